"""Command line: python -m corpusloom.cli COMMAND …

list; run NAME DIR; process RAW OUT; chunk PROCESSED OUT; index-build CHUNKS OUT; index-info INDEX; bm25-info INDEX;
bm25-query INDEX TEXT; index-query INDEX TEXT; hybrid-query INDEX TEXT; rerank-query INDEX TEXT; agent-query INDEX TEXT;
eval INDEX QUERIES GOLD (tables of query_id, text and of query_id, doc_id, where doc_id is a chunk). process and chunk take
--force and --limit, process also --only KIND. Results are tables, or JSON lines with --json.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators import embed, evaluate, index, search
from .plans import agent, hybrid
from .sources import ingest, store


def _show(df: DataFrame, as_json: bool, n: int) -> None:
    if as_json:
        for line in df.limit(n).toJSON().collect():
            print(line)
    else:
        df.show(n, truncate=80)


def build_index(chunks: DataFrame, out: str) -> None:
    """chunks (chunk_id, text, …) -> the tables of an index below a folder; postings are sorted by term for pruning."""
    chunks.write.mode("overwrite").parquet(f"{out}/chunks")

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return chunks.sparkSession.read.parquet(f"{out}/{name}")

    index.write_index(store.spread(chunks.select("chunk_id", "text")), write, "chunk_id")
    embed.embed_chunks(chunks).write.mode("overwrite").parquet(f"{out}/vectors")


def load_index(spark: SparkSession, at: str) -> hybrid.Index:
    t = {n: spark.read.parquet(f"{at}/{n}") for n in ("chunks", "postings", "lengths", "vectors")}
    chunks = t["chunks"]
    for c in ("parent_id", "doc_id", "title", "url", "section"):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    parents = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.min_by("text", "chunk_id").alias("text"), F.lit(0).alias("token_count"))
    return hybrid.Index(chunks, t["postings"], t["lengths"], index.corpus_stats(t["lengths"]), t["vectors"], parents)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("command", choices=["list", "run", "process", "chunk", "index-build", "index-info", "bm25-info", "bm25-query", "index-query", "hybrid-query", "rerank-query", "agent-query", "eval"])
    p.add_argument("args", nargs="*")
    p.add_argument("--json", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--only")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--top-n", type=int, default=10)
    o = p.parse_args(argv)
    if o.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    a = o.args
    if o.command == "run":
        _show(catalog.QUERIES[a[0]](spark, a[1]), o.json, o.top_n)
    elif o.command == "process":
        done = ingest.process(spark, a[0], a[1], force=o.force, only=o.only, limit=o.limit)
        _show(done.select("doc_id", "kind", "ok", "error", "content_chars").orderBy("doc_id"), o.json, o.top_n)
    elif o.command == "chunk":
        _show(ingest.chunk(spark, a[0], a[1], o.force, o.limit).orderBy("doc_id"), o.json, o.top_n)
    elif o.command == "index-build":
        build_index(spark.read.parquet(a[0]), a[1])
    else:
        at = load_index(spark, a[0])
        if o.command == "index-info":
            _show(at.chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents")), o.json, 1)
            return
        if o.command == "bm25-info":
            terms = at.postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
            _show(at.stats.join(terms, how="cross"), o.json, 1)  # one row each
            return
        if o.command == "eval":
            queries, gold = spark.read.parquet(a[1]).select("query_id", "text"), spark.read.parquet(a[2])
            before, _ = hybrid.retrieve(embed.embed_queries(queries), at, hybrid.DEFAULTS.top_n, hybrid.DEFAULTS.excluded_sections)
            _show(evaluate.deltas(before, search.rerank(before, queries, hybrid.DEFAULTS.keep_k), gold), o.json, 1)
            return
        queries = spark.createDataFrame([(-1, a[1])], "query_id long, text string")
        if o.command == "bm25-query":
            _show(search.bm25(queries, at.postings, at.lengths, at.stats, o.top_n), o.json, o.top_n)
        elif o.command == "index-query":
            _show(search.dense(embed.embed_queries(queries), at.vectors, o.top_n), o.json, o.top_n)
        elif o.command == "rerank-query":
            packs, _ = hybrid.retrieve_and_rerank(embed.embed_queries(queries), at)
            _show(packs.select("final_rank", "fusion_rank", "chunk_id", "reranker_score", "child_text").orderBy("final_rank"), o.json, o.top_n)
        elif o.command == "agent-query":
            asked = queries.select(F.col("query_id").alias("request_id"), F.col("text").alias("query"), F.lit(False).alias("use_web"))

            def find(todo: DataFrame) -> DataFrame:
                numbered = todo.select(F.col("request_id").alias("query_id"), F.col("query").alias("text"))
                return hybrid.retrieve_and_rerank(embed.embed_queries(numbered), at)[0].withColumnRenamed("query_id", "request_id").withColumn("source_type", F.lit("internal"))

            store.shared_folder(spark)  # the loop's checkpoints go there
            _show(agent.answer(asked, find), o.json, 1)
        else:
            packs, _ = hybrid.retrieve(embed.embed_queries(queries), at, o.top_n)
            _show(packs.orderBy("final_rank"), o.json, o.top_n)


if __name__ == "__main__":
    main()
