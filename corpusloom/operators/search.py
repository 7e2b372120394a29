"""Retrieval for many queries at once: BM25 with phrases, exact and LSH cosine, fusion, parents, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import text as T
from ..sources.store import written


def ranked(df: DataFrame, n: int | None, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if n is None else out.where(F.col(name) <= n)


def query_phrases(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) -> (query_id, phrase, subs, n_phrases): each token of a query is a phrase of sub-tokens."""
    tokens = queries.select("query_id", T.terms(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    out = tokens.select("query_id", F.size("tokens").alias("n_phrases"), F.posexplode("tokens").alias("phrase", "token"))
    return out.select("query_id", "n_phrases", "phrase", F.split("token", "[-_.]").alias("subs"))


def phrase_hits(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, n_phrases, phrase, chunk_id, tf): documents where the sub-tokens stand side by side, and how often."""
    one = phrases.where(F.size("subs") == 1).select("query_id", "n_phrases", "phrase", F.element_at("subs", 1).alias("term"))
    single = one.join(postings, "term").select("query_id", "n_phrases", "phrase", "chunk_id", F.col("tf").cast("long").alias("tf"))
    many = phrases.where(F.size("subs") > 1).select("query_id", "n_phrases", "phrase", F.size("subs").alias("m"), F.posexplode("subs").alias("off", "term"))
    starts = many.join(postings, "term").select("query_id", "n_phrases", "phrase", "m", "chunk_id", "off", F.explode("positions").alias("pos"))
    starts = starts.groupBy("query_id", "n_phrases", "phrase", "m", "chunk_id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count_distinct("off").alias("k"))
    return single.union(starts.where("k = m").groupBy("query_id", "n_phrases", "phrase", "chunk_id").agg(F.count("*").alias("tf")))


def _phrase_filter(phrases: DataFrame, log_bits: int) -> DataFrame:
    """One row (words, longest): a Bloom filter of 2 ** log_bits bits over the heads of phrases, and their greatest length."""
    n = 1 << (log_bits - 6)
    bits = phrases.select(F.explode(F.array(*_bits(F.col("head"), log_bits))).alias("bit"))
    bits = bits.select(F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    none = phrases.sparkSession.range(n).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return words.join(phrases.agg(F.coalesce(F.max("m"), F.lit(0)).alias("longest")), how="cross")


def _bits(head: Column, log_bits: int) -> tuple[Column, Column]:
    """Two places of a 64-bit hash in a filter of 2 ** log_bits bits."""
    low = F.lit((1 << log_bits) - 1)
    return head.bitwiseAND(low), F.shiftrightunsigned(head, 32).bitwiseAND(low)


def token_hits(phrases: DataFrame, tokens: DataFrame, log_bits: int = 20) -> DataFrame:
    """phrase_hits with dl, by one pass over tokenized documents instead of the postings of every sub-token.

    The first two sub-tokens of a phrase (or its only one) are its head. A filter of fixed size over the heads keeps all other
    places of the documents out of the shuffle; where it is too small for the phrases, more is shuffled and the result is the
    same. What follows a place in its document is compared with the whole phrase.
    """
    head = lambda *terms: F.xxhash64(*terms)
    p = phrases.withColumn("m", F.size("subs")).withColumn("head", F.when(F.col("m") > 1, head(F.get("subs", F.lit(0)), F.get("subs", F.lit(1)))).otherwise(head(F.get("subs", F.lit(0)))))
    seen = _phrase_filter(p, log_bits)
    words, longest = seen.select("words").scalar(), seen.select("longest").scalar()
    at = tokens.select("chunk_id", "subs", F.posexplode("subs").alias("pos", "term"))
    following = F.get("subs", F.col("pos") + 1)
    heads = F.when(following.isNull(), F.array(head("term"))).otherwise(F.array(head("term"), head("term", following)))
    at = at.select("chunk_id", "subs", "pos", F.explode(heads).alias("head"))
    known = [F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in _bits(F.col("head"), log_bits)]
    at = at.where(known[0] & known[1]).select("head", "chunk_id", F.size("subs").cast("long").alias("dl"), F.slice("subs", F.col("pos") + 1, longest).alias("found"))
    hits = at.join(p, "head").where(F.slice("found", F.lit(1), F.col("m")) == F.col("subs"))
    return hits.groupBy("query_id", "n_phrases", "phrase", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, postings: DataFrame, lengths: DataFrame, stats: DataFrame, n: int | None = 20, keep: DataFrame | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, score, rank). All phrases must occur; statistics are those of the whole corpus.

    keep: the chunk_ids that may be returned; it filters after scoring.
    """
    return _scored(phrase_hits(query_phrases(queries), postings), lengths, stats, n, keep, config)


def bm25_scan(queries: DataFrame, tokens: DataFrame, stats: DataFrame, n: int | None = 20, keep: DataFrame | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """As bm25, but without postings: for many phrases of frequent sub-tokens, whose postings are far more than their hits."""
    hits = written(token_hits(query_phrases(queries), tokens), "hits")
    return _scored(hits, None, stats, n, keep, config)


def _scored(hits: DataFrame, lengths: DataFrame | None, stats: DataFrame, n: int | None, keep: DataFrame | None, config: EngineConfig) -> DataFrame:
    """Hits, with dl if lengths is None, as ranked results."""
    seen = hits.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    k1, b = config.bm25_k1, config.bm25_b
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(seen, ["query_id", "phrase"])
    scored = (scored if lengths is None else scored.join(lengths, "chunk_id")).join(F.broadcast(stats), how="cross")  # stats: one row
    scored = scored.groupBy("query_id", "chunk_id", "n_phrases").agg(F.count("*").alias("got"), F.sum(part).alias("score")).where("got = n_phrases")
    if keep is not None:
        scored = scored.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi")
    # the parts of a score are added in any order; nine decimals make equal documents equal, so that reruns agree
    return ranked(scored.select("query_id", "chunk_id", F.round("score", 9).alias("score")), n, F.desc("score"), F.asc("chunk_id"))


def _pack(df: DataFrame, key: str, ids: str, vec: str, size: int) -> DataFrame:
    """Blocks of vectors as rows of (key, ids, mat), a bounded number in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, size):
                part = t.slice(at, size)
                rows = [np.array(v.as_py(), np.float64) for v in part.column(1)]
                for d in sorted({len(r) for r in rows}):
                    sel = [i for i, r in enumerate(rows) if len(r) == d]
                    block = np.stack([rows[i] for i in sel])
                    own = np.array([part.column(0)[i].as_py() for i in sel], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary()), pa.array([d], pa.int32())], [f"{key}_ids", f"{key}_mat", "dim"])

    return df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(F.col(ids).cast("long").alias("id"), vec).mapInArrow(run, f"{key}_ids binary, {key}_mat binary, dim int")


def dense(queries: DataFrame, vectors: DataFrame, n: int = 20, threshold: float = 0.0, block: int = 2048) -> DataFrame:
    """queries (query_id, embedding), vectors (chunk_id, embedding) -> (query_id, chunk_id, score, rank): exact cosine top n.

    Blocks of queries meet blocks of vectors; each pair gives its local top n. A query is not its own result. Zero vectors
    score nothing. threshold applies only above 0.
    """
    q, v = _pack(queries, "q", "query_id", "embedding", block), _pack(vectors, "v", "chunk_id", "embedding", block)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = v.withColumn("part", F.pmod(F.xxhash64("v_ids"), F.lit(parts)).cast("int")).join(q, ["part", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                qi, vi = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["v_ids"], np.int64)
                a, b = (np.frombuffer(r[m], np.float64).reshape(-1, r["dim"]) for m in ("q_mat", "v_mat"))
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (a @ b.T) / (na[:, None] * nb[None, :])
                s[~np.isfinite(s) | (qi[:, None] == vi[None, :])] = -np.inf
                if threshold > 0:
                    s[s < threshold] = -np.inf
                if s.shape[1] > n:  # all that reach the n-th best score of their query
                    edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
                else:
                    i, j = np.nonzero(s > -np.inf)
                order = np.lexsort((vi[j], -s[i, j], i))
                i, j = i[order], j[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < n
                if top.any():
                    i, j = i[top], j[top]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(vi[j]), pa.array(s[i, j])], ["query_id", "chunk_id", "score"])

    return ranked(pairs.mapInArrow(run, "query_id long, chunk_id long, score double"), n, F.desc("score"), F.asc("chunk_id"))


def dense_lsh(queries: DataFrame, vectors: DataFrame, n: int = 20, bucket: float = 1.0, tables: int = 6, distance: float = 1.2) -> DataFrame:
    """As dense, but candidates come from random projections of unit vectors; scores of candidates are exact."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df: DataFrame, key: str) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias(key), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="unit").transform(df).drop("raw")

    q, v = unit(queries, "query_id"), unit(vectors, "chunk_id")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(v)
    near = model.approxSimilarityJoin(q, v, distance, "distance").select("datasetA.query_id", "datasetB.chunk_id", "distance").where("query_id <> chunk_id")
    return ranked(near.withColumn("score", 1 - F.col("distance") ** 2 / 2).drop("distance"), n, F.desc("score"), F.asc("chunk_id"))


def rrf(dense_hits: DataFrame, bm25_hits: DataFrame, k: int = 60, dense_weight: float = 1.0, bm25_weight: float = 1.0) -> DataFrame:
    """Fusion by reciprocal ranks; ties by dense rank, then BM25 rank, then id. A score that a chunk does not have is 0."""
    d = dense_hits.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = bm25_hits.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = d.join(b, ["query_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf_score", part(dense_weight, "dense_rank") + part(bm25_weight, "bm25_rank"))
    both = both.withColumn("in_dense", F.col("dense_rank").isNotNull()).withColumn("in_bm25", F.col("bm25_rank").isNotNull()).withColumn("in_both", F.col("in_dense") & F.col("in_bm25"))
    both = both.na.fill(0.0, ["dense_score", "bm25_score"])
    return ranked(both, None, F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("chunk_id"), name="final_rank")


def without_sections(fused: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Drop chunks whose section contains any of the names, whatever its case."""
    hit = F.lit(False)
    for name in excluded:
        hit = hit | F.contains(F.lower(F.coalesce("section", F.lit(""))), F.lit(name.lower()))
    return fused.where(~hit)


def prefetched(fused: DataFrame, k: int) -> DataFrame:
    return fused.where(F.col("final_rank") <= max(3 * k, 15))


def best_of_parent(fused: DataFrame) -> DataFrame:
    """One chunk for each parent, the best; chunks without a parent stand for themselves."""
    key = F.coalesce(F.nullif(F.col("parent_id").cast("string"), F.lit("")), F.col("chunk_id").cast("string"))
    out = fused.withColumn("_p", key)
    place = F.row_number().over(Window.partitionBy("query_id", "_p").orderBy("final_rank"))
    return out.withColumn("_rn", place).where("_rn = 1").drop("_p", "_rn")


def with_parent(packs: DataFrame, parents: DataFrame, most: int = 6000) -> DataFrame:
    """parent_text (cut) and parent_tokens of each pack; empty and 0 where there is no such parent."""
    p = parents.select("parent_id", T.parent_cut(F.col("text"), most).alias("parent_text"), F.col("token_count").alias("parent_tokens"))
    out = packs.join(p, "parent_id", "left")
    return out.withColumn("parent_text", F.coalesce("parent_text", F.lit(""))).withColumn("parent_tokens", F.coalesce("parent_tokens", F.lit(0)))


def signals(fused: DataFrame) -> DataFrame:
    """Confidence of each query, before parents are merged: top score, gap, provenance counts, agreement of the first."""
    score = lambda r: F.max(F.when(F.col("place") == r, F.col("rrf_score")))
    s = ranked(fused, None, F.asc("final_rank"), name="place")
    count = lambda c: F.count_if(c)
    out = s.groupBy("query_id").agg(
        score(1).alias("top"), score(2).alias("second"),
        count(F.col("in_dense") & ~F.col("in_bm25")).alias("dense_only"), count(~F.col("in_dense") & F.col("in_bm25")).alias("bm25_only"), count(F.col("in_both")).alias("both"),
        F.bool_or((F.col("place") == 1) & F.col("in_both")).alias("agreement"),
    )
    gap = F.when(F.col("second").isNull(), F.col("top")).otherwise(F.col("top") - F.col("second"))
    return out.select("query_id", F.round("top", 6).alias("top_score"), F.round(gap, 6).alias("score_gap"), "dense_only", "bm25_only", "both", "agreement")


def keyword_coverage(queries: DataFrame, packs: DataFrame, preview: str = "child_text") -> DataFrame:
    """Share of a query's words that occur in one of its previews; 0 without words or packs."""
    words = queries.select("query_id", F.explode_outer(F.split(F.lower(F.trim("text")), "\\s+")).alias("w")).where("w <> ''")
    hit = words.join(packs.select("query_id", F.lower(preview).alias("p")), "query_id", "left").groupBy("query_id", "w").agg(F.max(F.coalesce(F.contains("p", "w"), F.lit(False))).alias("hit"))
    got = hit.groupBy("query_id").agg(F.round(F.avg(F.col("hit").cast("double")), 3).alias("coverage"))
    return queries.select("query_id").join(got, "query_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def lexical_score(query: Column, text: Column) -> Column:
    """The default pair scorer: share of the query's terms that the text has."""
    q = T.terms(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, T.terms(text))) / F.size(q))


def rerank(packs: DataFrame, queries: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """Score (query, parent text or else child text), best first, ties by the prior rank; at most k."""
    text = F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("child_text"))
    scored = packs.join(queries.select("query_id", F.col("text").alias("_query")), "query_id").withColumn("reranker_score", F.coalesce(scorer(F.col("_query"), text), F.lit(0.0)))
    return ranked(scored.drop("_query").withColumnRenamed("final_rank", "fusion_rank"), k, F.desc("reranker_score"), F.asc("fusion_rank"), name="final_rank")


def rerank_key(queries: DataFrame, packs: DataFrame, model: str = "lexical") -> DataFrame:
    """Cache key of a reranking: model, query and the sorted candidate ids."""
    ids = packs.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("chunk_id").cast("string"))), ",").alias("ids"))
    return queries.join(ids, "query_id").select("query_id", F.sha2(F.concat_ws("|", F.lit(model), "text", "ids"), 256).alias("key"))
