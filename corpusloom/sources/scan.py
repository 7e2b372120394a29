"""Readers and writers of the ingest side, on Spark's sources and committers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "kind string, title string, tags array<string>, arxiv_id string, arxiv_version int, url string, version string, repo string, ref string, path string"


def _filled(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.trim(F.coalesce(F.col(n), F.lit(""))) != "")
    return out


def seeds(lines: DataFrame) -> DataFrame:
    """lines (value) of JSONL -> seeds with valid and error; blank and # lines are skipped."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    s = rows.select("value", F.from_json("value", SEED, {"mode": "PERMISSIVE"}).alias("s")).select("value", "s.*")
    s = s.withColumn("arxiv_version", F.coalesce("arxiv_version", F.lit(1))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    ok = F.when(F.col("kind") == "arxiv", _filled("arxiv_id")).when(F.col("kind") == "docs", _filled("url")).when(F.col("kind") == "github", _filled("repo", "path")).otherwise(False)
    return s.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("error", F.when(F.col("kind").isNull(), "no kind").when(~F.col("valid"), "missing field or unknown kind"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seeds(spark.read.text(path))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, name, content, sha256): every file below a folder of raw documents, each in a folder of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def kind(meta_kind: Column, names: Column) -> Column:
    """docs, github or pdf: as the metadata says, else by the files' names."""
    k = F.lower(F.trim(F.coalesce(meta_kind, F.lit(""))))
    has = lambda *ends: F.exists(names, lambda n: F.lower(n).rlike("(" + "|".join(ends) + ")$"))
    told = F.when(k.isin("docs", "html", "web"), "docs").when(k.isin("github", "code", "repo"), "github").when(k.isin("pdf", "arxiv", "paper"), "pdf")
    return F.coalesce(told, F.when(has("\\.pdf"), "pdf").when(has("\\.html", "\\.htm"), "docs").otherwise("github"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without its byte-order mark if it is valid, else windows-1252 (its five undefined bytes as in latin-1)."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    western = F.translate(F.decode(content, "iso-8859-1"), "".join(a for a, c in high if c), "".join(c for _, c in high if c))
    return F.coalesce(F.regexp_replace(utf8, "^﻿", ""), western)


def chosen_file(files: DataFrame, preferred: list[str], suffix: str) -> DataFrame:
    """One file for each doc_id: the first preferred name that is there, else the first with the suffix by name."""
    low = F.lower("name")
    order = F.coalesce(*[F.when(low == n, F.lit(i)) for i, n in enumerate(preferred)], F.lit(len(preferred)))
    pool = files.where(low.endswith(suffix) | low.isin(*preferred)) if preferred else files.where(low.endswith(suffix))
    return pool.groupBy("doc_id").agg(F.min_by("name", F.struct(order, "name")).alias("name"))


def todo(documents: DataFrame, done: DataFrame, force: bool = False, only: str | None = None, limit: int = 0) -> DataFrame:
    """What is left to do: of the kind, not done before unless forced, the first `limit` by doc_id (0: all)."""
    out = documents if only is None else documents.where(F.col("kind") == only)
    out = out if force else out.join(done.select("doc_id"), "doc_id", "left_anti")
    return out.orderBy("doc_id").limit(limit) if limit else out


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.withColumn("schema_version", F.lit(1)).write.mode("append").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str, doc_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, malformed lines) of JSONL files; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = rows.where("r._bad is null").select("r.*").drop("_bad")
    return (good if doc_ids is None else good.where(F.col("doc_id").isin(doc_ids))), rows.where("r._bad is not null").select("value")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by doc bucket, so that an upsert rewrites few partitions; Spark's commit is atomic for each job."""
    chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def written_chunks(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """Chunks of write_chunks; of some documents only their buckets are read, and the ids go down to the Parquet scan."""
    rows = spark.read.parquet(path)
    if doc_ids is None:
        return rows.drop("bucket")
    kind = rows.schema["doc_id"].dataType
    wanted = spark.createDataFrame([(str(d),) for d in doc_ids], "d string").select(F.pmod(F.xxhash64(F.col("d").cast(kind)), F.lit(64)).alias("b")).distinct()
    buckets = [r["b"] for r in wanted.collect()]  # 64 at most
    return rows.where(F.col("bucket").isin(buckets) & F.col("doc_id").isin([*doc_ids])).drop("bucket")


def web_results(fixture: DataFrame, n: int, order: str = "url") -> DataFrame:
    """The mock provider: the first n rows of a fixture, whatever the query."""
    return fixture.orderBy(order).limit(n)
