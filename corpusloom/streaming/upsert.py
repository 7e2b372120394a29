"""Index maintenance from a stream of chunks: each micro-batch is merged by hash into the buckets that it touches.

A table is a folder of versioned buckets and of pointers (epoch, bucket, version); the newest pointer of a bucket counts.
A batch reads and writes only its buckets, and a batch that runs twice gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import last_rows, merged
from ..sources.store import exists

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder of each bucket's newest version; at most one for each bucket."""
    if not exists(spark, f"{root}/pointers"):
        return {}
    newest = spark.read.parquet(f"{root}/pointers").groupBy("bucket").agg(F.max_by("version", F.struct("epoch", "version")).alias("version"))
    return {r["bucket"]: f"{root}/data/{r['version']}/bucket={r['bucket']}" for r in newest.collect()}


def merge_batch(batch: DataFrame, root: str, epoch: int, order: Column | None = None, key: str = "chunk_id", buckets: int = BUCKETS) -> int:
    """Merge a batch into the table and give the number of buckets written.

    order: of rows with equal keys the one with the greatest counts; by default the last one read.
    """
    spark = batch.sparkSession
    new = last_rows(batch, key, order).withColumn("bucket", bucket_of(key, buckets)).persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if touched:
        at = pointers(spark, root)
        known = [at[b] for b in touched if b in at]
        out = merged(new, spark.read.parquet(*known).withColumn("bucket", bucket_of(key, buckets)), key) if known else new
        version = uuid.uuid4().hex
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{version}")
        spark.createDataFrame([(epoch, b, version) for b in touched], "epoch long, bucket int, version string").coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    new.unpersist()
    return len(touched)


def stream_upsert(chunks: DataFrame, root: str, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """chunks: a streaming DataFrame with chunk_id and content_sha."""
    return chunks.writeStream.foreachBatch(lambda df, epoch: merge_batch(df, root, epoch, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, root: str) -> DataFrame:
    at = pointers(spark, root)
    if not at:
        raise FileNotFoundError(root)
    return spark.read.parquet(*at.values())
