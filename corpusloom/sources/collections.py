"""Collections of vectors with payload columns: a bucketed table with a fixed dimension, made, filled, counted and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import upsert
from .store import delete, exists

#: The columns that a point carries beside its vector, which searches filter by and return.
PAYLOAD = ("chunk_id", "parent_id", "doc_id", "title", "url", "section", "source_type", "is_table", "is_code", "token_count", "content_sha")


def ensure(spark: SparkSession, root: str, dim: int, recreate: bool = False) -> bool:
    """Make the collection if it is not there (or anew); whether it was made. Another dimension than before is an error."""
    if recreate:
        drop(spark, root)
    if exists(spark, f"{root}/collection"):
        known = info(spark, root)["dim"]
        if known != dim:
            raise ValueError(f"the collection has {known} dimensions, not {dim}")
        return False
    spark.createDataFrame([(dim, "cosine")], "dim int, distance string").coalesce(1).write.parquet(f"{root}/collection")
    return True


def drop(spark: SparkSession, root: str) -> None:
    delete(spark, root)


def put(points: DataFrame, root: str, epoch: int = 0) -> tuple[int, int]:
    """Upsert points (chunk_id, content_sha, embedding and payload columns): (buckets written, points of a wrong dimension, left out)."""
    dim = info(points.sparkSession, root)["dim"]
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    for c in PAYLOAD:
        if c not in points.columns:
            points = points.withColumn(c, F.lit(None).cast("string"))
    wrong = points.where(~fits).count()
    return upsert.merge_batch(points.where(fits), root, epoch), wrong


def points(spark: SparkSession, root: str) -> DataFrame:
    return upsert.read_index(spark, root)


def info(spark: SparkSession, root: str) -> dict:
    """Dimension, distance and number of points of a collection."""
    r = spark.read.parquet(f"{root}/collection").first()
    n = points(spark, root).count() if upsert.pointers(spark, root) else 0
    return {"dim": r["dim"], "distance": r["distance"], "points": n}
