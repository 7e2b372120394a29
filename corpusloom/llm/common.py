"""What the operators share: the shared scratch folder, saved tables, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("corpusloom", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_written: list[str] = []


def saved(df: DataFrame, tag: str, partition: str = "") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and what was computed survives a lost executor."""
    path = f"{scratch(df.sparkSession)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    (df.write.partitionBy(partition) if partition else df.write).option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._corpusloom_path = path  # type: ignore[attr-defined]
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables written by saved() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_corpusloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what saved() wrote, from the since-th table still there on, but for `keep`. An operator's result reads some
    of its tables, so this is for when the result has been consumed."""
    for path in _written[since:]:
        if path != getattr(keep, "_corpusloom_path", None):
            _delete(spark, path)


def n_written() -> int:
    return len(_written)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_bucket(modulus: int):
    """crc32 of the decimal doc_id modulo a number; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def row_key():
    """A hash of doc_id and text; with the doc_id it tells documents apart: rows equal in both are the same one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


#: The columns of identity(), by which rows are grouped and joined.
IDENTITY = ["key", "id", "no_id"]


def identity(key, doc_id) -> list:
    """A row's key and its doc_id as two columns without nulls, so that plain joins can be on them."""
    return [key.alias("key"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), doc_id.isNull().alias("no_id")]
