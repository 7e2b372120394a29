"""Tables that outlive a query: written once below the folder that driver and executors share, and read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-store-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder with all in it; whether it was there."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores is dealt out; one file may be a single row group."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file of a table: another one once the table is written anew."""
    p, fs = _path(spark, path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table below the shared folder: computed once, whatever is written to what it was read from."""
    at = f"{shared_folder(df.sparkSession)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_kept: dict[tuple, dict[str, str]] = {}


def kept_tables(spark: SparkSession, source: str, kind: str, build: Callable[[Callable[[str, DataFrame], DataFrame]], None]) -> dict[str, DataFrame]:
    """The tables that `build` makes of the table at `source` through the function write(name, df) that it is given.

    They are written when first asked for in this application, and again when the source has changed.
    """
    key = (spark.sparkContext.applicationId, kind, fingerprint(spark, source))
    if key not in _kept:
        at, paths = f"{shared_folder(spark)}/corpusloom/{kind}-{uuid.uuid4().hex}", {}

        def write(name: str, df: DataFrame) -> DataFrame:
            paths[name] = f"{at}/{name}"
            df.write.parquet(paths[name])
            return spark.read.parquet(paths[name])

        build(write)
        _kept[key] = paths
    return {name: spark.read.parquet(path) for name, path in _kept[key].items()}


def drop_kept(spark: SparkSession) -> int:
    """Delete all kept tables of this application; how many sets of tables there were."""
    mine = [k for k in _kept if k[0] == spark.sparkContext.applicationId]
    for k in mine:
        delete(spark, next(iter(_kept.pop(k).values())).rsplit("/", 1)[0])
    return len(mine)
