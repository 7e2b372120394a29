"""Embedding in Arrow batches with a cache keyed by content hash; the default model is a unit vector seeded by the text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what stands before a query (not before a passage).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

Model = Callable[[list[str]], np.ndarray]


def seeded(texts: list[str], dim: int = 64) -> np.ndarray:
    """A unit normal vector for each text, seeded by the first 8 hex digits of its SHA-256."""
    rows = [np.random.default_rng(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)).normal(size=dim) for t in texts]
    out = np.array(rows, np.float32).reshape(len(texts), dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(texts: DataFrame, model: Model = seeded, cache: DataFrame | None = None, prefix: str = "", batch: int = 64) -> DataFrame:
    """texts (sha, text) -> (sha, embedding), one row for each hash; hashes in the cache (sha, embedding) are not encoded again."""
    once = texts.dropDuplicates(["sha"])
    todo = once if cache is None else once.join(cache.select("sha"), "sha", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, batch):
                part = t.slice(at, batch)
                vecs = model([prefix + (x or "") for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vecs), pa.list_(pa.float32()))], ["sha", "embedding"])

    new = todo.select("sha", "text").mapInArrow(run, "sha string, embedding array<float>")
    return new if cache is None else new.unionByName(cache.join(once.select("sha"), "sha", "left_semi").select("sha", "embedding"))


def embed_chunks(chunks: DataFrame, model: Model = seeded, cache: DataFrame | None = None) -> DataFrame:
    """chunks (chunk_id, text) -> (chunk_id, content_sha, embedding)."""
    keyed = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("sha"))
    return keyed.drop("text").join(embed(keyed.select("sha", "text"), model, cache), "sha").withColumnRenamed("sha", "content_sha")


def embed_queries(queries: DataFrame, model: Model = seeded) -> DataFrame:
    """queries (query_id, text) -> with embedding; the instruction prefix stands before the text."""
    keyed = queries.withColumn("sha", F.sha2("text", 256))
    return keyed.join(embed(keyed.select("sha", "text"), model, prefix=QUERY_PREFIX), "sha").drop("sha")
