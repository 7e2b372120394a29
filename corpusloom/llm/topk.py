"""Exact top-k inner products by a three-phase uniform threshold.

The components are dealt to `nodes` slices; a vector's score is the sum of its slice scores. (1) Every slice gives its
local list, the k best slice scores for each query, and its least one; summed over the lists they give a k-th best total so
far, which no true member of the top k falls below. (2) A vector that reaches this total reaches 1/nodes of it in at
least one slice (scores counted from the slice's least). The slices are gone through one after the other, and a vector is
left out of the next ones as soon as what it has, and at most the product of the two slices' lengths for each slice to
come, leaves it short of the cutoff. (3) What is left has its exact scores, and the k best of those are given.

Vectors and queries go in blocks, every block of vectors with every block of queries, so that a task holds two blocks.
The cutoffs travel with their block of queries. In the lists a row is known by its block and place, as a vec_id may have
several rows.

Cases: vectors null, empty or with null or non-finite components take no part, nor do those with a component so large that a
score might not fit a long (its square times the number of components); vectors of another length than the query are no
candidates; rows that share a query's vec_id are its own and no candidates of it, and of several such rows the query is
the one with the least bytes; other repeated rows are candidates each; a null vec_id takes no part; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship


def _quantised(v: pa.ListScalar, scale: int) -> bytes | None:
    values = v.values
    if values is None or values.null_count:
        return None
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(x).all() or not len(x):
        return None
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    return x.astype(np.int64).tobytes() if np.abs(x).max() <= math.isqrt((2**63 - 1) // len(x)) else None


def _quantiser(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([_quantised(v, scale) for v in t.column(1)], pa.binary())], ["vec_id", "raw"])

    return run


def _blocker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ids, raw = t.column(0).to_pylist(), t.column(1).to_pylist()
            by: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by.setdefault(len(r), []).append(i)
            for length, at in by.items():
                for k in range(0, len(at), size):
                    some = at[k : k + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([length // 8], pa.int32()), pa.array([np.array([ids[i] for i in some], np.int64).tobytes()], pa.binary()), pa.array([b"".join(raw[i] for i in some)], pa.binary())],
                        ["dim", "ids", "mat"],
                    )

    return run


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, dim)


def _slices(q: np.ndarray, x: np.ndarray, nodes: int) -> np.ndarray:
    """(nodes, queries, vectors) exact slice scores."""
    cut = np.array_split(np.arange(q.shape[1]), nodes)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if exact else np.int64  # doubles hold these sums exactly; else integers, more slowly
    return np.stack([q[:, c].astype(kind) @ x[:, c].astype(kind).T for c in cut])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _local(k: int, nodes: int):
    """Phase 1: (query_id, node, least, block, row, vec_id, score) of each slice's local list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                q, x = _matrix(r["q_mat"], r["dim"]), _matrix(r["mat"], r["dim"])
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                out: list[list] = [[], [], [], [], [], [], []]
                for node, s in enumerate(_slices(q, x, nodes)):
                    for i in range(len(q)):
                        other = np.flatnonzero(ids != q_ids[i])
                        if not len(other):
                            continue
                        top = other[_best(s[i, other], ids[other], k)]
                        for o, v in zip(out, (np.full(len(top), q_ids[i]), np.full(len(top), node), np.full(len(top), s[i].min()), np.full(len(top), r["block"]), top, ids[top], s[i, top]), strict=True):
                            o.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["query_id", "node", "least", "block", "row", "vec_id", "score"])

    return run


def _survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray, cutoff: np.ndarray, alive: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the pairs that may reach the cutoff: score less the slices' least (queries, nodes) >= cutoff.

    A slice's scores are computed for whole blocks while many pairs are left, and pair by pair when few are.
    """
    cut = np.array_split(np.arange(q.shape[1]), nodes)
    q_long, x_long = (np.stack([np.sqrt((m[:, c].astype(np.float64) ** 2).sum(axis=1)) for c in cut]) for m in (q, x))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    qs, xs = q.astype(kind), x.astype(kind)
    enough = cutoff + least.sum(axis=1)
    enough -= np.abs(enough) * 1e-12 + nodes  # sums of large doubles are rounded
    share = cutoff / nodes - np.abs(cutoff) * 1e-12 - 1
    total, seen = np.zeros(alive.shape, kind), np.zeros(alive.shape, bool)
    node = 0
    while node < nodes:
        score = qs[:, cut[node]] @ xs[:, cut[node]].T
        total += score
        seen |= score >= (share + least[:, node])[:, None]
        node += 1
        rest = (q_long[node:].T @ x_long[node:]) * (1 + 1e-9) if node < nodes else 0.0
        alive = alive & (total + rest >= enough[:, None])
        if 16 * np.count_nonzero(alive) < alive.size:
            break
    if node == nodes:
        alive &= seen
    i, j = np.nonzero(alive)
    total, seen = total[i, j].astype(np.int64), seen[i, j]
    for later in range(node, nodes):
        score = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 16):
            score[a : a + (1 << 16)] = np.einsum("pc,pc->p", qs[i[a : a + (1 << 16)]][:, cut[later]], xs[j[a : a + (1 << 16)]][:, cut[later]])
        total, seen = total + score, seen | (score >= share[i] + least[i, later])
        rest = sum((q_long[n, i] * x_long[n, j] * (1 + 1e-9) for n in range(later + 1, nodes)), np.zeros(len(i)))
        keep = (total + rest >= enough[i]) & (seen if later == nodes - 1 else True)
        i, j, total, seen = i[keep], j[keep], total[keep], seen[keep]
    return i, j, total


def _resolve(k: int, nodes: int):
    """Phases 2 and 3 for a pair of blocks: the entries that may matter with their exact scores, k for each query at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                q, x = _matrix(r["q_mat"], r["dim"]), _matrix(r["mat"], r["dim"])
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                least, cutoff = np.array(r["least"], np.int64).reshape(-1, nodes), np.array(r["cutoff"], np.float64)
                i, j, total = _survivors(q, x, least, cutoff, ids[None, :] != q_ids[:, None], nodes)
                order = np.lexsort((ids[j], -total, i))
                i, j, total = i[order], j[order], total[order]
                first = np.searchsorted(i, np.arange(len(q)))
                top = np.arange(len(i)) - first[i] < k
                if top.any():
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[top]]), pa.array(ids[j[top]]), pa.array(total[top])], ["query_id", "vec_id", "score"])

    return run


def top_k(vecs: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, nodes: int = 4, block: int = 2048, query_block: int = 256) -> DataFrame:
    """embeddings (vec_id, embedding) -> (query_id, rank, vec_id, score): for each row with vec_id mod `every` = 0 its k best.

    The score is the integer inner product of floor(scale * component); ties go to the smaller vec_id.
    """
    spark = vecs.sparkSession
    ship(spark)
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = saved(rows.mapInArrow(_quantiser(scale), "vec_id long, raw binary").where("raw is not null"), "quantised")
    blocks = saved(rows.mapInArrow(_blocker(block), "dim int, ids binary, mat binary").withColumn("block", F.monotonically_increasing_id()), "vec-blocks")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("raw").alias("raw"))
    asked = asked.withColumn("dim", (F.length("raw") / 8).cast("int"))
    asked = saved(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // query_block)))).cast("int")), "asked")
    n_blocks = (asked.agg(F.max("qb")).first()[0] or 0) + 1
    spread = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def paired(queries: DataFrame) -> DataFrame:
        extra = [c for c in ("least", "cutoff") if c in queries.columns]
        q = queries.groupBy("qb", "dim").agg(F.sort_array(F.collect_list(F.struct("vec_id", "raw", *extra))).alias("q"))
        q = q.mapInArrow(_joined(nodes, bool(extra)), "qb int, dim int, q_ids binary, q_mat binary" + (", least array<long>, cutoff array<double>" if extra else ""))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return spread.join(q, ["qb", "dim"]).repartition(parts, "qb", F.xxhash64("ids"))

    lists = saved(paired(asked).mapInArrow(_local(k, nodes), "query_id long, node long, least long, block long, row long, vec_id long, score long"), "lists")
    least = lists.groupBy("query_id", "node").agg(F.min("least").alias("least"))
    place = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id", "block", "row"))
    best = lists.withColumn("place", place).where(F.col("place") <= k).join(least.withColumnRenamed("least", "floor"), ["query_id", "node"])
    partial = best.groupBy("query_id", "block", "row").agg(F.sum(F.col("score") - F.col("floor")).alias("sum"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum")))
    cutoff = partial.withColumn("place", nth).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count("*") < k, 0).otherwise(F.min("sum")).alias("cutoff"))
    floors = least.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "least"))), lambda s: s["least"]).alias("least"))
    ready = asked.join(floors.join(cutoff, "query_id").withColumnRenamed("query_id", "vec_id"), "vec_id")
    found = paired(ready).mapInArrow(_resolve(k, nodes), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _joined(nodes: int, extra: bool):
    """A block of queries as one row of matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                cols = [pa.array([r["qb"]], pa.int32()), pa.array([r["dim"]], pa.int32()), pa.array([np.array([x["vec_id"] for x in r["q"]], np.int64).tobytes()], pa.binary()), pa.array([b"".join(x["raw"] for x in r["q"])], pa.binary())]
                names = ["qb", "dim", "q_ids", "q_mat"]
                if extra:
                    cols += [pa.array([[v for x in r["q"] for v in x["least"]]], pa.list_(pa.int64())), pa.array([[float(x["cutoff"]) for x in r["q"]]], pa.list_(pa.float64()))]
                    names += ["least", "cutoff"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run
