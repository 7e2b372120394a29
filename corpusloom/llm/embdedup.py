"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Each of `tables` hashes joins `parts` cross-polytope codes: the vector is rotated (three rounds of random signs and a
Hadamard transform) and the coordinate of largest magnitude, with its sign, is its code. A vector lies in its own bucket
and in those of its `probes` next likeliest codes. Pairs that share a bucket, at home for one of them, are verified by
cosine in double precision. A pair that meets several times counts in the first table where it does.

A bucket is gone through twice. First its members come with 256 signs of rotated coordinates each; only those with a
partner whose signs differ in at most the expected number at the threshold plus seven deviations come again, with their
vectors. (At a cosine of 0.9, 76 of 256; unrelated vectors differ in 128 with a deviation of 8.)

Equal vectors are one class with a multiplicity. A bucket is compared in blocks of bounded size; a block gives each
member's number of links and the links of a spanning forest, never all its pairs.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing and stand for themselves;
vectors of different lengths never link; repeated rows are links of each other; a null vec_id is never the smallest.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .components import connected_components
from .vectext import U, mix

_ALTERNATIVES = 4  # codes of a part that probes choose from


def vectors(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Double vectors of a list column and which are valid: not null, finite, without nulls, not zero."""
    out, ok = [], np.zeros(len(column), bool)
    for i, v in enumerate(column):
        values = v.values
        x = np.empty(0) if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok[i] = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
        out.append(x)
    return out, ok


def even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, padded to a power of two, after three rounds of signs and a fast Hadamard transform."""
    n, d = x.shape
    size = signs.shape[1]
    y = np.zeros((n, size))
    y[:, :d] = x
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            y = y.reshape(n, size // (2 * h), 2, h)
            y = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


_SIGNS = 256  # of rotated coordinates in a sketch, 64 of a rotation at most


def sketch_limit(least: float, signs: int) -> float:
    """The number of differing signs that a pair at the cosine `least` exceeds only beyond seven deviations."""
    p = np.arccos(least) / np.pi
    return signs * p + 7 * np.sqrt(signs * p * (1 - p))


def codes(x: np.ndarray, tables: int, parts: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables, 1 + probes) bucket numbers, the home bucket first; and the sketches, signs as bytes of 0 and 1."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    x = even(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, d])
    choice = np.array(list(itertools.product(range(min(_ALTERNATIVES, 2 * size)), repeat=parts)))
    out, signs = np.empty((n, tables, 1 + probes), np.int64), []
    for t in range(tables):
        cost, code = np.zeros((n, len(choice))), np.zeros((n, len(choice)), np.int64)
        for p in range(parts):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, size)))
            if sum(v.shape[1] for v in signs) < _SIGNS:
                signs.append(y[:, :64] > 0)
            both = np.concatenate((y, -y), axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :_ALTERNATIVES]
            gap = (both[np.arange(n)[:, None], top[:, :1]] - both[np.arange(n)[:, None], top]) ** 2
            cost += gap[:, choice[:, p]]
            code = code * (2 * size) + top[:, choice[:, p]]
        best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = code[np.arange(n)[:, None], best]
    return out, np.concatenate(signs, axis=1)[:, :_SIGNS]


def _hasher(tables: int, parts: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            vecs, ok = vectors(t.column(1))
            cls, dim, raw, buckets, sketch = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int32), [None] * len(ok), [None] * len(ok), [None] * len(ok)
            for d in {len(vecs[i]) for i in np.flatnonzero(ok)}:
                at = np.array([i for i in np.flatnonzero(ok) if len(vecs[i]) == d])
                x = np.stack([vecs[i] for i in at]) + 0.0  # no negative zeros
                c, signs = codes(x, tables, parts, probes, seed)
                c = c.reshape(len(at), -1)
                bits = x.view(U) * mix(np.arange(1, d + 1, dtype=U))
                cls[at], dim[at] = mix(np.sum(mix(bits), axis=1, dtype=U) + U(d)).view(np.int64), d
                packed = np.packbits(signs, axis=1)
                for k, i in enumerate(at):
                    raw[i], buckets[i], sketch[i] = x[k].tobytes(), c[k], packed[k].tobytes()
            cols = [t.column(0), pa.array(cls, mask=~ok), pa.array(dim), pa.array(raw, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cls", "dim", "raw", "buckets", "sketch"])

    return run


def _near(rows: pa.Table, least: float) -> pa.RecordBatch | None:
    """Of one pair of blocks of a bucket the members with a partner of a like sketch."""
    bi, bj = (rows.column(c)[0].as_py() for c in ("bi", "bj"))
    block = rows.column("block").to_numpy()
    x, y = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    if not len(x) or not len(y):
        return None
    signs = np.unpackbits(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1).astype(np.float32) * 2 - 1
    # padding bits are equal in all sketches
    differ = (signs.shape[1] - signs[x] @ signs[y].T) / 2
    like = differ <= sketch_limit(least, signs.shape[1])
    if bi == bj:
        np.fill_diagonal(like, False)
    hit = np.union1d(x[like.any(axis=1)], y[like.any(axis=0)])
    return rows.select(["cls", "dim", "table", "bucket", "block", "bi", "bj"]).take(pa.array(hit)).combine_chunks().to_batches()[0] if len(hit) else None


def _compare(rows: pa.Table, least: float, tables: int, probes: int) -> pa.RecordBatch | None:
    """One pair of blocks of a bucket -> (a, null, links of class a) and (a, b, null) for the links of a spanning forest."""
    table, bucket, bi, bj = (rows.column(c)[0].as_py() for c in ("table", "bucket", "bi", "bj"))
    cls, m, block = (rows.column(c).to_numpy() for c in ("cls", "m", "block"))
    x, y = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    if not len(x) or not len(y):
        return None
    raw = rows.column("raw").to_pylist()
    v = even(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    own = np.array(rows.column("buckets").to_pylist(), np.int64).reshape(len(raw), tables, 1 + probes)
    home = own[:, :, 0]
    link = (v[x] @ v[y].T) / (norm[x][:, None] * norm[y][None, :]) >= least
    link &= cls[x][:, None] < cls[y][None, :] if bi == bj else True
    hx, hy = home[x, table] == bucket, home[y, table] == bucket
    if not link.any():
        return None
    # in this table a pair counts at the home of its smaller class if the other has that bucket, else at the other's home
    in_y = (home[x, table][:, None, None] == own[y, table][None, :, :]).any(axis=2)
    in_x = (home[y, table][None, :, None] == own[x, table][:, None, :]).any(axis=2)
    link &= np.where(cls[x][:, None] < cls[y][None, :], hx[:, None] | (hy[None, :] & ~in_y), hy[None, :] | (hx[:, None] & ~in_x))
    for t in range(table):
        if not link.any():
            return None
        p, q = np.nonzero(link)
        met = (home[x[p], t][:, None] == own[y[q], t]).any(axis=1) | (home[y[q], t][:, None] == own[x[p], t]).any(axis=1)
        link[p[met], q[met]] = False
    p, q = np.nonzero(link)
    if not len(p):
        return None
    links = np.bincount(x[p], m[y[q]], len(raw)) + np.bincount(y[q], m[x[p]], len(raw))
    root = np.arange(len(raw))
    while True:  # labels fall to the least index that is linked
        low = root.copy()
        np.minimum.at(low, x[p], root[y[q]])
        np.minimum.at(low, y[q], root[x[p]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(raw)))
    a = np.concatenate((cls[some], cls[tied]))
    b = pa.array(np.concatenate((np.zeros(len(some), np.int64), cls[root[tied]])), mask=np.arange(len(a)) < len(some))
    n = pa.array(np.concatenate((links[some].astype(np.int64), np.zeros(len(tied), np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "n"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for t in batches:
        if not t.num_rows:
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cut], [*cut, t.num_rows], strict=True):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(t.slice(int(a), int(b - a)))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def embedding_dedup(vecs: DataFrame, *, least: float = 0.9, tables: int = 8, parts: int = 3, probes: int = 10, block: int = 512, seed: int = 5) -> DataFrame:
    """embeddings (vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each vector."""
    spark = vecs.sparkSession
    ship(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    hashed = saved(rows.mapInArrow(_hasher(tables, parts, probes, seed), "vec_id long, cls long, dim int, raw binary, buckets array<long>, sketch binary"), "hashed")
    classes = hashed.where("cls is not null").groupBy("cls").agg(F.count("*").alias("m"), *[F.min(c).alias(c) for c in ("dim", "raw", "buckets", "sketch")])
    classes = saved(classes, "classes")
    spread = classes.select("cls", "dim", F.posexplode("buckets").alias("pos", "bucket")).withColumn("table", F.floor(F.col("pos") / (1 + probes)).cast("int"))
    spread = spread.select("cls", "dim", "table", "bucket", (F.col("pos") % (1 + probes) == 0).cast("int").alias("home"))
    of = ["dim", "table", "bucket"]
    busy = spread.groupBy(*of).agg(F.count("*").alias("k"), F.sum("home").alias("homes")).where("k > 1 and homes > 0")
    busy = busy.select(*of, F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    dealt = spread.join(busy, of).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cls", *of, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    keys = [*of, "bi", "bj"]

    def by_group(f: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches, keys):
                if g.num_rows > 1 and (got := f(g)) is not None:
                    yield got

        return run

    def gathered(members: DataFrame, *columns: str) -> DataFrame:
        return members.join(classes.select("cls", *columns), "cls").repartition(n_parts, *keys).sortWithinPartitions(*keys)

    near = gathered(dealt, "sketch").mapInArrow(by_group(lambda g: _near(g, least)), "cls long, dim int, table int, bucket long, block int, bi int, bj int")
    found = gathered(saved(near, "near"), "m", "raw", "buckets").mapInArrow(by_group(lambda g: _compare(g, least, tables, probes)), "a long, b long, n long")
    found = saved(found, "found")
    links = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cls")
    comps = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    each = hashed.select("vec_id", "cls").join(classes.select("cls", "m"), "cls", "left").join(links, "cls", "left").join(comps, "cls", "left")
    each = saved(each.withColumn("root", F.coalesce("root", "cls")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))), "each")
    named = saved(each.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "named")
    out = each.join(named, "root", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
