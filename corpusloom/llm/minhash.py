"""MinHash near-duplicate detection: hash minima in bands, signature and exact verification, star components.

Documents with equal shingle sets form one class first, so copies never meet in a bucket. Within a bucket the classes
are first compared with two leaders, by signature and then on their full shingle sets. Where a bucket still spans several
components, all pairs of different components are compared in blocks of bounded size, again by signature and on full
sets; a block gives only the links that join components. Thus no link that a bucket shows is lost, and no group is
expanded into rows for all its pairs.

Cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing; fewer words than
`words` make one shingle of the whole sequence; repeated rows are one class and each gets its row in the result; a
null doc_id takes part by its text, is never the smallest id and is not kept unless no row of its component has an id.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, row_key, saved, ship
from .components import connected_components
from .vectext import U, Words, mix, pieces

_WEIGHTS = mix(np.arange(1, 65, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def shingles(w: Words, i: int, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of document i."""
    a, b = w.doc[i], w.doc[i + 1]
    n = int(b - a)
    if n == 0:
        return np.empty(0, U)
    h = w.hash[a:b]
    if n < words:  # the length enters, so that a short text differs from any shingle
        return mix(np.array([np.sum(h * _WEIGHTS[:n], dtype=U) + U(n)], U))
    s = h[: n - words + 1] * _WEIGHTS[0]
    for k in range(1, words):
        s += h[k : n - words + 1 + k] * _WEIGHTS[k]
    s = np.sort(mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _fingerprint(s: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two independent 64-bit sums over a whole set: both are equal for equal sets only, but for a chance of 2^-128 a pair."""
    return tuple(mix(np.array([np.sum(mix(s ^ U(c)), dtype=U) + U(len(s))], U)).view(np.int64)[0] for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))  # type: ignore[return-value]


def _hashes(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, k, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, k, dtype=U)


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash (the high half of a * x + b) over a set."""
    low = np.full(len(a), np.iinfo(U).max, U)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * a + b).min(axis=0))
    return low >> U(32)


def _sketcher(words: int, bands: int, rows: int, seed: int, class_bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(bands * rows, seed)
        salt = mix(np.arange(1, bands + 1, dtype=U))
        for part, data, offsets in pieces(batches):
            w = Words(data, offsets)
            sizes, sets, checks, keys = [], [], [], []
            for i in range(part.num_rows):
                s = shingles(w, i, words)
                sizes.append(len(s))
                if not len(s):
                    sets.append(None), checks.append(None), keys.append(None)
                    continue
                low = _minima(s, a, b).reshape(bands, rows)
                cls, check = _fingerprint(s)
                sets.append(cls >> (64 - class_bits)), checks.append(check)
                band = salt.copy()
                for r in range(rows):
                    band = mix(band * U(3) + low[:, r])
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(checks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "cls", "chk", "bands"],
            )

    return sketch


def _setter(words: int, k: int, seed: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(k, seed)
        for part, data, offsets in pieces(batches):
            w = Words(data, offsets)
            s = [shingles(w, i, words) for i in range(part.num_rows)]
            sigs = [(mix(_minima(x, a, b)) & U(255)).astype(np.uint8).tobytes() for x in s]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], ["cls", "sig", "items"])

    return sets


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _confirmer(percent: int, least: float):
    """Pairs that agree in enough of their signature and are linked by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            t = t.filter(pa.array((_bytes(t.column("sig_a")) == _bytes(t.column("sig_b"))).mean(axis=1) >= least))
            ok = []
            for x, y in zip(t.column("items_a"), t.column("items_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def common_counts(x: list[np.ndarray], y: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of incidence matrices a slab at a time."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, item = np.repeat(np.arange(len(sets)), [len(v) for v in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, item), len(both) - 1)
        hit = both[at] == item
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    if len(both):
        (xa, xo), (ya, yo) = entries(x), entries(y)
        for low in range(0, len(both), slab):
            part = []
            for at, owner, n in ((xa, xo, len(x)), (ya, yo, len(y))):
                i, j = np.searchsorted(at, (low, low + slab))
                m = np.zeros((n, min(slab, len(both) - low)), np.float32)
                m[owner[i:j], at[i:j] - low] = 1
                part.append(m)
            out += part[0] @ part[1].T
    return out.astype(np.int64)


def _near(least: float):
    """For one pair of blocks of a bucket: the members with a partner of another component whose signature agrees enough."""

    def near(t: pa.Table) -> pa.Table:
        cls, comp, block = (t.column(c).to_numpy() for c in ("cls", "comp", "block"))
        i, j, band = (t.column(c)[0].as_py() for c in ("bi", "bj", "band"))
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sig = _bytes(t.column("sig").combine_chunks())
        keys = np.array(t.column("bands").to_pylist(), np.int64)
        want = comp[x][:, None] != comp[y][None, :]
        if i == j:
            want &= cls[x][:, None] < cls[y][None, :]
        for earlier in range(band):  # a pair is compared in the first bucket that it shares
            want &= keys[x, earlier][:, None] != keys[y, earlier][None, :]
        for p in range(len(x)):
            at = np.flatnonzero(want[p])
            want[p, at] = (sig[y[at]] == sig[x[p]]).mean(axis=1) >= least
        hit = np.union1d(x[want.any(axis=1)], y[want.any(axis=0)])
        return t.select(["bucket", "cls", "comp", "block", "bi", "bj"]).take(pa.array(hit, pa.int64()))

    return near


def _across(percent: int):
    """For the near members of one pair of blocks: links that join different components, one for each joining."""

    def links(t: pa.Table) -> pa.Table:
        cls, comp, block = (t.column(c).to_numpy() for c in ("cls", "comp", "block"))
        x, y = np.flatnonzero(block == t.column("bi")[0].as_py()), np.flatnonzero(block == t.column("bj")[0].as_py())
        a, b = [], []
        if len(x) and len(y):
            items = t.column("items")
            sets = [[np.frombuffer(items[int(k)].as_buffer(), U) for k in v] for v in (x, y)]
            both = common_counts(*sets)
            size = [np.array([len(s) for s in v]) for v in sets]
            good = (comp[x][:, None] != comp[y][None, :]) & (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both))
            root = {int(c): int(c) for c in comp}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for p, q in zip(*np.nonzero(good), strict=True):
                u, v = x[p], y[q]
                ru, rv = find(int(comp[u])), find(int(comp[v]))
                if ru != rv:
                    root[ru] = rv
                    a.append(cls[u]), b.append(cls[v])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, seed: int = 17, block: int = 256, block_bytes: int = 8 << 20, class_bits: int = 64) -> DataFrame:
    """documents (doc_id, text) -> (key, doc_id, n_shingles, component_id, kept), a row for each input row; key is its row_key().

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their shingle sets. A pair at 0.75 shares none
    of 32 bands of 4 minima with a chance of 5e-6; the signature check passes a true link but for about 1e-6. Documents are
    one class if 128 bits of fingerprint agree; class_bits of them name the class, and where two differ in the rest, they
    get other names.
    """
    ship(docs.sparkSession)
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    sketch = saved(docs.mapInArrow(_sketcher(words, bands, rows, seed, class_bits), "doc_id long, key long, n_shingles long, cls long, chk long, bands array<long>"), "sketch")
    odd = sketch.where("cls is not null").groupBy("cls").agg(F.min("chk").alias("lead"), F.max("chk").alias("other")).where("lead <> other").select("cls", "lead")
    if odd.limit(1).count():
        told_apart = saved(sketch.join(odd, "cls", "left").withColumn("cls", F.when(F.col("chk") != F.col("lead"), F.xxhash64("cls", "chk")).otherwise(F.col("cls"))).drop("lead"), "sketch")
        forget(sketch)
        sketch = told_apart
    one = sketch.where("cls is not null").groupBy("cls").agg(F.min(F.struct("key", "n_shingles", "bands")).alias("m")).select("cls", "m.key", F.col("m.n_shingles").alias("size"), "m.bands")
    keyed = one.select("cls", "key", "size", F.posexplode("bands").alias("band", "bucket"))
    full = keyed.groupBy("bucket").agg(F.min("cls").alias("low"), F.min_by("cls", F.xxhash64("cls")).alias("drawn"), F.count("*").alias("n")).where("n > 1")
    members = saved(keyed.join(full, "bucket"), "members")
    busy = members.groupBy("key").agg(F.min("cls").alias("cls"))
    # the texts of busy classes are read again, which is cheaper than to keep every document's set
    sets = saved(docs.join(busy, "key").select("cls", "text").mapInArrow(_setter(words, bands * rows, seed), "cls long, sig binary, items binary"), "sets")

    stars = members.select("cls", F.explode(F.array("low", "drawn")).alias("leader")).where("cls <> leader")
    stars = stars.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    stars = stars.join(sets.toDF("a", "sig_a", "items_a"), "a").join(sets.toDF("b", "sig_b", "items_b"), "b")
    links = saved(stars.mapInArrow(_confirmer(percent, least), "a long, b long"), "links")

    comps = connected_components(links).withColumnRenamed("node", "cls")
    labelled = members.join(comps, "cls", "left").select("bucket", "band", "cls", "size", F.coalesce("root", "cls").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.greatest(F.count("*") / block, F.sum("size") * 8 / block_bytes)).cast("int").alias("blocks"))
    mixed = mixed.where("lo <> hi").select("bucket", "blocks")
    dealt = labelled.drop("size").join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("cls", "sig"), "cls").join(one.select("cls", "bands"), "cls")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    near = dealt.select("bucket", "band", "cls", "comp", "block", "bi", "bj", "sig", "bands").groupBy("bucket", "bi", "bj").applyInArrow(_near(least), "bucket long, cls long, comp long, block int, bi int, bj int")
    joins = near.join(sets.select("cls", "items"), "cls").groupBy("bucket", "bi", "bj").applyInArrow(_across(percent), "a long, b long")
    links = links.union(saved(joins, "links"))

    comps = connected_components(links).withColumnRenamed("node", "cls")
    rooted = saved(sketch.select("key", "doc_id", "n_shingles", "cls").join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls")).drop("cls"), "rooted")
    forget(members, sets, sketch)
    # written, so that the join starts from plain shuffles, of which adaptive execution can split a large component's
    named = saved(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "named")
    out = rooted.join(named, "root", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("key", "doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def minhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """near_groups without the key: (doc_id, n_shingles, component_id, kept)."""
    return near_groups(docs, **options).drop("key")
