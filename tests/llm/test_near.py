"""MinHash, components, embeddings and top-k against brute force, with nulls, ties, repeats and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.embdedup import embedding_dedup
from corpusloom.llm.minhash import common_counts, minhash_dedup
from corpusloom.llm.topk import _survivors, top_k

DOCS = "doc_id long, text string, key string, cls int, root string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_minhash(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    r = roots(len(rows), pairs)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if r[j] == r[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((doc, len(sets[i]), low, doc == low))
    return sorted(out, key=str)


def test_minhash_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in words]
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choice(vocab) for _ in range(12 + i))) for i in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Two Words"), (1004, "two  words"), (1005, "two wordsx"), (None, rows[0][1]), (None, "alone here"), (1000, None), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, "k", 1, "r") for i, t in rows], DOCS)
    got = sorted([tuple(r) for r in minhash_dedup(df).collect()], key=str)
    assert got == brute_minhash(rows)
    small = minhash_dedup(df, block=4)  # blocks of a few rows give the same
    assert sorted([tuple(r) for r in small.collect()], key=str) == got
    few = minhash_dedup(df, class_bits=3)  # class names that collide are told apart
    assert sorted([tuple(r) for r in few.collect()], key=str) == got


def test_minhash_empty_table(spark):
    assert minhash_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_common_counts():
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(7)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert (common_counts(x, y, slab=8) == want).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    r = roots(400, edges)
    low = {}
    for i in range(400):
        low.setdefault(r[i], i)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {i: got.get(i, i) for i in touched} == {i: low[r[i]] for i in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(rng):
    base = rng.normal(size=(30, 24))
    rows = [v + rng.normal(size=24) * s for v in base for s in (0, 0.05, 0.3)]
    rows = [r.tolist() for r in rows] + [rows[0].tolist()] * 3 + [[0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, None, [1.0, 2.0], [2.0, 4.0], []]
    return list(enumerate(rows)) + [(None, rows[1]), (4, rows[4])]


EMB = "vec_id long, embedding array<double>, cls string, m int"


def test_embeddings_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(5))
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                pairs.append((i, j))
    r = roots(len(rows), pairs)
    want = []
    for i, (v, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if r[j] == r[i] and rows[j][0] is not None]
        want.append((v, sum(i in p for p in pairs), min(ids), v == min(ids)))
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], EMB)
    for block in (512, 4):
        got = sorted([tuple(x) for x in embedding_dedup(df, block=block).collect()], key=str)
        assert got == sorted(want, key=str)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(230)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[3][1]), (400, None), (401, [float("inf")] * 10), (402, [None] * 10), (500, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], EMB)
    valid = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in valid:
        if q % 100 == 0:
            s = sorted(((-int(x @ y), i) for i, y in valid if i != q and len(y) == len(x)))[:10]
            want |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s)}
    for block, qb in ((2048, 256), (16, 1)):
        got = [tuple(r) for r in top_k(df, block=block, query_block=qb).collect()]
        assert set(got) == want and len(got) == len(want)
    assert top_k(df.limit(0)).collect() == []


def test_top_k_large_components_stay_exact(spark):
    rows = [(i, [2.0**29 + i, 3.0]) for i in range(4)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1).collect()
    assert len(got) == 3 and all(r.score == int(2**29 + r.query_id) * int(2**29 + r.vec_id) + 9 for r in got)


def test_embeddings_of_any_magnitude_link(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [1.0, 2.01]), (3, [-1e308, 1.7e308]), (4, [-5e-324, 1e-323]), (5, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_top_k_leaves_out_what_may_not_fit(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**20, 2.0**20]), (4, [2.0, -3.0]), (5, []), (100, [2.0**20, -(2.0**20)])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 3, 2**41), (0, 2, 100, 0), (0, 3, 4, -(2**20)), (100, 1, 4, 5 * 2**40), (100, 2, 0, 0), (100, 3, 3, 0)]


@pytest.mark.parametrize("scale", [1.0, 2.0**40])
def test_survivors_are_all_that_reach_the_cutoff(scale):
    """Against full products; clustered vectors, so that later slices are computed for few pairs only."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 32)) * 3000
    x = np.floor(np.repeat(centre, 40, axis=0) + rng.normal(size=(240, 32)) * 300).astype(np.int64)
    q = np.floor(centre + 5).astype(np.int64) * int(scale if scale > 1 and 2**40 * 10**4 < 2**62 else 1)
    if scale > 1:
        q, x = q // 2**20, x
    slices = np.stack([q[:, c] @ x[:, c].T for c in np.array_split(np.arange(32), 4)])
    least = slices.min(axis=2).T
    full = q @ x.T
    nth = np.sort(full, axis=1)[:, -10]
    cutoff = (nth - least.sum(axis=1)).astype(np.float64)
    alive = np.ones(full.shape, bool)
    i, j, total = _survivors(q, x, least, cutoff, alive, 4)
    assert (total == full[i, j]).all()
    assert {(a, b) for a, b in zip(*np.nonzero(full >= nth[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_top_k_repeated_rows_raise_no_cutoff(spark):
    rows = [(0, [4.0] * 4), (99, [1.796875] * 4)]
    for other in (0.0, 1.0):  # the second row of a vec_id equal to the first, or high in another slice
        one = [(1 + 5 * s + i, [4.0 * (c == s) for c in range(4)]) for s in range(4) for i in range(5)]
        two = one if not other else [(v, x[1:] + x[:1]) for v, x in one]
        for block in (2048, 8):
            got = top_k(spark.createDataFrame(rows + one + two, "vec_id long, embedding array<double>"), block=block).collect()
            assert sorted((r["rank"], r.vec_id, r.score) for r in got)[0] == (1, 99, 30146560)
            assert [r.score for r in got if r.vec_id != 99] == [16777216] * 9


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    df = spark.createDataFrame([(i, "a b c d e f", "k", 1, "r") for i in range(n)], DOCS)
    assert {r.component_id for r in minhash_dedup(df).collect()} == {0}
    assert df.select(F.count("*")).first()[0] == n
