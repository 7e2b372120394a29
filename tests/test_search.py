"""BM25 against a scorer in plain Python, fusion, parents, dense search."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, index, search


def naive_bm25(docs, query):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    per = []
    for phrase in query:
        tf = {i: sum(d[k : k + len(phrase)] == phrase for k in range(len(d))) for i, d in docs.items()}
        per.append({i: t for i, t in tf.items() if t})
    for i, d in docs.items():
        if all(i in p for p in per) and per:
            s = 0
            for p in per:
                idf = math.log((n - len(p) + 0.5) / (len(p) + 0.5))
                s += (idf if idf > 0 else 1e-6) * p[i] * 2.2 / (p[i] + 1.2 * (0.25 + 0.75 * len(d) / avg))
            scores[i] = s
    return scores


def test_bm25_equals_naive_with_phrases(spark):
    rng = random.Random(4)
    vocab = [a + b for a in "abcdef" for b in "xyz"] + ["ax-bx", "cx_dx", "ax.bx.cx"]
    raw = {i: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14))) for i in range(60)}
    docs = spark.createDataFrame(list(raw.items()), "doc_id long, text string")
    qs = {q: " ".join(dict.fromkeys(rng.choice(vocab) for _ in range(rng.randint(1, 2)))) for q in range(50)}
    queries = spark.createDataFrame(list(qs.items()), "query_id long, text string")
    lengths = index.doc_stats(docs)
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(queries, index.postings(docs), lengths, index.corpus_stats(lengths), n=None).collect()}
    stored = {r.chunk_id: r.subs for r in index.occurrences(docs).groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("subs")).collect()}
    want = {}
    for q, text in qs.items():
        phrases = [p.replace("_", "-").replace(".", "-").split("-") for p in text.split()]
        want |= {(q, i): s for i, s in naive_bm25(stored, phrases).items()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(got[k], want[k], rel_tol=0, abs_tol=1e-9) for k in want)  # nine decimals


def test_token_scan_equals_postings(spark):
    """Phrases of one to four sub-tokens, at the ends and repeated, with a filter that is full as well."""
    rng = random.Random(9)
    vocab = ["aa", "bb", "cc", "dd", "ee1", "aa-bb", "cc_dd", "aa.bb.cc", "dd-aa-bb-cc"]
    raw = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(raw, "doc_id long, text string")
    qs = [(q, " ".join(rng.choice([*vocab, "bb-cc", "no-aa", "zz"]) for _ in range(rng.randint(1, 2)))) for q in range(60)] + [(60, ""), (61, None)]
    queries = spark.createDataFrame(qs, "query_id long, text string")
    tokens, lengths = index.tokenized(docs), index.doc_stats(docs)
    stats = index.corpus_stats(lengths)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(search.bm25(queries, index.postings(docs), lengths, stats))
    assert rows(search.bm25_scan(queries, tokens, stats)) == want and len(want) > 200
    phrases, cols = search.query_phrases(queries), ["query_id", "n_phrases", "phrase", "chunk_id", "tf"]
    want = rows(search.phrase_hits(phrases, index.postings(docs)).select(cols))
    assert rows(search.token_hits(phrases, tokens, log_bits=6).select(cols)) == want and len(want) > 200
    assert search.token_hits(phrases.limit(0), tokens).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")


def test_rrf_exact_match_boost_and_total_order(spark):
    dense = hits(spark, [(1, c, 1 - c / 10, c) for c in range(1, 11)])
    lexical = hits(spark, [(1, 10, 5.0, 1), (1, 77, 4.0, 2)])
    out = {r.chunk_id: r for r in search.rrf(dense, lexical).collect()}
    assert out[10].final_rank == 1 and out[10].in_both
    assert math.isclose(out[10].rrf_score, 1 / 70 + 1 / 61)
    assert out[2].final_rank < out[77].final_rank  # equal scores: the dense one first
    assert len(out) == 11


def test_rrf_weights_and_one_side(spark):
    none = hits(spark, []).limit(0)
    only = hits(spark, [(1, 5, 1.0, 1)])
    assert search.rrf(only, none).first().rrf_score == 1 / 61
    assert search.rrf(only, only, dense_weight=0.0).first().rrf_score == 1 / 61


def test_parent_dedup_and_signals(spark):
    rows = [(1, 1, 0.9, True, True, 1, "p"), (1, 2, 0.8, True, False, 2, "p"), (1, 3, 0.7, False, True, 3, None)]
    fused = spark.createDataFrame(rows, "query_id long, chunk_id long, rrf_score double, in_dense boolean, in_bm25 boolean, final_rank int, parent_id string").withColumn("in_both", F.col("in_dense") & F.col("in_bm25"))
    assert {r.chunk_id for r in search.best_of_parent(fused).collect()} == {1, 3}
    s = search.signals(fused).first()
    assert (s.top_score, s.score_gap, s.dense_only, s.bm25_only, s.both, s.agreement) == (0.9, 0.1, 1, 1, 1, True)


def test_dense_exact_with_ties_and_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    x[7] = x[3]
    x[5] = 0
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    out = search.dense(q, v, 5).collect()
    for i in range(3):
        with np.errstate(invalid="ignore", divide="ignore"):
            s = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        s[[i, 5]] = -9
        want = sorted(range(40), key=lambda j: (-round(s[j], 12), j))[:5]
        assert [r.chunk_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == i] == want


def test_upsert_twice_is_all_skipped(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, content_sha string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "chunk_id string, content_sha string")
    assert {r.chunk_id: r.status for r in index.upsert_status(new, old).collect()} == {"a": "skipped", "b": "updated", "c": "inserted"}
    after = index.merged(new, old)
    assert {tuple(r) for r in after.collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("z", "9")}
    assert index.upsert_counts(index.upsert_status(new, after)).first().skipped == 3
    assert [r.chunk_id for r in index.stale(after, new).collect()] == ["z"]


def test_hit_mrr_and_movement(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3)], "query_id long, chunk_id long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 21), (3, 5)], "query_id long, doc_id long")
    r = evaluate.hit_mrr(run, gold, 2).first()
    assert (r.queries, round(r.hit_at_k, 4), round(r.mrr, 4)) == (3, 0.3333, 0.1667)
    before = spark.createDataFrame([(1, c, c) for c in range(1, 8)], "query_id long, chunk_id long, final_rank int")
    after = spark.createDataFrame([(1, 7, 1), (1, 1, 2), (1, 3, 3)], "query_id long, chunk_id long, final_rank int")
    assert {x.chunk_id: x.change for x in evaluate.movement(before, after, 3).collect()} == {1: "demoted", 2: "dropped", 3: "same", 7: "rescued"}


def test_lsh_recall(spark):
    """Of the exact neighbours within the distance that the search is for, nearly all are found, with exact scores."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 16))
    x = np.repeat(centre, 6, axis=0) + rng.normal(size=(240, 16)) * 0.15
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 6 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id): r.score for r in search.dense(q, v, 5, threshold=0.5).collect()}
    found = {(r.query_id, r.chunk_id): r.score for r in search.dense_lsh(q, v, 5).collect()}
    assert len(exact) >= 190 and len(exact.keys() & found.keys()) >= 0.95 * len(exact)
    assert all(abs(found[k] - exact[k]) < 1e-9 for k in exact.keys() & found.keys())
