"""Toxicity scores by a linear classifier whose training penalises score changes under identity-term swaps.

Features of a text are the presence of its words and of their first 4 and 6 bytes, hashed. Words are what stands between
white space and punctuation, A-Z lowered, so that "women," and "women's" mention women as "women" does. Identity terms and
their plurals have one feature each and no prefixes. For every identity term in a labelled text a counterfactual puts
another term of the list, or a neutral word, in its place; the squared change of the log odds is part of the loss. As a
change of the score is at most a quarter of that of its log odds, a mere mention of a group moves no score.

The classifier is fitted on at most `sample` labelled rows (smallest hash of doc_id first); every text is scored whole.

Cases: null labels and null doc_ids teach nothing, several labels of one doc_id count as toxic if any is; without
training rows of both classes every score is their share of toxic rows (0 without rows); a null or empty text gets the
score of no feature; a very long text is read in slices of words; repeated rows are scored alike. Extra columns are ignored
and labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, saved, ship
from .vectext import U, Words, mix, pieces, span_hashes

# Words that name groups of people, in four languages.
IDENTITY_TERMS = (
    "women men woman man girls boys muslims muslim christians christian jews jewish jew hindus hindu buddhists atheists catholics "
    "black white asian african latino latina hispanic arab arabs europeans americans mexicans chinese indian immigrants immigrant refugees "
    "foreigners gay lesbian bisexual transgender queer straight homosexual disabled blind deaf elderly teenagers "
    "frauen männer juden muslime christen ausländer flüchtlinge schwule lesben türken "
    "femmes hommes juifs musulmans chrétiens étrangers réfugiés homosexuels noirs arabes "
    "mujeres hombres judíos musulmanes cristianos extranjeros refugiados homosexuales negros árabes"
).split()

_BITS = 20
_PREFIXES = (4, 6)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + U(salt)) >> U(64 - _BITS)).astype(np.int64)


def _identity() -> np.ndarray:
    """Hashes of the identity terms and of their plurals in s."""
    words = sorted({t.encode() for t in IDENTITY_TERMS} | {t.encode() + b"s" for t in IDENTITY_TERMS if not t.endswith("s")})
    ends = np.cumsum([len(w) for w in words])
    return np.sort(span_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends))


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"*@$!#")] = True  # letters are written with these
_SLICE = 1 << 18


def spoken(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with punctuation as spaces, but for *@$!# between other characters."""
    out = data.copy()
    for a in range(0, len(data), 1 << 20):
        lo, hi = max(0, a - 3), min(len(data), a + (1 << 20) + 3)
        d = data[lo:hi]
        gap = _PUNCTUATION[d]
        # U+2010 to U+203F, and the marks of Latin-1 that stand at words
        wide = np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x80) & (d[2:] >= 0x90)) if len(d) > 2 else np.empty(0, np.int64)
        for k in range(3):
            gap[wide + k] = True
        marks = np.flatnonzero((d[:-1] == 0xC2) & np.isin(d[1:], (0xA1, 0xAB, 0xB7, 0xBB, 0xBF)))
        gap[marks] = gap[marks + 1] = True
        plain, inside = ~gap & (d > 0x20), _INSIDE[d]
        inside[0] = inside[-1] = False
        inside[1:-1] &= plain[:-2] & plain[2:]
        edge = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        inside[edge] = inside[edge[edge > 0] - 1] = False
        gap &= ~inside
        own = slice(a - lo, min(len(d), a - lo + (1 << 20)))
        out[a : a + (1 << 20)][gap[own]] = 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct document << 24 | feature; features 0..len(group)-1 are the identity terms, hashed slots follow.

    live: features to give, the others are left out.
    """
    w = Words(spoken(data, offsets), offsets, hashes=False)
    doc = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
    out = []
    for a in range(0, len(doc), _SLICE):
        d, s, e = doc[a : a + _SLICE], w.start[a : a + _SLICE], w.end[a : a + _SLICE]
        h = span_hashes(w.data, s, e)
        at = np.minimum(np.searchsorted(group, h), len(group) - 1)
        is_group = group[at] == h
        docs, feats = [d], [np.where(is_group, at, len(group) + _slot(h, 0))]
        for k in _PREFIXES:
            long = np.flatnonzero((e - s > k) & ~is_group)
            docs.append(d[long])
            feats.append(len(group) + _slot(span_hashes(w.data, s[long], s[long] + k), k))
        docs, feats = np.concatenate(docs), np.concatenate(feats)
        if live is not None:
            keep = np.flatnonzero(live[feats])
            docs, feats = docs[keep], feats[keep]
        out.append(np.unique((docs << 24) | feats))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0] if out else np.empty(0, np.int64)


def _extract(group: np.ndarray):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            key = features(data, offsets, group)
            cut = np.searchsorted(key, np.arange(part.num_rows + 1) << 24)
            out = [(key[a:b] & 0xFFFFFF).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["order", "toxic", "feats"])

    return extract


def _tally(size: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), np.int64)
        for t in batches:
            for y, f in zip(t.column("toxic").to_pylist(), t.column("feats"), strict=True):
                n[y][np.frombuffer(f.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], ["feat", "pos", "neg"])

    return tally


def _choose(keep: np.ndarray):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for f in t.column("feats"):
                f = np.frombuffer(f.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(keep, f), len(keep) - 1)
                out.append(at[keep[at] == f].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([t.column("order"), t.column("toxic"), pa.array(out, pa.binary())], ["order", "toxic", "feats"])

    return choose


def fit(rows: list[np.ndarray], y: np.ndarray, n_features: int, n_group: int, *, ridge: float = 1e-4, swap: float = 1.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic loss (Adam, full batch), both classes of equal weight in all.

    Features below n_group are identity terms. swap weighs the mean squared change of the score when an identity term of a text becomes another or a neutral word.
    """
    n = len(rows)
    sizes = np.array([len(r) for r in rows])
    idx = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    named = idx < n_group
    term, text = idx[named], owner[named]
    other = (term + 1 + mix(text.astype(U) * U(31) + term.astype(U)).astype(np.int64) % max(1, n_group - 1)) % max(1, n_group)
    w, b = np.zeros(n_features), 0.0
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[idx], n) + b)))
        g = (p - y) * share
        grad = np.bincount(idx, g[owner], n_features) + ridge * w
        if len(term):
            gap = w[term] - w[other]
            grad += 2 * swap / n * (np.bincount(term, gap + w[term], n_features) - np.bincount(other, gap, n_features))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        fix = np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def _score_of(group: np.ndarray, weight: np.ndarray, bias: float):
    live = weight != 0

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        key = features(data, offsets, group, live)
        z = np.bincount(key >> 24, weight[key & 0xFFFFFF].astype(np.float64), len(offsets) - 1) + bias
        return 1 / (1 + np.exp(-z))

    return score


def _scorer(group: np.ndarray, weight: np.ndarray, bias: float):
    score_of = _score_of(group, weight, bias)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score_of(data, offsets))], ["doc_id", "held_out", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, max_features: int = 4096, least_z: float = 2.4, held_mod: int = 3, held_rest: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(identity terms' hashes, weight of every feature, bias), learned from documents (doc_id, text) and labels (doc_id, toxic).

    Features are the identity terms and the max_features whose log odds ratio is most significant, least_z at least.
    Rows with crc32(doc_id as text) mod `held_mod` = `held_rest` are held out.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = doc_bucket(held_mod) == held_rest
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    known = known.where(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    group = _identity()
    drawn = docs.join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("order"), "toxic", "text")
    # at most `sample` rows out of all partitions: a few files, not one for every partition of the documents
    feats = saved(drawn.mapInArrow(_extract(group), "order long, toxic int, feats binary").repartition(max(1, sample // 2000)), "toxic-feats")
    size = len(group) + (1 << _BITS)
    counts = feats.mapInArrow(_tally(size), "feat long, pos long, neg long").groupBy("feat").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = feats.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    weight, bias = np.zeros(size, np.float32), 0.0
    if 0 < pos < n:
        a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
        odds = F.log(a / (pos + 1 - a)) - F.log(b / (n - pos + 1 - b))
        z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
        best = counts.where(f"pos + neg >= 2 and feat >= {len(group)}").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feat").limit(max_features).select("feat").collect()
        keep = np.concatenate((np.arange(len(group)), np.sort(np.array([r["feat"] for r in best], np.int64))))
        rows = feats.mapInArrow(_choose(keep.astype(np.int32)), feats.schema).orderBy("order").limit(sample).toArrow()
        w, bias = fit([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("feats")], rows.column("toxic").to_numpy().astype(float), len(keep), len(group))
        weight[keep] = w
    else:
        bias = 40.0 if n and pos == n else -40.0
    return group, weight, bias


def toxicity(docs: DataFrame, labels: DataFrame, *, held_mod: int = 3, held_rest: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted, a row for each document."""
    model = train(docs, labels, held_mod=held_mod, held_rest=held_rest, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_bucket(held_mod) == held_rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(*model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_filter(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    score = _score_of(*train(docs, labels, **options))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            yield part.filter(pa.array(score(data, offsets) < threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(keep, docs.withColumn("text", F.col("text").cast("string")).schema)
