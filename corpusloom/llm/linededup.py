"""Line dedup by a log-template tree of fixed depth.

A line's tokens (runs outside white space; tokens with a digit count as <*>) lead it down a tree: the number of tokens, then
the first `depth` tokens. In a leaf the distinct lines are taken from the commonest down (documents that have it, then
the place where it first stands); a line joins the template that it equals in most places, if those are `percent` of all,
or starts one. The other places are variable fields; a <*> equals nothing, so lines of numbers form no template. What
a place is depends neither on the number of documents nor on how often a field's values recur. Lines that are equal token
by token recur too, whether they fit a template or not. A template or equal line in at least `min_docs` documents (equal
lines of more than `pair_tokens` tokens: in two) goes from all but the document with the smallest doc_id.

The texts are parsed twice and never shuffled for it: the first pass counts leaves, a Bloom filter of fixed size
(`filter_bits`) over the busy ones goes with the second pass, which gives hashes of the lines that may matter; an exact join
takes off what the filter lets through by chance, so a filter too small for the corpus costs shuffle and no result. Counts
are sums of pre-aggregated rows. Only the distinct lines of a leaf pass through one task, one by one; it holds the lines that
started a template, and finds those that may fit by bands of places, so that its work grows with the lines, not their pairs.
The texts move once, to the lines to drop, by the same sort-merge join at every size.

Cases: a null text stays null and has no lines; an empty text has one empty line; lines of fewer than `min_tokens` tokens
always stay; rows equal in doc_id and text are one document and treated alike; a null doc_id comes after all others; a
document all of whose lines go keeps the empty text; a long text is parsed in blocks of lines, so that memory is bounded by
its longest line. Extra columns are carried along whatever their names; a column n_lines or n_dropped of the documents gives
way to that of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, row_key, saved, ship
from .vectext import U, Words, distinct, mix, pieces

_PLACE = U(0x9E3779B97F4A7C15)
_SALTS = np.arange(65, dtype=U) * _PLACE
_NEWLINE = 10


class Lines:
    """The lines with tokens of consecutive texts: row, number in the row, leaf, hashes of the masked and the whole line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int, min_tokens: int):
        w = Words(data, offsets, lower=False)
        breaks = np.flatnonzero(data == _NEWLINE)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.doc))
        line = np.searchsorted(breaks, w.start)
        first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.empty(0, np.int64)
        self.size = np.diff(np.append(first, len(row)))
        place = (np.arange(len(row)) - np.repeat(first, self.size)).astype(U) * _PLACE
        digit = (data >= 48) & (data <= 57)
        number = np.logical_or.reduceat(digit, w.start) if len(row) else np.empty(0, bool)
        self.codes = np.where(number, U(0), w.hash)
        self.first, self.row = first, row[first]
        self.line_no = line[first] - np.searchsorted(breaks, offsets[:-1])[self.row]
        lead = self.size.astype(U)
        for k in range(depth):
            at = np.flatnonzero(self.size > k)
            lead[at] += mix(self.codes[first[at] + k] + _SALTS[k + 1])
        self.leaf = mix(lead).view(np.int64)
        self.h, self.exact = (np.add.reduceat(mix(c ^ mix(place)), first).view(np.int64) if len(row) else np.empty(0, np.int64) for c in (self.codes, w.hash))
        self.fixed = np.add.reduceat((~number).astype(np.int64), first) if len(row) else np.empty(0, np.int64)
        if min_tokens > 1:
            ok = self.size >= min_tokens
            for name in ("size", "first", "row", "line_no", "leaf", "h", "exact", "fixed"):
                setattr(self, name, getattr(self, name)[ok])


def _blocks(batches: Iterator[pa.RecordBatch], depth: int, min_tokens: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """(slice of a batch, its lines); a text of more than `most` bytes comes in several blocks of whole lines."""
    for part, data, offsets in pieces(batches, most=most):
        if len(data) <= most:
            yield part, Lines(data, offsets, depth, min_tokens)
            continue
        breaks, at, before = np.flatnonzero(data == _NEWLINE), 0, 0
        while at < len(data):
            k = max(before, int(np.searchsorted(breaks, at + most, side="right")) - 1)
            to = int(breaks[k]) + 1 if k < len(breaks) else len(data)
            lines = Lines(data[at:to], np.array([0, to - at]), depth, min_tokens)
            lines.line_no += before
            yield part, lines
            at, before = to, k + 1


def _leaves(depth: int, min_tokens: int, pair_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, depth, min_tokens):
            if not len(x.leaf):
                continue
            order = np.lexsort((x.row, x.leaf))
            leaf, row = x.leaf[order], x.row[order]
            new = np.concatenate(([True], leaf[1:] != leaf[:-1]))
            once = new | np.concatenate(([True], row[1:] != row[:-1]))
            at = np.flatnonzero(new)
            n, long = np.add.reduceat(once.astype(np.int64), at), x.size[order][at] > pair_tokens
            yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(n), pa.array(long)], ["leaf", "n", "long"])

    return run


def _bits(leaf: np.ndarray, log_bits: int) -> list[np.ndarray]:
    return [(mix(leaf.view(U) + _SALTS[k]) >> U(64 - log_bits)).astype(np.int64) for k in range(3)]


def _filter_words(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            pos = distinct(np.concatenate(_bits(t.column(0).to_numpy(zero_copy_only=False), log_bits)))[0]
            word = pos >> 6
            at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            bits = np.bitwise_or.reduceat(U(1) << (pos & 63).astype(U), at)
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(bits.view(np.int64))], ["word", "bits"])

    return run


def _leaf_filter(busy: DataFrame, log_bits: int) -> np.ndarray:
    """A Bloom filter of 2 ** log_bits bits over the leaves; the driver gets at most 2 ** (log_bits - 6) words of it."""
    words = busy.mapInArrow(_filter_words(log_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def _hot(filter_: np.ndarray, log_bits: int, depth: int, percent: int, min_tokens: int, pair_tokens: int):
    """The lines whose leaf passes the filter; a masked line's codes only with its first occurrence in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, depth, min_tokens):
            ok = np.ones(len(x.leaf), bool)
            for pos in _bits(x.leaf, log_bits):
                ok &= (filter_[pos >> 6] >> (pos & 63).astype(U) & U(1)).astype(bool)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            fit = 100 * x.fixed[at] >= percent * x.size[at]
            once = np.zeros(len(at), bool)
            once[np.unique(x.h[at], return_index=True)[1]] = True
            once &= fit
            size = np.where(once, x.size[at], 0)
            ends = np.concatenate(([0], np.cumsum(size)))
            flat = x.codes[np.repeat(x.first[at] - ends[:-1], size) + np.arange(ends[-1])].view(np.int64)
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(~once))
            rows = pa.array(x.row[at])
            cols = [part.column(0).take(rows), part.column(1).take(rows), *(pa.array(v[at]) for v in (x.line_no.astype(np.int32), x.leaf, x.h, x.exact)), pa.array(x.size[at] > pair_tokens), pa.array(fit), codes]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "line_no", "leaf", "h", "exact", "long", "fit", "codes"])

    return run


class Leaf:
    """The templates of one leaf, in the order in which lines started them.

    Two lines of n places that are equal in `need` of them differ in n - need at most. The first `depth` places are alike in
    the whole leaf; so of n - need + 1 bands of the other places (less for masked leading ones) one is equal in both. Once
    there are many templates, a line is held only against those that share a band with it.
    """

    def __init__(self, row: np.ndarray, percent: int, depth: int, few: int):
        self.rows, self.ids, self.n = np.empty((4, len(row)), np.int64), [], 0
        self.need, self.few = -(-percent * len(row) // 100), few
        bands = len(row) - self.need - int((row[:depth] == 0).sum()) + 1
        rest = len(row) - min(depth, len(row))
        self.cuts = np.linspace(min(depth, len(row)), len(row), bands + 1).astype(int) if 0 < bands <= rest else None
        self.index: dict[tuple[int, bytes], list[int]] | None = None

    def _bands(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(k, row[a:b].tobytes()) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)) if (row[a:b] != 0).all()]

    def find(self, row: np.ndarray) -> int | None:
        """The id of the template that the line is equal to in most places, the earliest of several, if those are enough."""
        if self.index is None:
            at = np.arange(self.n)
        else:
            at = np.array(sorted({i for band in self._bands(row) for i in self.index.get(band, ())}), np.int64)
        if not len(at):
            return None
        same = ((self.rows[at] == row) & (row != 0)).sum(axis=1)
        best = int(same.argmax())
        return self.ids[at[best]] if same[best] >= self.need else None

    def start(self, row: np.ndarray, h: int) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.n] = row
        self.ids.append(h)
        if self.index is None and self.n >= self.few and self.cuts is not None:
            self.index = {}
            for i in range(self.n):
                self._add(i)
        self.n += 1
        if self.index is not None:
            self._add(self.n - 1)

    def _add(self, i: int) -> None:
        for band in self._bands(self.rows[i]):
            self.index.setdefault(band, []).append(i)  # type: ignore[union-attr]


def _matcher(percent: int, depth: int, few: int = 64):
    """(leaf, h, codes), sorted by leaf and with its commonest lines first -> (leaf, h, template): the h of the line that
    started the template. Only the starting lines of one leaf are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, now = None, None
        for t in batches:
            leaves, hs = t.column(0).to_pylist(), t.column(1).to_pylist()
            codes, at = t.column(2).flatten().to_numpy(), t.column(2).offsets.to_numpy()
            at, out = at - at[0], []
            for i, (key, h) in enumerate(zip(leaves, hs, strict=True)):
                row = codes[at[i] : at[i + 1]]
                if key != leaf or now is None:
                    leaf, now = key, Leaf(row, percent, depth, few)
                found = now.find(row)
                if found is None:
                    now.start(row, h)
                out.append(h if found is None else found)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(out, pa.int64())], ["leaf", "h", "template"])

    return run


def line_decisions(docs: DataFrame, *, depth: int, percent: int, min_docs: int, min_tokens: int, pair_tokens: int, filter_bits: int) -> DataFrame:
    """(key, doc_id, drop): for each document that loses lines their numbers, from 0. docs: key, doc_id, text."""
    ship(docs.sparkSession)
    texts = docs.where("text is not null").select("key", "doc_id", "text")
    enough = F.col("n") >= F.when(F.col("long"), F.lit(min(2, min_docs))).otherwise(F.lit(min_docs))
    leaves = texts.mapInArrow(_leaves(depth, min_tokens, pair_tokens), "leaf long, n long, long boolean")
    busy = saved(leaves.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("long").alias("long")).where(enough).select("leaf"), "busy")
    hot = texts.mapInArrow(
        _hot(_leaf_filter(busy, filter_bits), filter_bits, depth, percent, min_tokens, pair_tokens),
        "key long, doc_id long, line_no int, leaf long, h long, exact long, long boolean, fit boolean, codes array<long>",
    )
    hot = saved(hot.join(busy, "leaf", "left_semi"), "hot")

    in_docs = hot.where("fit").groupBy("leaf", "h", "doc_id", "key").agg(F.min("line_no").alias("line_no"))
    kinds = in_docs.groupBy("leaf", "h").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")).alias("at"))
    kinds = kinds.join(hot.where("codes is not null").groupBy("leaf", "h").agg(F.min("codes").alias("codes")), ["leaf", "h"])
    kinds = kinds.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "at", "h").select("leaf", "h", "codes")
    forms = saved(kinds.mapInArrow(_matcher(percent, depth), "leaf long, h long, template long"), "forms")
    of = saved(hot.select("key", "doc_id", "line_no", "exact", "long", "leaf", "h").join(forms, ["leaf", "h"], "left").drop("h"), "of-template")

    def recurring(*by: str) -> DataFrame:
        """The groups of lines that recur, with the document that keeps them; a document counts once."""
        once = of.where(F.col(by[1]).isNotNull()).select(*by, "doc_id", "key").distinct()
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
        return once.groupBy(*by).agg(F.count("*").alias("n"), first)

    # written, so that the joins below start from plain shuffles, of which adaptive execution can split skewed ones
    alike = saved(recurring("leaf", "template").where(F.col("n") >= min_docs).select("leaf", "template", "first"), "alike")
    equal = saved(recurring("leaf", "exact", "long").where(enough).select("leaf", "exact", "first"), "equal")
    other = ~(F.col("key").eqNullSafe(F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    gone = of.join(alike, ["leaf", "template"]).where(other).select("key", "doc_id", "line_no")
    gone = gone.union(of.join(equal, ["leaf", "exact"]).where(other).select("key", "doc_id", "line_no"))
    out = saved(gone.groupBy("key", "doc_id").agg(F.collect_set("line_no").alias("drop")), "drops")
    forget(busy, hot, forms, of, alike, equal)
    return out


def _n_lines(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_decided(docs: DataFrame, *, depth: int = 4, percent: int = 70, min_docs: int = 3, min_tokens: int = 1, pair_tokens: int = 50, filter_bits: int = 26) -> DataFrame:
    """documents -> (row, text, n_lines, n_dropped): the row as it was, the text that is left, a row for each row."""
    doc_id, whole = F.col("doc_id").cast("long"), F.col("text").cast("string")
    drops = line_decisions(docs.select(row_key().alias("key"), doc_id.alias("doc_id"), whole.alias("text")), depth=depth, percent=percent, min_docs=min_docs, min_tokens=min_tokens, pair_tokens=pair_tokens, filter_bits=filter_bits)
    keyed = docs.select(row_key().alias("key"), doc_id.alias("id"), F.struct(*docs.columns).alias("row"))
    # drops grow with the corpus: never broadcast, and no hash table of them in memory
    joined = keyed.join(drops.select(F.col("key").alias("at"), F.col("doc_id").alias("at_id"), "drop").hint("merge"), (F.col("key") == F.col("at")) & F.col("id").eqNullSafe(F.col("at_id")), "left")
    text = F.col("row.text").cast("string")
    ls = F.split(text, "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop")))
    rest = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n"))
    return joined.select("row", rest.alias("text"), _n_lines(text).alias("n_lines"), F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).alias("n_dropped"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """documents -> the same columns with the text that is left, and n_lines and n_dropped, a row for each row."""
    cols = [(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return line_decided(docs, **options).select(*cols, "n_lines", "n_dropped")
