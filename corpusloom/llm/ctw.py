"""Language-model scoring by context-tree weighting over bytes.

A text is read as its words (runs outside white space, A-Z lowered), each followed by a space, then an end byte. Every
byte is eight binary decisions; for each decision node there is a context tree over the preceding bytes, whose nodes
hold Krichevsky-Trofimov estimates. A node's weighted probability is half its own estimate and half the product of its
children's; the posterior weights of the trained tree mix the estimates of all depths into the predicted bit.

Three passes, none of which gathers a model in one place: (1) blocks of documents count their distinct grams and words;
(2) partitions by the last three context bytes merge the counts of all blocks and build their subtrees (of the levels
above, a row for each pair of bytes and node goes through the driver: some 10,000s for text, 256^3 at most, whatever the
corpus); (3) each block gets the log probability of every gram and the count of every word that it holds, in the order of
its own sorted keys, and sums them for its documents.

Log probabilities travel as fixed-point numbers of 48 bits (steps of 2^-42, about 2e-13).

Cases: a null or empty text is the end alone; a null doc_id counts as the empty text in the split; repeated rows are
scored and counted as often as they stand; without training rows all counts are 0 and a bit has probability 1/2; a very
long text is read in slices cut between words, which share its context, and is not split over blocks; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, saved, ship
from .vectext import _BYTE, _IS_WORD, _LOWER, _power, U, distinct, mix, pieces

_SPACE, _END = 0x20, 0x0A
_END_KEY = mix(np.array([0xE4D], U))[0]
_LN10 = np.log(10.0)
_BLOCK_BYTES = 32 << 20


_SLICE = 4 << 20


def cuts(gap: np.ndarray, most: int) -> list[int]:
    """Places from 0 to the end, about `most` bytes apart, each but the last after a byte where gap is set."""
    out = [0]
    while out[-1] + most < len(gap):
        at = out[-1] + most
        step = np.flatnonzero(gap[at : at + most])
        while not len(step) and at + most < len(gap):
            at += most
            step = np.flatnonzero(gap[at : at + most])
        if not len(step):
            break
        out.append(at + int(step[0]) + 1)
    return [*out, len(gap)] if len(gap) > out[-1] else out


def canonical(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of the documents as the model reads them; each document ends in the only 0x0A that it has."""
    if len(offsets) != 2 or len(data) <= _SLICE:
        return _canonical(data, offsets)
    at = cuts(~_IS_WORD[data], _SLICE)  # a long document in parts between words
    parts = [_canonical(data[a:b], np.array([0, b - a]))[:-1] for a, b in zip(at, at[1:], strict=False)]
    return np.concatenate((*parts, np.array([_END], np.uint8)))


def _canonical(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    d = np.insert(_LOWER[data], np.repeat(offsets[1:], 2), np.tile(np.array([_SPACE, _END], np.uint8), n))
    word = _IS_WORD[d]
    gap = np.zeros(len(d), bool)
    gap[1:] = word[:-1] & ~word[1:]
    d[gap] = _SPACE
    keep = word | gap
    last = offsets[1:] + 2 * np.arange(n) + 1
    keep[last] = True
    d[last] = _END
    return d[keep]


def grams(c: np.ndarray, depth: int) -> np.ndarray:
    """Byte i and its `depth` predecessors as one number, the nearest lowest; before a document stand end bytes."""
    c64 = c.astype(U)
    g = c64.copy()
    for k in range(1, depth + 1):
        g[k:] |= c64[:-k] << U(8 * k) if k < len(c) else U(0)
    end = np.flatnonzero(c == _END) + 1
    begin, stop = np.append(0, end), np.append(end, len(c))  # what comes last need not end here
    for k in range(1, depth + 1):
        for p in range(k):
            at = (begin + p)[begin + p < stop]
            g[at] = (g[at] & ~U(0xFF << (8 * k))) | U(_END << (8 * k))
    return g


def gram_slices(c: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, grams of the bytes from there on) for slices of canonical bytes, cut after words."""
    at = cuts((c == _SPACE) | (c == _END), _SLICE)
    for a, b in zip(at, at[1:], strict=False):
        before = min(a, depth)
        yield a, grams(c[a - before : b], depth)[before:]


def word_slices(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_keys of slices of canonical bytes."""
    at, doc = cuts((c == _SPACE) | (c == _END), _SLICE), 0
    for a, b in zip(at, at[1:], strict=False):
        keys, own = word_keys(c[a:b])
        yield keys, own + doc
        doc += int((c[a:b] == _END).sum())


def word_keys(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token and the index of its document; a document's end is a token."""
    word = _IS_WORD[c]
    first = word.copy()
    first[1:] &= ~word[:-1]
    end = np.flatnonzero(c == _END)
    s = np.flatnonzero(first)
    e = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    up, down = _power(len(c))
    v = _BYTE[c]
    v *= up[: len(c)]
    total = np.cumsum(v, dtype=U)
    h = mix((total[e - 1] - total[s] + v[s]) * down[s])
    return np.concatenate((h, np.full(len(end), _END_KEY, U))), np.concatenate((np.searchsorted(end, s), np.arange(len(end))))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_keys(b) -> np.ndarray:
    return np.cumsum(_unpack(b, U), dtype=U)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.empty(0, U)
    if not len(k):
        return np.empty(0, U), np.empty(0, np.int64)
    n = np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(n[order], at)


_SCHEMA = "block long, kind string, p int, payload binary, extra binary"


def _part_of(kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix((keys >> U(8)) & U(0xFFFFFF) if kind == "g" else keys.copy()) % U(parts)).astype(np.int32)


def _by_part(kind: str, keys: np.ndarray, parts: int) -> tuple[list[int], list[np.ndarray]]:
    """The partitions of some sorted keys, and for each the places of its keys, which stay sorted."""
    part = _part_of(kind, keys, parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    ps = [p for p in range(parts) if cut[p] < cut[p + 1]]
    return ps, [order[cut[p] : cut[p + 1]] for p in ps]


_FIXED = 2.0**42


def _pack_logs(x: np.ndarray) -> bytes:
    """48 bits each, byte plane by byte plane."""
    whole = np.clip(np.round(x * _FIXED), -(2.0**47), 2.0**47 - 1).astype("<i8")
    return _pack(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, :6].T))


def _unpack_logs(b) -> np.ndarray:
    planes = _unpack(b, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return (out.view("<i8").ravel() >> 16) / _FIXED


def _counter(depth: int, parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24  # type: ignore[union-attr]
        state: dict = {"block": 0, "size": 0, "piece": 0, "g": ([], []), "w": ([], [])}

        def rows(kind: list, p: list, payload: list, extra: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + state["block"]] * len(p), pa.int64()), pa.array(kind, pa.string()), pa.array(p, pa.int32()), pa.array(payload, pa.binary()), pa.array(extra, pa.binary())], ["block", "kind", "p", "payload", "extra"])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in "gw":
                keys, n = _merge(*state[kind])
                ps, sel = _by_part(kind, keys, parts)
                yield rows([kind] * len(ps), ps, [_pack_keys(keys[x]) for x in sel], [_pack(n[x].astype(np.uint32)) for x in sel])
            state.update(block=state["block"] + 1, size=0, piece=0, g=([], []), w=([], []))

        for part, data, offsets in pieces(batches):
            ids, held = part.column(0), part.column(2).to_numpy(zero_copy_only=False)
            c = canonical(data, offsets)
            end = np.flatnonzero(c == _END) + 1
            lengths = np.diff(end, prepend=0)
            learns = np.repeat(~held, lengths)
            for kind in "gw":
                for x, y in gram_slices(c, depth) if kind == "g" else word_slices(c):
                    all_keys, learn = (y, learns[x : x + len(y)]) if kind == "g" else (x, ~held[y])
                    known, n = distinct(all_keys[learn])
                    new, _ = distinct(all_keys[~learn])
                    state[kind][0].extend((known, new))
                    state[kind][1].extend((n, np.zeros(len(new), np.int64)))
                    if len(state[kind][0]) >= 8:
                        k, m = _merge(*state[kind])
                        state[kind] = ([k], [m])
            null = ids.is_null().to_numpy(zero_copy_only=False)
            about = np.concatenate((ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint8), null.view(np.uint8), held.view(np.uint8)))
            yield rows(["t"], [state["piece"]], [_pack(c)], [about.tobytes()])
            state["piece"] += 1
            state["size"] += len(c)
            if state["size"] >= _BLOCK_BYTES:
                yield from flush()
        if state["piece"]:
            yield from flush()

    return count


_TABLE = 1 << 16
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))))  # log gamma(n + 1/2) - log gamma(1/2)
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _TABLE)))))  # log gamma(n + 1)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma of large x."""
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i / 1260))


def _log_gamma(n: np.ndarray, table: np.ndarray, plus: float, less: float) -> np.ndarray:
    n = n.astype(np.int64)
    out = table[np.minimum(n, _TABLE - 1)]
    large = n >= _TABLE
    if large.any():
        out[large] = _stirling(n[large] + plus) - less
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with a zeros and b ones."""
    half = 0.5723649429247001  # log gamma(1/2)
    return _log_gamma(a, _HALF, 0.5, half) + _log_gamma(b, _HALF, 0.5, half) - _log_gamma(a + b, _WHOLE, 1.0, 0.0)


def _nodes(codes: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, first `level` bits of the byte) of sorted grams, with the counts of the next bit 0 and 1."""
    key = codes >> U(8 - level)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    one = ((codes >> U(7 - level)) & U(1)).astype(bool)
    return key[at], np.add.reduceat(np.where(one, 0, n), at), np.add.reduceat(np.where(one, n, 0), at)


class Tree:
    """The levels from `low` to `depth` of the context trees over some grams and their counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int, low: int):
        self.depth, self.low = depth, low
        self.levels: list[dict[int, tuple]] = []
        seen = n > 0
        codes, n = codes[seen], n[seen]
        by_depth = {depth: (codes, n)}
        for d in range(depth - 1, low - 1, -1):
            by_depth[d] = _merge([by_depth[d + 1][0] & U((1 << (8 * (d + 1))) - 1)], [by_depth[d + 1][1]])
        for level in range(8):
            at: dict[int, tuple] = {}
            for d in range(depth, low - 1, -1):
                if not len(by_depth[d][0]):
                    at[d] = (np.empty(0, U), *[np.empty(0)] * 4)
                    continue
                key, a, b = _nodes(*by_depth[d], level)
                kt = _log_kt(a, b)
                if d == depth:
                    weighted, stop = kt, np.ones(len(kt))
                else:
                    child_key, child = at[d + 1][0], at[d + 1][3]
                    up = np.searchsorted(key, child_key & U((1 << (8 * d + level)) - 1))
                    below = np.bincount(up, weights=child, minlength=len(key))
                    weighted = np.logaddexp(kt, below) - np.log(2)
                    stop = np.exp(kt - np.log(2) - weighted)
                at[d] = (key, a, b, weighted, stop)
            self.levels.append(at)

    def mixed(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted probability of the gram's bit as mixed from the deepest seen node up to `low`, and where any was seen."""
        bit = ((codes >> U(7 - level)) & U(1)).astype(bool)
        q, any_seen = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        for d in range(self.depth, self.low - 1, -1):
            key, a, b, _, stop = self.levels[level][d]
            if not len(key):
                continue
            want = (codes & U((1 << (8 * (d + 1))) - 1)) >> U(8 - level)
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[i] == want
            own = (np.where(bit, b[i], a[i]) + 0.5) / (a[i] + b[i] + 1.0)
            w = np.where(any_seen, stop[i], 1.0)
            q = np.where(hit, w * own + (1 - w) * q, q)
            any_seen |= hit
        return q, any_seen


_LOW = 3  # the depth at which partitions begin


def _merged(t: pa.Table, some: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all blocks of a partition, some blocks at a time."""
    keys, n = np.empty(0, U), np.empty(0, np.int64)
    payload, extra = t.column("payload"), t.column("extra")
    for a in range(0, t.num_rows, some):
        at = range(a, min(a + some, t.num_rows))
        keys, n = _merge([keys, *(_unpack_keys(payload[i].as_buffer()) for i in at)], [n, *(_unpack(extra[i].as_buffer(), np.uint32).astype(np.int64) for i in at)])
    return keys, n


def _top(depth: int):
    """For one partition: what the levels above need of its subtrees; for words: tokens and distinct tokens seen."""

    def stats(t: pa.Table) -> pa.Table:
        keys, n = _merged(t)
        out: list[list] = [[], [], [], [], []]
        if t.column("kind")[0].as_py() == "w":
            cols = [np.array([-1]), np.array([0]), np.array([n.sum()]), np.array([(n > 0).sum()]), np.array([0.0])]
            out = [[c] for c in cols]
        else:
            tree = Tree(keys, n, depth, _LOW)
            for level in range(8):
                key, a, b, weighted, _ = tree.levels[level][_LOW]
                if len(key):
                    last = (key >> U(level)) & U(0xFFFF)
                    node = (key & U((1 << level) - 1)) | U(1 << level)
                    # a row for each pair of last bytes and node: sums over the byte before
                    both, at = np.unique((last << U(8)) | node, return_inverse=True)
                    for o, v in zip(out, (both >> U(8), both & U(0xFF), np.bincount(at, a), np.bincount(at, b), np.bincount(at, weighted)), strict=True):
                        o.append(v)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(o).astype(k) if o else np.empty(0, k) for c, o, k in zip(("last", "node", "a", "b", "weighted"), out, kinds, strict=True)})

    return stats


class Top:
    """Depths 0 to 2: estimate of bit 1, weight of stopping, seen; sorted by (last two bytes, node), dense above."""

    def __init__(self, last: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        key = (last << 8) | node
        order = np.argsort(key)
        self.key, a, b, below = key[order], a[order].astype(float), b[order].astype(float), below[order]
        kt = _log_kt(a, b)
        two = np.logaddexp(kt, below) - np.log(2)
        self.two, self.two_stop = (b + 0.5) / (a + b + 1), np.exp(kt - np.log(2) - two)
        up = self.key & 0xFFFF
        a, b, below = (np.bincount(up, v, 1 << 16) for v in (a, b, two))
        kt = _log_kt(a, b)
        self.one_seen = a + b > 0
        one = np.where(self.one_seen, np.logaddexp(kt, below) - np.log(2), 0.0)
        self.one, self.one_stop = (b + 0.5) / (a + b + 1), np.exp(kt - np.log(2) - one)
        a, b, below = (v.reshape(256, 256).sum(axis=0) for v in (a, b, one))
        kt = _log_kt(a, b)
        zero = np.logaddexp(kt, below) - np.log(2)
        self.zero, self.zero_stop = (b + 0.5) / (a + b + 1), np.exp(kt - np.log(2) - zero)

    def mixed(self, codes: np.ndarray, level: int, q: np.ndarray, seen: np.ndarray) -> np.ndarray:
        sym = codes & U(0xFF)
        bit = ((sym >> U(7 - level)) & U(1)).astype(bool)
        node = ((sym >> U(8 - level)) | U(1 << level)).astype(np.int64)
        two = (((codes >> U(8)) & U(0xFFFF)).astype(np.int64) << 8) | node

        def step(at: np.ndarray, one: np.ndarray, stop: np.ndarray, here: np.ndarray) -> None:
            nonlocal q, seen
            own = np.where(bit, one[at], 1 - one[at])
            w = np.where(seen, stop[at], 1.0)
            q = np.where(here, w * own + (1 - w) * q, q)
            seen = seen | here

        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, two), len(self.key) - 1)
            step(at, self.two, self.two_stop, self.key[at] == two)
        at = two & 0xFFFF
        step(at, self.one, self.one_stop, self.one_seen[at])
        step(node, self.zero, self.zero_stop, np.ones(len(node), bool))
        return q


def log10_probability(tree: Tree, top: Top, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes))
    for level in range(8):
        out += np.log(top.mixed(codes, level, *tree.mixed(codes, level)))
    return out / _LN10


_ANSWER = "block long, kind string, p int, extra binary"


def _answers(depth: int, top: Top):
    """For one partition: to every block the values of its keys in their order, log10 probabilities of grams or counts of words."""

    def answer(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        keys, n = _merged(t)
        value = n if kind == "w" else log10_probability(Tree(keys, n, depth, _LOW), top, keys)
        pack = _pack if kind == "w" else _pack_logs
        got = [pack(value[np.searchsorted(keys, _unpack_keys(x.as_buffer()))]) for x in t.column("payload")]
        return pa.table({"block": t.column("block"), "kind": t.column("kind"), "p": t.column("p"), "extra": pa.array(got, pa.binary())})

    return answer


def _values(kind: str, keys: np.ndarray, parts: int, answers: pa.Table) -> np.ndarray:
    """The answers in the order of a block's sorted keys."""
    of = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    got = {p: x for p, x in zip(of.column("p").to_pylist(), of.column("extra"), strict=True)}
    out = np.empty(len(keys), np.int64 if kind == "w" else np.float64)
    for p, at in zip(*_by_part(kind, keys, parts), strict=True):
        out[at] = _unpack(got[p].as_buffer(), np.int64) if kind == "w" else _unpack_logs(got[p].as_buffer())
    return out


class Lookup:
    """A hash table over distinct keys with vectorised probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.slot, self.values = keys, np.full(1 << bits, -1, np.int32), values
        wait, h = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(wait):
            free = self.slot[h] < 0
            self.slot[h[free]] = wait[free]
            left = self.slot[h] != wait
            wait, h = wait[left], (h[left] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        h = self._hash(keys)
        found = self.slot[h]
        wrong = np.flatnonzero(self.key[found] != keys)
        h = h[wrong]
        while len(wrong):
            h = (h + 1) & self.mask
            found[wrong] = self.slot[h]
            still = self.key[found[wrong]] != keys[wrong]
            wrong, h = wrong[still], h[still]
        return self.values[found]


def _score(depth: int, parts: int, train: int, types: int, key, texts: pa.Table, answers: pa.Table) -> pa.Table:
    pieces_ = texts.column("payload")
    table = {}
    for kind in "gw":  # the block's keys once more: cheaper than to send them with the answers
        keys: list[np.ndarray] = []
        for payload in pieces_:
            c = _unpack(payload.as_buffer(), np.uint8)
            keys += [distinct(y if kind == "g" else x)[0] for x, y in (gram_slices(c, depth) if kind == "g" else word_slices(c))]
            if len(keys) >= 8:
                keys = [distinct(np.concatenate(keys))[0]]
        all_keys = distinct(np.concatenate(keys))[0]
        del keys
        table[kind] = Lookup(all_keys, _values(kind, all_keys, parts, answers))
    out: list[list] = [[], [], [], [], [], [], []]
    whole = np.log10(train + 0.1 * (types + 1))
    for payload, about in zip(pieces_, texts.column("extra"), strict=True):
        c, about = _unpack(payload.as_buffer(), np.uint8), np.frombuffer(about.as_buffer(), np.uint8)
        n = len(about) // 10
        end = np.flatnonzero(c == _END)
        score, base, tokens, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a, of in gram_slices(c, depth):
            first, last = np.searchsorted(end, (a, a + len(of) - 1))
            begin = np.append(0, end[first:last] + 1 - a)
            score[first : last + 1] += np.add.reduceat(table["g"](of), begin)
        for of, doc in word_slices(c):
            count = table["w"](of)
            base += np.bincount(doc, weights=np.log10(count + 0.1) - whole, minlength=n)
            tokens += np.bincount(doc, minlength=n)
            seen += np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64)
        ids = about[: 8 * n].view(np.int64)
        cols = (ids, about[8 * n : 9 * n].astype(bool), about[9 * n :].astype(bool), tokens, seen, base, score)
        for o, v in zip(out, cols, strict=True):
            o.append(v)
    ids, null, held, tokens, seen, base, score = (np.concatenate(o) for o in out)
    sizes = np.full(len(ids), train, np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=null), "held_out": held, "n_tokens": tokens.astype(np.int64), "n_known": seen, "train_tokens": sizes, "base_score": base, "score": score})


def ctw_score(docs: DataFrame, *, depth: int = 6, held_mod: int = 10, held_rest: int = 0) -> DataFrame:
    """documents (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each.

    Rows whose crc32(doc_id as text) mod `held_mod` is `held_rest` are held out; the model learns from all others.
    score is the log10 probability that the context-tree mixture gives the text, base_score that of the add-0.1 unigram.
    """
    if depth < _LOW:
        raise ValueError(f"depth is {_LOW} at least")
    spark = docs.sparkSession
    ship(spark)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (doc_bucket(held_mod) == held_rest).alias("held"))
    blocks = saved(rows.mapInArrow(_counter(depth, parts), _SCHEMA), "ctw-blocks", partition="kind").select("block", "kind", "p", "payload", "extra")
    keys = blocks.where("kind <> 't'")
    stats = keys.groupBy("kind", "p").applyInArrow(_top(depth), "last long, node long, a long, b long, weighted double")
    up = stats.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("a", "b", "weighted")]).toArrow()
    last, node, a, b, weighted = (up.column(c).to_numpy() for c in ("last", "node", "a", "b", "weighted"))
    words = last < 0
    train, types = int(a[words].sum()), int(b[words].sum())
    top = Top(*(v[~words] for v in (last, node, a, b, weighted)))
    answers = keys.groupBy("kind", "p").applyInArrow(_answers(depth, top), _ANSWER)
    score = functools.partial(_score, depth, parts, train, types)
    texts = blocks.where("kind = 't'").groupBy("block")
    return texts.cogroup(answers.groupBy("block")).applyInArrow(lambda key, a, b: score(key, a, b), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
