"""SentencePiece encoding and decoding with a given BPE vocabulary; giant texts are encoded in parallel chunks.

A sequence of pieces is the encoding of a text exactly if every two neighbours are what the merges make of the two
together. Over the semiring (max, +) with weights 0 for neighbours that fit and minus infinity for others, the encoding is
the only path of finite weight through the lattice of pieces. So a chunk has a transfer matrix between boundary states
(where the last piece before the boundary ends, and which it is). The matrices of `fan` neighbouring chunks are multiplied
in one task each, the products of a text are scanned for the states at the blocks' boundaries, and these fix the states
inside each block; then every chunk is traced back by itself. Short texts are one chunk; there the path is followed from
word to word, and words are remembered in a cache of bounded size.

The result is that of the sentencepiece library with the same model: a space in front, spaces as U+2581, characters
outside the vocabulary as bytes.

Cases: a null or empty text has no ids and decodes to the empty text; U+2581 in a text decodes to a space; repeated rows
are encoded alike; any length that a Spark string has is handled, in chunks, of which only the last step, the row of the
result, brings a text together; empty tables give none. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .vectext import U
from .vectext import pieces as slices

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CACHE = 150_000
FREE = 1 << 30  # in the place of a piece: whatever comes before, any piece may follow


@functools.lru_cache(maxsize=1)
def _codec(model: bytes) -> Codec:
    return Codec(model)


class _Words(dict):
    """Ids of words with a prefix, computed when first asked for. Of words not used lately half are forgotten at a time."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix, self.old = codec, prefix, {}

    def learn(self, words: set[str]) -> None:
        """Compute what is not known of some words, all at once."""
        old = self.old
        new = [w for w in words if w not in self and w not in old and len(w) < _LONG_WORD]
        if len(new) < 200:  # not worth it
            return
        if len(self) + len(new) > _CACHE:
            self.old = dict(self)
            self.clear()
        new.sort(key=len)
        for a in range(0, len(new), 8192):
            some = new[a : a + 8192]
            self.update(zip(some, self.codec.table.ids([self.prefix + w for w in some]), strict=True))

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if len(word) > 1 and (word[-2], word[-1]) not in self.codec.beside:  # no piece has these two side by side
                got = self[word[:-1]] + self.codec.bare[word[-1]]
            else:
                got = self.codec.ids(self.codec.path(self.prefix + word))
        if len(self) >= _CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


_LONG_WORD = 48
_TIMES = 0x9E3779B97F4A7C15


class _Hashed:
    """Open addressing from 64-bit keys (none is 0) to int32; -2 for a key that is not there."""

    def __init__(self, bits: int):
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.key, self.value, self.n = np.zeros(self.mask + 1, U), np.zeros(self.mask + 1, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        self.n += len(keys)
        h = self._slot(keys)
        while len(keys):
            free = self.key[h] == 0
            self.key[h[free]] = keys[free]
            mine = self.key[h] == keys
            self.value[h[mine]] = values[mine]
            keys, values, h = keys[~mine], values[~mine], (h[~mine] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        h = self._slot(keys)
        there = self.key[h]
        out = np.where(there == keys, self.value[h], -2).astype(np.int32)
        wait = np.flatnonzero((there != keys) & (there != 0))
        h = h[wait]
        while len(wait):
            h = (h + 1) & self.mask
            there = self.key[h]
            hit = there == keys[wait]
            out[wait[hit]] = self.value[h[hit]]
            go = ~hit & (there != 0)
            wait, h = wait[go], h[go]
        return out


class _Paths:
    """Codec.path for many words at once: the last piece of every prefix, prefix length by prefix length.

    A substring is looked up by a 64-bit polynomial hash of its characters, and its length has to be the piece's.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.power = np.array([pow(_TIMES, i, 1 << 64) for i in range(codec.longest + 1)], U)
        self.sizes = np.array([len(t) for t in codec.text])
        hashes = [functools.reduce(lambda h, ch: (h * _TIMES + ord(ch) + 1) % (1 << 64), t, 0) for t in codec.id]
        self.piece = _Hashed(18)
        self.piece.put(np.array(hashes, U), np.array(list(codec.id.values()), np.int32))
        self.fits = _Hashed(21)
        self.solo = np.full(codec.size, -1, np.int8)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = 1 << 21  # tokens below 0 are characters
        key = ((a.astype(np.int64) + shift).astype(U) << U(32)) | (b.astype(np.int64) + shift).astype(U)
        got = self.fits.get(key)
        new = np.flatnonzero(got == -2)
        if len(new):
            pairs, at = np.unique(key[new], return_inverse=True)
            values = np.array([self.codec.tried((k >> 32) - shift, (k & 0xFFFFFFFF) - shift) for k in pairs.tolist()], np.int32)
            if 2 * (self.fits.n + len(pairs)) > self.fits.mask:
                self.fits.clear()
            self.fits.put(pairs, values)
            got[new] = values[at]
        return got.astype(bool)

    def _alone(self, t: np.ndarray) -> np.ndarray:
        for k in np.unique(t[self.solo[t] < 0]).tolist():
            self.solo[k] = self.codec.solo(k)
        return self.solo[t].astype(bool)

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words, none empty."""
        n = np.array([len(w) for w in words])
        order = np.argsort(-n, kind="stable")
        n = n[order]
        chars = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start, most = np.cumsum(n) - n, int(n[0])
        hashed, last, size_of = np.zeros((most + 1, len(n)), U), np.zeros((most + 1, len(n)), np.int32), np.zeros((most + 1, len(n)), np.int16)
        for i in range(1, most + 1):
            m = int(np.searchsorted(-n, -i, side="right"))  # the words of i characters and more
            ch = chars[start[:m] + i - 1]
            hashed[i, :m] = hashed[i - 1, :m] * U(_TIMES) + (ch + 1).astype(U)
            left = np.arange(m)
            for size in range(min(self.codec.longest, i), 0, -1):
                j = i - size
                t = self.piece.get(hashed[i, left] - hashed[j, left] * self.power[size])
                t = np.where((t >= 0) & (self.sizes[t] == size), t, -2)
                if size == 1:  # what no longer piece ends is ended by its last character
                    ok, t = np.arange(len(left)), np.where(t < 0, -1 - ch[left], t)
                else:
                    some = np.flatnonzero(t >= 0)
                    ok = some[self._alone(t[some]) if j == 0 else self._fit(last[j, left[some]], t[some])] if len(some) else some
                last[i, left[ok]], size_of[i, left[ok]] = t[ok], size
                left = np.delete(left, ok)
                if not len(left):
                    break
        at, word, tokens, owners = n.copy(), np.arange(len(n)), [], []
        while len(word):
            tokens.append(last[at[word], word])
            owners.append(word)
            at[word] -= size_of[at[word], word]
            word = word[at[word] > 0]
        token, owner = np.concatenate(tokens)[::-1], np.concatenate(owners)[::-1]
        k = np.argsort(owner, kind="stable")
        token, owner = token[k], owner[k]
        cut = np.searchsorted(owner, np.arange(len(n) + 1))
        raw, odd = token.astype(np.int32).tobytes(), np.minimum.reduceat(token, cut[:-1]) < 0
        out: list[bytes] = [b""] * len(n)
        for r, i in enumerate(order.tolist()):
            out[i] = self.codec.ids(token[cut[r] : cut[r + 1]].tolist()) if odd[r] else raw[4 * cut[r] : 4 * cut[r + 1]]
        return out


class Codec:
    """Pieces of a model, the test whether two fit, and encoding of whole units."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.score = [sp.get_score(i) for i in range(self.size)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(self.size)]
        self.byte_id = {int(self.text[i][3:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.longest = max(map(len, self.id))
        self.ends = {t[i:] for t in self.id for i in range(len(t))}
        self.beside = {(t[i], t[i + 1]) for t in self.id for i in range(len(t) - 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.prefixes: dict[str, int] = {}
        self.lines = not any("\n" in t for t in self.id)
        self.newline = self.ids([-11]) if self.lines else b""
        self.spaced, self.bare = _Words(self, SPACE), _Words(self, "")
        raw = [b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        for value, i in self.byte_id.items():
            raw[i] = bytes([value])
        self.length = np.array([len(r) for r in raw])
        self.begin = np.append(0, np.cumsum(self.length))[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.table = _Paths(self)

    def token(self, s: str) -> int | None:
        """Id of a piece; -1 - code point for a single character that is none."""
        t = self.id.get(s)
        return -1 - ord(s) if t is None and len(s) == 1 else t

    def string(self, t: int) -> str:
        return self.text[t] if t >= 0 else chr(-1 - t)

    def merged(self, s: str) -> list[str]:
        """The merges played out: the best-scored neighbours first, of equals the leftmost."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = self.id.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.score[t] > best):
                    best, at = self.score[t], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def tried(self, a: int, b: int) -> bool:
        """Whether two tokens are what the merges make of the two together."""
        x, y = self.string(a), self.string(b)
        return self.merged(x + y) == [x, y]

    def fit(self, a: int, b: int) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > _CACHE:
                self.fits.clear()
            ok = self.fits[a, b] = self.tried(a, b)
        return ok

    def solo(self, a: int) -> bool:
        ok = self.alone.get(a)
        if ok is None:
            ok = self.alone[a] = len(self.merged(self.string(a))) == 1
        return ok

    def path(self, s: str) -> list[int]:
        """The tokens of s, by the only last token that each prefix can have; prefixes of short units are remembered."""
        n, get, fits = len(s), self.id.get, self.fits
        known = self.prefixes if n <= 48 else {}
        if len(known) > _CACHE // 2:
            known.clear()
        done = n
        while done and s[:done] not in known:
            done -= 1
        ends = self.ends
        for i in range(done + 1, n + 1):
            j = i - 2
            while j >= 0 and s[j:i] in ends:
                j -= 1
            for j in range(j + 1, i):
                t = get(s[j:i])
                if t is None:
                    if j < i - 1:
                        continue
                    t = -1 - ord(s[j])
                if j == 0:
                    ok = self.solo(t)
                else:
                    before = known[s[:j]]
                    ok = fits.get((before, t))
                    if ok is None:
                        ok = self.fit(before, t)
                if ok:
                    known[s[:i]] = t
                    break
        out = []
        while n:
            t = known[s[:n]]
            out.append(t)
            n -= len(self.text[t]) if t >= 0 else 1
        return out[::-1]

    def ids(self, tokens: list[int]) -> bytes:
        out: list[int] = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            else:
                out.extend(self.byte_id[b] for b in chr(-1 - t).encode())
        return np.array(out, np.int32).tobytes()

    def units(self, s: str) -> bytes:
        """Ids of text whose spaces are already U+2581; no piece has U+2581 after another character."""
        return b"".join([self.ids(self.path(u)) for line in (re.split("(\n)", s) if self.lines else [s]) for u in _UNIT.findall(line)])

    def learn(self, texts: list[str]) -> None:
        """Get the words of some texts into the caches at once; encode() then finds them there."""
        spaced: set[str] = set()
        bare: set[str] = set()
        for text in texts:
            if text and self.lines and SPACE not in text:
                for k, line in enumerate(text.split("\n")):
                    words = line.split(" ")
                    if k:
                        bare.add(words[0])
                        del words[0]
                    spaced.update(words)
        self.bare.learn(bare - {""})
        self.spaced.learn(spaced - {""})

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32."""
        if not text:
            return b""
        if SPACE in text or not self.lines:
            return self.units(SPACE + text.replace(" ", SPACE))
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
                if not line:
                    continue
            words = line.split(" ")
            if "" in words:  # runs of spaces
                out.append(self.units((SPACE if k == 0 else "") + line.replace(" ", SPACE)))
                continue
            if k:
                out.append(self.bare[words[0]])
                del words[0]
            out.extend(map(self.spaced.__getitem__, words))
        return b"".join(out)

    def decoded(self, ids: np.ndarray, most: int = 1 << 16) -> Iterator[bytes]:
        """UTF-8 of a sequence of ids, without the space in front, `most` ids at a time."""
        for a in range(0, len(ids), most):
            some = ids[a : a + most]
            length = self.length[some]
            at = np.repeat(self.begin[some] - np.append(0, np.cumsum(length))[:-1], length) + np.arange(length.sum())
            out = self.bytes[at].tobytes()
            yield out[1:] if a == 0 and out[:1] == b" " else out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded(ids))


def _is_cut(s: str, i: int) -> bool:
    """Whether no piece can cross place i: U+2581 after another character."""
    return 0 < i < len(s) and s[i] == SPACE != s[i - 1]


def chunk_states(c: Codec, context: str, chunk: str, at_start: bool) -> list[tuple[int, int]]:
    """Possible states at a boundary: (characters back to the end of the last piece, that piece or FREE)."""
    if at_start:
        return [(0, FREE)]
    out, s = [], context + chunk[:1]
    if len(context) < c.longest:  # the context reaches back to the beginning of the text
        out.append((len(context), FREE))
    for back in range(min(c.longest, len(context))):
        end = len(context) - back
        if _is_cut(s, end):
            out.append((back, FREE))
            continue
        for size in range(1, min(c.longest, end) + 1):
            t = c.token(context[end - size : end])
            if t is not None and c.solo(t):
                out.append((back, t))
    return out


def _spread(c: Codec, s: str, stop: int, nodes: dict[int, dict[int, int]], least: int) -> dict[int, dict[int, int]]:
    """Extend paths up to `stop`; nodes[end][piece] is a bit set of the states they came from. Pieces end after `least`."""
    for at in range(min(nodes, default=0), stop):
        for t, mask in nodes.get(at, {}).items():
            for size in range(max(1, least + 1 - at), min(c.longest, stop - at) + 1):
                b = c.token(s[at : at + size])
                if b is not None and (c.solo(b) if t == FREE else c.fit(t, b)):
                    there = nodes.setdefault(at + size, {})
                    b = FREE if _is_cut(s, at + size) else b
                    there[b] = there.get(b, 0) | mask
    return nodes


def transfer(c: Codec, context: str, chunk: str, after: str, at_start: bool) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The finite entries of a chunk's transfer matrix: (state at its beginning, state at its end). after: the next character."""
    states, low = chunk_states(c, context, chunk, at_start), len(context)
    s, end = context + chunk + (after or SPACE), len(context) + len(chunk)
    nodes: dict[int, dict[int, int]] = {}
    for k, (back, t) in enumerate(states):
        here = nodes.setdefault(low - back, {})
        here[t] = here.get(t, 0) | 1 << k
    first = next((i for i in range(max(1, low), end + 1) if _is_cut(s, i)), None)
    if first is None:
        nodes = _spread(c, s, end, nodes, low)
    else:
        mask = _spread(c, s, first, nodes, low).get(first, {}).get(FREE, 0)
        last = next(i for i in range(end, 0, -1) if _is_cut(s, i))
        nodes = _spread(c, s, end, {last: {FREE: mask}}, last)
    if not after:  # the text ends here
        nodes = {end: {FREE: functools.reduce(lambda x, y: x | y, nodes.get(end, {}).values(), 0)}}
    out = []
    for back in range(min(c.longest, len(s))):
        for t, mask in nodes.get(end - back, {}).items():
            out += [(states[k], (back, t)) for k in range(len(states)) if mask >> k & 1]
    return out


def compose(a: list, b: list) -> list:
    """The product of two transfer matrices."""
    by: dict = {}
    for x, y in b:
        by.setdefault(x, []).append(y)
    return list({(x, z) for x, y in a for z in by.get(y, ())})


def boundary_states(matrices: list[list], first: tuple[int, int] = (0, FREE), last: tuple[int, int] = (0, FREE)) -> list[tuple[int, int]]:
    """The state at every boundary from first to last: those reached from the left and leading to the end."""
    left = [{first}]
    for m in matrices:
        left.append({y for x, y in m if x in left[-1]})
    right = [{last} & left[-1]]
    for m in reversed(matrices):
        right.append({x for x, y in m if y in right[-1]})
    both = [a & b for a, b in zip(left, reversed(right), strict=True)]
    assert all(len(x) == 1 for x in both), "a text has one encoding"
    return [next(iter(x)) for x in both]


def _whole_words(c: Codec, s: str) -> bytes:
    """Ids of text that begins with U+2581, has no two in a row and none at a line's end."""
    out = []
    for k, line in enumerate(s.split("\n")):
        words = line.split(SPACE)
        first = words.pop(0)
        if k:
            out.append(c.newline)
            if first:
                out.append(c.bare[first])
        out.extend(map(c.spaced.__getitem__, words))
    return b"".join(out)


def traced(c: Codec, context: str, chunk: str, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
    """Ids of the pieces after the entry state's up to the leaving state's."""
    s, low = context + chunk, len(context)
    end = len(s) - leave[0]
    begin = low - entry[0]
    known = 0 if entry[1] == FREE else len(c.string(entry[1]))
    if end <= begin:
        return b""
    cut = max(begin, 1)  # the first place that no piece crosses
    while cut < end and not s[cut] == SPACE != s[cut - 1]:
        cut += 1
    head, rest = s[begin - known : cut], s[cut:end]
    out = [c.ids(c.path(head)[1:] if known else c.path(head))]
    if rest and c.lines and SPACE + SPACE not in rest and SPACE + "\n" not in rest and rest[-1] != SPACE:
        out.append(_whole_words(c, rest))
    else:
        places = [i for i in range(1, len(rest)) if rest[i] == SPACE != rest[i - 1]]
        out += [c.ids(c.path(rest[i:j])) for i, j in zip([0, *places], [*places, len(rest)], strict=True) if i < j]
    return b"".join(out)


def _digest(codec: Codec, text: str, ids: bytes) -> tuple:
    """Number of ids, their digest, and whether they decode to the text."""
    raw, at, same = text.encode("utf-8", "surrogatepass"), 0, True
    for part in codec.decoded(np.frombuffer(ids, np.int32)):
        same = same and raw.startswith(part, at)
        at += len(part)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), same and at == len(raw)


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _short(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for part, _, _ in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            codec.learn(texts)
            ids = [codec.encode(t) for t in texts]
            n, sha, same = zip(*[_digest(codec, t, i) for t, i in zip(texts, ids, strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(same), _lists(ids)], ["doc_id", "n_tokens", "ids_sha256", "round_trip", "ids"])

    return run


def _cutter(chunk: int, back: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        for part, _, _ in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = SPACE + text.replace(" ", SPACE)
                at = range(0, len(s), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at), pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array([s[max(0, b - back) : b] for b in at]), pa.array([s[b : b + chunk] for b in at]), pa.array([s[b + chunk : b + chunk + 1] for b in at])],
                    ["row", "doc_id", "idx", "context", "chunk", "after"],
                )
                row += 1

    return cut


def _matrices(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for t in batches:
            got = [transfer(codec, c, s, n, i == 0) for i, c, s, n in zip(*[t.column(x).to_pylist() for x in ("idx", "context", "chunk", "after")], strict=True)]
            flat = [np.array([[*x, *y] for x, y in m], np.int32).tobytes() for m in got]
            yield pa.RecordBatch.from_arrays([t.column("row"), t.column("idx"), pa.array(flat, pa.binary())], ["row", "idx", "matrix"])

    return run


def _matrix(flat: pa.Scalar) -> list:
    return [((a, b), (c, d)) for a, b, c, d in np.frombuffer(flat.as_buffer(), np.int32).reshape(-1, 4).tolist()]


def _product(t: pa.Table) -> pa.Table:
    """The product of the matrices of one block of chunks."""
    t = t.sort_by("idx")
    m = functools.reduce(compose, map(_matrix, t.column("matrix")))
    flat = np.array([[*x, *y] for x, y in sorted(m)], np.int32).tobytes()
    return pa.table({"row": t.column("row")[:1], "block": t.column("block")[:1], "matrix": pa.array([flat], pa.binary())})


_STATES = ["in_back", "in_piece", "out_back", "out_piece"]


def _with_states(t: pa.Table, by: list[str], state: list[tuple[int, int]]) -> pa.Table:
    cols = [pa.array([x[k] for x in s], pa.int32()) for s in (state[:-1], state[1:]) for k in (0, 1)]
    return pa.table([*(t.column(c) for c in by), *cols], names=[*by, *_STATES])


def _scan(t: pa.Table) -> pa.Table:
    """The states at the boundaries of one text's blocks, of which it has 256 at most, as a Spark string ends at 2 GB."""
    t = t.sort_by("block")
    return _with_states(t, ["row", "block"], boundary_states([_matrix(m) for m in t.column("matrix")]))


def _inside(t: pa.Table, ends: pa.Table) -> pa.Table:
    """The states at the boundaries of the chunks of one block, whose own are known."""
    t = t.sort_by("idx")
    a, b, c, d = (ends.column(x)[0].as_py() for x in _STATES)
    return _with_states(t, ["row", "idx"], boundary_states([_matrix(m) for m in t.column("matrix")], (a, b), (c, d)))


def _tracer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for t in batches:
            d = t.to_pydict()
            spaced: set[str] = set()
            bare: set[str] = set()
            for line in (x for c in d["chunk"] for x in c.split("\n")):
                words = line.split(SPACE)
                bare.add(words.pop(0))
                spaced.update(words)
            codec.bare.learn(bare - {""})
            codec.spaced.learn(spaced - {""})
            ids = [traced(codec, d["context"][k], d["chunk"][k], (d["in_back"][k], d["in_piece"][k]), (d["out_back"][k], d["out_piece"][k])) for k in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays([t.column("row"), t.column("doc_id"), t.column("idx"), t.column("chunk"), pa.array(ids, pa.binary())], ["row", "doc_id", "idx", "chunk", "ids"])

    return run


def _joined(model: bytes):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        text, ids = "".join(t.column("chunk").to_pylist())[1:].replace(SPACE, " "), b"".join(t.column("ids").to_pylist())
        n, sha, same = _digest(_codec(model), text, ids)
        return pa.table({"doc_id": t.column("doc_id")[:1], "n_tokens": pa.array([n], pa.int64()), "ids_sha256": pa.array([sha]), "round_trip": pa.array([same]), "ids": _lists([ids])})

    return run


def encode(docs: DataFrame, model_path: str, *, chunk: int = 32_768, fan: int = 256) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip, ids.

    round_trip tells whether decoding gives the text again. Texts of more than `chunk` characters go by chunks, and by
    blocks of `fan` chunks.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    back = 2 * _codec(model).longest
    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, ids array<int>"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.where(~giant).mapInArrow(_short(model), schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(1, parts // 4)  # giant texts are few: not a small file for every partition of the documents
    chunks = saved(docs.where(giant).mapInArrow(_cutter(chunk, back), "row long, doc_id long, idx int, context string, chunk string, after string").repartition(few), "chunks")
    matrices = chunks.repartition(parts, "row", "idx").mapInArrow(_matrices(model), "row long, idx int, matrix binary")
    matrices = saved(matrices.withColumn("block", F.floor(F.col("idx") / fan).cast("int")).repartition(few), "matrices")
    products = matrices.groupBy("row", "block").applyInArrow(_product, "row long, block int, matrix binary")
    states = "in_back int, in_piece int, out_back int, out_piece int"
    ends = products.groupBy("row").applyInArrow(_scan, f"row long, block int, {states}")
    at = matrices.groupBy("row", "block").cogroup(ends.groupBy("row", "block")).applyInArrow(_inside, f"row long, idx int, {states}")
    traces = chunks.join(at, ["row", "idx"]).repartition(parts, "row", "idx").mapInArrow(_tracer(model), "row long, doc_id long, idx int, chunk string, ids binary")
    return short.unionByName(traces.groupBy("row").applyInArrow(_joined(model), schema))


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    ship(ids.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for t in batches:
            for k in range(t.num_rows):  # one text at a time
                x = t.column(1)[k].values
                raw = codec.decode(x.to_numpy(zero_copy_only=False).astype(np.int32)) if x is not None else b""
                yield pa.RecordBatch.from_arrays([t.column(0).slice(k, 1), pa.array([raw.decode("utf-8", "replace")], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
