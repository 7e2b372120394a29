"""Lines, language model, pieces, mixing, WARC, HTML, toxicity and the stages."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ctw, linededup, stages, toxicity
from corpusloom.llm.ctw import ctw_score
from corpusloom.llm.htmltext import html_text, text_of
from corpusloom.llm.linededup import line_dedup
from corpusloom.llm.mixing import mix, mixed_documents, word_count
from corpusloom.llm.pieces import SPACE, _codec, boundary_states, compose, decode, encode, traced, transfer
from corpusloom.llm.warc import archives, checked_revisits, read_warc, record, records_in, write_warc

VOCABULARY = stages.VOCABULARY
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source(i), len(t or ""), "k", 1) for i, t in rows], DOCS)


# lines


def test_line_dedup_templates(spark):
    rows = [(i, f"Unique line number {w} stands here alone\nPosted on 2020-01-{i + 10} by user {w}x about things\nAll rights reserved.\nOf the") for i, w in enumerate(("aa", "bb", "cc", "dd"))]
    rows += [(50, None), (51, ""), (None, "All rights reserved."), (0, rows[0][1])]
    got = {(r.doc_id, r.n_lines): (r.text, r.n_dropped) for r in line_dedup(docs(spark, rows), min_tokens=3).collect()}
    assert got[0, 4] == (rows[0][1], 0)  # the first document keeps its lines
    assert got[1, 4] == ("Unique line number bb stands here alone\nOf the", 2)
    assert got[50, 0] == (None, 0) and got[51, 1] == ("", 0) and got[None, 1] == ("", 1)
    assert line_dedup(docs(spark, []).limit(0)).collect() == []


def test_line_dedup_leaves_rare_lines(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(12)) for _ in range(3))) for i in range(40)]
    assert all(r.n_dropped == 0 for r in line_dedup(docs(spark, rows)).collect())


def stage_texts(spark, rows):
    return {r.doc_id: r.text for r in stages.drop_recurring_lines(spark, docs(spark, rows), "").collect()}


def test_pipeline_lines_join_the_template_they_fit(spark):
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, "\n".join([f"own {chr(97 + i) * 3}", " ".join(words if i < 1 else words[: 3 + i] + [chr(97 + i) * 5] + words[4 + i :])])) for i in range(14)]
    got = stage_texts(spark, rows)
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}


def test_pipeline_lines_with_values_that_recur(spark):
    names = "ada bob cyd dan eve fay".split()
    rows = [(6 * i + j, f"own {a}{b}\nThis page was last changed by user {a} from the city of {b} in spring") for i, a in enumerate(names) for j, b in enumerate(names)]
    got = stage_texts(spark, rows)
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}


def test_pipeline_short_lines_and_long_pairs(spark):
    passage = " ".join(f"p{chr(97 + i % 26) * (1 + i // 26)}" for i in range(60))
    rows = [(i, f"own {chr(97 + i) * 4}\nLes.\nAnd ornd.\n\n" + (passage if i > 2 else "end " + chr(98 + i) * 5)) for i in range(5)]
    got = stage_texts(spark, rows)
    assert got == {i: t if i == 0 else "\n".join(x for x in t.split("\n") if x not in ("Les.", "And ornd.") and (i < 4 or x != passage)) for i, t in rows}


def test_pipeline_keeps_lines_of_numbers(spark):
    rows = [(i, f"202{i} 3{i}.5 1{i} {i}\n2021 34.5 12 9\nYear 202{i} was {i} {i}") for i in range(5)]
    got = stage_texts(spark, rows)
    assert got == {i: t if i == 0 else t.replace("2021 34.5 12 9\n", "") for i, t in rows}


@pytest.mark.parametrize("filter_bits", [6, 12, 26])
def test_line_dedup_equals_brute_force(spark, filter_bits):
    """Greedy templates recomputed line by line; a filter too small to hold the leaves changes nothing."""
    rng = random.Random(filter_bits)
    words = [f"{a}{b}" for a in "bcd" for b in "aeiou"]
    base = [[rng.choice(words) for _ in range(n)] for n in (1, 3, 6, 6, 9, 9, 12, 60, 60)]

    def line():
        out = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            out[rng.randrange(len(out))] = rng.choice([*words, "7", "a1"])
        return rng.choice((" ", "  ", "\t")).join(out) + rng.choice(("", " "))

    rows = [(i, "\n".join(line() if rng.random() < 0.9 else rng.choice(("", " ")) for _ in range(rng.randint(1, 6)))) for i in range(90)]
    rows += [(3, rows[3][1]), (200, None), (201, ""), (None, rows[5][1] + "\nx"), (202, "\n".join([" ".join(base[7])] * 3))]
    tokens = {(k, j): x.split() for k, (_, t) in enumerate(rows) for j, x in enumerate((t or "").split("\n")) if x.split()}
    masked = {p: tuple("<*>" if re.search("[0-9]", t) else t for t in x) for p, x in tokens.items()}
    rank = {row: (row[0] is None, row[0] or 0, row[1] or "") for row in rows}
    holders, at = defaultdict(set), {}
    for (k, j), m in masked.items():
        if 100 * sum(t != "<*>" for t in m) >= 70 * len(m):
            holders[m].add(rows[k])
            at[m] = min(at.get(m, (True, 1 << 60, 0)), (*rank[rows[k]][:2], j))
    template, starts = {}, defaultdict(list)
    for m in sorted(holders, key=lambda m: (-len(holders[m]), at[m])):
        same = [sum(a == b != "<*>" for a, b in zip(m, s, strict=True)) for s in starts[len(m), m[:4]]]
        if same and 100 * max(same) >= 70 * len(m):
            template[m] = starts[len(m), m[:4]][same.index(max(same))]
        else:
            starts[len(m), m[:4]].append(m)
            template[m] = m
    groups = defaultdict(set)
    for (k, j), m in masked.items():
        groups["equal", tuple(tokens[k, j])].add(rows[k])
        if m in template:
            groups["alike", template[m]].add(rows[k])
    gone = {p for p, m in masked.items() for g in (("equal", tuple(tokens[p])), ("alike", template.get(m)))
            if len(groups[g]) >= (2 if g[0] == "equal" and len(m) > 50 else 3) and rows[p[0]] != min(groups[g], key=rank.get)}
    want = sorted(repr((i, t and "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in gone), 0 if t is None else t.count("\n") + 1, sum(p[0] == k for p in gone))) for k, (i, t) in enumerate(rows))
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in line_dedup(docs(spark, rows), filter_bits=filter_bits).collect()) == want
    assert len(gone) > 100


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_leaf_bands_find_what_a_scan_finds(percent):
    """Templates by bands against a scan of all, for lines of all lengths, with masked places."""
    rng = np.random.default_rng(percent)
    for n in (1, 3, 4, 5, 6, 8, 12, 25, 60):
        lead = rng.integers(0 if n > 4 else 1, 4, min(4, n))
        rows = [np.concatenate((lead, rng.integers(0, 4, n - len(lead)))).astype(np.int64) for _ in range(150)]
        rows += [np.where((rng.random(n) < 0.2) & (np.arange(n) >= 4), 0, r) for r in rows]
        scan, bands = (linededup.Leaf(rows[0], percent, 4, few) for few in (1 << 30, 0))
        for h, row in enumerate(rows):
            want = scan.find(row)
            assert bands.find(row) == want
            if want is None:
                scan.start(row, h), bands.start(row, h)


def test_lines_of_long_texts_and_clashing_names(spark):
    many = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of all {'x' * (i % 50)}" for i in range(60_000))
    assert len(many) > 2 << 20
    tail = "\nthe end that three documents share\nlast " + "z" * (3 << 20) + " words of a line"
    df = docs(spark, [(i, f"own {i}\n{many}{tail}") for i in range(3)]).withColumns({c: F.lit(777) for c in ("n_dropped", "n_lines", "drop", "row", "at", "id")})
    got = sorted(stages.drop_recurring_lines(spark, df, "").collect())
    assert [r.text for r in got] == [f"own {i}" + (f"\n{many}{tail}" if i == 0 else "") for i in range(3)]
    assert all((r.n_dropped, r.n_lines, r["drop"], r.row, r["at"], r.id, r.n_chars) == (777,) * 6 + (len(r.text),) for r in got)


# context-tree weighting


def brute_ctw(train, text, depth):
    """Node by node: weighted probabilities bottom-up, then the mixture along each bit's contexts."""
    counts = defaultdict(lambda: [0, 0])
    end = b"\n"

    def canonical(t):
        return b"".join(w + b" " for w in (t or "").encode().lower().split()) + end

    def bits(t):
        c = end * depth + canonical(t)
        for i in range(depth, len(c)):
            node = 1
            for j in range(7, -1, -1):
                bit = c[i] >> j & 1
                yield c[i - depth : i], node, bit
                node = node * 2 + bit

    for t in train:
        for ctx, node, bit in bits(t):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node][bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = defaultdict(list)
    for ctx, node in counts:
        if ctx:
            children[ctx[1:], node].append((ctx, node))
    weighted, stop = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            weighted[key], stop[key] = own, 1.0
        else:
            weighted[key] = np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)
            stop[key] = math.exp(own - math.log(2) - weighted[key])
    total = 0.0
    for ctx, node, bit in bits(text):
        q, seen = 0.5, False
        for d in range(depth, -1, -1):
            key = (ctx[depth - d :], node)
            if key in counts:
                n = counts[key]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                w = stop[key] if seen else 1.0
                q, seen = w * own + (1 - w) * q, True
        total += math.log10(q)
    return total


def test_ctw_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "Thing", "of", "über", "a"]) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(40, None), (41, "\t zz "), (None, "the of"), (3, "the the")]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    tokens = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    got = ctw_score(docs(spark, rows), depth=3).collect()
    assert len(got) == len(rows) and any(held)
    by = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in got}
    for (i, t), h in zip(rows, held, strict=True):
        own = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = by[i, len(own), round(base, 6)]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, sum(tokens[w] > 0 for w in own), n)
        assert math.isclose(r.score, brute_ctw(train, t, 3), rel_tol=1e-9)


def test_ctw_slices_of_long_texts(monkeypatch):
    """Slices of any size give the grams, words and canonical bytes of the whole."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcAé \n") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    c = ctw.canonical(data, offsets)
    g, (w, doc) = ctw.grams(c, 4), ctw.word_keys(c)
    alone = [ctw.canonical(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    for size in (1, 5, 16, 64):
        monkeypatch.setattr(ctw, "_SLICE", size)
        assert (np.concatenate([y for _, y in ctw.gram_slices(c, 4)]) == g).all()
        got = [np.concatenate(x) for x in zip(*ctw.word_slices(c), strict=True)]
        assert sorted(zip(*got, strict=True)) == sorted(zip(w, doc, strict=True))
        assert all((ctw.canonical(np.frombuffer(t, np.uint8), np.array([0, len(t)])) == x).all() for t, x in zip(texts, alone, strict=True))


def test_ctw_empty(spark):
    assert ctw_score(docs(spark, []).limit(0)).collect() == []


# pieces


@pytest.fixture(scope="module")
def sp():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        return _codec(f.read())


ALPHABET = [" ", "  ", "a", "the", "ing", "\n", "é", "日", "▁", " b", "tion", "😀", "0", "..", "\t", "in", "Th", " th", "\x00"]


def texts(n=300, seed=8):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def ids_of(sp, t):
    return np.array(sp.encode(t), np.int32).tobytes()


def test_encoding_is_the_librarys(sp, codec):
    for t in texts():
        assert codec.encode(t) == ids_of(sp, t)
        assert codec.decode(np.array(sp.encode(t), np.int32)).decode("utf-8", "replace") == sp.decode(sp.encode(t))


def test_words_learnt_at_once_are_the_librarys(sp, codec):
    rng = random.Random(3)
    letters = ["a", "e", "th", "ing", "é", "日", "😀", "0", ",", ".", "tion", "Th", "\x00", "ß", "qu", "zx"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + ["x" * 47, "tion" * 30, "a"]
    for some in (words, words[::-1]):
        assert codec.table.ids([SPACE + w for w in some]) == [ids_of(sp, w) for w in some]
    fresh = type(codec)(open(VOCABULARY, "rb").read())
    lines = ["\n".join(" ".join(words[k : k + 9]) for k in range(a, a + 90, 9)) for a in range(0, 1500, 90)]
    fresh.learn(lines)
    assert len(fresh.spaced) > 1000 and [fresh.encode(t) for t in lines] == [ids_of(sp, t) for t in lines]


def test_chunks_of_any_size_give_the_same(sp, codec):
    for k, t in enumerate(x for x in texts(200, 9) if x):
        n = (1, 2, 3, 7, 16, 33)[k % 6]
        s = SPACE + t.replace(" ", SPACE)
        args = [(s[max(0, b - 2 * codec.longest) : b], s[b : b + n], s[b + n : b + n + 1], b == 0) for b in range(0, len(s), n)]
        m = [transfer(codec, *a) for a in args]
        state = boundary_states(m)
        assert b"".join(traced(codec, a[0], a[1], state[i], state[i + 1]) for i, a in enumerate(args)) == ids_of(sp, t)
        if len(m) > 2:  # the product is associative
            left, right = compose(compose(m[0], m[1]), m[2]), compose(m[0], compose(m[1], m[2]))
            assert sorted(left) == sorted(right)


def test_encode_decode_tables(spark, sp):
    rows = [(i, t) for i, t in enumerate(texts(40, 10))] + [(90, None), (91, ""), (92, "word " * 300), (92, "word " * 300), (None, "x")]
    out = encode(docs(spark, rows), VOCABULARY, chunk=64, fan=3)
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in out.join(docs(spark, rows).select("doc_id", "text"), "doc_id").collect())
    got = sorted((str(r.doc_id), np.array(r.ids, np.int32).tobytes(), r.n_tokens) for r in out.collect())
    assert got == sorted((str(i), ids_of(sp, t or ""), len(sp.encode(t or ""))) for i, t in rows)
    back = {r.doc_id: r.text for r in decode(out, VOCABULARY).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)


# mixing


def test_mixing_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60)))) for i in range(900)] + [(900, None), (901, ""), (7, "same"), (7, "same"), (None, "x y z")]
    df = docs(spark, rows, lambda i: None if i is None or i % 9 == 8 else f"s{i % 4 if i % 3 else 0}")
    out = mix(df, fan=16)
    got = out.collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.source_size >= r.size
    assert all(r.source_size == sizes[r.source] for r in got)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate([*sorted(x for x in sizes if x is not None), None])}
    want, total, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            total -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 60
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(mix(df, fan=16).collect())  # reruns agree
    copies = mixed_documents(df, fan=16)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


def test_mixing_many_equal_rows(spark):
    """Equal rows, a third of all, are one item; each row gets the floor or the ceiling of its share."""
    rows = [(i, "w " * (i % 40 + 1)) for i in range(400)] + [(1000, "one same text of words")] * 300 + [(1001, "x y")] * 7
    df = docs(spark, rows, lambda i: "a" if i >= 1000 or i % 2 else "b")
    out = mix(df, fan=16).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all(r.copies <= 2 for r in out)
    got = Counter()
    for r in out:
        got[r.source] += r.taken
    target = {r.source: r.target for r in out}
    assert all(abs(got[s] - target[s]) <= 60 for s in target)
    same = Counter(r.copies for r in out if r.doc_id == 1000)
    assert max(same) - min(same) <= 1
    rate = next(r.target / r.source_size for r in out if r.doc_id == 1000)
    assert abs(sum(k * n for k, n in same.items()) - 300 * rate) < 1 + 1e-9
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in mix(df, fan=16).collect())


def test_word_count_and_empty(spark):
    t = spark.createDataFrame([(None,), ("",), (" \t\n",), ("a\x0bb\x0c c\xa0d ",)], "text string")
    assert [r[0] for r in t.select(word_count(t.text)).collect()] == [0, 0, 0, 3]
    assert mix(docs(spark, []).limit(0)).collect() == []


# WARC

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    big, rows = "<p>é</p>" * 40, []
    rows = [(5, "http://a/%0A?x=1\r\n", big), (3, "http://b", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "n", big), (3, "http://b", big), (8, "z", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "d") for r in rows], PAGES)
    files = write_warc(df, roll=2000)
    got = read_warc(files, split=97).collect()
    assert len(got) == len(rows) and files.agg({"records": "sum"}).first()[0] == len(rows)
    by = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
    n = len(big.encode())
    assert by == sorted([("5", "revisit", "3", n), ("3", "response", "None", n), ("9", "revisit", "3", n), ("None", "revisit", "3", n), ("3", "response", "None", n)] + [(str(i), "response", "None", s) for i, s in ((1, 5), (2, 5), (4, 0), (6, 0), (8, 300_000))])
    assert all(r.intact for r in got if r.record_type == "response") and all(r.intact for r in checked_revisits(read_warc(files, split=97)).collect()) and len({(r.path, r.place) for r in got}) == len(rows)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%0A?x=1\r\n"}
    folder = files.first().path.rsplit("/", 1)[0]
    assert read_warc(archives(spark, folder)).count() == len(rows)
    assert read_warc(write_warc(df.limit(0))).collect() == []


def test_ranges_own_each_record_once():
    raw = [record(i, "u", b"\x1f\x8b\x08" * 50 + bytes([i]), "0", 151, None) for i in range(20)]
    data = b"junk\x1f\x8b\x08junk" + b"".join(gzip.compress(r, mtime=0) for r in raw)
    for step in (1, 13, 100, 5000):
        f = io.BytesIO(data)
        seen = [(r, whole) for a in range(0, len(data), step) for _, r, whole in records_in(f, len(data), a, min(a + step, len(data)))]
        assert seen == [(r, True) for r in raw]


def test_damage_is_reported(spark, tmp_path):
    """A payload of another digest, a flipped byte and a cut file: the record is there and not intact, nor are its revisits."""
    big = [f"<p>{i} {'x' * 200}</p>".encode() for i in range(5)]
    sha = [hashlib.sha256(b).hexdigest() for b in big]
    members = [bytearray(gzip.compress(record(i, "u", big[i] if i != 1 else big[i].replace(b"x", b"y"), sha[i], len(big[i]), None), mtime=0)) for i in range(5)]
    members += [bytearray(gzip.compress(record(10 + i, "u", b"", sha[i], len(big[i]), i), mtime=0)) for i in range(5)]
    members[2][-6] ^= 1
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members[:5]) + b"".join(members[5:9]) + bytes(members[9])[:-20])
    files = spark.createDataFrame([("file://" + str(path), path.stat().st_size)], "path string, size long")
    got = {r.page_id: r for r in checked_revisits(read_warc(files, split=64)).collect()}
    assert {i: r.intact for i, r in got.items()} == {0: True, 1: False, 2: False, 3: True, 4: True, 10: True, 11: False, 12: False, 13: True, 14: False}
    assert got[0].payload_digest == sha[0] and got[1].payload_digest == hashlib.sha256(big[1].replace(b"x", b"y")).hexdigest() and got[2].payload_digest is None


# HTML


def test_html_layout():
    h = "<head><title>t</title></head><h1>A &amp; B</h1><p>one<p>two <b>x</b>  y<br>z<ul><li>a<li>b<ol start=3><li>c</ol></ul><table><caption>Cap<tr><th>N<th>Q<tr><td>apple<td>3</table><div hidden>no</div><i style='display:none'>no</i><pre>\n k\n  l</pre><script>no</script>end"
    assert text_of(h) == "A & B\n\none\n\ntwo x y\nz\n\n- a\n- b\n  3. c\n\nCap\nN      Q\napple  3\n\n k\n  l\n\nend"


def test_html_tables_and_formulas_lose_no_text():
    assert text_of("<table><tbody>note<tr><td>a<td>b</table>") == "note\na  b"
    assert text_of("<table><tbody><p>one</p><tr><td>a</tr><b>two</b> three</tbody></table>") == "one\ntwo\nthree\na"
    assert text_of("<table><tbody><form><tr><td>a<td>b</tr>of <i>form</i></form></table>") == "of\nform\na  b"
    assert text_of("<table><tr><td>x<table><tbody>in<tr><td>y</table></table>") == "x in y"
    assert text_of("<table><div hidden><tr><td>no</td></tr></div><tr><td>a</td><img alt=pic></table>") == "a\npic"
    assert text_of("<table>" + "<div>" * 20_000 + "<tr><td>deep") == "deep"
    assert text_of("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds") == "so x=2 holds"
    assert text_of("<svg><title>t</title><style/><defs/><path d='M0'/><text>A</text><text>B</text></svg>end") == "A Bend"


def test_html_numbers_spans_and_visibility():
    assert text_of(f"<table><tr><td colspan='{'9' * 5000}' rowspan=-1>x<ol start={'1' * 9000}><li>y") == "x 1000000000. y"
    assert text_of(f"&#{'1' * 5000};a&#x{'f' * 5000};b&#{'0' * 5000}65;&#00000066;&#x0000043;") == "\ufffda\ufffdbABC"
    assert text_of("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e<tr><td colspan=2>ff<td>g<tr><td rowspan=0>h<td>i<tr><td>j</table>") == "aa  b\n    c\nd   e\nff     g\nh   i\n    j"
    assert text_of("<div style='visibility:hidden'>no <b style='Visibility: visible'>yes</b> <img alt=no><input value=no>no</div>") == "yes"
    css = "<style>/* .ok{display:none} */ .ad, #x{display:none} p.q{visibility:hidden} @media print{.ok{display:none}} @media screen{.s{display:none}} .show{display:block!important} a b{display:none}</style>"
    assert text_of(css + "<p class='big ad'>no<p id=x>no<p class=q>no<p class=ok>ok<p class=s>no<p class='ad show'>shown<p class=ad style='display:block'>inline<a><b>kept") == "ok\n\nshown\n\ninlinekept"


def test_html_text_is_bounded():
    one = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "x" * 20_000 + "</table>"
    wide = "<table><tr>" + f"<td>{'y' * 60}" * 999 + "<tr><td colspan=999><td>x" * 4000 + "</table>"
    tall = "<table><tr><td colspan=1000 rowspan=1000>q" + "<tr><td>x" * 10_000 + "</table>"
    deep = "<table><tr><td>a<td>b" * 300
    for h in (one, wide, tall, deep):
        out = text_of(h)
        assert len(out) <= 2 * len(h) and Counter(out.replace(" ", "").replace("\n", "")) == Counter(re.sub("<[^>]*>", "", h))


def tokens_in_order(source):
    """All visible text by another parser: the standard library's, over generated pages whose tags are closed."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.gone, self.vis, self.out = 0, [True], []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img"):
                return
            a = dict(attrs)
            style = a.get("style") or ""
            self.gone += bool(self.gone or tag in ("script", "style", "template") or "hidden" in a or "display:none" in style)
            self.vis.append("visible" in style or (self.vis[-1] and "visibility:hidden" not in style))

        def handle_endtag(self, tag):
            self.gone -= bool(self.gone)
            self.vis.pop()

        def handle_data(self, data):
            if not self.gone and self.vis[-1]:
                self.out += data.split()

    p = P()
    p.feed(source)
    p.close()
    return p.out


def test_html_all_visible_text_against_another_parser():
    rng = random.Random(12)
    count = [0]

    def page(depth):
        count[0] += 1
        word = f"w{count[0]}"
        if depth == 0:
            return rng.choice((word, f"{word} &amp; x", f"{word}&lt;{word}"))
        inner = lambda: " ".join(page(depth - 1) for _ in range(rng.randint(1, 3)))
        style = rng.choice(("",) * 6 + (" hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'", " class=a"))
        tag = rng.choice("div section b i span h2 blockquote ul table pre script template".split())
        if tag == "ul":
            return f"<ul{style}>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + "</ul>"
        if tag == "table":
            return f"<table{style}>" + "".join("<tr>" + "".join(f"<td rowspan={rng.randint(1, 3)} colspan={rng.randint(1, 3)}>{inner()}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<{tag}{style}>{word if tag == 'script' else inner()}</{tag}>"

    for _ in range(300):
        h = " ".join(page(rng.randint(0, 4)) for _ in range(3))
        got = [t for t in text_of(h).split() if t != "-"]
        assert got == tokens_in_order(h), h


def test_html_never_fails(spark):
    rng = random.Random(5)
    parts = ["<div>", "</div>", "<p", ">", "<table>", "<tr>", "<td>", "</td>", "text", "<li>", "</ul>", "<!--", "-->", "&amp", "<a href='", '"', "<![CDATA[", "]]>", "<script>", "</script>", "<pre>", "\n", "<br/>", "<"]
    for _ in range(400):
        text_of("".join(rng.choice(parts) for _ in range(40)))
    assert text_of("<div>" * 20_000 + "deep") == "deep"
    assert text_of("<table><tr><td>" * 500 + "deep") == "deep"
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "b")]
    got = html_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("2", ""), ("3", "a"), ("3", "a"), ("None", "b")]


# toxicity


def toxic_rows(rng, n=600):
    clean = [f"{a}{b}" for a in "bcdfg" for b in ("alon", "eris", "otan", "ulme")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "scum", "vermin"])
        if rng.random() < (0.5 if bad else 0.05):
            words[rng.randrange(30)] = "women"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_toxicity_held_out_and_identity(spark):
    rows, labels = toxic_rows(random.Random(1))
    extra = [(10_000, "women meet here"), (10_001, "men meet here"), (10_002, "meet here"), (10_003, None), (10_004, ""), (None, "idiot scum")]
    df = docs(spark, rows + extra)
    lab = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 0), (0, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(df, lab).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i, _ in rows if by[i].held_out] == held
    right = sum(by[i].predicted == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.95
    assert abs(by[10_000].score - by[10_002].score) < 0.1 and abs(by[10_000].score - by[10_001].score) < 0.1
    assert by[10_003].score == by[10_004].score and all(0 <= r.score <= 1 for r in got) and by[None].predicted == 1
    kept = {r.doc_id for r in toxicity.toxic_filter(df, lab).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_identity_in_prose(spark):
    """Terms with punctuation, possessives, plurals and hyphens are mentions as well; toxic words keep their weight."""
    rng = random.Random(3)
    rows, labels = toxic_rows(rng)
    rows = [(i, t.replace("women", rng.choice(("women,", "women.", "(women)", "«women»", "Asian-American", "lesbians'")))) for i, t in rows]
    probes = ["meet here", "women, meet here", "women meet here", "women. meet here", "women's meet here", "Women! meet here", "asian-american meet here", "lesbians meet here", "“women” meet here"]
    df = docs(spark, rows + [(10_000 + k, t) for k, t in enumerate(probes)] + [(20_000, "scum! meet here"), (20_001, "you idiot, meet"), (20_002, "!!! -- …"), (20_003, "")])
    by = {r.doc_id: r.score for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert all(abs(by[10_000 + k] - by[10_000]) < 0.05 for k in range(len(probes))), [by[10_000 + k] for k in range(len(probes))]
    assert by[20_000] > 0.7 and by[20_001] > 0.7 and by[20_002] == by[20_003]


def brute_features(text):
    """Words and their prefixes by regular expressions."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    text = re.sub("[\u2010-\u203f¡«·»¿]", " ", text)
    inside = "[^\\x00-\\x20\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]"
    words = re.findall(f"(?:{inside}|(?<={inside})[*@$!#](?={inside}))+", text)
    return {(0, w) for w in words} | {(k, w.encode()[:k]) for w in words for k in (4, 6) if len(w.encode()) > k}


def test_toxicity_features_equal_brute_force(monkeypatch):
    rng = random.Random(9)
    parts = ["Sh!t", "f*ck", "don't", "a", "é", "«", "»", "—", "“x”", "...", "!", "#", " ", "  ", "\n", "longerword", "ééééé", "-", "1", "日本語テキスト", "ñandú¿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    group = toxicity._identity()
    key = toxicity.features(data, offsets, group)
    monkeypatch.setattr(toxicity, "_SLICE", 7)
    assert (toxicity.features(data, offsets, group) == key).all()
    by = np.split(key & 0xFFFFFF, np.searchsorted(key, np.arange(1, len(raw)) << 24))
    seen: dict = {}
    for t, feats in zip(texts, by, strict=True):
        want = brute_features(t)
        assert len(feats) == len(want), (t, want)  # a slot shared by chance would show here
        alone = toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), group)
        assert (alone == feats).all()
        for w in want:
            seen.setdefault(w, set(feats)).intersection_update(feats)
    assert all(seen.values())


def test_toxicity_fit_reaches_the_minimum():
    """The gradient steps against a brute-force minimum of the same loss on a few rows."""
    rows, y = [np.array(r) for r in ([0, 3], [3], [1, 4], [4], [0, 4], [3, 4])], np.array([1.0, 1, 0, 0, 1, 0])
    w, b = toxicity.fit(rows, y, 5, 2, ridge=0.05, swap=0.5, steps=4000, rate=0.01)

    def loss(x):
        total = 0.025 * float((x[:5] ** 2).sum())
        for r, t in zip(rows, y, strict=True):
            z = x[r].sum() + x[5]
            total += (math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z))) / 6
            for term in r[r < 2]:
                total += 0.5 / 6 * ((x[term] - x[1 - term]) ** 2 + x[term] ** 2)
        return total

    x, step = np.append(w, b), 1.0
    best = x.copy()
    while step > 1e-4:  # coordinate search from the found place and from zero
        for start in (best, np.zeros(6)):
            v = start.copy()
            moved = True
            while moved:
                moved = False
                for i in range(6):
                    for d in (step, -step):
                        t = v.copy()
                        t[i] += d
                        if loss(t) < loss(v) - 1e-12:
                            v, moved = t, True
            if loss(v) < loss(best):
                best = v
        step /= 4
    assert loss(x) <= loss(best) + 1e-3 and np.abs(x - best).max() < 0.1


def test_swap_penalty_flattens_identity_weights():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    rows = [np.array(([0] if (v and rng.random() < 0.8) else []) + ([3] if v and rng.random() < 0.9 else [4]), np.int64) for v in y]
    free, _ = toxicity.fit(rows, y, 5, 2, swap=0.0)
    bound, _ = toxicity.fit(rows, y, 5, 2, swap=5.0)
    assert abs(bound[0]) < 0.25 * abs(free[0])


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 and r.score < 0.01 for r in toxicity.toxicity(df, none).collect())
    assert toxicity.toxicity(df.limit(0), none).collect() == []


# stages


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows, labels = toxic_rows(random.Random(7), 240)
    long = " ".join(f"tok{i}" for i in range(80))
    rows += [(500, long), (501, long + " more"), (502, None), (503, ""), (None, "some text without an id"), (None, long + " end")]
    df = docs(spark, rows, lambda i: f"s{(i or 0) % 3}")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    d = df
    for stage in (stages.drop_toxic, stages.drop_recurring_lines, stages.drop_near_duplicates, stages.mix_sources):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == df.columns
        if stage is stages.drop_toxic:
            ids = {r.doc_id for r in d.collect()}
            assert sum(i % 4 == 0 for i in ids if i is not None and i < 240) <= 2
            assert {i for i, _ in rows if i is None or i % 4} <= ids | {500}
        if stage is stages.drop_near_duplicates:
            left = d.collect()
            ids = {r.doc_id for r in left}
            assert 501 not in ids and {500, 502, 503, None} <= ids
            assert [r.text for r in left if r.doc_id is None] == ["some text without an id"]
    out = stages.tokenize(spark, d, str(tmp_path))
    assert out.count() == d.count()
