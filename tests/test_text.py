"""Column functions against small literals."""

from pyspark.sql import functions as F

from corpusloom.functions import html, markdown
from corpusloom.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_terms_technical_first_and_distinct(spark):
    got = one(spark, T.terms, "FlashAttention-2 on H100 with FP8", "BAAI/bge-small-en-v1.5 achieves 384-dim", "3x speedup, 2bit", "**Bold** `code` [link](u) a", "", None)
    assert got[0] == ["flashattention-2", "h100", "fp8", "on", "with"]
    assert got[1] == ["bge-small-en-v1.5", "384-dim", "baai", "achieves"]
    assert got[2] == ["3x", "2bit", "speedup"]
    assert got[3] == ["bold", "code", "link"]
    assert got[4] == got[5] == []


def test_normalized(spark):
    got = one(spark, T.normalized, "exam-\n  ple  \r\n\r\n\r\n\r\nso­ft ﬁx ", "")
    assert got == ["example\n\nsoft fix", ""]
    assert markdown.plain_text("exam-\n  ple  \r\n\r\n\r\n\r\nso­ft ﬁx ") == got[0]


def test_slug_and_ids(spark):
    assert one(spark, T.slug, "Hello, World!", "***", "a" * 80) == ["hello-world", "doc", "a" * 60]
    assert one(spark, T.language, "a/b.PY", "x.cu", "Makefile") == ["python", "cpp", "text"]


def test_numbers_and_citations(spark):
    assert one(spark, T.numbers, "3x faster, 75% of 128 GB in 12ms") == [["3x", "75%", "128 GB", "12ms"]]
    assert one(spark, T.citation_ids, "a [2] b [1] c [2]") == [["2", "1"]]


def test_grounded(spark):
    df = spark.createDataFrame([("Paged attention reduces memory [1].", "paged attention helps memory"), ("Bananas grow tall [1].", "paged attention"), ("It is so", "x")], "c string, s string")
    assert [r[0] for r in df.select(T.grounded(F.col("c"), F.col("s"), F.lit(0.3))).collect()] == [True, False, True]


MD = """intro
# A
text a
## B
| x | y |
|---|---|
| 1 | 2 |

```py
# not a heading
```
para
# C
"""


def test_sections_and_blocks():
    s = markdown.sections(MD)
    assert [x["path"] for x in s] == ["Document", "A", "A > B", "C"]
    assert [k for k, _, _ in markdown.blocks(s[2]["body"])] == ["table", "code", "paragraph"]
    parents, children = markdown.chunk_document("d", MD)
    assert [p["section"] for p in parents] == ["Document", "A", "A > B"]
    known = {p["parent_id"]: p["section"] for p in parents}
    assert all(known[c["parent_id"]] == c["section"] for c in children)
    assert markdown.chunk_document("d", MD) == (parents, children)


def test_flat_h1_levels_from_numbers():
    md = "\n".join(f"# {h}\nx" for h in ("1 Intro", "2 Method", "2.1 Part", "Unnumbered", "2.2.1 Deep"))
    assert [h[2] for h in markdown.headings(md)] == [1, 1, 2, 2, 3]


def test_windows():
    text = " ".join(f"w{i}" for i in range(900))
    w = [text[a:b] for a, b in markdown.windows(text, 400, 50)]
    assert [markdown.count_tokens(x) for x in w] == [400, 400, 200]
    assert w[1].startswith("w350 ") and markdown.windows("a b", 400, 50) == [(0, 3)] and markdown.windows("", 400, 50) == []


def test_normalize_markdown_leaves_code():
    assert markdown.normalize_markdown("exam-\nple\n```\na-\nb\n```") == "example\n\n```\na-\nb\n```"


def test_html_markdown():
    h = '<nav>no</nav><main><h1>T</h1><p>a <b>b</b> <a href="u">l</a></p><ul><li>x<li>y</ul><pre><code class="language-py">z\n</code></pre><table><tr><th>h<tr><td>1|2</table></main><footer>no</footer>'
    assert html.html_markdown(h) == "# T\n\na **b** [l](u)\n\n- x\n- y\n\n```py\nz\n```\n\n| h |\n| --- |\n| 1\\|2 |"
    assert html.html_markdown("") == ""


def test_headings_and_numbers():
    got = markdown.headings('# Intro[#](#intro "Link to this heading")\n## [#](#x)\n# 2.1 Setup\n# GPU memory\n# A.1 More\n# 10B.C2 Odd\n# 3. Not a number\n')
    assert [(level, t) for _, _, level, t in got] == [(1, "Intro"), (2, "2.1 Setup"), (2, "GPU memory"), (2, "A.1 More"), (2, "10B.C2 Odd"), (2, "3. Not a number")]
    flat = markdown.headings("# Abstract\n# 2 A\n# 2.1 B\n# GPU memory\n# A.1.2 C\n# 3. D\n")
    assert [(level, t) for _, _, level, t in flat] == [(1, "Abstract"), (1, "2 A"), (2, "2.1 B"), (2, "GPU memory"), (3, "A.1.2 C"), (3, "3. D")]


def test_chunks_cover_their_document():
    """Spans are exact, blocks that are whole stay whole, and every character but headings and space is in a child."""
    import random

    rng = random.Random(11)
    parts = ["# One\n", "## Two [#](#t)\n", "### [¶](#x)\n", "plain words here.\n", "\n", "| a | b\n", "  | c |\n", "```py\n# no heading\n| no table |\n```\n", "~~~\nx\n```\n~~~\n", "more text\nand a line\n", "word " * 60 + "\n", "```\nopen fence\n"]
    for _ in range(300):
        doc = "".join(rng.choice(parts[:-1] if k < 11 else parts) for k in range(rng.randint(0, 12)))
        parents, children = markdown.chunk_document("d", doc, most=40, overlap=7, parent_most=100)
        covered = [False] * len(doc)
        for c in children:
            assert doc[c["char_start"] : c["char_end"]] == c["text"]
            covered[c["char_start"] : c["char_end"]] = [True] * len(c["text"])
            assert c["is_table"] or c["is_code"] or c["token_count"] <= 40
        for begin, end, _, _ in markdown.headings(doc):
            covered[begin:end] = [True] * (end - begin)
        left = "".join(x for x, ok in zip(doc, covered, strict=True) if not ok)
        assert not left.strip(), (doc, left)
        assert all(a["char_end"] <= b["char_start"] for a, b in zip(parents, parents[1:], strict=False))
        assert all(c["text"].startswith(("```", "~~~")) for c in children if c["is_code"])
        assert all(x.lstrip().startswith("|") for c in children if c["is_table"] for x in c["text"].split("\n"))


def test_html_of_any_depth_and_number():
    assert html.html_markdown("<span>" * 3000 + "deep") == "deep"
    assert html.html_markdown("<ul><li>" * 2000 + "deep").endswith("deep")
    assert html.html_markdown("<div>" * 5000 + "<b>x</b>") in ("x", "**x**")
    assert html.html_markdown(f"<p>a&#{'1' * 5000};b &#{'0' * 5000}65;</p>") == "a\ufffdb A"
    assert [html.code_language(html.parse(f'<code class="{c}">')) for c in ("hl Language_Rust", "lang-c++", "x bash", "python3", "sh")] == ["rust", "c++", "bash", "", ""]
