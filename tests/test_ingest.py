"""The ingest drivers, stores, stream upserts, collections, rerank cache and response mapping on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import rerank_cache, response, search, web
from corpusloom.plans import hybrid
from corpusloom.sources import collections, ingest, scan, store
from corpusloom.streaming import upsert

META = {"kind": "docs", "seed": {"title": "A page", "url": "http://a/b"}, "source": {"version": "v2"}}


def raw(spark, docs):
    rows = [(d, n, x.encode() if isinstance(x, str) else x) for d, files in docs.items() for n, x in files.items()]
    return spark.createDataFrame(rows, "doc_id string, name string, content binary")


DOCS = {
    "a": {"meta.json": json.dumps(META), "page.html": "<nav>no</nav><main><h1>H</h1><p>" + "words " * 60 + "</p><pre><code class='python'>x = 1</code></pre></main>"},
    "b": {"meta.json": json.dumps({"kind": "github", "source": {"repo": "o/r", "ref": "main"}}), "z.py": "print(1)\r\n", "a.md": "# T"},
    "c": {"page.html": "x"},
    "d": {"meta.json": "[]", "page.html": "x"},
    "e": {"meta.json": json.dumps({"kind": "arxiv", "seed": {"title": "Paper"}}), "paper.txt": "Running head\nAbstract\nOne two-\nthree.\fRunning head\n1 Start\nMore."},
    "f": {"meta.json": json.dumps({"kind": "paper"}), "other.pdf": b"\x00\x01"},
    "g": {"meta.json": json.dumps({"kind": "docs"}), "notes.txt": "nothing"},
    "h": {"meta.json": json.dumps({}), "readme.md": "read \xe9", "x.html": ""},
}


def test_process_all(spark):
    got = {r.doc_id: r for r in ingest.process_all(raw(spark, DOCS)).collect()}
    assert {d: (r.kind, r.ok, r.error) for d, r in got.items()} == {
        "a": ("docs", True, None), "b": ("github", True, None), "c": ("unknown", False, "missing meta.json"), "d": ("unknown", False, "meta.json is no JSON object"),
        "e": ("pdf", True, None), "f": ("pdf", False, "no text of pages"), "g": ("docs", False, "no html or markdown file"), "h": ("docs", True, None),
    }
    assert got["a"].content_md.startswith("# A page\n**Doc ID:** a\n**Source:** http://a/b\n**Version:** v2\n\n# H\n\nwords") and "```python\nx = 1\n```" in got["a"].content_md
    assert got["a"].content_chars == len(got["a"].content_md) and got["a"].method == "html"
    assert got["e"].content_md == "# Paper\n**Doc ID:** e\n\n## Abstract\n\nOne twothree.\n\n---\n\n## 1 Start\n\nMore."
    assert "## File: a.md" in got["b"].content_md and "print(1)" in got["b"].content_md and "**Repo:** o/r@main" in got["b"].content_md
    assert got["h"].content_md.endswith("read é") and got["h"].method == "md"
    files = raw(spark, DOCS)
    done = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert [r.doc_id for r in ingest.process_all(files, done, limit=2).orderBy("doc_id").collect()] == ["c", "d"]
    assert {r.doc_id for r in ingest.process_all(files, done, force=True, only="docs").collect()} == {"a", "g", "h"}
    assert ingest.process_all(files.limit(0)).collect() == []


def test_drivers_on_folders(spark, tmp_path, capsys):
    for d, files in DOCS.items():
        (tmp_path / "raw" / d).mkdir(parents=True)
        for n, x in files.items():
            (tmp_path / "raw" / d / n).write_bytes(x.encode() if isinstance(x, str) else x)
    at = [str(tmp_path / n) for n in ("raw", "processed", "chunks")]
    cli.main(["process", at[0], at[1], "--limit", "3", "--json"], spark)
    assert [json.loads(x)["doc_id"] for x in capsys.readouterr().out.splitlines()] == ["a", "b", "c"]
    cli.main(["process", at[0], at[1], "--json"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 8
    cli.main(["chunk", at[1], at[2], "--json"], spark)
    rows = {r["doc_id"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert set(rows) == {"a", "b", "e", "h"} and all(r["ok"] and r["child_count"] for r in rows.values())
    children = spark.read.parquet(at[2] + "/children")
    text = {r.doc_id: r.content_md for r in spark.read.parquet(at[1]).where("ok").collect()}
    assert all(text[r.doc_id][r.char_start : r.char_end] == r.text for r in children.collect())
    n = children.count()
    ingest.chunk(spark, at[1], at[2])
    assert spark.read.parquet(at[2] + "/children").count() == n  # nothing is chunked twice


def test_chunk_all_reports_errors(spark):
    docs = spark.createDataFrame([(1, "t", None, "# A\n\ntext"), (2, "t", None, None), (3, None, None, "x"), (4, "t", None, "  ")], "doc_id long, title string, source_url string, content_md string")
    got = {r.doc_id: (r.ok, r.error, r.parent_count, r.child_count) for r in ingest.chunk_all(docs)[2].collect()}
    assert got == {"1": (True, None, 1, 1), "2": (False, "missing content", 0, 0), "3": (False, "missing title", 0, 0), "4": (True, None, 0, 0)}


def test_parent_store(spark, tmp_path):
    lines = ['{"parent_id": "p", "doc_id": "d", "text": "old"}', "{broken", "", '{"doc_id": "d"}', '{"parent_id": "q", "doc_id": "e", "token_count": 3}', '{"parent_id": "p", "doc_id": "d", "text": "new", "section": "S"}']
    (tmp_path / "parents.jsonl").write_text("\n".join(lines))
    table = ingest.parent_store(spark, str(tmp_path / "parents.jsonl"))
    assert {r.parent_id: (r.text, r.section, r.token_count) for r in table.collect()} == {"p": ("new", "S", 0), "q": ("", "", 3)}
    assert [r.parent_id for r in ingest.parents_of(table, "d").collect()] == ["p"]


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = lambda xs: spark.createDataFrame(xs, "chunk_id string, content_sha string, n int").coalesce(1)
    assert upsert.merge_batch(rows([(f"c{i}", "1", 0) for i in range(200)]), root, 0) <= 64
    before = upsert.pointers(spark, root)
    assert upsert.merge_batch(rows([("c1", "2", 1), ("c1", "3", 2), ("new", "1", 3), ("c7", "1", 4)]), root, 1) <= 3
    after = upsert.pointers(spark, root)
    assert sum(before[b] != after[b] for b in before) <= 3
    got = {r.chunk_id: (r.content_sha, r.n) for r in upsert.read_index(spark, root).collect()}
    assert len(got) == 201 and got["c1"] == ("3", 2) and got["new"] == ("1", 3) and got["c7"] == ("1", 0)
    upsert.merge_batch(rows([("c1", "2", 1), ("c1", "3", 2), ("new", "1", 3), ("c7", "1", 4)]), root, 1)  # twice is once
    assert {r.chunk_id: (r.content_sha, r.n) for r in upsert.read_index(spark, root).collect()} == got
    assert upsert.merge_batch(rows([("k", "9", 5), ("k", "8", 6)]), root, 2, order=F.col("content_sha")) == 1
    assert upsert.read_index(spark, root).where("chunk_id = 'k'").first().content_sha == "9"
    assert upsert.merge_batch(rows([]), root, 3) == 0
    with pytest.raises(FileNotFoundError):
        upsert.read_index(spark, str(tmp_path / "none"))


def test_stream_of_upserts(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "index")
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")])):
        spark.createDataFrame(rows, "chunk_id string, content_sha string").write.mode("append").parquet(src)
        upsert.stream_upsert(spark.readStream.schema("chunk_id string, content_sha string").parquet(src), root, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in upsert.read_index(spark, root).select("chunk_id", "content_sha").collect()} == {("a", "1"), ("b", "2"), ("c", "1")}


def test_collections(spark, tmp_path):
    root = str(tmp_path / "col")
    assert collections.ensure(spark, root, 2) and not collections.ensure(spark, root, 2)
    with pytest.raises(ValueError, match="2 dimensions"):
        collections.ensure(spark, root, 3)
    points = spark.createDataFrame([("a", "1", [1.0, 2.0]), ("b", "1", [1.0]), ("c", "1", None)], "chunk_id string, content_sha string, embedding array<double>")
    assert collections.put(points, root) == (1, 2)
    assert collections.info(spark, root) == {"dim": 2, "distance": "cosine", "points": 1}
    assert set(collections.PAYLOAD) <= set(collections.points(spark, root).columns)
    assert collections.ensure(spark, root, 3, recreate=True) and collections.info(spark, root)["points"] == 0


PACKS = "query_id long, chunk_id long, final_rank int, child_text string, parent_text string"


def test_rerank_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, text string")
    packs = spark.createDataFrame([(1, 10, 1, "none", ""), (1, 11, 2, "alpha", ""), (1, 12, 3, "x", "alpha beta"), (2, 10, 1, "gamma", "")], PACKS)
    plain = {(r.query_id, r.chunk_id): (r.reranker_score, r.final_rank) for r in search.rerank(packs, q, 5).collect()}

    def run(p=packs):
        return {(r.query_id, r.chunk_id): (r.reranker_score, r.final_rank, r.from_cache) for r in rerank_cache.rerank(p, q, path).collect()}

    assert rerank_cache.stats(spark, path).first().lists == 0
    assert rerank_cache.warm(packs.where("query_id = 2"), q, path) == {"scored": 1, "cached": 0}
    assert run() == {k: (*v, k[0] == 2) for k, v in plain.items()}
    assert run() == {k: (*v, True) for k, v in plain.items()}
    assert not any(hit for *_, hit in run(packs.where("chunk_id <> 12 and query_id = 1")).values())  # another list
    assert rerank_cache.clear(spark, path) == 3 and not store.exists(spark, path)


def test_responses(spark):
    answers = spark.createDataFrame([(1, "Alpha holds [1]. Beta too [9].", "web", "weak", 2, ["w"], [("search", 5, "x" * 200, 3)]), (2, "Nothing.", None, None, None, None, None)],
                                    "request_id long, answer string, intent string, grade string, retries int, warnings array<string>, calls array<struct<tool:string,ms:int,input:string,n:int>>")
    packs = spark.createDataFrame([(1, 1, "c1", "d", "T", "S", None, "internal", "Alpha holds here", "", 0.0, 0.2), (1, 2, "c2", "d", None, None, "http://u", "web", "y", "", 0.7, 0.1)],
                                  "request_id long, final_rank int, chunk_id string, doc_id string, title string, section string, url string, source_type string, child_text string, parent_text string, reranker_score double, rrf_score double")
    got = {r.request_id: r for r in response.responses(answers, packs).collect()}
    r = got[1]
    assert [c.chunk_id for c in r.citations] == ["c1", "c2"] and [e.chunk_id for e in r.used_sources] == ["c1"] and [e.score for e in r.evidence] == [0.2, 0.7]
    assert [e.title for e in r.evidence] == ["T", "d"] and r.warnings == ["w", "citation_validator: unknown ids 9"]
    assert [(s.step, s.node, s.latency_ms) for s in r.trace] == [(1, "analyze_intent", 0), (2, "grade_context", 0), (3, "search", 5)] and len(r.trace[2].detail) == 6 + 120 + 4
    assert (r.self_check.passed, r.citation_validation.passed, r.citation_density) == (False, False, 1.0)
    assert got[2].citations == [] and got[2].evidence == [] and got[2].citation_density == 1.0 and got[2].warnings == [] and len(got[2].trace) == 2


def test_chunks_of_some_documents(spark, tmp_path):
    chunks = spark.createDataFrame([(f"d{i}", f"c{i}") for i in range(100)], "doc_id string, chunk_id string")
    scan.write_chunks(chunks, str(tmp_path / "c"))
    some = scan.written_chunks(spark, str(tmp_path / "c"), ["d3", "d77", "none"])
    assert {r.chunk_id for r in some.collect()} == {"c3", "c77"} and scan.written_chunks(spark, str(tmp_path / "c")).count() == 100
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString() and len(some.inputFiles()) > 0


def test_one_side_may_fail(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    fine = lambda q: spark.createDataFrame([(1, 5, 0.9, 1)], "query_id long, chunk_id long, score double, rank int")

    def broken(q):
        return q.select(F.raise_error(F.lit("down")).cast("long").alias("query_id"), F.lit(1).cast("long").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    hits, warnings = hybrid.retrieve_isolated(queries, broken, fine)
    assert [(r.chunk_id, r.in_dense, r.in_bm25) for r in hits.collect()] == [(5, False, True)] and len(warnings) == 1 and warnings[0].startswith("dense search failed")
    assert hybrid.retrieve_isolated(queries, fine, fine)[1] == []


def test_providers(spark):
    pages = spark.createDataFrame([("t2", "http://b", "s", 1.0), ("t1", "http://a", "s", 1.0), ("t3", "http://c", "s", 1.0)], "title string, url string, snippet string, score double")
    assert [(r.position, r.title) for r in web.provided("mock", pages, 2).orderBy("position").collect()] == [(1, "t1"), (2, "t2")]
    with pytest.raises(ValueError, match="unknown provider 'other'"):
        web.provided("other", pages)


def test_kept_tables(spark, tmp_path):
    src, built = str(tmp_path / "src"), []
    spark.range(3).write.parquet(src)

    def build(write):
        built.append(write("t", spark.read.parquet(src)).count())

    tables = [store.kept_tables(spark, src, "some", build)["t"].count() for _ in range(2)]
    spark.range(2).write.mode("append").parquet(src)  # another source gives other tables
    assert store.kept_tables(spark, src, "some", build)["t"].count() == 5 and tables == [3, 3] and built == [3, 5]
    assert store.drop_kept(spark) >= 2 and store.kept_tables(spark, src, "some", build)["t"].count() == 5 and built == [3, 5, 5]
