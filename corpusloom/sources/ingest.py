"""The drivers of the ingest side over a table of raw files: documents to Markdown, Markdown to parents and children.

Every document gives a row, with ok and an error where it could not be done; one bad document stops no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, markdown_docs, pages
from . import scan
from .store import exists

_META = "meta.json"


def _files(raw: DataFrame) -> DataFrame:
    return raw.select("doc_id", "name", F.lower("name").alias("low"), F.regexp_replace(scan.decoded(F.col("content")), "\r\n?", "\n").alias("text"), F.sha2("content", 256).alias("sha256"))


def described(raw: DataFrame) -> DataFrame:
    """raw (doc_id, name, content) -> (doc_id, kind, title, source_url, version, repo, commit, error) from the metadata."""
    meta = F.max(F.when(F.col("name") == _META, F.col("text"))).alias("meta")
    one = _files(raw).groupBy("doc_id").agg(meta, F.collect_set(F.when(F.col("name") != _META, F.col("name"))).alias("names"))
    good = F.try_parse_json("meta").isNotNull() & F.startswith(F.ltrim("meta"), F.lit("{"))
    error = F.when(F.col("meta").isNull(), "missing meta.json").when(~F.coalesce(good, F.lit(False)), "meta.json is no JSON object")
    pick = lambda *p: T.pick(F.col("meta"), *p)
    kind = F.when(error.isNotNull(), "unknown").otherwise(scan.kind(F.get_json_object("meta", "$.kind"), F.col("names")))
    return one.select(
        "doc_id", kind.alias("kind"), F.coalesce(pick("$.seed.title", "$.title"), F.col("doc_id")).alias("title"), pick("$.source.pdf_url", "$.source.resolved_url", "$.source.url", "$.seed.url").alias("source_url"),
        pick("$.source.version", "$.seed.version").alias("version"), pick("$.source.repo").alias("repo"), pick("$.source.resolved_commit", "$.source.ref").alias("commit"), error.alias("error"),
    )


def _one(files: DataFrame, preferred: list[str], suffix: str, last: str | None = None) -> DataFrame:
    """(doc_id, text) of the file chosen for each document; the name `last` only where there is no other."""
    name = scan.chosen_file(files if last is None else files.where(F.col("low") != last), preferred, suffix)
    if last is not None:
        rest = files.join(name.select("doc_id"), "doc_id", "left_anti").where(F.col("low") == last)
        name = name.unionByName(rest.groupBy("doc_id").agg(F.min("name").alias("name")))
    return files.join(name, ["doc_id", "name"]).select("doc_id", "text")


def html_documents(files: DataFrame) -> DataFrame:
    """(doc_id, body, method) of pages: their own Markdown, or the snapshot's where that is richer."""
    page = _one(files, ["page.html"], ".html").withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    own = markdown_docs.html_rows(page).withColumnsRenamed({"page_id": "doc_id", "content_md": "own"})
    snap = markdown_docs.with_normalized(_one(files, ["page.md"], ".md", "readme.md"), "text").withColumnRenamed("text", "snap")
    both = own.join(snap, "doc_id", "full_outer").withColumn("method", documents.richer(F.col("own"), F.col("snap")))
    return both.select("doc_id", F.when(F.col("method") == "html", F.col("own")).otherwise(F.coalesce("snap", F.lit(""))).alias("body"), "method")


def page_documents(files: DataFrame, share: float = 0.6, breaks: bool = True) -> DataFrame:
    """(doc_id, body, pages, removed) of text with form feeds between pages: repeated lines out, headings marked."""
    split = pages.split_pages(_one(files, ["page.txt", "paper.txt"], ".txt"))
    clean = pages.without_repeated(split, share)
    count = clean.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("removed").alias("removed"))
    return pages.pages_markdown(clean, breaks).withColumnRenamed("content_md", "body").join(count, "doc_id")


def process_all(raw: DataFrame, done: DataFrame | None = None, force: bool = False, only: str | None = None, limit: int = 0) -> DataFrame:
    """raw (doc_id, name, content) -> doc_id, kind, ok, error, title, source_url, version, method, content_md, content_chars, non_ws_chars.

    Documents of `done` (doc_id) are left out unless forced; only: one kind; limit: the first so many by doc_id (0: all).
    """
    spark = raw.sparkSession
    about = described(raw)
    about = scan.todo(about, about.limit(0) if done is None else done, force, only, limit)
    files = _files(raw).where(F.col("name") != _META).join(about.where("error is null").select("doc_id", "kind"), "doc_id")
    of = lambda k: files.where(F.col("kind") == k)
    docs = html_documents(of("docs"))
    pdfs = page_documents(of("pdf")).withColumn("method", F.lit("pages")).select("doc_id", "body", "method")
    code = of("github").join(about.select("doc_id", "title", "source_url", "repo", "commit"), "doc_id").withColumn("path", F.col("name")).withColumn("artifact_sha256", F.lit(None).cast("string"))
    code = documents.github_markdown(code).select("doc_id", F.col("content_md").alias("body"), F.lit("files").alias("method"))
    bodies = docs.unionByName(pdfs).unionByName(code)
    out = about.join(bodies, "doc_id", "left")
    head = markdown_docs.header(F.col("title"), F.col("doc_id"), F.col("source_url"), F.col("version"))
    content = F.when(F.col("kind") == "github", F.col("body")).otherwise(F.concat(head, F.col("body")))
    missing = F.when(F.col("kind") == "pdf", "no text of pages").when(F.col("kind") == "docs", "no html or markdown file").otherwise("no files")
    out = out.withColumn("error", F.coalesce("error", F.when(F.col("body").isNull(), missing)))
    out = out.withColumn("content_md", content).withColumn("non_ws_chars", F.length(F.regexp_replace("body", "(?U)\\s+", "")))
    out = markdown_docs.with_normalized(out.select("doc_id", "kind", "error", "title", "source_url", "version", "method", "content_md", "non_ws_chars"), "content_md")
    return out.withColumn("ok", F.col("error").isNull()).withColumn("content_chars", F.length("content_md"))


def process(spark: SparkSession, root: str, out: str, **options) -> DataFrame:
    """All documents below a folder of raw files into a table, with processed_at; what is there already is left unless forced."""
    done = spark.read.parquet(out).where("ok").select("doc_id") if exists(spark, out) else None
    rows = process_all(scan.raw_files(spark, root), done, **options).withColumn("processed_at", F.current_timestamp())
    rows.write.mode("append").parquet(out)
    newest = F.max_by(F.struct(*rows.columns), "processed_at").alias("r")
    return spark.read.parquet(out).groupBy("doc_id").agg(newest).select("r.*")


def _chunk_error(content: Column, title: Column) -> Column:
    return F.when(content.isNull(), "missing content").when(title.isNull(), "missing title")


def chunk_all(processed: DataFrame, done: DataFrame | None = None, force: bool = False, limit: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """processed (doc_id, title, source_url, content_md) -> (parents, children, summary).

    summary: doc_id, ok, error, parent_count, child_count, content_chars for every document that was looked at.
    """
    rows = processed.withColumn("error", _chunk_error(F.col("content_md"), F.col("title")))
    rows = scan.todo(rows, rows.limit(0) if done is None else done, force, None, limit)
    good = rows.where("error is null").select("doc_id", "content_md")
    about = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "title", F.col("source_url").alias("url"))
    parents = markdown_docs.parent_rows(good).join(about, "doc_id")
    children = markdown_docs.chunk_rows(good).join(about, "doc_id")
    count = children.groupBy("doc_id").agg(F.count_distinct("parent_id").alias("parent_count"), F.count("*").alias("child_count"))
    summary = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("error").isNull().alias("ok"), "error", F.length("content_md").alias("content_chars")).join(count, "doc_id", "left")
    return parents, children, summary.na.fill(0, ["parent_count", "child_count"])


def chunk(spark: SparkSession, processed: str, out: str, force: bool = False, limit: int = 0) -> DataFrame:
    """Parents, children and a summary of the table `processed`, below a folder; documents chunked before are left unless forced."""
    at = f"{out}/summary"
    done = spark.read.parquet(at).where("ok").select("doc_id") if exists(spark, at) else None
    tables = dict(zip(("parents", "children", "summary"), chunk_all(spark.read.parquet(processed).where("ok"), done, force, limit), strict=True))
    mode = "overwrite" if force else "append"
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{out}/{name}")
    return spark.read.parquet(at)


def parent_store(spark: SparkSession, path: str) -> DataFrame:
    """(parent_id, doc_id, section, text, token_count) of JSON lines; malformed lines and lines without an id are left out,
    missing fields are empty or 0, and of lines with the same parent_id the last one of the file counts."""
    fields = "parent_id string, doc_id string, section string, text string, token_count int, _bad string"
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    rows = lines.select("at", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r._bad is null and r.parent_id <> ''")
    last = rows.groupBy("r.parent_id").agg(F.max_by("r", "at").alias("r")).select("r.*").drop("_bad")
    return last.na.fill("", ["doc_id", "section", "text"]).na.fill(0, ["token_count"])


def parents_of(store: DataFrame, doc_id: str) -> DataFrame:
    return store.where(F.col("doc_id") == doc_id)
