"""Whole documents: requests, repository files and HTML pages to Markdown, prompts of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def validated(requests: DataFrame) -> DataFrame:
    """requests (query, top_k, …) with valid and error: a query must have text, top_k (5 where null) be 1 to 20."""
    k = F.coalesce("top_k", F.lit(5))
    error = F.when(F.length(F.coalesce("query", F.lit(""))) < 1, "query is empty").when(~k.between(1, 20), "top_k is not in 1..20")
    return requests.withColumn("top_k", k).withColumn("error", error).withColumn("valid", F.col("error").isNull())


def github_markdown(files: DataFrame) -> DataFrame:
    """files (doc_id, title, source_url, repo, commit, path, text, sha256, artifact_sha256) -> (doc_id, content_md, n_files).

    Files stand in the order of their paths, Markdown as it is and all else in fences, each with its lines and hash.
    """
    body = F.regexp_replace(T.newlines(F.col("text")), "\n+\\z", "")
    lines = F.greatest(F.lit(1), F.size(F.split(body, "\n")))
    lang = T.language(F.col("path"))
    other = F.col("artifact_sha256").isNotNull() & (F.col("artifact_sha256") != F.col("sha256"))
    part = F.concat(
        F.lit("## File: "), F.col("path"), F.lit("\n**Lines:** 1-"), lines.cast("string"), F.lit("\n**SHA256:** "), F.col("sha256"),
        F.when(other, F.concat(F.lit("\n**Artifact SHA256 (meta):** "), F.col("artifact_sha256"))).otherwise(""), F.lit("\n\n"),
        F.when(F.lower("path").endswith(".md"), body).otherwise(F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```"))),
    )
    field = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), F.col(c)))
    repo = F.when(F.col("repo").isNotNull(), F.concat(F.lit("**Repo:** "), F.col("repo"), F.coalesce(F.concat(F.lit("@"), F.col("commit")), F.lit(""))))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit("**Doc ID:** "), F.col("doc_id")), field("Source", "source_url"), repo)
    one = files.select("doc_id", head.alias("head"), F.struct("path", part.alias("part")).alias("f"))
    parts = F.transform(F.sort_array(F.collect_list("f")), lambda f: f["part"])
    return one.groupBy("doc_id").agg(F.concat_ws("\n\n", F.min("head"), F.array_join(parts, "\n\n")).alias("content_md"), F.count("*").alias("n_files"))


def richer(html_md: Column, snapshot_md: Column) -> Column:
    """html or md: the page's own Markdown unless it is thin beside the snapshot (under 200 or 80 % of its characters)."""
    size = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", ""))
    enough = size(html_md) >= F.greatest(F.lit(200), F.floor(size(snapshot_md) * 0.8))
    return F.when(size(html_md) == 0, "md").when((size(snapshot_md) == 0) | enough, "html").otherwise("md")


def evidence_prompt(packs: DataFrame, by: str = "request_id", place: str = "final_rank") -> DataFrame:
    """(request_id, prompt): the packs of a request as numbered blocks in the order of their places."""
    full = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    n = F.col(place).cast("string")
    block = F.concat(
        F.lit("["), n, F.lit("] ["), F.upper(F.coalesce("source_type", F.lit("internal"))), F.lit("] Source: "), F.coalesce(full("title"), F.lit("Unknown Source")), F.lit(" | Section: "), F.coalesce(full("section"), F.lit("—")),
        F.lit("\nURL: "), F.coalesce(full("url"), F.lit("N/A")), F.lit("\nchunk_id: "), F.col("chunk_id").cast("string"), F.lit("\n\n"), F.coalesce(full("parent_text"), F.coalesce("child_text", F.lit(""))),
    )
    blocks = F.transform(F.sort_array(F.collect_list(F.struct(place, block.alias("b")))), lambda x: x["b"])
    return packs.groupBy(by).agg(F.array_join(blocks, "\n\n---\n\n").alias("prompt"))
