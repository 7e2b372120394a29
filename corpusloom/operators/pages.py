"""Page text to Markdown: repeated header and footer lines out, headings marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text with form feeds) -> (doc_id, page_no, text); blank pages go."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page_no", "text")).where(F.trim(F.regexp_replace("text", "\\s", "")) != "")


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", F.posexplode(F.split(T.newlines(F.col("text")), "\n")).alias("line_no", "line")).withColumn("s", F.regexp_replace("line", "(?U)^\\s+|\\s+\\z", ""))


def repeated_lines(pages: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """(doc_id, s, n): short lines on many pages of a document. A document of one page has none."""
    alnum = F.length(F.regexp_replace("s", "[^\\p{L}\\p{N}]", ""))
    line = page_lines(pages).where((F.length("s") >= 1) & (F.length("s") <= 80)).where(alnum >= F.greatest(F.lit(6), F.floor(F.length("s") * 0.4)))
    n_pages = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages")).where("pages > 1")
    seen = line.groupBy("doc_id", "s").agg(F.count_distinct("page_no").alias("n"))
    return seen.join(n_pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "s", "n")


def without_repeated(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """pages with the repeated lines gone and the number of lines removed."""
    lines = page_lines(pages).join(repeated_lines(pages, share).withColumn("gone", F.lit(True)), ["doc_id", "s"], "left")
    kept = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("line_no", "line", "gone"))), lambda x: x["gone"].isNull()), lambda x: x["line"])
    out = lines.groupBy("doc_id", "page_no").agg(F.array_join(kept, "\n").alias("text"), F.count("gone").alias("removed"))
    return out.withColumn("text", F.regexp_replace("text", "^\n+|\n+\\z", ""))


def pages_markdown(pages: DataFrame, breaks: bool = True) -> DataFrame:
    """(doc_id, content_md): headings as #, pages divided by ---."""
    s = lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+\\z", "")
    line = lambda x: F.when(T.heading_line(s(x)), F.concat(F.lit("\n"), F.repeat(F.lit("#"), T.heading_level(s(x))), F.lit(" "), s(x), F.lit("\n"))).otherwise(s(x))
    md = pages.select("doc_id", "page_no", F.array_join(F.transform(F.split(T.newlines(F.col("text")), "\n"), line), "\n").alias("md"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "md"))), lambda x: x["md"]), "\n\n---\n\n" if breaks else "\n")
    return md.groupBy("doc_id").agg(joined.alias("content_md"))
