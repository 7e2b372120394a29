"""Markdown as Arrow functions over tables: normalizing, pages of HTML, parents and children of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, markdown

_PARENT = "parent_id string, doc_id string, parent_idx int, section string, heading_level int, text string, token_count int, char_start int, char_end int"
_CHILD = "chunk_id string, parent_id string, doc_id string, section string, text string, token_count int, chunk_index int, parent_idx int, is_table boolean, is_code boolean, char_start int, char_end int"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def with_normalized(df: DataFrame, text: str) -> DataFrame:
    """df with the Markdown of a column normalized; null stays null. The other columns go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at = t.schema.get_field_index(text)
            yield t.set_column(at, t.schema.field(at), pa.array([x if x is None else markdown.normalize_markdown(x) for x in t.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def html_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, content_md)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            md = [markdown.normalize_markdown(html.html_markdown(x or "")) for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(md, pa.string())], ["page_id", "content_md"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, content_md string")


def _rows(docs: DataFrame, which: int, schema: str) -> DataFrame:
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):  # a document at a time
                rows = markdown.chunk_document(str(i), x or "")[which]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])

    return docs.select("doc_id", "content_md").mapInArrow(run, schema)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """documents (doc_id, content_md) -> children of the Markdown chunker."""
    return _rows(docs, 1, _CHILD)


def parent_rows(docs: DataFrame) -> DataFrame:
    """documents (doc_id, content_md) -> the sections that children belong to."""
    return _rows(docs, 0, _PARENT)


def header(title: Column, doc_id: Column, source_url: Column, version: Column) -> Column:
    """The lines that a document starts with: title, id, and source and version where there are any."""
    field = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), c))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("# "), title), F.concat(F.lit("**Doc ID:** "), doc_id), field("Source", source_url), field("Version", version)), F.lit("\n\n"))
