"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and, but for the last, returns the columns of docs.

A row is known by its doc_id and a hash of doc_id and text: rows equal in both are equal rows and share every decision.
Empty tables give empty tables; null texts and ids, repeated rows, long texts and clashing column names are handled as the
operator of the stage says; columns other than text and n_chars come back as they were.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IDENTITY, identity, read, row_key
from .linededup import line_decided
from .minhash import near_groups
from .mixing import mixed_documents
from .pieces import encode
from .toxicity import toxic_filter

VOCABULARY = os.environ.get("CORPUSLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic."""
    return toxic_filter(docs, read(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines; a document that had text and loses all its lines goes. Other columns stay, n_chars follows."""
    out = line_decided(docs).where("n_dropped = 0 or n_dropped < n_lines")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c])
        return F.col("row")[c]

    return out.select(*[column(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id; of equal rows one stays.

    Rows with a null doc_id go if a row of their group has one.
    """
    drop = near_groups(docs).where("not kept").select(*identity(F.col("key"), F.col("doc_id"))).distinct()
    once = docs.select(*identity(row_key(), F.col("doc_id").cast("long")), F.struct(*docs.columns).alias("row")).dropDuplicates(IDENTITY)
    return once.join(drop, IDENTITY, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and digest, and whether they decode to the text, a row for each copy that the mix takes."""
    return encode(docs, VOCABULARY)
