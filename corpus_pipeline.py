"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokenising, each stage written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import stages
from corpusloom.llm.common import forget, n_written, read, release, saved

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_recurring_lines),
    ("near_dedup", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("tokenize", stages.tokenize),
]

#: No SQL for the trained classifier and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; what earlier stages wrote is deleted as soon as the next is done."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        since = n_written()
        after = saved(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=after)
        if k:
            forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
