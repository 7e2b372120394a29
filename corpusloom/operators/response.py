"""Answers as the service returns them: citations, evidence, used sources, validation, trace and warnings in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from . import verify


def _gathered(df: DataFrame, name: str, order: str, *fields: Column) -> DataFrame:
    """One row for each request: its rows as an array of structs in their order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("row"))))
    return df.groupBy("request_id").agg(F.transform(rows, lambda x: x["row"]).alias(name))


def trace(intent: Column, grade: Column, retries: Column, calls: Column) -> Column:
    """Steps (step, node, status, latency_ms, detail): the two that every request takes, then its tool calls (tool, ms, input, n)."""
    step = lambda n, node, ms, detail: F.struct(n.cast("int").alias("step"), node.alias("node"), F.lit("ok").alias("status"), ms.cast("long").alias("latency_ms"), detail.alias("detail"))
    first = step(F.lit(1), F.lit("analyze_intent"), F.lit(0), F.concat(F.lit("intent="), F.coalesce(intent, F.lit("?"))))
    second = step(F.lit(2), F.lit("grade_context"), F.lit(0), F.concat(F.lit("grade="), F.coalesce(grade, F.lit("?")), F.lit(" retries="), F.coalesce(retries, F.lit(0)).cast("string")))
    tools = F.transform(calls, lambda c, i: step(i + 3, c["tool"], F.coalesce(c["ms"], F.lit(0)), F.concat(F.lit("input="), F.left(F.coalesce(c["input"], F.lit("")), F.lit(120)), F.lit(" n="), F.coalesce(c["n"], F.lit(0)).cast("string"))))
    return F.concat(F.array(first, second), F.coalesce(tools, F.slice(F.array(first), 1, 0)))


def responses(answers: DataFrame, packs: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """answers (request_id, answer, intent, grade, retries, warnings, calls) and packs (request_id, final_rank, chunk_id, doc_id,
    title, section, url, source_type, child_text, parent_text, reranker_score, rrf_score) -> a row for each answer.

    An invalid use of citations adds a warning for each of its kinds. A request without packs has empty lists and density 1.
    """
    cites = verify.citations(packs)
    text = F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("child_text"))
    score = F.coalesce(F.nullif("reranker_score", F.lit(0.0)), F.col("rrf_score"), F.lit(0.0))
    evidence = [F.col("chunk_id").cast("string").alias("chunk_id"), "doc_id", F.coalesce("title", F.col("doc_id").cast("string"), F.lit("Unknown")).alias("title"), "source_type", "url", "section", F.col("child_text").alias("text"), score.alias("score")]
    label = [F.col("citation_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("footnote_label").alias("label"), F.col("url")]
    used = verify.used_citations(cites, answers)
    sources = cites.select("request_id", "citation_id", text.alias("source"), "source_type")
    checked = verify.self_check(answers.select("request_id", "answer"), sources)
    checked = checked.select("request_id", F.struct("passed", "checks_run", "checks_passed", "checks_failed", "uncited_sentences", "numeric_failures", "coverage").alias("self_check"), F.col("answer").alias("answer_markdown"))
    valid = verify.validate(answers.select("request_id", "answer"), cites, config.min_density)
    out = answers.drop("answer").join(checked, "request_id").join(valid, "request_id")
    for part in (_gathered(cites, "citations", "final_rank", *label), _gathered(cites, "evidence", "final_rank", *evidence), _gathered(used, "used_sources", "final_rank", *evidence)):
        out = out.join(part, "request_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    orphans = F.when(F.size("orphans") > 0, F.concat(F.lit("citation_validator: unknown ids "), F.array_join("orphans", ",")))
    sparse = F.when(~F.col("density_ok") & (F.col("total") > 0), F.concat(F.lit("citation_validator: density "), F.col("density").cast("string")))
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(F.col("passed"), F.array().cast("array<string>")).otherwise(F.filter(F.array(orphans, sparse), lambda x: x.isNotNull())))
    return out.select(
        "request_id", "answer_markdown", none("citations").alias("citations"), none("used_sources").alias("used_sources"), none("evidence").alias("evidence"),
        F.struct("passed", "total", "valid", "orphans", "unused", "density_ok").alias("citation_validation"), F.col("density").alias("citation_density"),
        trace(F.col("intent"), F.col("grade"), F.col("retries"), F.col("calls")).alias("trace"), warnings.alias("warnings"), "self_check",
    )
