"""The answer loop over a batch of requests: gate, intent, retrieval, grading, decomposition, synthesis, checks.

Models are Column functions (classify, decompose, generate), so that a batch stays one plan; the defaults are
deterministic. A request leaves the loop when its evidence is strong or its retries are spent, after 3 passes at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import text as T
from ..operators import verify

NO_EVIDENCE = "I could not find relevant information to answer this question."


def classify(query: Column) -> Column:
    """The default intent: web for news and dates, hybrid for comparisons, else internal."""
    q = F.lower(query)
    return F.when(q.rlike("\\b(latest|today|news|release date)\\b"), "web").when(q.rlike("\\b(compare|versus|vs)\\b"), "hybrid").otherwise("internal")


def intent(answer: Column) -> Column:
    """What a classifier said, if it is one of the three; else internal."""
    a = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(a.isin("internal", "web", "hybrid"), a).otherwise("internal")


def decompose(query: Column) -> Column:
    """The default subqueries: the parts between conjunctions and question marks."""
    return F.split(query, "(?i)\\?\\s*|;\\s*|\\s+and\\s+")


def subqueries(parts: Column, query: Column) -> Column:
    """Trimmed parts without blanks; the query itself where none is left."""
    kept = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) == 0, F.array(query)).otherwise(kept)


def generate(query: Column, texts: Column) -> Column:
    """The default answer: the first sentence of each piece of evidence with its marker."""
    first = F.transform(texts, lambda x, i: F.concat(F.element_at(T.sentences(x), 1), F.lit(" ["), (i + 1).cast("string"), F.lit("].")))
    return F.concat_ws(" ", first)


@dataclass(frozen=True)
class Models:
    classify: Callable[[Column], Column] = classify
    decompose: Callable[[Column], Column] = decompose
    generate: Callable[[Column, Column], Column] = generate


def grade(requests: DataFrame, packs: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(request_id, n, best, grade): empty, weak (few packs or a low best score) or strong; a score of 0 counts as none."""
    one = F.coalesce(F.nullif("reranker_score", F.lit(0.0)), F.nullif("rrf_score", F.lit(0.0)), F.lit(0.0))
    found = packs.groupBy("request_id").agg(F.count("*").alias("n"), F.max(one).alias("best"))
    out = requests.select("request_id").join(found, "request_id", "left").na.fill({"n": 0, "best": 0.0})
    g = F.when(F.col("n") == 0, "empty").when((F.col("n") < config.weak_count) | (F.col("best") < config.weak_score), "weak").otherwise("strong")
    return out.withColumn("grade", g)


def next_step(grade_: Column, retries: Column, use_web: Column, most: int = DEFAULTS.max_retries) -> Column:
    return F.when(grade_ == "strong", "synthesize").when(retries < most, "decompose").when(use_web, "web").otherwise("synthesize")


def new_packs(packs: DataFrame, seen: DataFrame) -> DataFrame:
    """Packs whose chunk the request does not have yet, one row for each chunk."""
    return packs.join(seen.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti").dropDuplicates(["request_id", "chunk_id"])


def answer(requests: DataFrame, search: Callable[[DataFrame], DataFrame], web: Callable[[DataFrame], DataFrame] | None = None, models: Models = Models(), config: EngineConfig = DEFAULTS) -> DataFrame:
    """requests (request_id, query, use_web) -> one answer each, with citations, validation and self-check.

    search: (request_id, query) -> packs (request_id, chunk_id, doc_id, title, section, url, child_text, parent_text,
    rrf_score, reranker_score, source_type). Between passes the evidence goes through checkpoint(), which cuts lineage.
    """
    gated = requests.withColumn("check", verify.gate(F.col("query"))).withColumn("intent", intent(models.classify(F.col("query"))))
    blocked = gated.where("check <> 'ok'")
    active = gated.where("check = 'ok'").withColumn("asked", F.array("query")).withColumn("retries", F.lit(0))
    evidence = None
    for _ in range(config.max_retries + 1):
        todo = active.where("intent <> 'web'").select("request_id", F.explode("asked").alias("query"))
        got = search(todo)
        evidence = got.dropDuplicates(["request_id", "chunk_id"]) if evidence is None else evidence.unionByName(new_packs(got, evidence))
        evidence = evidence.checkpoint()
        graded = active.join(grade(active, evidence, config), "request_id")
        step = next_step(F.col("grade"), F.col("retries"), F.coalesce("use_web", F.lit(False)), config.max_retries)
        active = graded.withColumn("step", step).where("step = 'decompose' and intent <> 'web'").drop("n", "best", "grade", "step")
        active = active.withColumn("asked", subqueries(models.decompose(F.col("query")), F.col("query"))).withColumn("retries", F.col("retries") + 1).checkpoint()
        if not active.limit(1).count():
            break
    allowed = gated.where("check = 'ok'")
    if web is not None:
        final = allowed.join(grade(allowed, evidence, config), "request_id")
        asked = final.where("intent <> 'internal' or (use_web and grade <> 'strong')").select("request_id", "query")
        evidence = evidence.unionByName(new_packs(web(asked), evidence), allowMissingColumns=True)
    return synthesized(allowed, blocked, evidence, models, config)


def synthesized(allowed: DataFrame, blocked: DataFrame, evidence: DataFrame, models: Models, config: EngineConfig) -> DataFrame:
    from ..operators.search import ranked

    placed = ranked(evidence, config.keep_k, F.desc("reranker_score"), F.desc("rrf_score"), F.asc("chunk_id"), by="request_id", name="final_rank")
    cites = verify.citations(placed)
    text = F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("child_text"))
    texts = cites.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("final_rank", text.alias("t")))), lambda x: x["t"]).alias("texts"), F.sort_array(F.collect_list("footnote_label")).alias("sources"))
    graded = allowed.join(grade(allowed, evidence, config), "request_id").join(texts, "request_id", "left")
    drafts = graded.withColumn("answer", F.when(F.col("texts").isNull(), NO_EVIDENCE).otherwise(models.generate(F.col("query"), F.col("texts"))))
    drafts = drafts.withColumn("warnings", F.when(F.col("grade") != "strong", F.array(F.concat(F.lit("evidence is "), F.col("grade")))).otherwise(F.array().cast("array<string>")))
    sources = cites.select("request_id", "citation_id", text.alias("source"), "source_type")
    checked = verify.self_check(drafts.select("request_id", "answer"), sources)
    valid = verify.validate(drafts.select("request_id", "answer"), cites, config.min_density)
    done = drafts.drop("answer").join(checked, "request_id").join(valid.select("request_id", F.col("passed").alias("citations_valid"), "density"), "request_id")
    done = done.select("request_id", "check", "intent", "grade", "answer", "sources", "warnings", F.col("passed").alias("self_check_passed"), "coverage", "citations_valid", "density")
    refused = blocked.select("request_id", "check", "intent", F.concat(F.lit("The request was not processed: "), F.col("check")).alias("answer"))
    return done.unionByName(refused, allowMissingColumns=True)
