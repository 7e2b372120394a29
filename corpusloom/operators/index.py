"""The inverted index as tables, its statistics, and hash-based maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokenized(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(chunk_id, subs): the sub-tokens of a document's distinct tokens, in index order; the one pass over the texts."""
    return docs.select(F.col(id_col).alias("chunk_id"), T.sub_tokens(T.terms(F.col("text") if text is None else text)).alias("subs"))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(chunk_id, pos, term): the sub-tokens of a document's distinct tokens, in index order."""
    return occurrences_of(tokenized(docs, id_col, text))


def occurrences_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_id", F.posexplode("subs").alias("pos", "term"))


def postings_of(tokens: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, positions) of tokenized documents, in one shuffle: by ranges of term and chunk, so that a term
    of all documents is spread over many tasks, and sorted, so that a search for a term reads little."""
    grouped = occurrences_of(tokens).repartitionByRange("term", "chunk_id").groupBy("term", "chunk_id")
    return grouped.agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).sortWithinPartitions("term", "chunk_id")


def write_index(docs: DataFrame, write: Callable[[str, DataFrame], DataFrame], id_col: str = "doc_id") -> None:
    """The tables tokens, postings and lengths through write(name, table); the texts are read once."""
    write_postings(write("tokens", tokenized(docs, id_col)), write)


def write_postings(tokens: DataFrame, write: Callable[[str, DataFrame], DataFrame]) -> None:
    """The tables postings and lengths of tokenized documents."""
    write("postings", postings_of(tokens))
    write("lengths", lengths_of(tokens))


def postings(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(term, chunk_id, tf, positions); write it sorted by term before searching it many times."""
    return postings_of(tokenized(docs, id_col, text))


def lengths_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_id", F.size("subs").cast("long").alias("dl"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    return lengths_of(tokenized(docs, id_col, text))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))


def last_rows(new: DataFrame, key: str = "chunk_id", order: Column | None = None) -> DataFrame:
    """Of rows with equal keys the one with the greatest `order`; by default the last one as the rows are read."""
    at = F.monotonically_increasing_id() if order is None else order
    numbered = new.withColumn("_at", at)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))
    return numbered.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_at")


def upsert_status(new: DataFrame, old: DataFrame, key: str = "chunk_id", sha: str = "content_sha", order: Column | None = None) -> DataFrame:
    """new with status inserted, updated or skipped against the hashes of old; of rows with equal keys the last one counts."""
    once = last_rows(new, key, order)
    known = old.select(F.col(key).alias("_key"), F.col(sha).alias("_sha"))
    status = F.when(F.col("_key").isNull(), "inserted").when(F.col("_sha") == F.col(sha), "skipped").otherwise("updated")
    return once.join(known, once[key] == F.col("_key"), "left").withColumn("status", status).drop("_key", "_sha")


def merged(new: DataFrame, old: DataFrame, key: str = "chunk_id", sha: str = "content_sha") -> DataFrame:
    """The table after the upsert: changed and new rows from new, all others from old."""
    changed = upsert_status(new, old, key, sha).where("status <> 'skipped'").drop("status")
    return old.join(changed.select(key), key, "left_anti").unionByName(changed)


def upsert_counts(status: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(one("inserted"), one("updated"), one("skipped"), F.count("*").alias("total"))


def stale(index: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the index whose chunk no longer exists."""
    return index.join(current.select(key), key, "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float, key: str = "key", at: str = "cached_at") -> DataFrame:
    """requests with hit: the newest entry of the key is younger than the time to live."""
    newest = cache.groupBy(key).agg(F.max(at).alias("cached_at"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp"))) / 3.6e9
    return requests.join(newest, key, "left").withColumn("hit", F.coalesce(age < ttl_hours, F.lit(False)))
