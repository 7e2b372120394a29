"""Web search over a provider table: sanitize, cache, allow-list, clean, limit, and what to add to the cache."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index, verify
from .search import ranked


def first_rows(fixture: DataFrame, n: int) -> DataFrame:
    """The mock provider: the first n rows of a fixture by url, numbered, whatever the query."""
    return ranked(fixture.orderBy("url").limit(n).withColumn("_all", F.lit(0)), None, F.asc("url"), by="_all", name="position").drop("_all")


#: Searches by provider name: (fixture or connection table, number of rows) -> (position, title, url, snippet, score).
PROVIDERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"mock": first_rows}


def provided(provider: str, table: DataFrame, n: int = 5) -> DataFrame:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[provider](table, n)


def cache_key(provider: str, query: Column) -> Column:
    return F.sha2(F.concat(F.lit(provider + "|"), F.lower(F.trim(query))), 256)


def search_web(requests: DataFrame, provided: DataFrame, cache: DataFrame, now: Column, provider: str = "mock", domains: tuple[str, ...] = (), most: int = 5, ttl_hours: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows). requests (request_id, query); provided (position, title, url, snippet, score): the provider's rows,
    whatever the query; cache (key, cached_at, title, url, snippet, score, position). Only requests that miss the cache are asked.
    """
    asked = requests.withColumn("clean", verify.sanitize_query(F.col("query"))).where("clean <> ''").withColumn("key", cache_key(provider, F.col("clean")))
    looked = index.cache_lookup(asked.select("request_id", "key"), cache, now, ttl_hours)
    cols = ["position", "title", "url", "snippet", "score"]
    hits = looked.where("hit").join(cache.select("key", "cached_at", *cols), ["key", "cached_at"]).select("request_id", *cols)
    fresh = provided.where(F.col("position") <= most).where(verify.allowed_domain(F.col("url"), list(domains)))
    fresh = fresh.withColumn("title", verify.clean_title(F.col("title"))).withColumn("snippet", verify.clean_snippet(F.col("snippet"))).where("snippet is not null")
    # the provider's rows are at most `most`, each miss gets all of them
    got = looked.where("not hit").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).join(fresh, F.col("n") == F.col("position")).select("request_id", "key", *cols)
    results = ranked(hits.unionByName(got.drop("key")), most, F.asc("position"), by="request_id", name="place").drop("place")
    return results, got.select("key", now.alias("cached_at"), *cols).distinct()


def purged(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The cache without some keys, or empty."""
    return cache.limit(0) if keys is None else cache.join(keys.select("key"), "key", "left_anti")
