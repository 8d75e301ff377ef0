"""Crawl frontier: insertion, eligibility, status, rounds.

A round is a DataFrame; the loop over rounds is bounded by depth, page cap and
attempts, and each round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls

SCHEMA = "source_id bigint, url string, normalized_url string, depth int, status string, error_message string, attempts int"
#: Errors after which a page is skipped, not failed (fixed values).
SKIPPABLE = ["too small", "missing code snippets", "404", "410"]
RATE_LIMITED = ["rate limit", "403", "429", "abuse detection", "secondary rate", "too many requests"]


def insert_new(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """Frontier with the found (source_id, url, depth) whose normal form it lacks; of equal ones the shallowest."""
    f = found.withColumn("normalized_url", urls.normalize(F.col("url"))).filter("normalized_url is not null")
    f = f.groupBy("source_id", "normalized_url").agg(F.min(F.struct("depth", "url")).alias("m"))
    f = f.join(frontier.select("source_id", "normalized_url"), ["source_id", "normalized_url"], "left_anti")
    fresh = f.select("source_id", F.col("m.url").alias("url"), "normalized_url", F.col("m.depth").cast("int").alias("depth"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("attempts"))
    return frontier.unionByName(fresh)


def eligible(frontier: DataFrame, limit: int, max_attempts: int = 3) -> DataFrame:
    """Next pages, pending or failed below the attempt cap, shallow first."""
    open_ = F.col("status").isin("pending", "failed") & (F.col("attempts") < max_attempts)
    return frontier.filter(open_).orderBy("depth", "normalized_url").limit(limit)


def status_counts(frontier: DataFrame) -> DataFrame:
    """(total, pending, done, failed, skipped); sums over no rows are null."""
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return frontier.agg(F.count("*").alias("total"), one("pending"), one("done"), one("failed"), one("skipped"))


def reset_fetching(frontier: DataFrame) -> DataFrame:
    """Pages that a crash left in flight are pending again."""
    return frontier.withColumn("status", F.when(F.col("status") == "fetching", "pending").otherwise(F.col("status")))


def apply_results(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Frontier after results (source_id, normalized_url, error): done, skipped or failed, with one more attempt."""
    r = results.select("source_id", "normalized_url", F.lit(True).alias("_ran"), F.col("error").alias("_error"))
    both = frontier.join(r, ["source_id", "normalized_url"], "left")
    status = F.when(F.col("_ran").isNull(), F.col("status")).when(F.col("_error").isNull(), "done").when(is_skippable(F.col("_error")), "skipped").otherwise("failed")
    attempts = F.col("attempts") + F.coalesce(F.col("_ran").cast("int"), F.lit(0))
    error = F.when(F.col("_ran").isNull(), F.col("error_message")).otherwise(F.col("_error"))
    return both.withColumn("status", status).withColumn("attempts", attempts).withColumn("error_message", error).select(*frontier.columns)


def is_skippable(error):
    out = F.lit(False)
    for part in SKIPPABLE:
        out = out | F.lower(error).contains(part)
    return out


def is_rate_limited(error):
    out = F.lit(False)
    for part in RATE_LIMITED:
        out = out | F.lower(error).contains(part)
    return out


def backoff_seconds(attempt):
    """15 s doubled with every attempt, 120 s at most."""
    return F.least(F.lit(120.0), 15 * F.pow(F.lit(2.0), attempt))


def crawl(seeds: DataFrame, pages: Callable[[DataFrame], DataFrame], root: str, max_depth: int = 3, max_pages: int = 500, batch: int = 1000, frontier: DataFrame | None = None, **scope) -> tuple[DataFrame, DataFrame]:
    """(frontier, pages) after a bounded crawl.

    ``pages`` maps a batch of frontier rows to (source_id, normalized_url, error,
    links array<string>, and whatever the page holds). Seeds are scope-filtered, and
    the page cap is exact. ``frontier``: that of a crawl to go on with; what was in
    flight is pending again.
    """
    spark = seeds.sparkSession
    seeds = seeds.filter(urls.in_scope(F.col("url"), root, **scope)).orderBy("depth", "url").limit(max_pages)
    before = spark.createDataFrame([], SCHEMA) if frontier is None else reset_fetching(frontier)
    frontier = insert_new(before, seeds).checkpoint()
    seen: DataFrame | None = None
    while True:
        now = eligible(frontier, batch).checkpoint()
        if now.isEmpty():
            return frontier, seen if seen is not None else pages(now)
        got = pages(now).checkpoint()
        seen = got if seen is None else seen.unionByName(got)
        frontier = apply_results(frontier, got)
        links = got.filter("error is null").join(now.select("source_id", "normalized_url", "depth"), ["source_id", "normalized_url"])
        links = links.filter(F.col("depth") < max_depth).select("source_id", F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"))
        links = links.filter(urls.in_scope(F.col("url"), root, **scope))
        room = max(0, max_pages - frontier.count())
        fresh = insert_new(frontier, links).join(frontier.select("source_id", "normalized_url"), ["source_id", "normalized_url"], "left_anti")
        frontier = frontier.unionByName(fresh.orderBy("depth", "normalized_url").limit(room)).checkpoint()
