"""What a run has to do with each source: cached, blocked, known bytes, or work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
OUTCOMES = ("cached", "errored", "deduped", "busy", "processed", "failed")


def cached(sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """sources with `cached`: a mapping of the same key, etag and size."""
    known = mappings.select("source_key", F.col("source_etag").alias("etag"), F.col("source_size").alias("size"), F.lit(True).alias("_hit"))
    return sources.join(known, ["source_key", "etag", "size"], "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def blocked(sources: DataFrame, tombstones: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """sources with `attempts` on this very version and `blocked`: as many as allowed."""
    known = tombstones.select("source_key", F.col("source_etag").alias("etag"), F.col("source_size").alias("size"), "attempts")
    return sources.join(known, ["source_key", "etag", "size"], "left").withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "blocked": F.coalesce(F.col("attempts") >= most, F.lit(False))})


def canonical(contents: DataFrame) -> DataFrame:
    """content_id, source_key (the first by key), copies. A partial minimum, so a hot content is no hot task."""
    return contents.groupBy("content_id").agg(F.min("source_key").alias("source_key"), F.count(F.lit(1)).alias("copies"))


def known_bytes(contents: DataFrame, outputs: DataFrame) -> DataFrame:
    """contents whose output is complete, by its master playlist."""
    done = outputs.filter("rel_path = 'master.m3u8'").select("content_id")
    return contents.join(done, "content_id", "left_semi")


def outcomes(sources: DataFrame, mappings: DataFrame, tombstones: DataFrame, outputs: DataFrame, content: Column) -> DataFrame:
    """source_key and outcome before any media is decoded; bytes are hashed for open sources only.

    Of several open sources with the same new bytes the first by key is processed, the rest deduped.
    """
    state = blocked(cached(sources, mappings), tombstones)
    gone = state.filter("cached or blocked").select("source_key", F.when(F.col("cached"), "cached").otherwise("errored").alias("outcome"))
    work = state.filter("not cached and not blocked").select("source_key", content.alias("content_id"))
    done = outputs.filter("rel_path = 'master.m3u8'").select("content_id", F.lit(True).alias("_done"))
    first = canonical(work).select("content_id", F.col("source_key").alias("_first"))
    judged = work.join(done, "content_id", "left").join(first, "content_id").select("source_key", F.when(F.col("_done") | (F.col("source_key") != F.col("_first")), "deduped").otherwise("processed").alias("outcome"))
    return gone.unionByName(judged)


def summary(outcome: DataFrame) -> DataFrame:
    """One row: how many sources came to each outcome, and all."""
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcome.agg(*map(count, OUTCOMES), F.count(F.lit(1)).alias("total"))


def pair_summary(outcome: DataFrame, pair: str = "pair") -> DataFrame:
    """As `summary` for each pair, and one row without a pair for all of them."""
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcome.rollup(pair).agg(*map(count, OUTCOMES), F.count(F.lit(1)).alias("total"), F.count_distinct(pair).alias("pairs_processed"))


def within_budget(sources: DataFrame, n: int) -> DataFrame:
    """The first n sources by key: what a run that may take n of them takes."""
    return sources.orderBy("source_key").limit(n)
