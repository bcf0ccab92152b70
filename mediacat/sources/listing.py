"""Object listings: from a table, from a directory tree, and the filters of a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import keys


def tree(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """source_key, etag, size, last_modified of all files under root/prefix; contents are not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base + prefix)
    key = F.element_at(F.split(F.col("path"), F.lit(base), 2), -1)
    stamp = F.md5(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")))
    return files.select(key.alias("source_key"), stamp.alias("etag"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


class Incomplete(RuntimeError):
    """A listing that ended with an error."""


def whole(listing: DataFrame) -> DataFrame:
    """The listing if none of its rows is an error; else raises Incomplete with the first. What is not listed is not known to be gone, so nothing may be cleaned up after it."""
    if "error" in listing.columns and (bad := listing.filter("error is not null").select("error").first()):
        raise Incomplete(bad["error"])
    return listing


def scan(listing: DataFrame, prefix: str = "", where: Callable[[Column], Column] | None = keys.is_video) -> DataFrame:
    """The listing's usable rows: complete, no folder marks, under the prefix, of the wanted kind (None: all); etags without quotes.

    The prefix is a plain string predicate, which file sources push down.
    """
    key = F.col("source_key")
    rows = listing.dropna(subset=["source_key", "etag", "size", "last_modified"]).filter(~(F.endswith(key, F.lit("/")) & (F.col("size") == 0)))
    if prefix:
        rows = rows.filter(F.startswith(key, F.lit(prefix)))
    if where is not None:
        rows = rows.filter(where(key))
    return rows.withColumn("etag", F.replace("etag", F.lit('"'), F.lit("")))
