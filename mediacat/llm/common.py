"""What the corpus operators share: tables, scratch space, words, positions."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediacat.operators.scratch import scratch_dir
from mediacat.operators.scratch import stored as stored

#: White space of the corpus contracts: space and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Function caches that a worker drops where a task ends.
CACHES: list = []
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(df: DataFrame, by: str, schema: str) -> DataFrame:
    """As `stored`, a folder for each value of `by`, so that a filter on it reads no others."""
    path = f"{scratch_dir(df.sparkSession)}/mediacat-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from here on: texts are long, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def released() -> None:
    """Called where a task of a Python worker ends: free memory goes back to the system, for the stages after it."""
    for cache in CACHES:
        cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


#: What drops the memory that an operator's tasks keep in a worker for later ones, by operator.
KEPT: dict[str, Callable[[], object]] = {}


def turn(owner: str, drop: Callable[[], object] | None = None) -> None:
    """Called where a task of an operator begins: what other operators' tasks have kept in this worker goes. drop: how to drop what this one will keep."""
    others = [k for k in KEPT if k != owner]
    for k in others:
        KEPT.pop(k)()
    if drop is not None:
        KEPT[owner] = drop
    if others:
        released()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most so many rows, so that a worker makes few Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    released()


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def crc_share(doc_id: int, n: int) -> int:
    """crc32 of the id as text, modulo n: the fold of a labelled row."""
    return zlib.crc32(str(doc_id).encode()) % n


def fold(doc_id: Column, n: int) -> Column:
    """crc_share as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column) -> DataFrame:
    """df with `out`: gapless ranks from 0 within each value of keys, by (bucket, order).

    `bucket` deals a key's rows over a bounded number of buckets, so that a hot key is not one
    task. Each bucket is numbered alone, behind the sizes of the buckets before it.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row for each bucket of a key
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return numbered.join(ahead, [*keys, "_bucket"]).withColumn(out, F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def digest_bucket(key: Column, salt: str = "", digits: int = 3) -> Column:
    """One of 16 ** digits buckets of a key, by md5."""
    return F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, digits)
