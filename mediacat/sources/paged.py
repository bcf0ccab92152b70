"""Paged listings as a data source: a task for each range of keys, pages by continuation token within it.

A client names its ranges and lists one page of one of them: rows, and a token for the next
page or None. A task asks for page after page and hands rows on as they come, so no page
outlives its reading. An error ends its range and is returned once, as a row with nothing but
`error`; see `listing.whole` for what must not follow it. A prefix of keys, given as an option
or as a filter of the query that Spark pushes down, reaches the client, which skips ranges and
pages that it rules out; Spark checks every row again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

SCHEMA = "source_key string, etag string, size long, last_modified timestamp, error string"
#: Characters of an error that are kept, keys of a page.
TAIL, PAGE = 500, 1000

Row = tuple[str | None, str | None, int | None, datetime | None]


class Client(Protocol):
    """What a listing service offers; it is sent to the tasks."""

    def ranges(self, prefix: str) -> Sequence[str]:
        """Ranges of keys that together hold all keys under the prefix."""

    def page(self, within: str, prefix: str, token: str | None) -> tuple[list[Row], str | None]:
        """Rows of one page of a range, and the token of the next page; None after the last."""


@dataclass
class KeyRange(InputPartition):
    within: str
    prefix: str


class _Reader(DataSourceReader):
    def __init__(self, client: Client, prefix: str):
        self.client, self.prefix = client, prefix

    def partitions(self):
        return [KeyRange(r, self.prefix) for r in self.client.ranges(self.prefix)] or [KeyRange("", "\0")]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        if partition.prefix == "\0":
            return
        token = None
        while True:
            try:
                rows, token = self.client.page(partition.within, partition.prefix, token)
            except Exception as e:  # noqa: BLE001
                yield (None, None, None, None, str(e)[-TAIL:] or type(e).__name__)
                return
            for row in rows:
                yield (*row, None)
            if token is None:
                return


class _Pushed(_Reader):
    """For sessions that push filters down to such sources (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("source_key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            yield f  # Spark checks it, too


def listed(spark: SparkSession, client: Client, prefix: str = "") -> DataFrame:
    """source_key, etag, size, last_modified, error of all that the client lists."""

    kind = _Pushed if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else _Reader

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mediacat_listing"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return kind(client, self.options.get("prefix", ""))

    spark.dataSource.register(Listing)
    return spark.read.format("mediacat_listing").option("prefix", prefix).load()


def written(objects: DataFrame, path: str, page: int = PAGE) -> list[tuple[str, str, str]]:
    """Writes a listing as sorted files, whose row groups are pages; file, first and last key of each."""
    from pyspark.sql import functions as F

    rows = objects.select("source_key", "etag", F.col("size").cast("long").alias("size"), "last_modified")
    rows.repartitionByRange("source_key").sortWithinPartitions("source_key").write.option("parquet.block.row.count.limit", page).parquet(path)
    spark = objects.sparkSession
    found = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("source_key").alias("a"), F.max("source_key").alias("b"))
    # a row for each file
    return sorted((r["file"], r["a"] or "", r["b"] or "") for r in found.collect())


class Files:
    """A client over sorted Parquet files in a folder that driver and executors share: a file is a range, a row group a page, its number the token."""

    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files

    def ranges(self, prefix: str) -> Sequence[str]:
        return [f for f, a, b in self.files if a[: len(prefix)] <= prefix <= b]  # the first key is not behind the prefix, the last not before it

    def page(self, within: str, prefix: str, token: str | None) -> tuple[list[Row], str | None]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(within)
        with pq.ParquetFile(path, filesystem=system) as f:
            k = int(token or 0)
            if k >= f.num_row_groups:
                return [], None
            group = f.read_row_group(k)
            stamps = group.column("last_modified").cast(pa.timestamp("us"))  # UTC
            rows = zip(*(group.column(c).to_pylist() for c in ("source_key", "etag", "size")), stamps.cast(pa.timestamp("us", "UTC")).to_pylist(), strict=True)
            return [r for r in rows if (r[0] or "").startswith(prefix)], str(k + 1) if k + 1 < f.num_row_groups else None
