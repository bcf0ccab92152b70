"""Keyed state as whole-table functions, and a store that commits all its tables in one step.

A mutation takes the table as it was and the changed rows, and returns the table as it will
be: a shuffle on the key for the rows of both sides, nothing on the driver.

`TableStore` keeps a table as buckets of its keys' hashes, each a folder of immutable files. A
`Commit` writes new folders for the buckets that its changes touch, of any number of tables,
and then creates one manifest, `_at-<number>`, that names the folder of every bucket of every
table. Readers resolve all tables through the largest manifest that is complete, so they see
all of a commit or nothing of it, and a writer that stops at any step leaves the last one in
place. A manifest is created only if there is none of its number: of two writers that began at
the same state the second gets a `Conflict` and changes nothing.
"""

from __future__ import annotations

import copy
import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = re.compile(r"_at-([0-9]{12})")
#: Bytes of a bucket on average, beyond which a table is dealt over more; and the most buckets.
TARGET, MOST = 128 << 20, 4096


class Conflict(RuntimeError):
    """Another commit came first."""


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of their keys; keys of rows must be unique."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def last(table: DataFrame, rows: DataFrame, seq: str = "insert_seq") -> DataFrame:
    """rows with a seq that goes on from the table's largest, in their own order of seq."""
    top = table.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(seq, F.col("_top") + 1 + F.col(seq)).drop("_top")


def upsert_last(table: DataFrame, rows: DataFrame, key: str, seq: str = "insert_seq") -> DataFrame:
    """As upsert, and the rows come last."""
    return upsert(table, last(table, rows, seq), key)


def failed(tombstones: DataFrame, failed_rows: DataFrame, at: str, version: str) -> DataFrame:
    """Tombstones after failures, see `failures`."""
    return upsert(tombstones, failures(tombstones, failed_rows, at, version), "source_key")


def failures(tombstones: DataFrame, failed_rows: DataFrame, at: str, version: str) -> DataFrame:
    """The tombstones of failed sources (source_key, source_etag, source_size, source_last_modified, error): attempts go on for the same version of a source, else start at 1."""
    was = tombstones.select("source_key", F.col("source_etag").alias("_etag"), F.col("source_size").alias("_size"), F.col("attempts").alias("_attempts"))
    same = (F.col("_etag") == F.col("source_etag")) & (F.col("_size") == F.col("source_size"))
    attempts = F.when(same, F.col("_attempts") + 1).otherwise(1).cast("int")
    return failed_rows.join(was, "source_key", "left").select("source_key", "source_etag", "source_size", "source_last_modified", "error", F.lit(at).alias("failed_at"), attempts.alias("attempts"), F.lit(version).alias("encoder_version"))


def repointed(mappings: DataFrame, moves: DataFrame, version: str, root: Column) -> DataFrame:
    """Mappings of moves.old point to moves.new; their source columns and encoded_at stay. moves: old (unique), new."""
    return _pointed(mappings.join(moves, F.col("content_id") == F.col("old"), "left"), version, root)


def moved(mappings: DataFrame, moves: DataFrame, version: str, root: Column) -> DataFrame:
    """As `repointed`, only the mappings that move."""
    return _pointed(mappings.join(moves, F.col("content_id") == F.col("old")), version, root)


def _pointed(joined: DataFrame, version: str, root: Column) -> DataFrame:
    moves = F.col("new").isNotNull()
    out = joined.withColumns({"content_id": F.coalesce("new", "content_id"), "encoder_version": F.when(moves, F.lit(version)).otherwise(F.col("encoder_version"))})
    return out.withColumn("hls_root", F.when(moves, root).otherwise(F.col("hls_root"))).drop("old", "new")


def _dirs(entry: dict, base: str) -> list[str]:
    return [f"{base}/{version}/_b={b}" for b, (version, _) in sorted(entry["at"].items())]


class TableStore:
    """Tables under one root of a file system that the driver shares with the executors."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all manifests, complete or not, from the latest on."""
        root = self._path(self.root)
        found = [_POINTER.fullmatch(os.path.basename(e.getPath().toString())) for e in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((int(m.group(1)) for m in found if m), reverse=True)

    def _manifest(self, number: int) -> dict | None:
        """Tables of a manifest; None if it is gone or its writer has not finished it."""
        try:
            stream = self._fs.open(self._path(f"{self.root}/_at-{number:012d}"))
            try:
                return json.loads(self._text(stream))["tables"]
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def current(self) -> tuple[int, dict]:
        """Number of the latest manifest, complete or not, and the tables of the latest complete one. Raises where there was a commit and no manifest is readable."""
        numbers = self._numbers()
        for n in numbers:
            if (tables := self._manifest(n)) is not None:
                return numbers[0], tables
        if self._fs.exists(self._path(f"{self.root}/_begun")):
            raise RuntimeError(f"{self.root} has had a commit, but no manifest is readable")
        return (numbers[0] if numbers else 0), {}

    def _frame(self, name: str, entry: dict | None, schema: str) -> DataFrame:
        if not entry or not entry["at"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*_dirs(entry, f"{self.root}/tables/{name}"))

    def read(self, name: str, schema: str) -> DataFrame:
        """The table as of the last commit, or an empty one if none was ever written."""
        return self._frame(name, self.current()[1].get(name), schema)

    def files(self, name: str) -> dict[str, str]:
        """The folder of each bucket of a table."""
        entry = self.current()[1].get(name, {"at": {}})
        return {b: version for b, (version, _) in entry["at"].items()}

    def begin(self) -> Commit:
        return Commit(self)

    def write(self, name: str, df: DataFrame) -> None:
        """A commit of one whole table."""
        commit = self.begin()
        commit.replace(name, df)
        commit.done()

    def _data(self, df: DataFrame, path: str, parts: int) -> None:
        df.repartition(parts, "_b").write.partitionBy("_b").parquet(path)

    def _point(self, number: int, tables: dict) -> None:
        path = self._path(f"{self.root}/_at-{number:012d}")
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if self._fs.exists(path):
                raise Conflict(f"{self.root}: commit {number} is there already") from e
            raise
        stream.write(bytearray(json.dumps({"tables": tables}).encode()))
        stream.close()
        self._fs.create(self._path(f"{self.root}/_begun"), True).close()

    def _sweep(self) -> None:
        """Removes what neither of the two latest complete manifests names, manifests first. One writer at a time (see `locking`)."""
        kept: list[dict] = []
        for n in self._numbers():
            tables = self._manifest(n) if len(kept) < 2 else None
            if tables is not None:
                kept.append(tables)
            elif kept:
                self._fs.delete(self._path(f"{self.root}/_at-{n:012d}"), False)
        base = f"{self.root}/tables"
        named = {d for tables in kept for name, entry in tables.items() for d in _dirs(entry, f"{base}/{name}")}
        whole = {os.path.dirname(d) for d in named}
        below = lambda p: [f"{p}/{os.path.basename(e.getPath().toString())}" for e in self._fs.listStatus(self._path(p)) if e.isDirectory()] if self._fs.exists(self._path(p)) else []
        for table in below(base):
            for version in below(table):
                for d in [version] if version not in whole else [b for b in below(version) if b not in named]:
                    self._fs.delete(self._path(d), True)


class Commit:
    """Changes of several tables that become visible together. `read` shows the state that the commit began at."""

    def __init__(self, store: TableStore):
        self.store = store
        self.number, self.before = store.current()
        self.after = copy.deepcopy(self.before)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.store._frame(name, self.before.get(name), schema)

    def _written(self, name: str, df: DataFrame, key: str | None, buckets: int, parts: int) -> dict:
        """Writes df and returns the folder and bytes of each of its buckets."""
        version = uuid.uuid4().hex
        path = f"{self.store.root}/tables/{name}/{version}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)) if key else F.lit(0)
        self.store._data(df.withColumn("_b", bucket.cast("int")), path, max(1, parts))
        sizes: dict[str, int] = {}
        found = self.store._fs.listFiles(self.store._path(path), True)
        while found.hasNext():
            f = found.next()
            folder = os.path.basename(f.getPath().getParent().toString())
            if folder.startswith("_b=") and f.getPath().getName().endswith(".parquet"):
                sizes[folder[3:]] = sizes.get(folder[3:], 0) + f.getLen()
        return {b: [version, n] for b, n in sizes.items()}

    def replace(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """The whole table. With a key it is dealt into buckets by the size that Spark expects of df, which is that of its files if df is stored."""
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() if key else 0
        buckets = min(MOST, 1 << max(0, int(str(size)) // self.store.target).bit_length())
        self.after[name] = {"buckets": buckets, "at": self._written(name, df, key, buckets, buckets)}

    def change(self, name: str, schema: str, key: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """rows replace what there is of their keys, and the keys of `gone` go; only buckets of these keys are written.

        Of rows and gone only the bucket numbers come to the driver, at most MOST of them.
        """
        store, entry = self.store, self.after.setdefault(name, {"buckets": 1, "at": {}})
        none = lambda what: store.spark.createDataFrame([], what)
        rows = rows.select(*self.read(name, schema).columns) if rows is not None else none(schema)
        keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
        buckets, old = entry["buckets"], entry["at"]
        want = min(MOST, 1 << max(0, sum(n for _, n in old.values()) // store.target).bit_length())
        if want > 2 * buckets:
            buckets, touched = want, range(want)
        elif buckets == 1:
            touched = range(1)
        else:
            number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
            touched = [r[0] for r in keys.select(number.alias("b")).distinct().collect()]
            old = {b: v for b, v in old.items() if b in set(touched)}
        if not touched:
            return
        table = remove(store._frame(name, {"at": old}, schema), keys, key).unionByName(rows)
        made = self._written(name, table, key, buckets, len(touched))
        kept = {b: v for b, v in entry["at"].items() if b not in old}
        self.after[name] = {"buckets": buckets, "at": {**kept, **made}}

    def done(self) -> None:
        """Makes all changes visible at once, or raises Conflict and none."""
        self.store._point(self.number + 1, self.after)
        self.store._sweep()


def apply(store: TableStore, changes: list[tuple], tries: int = 5) -> None:
    """One commit of (table, schema, key, rows, gone), begun anew where another came first.

    rows may be a function of the commit, for rows that follow from the state that they change.
    """
    for left in range(tries - 1, -1, -1):
        commit = store.begin()
        for name, schema, key, rows, gone in changes:
            commit.change(name, schema, key, rows(commit) if callable(rows) else rows, gone)
        try:
            return commit.done()
        except Conflict:
            if not left:
                raise
