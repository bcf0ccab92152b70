"""State as keyed JSON documents: strict decoding, encoding, import into and export from a TableStore.

A destination may hold its state as one object a key: mappings, image mappings, tombstones,
metadata, the fingerprint index, raw fingerprints, and the output trees themselves. Documents
are read by Spark as rows of key and body and decoded by built-in functions. Decoding is strict
about what is there: broken JSON, something that is no object, or a field of another type (or
out of its range) gives a row with nothing but key and `error`. It is lenient about what is
not: unknown fields are passed over, missing and null fields are null, no body is a row of
nulls, text behind the document is not read.

An index is a document of many entries, which one task reads; an export writes several of at
most `ENTRIES` entries, numbered in the order of insertion, and an import takes any number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat import pipeline
from mediacat.functions import keys
from mediacat.operators import scratch, state

#: Entries of an index document that an export writes, characters of an error that are kept.
ENTRIES, TAIL = 10_000, 500

# The version of the index document, content types, names of fields.
INDEX_VERSION = 1
JSON, BINARY = "application/json", "application/octet-stream"


@dataclass(frozen=True)
class Field:
    """kind: string, long, int or double, a tuple of fields (an object), or a list that holds such a tuple (a list of objects)."""

    column: str
    name: str
    kind: str | tuple | list = "string"
    optional: bool = False


_SOURCE = (Field("source_key", "sourceKey"), Field("source_etag", "sourceEtag"), Field("source_size", "sourceSize", "long"), Field("source_last_modified", "sourceLastModified"))
MAPPING = (*_SOURCE, Field("content_id", "contentId"), Field("hls_root", "hlsRoot"), Field("encoded_at", "encodedAt"), Field("encoder_version", "encoderVersion"))
IMAGE_MAPPING = (*_SOURCE, Field("pdq_hash", "pdqHash"), Field("quality", "quality", "int"), Field("hashed_at", "hashedAt"), Field("hasher_version", "hasherVersion"))
TOMBSTONE = (*_SOURCE, Field("error", "error"), Field("failed_at", "failedAt"), Field("attempts", "attempts", "int"), Field("encoder_version", "encoderVersion"))
_PROBED = (Field("width", "width", "int"), Field("height", "height", "int"), Field("duration_seconds", "durationSeconds", "double"), Field("bitrate_kbps", "bitrateKbps", "int", True))
_RUNG = (Field("name", "name"), Field("width", "width", "int"), Field("height", "height", "int"), Field("video_bitrate_kbps", "videoBitrateKbps", "int"), Field("audio_bitrate_kbps", "audioBitrateKbps", "int"))
METADATA = (Field("content_id", "contentId"), Field("encoder_version", "encoderVersion"), Field("encoded_at", "encodedAt"), Field("source", "source", _PROBED), Field("ladder", "ladder", [_RUNG]))
ENTRY = (
    Field("content_id", "contentId"),
    Field("interval_seconds", "intervalSeconds", "double"),
    Field("hash_count", "hashCount", "int"),
    Field("width", "width", "int"),
    Field("height", "height", "int"),
    Field("video_bitrate_kbps", "videoBitrateKbps", "int", True),
    Field("encoded_at", "encodedAt"),
)
INDEX = (Field("version", "version", "long"), Field("entries", "entries", [ENTRY]))


# decoding
def _at(raw: Column, name: str) -> Column:
    return F.try_variant_get(raw, f"$.{name}", "variant")


def _value(raw: Column, kind: str | tuple | list) -> Column:
    if isinstance(kind, str):
        return F.try_variant_get(raw, "$", kind)
    if isinstance(kind, list):
        return F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda x: _value(x, kind[0]))
    return F.when(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), F.struct(*[_value(_at(raw, f.name), f.kind).alias(f.column) for f in kind]))


def _fault(raw: Column, kind: str | tuple | list, path: str) -> Column:
    """What is wrong with a value, the first fault of all; null if nothing is, or if there is none."""
    said = F.schema_of_variant(raw)
    begins = lambda *names: F.regexp_like(said, F.lit("^(" + "|".join(names) + r")\b"))
    wrong = lambda what: F.lit(f"{path}: not {what}")
    there = raw.isNotNull() & (said != "VOID")
    if isinstance(kind, tuple):
        inner = F.coalesce(*[_fault(_at(raw, f.name), f.kind, f"{path}.{f.name}" if path != "document" else f.name) for f in kind])
        return F.when(there, F.when(~begins("OBJECT"), wrong("an object")).otherwise(inner))
    if isinstance(kind, list):
        items = F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda x: _fault(x, kind[0], f"{path}[]"))
        return F.when(there, F.when(~begins("ARRAY"), wrong("a list")).otherwise(F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))))
    if kind == "string":
        return F.when(there & (said != "STRING"), wrong("a string"))
    if kind == "double":
        return F.when(there & ~begins("BIGINT", "DECIMAL", "DOUBLE"), wrong("a number"))
    return F.when(there & ((said != "BIGINT") | _value(raw, kind).isNull()), wrong(f"a whole number ({kind})"))


def decoded(docs: DataFrame, fields: tuple[Field, ...], error: str = "error") -> DataFrame:
    """key, a column for each field, error; docs: key, body. Rows with an error have no values.

    error: the name of the column of errors, where `error` is a field of the document.
    """
    raw = docs.select("key", "body", F.try_parse_json("body").alias("_v"))
    what = F.when(F.col("body").isNotNull() & F.col("_v").isNull(), "document: broken JSON").otherwise(_fault(F.col("_v"), fields, "document"))
    judged = raw.select("key", "_v", what.alias("_error"))
    values = [F.when(F.col("_error").isNull(), _value(_at(F.col("_v"), f.name), f.kind)).alias(f.column) for f in fields]
    return judged.select("key", *values, F.col("_error").alias(error))


def index_entries(docs: DataFrame) -> DataFrame:
    """key, the columns of the state's index, error: a row for each entry, or one error row for a document that does not decode or has another version; no body is an index without entries."""
    d = decoded(docs.filter("body is not null"), INDEX)
    version = F.coalesce("version", F.lit(0))
    unfit = F.when(version != INDEX_VERSION, F.concat(F.lit("unsupported fingerprint index version: "), version.cast("string")))
    d = d.select("key", "entries", F.coalesce("error", unfit).alias("error"))
    number = F.coalesce(F.nullif(F.regexp_extract("key", r"-(\d+)\.json$", 1), F.lit("")).cast("long"), F.lit(0))
    good = d.filter("error is null").select("key", F.posexplode("entries").alias("_at", "e"), F.lit(None).cast("string").alias("error"))
    rows = good.select("key", "e.*", (F.call_function("shiftleft", number, F.lit(32)) + F.col("_at")).alias("insert_seq"), "error")
    return rows.unionByName(d.filter("error is not null").select("key", "error"), allowMissingColumns=True)


# encoding
def _text(value: Column, kind: str | tuple | list, depth: int) -> Column:
    pad, out = "  " * (depth + 1), "  " * depth
    if isinstance(kind, str):
        j = F.to_json(F.array(value))
        return F.substr(j, F.lit(2), F.length(j) - 2)
    if isinstance(kind, list):
        items = F.array_join(F.transform(value, lambda x: F.concat(F.lit(pad), _text(x, kind[0], depth + 1))), ",\n")
        return F.when(value.isNull(), "null").when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[\n"), items, F.lit(f"\n{out}]")))
    return F.when(value.isNull(), "null").otherwise(_object([(f, value[f.column]) for f in kind], depth))


def _object(values: list[tuple[Field, Column]], depth: int) -> Column:
    pad, out = "  " * (depth + 1), "  " * depth
    line = lambda f, v: F.when(v.isNull() if f.optional else F.lit(False), F.lit(None)).otherwise(F.concat(F.lit(f'{pad}"{f.name}": '), _text(v, f.kind, depth + 1)))
    return F.concat(F.lit("{\n"), F.array_join(F.array(*[line(f, v) for f, v in values]), ",\n"), F.lit(f"\n{out}}}"))


def body(fields: tuple[Field, ...]) -> Column:
    """The document of a row: fields in order, two blanks for each level; optional fields without value are left out, others are null."""
    return _object([(f, F.col(f.column)) for f in fields], 0)


def index_documents(index: DataFrame, most: int = ENTRIES) -> DataFrame:
    """key, body of index documents of at most about `most` entries each (range-partitioned by insertion); one of no entries for an empty index."""
    n = index.count()
    parts = max(1, -(-n // most))
    placed = index.repartitionByRange(parts, "insert_seq").withColumn("_part", F.spark_partition_id()) if parts > 1 else index.withColumn("_part", F.lit(0))
    entry = F.struct("insert_seq", *[f.column for f in ENTRY])
    grouped = placed.groupBy("_part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    rows = grouped if n else index.sparkSession.range(1).select(F.lit(0).alias("_part"), F.array().cast(grouped.schema["entries"].dataType).alias("entries"))
    name = F.concat(F.lit("fingerprints/index"), F.when(F.col("_part") > 0, F.concat(F.lit("-"), F.format_string("%05d", F.col("_part")))).otherwise(""), F.lit(".json"))
    return rows.select(name.alias("key"), F.lit(INDEX_VERSION).alias("version"), "entries").select("key", body(INDEX).alias("body"))


# objects
class Folder:
    """Objects of a folder on a file system that driver and executors share, by key; it is sent to the tasks. An object is seen whole or not at all."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _place(self, key: str):
        from pyarrow import fs

        if self.root.startswith("/") or self.root.startswith("file:"):
            return fs.LocalFileSystem(), f"{_bare(self.root)}/{key}"
        system, path = fs.FileSystem.from_uri(self.root)
        return system, f"{path}/{key}"

    def put(self, key: str, data: bytes, kind: str) -> None:
        import uuid

        system, path = self._place(key)
        folder, name = path.rsplit("/", 1)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/_{uuid.uuid4().hex}"  # readers of the folder pass names with _ over
        with system.open_output_stream(part) as f:
            f.write(data)
        system.move(part, path)

    def get(self, key: str) -> bytes:
        system, path = self._place(key)
        with system.open_input_stream(path, compression=None) as f:
            return f.read()

    def remove(self, key: str) -> None:
        """No error where there is none."""
        from pyarrow import fs

        system, path = self._place(key)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)


def _bare(root: str) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root)


def objects(spark: SparkSession, root: str, prefix: str, suffix: str) -> DataFrame:
    """key, content of the objects under a prefix (a folder); none where it does not exist. Contents are read only where they are asked for."""
    base = root.rstrip("/") + "/"
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(base + prefix)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "key string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(base + prefix)
    start = F.instr("path", _bare(base) + prefix) + len(_bare(base))
    return found.select(F.substr("path", start).alias("key"), "content")


def contents(rows: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """key, content of objects read one after the other by tasks, for names that Hadoop's file systems do not read, such as those with a colon."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key in pdf["key"]:
                yield pd.DataFrame({"key": [key], "content": [get(key)]})

    return rows.select("key").mapInPandas(each, "key string, content binary")


def documents(spark: SparkSession, root: str, prefix: str, suffix: str = ".json") -> DataFrame:
    """key, body; a body that is no UTF-8 does not decode."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    return objects(spark, root, prefix, suffix).select("key", text.alias("body"))


def put_all(rows: DataFrame, put: Callable[[str, bytes, str], None], kind: str) -> DataFrame:
    """key, error of objects sent by tasks; rows: key, content (binary). A failed one is a row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for key, content in zip(pdf["key"], pdf["content"], strict=True):
                try:
                    put(key, bytes(content), kind)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(str(e)[-TAIL:] or type(e).__name__)
            yield pd.DataFrame({"key": pdf["key"], "error": errors})

    return rows.select("key", "content").mapInPandas(each, "key string, error string")


# whole states
class Invalid(ValueError):
    """Documents that do not decode."""


_KEYED = {
    "mappings": (pipeline.MAPPING, MAPPING, lambda: keys.mapping_key(F.col("source_key"))),
    "image_mappings": (pipeline.IMAGE_MAPPING, IMAGE_MAPPING, lambda: keys.image_mapping_key(F.col("source_key"))),
    "tombstones": (pipeline.TOMBSTONE, TOMBSTONE, lambda: keys.tombstone_key(F.col("source_key"))),
    "image_tombstones": (pipeline.TOMBSTONE, TOMBSTONE, lambda: keys.tombstone_key(F.col("source_key"))),
    "metadata": (pipeline.METADATA, METADATA, lambda: keys.metadata_key(F.col("content_id"))),
}


def exported(store: state.TableStore, put: Callable[[str, bytes, str], None], most: int = ENTRIES) -> DataFrame:
    """key, error of all documents and fingerprints of a store, put by tasks; repeatable. Sources' keys, and so documents, of videos and images differ."""
    begun = store.begin()
    texts = [begun.read(name, schema).select(key().alias("key"), body(fields).alias("body")) for name, (schema, fields, key) in _KEYED.items()]
    texts.append(index_documents(begun.read("index", pipeline.INDEX), most))
    said = [put_all(t.select("key", F.encode("body", "UTF-8").alias("content")), put, JSON) for t in texts]
    blobs = begun.read("blobs", pipeline.BLOB).select(keys.fingerprint_key(F.col("content_id")).alias("key"), F.col("blob").alias("content"))
    out = put_all(blobs, put, BINARY)
    for part in said:
        out = out.unionByName(part)
    return scratch.stored(out)


def imported(store: state.TableStore, root: str, get: Callable[[str], bytes] | None = None) -> dict[str, int]:
    """Rows by table that the objects under a root hold; they replace the store's tables in one commit.

    Raises Invalid, with the first of them, if documents do not decode, and changes nothing then.
    Of entries with one content the last counts. Outputs are the objects under `by-id/`. get reads
    a fingerprint by its key (by default `Folder(root).get`), as its name has a colon.
    """
    spark, tables = store.spark, {}
    for name, prefix in (("mappings", "mappings/"), ("image_mappings", "image-mappings/"), ("tombstones", "errors/")):
        tables[name] = scratch.stored(decoded(documents(spark, root, prefix), _KEYED[name][1], "_error"))
    tables["metadata"] = scratch.stored(decoded(documents(spark, root, "by-id/", "metadata.json"), METADATA, "_error"))
    tables["index"] = scratch.stored(index_entries(documents(spark, root, "fingerprints/")).withColumnRenamed("error", "_error"))
    for table in tables.values():
        if bad := table.filter("_error is not null").orderBy("key").select("key", "_error").first():
            raise Invalid(f"{bad['key']}: {bad['_error']}")
    stones = tables.pop("tombstones")
    image = F.coalesce(keys.is_image(F.col("source_key")), F.lit(False))
    tables |= {"tombstones": stones.filter(~image), "image_tombstones": stones.filter(image)}
    tables["index"] = tables["index"].groupBy("content_id").agg(F.max_by(F.struct(*[f.column for f in ENTRY if f.column != "content_id"], "insert_seq"), "insert_seq").alias("e")).select("content_id", "e.*")
    blob = contents(objects(spark, root, "fingerprints/", ".bin"), get or Folder(root).get)
    tables["blobs"] = blob.select(F.regexp_extract("key", r"^fingerprints/(.*)\.bin$", 1).alias("content_id"), F.col("content").alias("blob"))
    listed = objects(spark, root, "by-id/", "").select(F.regexp_extract("key", "^by-id/([^/]+)/", 1).alias("content_id"), F.regexp_extract("key", "^by-id/[^/]+/(.+)$", 1).alias("rel_path"))
    tables["outputs"] = listed
    schemas = {name: schema for name, (schema, *_) in _KEYED.items()} | {"index": pipeline.INDEX, "blobs": pipeline.BLOB, "outputs": pipeline.OUTPUT}
    commit, counts = store.begin(), {}
    for name, rows in tables.items():
        rows = scratch.stored(rows.select(*spark.createDataFrame([], schemas[name]).columns))
        counts[name] = rows.count()
        commit.replace(name, rows, "source_key" if "source_key" in rows.columns else "content_id")
    commit.done()
    return counts
