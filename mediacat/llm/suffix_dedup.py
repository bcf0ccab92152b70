"""Removal of repeated byte strings by suffixes in buckets and a difference-cover sample.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus.
The suffixes of the corpus (cut at `length` bytes) are never sorted as a whole:

1. Cover sample. Positions p with p mod 73 in a perfect difference set of nine numbers are
   sampled. For any two positions i and j some step d < 73 takes both onto the sample, so two
   equal strings of 100 bytes share the sample name (28 bytes) at i + d and j + d. A sample's
   rank stands for its whole surroundings: the 172 bytes in which the 73 strings around it lie.
2. Buckets of samples. Samples are dealt by name, packed, and each bucket is sorted alone by
   (name, rank, position). In a long tie (equal rank) all strings around a later sample repeat
   those around the first: they are settled by the rank, no suffix among them is compared.
   First samples of different ranks under one name leave their strings open.
3. Buckets of suffixes. Only the open strings, those at the ends of repeats and at edits, are
   dealt by their hash and sorted, one bucket at a time; all but the first of equal ones go.

Why that is exact: let e be the first place of a string that also starts at i. The two share
a sample name. If the ranks are equal, the sample at i is a later one and step 2 settles it.
Else both are open unless settled, and the sample at e is the first of its rank, for an
earlier one would bring an earlier place; so step 3 has both.

A task settles equal ranks and strings among its own documents before it sends any, so a
passage in a third of all documents sends one record for each task; exact copies of whole
texts are settled first, by digest. Memory: one bucket of about BUCKET records at a time.
Disk: steps 2 and 3 run in ROUNDS rounds, each over its share of the hashes (equal strings are
in one round), whose shuffle files go before the next.

Defined cases: null and empty texts have no bytes and the digest of nothing; texts shorter
than `length` stay whole; very long texts are read whole, as blocks of their own; ids should
be unique, rows that share one are taken as the same document at the same place and do not
remove each other; rows without id stay whole and remove nothing; copies keep the least id;
an empty table gives no rows; extra columns are dropped. Strings count as equal by hash: 96
bits and more for ranks (name, bucket and surroundings), 88 bits and their bucket for open
strings; the hashes are polynomials modulo primes, of two seeds for open strings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import kernels as K
from mediacat.llm.common import stored, table

LENGTH = 100
#: A perfect difference set: every number from 1 to 72 is one difference of its members, modulo 73.
PERIOD, COVER = 73, (1, 2, 4, 8, 16, 32, 37, 55, 64)
NAME = LENGTH - PERIOD + 1
#: Records of a bucket, on average, and records that a task holds before it sends them.
BUCKET, PACK = 1_200_000, 800_000
BROADCAST_ROWS = 1_000_000
#: Rounds of each sort, where the corpus is more than a few buckets.
ROUNDS = 2

#: Bytes that a record takes of its two keys: sample names and ranks, or suffix hashes alone.
SAMPLES, SUFFIXES = (4, 8), (8, 3)
LATER, OPEN = 0, 1
PARTS = "part long, kind int, blob binary"


def pack(doc: np.ndarray, at: np.ndarray, *keys: tuple[np.ndarray, int]) -> bytes:
    """Records sorted by document: runs of documents, then places and keys in as many bytes as asked for."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, len(doc))).astype("<u4")
    low = [k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes() for k, n in keys]
    return b"".join([np.array([len(first), len(doc)], "<u8").tobytes(), doc[first].astype("<i8").tobytes(), lengths.tobytes(), at.astype("<u4").tobytes(), *low])


def unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
    """doc, at and the keys of a pack."""
    runs, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    doc, lengths = np.frombuffer(blob, "<i8", runs, 16), np.frombuffer(blob, "<u4", runs, 16 + 8 * runs)
    place = 16 + 12 * runs
    out = [np.repeat(doc, lengths), np.frombuffer(blob, "<u4", n, place)]
    place += 4 * n
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        if width:
            wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, place).reshape(n, width)
        place += n * width
        out.append(wide.view("<u8").ravel())
    return out


def first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the last is the weightiest), document and place; and which rows in it are first of their keys."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _same_place(order: np.ndarray, new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows in order at the very place (document and start) of the first of their group: rows that share an id."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return (doc[order] == doc[order[head]]) & (at[order] == at[order[head]])


def _to_parts(doc: np.ndarray, at: np.ndarray, kind: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    part = (K.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((at, doc, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1) != 0)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[order[a]]), kind, pack(doc[order[a:b]], at[order[a:b]])


def _send(doc, at, keys, widths, buckets: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, -1, blob) of the task's first records; (part, LATER, blob) of those it settles itself."""
    order, new = first_of(keys, doc, at)
    later = order[~(new | _same_place(order, new, doc, at))]
    yield from _to_parts(doc[later], at[later], LATER, parts)
    head = np.sort(order[new])
    bucket = ((keys[-1][head] >> np.uint64(8 * widths[0] if widths[0] < 8 else 20)) % np.uint64(buckets)).astype(np.int64)
    head = head[np.argsort(bucket, kind="stable")]
    bucket.sort()
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1) != 0)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = head[a:b]
        yield int(bucket[a]), -1, pack(doc[own], at[own], *zip([k[own] for k in reversed(keys)], widths, strict=False))


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary())], names=["part", "kind", "blob"])


def in_round(h: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """A mask of the hashes that a round takes: an even range of their upper halves."""
    return (h >> np.uint64(32)) * np.uint64(rounds) >> np.uint64(32) == turn


def samples(data: np.ndarray, off: np.ndarray, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places, names and ranks (64-bit hashes) of a round's part of the cover sample of some rows' bytes."""
    size = np.diff(off)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    at = (np.arange(len(data)) - off[row]).astype(np.int64)
    chosen = np.zeros(PERIOD, bool)
    chosen[list(COVER)] = True
    # samples whose name lies in the text and around which there is a whole string
    p = np.flatnonzero(chosen[at % PERIOD] & (at + NAME <= size[row]) & (size[row] >= LENGTH))
    row, at, n = row[p], at[p], size[row[p]]
    fits = at - (PERIOD - 1) <= n - LENGTH
    p, row, at, n = p[fits], row[fits], at[fits], n[fits]
    rolling = K.Rolling(data)
    name = rolling.of(p, p + NAME)
    own = in_round(name, turn, rounds)
    p, row, at, n, name = p[own], row[own], at[own], n[own], name[own]
    left, right = np.minimum(PERIOD - 1, at), np.minimum(LENGTH, n - at)
    around = rolling.of(p - left, p + right)
    return row, at, name, K.mix(around ^ (left * 128 + right).astype(np.uint64))


def _sorted_samples(docs: DataFrame, buckets: int, parts: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """part, kind, blob: a round's samples that are later ones of their rank, and first ones of a rank among several."""

    def run(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            doc, at, name, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc))
            return _rows(list(_send(doc[order], at[order], (rank[order], name[order]), SAMPLES, buckets, parts)))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, data, off in K.blocks(batch.column(1)):
                row, at, name, rank = samples(data, off, turn, rounds)
                held.append((ids[a + row], at, name, rank))
                n += len(at)
                if n > PACK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(p, k, b) for p, k, b in zip(pdf["part"], pdf["kind"], pdf["blob"], strict=True) if k >= 0]
        blobs = pdf["blob"][pdf["kind"] < 0]
        if len(blobs):
            doc, at, name, rank = (np.concatenate(x) for x in zip(*(unpack(b, *SAMPLES) for b in blobs), strict=True))
            by_name = np.argsort(name, kind="stable")
            same = name[by_name][1:] == name[by_name][:-1]
            shared = by_name[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            doc, at, name, rank = doc[shared], at[shared], name[shared], rank[shared]
            order, new = first_of((rank, name), doc, at)
            later = order[~(new | _same_place(order, new, doc, at))]
            out += _to_parts(doc[later], at[later], LATER, parts)
            head = order[new]
            several = np.zeros(len(head), bool)
            several[1:] = name[head][1:] == name[head][:-1]
            several[:-1] |= several[1:]
            out += _to_parts(doc[head[several]], at[head[several]], OPEN, parts)
        return pd.DataFrame(out, columns=["part", "kind", "blob"])

    sent = docs.select("doc_id", F.col("bytes")).mapInArrow(run, PARTS)
    return sent.groupBy(F.when(F.col("kind") < 0, F.col("part")).otherwise(-1 - F.col("part"))).applyInPandas(settle, PARTS)


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, np.ndarray]:
    """For each document the union of its ranges [lo, hi] as rows (first, last); touching ranges join."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # ranges of one document lie beyond those of the one before it on one line
    docs, at = np.unique(doc, return_inverse=True)
    shift = at * (1 << 40)
    top = np.maximum.accumulate(hi + shift)
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] + shift[1:] > top[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    ranges = np.stack([lo[first], top[last] - shift[first]], 1) if len(doc) else np.zeros((0, 2), np.int64)
    cuts = np.searchsorted(at[first], np.arange(len(docs) + 1))
    return {int(d): ranges[a:b] for d, a, b in zip(docs, cuts[:-1], cuts[1:], strict=True)}


def _by_document(parts: DataFrame) -> DataFrame:
    """doc_id, later, open: ranges of starts of strings, as 64-bit pairs; one row for each document with any."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for kind in (LATER, OPEN):
            blobs = pdf["blob"][pdf["kind"] == kind]
            doc, at = (np.concatenate(x) for x in zip(*(unpack(b) for b in blobs), strict=True)) if len(blobs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            at = at.astype(np.int64)
            found.append(_runs(doc, np.maximum(at - (PERIOD - 1), 0), at))
        raw = lambda r: r.astype("<i8").tobytes() if r is not None else b""
        return pd.DataFrame([(d, raw(found[0].get(d)), raw(found[1].get(d))) for d in sorted({*found[0], *found[1]})], columns=["doc_id", "later", "open"])

    return parts.groupBy("part").applyInPandas(gather, "doc_id long, later binary, open binary")


def _pairs(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8").reshape(-1, 2)


def _starts(ranges: np.ndarray, n: int) -> np.ndarray:
    """A mask of n starts that lie in the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(ranges[:, 0], n), 1)
    np.add.at(steps, np.minimum(ranges[:, 1] + 1, n), -1)
    return np.cumsum(steps)[:n] > 0


def open_strings(data: np.ndarray, p: np.ndarray, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the strings at p a round takes, and the two hashes of those; only bytes of strings at p are hashed."""
    steps = np.zeros(len(data) + 1, np.int32)
    steps[p] = 1
    steps[p + LENGTH] -= 1
    needed = np.cumsum(steps[:-1]) > 0
    at = np.cumsum(needed)[p] - 1
    data = data[needed]
    h = K.Rolling(data, room=K.BLOCK).of(at, at + LENGTH)
    own = np.flatnonzero(in_round(h, turn, rounds))
    return own, h[own], K.Rolling(data, 2, K.BLOCK).of(at[own], at[own] + LENGTH) & np.uint64((1 << 24) - 1)


def _sorted_suffixes(docs: DataFrame, ranges: DataFrame, buckets: int, parts: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """part, kind, blob: a round's open strings that start earlier too."""

    def run(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            doc, at, h, more = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc))
            return _rows(list(_send(doc[order], at[order], (more[order], h[order]), SUFFIXES, buckets, parts)))

        for batch in batches:
            ids, later, open_ = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for a, b, data, off in K.blocks(batch.column(1)):
                places, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in range(a, b):
                    starts = off[k - a + 1] - off[k - a] - LENGTH + 1
                    if starts > 0:
                        places.append(np.flatnonzero(_starts(_pairs(open_[k]), starts) & ~_starts(_pairs(later[k]), starts)) + off[k - a])
                        rows.append(np.full(len(places[-1]), k, np.int64))
                p, k = np.concatenate(places), np.concatenate(rows)
                own, h, more = open_strings(data, p, turn, rounds)
                p, k = p[own], k[own]
                for i in range(0, len(p), PACK):  # a block is 1 MB, but a very long text is one of its own
                    some = slice(i, i + PACK)
                    held.append((np.array(ids, np.int64)[k[some]], p[some] - off[k[some] - a], h[some], more[some]))
                    n += len(held[-1][1])
                    if n > PACK:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(p, k, b) for p, k, b in zip(pdf["part"], pdf["kind"], pdf["blob"], strict=True) if k >= 0]
        blobs = pdf["blob"][pdf["kind"] < 0]
        if len(blobs):
            doc, at, h, more = (np.concatenate(x) for x in zip(*(unpack(b, *SUFFIXES) for b in blobs), strict=True))
            order, new = first_of((more, h), doc, at)
            later = order[~(new | _same_place(order, new, doc, at))]
            out += _to_parts(doc[later], at[later], LATER, parts)
        return pd.DataFrame(out, columns=["part", "kind", "blob"])

    sent = docs.join(ranges, "doc_id").select("doc_id", "bytes", "later", "open").mapInArrow(run, PARTS)
    return sent.groupBy(F.when(F.col("kind") < 0, F.col("part")).otherwise(-1 - F.col("part"))).applyInPandas(settle, PARTS)


def _single_starts(parts: DataFrame) -> DataFrame:
    """doc_id, more: ranges of single starts, from parts of later suffixes."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, at = (np.concatenate(x) for x in zip(*(unpack(b) for b in pdf["blob"]), strict=True))
        at = at.astype(np.int64)
        return pd.DataFrame([(d, r.astype("<i8").tobytes()) for d, r in _runs(doc, at, at).items()], columns=["doc_id", "more"])

    return parts.groupBy("part").applyInPandas(gather, "doc_id long, more binary")


def removed_spans(later: np.ndarray, more: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs (first, end) of removed bytes of a text of n bytes, from ranges of starts."""
    ranges = np.concatenate([later, more])
    ranges = ranges[ranges[:, 0] <= n - LENGTH]
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    spans = np.stack([ranges[:, 0], np.minimum(ranges[:, 1], n - LENGTH) + LENGTH - 1], 1)
    out = _runs(np.zeros(len(spans), np.int64), spans[:, 0], spans[:, 1])[0]
    return out + np.array([0, 1])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of removed byte ranges: start, end), n_bytes, kept (the remaining bytes) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    size = rows.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    buckets = max(8, -(-size * len(COVER) // PERIOD // BUCKET))
    parts = max(8, -(-size // (32 << 20)))
    rounds = ROUNDS if buckets > 8 else 1

    def by_rounds(step) -> DataFrame:
        """What the rounds of a sort find, each written before the next begins."""
        found = [stored(step(max(8, -(-buckets // rounds)), parts, turn, rounds)) for turn in range(rounds)]
        return functools.reduce(DataFrame.unionByName, found)

    # exact copies: all but the least id of a digest go whole
    digests = rows.filter((F.length("bytes") >= LENGTH) & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("bytes", 256).alias("d"))
    least = digests.groupBy("d").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(digests.join(least, "d").filter("doc_id <> first").select("doc_id").distinct())
    own = rows.filter("doc_id is not null").join(_small(copies), "doc_id", "left_anti")
    ranges = stored(_by_document(by_rounds(functools.partial(_sorted_samples, own))))
    open_ = ranges.filter(F.length("open") > 0)
    more = stored(_single_starts(by_rounds(functools.partial(_sorted_suffixes, own, _small(open_)))))
    hit = ranges.filter(F.length("later") > 0).select("doc_id", "later").join(more, "doc_id", "full")
    hit = stored(hit.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True))

    def cut(batches):
        for batch in batches:
            ids, data, later, more, copy = (batch.column(i).to_pylist() for i in range(5))
            spans, kept = [], []
            for raw, a, b, whole in zip(data, later, more, copy, strict=True):
                own = np.array([[0, len(raw)]]) if whole else removed_spans(_pairs(a), _pairs(b), len(raw))
                edges = [0, *own.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": s, "end": e} for s, e in own.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array([len(r) for r in data], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "spans", "n_bytes", "kept"])

    found = rows.join(_small(hit), "doc_id").select("doc_id", "bytes", "later", "more", "copy").mapInArrow(cut, "doc_id long, spans array<struct<start:long,end:long>>, n_bytes long, kept binary")
    ids = hit.select("doc_id")
    whole = rows.join(_small(ids), "doc_id", "left_anti").select("doc_id", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.length("bytes").cast("long").alias("n_bytes"), F.col("bytes").alias("kept"))
    return found.unionByName(whole)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast while the rows are few and short (ranges are a few dozen bytes a row)."""
    size = df.agg(F.count(F.lit(1)).alias("n"), *([F.coalesce(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in binary)), F.lit(0)).alias("b")] if (binary := [c for c, t in df.dtypes if t == "binary"]) else [F.lit(0).alias("b")])).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and size["b"] <= 32 << 20 else df


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op4_suffix_dedup": f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1),
marked AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM later)),
spans AS (SELECT doc_id, min(i) AS s, max(i) + {LENGTH} AS e FROM marked GROUP BY doc_id, run),
edges AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e NULLS LAST), 0) AS a, s AS b, e FROM edges),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept, count(e) AS n_spans, coalesce(sum(e - b) FILTER (WHERE e IS NOT NULL), 0)::BIGINT AS n_removed FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN cut USING (doc_id)""",
}
