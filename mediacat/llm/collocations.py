"""Phrase collocations by vertical positional lists.

1. Blocks. A task cuts its texts of one language into pieces and words and numbers the words in
   turn, with a number left out between pieces, so that neighbours in a piece have neighbouring
   numbers. A block owns at most BLOCK words and sees the `most` - 1 after them; a phrase belongs
   to the block that owns its first word. A word's list is the rising numbers of its places.
2. Frequent lists. Each block asks for its list lengths: keys are dealt to buckets, a bucket adds
   up a key's lengths over all blocks, which is its exact frequency, numbers the keys that are
   frequent, and answers each block in the order of its question.
3. Extension. In each block the frequent lists of k words are merged by place with the lists one
   place on, of the phrases that end in the adjacent word; what meets is a phrase of k + 1 words
   whose first and last k are both frequent, keyed by the numbers of these two: exact, without
   hashes. Its places are its list, and 2. follows, up to phrases of `most` words.
4. Scores. The levels are joined by number; cuts, dominated phrases and the best of each language
   are plain columns. The best are taken by bucket first, then of these.

The corpus moves as packed lists, a record a block and bucket, once for each level; after level
one only places of frequent neighbours are left. Buckets grow in number with the corpus, and a
hot word, phrase or copied passage is one number a block.

Defined cases: null texts are empty; a null lang is `und`; very long texts are read whole and
span blocks; repeated rows and copies count each time; rows without id count as others do; ties
in score and frequency go by phrase in byte order, ties of cuts to the shortest first part; an
empty table gives no rows; extra columns are dropped. Frequencies and scores are exact (38
decimal digits).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediacat.llm import kernels as K
from mediacat.llm.common import digest_bucket, parted, released, stored, table

#: Words that a block owns (a task holds three times as many of all languages), keys of a bucket, on average.
BLOCK, BUCKET = 1 << 20, 1_500_000
LEAST, MOST, TOP, SCALE = 30, 4, 2000, 2_000_000
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[*b" \t"]] = True
MOVED = "kind string, lang string, block long, bucket int, own long, n long, a binary, b binary, c binary"
ANSWERED = "kind string, lang string, block long, bucket int, a binary, gid long, `left` long, `right` long, word string, f long"


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest whole bytes each, by byte planes, compressed."""
    top = int(values.max()) if len(values) else 0
    kind = np.min_scalar_type(top)
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return struct.pack("<BQ", kind.itemsize, len(values)) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", blob)
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(blob[9:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_lists(places: np.ndarray) -> bytes:
    """Rising places list by list, as differences modulo 2 ** 32."""
    return pack(np.diff(places.astype(np.uint32), prepend=np.uint32(0)))


def unpack_lists(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)) & 0xFFFFFFFF


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of rows, and whether each begins a piece."""
    gap = _GAPS[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts, ends = ~gap, ~gap
    starts[1:] &= gap[:-1] | first[1:-1]
    ends[:-1] &= gap[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    cuts = np.concatenate([[0], np.cumsum(_BREAKS[data] | first[:-1])])
    begins = np.ones(len(starts), bool)
    begins[1:] = cuts[starts[1:] + 1] > cuts[ends[:-1]]
    return starts, ends, begins


def _by_key(key: np.ndarray, places: np.ndarray, n: int) -> tuple[bytes, bytes]:
    """Packed lists of keys 0 to n - 1, and their lengths. places rise."""
    return pack_lists(places[np.argsort(key, kind="stable")]), pack(np.bincount(key, minlength=n))


class Words:
    """Words of one language that a task has read and not yet made a block of."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        starts, ends, begins = spans(K.lowered(data), off)
        inside = ~_GAPS[data]
        self.parts.append((K.lowered(data[inside]), ends - starts, begins))
        self.n += len(starts)

    def blocks(self, size: int, most: int, rest: bool) -> Iterator[tuple[pa.LargeBinaryArray, np.ndarray, int]]:
        """(words, places, how many are owned) of full blocks, and of what is left if asked for."""
        data, length, begins = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        edges = np.concatenate([[0], np.cumsum(length)])
        at = 0
        while self.n - at >= size + most or (rest and at < self.n):
            own = min(size, self.n - at)
            end = min(self.n, at + own + most - 1)
            text = np.ascontiguousarray(data[edges[at] : edges[end]])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer(edges[at : end + 1] - edges[at]), pa.py_buffer(text)])
            yield words, np.cumsum(1 + begins[at:end]), own
            at += own
        self.parts, self.n = ([(data[edges[at] :], length[at:], begins[at:])] if at < self.n else []), self.n - at


def _bucket(word: bytes, buckets: int) -> int:
    return int.from_bytes(word[-8:], "little") * 0x9E3779B97F4A7C15 % 0xFFFFFFFFFFFFFFC5 % buckets


def _indexed(words: pa.LargeBinaryArray, places: np.ndarray, own: int, buckets: int) -> Iterator[dict]:
    """A block's lists of words and its questions, a record a bucket."""
    coded = words.dictionary_encode()
    keys = coded.dictionary.to_pylist()
    bucket = np.array([_bucket(k, buckets) for k in keys], np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy()]
    counts = np.bincount(key[:own], minlength=len(keys))
    a, b = _by_key(key, places, len(keys))
    yield {"kind": "lists", "bucket": 0, "own": int(places[own] if own < len(places) else places[-1] + 1), "n": own, "a": a, "b": b}
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            mine = [keys[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
            yield {"kind": "ask", "bucket": k, "own": 0, "n": len(mine), "a": pa.compress(b"".join(mine), "zstd", asbytes=True), "b": pack(np.array([len(w) for w in mine])), "c": pack(counts[cuts[k] : cuts[k + 1]])}


def _words_of(a: bytes, b: bytes) -> tuple[bytes, np.ndarray]:
    length = unpack(b)
    return pa.decompress(a, int(length.sum()), "zstd", asbytes=True) if length.sum() else b"", length


def _answers(pdf: pd.DataFrame, bucket: int, buckets: int, least: int, words: bool) -> pd.DataFrame:
    """Of one bucket's questions: which keys are frequent over all blocks, numbered; and for each question the numbers plus one, 0 for others."""
    counts = [unpack(c) for c in pdf["c"]]
    if words:
        texts, lengths = zip(*map(_words_of, pdf["a"], pdf["b"]), strict=True)
        edges = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(b"".join(texts))]).dictionary_encode()
        key, n = coded.indices.to_numpy(), len(coded.dictionary)
    else:
        left, right = (np.concatenate([unpack(x) for x in pdf[c]]) for c in ("a", "b"))
        codes, first, key = np.unique(_paired(left, right), return_index=True, return_inverse=True)
        n = len(codes)
    total = np.zeros(n, np.int64)
    np.add.at(total, key, np.concatenate(counts))
    frequent = np.flatnonzero(total >= least)
    number = np.zeros(n, np.int64)
    gid = np.arange(len(frequent)) * buckets + bucket
    number[frequent] = gid + 1
    at = np.cumsum([0] + [len(c) for c in counts])
    said = pd.DataFrame({"kind": "answer", "block": pdf["block"].to_numpy(), "a": [pack(number[key[i:j]]) for i, j in zip(at[:-1], at[1:], strict=True)]})
    found = pd.DataFrame({"kind": "phrase", "gid": gid, "f": total[frequent]})
    if words:
        found["word"] = [w.decode("utf-8", "replace") for w in coded.dictionary.take(pa.array(frequent)).to_pylist()]
    else:
        found["left"], found["right"] = left[first[frequent]], right[first[frequent]]
    return pd.concat([said, found], ignore_index=True)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number a pair; where theirs are too large for that, of their ranks."""
    if len(left) and max(left.max(), right.max()) >= 1 << 31:
        left, right = (np.unique(x, return_inverse=True)[1] for x in (left, right))
    return (left << 32) | right


def _extended(pdf: pd.DataFrame, answers: pd.DataFrame, buckets: int) -> Iterator[dict]:
    """Lists of a block's phrases one word longer, and its questions. pdf: the block's lists; answers: what its questions gave, by bucket."""
    number = np.concatenate([unpack(a) for a in answers.sort_values("bucket")["a"]]) - 1
    length, places, own = unpack(pdf["b"].iloc[0]), unpack_lists(pdf["a"].iloc[0]), int(pdf["own"].iloc[0])
    key = np.repeat(np.arange(len(length)), length)
    frequent = number[key] >= 0
    places, key = places[frequent], key[frequent]
    order = np.argsort(places, kind="stable")
    places, key = places[order], key[order]
    # every place has one phrase of this length at most, so lists meet where places are neighbours
    at = np.flatnonzero(places[1:] - places[:-1] == 1)
    if not len(at):
        return
    codes, new = np.unique((key[at] << 32) | key[at + 1], return_inverse=True)
    left, right = number[codes >> 32], number[codes & 0xFFFFFFFF]
    bucket = (K.mix(K.mix(left.astype(np.uint64)) + right.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((right, left, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    left, right, bucket, new = left[order], right[order], bucket[order], rank[new]
    counts = np.bincount(new[places[at] < own], minlength=len(codes))
    a, b = _by_key(new, places[at], len(codes))
    yield {"kind": "lists", "bucket": 0, "own": own, "n": 0, "a": a, "b": b}
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in range(buckets):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            yield {"kind": "ask", "bucket": k, "own": 0, "n": int(j - i), "a": pack(left[i:j]), "b": pack(right[i:j]), "c": pack(counts[i:j])}


_MOVED = [c.split()[0] for c in MOVED.split(", ")]
_ANSWERED = [c.split()[0].strip("`") for c in ANSWERED.split(", ")]


def _read(docs: DataFrame, buckets: int, most: int, size: int) -> DataFrame:
    """Lists and questions of single words."""

    def run(batches):
        held: dict[str, Words] = {}
        made = 0

        def emit(lang, rest):
            nonlocal made
            for words, places, own in held[lang].blocks(size, most, rest):
                block = (TaskContext.get().partitionId() << 32) | made
                made += 1
                yield pa.RecordBatch.from_pylist([{"c": None, **row, "lang": lang, "block": block} for row in _indexed(words, places, own, buckets)], schema=kind)
            if not held[lang].n:
                del held[lang]

        kind = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("own", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pa.array(langs.indices.to_numpy() == i))
                for _, _, data, off in K.blocks(texts, 4 << 20):
                    held.setdefault(lang, Words()).add(data, off)
                    if held[lang].n >= size + most:
                        yield from emit(lang, False)
                    if sum(w.n for w in held.values()) > 3 * size:
                        yield from emit(max(held, key=lambda k: held[k].n), True)
        for lang in list(held):
            if held[lang].n:
                yield from emit(lang, True)
        released()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, MOVED)


def _asked(asks: DataFrame, buckets: int, least: int, words: bool) -> DataFrame:
    """Answers and frequent phrases of all questions, a bucket of a language at a time."""

    def add(key, pdf):
        out = _answers(pdf, int(key[1]), buckets, least, words)
        out["lang"], out["bucket"] = key
        released()
        return out.reindex(columns=_ANSWERED).astype({c: "Int64" if c in ("block", "gid", "left", "right", "f") else object for c in _ANSWERED if c != "bucket"})

    return asks.select("lang", "bucket", "block", "a", "b", "c").groupBy("lang", "bucket").applyInPandas(add, ANSWERED)


def _longer(lists: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def extend(key, pdf, said):
        rows = [{**r, "lang": key[0], "block": key[1]} for r in _extended(pdf, said, buckets)] if len(pdf) and len(said) else []
        released()
        return pd.DataFrame(rows, columns=_MOVED, dtype=object)

    return lists.select("lang", "block", "own", "a", "b").groupBy("lang", "block").cogroup(answers.select("lang", "block", "bucket", "a").groupBy("lang", "block")).applyInPandas(extend, MOVED)


def levels(docs: DataFrame, least: int = LEAST, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n (words) of each language, and the frequent phrases of 1 to `most` words: lang, gid, f, and word, or left and right (numbers of their first and last words but one)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // (6 * BUCKET)))
    moved = parted(_read(docs, buckets, most, block), "kind", MOVED)
    n = moved.filter("kind = 'lists'").groupBy("lang").agg(F.sum("n").alias("n"))
    out = []
    for k in range(1, most + 1):
        said = parted(_asked(moved.filter("kind = 'ask'"), buckets, least, k == 1), "kind", ANSWERED)
        out.append(said.filter("kind = 'phrase'").select("lang", "gid", "f", *(["word"] if k == 1 else ["left", "right"])))
        if k < most:
            moved = parted(_longer(moved.filter("kind = 'lists'"), said.filter("kind = 'answer'"), buckets), "kind", MOVED)
    return n, out


def phrases(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, cuts (array of k, l, r), inside (array of the frequencies' owners: words and gid of its parts of two words or more), words, gid of all candidates."""
    at = found[0].select("lang", "gid", F.col("f").alias("a"), F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"), F.array().cast("array<struct<size:int,gid:long>>").alias("inside"))
    out = None
    for size, level in enumerate(found[1:], 2):
        side = lambda k: at.select("lang", F.col("gid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("words", "heads", "tails", "inside")])  # noqa: B023, E731
        both = level.join(side("left"), ["lang", "left"]).join(side("right"), ["lang", "right"])
        own = F.array(*[F.struct(F.lit(size - 1).alias("size"), F.col(c).alias("gid")) for c in ("left", "right")]) if size > 2 else F.array().cast("array<struct<size:int,gid:long>>")
        # heads: f of the first 1, 2, ... words; tails: of the last 1, 2, ...
        at = stored(both.select("lang", "gid", F.col("f").alias("a"), F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"), F.concat("left_heads", F.array("f")).alias("heads"), F.concat("right_tails", F.array("f")).alias("tails"), F.array_distinct(F.concat("left_inside", "right_inside", own)).alias("inside")))
        one = at.withColumn("size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("size") - k - 1).alias("r")))
    return out.select("lang", "size", "gid", F.array_join("words", " ").alias("phrase"), "a", cut.alias("cuts"), "inside")


def _score(a: Column, l: Column, r: Column, scale: int) -> Column:  # noqa: E741
    return F.call_function("div", F.lit(scale).cast("decimal(38,0)") * a.cast("decimal(19,0)"), l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))


def mined(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, percent: int = 80, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    n, found = levels(docs, least, most, block)
    all_ = phrases(found)
    longer = all_.select("lang", F.col("a").alias("f"), F.explode("inside").alias("x")).groupBy("lang", F.col("x.size").alias("size"), F.col("x.gid").alias("gid")).agg(F.max("f").alias("f"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    kept = all_.join(longer, ["lang", "size", "gid"], "left").filter(F.col("f").isNull() | (big("f") * 100 < big("a") * percent))
    scored = kept.select("lang", "phrase", "a", F.array_min(F.transform("cuts", lambda c: F.struct(_score(F.col("a"), c["l"], c["r"], scale).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))).alias("cut"))
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    by = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    # a language's best are among the best of its 256 buckets; at most 256 times `top` rows are left of it
    best = by(by(rows.withColumn("_bucket", digest_bucket(F.col("phrase"), digits=2)), "lang", "_bucket").drop("rank", "_bucket"), "lang")
    return best.join(F.broadcast(n) if n.count() <= 10_000 else n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op13_collocations": f"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\n\\x0b\\f\\r]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, s, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.*, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:k], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS i) WHERE i < k),
scored AS (SELECT cuts.lang, cuts.k, cuts.s, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score, i FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = i AND x.s = cuts.x JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - i AND y.s = cuts.y),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, i) = 1),
part AS (SELECT DISTINCT lang, a AS f, array_to_string(w[i:i + j - 1], ' ') AS s FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < k AND i + j - 1 <= k),
longer AS (SELECT lang, s, max(f) AS f FROM part GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, s) WHERE longer.f IS NULL OR 100 * longer.f::HUGEINT < 80 * low.a)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s))::BIGINT AS rank, s AS phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) <= 2000""",
}
