"""Similarity join on word n-gram sets (Jaccard), by prefix filters under several global orders.

Documents with equal sets form one class, which its least id stands for. Between classes:

1. Survivors. A linked document shares at least the threshold's part of its shingles with
   other sets. Shingle hashes are dealt to buckets (packed by task, five bytes each), equal
   ones of different sets are found bucket by bucket, and documents with too few shared
   shingles leave. On real corpora that is nearly all of them. A task counts the shingles
   that several of its own sets have and sends one record of each, so a common shingle is
   no hot bucket.
2. Orders. Survivors' shingles are ordered by rarity under three global orders (exact
   frequency, and twice its power of two, each with its own hash for ties). In every order a
   linked pair shares a shingle among the first n - ceil(t * n) + 1 of both sets. Candidates
   come from the first order and must also meet in the second and third, and in size, where
   single shingles, which no other set has, count against both, and so does what stands before
   the first common shingle (the positional filter).
3. Verification counts the common shingles of a candidate pair.

No group's pairs are all emitted: each prefix shingle first names a few leaders, which all
its documents are compared with, and verified links join components. After each round only
shingles that still hold several components go on, with other leaders. When rounds end, all
candidate pairs across components are verified, so no component is missed: a pair in one
component needs no link of its own.

Defined cases: words are split at space and bytes 9 to 13 and A to Z lowered; texts with
fewer words than n are one shingle; texts without words and null texts have no shingles, are
linked with nothing and are their own component; very long texts are read whole, as blocks of
their own; rows are linked by their own sets, so rows that share an id and differ in text may
lie in different components; copies of a set are one class, and ties between leaders go by hash
and class; rows without id are linked with rows of the same set only, and are never dropped; an
empty table gives no rows; extra columns are dropped, by `representatives` passed through, which
drops by row: of a component the class with the least id stays (of two such classes one), with
the rows of that id in it, be they several. Shingles count as equal by 64-bit hash (polynomials modulo
two primes, scrambled), classes by 128 bits over their set.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import kernels as K
from mediacat.llm.common import released, stored, table, turn
from mediacat.operators.graph import components

#: A side of at most so many rows of two numbers is broadcast.
BROADCAST_ROWS = 1_000_000
#: Shingles of a bucket of the survivors' step, on average, and shingles that a task packs at once.
BUCKET, PACK = 700_000, 500_000
#: Stands for several sets that a task has met a shingle in.
SEVERAL = np.uint64(0)
LEADER_ROUNDS = 3


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct shingles of each row, by row, then hash."""
    low = K.lowered(data)
    starts, ends = K.word_spans(low, off)
    rows = K.row_of(off, starts)
    word = K.Rolling(low).of(starts, ends)
    h = word.copy()
    for k in range(1, n):
        h = K.mix(h[: len(word) - k]) + word[k:] if len(word) > k else h[:0]
    whole = rows[n - 1 :] == rows[: max(0, len(rows) - n + 1)]
    of, h = rows[: len(h)][whole], K.mix(h[whole])
    # rows with fewer words: all of them as one shingle, marked by their number
    counts = np.bincount(rows, minlength=len(off) - 1)
    firsts = np.searchsorted(rows, np.arange(len(off) - 1))
    for few in range(1, n):
        at = np.flatnonzero(counts == few)
        if len(at):
            x = word[firsts[at]]
            for k in range(1, few):
                x = K.mix(x) + word[firsts[at] + k]
            of, h = np.concatenate([of, at]), np.concatenate([h, K.mix(x + np.uint64(few << 56))])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values over each row (of is sorted), modulo 2 ** 64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    at = np.searchsorted(of, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def signature(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and two 64-bit sums that stand for each row's set."""
    return np.bincount(of, minlength=n), sums(of, K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), n), sums(of, K.mix(h + np.uint64(0x1234567890ABCDEF)), n)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        turn("ngram_join")
        for batch in batches:
            for a, b, data, off in K.blocks(batch.column(1)):
                size, s1, s2 = signature(*shingles(data, off, n), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), batch.column(2).slice(a, b - a)], names=["doc_id", "n", "s1", "s2", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, text_hash long")


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and the row after the last of each run of equal keys."""
    edges = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _packed(owner: np.ndarray, h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, -1, blob) of (set, shingle) pairs: number of runs, each run's set and length, five bytes of each shingle."""
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    owner, h, bucket = owner[order], h[order], bucket[order]
    for a, b in _cuts(bucket):
        runs = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        lengths = np.diff(np.append(runs, b - a)).astype("<u4")
        low = h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        yield int(bucket[a]), -1, b"".join([np.array([len(runs)], "<u8").tobytes(), owner[a:b][runs].astype("<u8").tobytes(), lengths.tobytes(), low.tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(blob, "<u8", 1)[0])
    owner, lengths = np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, "<u4", k, 8 + 8 * k)
    low = np.frombuffer(blob, np.uint8, offset=8 + 12 * k).reshape(-1, 5)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :5] = low
    return np.repeat(owner, lengths), wide.view("<u8").ravel()


def _settled(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (set, shingle) pairs: the pairs, each once, whose shingle has several sets or SEVERAL, sorted; and which of them are first of their shingle."""
    order = np.lexsort((owner, h))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    fresh = new.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    owner, h, new = owner[fresh], h[fresh], new[fresh]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    mixed = np.repeat((size > 1) | (owner[first] == SEVERAL) if len(h) else np.zeros(0, bool), size)
    return owner, h, np.where(mixed, np.where(new, 2, 1), 0)


def _counts(owner: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, 0, blob): how often each set occurs, by part of the sets."""
    sets, shared = np.unique(owner, return_counts=True)
    part = (K.mix(sets) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for a, b in _cuts(part[order]):
        yield int(part[order[a]]), 0, np.stack([sets[order[a:b]], shared[order[a:b]].astype(np.uint64)]).astype("<u8").tobytes()


def _sent(owner: np.ndarray, h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """What a task sends: shingles of one of its sets; one record, for SEVERAL, of those that it has in several; and its counts of these."""
    owner, h, mixed = _settled(owner, h)
    yield from _counts(owner[mixed > 0], buckets)
    sent = mixed != 1
    yield from _packed(np.where(mixed == 2, SEVERAL, owner)[sent], h[sent], buckets)


def _shared_counts(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """For each set, how many of the bucket's shingles it shares with another set; packed by part of the sets."""
    out = [(p, b) for p, k, b in zip(pdf["bucket"], pdf["kind"], pdf["blob"], strict=True) if k >= 0]
    blobs = pdf["blob"][pdf["kind"] < 0]
    if len(blobs):
        owner, _, mixed = _settled(*(np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True)))
        out += [(p, b) for p, _, b in _counts(owner[(mixed > 0) & (owner != SEVERAL)], parts)]
        del owner, mixed
        released()
    return pd.DataFrame({"part": pd.Series([p for p, _ in out], dtype="int64"), "blob": pd.Series([b for _, b in out], dtype=object)})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a part's packed counts by set."""
    sets, shared = np.concatenate([np.frombuffer(b, "<u8").reshape(2, -1) for b in pdf["blob"]], axis=1)
    own, at = np.unique(sets, return_inverse=True)
    return pd.DataFrame({"s1": own.view(np.int64), "shared": np.bincount(at, shared.astype(np.int64)).astype(np.int64)})


def survivors(docs: DataFrame, classes: DataFrame, n: int, least: Fraction) -> DataFrame:
    """id, rep, s1 of the classes that share enough shingles to link with another.

    Copies of a set in several tasks may count a shingle more than once, which can only let
    more classes stay.
    """
    can = classes.filter(F.col("n") * (least.denominator - least.numerator) >= least.numerator)
    total = classes.agg(F.coalesce(F.sum(F.col("n") * F.least("copies", F.lit(8))), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET))

    def run(batches):
        turn("ngram_join")
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for _, _, data, off in K.blocks(batch.column(0)):
                of, h = shingles(data, off, n)
                _, s1, _ = signature(of, h, len(off) - 1)
                parts.append((s1[of], h))
                held += len(h)
                if held > PACK:
                    yield _batch(parts)
                    parts, held = [], 0
        if held:
            yield _batch(parts)
        released()

    def _batch(parts):
        rows = list(_sent(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

    dealt = docs.select("text").mapInArrow(run, "bucket long, kind int, blob binary")
    bucket = F.when(F.col("kind") < 0, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    shared = dealt.groupBy(bucket).applyInPandas(lambda pdf: _shared_counts(pdf, buckets), "part long, blob binary").groupBy("part").applyInPandas(_added, "s1 long, shared long")
    return can.join(shared, "s1").filter(F.col("shared") * least.denominator >= F.col("n") * least.numerator).select("id", "rep", "s1")


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _token_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """id, tokens (sorted distinct shingle hashes) of the chosen classes, from rows of the ids that stand for them."""

    def run(batches):
        turn("ngram_join")
        for batch in batches:
            for a, b, data, off in K.blocks(batch.column(1)):
                of, h = shingles(data, off, n)
                at = np.searchsorted(of, np.arange(b - a + 1))
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                _, s1, _ = signature(of, h, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s1.view(np.int64)), sets], names=["rep", "s1", "tokens"])

    own = docs.select(F.col("doc_id").cast("long"), "text").join(_small(chosen.select(F.col("rep").alias("doc_id")).distinct()), "doc_id").select("doc_id", "text")
    # an id may have rows of other sets, too
    found = own.mapInArrow(run, "rep long, s1 long, tokens array<long>").join(_small(chosen), ["rep", "s1"])
    return found.groupBy("id").agg(F.first("tokens").alias("tokens"))


def _prefixes(sets: DataFrame, least: Fraction) -> DataFrame:
    """id, n, u (shingles of no other set), weight (mean frequency of the set's shingles), and the shared prefix shingles a, b, c of three orders."""
    each = sets.select("id", F.explode("tokens").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    tier = "cast(floor(log2(cast(x.df as double)) + 1e-9) as long)"
    rows = each.join(often, "h").groupBy("id").agg(F.collect_list(F.struct("df", "h")).alias("all")).withColumn("n", F.size("all").cast("long"))
    keep = f"cast(n - ceil(n * {least.numerator} / {least.denominator} - 1e-9) + 1 as int)"
    order = lambda by: F.expr(f"transform(filter(slice(sort_array(transform(all, x -> struct({by}, x.h, x.df))), 1, {keep}), x -> x.df > 1), x -> x.h)")
    weight = F.expr("aggregate(all, 0D, (s, x) -> s + x.df) / n")
    single = F.expr("cast(size(filter(all, x -> x.df = 1)) as long)")
    return rows.select("id", "n", single.alias("u"), weight.alias("weight"), order("x.df as k, 0L as r").alias("a"), order(f"{tier} as k, xxhash64(x.h, 1) as r").alias("b"), order(f"{tier} as k, xxhash64(x.h, 2) as r").alias("c"))


def _can_link(least: Fraction, n: str = "n", u: str = "u", n2: str = "n2", u2: str = "u2"):
    """Whether two sets may link if they share all but their single shingles: the most their sizes allow."""
    most = F.least(F.col(n) - F.col(u), F.col(n2) - F.col(u2))
    return most * least.denominator >= least.numerator * (F.col(n) + F.col(n2) - most)


def _verified(pairs: DataFrame, prefix: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a < b) that meet in size and in the second and third order and link."""
    side = lambda k: prefix.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("u").alias(f"u{k}"), F.col("b").alias(f"b{k}"), F.col("c").alias(f"c{k}"))
    p, q = least.numerator, least.denominator
    near = pairs.join(side("x"), "x").join(side("y"), "y").filter(_can_link(least, "nx", "ux", "ny", "uy") & F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy")).select("x", "y")
    own = lambda k: sets.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}"))
    both = near.join(own("x"), "x").join(own("y"), "y").withColumn("shared", F.size(F.array_intersect("tx", "ty")))
    return both.filter(F.col("shared") * q >= p * (F.size("tx") + F.size("ty") - F.col("shared"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def link(sets: DataFrame, least: Fraction) -> DataFrame:
    """id, comp of all sets; sets: id, tokens (distinct)."""
    prefix = stored(_prefixes(sets, least))
    found = stored(prefix.select("id", F.col("id").alias("comp")))
    # u: shingles before this one in the first order, single ones first; no pair that meets first here shares them
    at = stored(prefix.select("id", "n", "u", "weight", F.posexplode("a").alias("place", "token")).withColumn("u", F.col("u") + F.col("place")).drop("place"))
    for turn in range(LEADER_ROUNDS + 1):
        placed = at.join(found, "id")
        mixed = placed.groupBy("token").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.array_distinct(F.array(
                F.min(F.struct(-F.col("weight"), F.xxhash64("id", F.lit(turn)), "id"))["id"],
                F.min(F.struct(F.xxhash64("id", F.lit(100 + turn)), "id"))["id"],
                F.min(F.struct(F.xxhash64("id", F.lit(200 + turn)), "id"))["id"],
            )).alias("leaders"),
        ).filter("low <> high")
        # a hot token is one row here; broadcast, it needs no exchange of its documents
        mixed = _small(stored(mixed.select("token", "leaders")), BROADCAST_ROWS // 10)
        if turn < LEADER_ROUNDS:
            led = placed.join(mixed, "token").select("id", "comp", F.explode("leaders").alias("leader")).filter("id <> leader").distinct()
            led = led.join(found.select(F.col("id").alias("leader"), F.col("comp").alias("other")), "leader").filter("comp <> other")
            pairs = led.select(F.least("id", "leader").alias("x"), F.greatest("id", "leader").alias("y")).distinct()
        else:
            rest = placed.join(mixed.select("token"), "token").select("token", "id", "comp", "n", "u")
            other = rest.select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "comp", "n", "u")])
            pairs = rest.join(other, "token").filter((F.col("comp") < F.col("comp2")) & _can_link(least)).select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).distinct()
        found = stored(components(found, stored(_verified(pairs, prefix, sets, least))))
    return found


def joined(docs: DataFrame, n: int = 3, least: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles, class_id (the least id with the same set), component_id, text_hash and stays (whether the row is of its component's first class and id) of every row."""
    signs = stored(_signed(docs, n))
    # classes have numbers of their own: an id may stand for several
    classes = stored(signs.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    chosen = stored(survivors(docs, classes, n, least))
    comps = stored(link(stored(_token_sets(docs, chosen, n)), least))
    first = comps.join(classes.select("id", "rep"), "id").groupBy("comp").agg(F.min(F.struct("rep", "id")).alias("first"))
    of = comps.join(first, "comp").select("id", "first")
    named = classes.join(of, "id", "left").select("n", "s1", "s2", "rep", F.coalesce("first.rep", "rep").alias("comp"), F.coalesce(F.col("first.id") == F.col("id"), F.lit(True)).alias("leads"))
    out = signs.join(named, ["n", "s1", "s2"], "left")
    stays = F.coalesce(F.col("leads") & (F.col("doc_id") == F.col("rep")), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("comp", "doc_id").alias("component_id"), "text_hash", stays.alias("stays"))


def representatives(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs, all columns, of the first class of each component only, and those without words or id."""
    others = _small(stored(joined(docs, n, least).filter("not stays and doc_id is not null").select(F.col("doc_id").alias("_other"), F.col("text_hash").alias("_hash")).distinct()))
    return docs.join(others, (docs["doc_id"] == others["_other"]) & (F.xxhash64(docs["text"]) == others["_hash"]), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("text_hash", "stays")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
SQL = {
    "op5_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, list_slice(w, i, i + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) UNION ALL SELECT doc_id, w FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(g)) AS c FROM (SELECT doc_id, list(array_to_string(s, chr(1))) AS g FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(classes.c, w.doc_id) AS class_id, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN classes USING (doc_id)""",
}
