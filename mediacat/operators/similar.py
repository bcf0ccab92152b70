"""Similarity join of frame-hash sequences, without loss, by keys of several bands of a frame.

At similarity t aligned frames differ in at most d = 64 * (1 - t) bits on average, so some
aligned frame differs in d, rounded down, at most. A hash is cut into `wide` bands more than
that; a bit spoils one band at most, so in that frame at least `wide` bands agree: a key of
`wide` bands, about 26 bits of 64 at t = 0.95, which chance meetings are rare on. Candidates are
an equi-join on keys, made distinct, and verified.

A key that more than HOT sequences have (flat frames all hash to zero) makes no candidates, so
there are at most HOT for each key of a sequence, whatever the number of videos. What that could
lose is known: similar sequences share a certain number of keys, and if all of them are hot,
both have at least so many hot ones. Those sequences are joined once more, on their rarest
single bands: in one global order by frequency all but as many as must agree, less one.

Videos of one sequence are first collapsed to it, which the joins then see once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions import hashing
from mediacat.operators.scratch import stored

RATIO, THRESHOLD = 0.7, 0.95
#: Bits of a key at least, where the number of keys of a frame allows; sequences of a key that may meet on it.
BITS, KEYS, HOT = 24, 120, 64


def near_length(a: str, b: str, least: float = RATIO):
    """The shorter sequence has at least `least` of the longer one's frames; empty ones never match."""
    n, m = F.col(a), F.col(b)
    return (F.least(n, m) > 0) & (F.least(n, m) / F.greatest(n, m, F.lit(1)) >= least)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join by shuffles on both sides. Keys exploded from frames are many times what the planner takes them for, so it would broadcast all of them, through the driver."""
    return df.hint("merge")


def _banded(f: DataFrame, key: str, count: int) -> DataFrame:
    frames = f.select(key, F.posexplode("hashes").alias("frame", "h"))
    return frames.select(key, "frame", F.inline(hashing.bands(F.col("h"), count)))


def _rarest(banded: DataFrame, often: DataFrame, key: str, count: int, threshold: float, ratio: float) -> DataFrame:
    """key and the bands (frame, band, value) among which a similar sequence must have one too: the rarest, as many as the bound asks for."""
    n = F.col(f"{key}.n")
    least = F.ceil(n * ratio - 1e-9)  # frames of the shortest sequence that may match
    agree = count * least - F.floor(64 * (1 - threshold) * least + 1e-6)
    ranked = banded.join(dealt(often), ["frame", "band", "value"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("often", F.xxhash64("frame", "band", "value").alias("tie"), "frame", "band", "value"))).alias("all"))
    return ranked.select(key, F.inline(F.slice("all", F.lit(1), (count * n - agree + 1).cast("int")))).select(key, "frame", "band", "value")


def sequences(videos: DataFrame) -> DataFrame:
    """videos (video, hashes, n) with `sequence`: what videos of the same hashes share (128 bits and the length)."""
    return videos.withColumn("sequence", F.struct(F.xxhash64("hashes").alias("h"), F.xxhash64(F.lit("2"), F.col("hashes")).alias("k"), F.col("n").cast("int").alias("n")))


def key_bands(threshold: float) -> tuple[int, int]:
    """Bands of a hash, and how many of them are a key."""
    spoiled, wide = hashing.band_count(threshold) - 1, 1
    while 64 * wide / (spoiled + wide) < BITS and math.comb(spoiled + wide + 1, wide + 1) <= KEYS:
        wide += 1
    return spoiled + wide, wide


def least_shared(threshold: float) -> float:
    """Keys that similar sequences share for each aligned frame at least: a frame that differs in e bits has comb(bands - e, wide) of them left, which is convex in e, so an even spread is the worst."""
    count, wide = key_bands(threshold)
    mean = 64 * (1 - threshold)
    low = math.floor(mean + 1e-9)
    keys = lambda e: math.comb(max(0, count - e), wide)
    return keys(low) + (mean - low) * (keys(low + 1) - keys(low))


def _keyed(f: DataFrame, key: str, threshold: float) -> DataFrame:
    """key and k: a number for each key of `wide` bands of each frame."""
    count, wide = key_bands(threshold)
    frames = f.select(key, F.posexplode("hashes").alias("frame", "h")).select(key, "frame", hashing.bands(F.col("h"), count).alias("bands"))
    values = lambda chosen: [F.get("bands", F.lit(i))["value"] for i in chosen]
    return frames.select(key, F.explode(F.array(*[F.xxhash64("frame", F.lit(c), *values(chosen)) for c, chosen in enumerate(itertools.combinations(range(count), wide))])).alias("k"))


def _by_rarest_band(sa: DataFrame, sb: DataFrame, threshold: float) -> DataFrame:
    count = hashing.band_count(threshold) + 1
    a, b = _banded(sa, "sa", count), _banded(sb, "sb", count)
    # one order of bands for both sides, by how many sequences have them
    often = a.select("frame", "band", "value").unionByName(b.select("frame", "band", "value")).groupBy("frame", "band", "value").agg(F.count(F.lit(1)).alias("often"))
    a, b = _rarest(a, often, "sa", count, threshold, RATIO), _rarest(b, often, "sb", count, threshold, RATIO)
    return a.join(dealt(b), ["frame", "band", "value"]).select("sa", "sb")


def candidates(sa: DataFrame, sb: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sa, sb of near lengths that may be similar, each once; sa, sb: distinct sequences (sa or sb, hashes)."""
    a, b = _keyed(sa, "sa", threshold), _keyed(sb, "sb", threshold)
    both = a.select("k", F.lit(1).alias("l")).unionByName(b.select("k", F.lit(0).alias("l")))
    often = both.groupBy("k").agg(F.sum("l").alias("x"), F.count(F.lit(1)).alias("n")).filter("x > 0 and n > x")
    often = stored(often)
    rare, hot = often.filter(F.col("n") <= HOT).select("k"), often.filter(F.col("n") > HOT).select("k")
    met = a.join(dealt(rare), "k").join(dealt(b), "k").select("sa", "sb")

    def heavy(keyed: DataFrame, side: str, sequences: DataFrame) -> DataFrame:
        """Sequences with as many hot keys as they share with a similar one at least."""
        n = F.ceil(F.ceil(F.col(f"{side}.n") * RATIO - 1e-9) * least_shared(threshold) - 1e-9)
        often = keyed.join(dealt(hot), "k").groupBy(side).agg(F.count(F.lit(1)).alias("hot")).filter(F.col("hot") >= n)
        return sequences.join(dealt(often.select(side)), side, "left_semi")

    if not hot.isEmpty():
        met = met.unionByName(_by_rarest_band(stored(heavy(a, "sa", sa)), stored(heavy(b, "sb", sb)), threshold))
    return met.filter(near_length("sa.n", "sb.n")).distinct()


def sequence_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sa, sb, similarity of all distinct sequences (see `sequences`) of the two sides at the threshold or above, lengths near.

    A sequence stands for all its videos, so a hot one is one row a side.
    """
    sa, sb = (stored(df.groupBy(F.col("sequence").alias(k)).agg(F.first("hashes").alias("hashes"))) for df, k in ((left, "sa"), (right, "sb")))
    both = candidates(sa, sb, threshold).join(dealt(sa.withColumnRenamed("hashes", "ha")), "sa").join(dealt(sb.withColumnRenamed("hashes", "hb")), "sb")
    return both.withColumn("similarity", hashing.similarity(F.col("ha"), F.col("hb"))).filter(F.col("similarity") >= threshold).select("sa", "sb", "similarity")


def pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of all left and right videos (video, hashes, n) at the threshold or above: every pair of copies is a row, so for reports, not for choosing."""
    left, right = sequences(left), sequences(right)
    close = sequence_pairs(left, right, threshold)
    return close.join(dealt(left.select(F.col("video").alias("a"), F.col("sequence").alias("sa"))), "sa").join(dealt(right.select(F.col("video").alias("b"), F.col("sequence").alias("sb"))), "sb").select("a", "b", "similarity")


def best(probes: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity: the most similar index video (video, hashes, n, insert_seq) of each probe; the earliest on ties.

    The choice is made among distinct sequences, each standing for its earliest video; probes are joined to it after.
    """
    probes, index = sequences(probes), sequences(index)
    first = index.groupBy(F.col("sequence").alias("sb")).agg(F.min(F.struct("insert_seq", "video")).alias("first"))
    found = sequence_pairs(probes, index, threshold).join(dealt(first), "sb")
    top = F.max_by(F.struct(F.col("first.video").alias("b"), "similarity"), F.struct("similarity", -F.col("first.insert_seq")))
    chosen = found.groupBy(F.col("sa").alias("sequence")).agg(top.alias("t"))
    return probes.join(dealt(chosen), "sequence").select(F.col("video").alias("a"), "t.b", "t.similarity")


def links(videos: DataFrame, others: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity with a < b: every video of `videos` against itself and `others` (video, hashes, n)."""
    found = pairs(videos, videos.unionByName(others), threshold).filter("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()
