"""The order-dependent part of a run: each source sees the index that earlier ones left.

A source is deduplicated onto the most similar index entry (the earliest on ties) unless it has
better quality; then it becomes an entry itself, every mapping of the old one moves to it and the
old one leaves the index. That is a fold in key order, not clustering.

The fold is computed as a fixed point of joins. Guessed entries, each with the video that ends it,
give every video its choice among those that are open at its place; the choices give entries again.
A video depends on earlier ones only, so each round settles at least one more video of any chain,
the fixed point is unique and it is the fold. The first guess folds each group of sequences around
their least neighbour by itself, which is right wherever near copies are all linked with each other;
later rounds look only at sequences whose neighbours' entries changed. Rounds grow with the longest chain of decisions across
sequences, not with the number of videos, and no component is gathered anywhere.

Videos of one sequence share its links, so copies are never paired: a round joins videos with the
entries of linked sequences, and a sequence has one open entry at a time, or its known ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.operators.scratch import stored


def fold(videos: list[tuple], similar: dict[tuple, float], threshold: float) -> list[tuple]:
    """(video, outcome, target at the time, target in the end) of (video, pixels, kbps, known) in order, on one machine: what `greedy` is tested against. Known ones are entries without being judged."""
    entries: list[tuple] = []
    out, repoint = [], {}
    for video, pixels, kbps, *known in videos:
        if known and known[0]:
            entries.append((video, pixels, kbps))
            out.append((video, "known", video))
            continue
        best, top = None, threshold
        for entry in entries:
            s = similar.get((min(video, entry[0]), max(video, entry[0])), 0.0)
            if s >= top and (best is None or s > top):
                best, top = entry, s
        if best is not None:
            better = pixels > best[1] if pixels != best[1] else (kbps is not None and best[2] is not None and kbps > best[2])
            if not better:
                out.append((video, "deduped", best[0]))
                continue
            entries.remove(best)
            repoint[best[0]] = video
        entries.append((video, pixels, kbps))
        out.append((video, "replaced" if best else "transcoded", video))

    def last(v):
        while v in repoint:
            v = repoint[v]
        return v

    return [(v, o, t, last(t)) for v, o, t in out]


def _records(videos: DataFrame, links: DataFrame) -> DataFrame:
    """video, until of the entries that each group would make by itself: known ones, its first video, and each that is better than all before it, until the next.

    Sequences are grouped by the least one that they are linked with. A running maximum in two
    levels: ranges of (group, video) in tasks, then what went before each range; a hot group is
    spread over many ranges. Equal quality with an unknown bit rate may be guessed wrong here,
    which a later round mends.
    """
    both = links.select("sa", "sb").unionByName(links.select(F.col("sb").alias("sa"), F.col("sa").alias("sb")))
    least = both.groupBy(F.col("sa").alias("sequence")).agg(F.min("sb").alias("least"))
    grouped = videos.join(least, "sequence", "left").select(F.when(F.col("least") < F.col("sequence"), F.col("least")).otherwise(F.col("sequence")).alias("group"), "video", F.struct("pixels", "kbps").alias("rate"))
    ranged = stored(grouped.repartitionByRange("group", "video").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy("group", "range").agg(F.max("rate").alias("top")).select("group", "range", F.max("top").over(before).alias("carry"))
    inside = Window.partitionBy("group", "range").orderBy("video")
    top = F.max("rate").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    top = F.when(F.col("carry").isNull() | (top > F.col("carry")), top).otherwise(F.col("carry"))
    best = stored(ranged.join(carry, ["group", "range"]).withColumn("top", top).filter(F.col("top").isNull() | (F.col("rate") > F.col("top"))).select("group", "range", "video"))
    after = Window.partitionBy("group").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    later = best.groupBy("group", "range").agg(F.min("video").alias("first")).select("group", "range", F.min("first").over(after).alias("later"))
    best = best.withColumn("next", F.lead("video").over(inside)).join(later, ["group", "range"])
    best = best.select("video", F.coalesce("next", "later").alias("until"))
    return best.unionByName(videos.filter("known").select("video", F.lit(None).cast(videos.schema["video"].dataType).alias("until")).join(best, "video", "left_anti"))


def _better() -> Column:
    return F.when(F.col("pixels") != F.col("best.pixels"), F.col("pixels") > F.col("best.pixels")).otherwise(F.coalesce(F.col("kbps") > F.col("best.kbps"), F.lit(False)))


def _choices(videos: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """video, target, better: the entry that each judged video meets, if any, and whether it has better quality."""
    entries = entries.select(F.col("sequence").alias("sb"), "until", F.col("video").alias("u"), "pixels", "kbps")
    offer = F.struct((-F.col("similarity")).alias("far"), F.col("u").alias("video"), "pixels", "kbps")
    offers = links.join(entries, "sb").select(F.col("sa").alias("sequence"), "until", offer.alias("offer"))
    met = videos.join(offers, "sequence").filter((F.col("offer.video") < F.col("video")) & (F.col("until").isNull() | (F.col("until") >= F.col("video"))))
    return met.groupBy("video").agg(F.min("offer").alias("best"), F.first("pixels").alias("pixels"), F.first("kbps").alias("kbps")).select("video", F.col("best.video").alias("target"), _better().alias("better"))


def _entries(videos: DataFrame, choices: DataFrame) -> DataFrame:
    """sequence, video, pixels, kbps, until of the entries that the choices make."""
    ended = choices.filter("better").groupBy(F.col("target").alias("video")).agg(F.min("video").alias("until"))
    return videos.join(choices.filter("not better").select("video"), "video", "left_anti").join(ended, "video", "left").select("sequence", "video", "pixels", "kbps", "until")


def greedy_by_sequence(videos: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """video, outcome, target, final.

    videos: video (unique; a number or text, judged in its order), sequence (what copies share),
    width, height, kbps, and known (boolean) if some are entries without being judged; links: sa, sb,
    similarity for judged videos of sequence sa and entries of sequence sb, a sequence with itself
    included where its copies are similar. Nothing is linked below the threshold. A null
    width or height counts as 0, a null bit rate is never better nor worse.
    """
    known = F.coalesce("known", F.lit(False)) if "known" in videos.columns else F.lit(False)
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    every = stored(videos.select("video", "sequence", pixels.alias("pixels"), F.col("kbps").cast("long").alias("kbps"), known.alias("known")))
    links = stored(links.filter(F.col("similarity") >= threshold).groupBy("sa", "sb").agg(F.max("similarity").alias("similarity")))
    judged = every.filter("not known")
    entries = stored(every.join(_records(every, links), "video").select("sequence", "video", "pixels", "kbps", "until"))
    choices = stored(_choices(judged, links, entries))
    while True:
        found = stored(_entries(every, choices))
        both = entries.unionByName(found).groupBy("sequence", "video", "until").agg(F.count(F.lit(1)).alias("n"))
        changed = both.filter("n = 1").select(F.col("sequence").alias("sb")).distinct()
        again = stored(links.join(changed, "sb", "left_semi").select(F.col("sa").alias("sequence")).distinct())
        if again.isEmpty():
            break
        open_ = stored(judged.join(again, "sequence", "left_semi"))
        choices = stored(choices.join(open_.select("video"), "video", "left_anti").unionByName(_choices(open_, links, found)))
        entries = found
    end = _ends(choices.filter("better").select("target", "video"))
    out = every.join(choices, "video", "left")
    outcome = F.when(F.col("known"), "known").when(F.col("better").isNull(), "transcoded").when(F.col("better"), "replaced").otherwise("deduped")
    out = out.select("video", outcome.alias("outcome"), F.when(~F.col("better"), F.col("target")).otherwise(F.col("video")).alias("target"))
    return out.join(end, "target", "left").select("video", "outcome", "target", F.coalesce("final", "target").alias("final"))


def _ends(moves: DataFrame) -> DataFrame:
    """target, final: where chains of moves (target, video) end, doubling the step until none moves on."""
    ends = stored(moves.select("target", F.col("video").alias("final")))
    while True:
        onward = ends.select(F.col("target").alias("final"), F.col("final").alias("_far"))
        if ends.join(onward, "final", "left_semi").isEmpty():
            return ends
        ends = stored(ends.join(onward, "final", "left").select("target", F.coalesce("_far", "final").alias("final")))


def greedy(videos: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """As `greedy_by_sequence`, for links between videos: a, b, similarity with a < b."""
    one = videos.withColumn("sequence", F.col("video"))
    both = links.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "similarity").unionByName(links.select(F.col("b").alias("sa"), F.col("a").alias("sb"), "similarity"))
    return greedy_by_sequence(one, both, threshold)
