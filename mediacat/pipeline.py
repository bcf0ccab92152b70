"""Whole passes over a catalog that lives in a TableStore: video, image, cleanup.

A pass reads the state once, decides for every source set-at-a-time, and commits all changed
tables together, so one that stops anywhere has changed nothing and is simply run again.
Objects that a commit gives up are rows of its table `trash` until `empty_trash` has deleted
them. Decoding and hashing are callables over the sources that are left after all cheap gates.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import hashing, keys, media
from mediacat.operators import cleanup, gates, resolve, scratch, similar, state
from mediacat.sources import listing

MAPPING = "source_key string, source_etag string, source_size long, source_last_modified string, content_id string, hls_root string, encoded_at string, encoder_version string"
IMAGE_MAPPING = "source_key string, source_etag string, source_size long, source_last_modified string, pdq_hash string, quality int, hashed_at string, hasher_version string"
TOMBSTONE = "source_key string, source_etag string, source_size long, source_last_modified string, error string, failed_at string, attempts int, encoder_version string"
OUTPUT = "content_id string, rel_path string"
INDEX = "content_id string, interval_seconds double, hash_count int, width int, height int, video_bitrate_kbps int, encoded_at string, insert_seq long"
BLOB = "content_id string, blob binary"
LEASE = "content_id string, worker string, until double"
MARK = "name string, mark string"
_RUNG = "name:string,width:int,height:int,video_bitrate_kbps:int,audio_bitrate_kbps:int"
METADATA = f"content_id string, encoder_version string, encoded_at string, source struct<width:int,height:int,duration_seconds:double,bitrate_kbps:int>, ladder array<struct<{_RUNG}>>"
#: Seconds between two frames of a fingerprint.
INTERVAL = 2.0


@dataclass
class Pass:
    store: state.TableStore
    at: str
    version: str
    prefix: str = ""
    max_attempts: int = gates.MAX_ATTEMPTS
    budget: int | None = None
    threshold: float = similar.THRESHOLD
    perceptual_dry_run: bool = False
    ladder: tuple = media.LADDER
    #: With a name, contents are leased for so many seconds before they are decoded.
    worker: str | None = None
    lease_seconds: float = 5400.0
    clock: Callable[[], float] = time.time

    def _open(self, sources: DataFrame, mappings: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
        seen = gates.blocked(gates.cached(sources, mappings), tombstones, self.max_attempts)
        skipped = seen.filter("cached or blocked").select("source_key", F.when(F.col("cached"), "cached").otherwise("errored").alias("outcome"))
        work = seen.filter("not cached and not blocked").select("source_key", "etag", "size", "last_modified")
        return skipped, gates.within_budget(work, self.budget) if self.budget is not None else work

    def _summary(self, outcome: DataFrame) -> dict:
        return gates.summary(outcome).first().asDict()

    def _source(self) -> list[Column]:
        return [F.col("source_key"), F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), keys.utc_iso(F.col("last_modified")).alias("source_last_modified")]

    def _tombstones(self, table: str, done: DataFrame, failed: DataFrame) -> tuple:
        """The change of a table of tombstones: those of sources that are done go."""
        rows = lambda c: state.failures(c.read(table, TOMBSTONE), failed.select(*self._source(), "error"), self.at, self.version)
        return table, TOMBSTONE, "source_key", rows, done

    def _claimed(self, wanted: DataFrame) -> DataFrame:
        """content_id of the wanted contents that this worker has leased now; live leases of others stay."""

        def free(now):
            def rows(commit):
                taken = commit.read("leases", LEASE).filter((F.col("until") > now) & (F.col("worker") != self.worker))
                return wanted.select("content_id").distinct().join(taken, "content_id", "left_anti").select("content_id", F.lit(self.worker).alias("worker"), F.lit(now + self.lease_seconds).alias("until"))

            return rows

        now = self.clock()
        state.apply(self.store, [("leases", LEASE, "content_id", free(now), None)])
        return self.store.read("leases", LEASE).filter((F.col("worker") == self.worker) & (F.col("until") > now)).join(wanted, "content_id", "left_semi").select("content_id")

    def _resolved(self, fresh: DataFrame, seen: DataFrame, index: DataFrame, blobs: DataFrame) -> DataFrame:
        """content_id, outcome, final (content ids) of fresh contents and known entries; fresh: source_key, content_id; seen: what was probed of them."""
        known = index.join(blobs, "content_id").select("content_id", "width", "height", F.col("video_bitrate_kbps").alias("kbps"), hashing.blob_hashes(F.col("blob")).alias("hashes"), F.concat(F.lit("0"), F.lpad(F.col("insert_seq").cast("string"), 20, "0")).alias("video"))
        new = fresh.join(seen, "content_id").select("content_id", "width", "height", F.col("bitrate_kbps").alias("kbps"), "hashes", F.concat(F.lit("1"), "source_key").alias("video"))
        both = scratch.stored(known.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False))).withColumn("n", F.size("hashes")))
        both = similar.sequences(both)
        if self.perceptual_dry_run:
            links = self.store.spark.createDataFrame([], both.select(F.col("sequence").alias("sa"), F.col("sequence").alias("sb"), F.lit(0.0).alias("similarity")).schema)
        else:
            links = similar.sequence_pairs(both.filter("not known"), both, self.threshold)
        folded = resolve.greedy_by_sequence(both.select("video", "sequence", "width", "height", "kbps", "known"), links, self.threshold)
        name = lambda side, out: both.select(F.col("video").alias(side), F.col("content_id").alias(out))
        return folded.join(name("video", "content_id"), "video").join(name("final", "end"), "final").select("content_id", "outcome", F.col("end").alias("final"))

    def videos(self, objects: DataFrame, content: Callable[[DataFrame], DataFrame], probe: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], leased: DataFrame | None = None) -> dict:
        """One pass over the videos.

        content: sources -> source_key, content_id, error. probe: source_key, content_id ->
        content_id, width, height, duration_seconds, bitrate_kbps, hashes, error. encode: source_key, content_id ->
        content_id, rel_path, error of new outputs. leased: contents (content_id) that others have at hand, beside those in the table of leases.

        Bytes with an output are deduplicated; new contents are matched with the index in the
        order of their first keys, and one that another of this pass replaces at once is not
        encoded. If an encoding fails, the contents that were decided by it are decided again.
        """
        began = self.store.begin()
        read_table = began.read
        mappings, tombstones, outputs = read_table("mappings", MAPPING), read_table("tombstones", TOMBSTONE), read_table("outputs", OUTPUT)
        index, blobs, metadata = read_table("index", INDEX), read_table("blobs", BLOB), read_table("metadata", METADATA)
        skipped, work = self._open(listing.scan(objects, self.prefix), mappings, tombstones)
        read = scratch.stored(work.join(content(work), "source_key"))
        done_before = outputs.filter("rel_path = 'master.m3u8'").select("content_id")
        others = leased if leased is not None else self.store.spark.createDataFrame([], "content_id string")
        first = gates.canonical(read.filter("error is null")).join(done_before, "content_id", "left_anti").select("source_key", "content_id")
        wanted = scratch.stored(first)
        first = wanted.join(others.select("content_id"), "content_id", "left_anti")
        if self.worker:
            first = first.join(self._claimed(first), "content_id", "left_semi")
        first = scratch.stored(first)
        busy = wanted.join(first.select("content_id"), "content_id", "left_anti").select("content_id")
        seen = scratch.stored(probe(first))
        broken = seen.filter("error is not null").select("content_id", "error")
        made = None
        while True:
            left = first.join(broken.select("content_id"), "content_id", "left_anti")
            found = scratch.stored(self._resolved(left, seen.filter("error is null"), index, blobs))
            stays = found.filter("outcome in ('transcoded', 'replaced') and content_id = final").select("content_id")
            need = left.join(stays, "content_id", "left_semi")
            if made is not None:
                need = need.join(made.select("content_id"), "content_id", "left_anti")
                if need.isEmpty():
                    break
            new = scratch.stored(encode(need))
            made = new if made is None else scratch.stored(made.unionByName(new))
            broken = broken.unionByName(new.filter("error is not null").groupBy("content_id").agg(F.first("error").alias("error")))
            if new.filter("error is not null").isEmpty():
                break
        decided = found.filter("outcome <> 'known'").select("content_id", "outcome", "final")
        kept = scratch.stored(decided.filter("content_id = final"))
        moves = found.filter("outcome = 'known' and content_id <> final").select(F.col("content_id").alias("old"), F.col("final").alias("new"))
        moves = scratch.stored(moves)
        gone = moves.select(F.col("old").alias("content_id"))
        judged = (
            read.join(broken.withColumnRenamed("error", "_broken"), "content_id", "left")
            .join(busy.withColumn("_busy", F.lit(True)), "content_id", "left")
            .join(decided.select("content_id", F.col("outcome").alias("_how"), "final"), "content_id", "left")
            .join(first.select("content_id", F.col("source_key").alias("_first")), "content_id", "left")
        )
        outcome = F.when(F.coalesce("error", "_broken").isNotNull(), "failed").when(F.col("_busy"), "busy").when((F.col("source_key") == F.col("_first")) & (F.col("_how") != "deduped"), "processed").otherwise("deduped")
        judged = scratch.stored(judged.withColumn("error", F.coalesce("error", "_broken")).withColumn("outcome", outcome).withColumn("content_id", F.coalesce("final", "content_id")))
        done, failed = judged.filter("outcome in ('processed', 'deduped')"), judged.filter("outcome = 'failed'")
        master = keys.master_key(F.col("content_id"))
        rows = done.select(*self._source(), "content_id", master.alias("hls_root"), F.lit(self.at).alias("encoded_at"), F.lit(self.version).alias("encoder_version"))
        # numbers grow with the sort's order; gaps do not matter
        entries = scratch.stored(kept.select("content_id").join(seen.drop("error"), "content_id").join(first, "content_id").orderBy("source_key").withColumn("place", F.monotonically_increasing_id()))
        new_index = entries.select("content_id", F.lit(INTERVAL).alias("interval_seconds"), F.size("hashes").alias("hash_count"), "width", "height", F.col("bitrate_kbps").alias("video_bitrate_kbps"), F.lit(self.at).alias("encoded_at"), F.col("place").alias("insert_seq"))
        new_blobs = entries.select("content_id", hashing.to_blob(F.lit(INTERVAL), F.col("hashes")).alias("blob"))
        new_metadata = entries.select("content_id", F.lit(self.version).alias("encoder_version"), F.lit(self.at).alias("encoded_at"), F.struct("width", "height", "duration_seconds", "bitrate_kbps").alias("source"), media.effective_ladder(F.col("width"), F.col("height"), media.ladder(self.ladder)).alias("ladder"))
        new_outputs = made.filter("error is null").join(kept.select("content_id"), "content_id", "left_semi").select("content_id", "rel_path")
        changes = [
            ("trash", OUTPUT, "content_id", outputs.join(gone, "content_id", "left_semi"), None),
            ("outputs", OUTPUT, "content_id", new_outputs, gone),
            ("blobs", BLOB, "content_id", new_blobs, gone),
            ("index", INDEX, "content_id", lambda c: state.last(c.read("index", INDEX), new_index), gone),
            ("metadata", METADATA, "content_id", new_metadata, gone),
            self._tombstones("tombstones", done, failed),
            ("mappings", MAPPING, "source_key", lambda c: state.upsert(state.moved(c.read("mappings", MAPPING), moves, self.version, master), rows, "source_key"), None),
        ]
        if self.worker:
            changes.append(("leases", LEASE, "content_id", None, first))
        state.apply(self.store, changes)
        return self._summary(skipped.unionByName(judged.select("source_key", "outcome")))

    def _slice_end(self, objects: DataFrame, size: int) -> str | None:
        """The key of the last of the first `size` sources that are neither cached nor blocked; none if there are no more than that."""
        began = self.store.begin()
        _, work = self._open(listing.scan(objects, self.prefix), began.read("mappings", MAPPING), began.read("tombstones", TOMBSTONE))
        first = gates.within_budget(work.select("source_key"), size + 1).agg(F.count(F.lit(1)).alias("n"), F.max("source_key").alias("last")).first()
        if first["n"] <= size:
            return None
        return work.filter(F.col("source_key") < first["last"]).agg(F.max("source_key")).first()[0]

    def videos_by_slices(self, objects: DataFrame, content: Callable, probe: Callable, encode: Callable, size: int, go_on: Callable[[], bool], leased: DataFrame | None = None) -> tuple[dict, bool]:
        """`videos` over ranges of keys with `size` open sources each, in order; counters, and whether all were done.

        No slice is begun once `go_on` says no. The table `marks` keeps the key that a run came to
        and the next run begins behind it, so the two decide every source once, as one run does; a
        run that comes to the end removes the mark. A stop between a slice and its mark repeats the
        slice, whose sources are cached then.
        """
        mark = self.store.read("marks", MARK).filter("name = 'videos'").first()
        after, total = mark["mark"] if mark else None, {**dict.fromkeys(gates.OUTCOMES, 0), "total": 0}
        mark_row = lambda m: self.store.spark.createDataFrame([("videos", m)], MARK)
        while go_on():
            rest = objects if after is None else objects.filter(F.col("source_key") > after)
            end = self._slice_end(rest, size)
            for k, v in self.videos(rest if end is None else rest.filter(F.col("source_key") <= end), content, probe, encode, leased).items():
                total[k] += v
            if end is None:
                state.apply(self.store, [("marks", MARK, "name", None, mark_row(None).select("name"))])
                return total, True
            state.apply(self.store, [("marks", MARK, "name", mark_row(end), None)])
            after = end
        return total, False

    def images(self, objects: DataFrame, hasher: Callable[[DataFrame], DataFrame]) -> dict:
        """hasher: sources -> source_key, pdq_hash, quality, error. Images are neither deduplicated nor leased."""
        began = self.store.begin()
        skipped, work = self._open(listing.scan(objects, self.prefix, keys.is_image), began.read("image_mappings", IMAGE_MAPPING), began.read("image_tombstones", TOMBSTONE))
        read = scratch.stored(work.join(hasher(work), "source_key"))
        done, failed = read.filter("error is null"), read.filter("error is not null")
        rows = done.select(*self._source(), "pdq_hash", "quality", F.lit(self.at).alias("hashed_at"), F.lit(self.version).alias("hasher_version"))
        skipped = scratch.stored(skipped)
        state.apply(self.store, [self._tombstones("image_tombstones", done, failed), ("image_mappings", IMAGE_MAPPING, "source_key", rows, None)])
        return self._summary(skipped.unionByName(read.select("source_key", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"))))

    def clean(self, objects: DataFrame, dry_run: bool = False) -> tuple[dict, DataFrame]:
        """Counters, and the plan of objects to delete; all live keys count, of whatever type."""
        live = listing.scan(objects, where=None).select("source_key")
        began = self.store.begin()
        mappings, outputs = began.read("mappings", MAPPING), began.read("outputs", OUTPUT)
        counts = scratch.stored(cleanup.refcounts(mappings, live, self.prefix))
        plan = scratch.stored(cleanup.gc_plan(counts, outputs))
        summary = cleanup.summary(counts, plan).first().asDict()
        if not dry_run:
            dead = counts.filter("action = 'collect'").select("content_id")
            gone = [(name, schema, "content_id", None, dead) for name, schema in (("outputs", OUTPUT), ("blobs", BLOB), ("index", INDEX), ("metadata", METADATA))]
            trash = outputs.join(dead, "content_id", "left_semi")
            state.apply(self.store, [("trash", OUTPUT, "content_id", trash, None), *gone, ("mappings", MAPPING, "source_key", None, cleanup.orphans(mappings, live, self.prefix))])
        return summary, plan

    def empty_trash(self, delete: Callable[[list[str]], None]) -> DataFrame:
        """content_id, batch, n, error: deletes the objects of the table `trash` by batches, as tasks; trees that are gone leave the table, others stay for the next time.

        delete: called in tasks with at most `cleanup.BATCH` keys, which may be gone already; it raises where one cannot be deleted.
        Trees whose content has an output again are not deleted.
        """
        began = self.store.begin()
        again = began.read("outputs", OUTPUT).select("content_id")
        trash = began.read("trash", OUTPUT).join(again, "content_id", "left_anti")
        said = scratch.stored(cleanup.deleted(cleanup.batches(trash), delete))
        bad = said.filter("error is not null").select("content_id")
        kept = began.read("trash", OUTPUT).select("content_id").distinct().join(bad, "content_id", "left_anti")
        state.apply(self.store, [("trash", OUTPUT, "content_id", None, kept)])
        return said

    def clean_images(self, objects: DataFrame, dry_run: bool = False) -> int:
        live = listing.scan(objects, where=None).select("source_key")
        gone = scratch.stored(cleanup.orphans(self.store.read("image_mappings", IMAGE_MAPPING), live, self.prefix))
        n = gone.count()
        if not dry_run:
            state.apply(self.store, [("image_mappings", IMAGE_MAPPING, "source_key", None, gone)])
        return n


def run_pairs(passes: dict[str, Callable[[], dict]], budget: float | None = None, clock: Callable[[], float] = time.monotonic) -> dict[str, dict]:
    """Counters of each pair's pass, run in order, and under 'total' their sum.

    No pair is begun after `budget` seconds; a pair that raises stops the run.
    """
    began, out = clock(), {}
    for name, run in passes.items():
        if budget is not None and clock() - began > budget:
            break
        out[name] = run()
    total: dict[str, int] = {}
    for summary in out.values():
        for k, v in summary.items():
            total[k] = total.get(k, 0) + v
    return {**out, "total": total}
