"""Paged listings, runs over configured pairs, locks on shared file systems, growth of similarity candidates."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediacat import config, locking, pipeline, runs
from mediacat.operators import similar, state
from mediacat.sources import listing, paged
from test_runs import _content, _encode, _maps, _objects, _probe

STAMP = datetime(2024, 1, 1, tzinfo=UTC)


def Pages(names, log, fails=()):  # noqa: N802
    """A client that is sent to the tasks by value."""

    stamp = STAMP

    class Client:
        """A listing in memory: ranges by first letter, three keys a page; asks are counted in a file."""

        def __init__(self, names, log, fails=()):
            self.names, self.log, self.fails = sorted(names), log, fails

        def ranges(self, prefix):
            return [c for c in sorted({n[0] for n in self.names}) if not prefix or c == prefix[0]]

        def page(self, within, prefix, token):
            with open(self.log, "a") as f:
                f.write(f"{within} {token}\n")
            at = int(token or 0)
            if (within, at) in self.fails:
                raise ConnectionError("page is gone")
            own = [n for n in self.names if n[0] == within and n.startswith(prefix)]
            return [(n, f'"{len(n)}"', 1, stamp) for n in own[at : at + 3]], str(at + 3) if at + 3 < len(own) else None

    return Client(names, log, fails)


def test_pages_are_read_by_range_and_an_error_is_one_row(spark, tmp_path):
    names = [f"{c}{i:02d}.mp4" for c in "abc" for i in range(8)]
    log = str(tmp_path / "asks")
    found = paged.listed(spark, Pages(names, log))
    assert found.rdd.getNumPartitions() == 3
    assert sorted(r["source_key"] for r in found.collect()) == names and listing.whole(found) is found
    broken = paged.listed(spark, Pages(names, log, fails={("b", 3)}))
    rows = broken.collect()
    assert sorted(r["source_key"] for r in rows if r["source_key"]) == [n for n in names if n[0] != "b"] + names[8:11] or len(rows) == 20
    assert [r["error"] for r in rows if r["error"]] == ["page is gone"]
    with pytest.raises(listing.Incomplete, match="page is gone"):
        listing.whole(broken)
    assert sorted(r["source_key"] for r in listing.scan(broken).collect()) == sorted([n for n in names if n[0] != "b"] + names[8:11])
    assert paged.listed(spark, Pages(names, log), "zz").count() == 0


def test_a_prefix_reaches_the_client(spark, tmp_path):
    names, log = [f"{c}{i:02d}.mp4" for c in "abc" for i in range(8)], tmp_path / "asks"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = listing.scan(paged.listed(spark, Pages(names, str(log))), "b0").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert sorted(r["source_key"] for r in got) == [n for n in names if n.startswith("b0")]
    assert {line[0] for line in log.read_text().splitlines()} == {"b"}


def test_files_are_pages(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03d}", "e", i) for i in range(95)], "source_key string, etag string, size long").withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    files = paged.written(rows.repartition(3), f"file:{tmp_path}/pages", page=10)
    client = paged.Files(files)
    assert paged.listed(spark, client).count() == 95
    assert [r["last_modified"] for r in paged.listed(spark, client, "k09").orderBy("source_key").collect()] == [STAMP.replace(tzinfo=None)] * 5
    assert len(client.ranges("k09")) == 1


def _config(**more):
    pair = lambda k, d: {"source": {"bucket": f"s{k}", "endpoint": "https://s"}, "dest": {"bucket": d, "endpoint": "https://s"}, "accessKeyId": "k", "secretAccessKey": "x"}
    pairs = [pair(k, d) for k, d in enumerate(more.pop("dests", ("d0", "d1")))]
    return config.load({"BUCKETS_CONFIG": json.dumps(pairs), "CLEANUP_ENABLED": "true", **more})


def test_a_run_stopped_inside_a_pair(spark, tmp_path):
    c = _config(dests=("d0",))
    store = state.TableStore(spark, f"file:{tmp_path}")
    listed = lambda p: _objects(spark, [("a.mp4", '"1"', 1), ("b.mp4", '"4"', 1)]).withColumn("error", F.lit(None).cast("string"))
    asked = iter([False, False, True])
    go = lambda **more: runs.run(c, listed, lambda p: store, lambda p: runs.Media(_content, _probe(spark), _encode()), "t", "1", slice_size=1, **more)
    one = go(stopped=lambda: next(asked))
    assert (one["processed"], one["total"]) == (1, 1) and "open" in one["pairs"][0] and "cleaned" not in one["pairs"][0]
    two = go()
    assert (two["processed"], two["total"]) == (1, 1) and two["pairs"][0]["cleaned"] == 0


def test_runs_over_pairs(spark, tmp_path):
    stores = {}
    store = lambda p: stores.setdefault(p[1].bucket, state.TableStore(spark, f"file:{tmp_path}/{p[1].bucket}"))
    media = lambda p: runs.Media(_content, _probe(spark), _encode())
    rows = {"s0": [("a.mp4", '"1"', 1)], "s1": [("d.mp4", '"4"', 1)]}
    listed = lambda p: _objects(spark, rows[p[0].bucket]).withColumn("error", F.lit(None).cast("string"))
    files = lambda p: locking.HadoopFiles(spark, f"file:{tmp_path}/{p[1].bucket}")
    go = lambda c, **more: runs.run(c, listed, store, media, "t", "1", **more)
    held = locking.acquire_on(files(_config().pairs[1]), 1000)
    one = go(_config(), files=files)
    assert (one["processed"], one["pairsProcessed"], one["totalPairs"]) == (1, 1, 2) and one["durationMs"] >= 0
    held.release()
    rows["s0"] = [("b.mp4", '"4"', 1)]
    # a listing that fails ends the run, and nothing is cleaned up
    bad = lambda p: listed(p).union(_objects(spark, [(None, None, None)]).withColumn("error", F.lit("page is gone")))
    two = runs.run(_config(), bad, store, media, "t", "1", files=files)
    assert (two["failed"], two["pairsProcessed"]) == (1, 1) and _maps(stores["d0"]) == {"a.mp4": "1"}
    assert locking.acquire_on(files(_config().pairs[0]), 1000).release() is None
    three = go(_config(MAX_RUNTIME_SECONDS="0"), clock=iter([0.0, 1.0, 2.0]).__next__)
    assert three["pairsProcessed"] == 0 and three["processed"] == three["total"] == 0
    assert go(_config(), stopped=lambda: True)["pairsProcessed"] == 0


def test_a_shared_destination_is_not_cleaned(spark, tmp_path):
    c = _config(dests=("d", "d", "e"))
    assert [runs.sharing(c.pairs, i) for i in range(3)] == [[1], [0], []]
    store = state.TableStore(spark, f"file:{tmp_path}")
    other = spark.createDataFrame([("theirs.mp4", "e", 1, "t", "sha256:7", "by-id/sha256:7/master.m3u8", "t", "1")], pipeline.MAPPING)
    state.apply(store, [("mappings", pipeline.MAPPING, "source_key", other, None)])
    one = config.Config(c.pairs[:2], cleanup=True)
    got = runs._pair(one, 0, _objects(spark, [("a.mp4", '"1"', 1)]), store, runs.Media(_content, _probe(spark), _encode()), "t", "1")
    assert "refused" in got and "theirs.mp4" in _maps(store)


def test_locks_on_a_shared_file_system(spark, tmp_path):
    files, now = locking.HadoopFiles(spark, f"file:{tmp_path}"), datetime(2024, 1, 1, tzinfo=UTC)
    held = locking.acquire_on(files, 100, now=now)
    assert held and locking.acquire_on(locking.HadoopFiles(spark, f"file:{tmp_path}"), 100, now=now + timedelta(seconds=99)) is None
    taken = locking.acquire_on(files, 100, now=now + timedelta(seconds=101))
    held.release()
    assert files.read(locking.LOCK) and taken
    taken.release()
    assert files.read(locking.LOCK) is None


def test_keys_of_bands():
    assert similar.key_bands(0.95) == (5, 2) and abs(similar.least_shared(0.95) - 0.8) < 1e-9
    assert similar.key_bands(1.0)[0] == similar.key_bands(1.0)[1]


def test_candidates_grow_with_the_videos_and_flat_frames_lose_nothing(spark):
    r = random.Random(9)

    def frames(n):
        return [(i, [r.getrandbits(63) for _ in range(4)]) for i in range(n)]

    def met(rows):
        f = similar.sequences(spark.createDataFrame(rows, "video long, hashes array<long>").withColumn("n", F.size("hashes")))
        side = lambda k: f.groupBy(F.col("sequence").alias(k)).agg(F.first("hashes").alias("hashes"))
        return similar.candidates(side("sa"), side("sb")).filter("sa < sb").count()

    few, many = met(frames(1000)), met(frames(4000))
    assert many <= max(few, 20) * 4**1.2
    # a hundred videos that begin with flat frames, and near copies of some
    flat = [(10000 + i, [0, 0, 0, r.getrandbits(63)]) for i in range(100)]
    near = [(20000 + i, [*h[:3], h[3] ^ 7]) for i, h in flat[:20]]
    rows = flat + near
    sim = lambda a, b: 1 - sum(bin(x ^ y).count("1") for x, y in zip(a, b)) / 4 / 64
    want = {(a, b) for a, x in rows for b, y in rows if a < b and sim(x, y) >= 0.95}
    f = spark.createDataFrame(rows, "video long, hashes array<long>").withColumn("n", F.size("hashes"))
    assert {(p["a"], p["b"]) for p in similar.pairs(f, f).filter("a < b").collect()} == want and len(want) >= 20
