"""State, passes, the order-dependent resolver, triggers, locks, configuration."""

import io
import json
import random
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediacat import config, locking, logs, pipeline
from mediacat.operators import resolve, similar, state
from mediacat.pipeline import Pass
from mediacat.sources import external
from mediacat.streaming import trigger


def test_store_swaps_versions(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}")
    assert store.read("t", "k string, v int").count() == 0
    for v in (1, 2, 3):
        rows = spark.createDataFrame([("a", v), (f"k{v}", v)], "k string, v int")
        store.write("t", state.upsert(store.read("t", "k string, v int"), rows, "k"))
    assert {tuple(r) for r in store.read("t", "k string, v int").collect()} == {("a", 3), ("k1", 1), ("k2", 2), ("k3", 3)}


def _objects(spark, rows):
    return spark.createDataFrame(rows, "source_key string, etag string, size long").withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))


def test_store_survives_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    schema = "k string, v int"
    store = state.TableStore(spark, f"file:{tmp_path}")
    rows = lambda v: spark.createDataFrame([("a", v)], schema)
    value = lambda: store.read("t", schema).first()["v"]
    store.write("t", rows(1))
    reader = store.read("t", schema)
    for step in ("_point", "_sweep"):
        with monkeypatch.context() as m:
            m.setattr(state.TableStore, step, lambda *a: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                store.write("t", rows(2))
        assert value() == (1 if step == "_point" else 2)
    # a manifest that was never finished is not one
    (tmp_path / "tables" / "t" / "0123").mkdir()
    (tmp_path / "_at-000000000099").write_text('{"tables": {"t"')
    assert value() == 2 and reader.first()["v"] == 1
    store.write("t", rows(3))
    assert value() == 3
    seen, stop = set(), threading.Event()

    def read():
        while not stop.is_set():
            seen.add(store.read("t", schema).count())

    watcher = threading.Thread(target=read)
    watcher.start()
    for v in (4, 5, 6):
        store.write("t", rows(v))
    stop.set()
    watcher.join()
    assert seen == {1} and value() == 6
    for f in tmp_path.glob("_at-*"):
        f.unlink()
    with pytest.raises(RuntimeError):
        store.read("t", schema)


def test_changes_write_only_their_buckets(spark, tmp_path):
    schema = "k string, v int"
    store = state.TableStore(spark, f"file:{tmp_path}", target=400)
    rows = lambda keys, v: spark.createDataFrame([(f"k{k}", v) for k in keys], schema)
    for _ in range(2):  # the second commit sees how large the table is
        state.apply(store, [("t", schema, "k", rows(range(600), 1), None)])
    before, store.target = store.files("t"), 1 << 20
    assert len(before) >= 8
    bucket = rows(range(600), 1).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(len(before))))
    own = [r["k"] for r in bucket.filter("b = 3").collect()]
    state.apply(store, [("t", schema, "k", spark.createDataFrame([(own[0], 5)], schema), spark.createDataFrame([(own[1],)], "k string"))])
    after = store.files("t")
    assert {b for b in after if after[b] != before[b]} == {"3"}
    got = {r["k"]: r["v"] for r in store.read("t", schema).collect()}
    assert got == {f"k{k}": 5 if f"k{k}" == own[0] else 1 for k in range(600) if f"k{k}" != own[1]}
    # files of buckets that no manifest names are gone
    assert len(list((tmp_path / "tables" / "t").glob("*/_b=3"))) == 2


def test_the_second_of_two_commits_is_begun_anew(spark, tmp_path):
    schema = "k string, v int"
    store = state.TableStore(spark, f"file:{tmp_path}")
    one, two = store.begin(), store.begin()
    one.change("t", schema, "k", spark.createDataFrame([("a", 1)], schema))
    two.change("u", schema, "k", spark.createDataFrame([("b", 2)], schema))
    one.done()
    with pytest.raises(state.Conflict):
        two.done()
    assert store.read("u", schema).count() == 0
    state.apply(store, [("u", schema, "k", lambda c: c.read("t", schema), None)])
    assert store.read("u", schema).first()["v"] == 1


FRAMES = [0x0123456789ABCDEF, 0x7777777777777777, 0x1111222233334444, 0x0F0F0F0F0F0F0F0F, 0x5A5A5A5A5A5A5A5A]
#: Etag of a source -> width, height, kbps, hashes.
VIDEOS = {
    "1": (640, 360, 500, FRAMES),
    "2": (640, 360, 400, [h ^ 1 for h in FRAMES]),  # near to 1, not better
    "3": (1920, 1080, 900, [h ^ 2 for h in FRAMES]),  # near to 1, better
    "4": (640, 360, None, [~h for h in FRAMES]),
    "5": (640, 360, None, []),
    "6": (1280, 720, 900, [h ^ 3 for h in FRAMES]),
}


def _content(s):
    return s.select("source_key", F.concat(F.lit("sha256:"), "etag").alias("content_id"), F.when(F.col("etag") == "9", "broken").alias("error"))


def _probe(spark, fails=()):
    known = [(f"sha256:{k}", w, h, 1.5, r, x, "no frames" if k in fails else None) for k, (w, h, r, x) in VIDEOS.items()]
    return lambda s: s.select("content_id").join(spark.createDataFrame(known, "content_id string, width int, height int, duration_seconds double, bitrate_kbps int, hashes array<long>, error string"), "content_id")


def _encode(fails=(), calls=None):
    def run(s):
        if calls is not None:
            calls.append(sorted(r["content_id"] for r in s.collect()))
        bad = F.col("content_id").isin([f"sha256:{k}" for k in fails])
        return s.select("content_id", F.when(~bad, "master.m3u8").alias("rel_path"), F.when(bad, "no encoder").alias("error"))

    return run


def _maps(store):
    return {r["source_key"]: r["content_id"].removeprefix("sha256:") for r in store.read("mappings", pipeline.MAPPING).collect()}


def _ids(store, name, schema):
    return sorted(r["content_id"].removeprefix("sha256:") for r in store.read(name, schema).collect())


def test_video_passes(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}")
    run = Pass(store, "2024-01-01T00:00:00Z", "1")
    objects = _objects(spark, [("a.mp4", '"1"', 1), ("b.mp4", '"1"', 1), ("c.mp4", '"4"', 1), ("bad.mp4", '"9"', 1), ("x.txt", '"3"', 1)])
    go = lambda: run.videos(objects, _content, _probe(spark), _encode())
    first = go()
    assert (first["processed"], first["deduped"], first["failed"]) == (2, 1, 1)
    second = go()
    assert (second["cached"], second["failed"]) == (3, 1)
    go()
    fourth = go()
    assert (fourth["cached"], fourth["errored"], fourth["failed"]) == (3, 1, 0)
    metadata = {r["content_id"]: r for r in store.read("metadata", pipeline.METADATA).collect()}
    assert metadata["sha256:1"]["source"]["width"] == 640 and [x["name"] for x in metadata["sha256:1"]["ladder"]] == ["360p"]
    left = objects.filter("source_key not in ('a.mp4', 'c.mp4')")
    dry, plan = run.clean(left, dry_run=True)
    assert dry == {"orphan_mappings": 2, "collected": 1, "retained": 1, "objects": 1}
    assert [r["object_key"] for r in plan.collect()] == ["by-id/sha256:4/master.m3u8"]
    assert _ids(store, "index", pipeline.INDEX) == _ids(store, "blobs", pipeline.BLOB) == ["1", "4"]
    assert run.clean(left)[0] == dry and run.clean(left)[0]["orphan_mappings"] == 0
    assert _ids(store, "index", pipeline.INDEX) == _ids(store, "blobs", pipeline.BLOB) == _ids(store, "metadata", pipeline.METADATA) == ["1"]


def test_near_duplicates_in_a_pass(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}")
    run = Pass(store, "2024-01-01T00:00:00Z", "1")
    rows = [("a.mp4", '"1"', 1), ("b.mp4", '"2"', 1), ("d.mp4", '"4"', 1), ("e.mp4", '"5"', 1)]
    first = run.videos(_objects(spark, rows), _content, _probe(spark), _encode())
    assert (first["processed"], first["deduped"]) == (3, 1) and _maps(store) == {"a.mp4": "1", "b.mp4": "1", "d.mp4": "4", "e.mp4": "5"}
    # a better copy takes over: mappings move, the old output, blob and entry go; its own bytes under another key follow
    calls = []
    rows += [("f.mp4", '"6"', 1), ("g.mp4", '"3"', 1), ("h.mp4", '"6"', 1)]
    second = run.videos(_objects(spark, rows), _content, _probe(spark), _encode(calls=calls))
    assert (second["cached"], second["processed"], second["deduped"]) == (4, 2, 1)
    assert _maps(store) == {"a.mp4": "3", "b.mp4": "3", "d.mp4": "4", "e.mp4": "5", "f.mp4": "3", "g.mp4": "3", "h.mp4": "3"}
    assert _ids(store, "outputs", pipeline.OUTPUT) == _ids(store, "blobs", pipeline.BLOB) == _ids(store, "index", pipeline.INDEX) == ["3", "4", "5"] and calls == [["sha256:3"]]
    seq = {r["content_id"][7:]: r["insert_seq"] for r in store.read("index", pipeline.INDEX).collect()}
    assert seq["3"] > max(seq["4"], seq["5"])


@pytest.mark.parametrize("stop", [4, "_point"])
def test_a_pass_that_stops_leaves_no_mapping_without_output(spark, tmp_path, monkeypatch, stop):
    store = state.TableStore(spark, f"file:{tmp_path}")
    run = Pass(store, "2024-01-01T00:00:00Z", "1")
    rows = [("a.mp4", '"1"', 1), ("b.mp4", '"1"', 1), ("d.mp4", '"4"', 1)]
    run.videos(_objects(spark, rows), _content, _probe(spark), _encode())
    rows.append(("g.mp4", '"3"', 1))
    objects = _objects(spark, rows)
    went = {"n": 0}
    true_data = state.TableStore._data

    def data(self, *args):
        went["n"] += 1
        if went["n"] == stop:
            raise OSError("stopped")
        true_data(self, *args)

    def whole():
        mapped = {r["hls_root"] for r in store.read("mappings", pipeline.MAPPING).collect()}
        made = {f"by-id/{r['content_id']}/{r['rel_path']}" for r in store.read("outputs", pipeline.OUTPUT).collect()}
        assert mapped <= made and _ids(store, "outputs", pipeline.OUTPUT) == _ids(store, "index", pipeline.INDEX) == _ids(store, "blobs", pipeline.BLOB)

    def stopped(call):
        with monkeypatch.context() as m:
            if isinstance(stop, str):
                m.setattr(state.TableStore, stop, lambda *a: (_ for _ in ()).throw(OSError("stopped")))
            else:
                went["n"] = 0
                m.setattr(state.TableStore, "_data", data)
            try:
                call()
            except OSError:
                pass

    stopped(lambda: run.videos(objects, _content, _probe(spark), _encode()))
    whole()
    run.videos(objects, _content, _probe(spark), _encode())
    whole()
    assert _maps(store) == {"a.mp4": "3", "b.mp4": "3", "d.mp4": "4", "g.mp4": "3"}
    left = objects.filter("source_key <> 'd.mp4'")
    stopped(lambda: run.clean(left))
    whole()
    run.clean(left)
    whole()
    assert _ids(store, "outputs", pipeline.OUTPUT) == ["3"] and _ids(store, "trash", pipeline.OUTPUT) == ["1", "4"]


def test_trash_is_emptied_by_batches(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}/store")
    root = tmp_path / "dest"
    for cid in "xy":
        (root / "by-id" / cid).mkdir(parents=True)
        for name in ("master.m3u8", "seg"):
            (root / "by-id" / cid / name).write_text("1")
    rows = spark.createDataFrame([(c, n) for c in "xyz" for n in ("master.m3u8", "seg")], pipeline.OUTPUT)
    state.apply(store, [("trash", pipeline.OUTPUT, "content_id", rows, None), ("outputs", pipeline.OUTPUT, "content_id", rows.filter("content_id = 'z'"), None)])
    base, locked = str(root), str(tmp_path / "locked")
    (tmp_path / "locked").touch()

    def delete(found):
        import os

        for key in found:
            if "/y/" in key and os.path.exists(locked):
                raise OSError(f"{key} is locked")
            if os.path.exists(f"{base}/{key}"):
                os.unlink(f"{base}/{key}")

    run = Pass(store, "t", "1")
    said = {r["content_id"]: (r["n"], r["error"]) for r in run.empty_trash(delete).collect()}
    assert said == {"x": (2, None), "y": (2, "by-id/y/master.m3u8 is locked")}
    assert not list((root / "by-id" / "x").iterdir()) and _ids(store, "trash", pipeline.OUTPUT) == ["y", "y"]
    (tmp_path / "locked").unlink()
    run.empty_trash(delete)
    assert not list((root / "by-id" / "y").iterdir()) and _ids(store, "trash", pipeline.OUTPUT) == []


def test_leases_are_shared_by_passes(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}")
    objects = _objects(spark, [("a.mp4", '"1"', 1), ("d.mp4", '"4"', 1)])
    state.apply(store, [("leases", pipeline.LEASE, "content_id", spark.createDataFrame([("sha256:4", "other", 100.0)], pipeline.LEASE), None)])
    early = Pass(store, "t", "1", worker="me", clock=lambda: 50.0).videos(objects, _content, _probe(spark), _encode())
    assert (early["processed"], early["busy"]) == (1, 1) and _maps(store) == {"a.mp4": "1"}
    assert [r["worker"] for r in store.read("leases", pipeline.LEASE).collect()] == ["other"]
    late = Pass(store, "t", "1", worker="me", clock=lambda: 101.0).videos(objects, _content, _probe(spark), _encode())
    assert (late["processed"], late["cached"]) == (1, 1) and store.read("leases", pipeline.LEASE).count() == 0


def test_failed_encodings_busy_contents_and_dry_runs(spark, tmp_path):
    objects = _objects(spark, [("a.mp4", '"1"', 1), ("b.mp4", '"3"', 1), ("c.mp4", '"2"', 1), ("d.mp4", '"4"', 1), ("e.mp4", '"5"', 1)])
    store = state.TableStore(spark, f"file:{tmp_path}/1")
    calls = []
    leased = spark.createDataFrame([("sha256:4",), ("sha256:77",)], "content_id string")
    got = Pass(store, "t", "1").videos(objects, _content, _probe(spark, fails="5"), _encode(fails="3", calls=calls), leased)
    # 3 would have replaced 1; as it fails, 1 is encoded and 2 goes onto it
    assert (got["processed"], got["deduped"], got["failed"], got["busy"]) == (1, 1, 2, 1) and calls == [["sha256:3"], ["sha256:1"]]
    assert _maps(store) == {"a.mp4": "1", "c.mp4": "1"}
    assert {r["source_key"]: r["error"] for r in store.read("tombstones", pipeline.TOMBSTONE).collect()} == {"b.mp4": "no encoder", "e.mp4": "no frames"}
    dry = state.TableStore(spark, f"file:{tmp_path}/2")
    both = pipeline.run_pairs({"one": lambda: Pass(dry, "t", "1", perceptual_dry_run=True).videos(objects, _content, _probe(spark), _encode()), "two": lambda: {"processed": 2, "extra": 1}})
    assert both["one"]["processed"] == 5 and both["total"]["processed"] == 7 and both["total"]["extra"] == 1
    # an index entry whose blob is gone is skipped
    dry.write("blobs", dry.read("blobs", pipeline.BLOB).limit(0))
    more = Pass(dry, "t", "1").videos(_objects(spark, [("z.mp4", '"6"', 1)]), _content, _probe(spark), _encode())
    assert more["processed"] == 1 and _maps(dry)["z.mp4"] == "6"


def test_slices_stopped_by_a_clock_give_what_one_run_gives(spark, tmp_path):
    objects = _objects(spark, [(f"{k}.mp4", f'"{e}"', 1) for k, e in zip("abcde", "19142", strict=True)])
    one, two = (state.TableStore(spark, f"file:{tmp_path}/{n}") for n in ("one", "two"))
    whole = Pass(one, "t", "1").videos(objects, _content, _probe(spark), _encode())
    counts = []
    for slices in (1, 5):
        clock = iter([True] * slices + [False])
        got, ended = Pass(two, "t", "1").videos_by_slices(objects, _content, _probe(spark), _encode(), 2, lambda c=clock: next(c))
        counts.append(got)
        assert ended == (slices == 5)
        assert [r["mark"] for r in two.read("marks", pipeline.MARK).collect()] == ([] if ended else ["b.mp4"])
    assert counts[0]["total"] == 2 and {k: counts[0][k] + counts[1][k] for k in whole} == whole
    assert _maps(two) == _maps(one)
    for name, schema in (("index", pipeline.INDEX), ("outputs", pipeline.OUTPUT), ("blobs", pipeline.BLOB)):
        assert _ids(two, name, schema) == _ids(one, name, schema)
    attempts = lambda s: [(r["source_key"], r["attempts"]) for r in s.read("tombstones", pipeline.TOMBSTONE).collect()]
    assert attempts(two) == attempts(one) == [("b.mp4", 1)]


def test_image_passes(spark, tmp_path):
    run = Pass(state.TableStore(spark, f"file:{tmp_path}"), "2024-01-01T00:00:00Z", "1", budget=1)
    objects = _objects(spark, [("a.jpg", '"1"', 1), ("b.png", '"1"', 1)])
    hasher = lambda s: s.select("source_key", F.lit("ab").alias("pdq_hash"), F.lit(7).alias("quality"), F.lit(None).cast("string").alias("error"))
    assert run.images(objects, hasher)["processed"] == 1
    again = run.images(objects, hasher)
    assert (again["processed"], again["cached"]) == (1, 1)
    assert run.clean_images(objects.filter("source_key = 'a.jpg'")) == 1


def test_resolver_equals_one_fold(spark):
    r = random.Random(3)
    videos = [(i, r.choice([100, 200, 300]), 1, r.choice([None, 5, 6])) for i in range(120)]
    links = {(a, b): r.choice([0.95, 0.96, 1.0]) for _ in range(110) if (a := r.randrange(120)) < (b := r.randrange(120))}
    want = resolve.fold([(v, w * h, k) for v, w, h, k in videos], links, 0.95)
    v = spark.createDataFrame(videos, "video long, width int, height int, kbps int")
    e = spark.createDataFrame([(a, b, s) for (a, b), s in links.items()], "a long, b long, similarity double")
    assert sorted(tuple(x) for x in resolve.greedy(v, e, 0.95).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_resolver_by_sequences_equals_one_fold(spark, seed):
    r = random.Random(seed)
    # (sequence, pixels): few sequences, so many copies; the first is hot
    videos = [(f"v{i:03}", min(r.randrange(30), r.randrange(30)) if i % 3 else 0, r.choice([100, 200, 300, None]), 1, r.choice([None, 5, 6, 7]), i < 12 and i % 2 == 0) for i in range(150)]
    close = {(c, c): 1.0 for c in range(30) if c != 7}
    for _ in range(50):
        a, b = r.randrange(30), r.randrange(30)
        if a != b:
            close[a, b] = close[b, a] = r.choice([0.94, 0.95, 0.97, 1.0])
    of = {v[0]: v[1] for v in videos}
    similar = {(a, b): close[of[a], of[b]] for a in of for b in of if a < b and (of[a], of[b]) in close}
    want = resolve.fold([(v, (w or 0) * h, k, known) for v, _, w, h, k, known in videos], similar, 0.95)
    v = spark.createDataFrame(videos, "video string, sequence int, width int, height int, kbps int, known boolean")
    e = spark.createDataFrame([(a, b, s) for (a, b), s in close.items()], "sa int, sb int, similarity double")
    got = resolve.greedy_by_sequence(v, e, 0.95)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert {o for _, o, _, _ in want} == {"known", "deduped", "replaced", "transcoded"}


def test_resolver_of_one_large_component(spark):
    # 100,000 copies and near copies in one component; better ones appear along the way
    n = 100_000
    v = spark.range(n, numPartitions=8).select(
        F.col("id").alias("video"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 40).cast("int")).alias("sequence"), F.lit(1).alias("width"), (F.log2(F.col("id") + 1).cast("int") + 1).alias("height"), F.lit(None).cast("int").alias("kbps")
    )
    e = spark.range(40).select(F.col("id").cast("int").alias("sa")).crossJoin(spark.range(40).select(F.col("id").cast("int").alias("sb"))).withColumn("similarity", F.lit(1.0))
    got = resolve.greedy_by_sequence(v, e, 0.95)
    counts = {x["outcome"]: x["n"] for x in got.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert counts == {"transcoded": 1, "replaced": 16, "deduped": n - 17}
    assert [x[0] for x in got.select("final").distinct().collect()] == [2**16 - 1]


def test_resolver_of_nothing(spark):
    v = spark.createDataFrame([], "video long, sequence int, width int, height int, kbps int")
    e = spark.createDataFrame([], "sa int, sb int, similarity double")
    assert resolve.greedy_by_sequence(v, e, 0.95).collect() == []


def test_banded_join_loses_nothing(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = [r.getrandbits(63) for _ in range(4)]
        rows += [(3 * i, base), (3 * i + 1, [h ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for h in base]), (3 * i + 2, [h ^ 0b1111 for h in base[:3]])]
    rows += [(900, []), (901, [0, 0]), (902, [0, 0])]
    sim = lambda a, b: 1 - sum(bin(x ^ y).count("1") for x, y in zip(a, b)) / min(len(a), len(b)) / 64
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and sim(x, y) >= 0.95}
    f = spark.createDataFrame(rows, "video long, hashes array<long>").withColumn("n", F.size("hashes"))
    assert {(p["a"], p["b"]) for p in similar.pairs(f, f).filter("a < b").collect()} == want
    index = f.filter("video % 3 = 0").withColumn("insert_seq", -F.col("video"))
    near = lambda x, y: x and y and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and sim(x, y) >= 0.95
    hashes = dict(rows)
    chosen = {a: max(((sim(x, hashes[b]), b) for b in hashes if b % 3 == 0 and near(x, hashes[b])), default=None) for a, x in rows}
    got = {r["a"]: (r["similarity"], r["b"]) for r in similar.best(f, index).collect()}
    assert got == {a: c for a, c in chosen.items() if c}


def test_no_join_of_keys_goes_through_the_driver(spark):
    r = random.Random(8)
    # flat frames, so that hot keys are joined too
    rows = [(i, [0, 0, 0, r.getrandbits(63)] if i % 3 else [r.getrandbits(63) for _ in range(4)]) for i in range(300)]
    f = spark.createDataFrame(rows, "video long, hashes array<long>").withColumn("n", F.size("hashes"))
    for found in (similar.pairs(f, f), similar.best(f, f.withColumn("insert_seq", F.col("video")))):
        assert found.count() >= 300
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_entries_move_to_the_end(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "content_id string, insert_seq long")
    got = {r["content_id"]: r["insert_seq"] for r in state.upsert_last(t, t.filter("content_id = 'a'"), "content_id").collect()}
    assert got["a"] > got["b"]


def test_locks(tmp_path):
    root, now = str(tmp_path), datetime(2024, 1, 1, tzinfo=UTC)
    held = locking.acquire(root, 100, now=now)
    assert held and locking.acquire(root, 100, now=now + timedelta(seconds=99)) is None
    taken = locking.acquire(root, 100, now=now + timedelta(seconds=101))
    assert taken
    held.release()  # no longer its own
    assert locking.read(taken.path)["workerId"] == taken.worker_id
    (tmp_path / locking.LOCK).write_text("{}")
    with locking.acquire(root, 100, now=now) as again:
        assert again
    assert locking.read(taken.path) is None


def test_configuration():
    pair = {"source": {"bucket": "a", "endpoint": "https://s"}, "dest": {"bucket": "b", "endpoint": "https://s", "region": "eu"}, "accessKeyId": "k"}
    env = {"BUCKETS_CONFIG": json.dumps([pair]), "SOURCE_SECRET_ACCESS_KEY": "s", "DEST_SECRET_ACCESS_KEY": "d", "MAX_RUNTIME_SECONDS": "900"}
    c = config.load(env)
    assert (c.pairs[0][0].region, c.pairs[0][1].region, c.lock_ttl, c.budget) == ("auto", "eu", 1350, 675)
    assert c.max_concurrency == 1 and config.load({**env, "MAX_CONCURRENCY": "4"}).max_concurrency == 4
    assert config.lock_ttl(100, 1.05) == 105 and config.time_budget(900, 0) == 0
    for bad in ({"BUCKETS_CONFIG": "[]"}, {"BUCKETS_CONFIG": "x"}, {**env, "MAX_RUNTIME_SECONDS": "nan"}, {**env, "LOG_LEVEL": "loud"}, {}):
        with pytest.raises(config.ConfigError):
            config.load(bad)
    with pytest.raises(config.ConfigError):
        config.check_disjoint([(c.pairs[0][0], c.pairs[0][0])])
    with pytest.raises(config.ConfigError):
        config.parse_ladder('[{"name":"x","width":0,"height":1,"videoBitrateKbps":1,"audioBitrateKbps":1}]')


def test_triggers(spark, tmp_path):
    assert trigger.is_one_shot(None, 0) and not trigger.is_one_shot("q", 0)
    assert trigger.serve(spark, lambda: {"processed": 1}) == {"processed": 1}
    calls, box, mark = [], tmp_path / "in", str(tmp_path / "mark")
    box.mkdir()
    (box / "1.json").write_text('{"payload": "x"}\n{"payload": "y"}\n')
    trigger.drain(spark, lambda: calls.append(1), str(box), mark)
    trigger.drain(spark, lambda: calls.append(1), str(box), mark)
    assert len(calls) == 1
    woken = threading.Event()
    query = trigger.serve(spark, lambda: woken.set() or {}, poll=1)
    try:
        assert woken.wait(60)
    finally:
        query.stop()


def test_programs(spark, tmp_path, monkeypatch):
    paths = spark.createDataFrame([("a", "hello"), ("b", "")], "source_key string, path string")
    got = {r["source_key"]: r for r in external.outputs(paths, lambda p: ["sh", "-c", f"test -n '{p}' && printf '%s' '{p}' || (echo gone >&2; exit 3)"]).collect()}
    assert bytes(got["a"]["output"]) == b"hello" and "gone" in got["b"]["error"]
    assert external.run_program(["/no/such/program"])[0] is None
    external.resolve.cache_clear()
    monkeypatch.setenv("FFMPEG_PATH", str(tmp_path / "missing"))
    with pytest.raises(FileNotFoundError):
        external.resolve("ffmpeg", "FFMPEG_PATH")
    (tmp_path / "f").write_bytes(b"abc")
    row = external.hashed(spark.createDataFrame([("k", str(tmp_path / "f"))], "source_key string, path string")).first()
    assert row["n_bytes"] == 3 and row["sha256"].startswith("ba7816bf")
    files = spark.createDataFrame([("p", "k", "t"), ("q", "", "t")], "path string, key string, content_type string")

    def put(path, key, kind):
        if not key:
            raise ValueError("no key")

    assert {r["path"]: r["error"] for r in external.uploaded(files, put).collect()} == {"p": None, "q": "no key"}


def test_budgets_back_off_trees_and_signatures(spark, tmp_path):
    times = iter([0.0, 1.0, 5.0, 11.0])
    got = pipeline.run_pairs({k: lambda: {"processed": 1} for k in "abc"}, budget=10, clock=lambda: next(times))
    assert list(got) == ["a", "b", "total"] and got["total"] == {"processed": 2}

    def gone():
        raise ConnectionError("no source")

    warned, slept = [], []
    assert trigger.patient(gone, warned.append, sleep=slept.append)() == {} and warned == ["no source"] and slept == [5.0]
    assert trigger.patient(lambda: {"processed": 1}, warned.append)() == {"processed": 1}
    (tmp_path / "v0").mkdir()
    (tmp_path / "master.m3u8").write_text("x")
    (tmp_path / "v0" / "seg_1.m4s").write_text("y")
    sent = tmp_path.parent / "sent.txt"

    def put(path, key, kind):
        with open(sent, "a") as f:
            f.write(f"{key} {kind}\n")

    assert {r["error"] for r in external.uploaded_tree(spark, f"file:{tmp_path}", "by-id/x/", put).collect()} == {None}
    assert sorted(sent.read_text().splitlines()) == ["by-id/x/master.m3u8 application/vnd.apple.mpegurl", "by-id/x/v0/seg_1.m4s video/iso.segment"]
    assert external.signature_args("a", "b")[-5:] == ["-vf", "signature=format=binary:filename=b", "-f", "null", "-"]


def test_logs():
    out, err = io.StringIO(), io.StringIO()
    log = logs.Logger("info", out, err)
    for level in config.LEVELS:
        log.emit(level, "m", n=1)
    assert len(out.getvalue().splitlines()) == 1 and len(err.getvalue().splitlines()) == 2
    assert json.loads(out.getvalue())["n"] == 1 and logs.exit_code({"failed": 2}) == 1 and logs.exit_code({}) == 0
