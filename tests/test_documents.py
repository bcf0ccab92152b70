"""State as keyed JSON documents: decoding, encoding, import and export."""

import json

import pytest
from pyspark.sql import functions as F

from mediacat import pipeline
from mediacat.operators import state
from mediacat.sources import documents as D


def _docs(spark, bodies):
    return spark.createDataFrame([(f"k{i}", b) for i, b in enumerate(bodies)], "key string, body string")


def test_what_decodes_and_what_does_not(spark):
    good = {"sourceKey": "a/ü \"x\".mp4", "sourceEtag": "e", "sourceSize": 2**40, "error": "line\none", "failedAt": "t", "attempts": 3, "encoderVersion": "1", "unknown": [1]}
    bad = [
        ("", "document: broken JSON"),
        ('{"attempts": 1', "document: broken JSON"),
        ("[1]", "document: not an object"),
        ('"x"', "document: not an object"),
        ('{"attempts": "1"}', "attempts: not a whole number (int)"),
        ('{"attempts": 1.0}', "attempts: not a whole number (int)"),
        (f'{{"attempts": {2**31}}}', "attempts: not a whole number (int)"),
        (f'{{"sourceSize": {2**63}}}', "sourceSize: not a whole number (long)"),
        ('{"error": 5}', "error: not a string"),
        ('{"error": {}}', "error: not a string"),
    ]
    empty = [None, "null", "{}", '{"attempts": null}']
    rows = D.decoded(_docs(spark, [json.dumps(good), *empty, *[b for b, _ in bad]]), D.TOMBSTONE, "_error").orderBy(F.substring("key", 2, 9).cast("int")).collect()
    first = rows[0].asDict()
    assert (first["source_key"], first["source_size"], first["error"], first["attempts"], first["source_last_modified"], first["_error"]) == (good["sourceKey"], 2**40, "line\none", 3, None, None)
    assert all(set(r.asDict().values()) == {None, r["key"]} for r in rows[1 : 1 + len(empty)])
    assert [r["_error"] for r in rows[1 + len(empty) :]] == [e for _, e in bad]
    assert all(r["source_key"] is None and r["attempts"] is None for r in rows[1:])


def test_nested_documents_come_back(spark):
    rows = [("c1", "1", "t", (10, 20, 1.5, None), [("a", 1, 2, 3, 4), ("b", 5, 6, 7, 8)]), ("c2", None, "t", (1, 2, 3.0, 9), []), ("c3", "1", None, None, None)]
    table = spark.createDataFrame(rows, pipeline.METADATA)
    docs = table.select(F.col("content_id").alias("key"), D.body(D.METADATA).alias("body"))
    texts = {r["key"]: r["body"] for r in docs.collect()}
    assert texts["c1"] == json.dumps(json.loads(texts["c1"]), indent=2) and "bitrateKbps\": null" not in texts["c1"]
    assert json.loads(texts["c1"])["ladder"][1] == {"name": "b", "width": 5, "height": 6, "videoBitrateKbps": 7, "audioBitrateKbps": 8}
    back = D.decoded(docs, D.METADATA)
    assert back.filter("error is not null").count() == 0
    assert sorted(map(tuple, back.drop("key", "error").collect())) == sorted(map(tuple, table.collect()))
    wrong = D.decoded(_docs(spark, ['{"ladder": [{"name": "a"}, {"width": "x"}]}', '{"source": {"durationSeconds": true}}', '{"ladder": {}}', '{"source": []}']), D.METADATA)
    assert [r["error"] for r in wrong.orderBy("key").collect()] == ["ladder[].width: not a whole number (int)", "source.durationSeconds: not a number", "ladder: not a list", "source: not an object"]


def test_versions_of_an_index(spark):
    entry = '{"contentId": "%s", "intervalSeconds": 2, "hashCount": 3, "width": 1, "height": 1, "encodedAt": "t"}'
    bodies = ['{"version": 1, "entries": [%s, %s]}' % (entry % "a", entry % "b"), '{"version": 1, "entries": null}', None, '{"version": 2, "entries": []}', "{}", '{"version": "1"}', '{"version": 1, "entries": [{"width": 0.5}]}']
    rows = D.index_entries(_docs(spark, bodies)).orderBy("key", "insert_seq").collect()
    assert [(r["content_id"], r["interval_seconds"], r["video_bitrate_kbps"], r["insert_seq"]) for r in rows[:2]] == [("a", 2.0, None, 0), ("b", 2.0, None, 1)]
    assert [(r["key"], r["error"]) for r in rows[2:]] == [
        ("k3", "unsupported fingerprint index version: 2"),
        ("k4", "unsupported fingerprint index version: 0"),
        ("k5", "version: not a whole number (long)"),
        ("k6", "entries[].width: not a whole number (int)"),
    ]


def _filled(spark, root):
    store = state.TableStore(spark, f"file:{root}")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "mappings": make([(f"v/{n} ü+%20.mp4", "e", n, "t", "sha256:c", "by-id/sha256:c/master.m3u8", "t", "1") for n in range(5)], pipeline.MAPPING),
        "image_mappings": make([("i.png", "e", 1, "t", "ab" * 32, 50, "t", "1")], pipeline.IMAGE_MAPPING),
        "tombstones": make([("v/x.mp4", "e", 1, "t", "no\n\"good\"", "t", 2, "1")], pipeline.TOMBSTONE),
        "image_tombstones": make([("i2.PNG", "e", 1, None, "bad", "t", 1, "1")], pipeline.TOMBSTONE),
        "metadata": make([("sha256:c", "1", "t", (1, 2, 3.5, None), [("a", 1, 2, 3, 4)])], pipeline.METADATA),
        "index": make([(f"sha256:{n:02d}", 2.0, 3, 1, 1, None if n % 2 else n, "t", 7 * n) for n in range(25)], pipeline.INDEX),
        "blobs": make([("sha256:c", bytearray(b"\x00\x01\xff"))], pipeline.BLOB),
    }
    for name, df in tables.items():
        store.write(name, df)
    return store


def test_a_state_goes_out_and_comes_back(spark, tmp_path):
    store = _filled(spark, tmp_path / "a")
    folder = D.Folder(f"file:{tmp_path}/out")
    for _ in range(2):  # repeatable
        assert D.exported(store, folder.put, most=10).filter("error is not null").count() == 0
    folder.put("by-id/sha256:c/master.m3u8", b"#EXTM3U", "x")
    folder.put("by-id/sha256:c/360p/a.m4s", b"1", "x")
    assert (tmp_path / "out/mappings/v/3 ü+%20.mp4.json").exists() and (tmp_path / "out/errors/i2.PNG.json").exists()
    indexes = [json.loads(p.read_text()) for p in (tmp_path / "out/fingerprints").glob("index*.json")]
    assert len(indexes) == 3 and sum(len(i["entries"]) for i in indexes) == 25 and {i["version"] for i in indexes} == {1}
    assert "videoBitrateKbps" not in next(e for i in indexes for e in i["entries"] if e["contentId"] == "sha256:01")
    other = state.TableStore(spark, f"file:{tmp_path}/b")
    counts = D.imported(other, f"file:{tmp_path}/out")
    assert counts == {"mappings": 5, "image_mappings": 1, "metadata": 1, "index": 25, "tombstones": 1, "image_tombstones": 1, "blobs": 1, "outputs": 3}
    for name, schema in (("mappings", pipeline.MAPPING), ("image_mappings", pipeline.IMAGE_MAPPING), ("tombstones", pipeline.TOMBSTONE), ("image_tombstones", pipeline.TOMBSTONE), ("metadata", pipeline.METADATA), ("blobs", pipeline.BLOB)):
        assert sorted(map(str, other.read(name, schema).collect())) == sorted(map(str, store.read(name, schema).collect())), name
    order = lambda s: [r["content_id"] for r in s.read("index", pipeline.INDEX).orderBy("insert_seq").collect()]
    assert order(other) == order(store)
    assert {r["rel_path"] for r in other.read("outputs", pipeline.OUTPUT).collect()} == {"master.m3u8", "360p/a.m4s", "metadata.json"}


def test_one_bad_document_changes_nothing(spark, tmp_path):
    store = _filled(spark, tmp_path / "a")
    folder = D.Folder(str(tmp_path / "out"))
    folder.put("mappings/x.mp4.json", b'{"sourceKey": "x.mp4"', "x")
    with pytest.raises(D.Invalid, match=r"mappings/x.mp4.json: document: broken JSON"):
        D.imported(store, f"file:{tmp_path}/out")
    folder.put("mappings/x.mp4.json", b'{"sourceKey": "x.mp4"}', "x")
    folder.put("fingerprints/index.json", b'{"version": 3}', "x")
    with pytest.raises(D.Invalid, match="unsupported fingerprint index version: 3"):
        D.imported(store, f"file:{tmp_path}/out")
    assert store.read("mappings", pipeline.MAPPING).count() == 5
    folder.remove("fingerprints/index.json")
    folder.remove("fingerprints/index.json")
    assert D.imported(store, f"file:{tmp_path}/out")["mappings"] == 1
    assert store.read("index", pipeline.INDEX).count() == 0 == store.read("blobs", pipeline.BLOB).count()


def test_failed_puts_are_rows(spark, tmp_path):
    def put(key, data, kind):
        if "v/x" in key:
            raise OSError("full")

    bad = D.exported(_filled(spark, tmp_path / "a"), put).filter("error is not null").collect()
    assert [tuple(r) for r in bad] == [("errors/v/x.mp4.json", "full")]


def test_an_empty_state(spark, tmp_path):
    store = state.TableStore(spark, f"file:{tmp_path}/a")
    folder = D.Folder(str(tmp_path / "out"))
    assert [tuple(r) for r in D.exported(store, folder.put).collect()] == [("fingerprints/index.json", None)]
    assert json.loads((tmp_path / "out/fingerprints/index.json").read_text()) == {"version": 1, "entries": []}
    assert set(D.imported(store, f"file:{tmp_path}/out").values()) == {0}
