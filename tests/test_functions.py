"""Fixed cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from mediacat.functions import hashing, keys, media
from mediacat.sources import listing


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("key,video,image", [("a/b.MP4", True, False), ("x.m2ts", True, False), ("x.3gp", True, False), ("x.mp4.txt", False, False), ("a.mp4/b", False, False), ("mp4", False, False), ("p.JPeG", False, True), ("p.heic", False, True), ("", False, False)])
def test_file_types(spark, key, video, image):
    assert one(spark, key, "string", keys.is_video) is video
    assert one(spark, key, "string", keys.is_image) is image


@pytest.mark.parametrize("cid,scheme,rest", [("sha256:abc123", "sha256", "abc123"), ("psig:xyz", "psig", "xyz"), ("abc123", None, None), ("md5:abc", None, None), ("sha256:a:b", "sha256", "a:b")])
def test_content_ids(spark, cid, scheme, rest):
    assert one(spark, cid, "string", keys.scheme_of) == scheme
    assert one(spark, cid, "string", keys.id_of) == rest


def test_keys(spark):
    assert one(spark, "sha256:abc", "string", keys.master_key) == "by-id/sha256:abc/master.m3u8"
    assert one(spark, "a/b/c.mov", "string", keys.mapping_key) == "mappings/a/b/c.mov.json"
    back = lambda k: one(spark, k, "string", lambda x: keys.source_key_of(x, "image-mappings/"))
    assert back("image-mappings/uploads/0/x.jpg.json") == "uploads/0/x.jpg"
    assert back("mappings/x.mov.json") is None and back("image-mappings/x.txt") is None


@pytest.mark.parametrize("url,want", [("https://S3.Example.com:443/path", "https://s3.example.com"), ("http://h:9000", "http://h:9000"), ("http://h:80/", "http://h"), ("not a url", "not a url")])
def test_endpoints(spark, url, want):
    from mediacat.config import normal_endpoint

    assert one(spark, url, "string", keys.endpoint) == want == normal_endpoint(url)


@pytest.mark.parametrize("a,b,want", [([1, 2], [1, 2], 1.0), ([], [0], 0.0), ([0], [-1], 0.0), ([0, 0, 255], [0, 0], 1.0), ([0], [255], 0.875)])
def test_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(hashing.similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert got == want


def test_difference_hash(spark):
    down = [9 - c for _ in range(8) for c in range(9)]
    assert one(spark, down, "array<int>", hashing.dhash) == -1
    assert one(spark, [9 - x for x in down], "array<int>", hashing.dhash) == 0
    assert one(spark, [5] * 72, "array<int>", hashing.dhash) == 0


def test_frames(spark):
    raw = bytearray(range(72)) + bytearray(range(72, 144)) + b"xx"
    assert [bytes(f) for f in one(spark, raw, "binary", hashing.frames)] == [bytes(raw[:72]), bytes(raw[72:144])]
    assert one(spark, bytearray(b"x"), "binary", hashing.frames) == []


def test_blobs(spark):
    import struct

    from pyspark.sql import functions as F

    cases = [(2.5, [1, -1, 2**63 - 1, -(2**63)]), (1.0, []), (0.0, [0]), (2.0, [5]), (0.1, [7, 8]), (1999.999, [255]), (7.999999, [256])]
    df = spark.createDataFrame([(i, c, h) for i, (c, h) in enumerate(cases)], "i int, interval double, hashes array<long>")
    blob = hashing.to_blob(F.col("interval"), F.col("hashes"))
    rows = df.select("i", blob.alias("b")).select("i", "b", hashing.blob_hashes(F.col("b")).alias("h"), hashing.blob_interval(F.col("b")).alias("s")).collect()
    for r in rows:
        seconds, hashes = cases[r["i"]]
        assert bytes(r["b"]) == struct.pack(f"<fI{len(hashes)}q", seconds, len(hashes), *hashes)
        assert r["h"] == hashes and r["s"] == struct.unpack("<f", struct.pack("<f", seconds))[0]
    none = spark.createDataFrame([(None,)], "b binary").select(hashing.blob_hashes(F.col("b")).alias("h")).first()
    assert none["h"] is None
    for bad in (b"1234567", struct.pack("<fI2q", 1.0, 2, 1, 2)[:-1]):
        with pytest.raises(Exception, match="cut short"):
            spark.createDataFrame([(bytearray(bad),)], "b binary").select(hashing.blob_hashes(F.col("b"))).collect()


def test_bands_agree(spark):
    for t in (0.98, 0.95, 0.9375, 0.9):
        n = hashing.band_count(t)
        x = 0x123456789ABCDEF0
        far = x
        for i in range(n - 1):  # the most bits that may differ, spread out
            far ^= 1 << (i * 64 // n)
        df = spark.createDataFrame([(x, far)], "a long, b long").select(F.arrays_overlap(hashing.bands(F.col("a"), n), hashing.bands(F.col("b"), n)).alias("met"))
        assert df.first()["met"]


H = "a" * 64


@pytest.mark.parametrize("text,want", [(f"{H},87", (H, 87)), (f"hash,quality\n{H.upper()} 50 x", (H, 50)), (f"{H}", (H, 0)), (f"{H},130,99", (H, 99)), (f"{H}\t-1\tx\t7", (H, 7)), ("", None), ("no hash", None), ("0" * 64 + ",9", None), ("f" * 63, None)])
def test_pdq_output(spark, text, want):
    got = one(spark, text, "string", media.pdq)
    assert (got and tuple(got)) == want


def test_probe(spark):
    text = '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":4,"height":2}],"format":{"duration":"1.5","bit_rate":"2500"}}'
    assert tuple(one(spark, text, "string", media.probe)) == (4, 2, 1.5, 3, "h264", "aac", True)
    assert one(spark, '{"streams":[],"format":{}}', "string", media.probe)["has_audio"] is False


def test_ladder(spark):
    fit = lambda w, h: [r["name"] for r in spark.range(1).select(media.effective_ladder(F.lit(w), F.lit(h)).alias("l")).first()["l"]]
    assert fit(320, 240) == ["360p"] and fit(1280, 720) == ["360p", "480p", "720p"] and fit(3840, 2160)[-1] == "1080p"


def test_scan_drops_marks_and_holes(spark):
    rows = [("a/", '"e"', 0), ("a/x.mp4", '"e"', 5), ("b/x.mp4", None, 5), (None, "e", 1), ("a/y.txt", "e", 0)]
    df = spark.createDataFrame(rows, "source_key string, etag string, size long").withColumn("last_modified", F.current_timestamp())
    assert [tuple(r) for r in listing.scan(df).select("source_key", "etag").collect()] == [("a/x.mp4", "e")]
    assert listing.scan(df, "a/", None).count() == 2


def test_tree(spark, tmp_path):
    for name in ("p/a.mp4", "p/q/b.mov"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    got = {(r["source_key"], r["size"]) for r in listing.tree(spark, f"file:{tmp_path}", "p").collect()}
    assert got == {("p/a.mp4", 2), ("p/q/b.mov", 2)}
