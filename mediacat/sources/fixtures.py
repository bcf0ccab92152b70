"""A media catalog made from the driver's tables, in Spark and as SQL views.

The tables hold no media. Documents stand for source objects and their bytes, error events
for earlier failures, embeddings' signs for frame hashes. What earlier runs have done to an
object (mapped it, mapped an older version, lost it since) follows from digits of the md5 of
its key, so that every state occurs at every scale. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import hashing, keys, media

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RUN_AT, ENCODED_AT, VERSION = "2024-06-01T00:00:00Z", "2024-05-01T00:00:00Z", "1.0.0"
EXTENSIONS = (".mp4", ".MOV", ".mkv", ".jpg", ".PNG", ".webp", ".txt", "")
OUTPUT_FILES = ("master.m3u8", "metadata.json", "360p/index.m3u8", "360p/init.mp4", "360p/seg_00000.m4s", "360p/seg_00001.m4s", "720p/index.m3u8", "720p/init.mp4", "720p/seg_00000.m4s")
WIDTHS, HEIGHTS = (320, 640, 854, 1280, 1920, 3840), (240, 360, 480, 720, 1080, 2160)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def _digit(key: Column, place: int) -> Column:
    return F.substring(F.md5(key), place, 1)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, etag (quoted), size, last_modified, content, doc_id."""
    d = _table(spark, sf_dir, "documents")
    key = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), _pick(EXTENSIONS, F.col("doc_id") % len(EXTENSIONS)))
    etag = F.concat(F.lit('"'), F.md5("text"), F.lit('"'))
    return d.select(key.alias("source_key"), etag.alias("etag"), F.col("n_chars").alias("size"), F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("last_modified"), F.col("text").alias("content"), "doc_id")


def source_time(last_modified: Column) -> Column:
    return F.date_format(last_modified, ISO)


def digest(content: Column) -> Column:
    return keys.content_id("sha256", F.sha2(content, 256))


def _mapped(s: DataFrame) -> DataFrame:
    key = F.col("source_key")
    etag = F.replace("etag", F.lit('"'), F.lit(""))
    stale = _digit(key, 2) == "0"
    return s.filter(_digit(key, 1) < "b").withColumns({"etag": F.when(stale, F.concat(F.lit("old-"), etag)).otherwise(etag), "content_id": digest(F.col("content"))})


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(source(spark, sf_dir).filter(keys.is_video(F.col("source_key"))))
    return m.select("source_key", F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), source_time(F.col("last_modified")).alias("source_last_modified"), "content_id", keys.master_key(F.col("content_id")).alias("hls_root"), F.lit(ENCODED_AT).alias("encoded_at"), F.lit(VERSION).alias("encoder_version"))


def image_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(source(spark, sf_dir).filter(keys.is_image(F.col("source_key"))))
    return m.select("source_key", F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), source_time(F.col("last_modified")).alias("source_last_modified"), F.sha2("content", 256).alias("pdq_hash"), (F.col("doc_id") % 101).cast("int").alias("quality"), F.lit(ENCODED_AT).alias("hashed_at"), F.lit(VERSION).alias("hasher_version"))


def tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's error events are the failed attempts on the object whose document has the user's number."""
    failed = _table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    s = source(spark, sf_dir).join(failed, "doc_id")
    attempts = F.when(_digit(F.col("source_key"), 4) < "8", F.lit(2)).otherwise(F.col("attempts"))
    return s.select("source_key", F.replace("etag", F.lit('"'), F.lit("")).alias("source_etag"), F.col("size").alias("source_size"), source_time(F.col("last_modified")).alias("source_last_modified"), F.lit("decode failed").alias("error"), F.lit(ENCODED_AT).alias("failed_at"), attempts.alias("attempts"), F.lit(VERSION).alias("encoder_version"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that still exist."""
    return source(spark, sf_dir).filter(_digit(F.col("source_key"), 3) > "2").select("source_key")


def output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, rel_path of finished outputs."""
    return mapping(spark, sf_dir).select("content_id").distinct().select("content_id", F.explode(F.array(*map(F.lit, OUTPUT_FILES))).alias("rel_path"))


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, frame, pixels: code points of all whole frames of 72 characters of each text."""
    pieces = F.regexp_extract_all("text", F.lit("(?s).{72}"), F.lit(0))
    frames = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("frame", "piece"))
    return frames.select("doc_id", "frame", F.transform(F.regexp_extract_all("piece", F.lit("(?s)."), F.lit(0)), F.ascii).alias("pixels"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", _pick(WIDTHS, d % 6).alias("width"), _pick(HEIGHTS, d % 6).alias("height"), F.when(d % 7 != 0, (500 + d % 4000).cast("int")).alias("bitrate_kbps"), (F.col("n_chars") / 10.0).alias("duration_seconds"), (d % 4 != 0).alias("has_audio"))


def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":'), F.col("width").cast("string"), F.lit(',"height":'), F.col("height").cast("string"), F.lit("}"))
    audio = F.lit('{"codec_type":"audio","codec_name":"aac"}')
    streams = F.when(~F.col("has_audio"), video).when(F.col("doc_id") % 2 == 1, F.concat(audio, F.lit(","), video)).otherwise(F.concat(video, F.lit(","), audio))
    rate = F.when(F.col("bitrate_kbps").isNull(), F.lit("")).otherwise(F.concat(F.lit(',"bit_rate":"'), (F.col("bitrate_kbps").cast("long") * 1000 + F.col("doc_id") % 1000).cast("string"), F.lit('"')))
    p = probes(spark, sf_dir)
    return p.select("doc_id", F.concat(F.lit('{"streams":['), streams, F.lit('],"format":{"duration":"'), F.col("doc_id").cast("string"), F.lit('.5"'), rate, F.lit("}}")).alias("probe"))


def pdq_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h = F.col("doc_id"), F.sha2("text", 256)
    q = (d % 130).cast("string")
    plain = F.concat(F.lit("hash,quality,filename\n"), h, F.lit(","), q, F.lit(",x.jpg"))
    tabs = F.concat(F.upper(h), F.lit("\t"), q, F.lit("\tx.jpg\r\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(d % 9 == 8, F.lit("error: no image\n")).when(d % 9 == 7, F.concat(F.lit("0" * 64), F.lit(" 50"))).when(d % 3 == 2, tabs).otherwise(plain).alias("stdout"))


def own_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, hashes: four frames a video from the signs of four vectors."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    f = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("video"), (F.col("vec_id") % 4).cast("int").alias("frame"), bits.alias("h"))
    return f.groupBy("video").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "h"))), lambda x: x["h"]).alias("hashes"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, hashes, n, original, kind: the videos (kind 0) with planted near copies.

    Copies with one bit of each frame flipped (kind 1) have the number of their original plus
    100000, copies without the last frame (kind 2) plus 200000; where the videos' numbers do
    not fit under 100000, the next power of ten that they fit under stands for it.
    """
    own = own_frames(spark, sf_dir).withColumn("original", F.col("video"))
    span = F.max("v") - F.least(F.min("v"), F.lit(0))
    ids = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("v"))
    step = ids.agg(F.greatest(F.lit(100000), F.pow(F.lit(10), F.length(span.cast("string"))).cast("long")).alias("step")).scalar()
    flipped = own.withColumns({"video": F.col("video") + step, "hashes": F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(1).cast("long")))})
    short = own.withColumns({"video": F.col("video") + 2 * step, "hashes": F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0)))})
    kinds = [df.withColumn("kind", F.lit(k)) for k, df in enumerate((own, flipped, short))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("n", F.size("hashes"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, hash_count, width, height, video_bitrate_kbps, insert_seq: an index entry for each mapped content."""
    m = mapping(spark, sf_dir).groupBy("content_id").agg(F.min("source_key").alias("k"))
    key = F.regexp_extract("k", r"doc-(\d+)", 1).cast("long")
    return m.select("content_id", (key % 50 + 1).cast("int").alias("hash_count"), _pick(WIDTHS, key % 6).alias("width"), _pick(HEIGHTS, key % 6).alias("height"), F.when(key % 7 != 0, (500 + key % 4000).cast("int")).alias("video_bitrate_kbps"), key.alias("insert_seq"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, side (source or dest), endpoint, bucket, prefix: a bucket of a pair for each page's url, its host spelled in different ways."""
    u = _table(spark, sf_dir, "pages").filter(F.col("url").contains("://")).select("page_id", F.regexp_extract("url", "^([^:]+://[^/?#:]+)", 1).alias("at"), F.regexp_extract("url", "^[^:]+://[^/?#]+/([^?#]*)", 1).alias("prefix"))
    p = F.col("page_id")
    at = F.when(p % 3 == 0, F.upper("at")).when((p % 3 == 1) & F.startswith("at", F.lit("https")), F.concat("at", F.lit(":443"))).otherwise(F.col("at"))
    return u.select("page_id", F.when(p % 2 == 0, "source").otherwise("dest").alias("side"), at.alias("endpoint"), F.concat(F.lit("b"), (p % 3).cast("string")).alias("bucket"), "prefix")


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey and what a bucket, its pair and the environment say of a key and a region; empty where nothing."""
    k = F.col("c_custkey")
    some = lambda when, what: F.when(when, what).otherwise(F.lit(""))
    return _table(spark, sf_dir, "customer").select(k, some(k % 3 == 0, F.col("c_name")).alias("key_bucket"), some(k % 2 == 0, F.concat(F.lit("pair-"), "c_name")).alias("key_pair"), some(k % 5 != 0, F.lit("env")).alias("key_env"), some(k % 4 == 0, F.lower("c_mktsegment")).alias("region_bucket"), some(k % 7 == 0, F.lit("ap")).alias("region_pair"), some(k % 11 == 0, F.lit("us")).alias("region_env"))


def ladder_rungs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(media.LADDER)], "ord int, name string, width int, height int, video_bitrate_kbps int, audio_bitrate_kbps int")


def hash_text(h: Column) -> Column:
    return hashing.hex64(h)


# The same views as SQL.
def _case(values: tuple, at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


_STATE = "substr(md5(source_key), {}, 1)"
_MAPPED = f"SELECT * REPLACE (CASE WHEN {_STATE.format(2)} = '0' THEN 'old-' ELSE '' END || replace(etag, '\"', '') AS etag), 'sha256:' || sha256(content) AS content_id FROM v_source WHERE {_STATE.format(1)} < 'b'"
_EXT = "lower(regexp_extract(regexp_extract({}, '[^/]*$'), '\\.([^.]*)$', 1))"
EXT = _EXT.format("source_key")
IS_VIDEO = f"{EXT} IN {keys.VIDEO}"
IS_IMAGE = f"{EXT} IN {keys.IMAGE}"
VIEWS = {
    "v_source": f"""SELECT source || '/' || lang || '/doc-' || doc_id || {_case(EXTENSIONS, f'doc_id % {len(EXTENSIONS)}')} AS source_key, '"' || md5(text) || '"' AS etag, n_chars AS size,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS last_modified, text AS content, doc_id FROM documents""",
    "v_mapped": _MAPPED,
    "v_mapping": f"""SELECT source_key, etag AS source_etag, size AS source_size, last_modified AS source_last_modified, content_id, 'by-id/' || content_id || '/master.m3u8' AS hls_root, '{ENCODED_AT}' AS encoded_at, '{VERSION}' AS encoder_version
  FROM v_mapped WHERE {IS_VIDEO}""",
    "v_image_mapping": f"""SELECT source_key, etag AS source_etag, size AS source_size, last_modified AS source_last_modified, sha256(content) AS pdq_hash, (doc_id % 101)::INTEGER AS quality, '{ENCODED_AT}' AS hashed_at, '{VERSION}' AS hasher_version FROM v_mapped WHERE {IS_IMAGE}""",
    "v_tombstone": f"""SELECT source_key, replace(etag, '"', '') AS source_etag, size AS source_size, last_modified AS source_last_modified, 'decode failed' AS error, '{ENCODED_AT}' AS failed_at,
  (CASE WHEN {_STATE.format(4)} < '8' THEN 2 ELSE n END)::INTEGER AS attempts, '{VERSION}' AS encoder_version
  FROM v_source JOIN (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (doc_id)""",
    "v_live": f"SELECT source_key FROM v_source WHERE {_STATE.format(3)} > '2'",
    "v_output": f"SELECT content_id, unnest({list(OUTPUT_FILES)}) AS rel_path FROM (SELECT DISTINCT content_id FROM v_mapping)",
    "v_frame_pixels": """SELECT doc_id, frame, list_transform(range(1, 73), lambda i: unicode(substr(piece, i, 1))) AS pixels
  FROM (SELECT doc_id, frame::INTEGER AS frame, substr(text, frame * 72 + 1, 72) AS piece FROM (SELECT doc_id, text, unnest(range(length(text) // 72)) AS frame FROM documents))""",
    "v_probe": f"SELECT doc_id, {_case(WIDTHS, 'doc_id % 6')} AS width, {_case(HEIGHTS, 'doc_id % 6')} AS height, CASE WHEN doc_id % 7 <> 0 THEN (500 + doc_id % 4000)::INTEGER END AS bitrate_kbps, n_chars / 10.0 AS duration_seconds, doc_id % 4 <> 0 AS has_audio FROM documents",
    "v_pdq": """SELECT doc_id, sha256(text) AS h, doc_id % 130 AS q FROM documents""",
    "v_frame": "SELECT vec_id // 4 AS video, vec_id % 4 AS frame, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT AS h FROM embeddings",
    "v_own": "SELECT video, list(h ORDER BY frame) AS hashes FROM v_frame GROUP BY video",
    "v_fingerprint": """SELECT *, len(hashes) AS n FROM (SELECT video, hashes FROM v_own UNION ALL SELECT video + 100000, list_transform(hashes, lambda h: xor(h, 1::UBIGINT)) FROM v_own
  UNION ALL SELECT video + 200000, list_slice(hashes, 1, len(hashes) - 1) FROM v_own)""",
    "v_index": f"""SELECT content_id, (k % 50 + 1)::INTEGER AS hash_count, {_case(WIDTHS, 'k % 6')} AS width, {_case(HEIGHTS, 'k % 6')} AS height, CASE WHEN k % 7 <> 0 THEN (500 + k % 4000)::INTEGER END AS video_bitrate_kbps, k AS insert_seq
  FROM (SELECT content_id, regexp_extract(min(source_key), 'doc-(\\d+)', 1)::BIGINT AS k FROM v_mapping GROUP BY 1)""",
    "v_bucket": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'source' ELSE 'dest' END AS side, CASE WHEN page_id % 3 = 0 THEN upper(site) WHEN page_id % 3 = 1 AND starts_with(site, 'https') THEN site || ':443' ELSE site END AS endpoint, 'b' || page_id % 3 AS bucket, prefix
  FROM (SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#:]+)', 1) AS site, regexp_extract(url, '^[^:]+://[^/?#]+/([^?#]*)', 1) AS prefix FROM pages WHERE contains(url, '://'))""",
    "v_credential": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS key_bucket, CASE WHEN c_custkey % 2 = 0 THEN 'pair-' || c_name ELSE '' END AS key_pair, CASE WHEN c_custkey % 5 <> 0 THEN 'env' ELSE '' END AS key_env,
  CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE '' END AS region_bucket, CASE WHEN c_custkey % 7 = 0 THEN 'ap' ELSE '' END AS region_pair, CASE WHEN c_custkey % 11 = 0 THEN 'us' ELSE '' END AS region_env FROM customer""",
    "v_ladder": "SELECT * FROM (VALUES " + ", ".join(str((i, *r)) for i, r in enumerate(media.LADDER)) + ") t(ord, name, w, h, video_kbps, audio_kbps)",
}


def with_views(body: str) -> str:
    """The SQL with the views that it names, directly or through others."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in need and _names(text, name):
                add(view)
                need.append(name)

    add(body)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need) + "\n" if need else "") + body


def _names(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None
