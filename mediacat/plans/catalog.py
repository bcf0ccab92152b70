"""Catalog queries by name, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat import pipeline
from mediacat.functions import errors, hashing, keys, media
from mediacat.operators import cleanup, gates, resolve, similar, state
from mediacat.operators.scratch import scratch_dir, stored
from mediacat.sources import fixtures as X
from mediacat.sources import documents, listing, paged

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = X.with_views(sql)
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


_ETAG = "replace(etag, '\"', '') AS etag"


def _iso(df: DataFrame) -> DataFrame:
    return df.withColumn("last_modified", F.date_format("last_modified", ISO))


def _sources(spark: SparkSession, sf: str, where=keys.is_video) -> DataFrame:
    return listing.scan(X.source(spark, sf), where=where)


@query(f"SELECT source_key, {_ETAG}, size, last_modified FROM v_source WHERE {X.IS_VIDEO} AND NOT (source_key LIKE '%/' AND size = 0)")
def source_scan(spark, sf):
    return _iso(_sources(spark, sf)).select("source_key", "etag", "size", "last_modified").orderBy("source_key")


@query(f"SELECT source_key, {_ETAG}, size, last_modified FROM v_source WHERE starts_with(source_key, 'src1/')")
def source_scan_prefix(spark, sf):
    return _iso(listing.scan(X.source(spark, sf), "src1/", None)).select("source_key", "etag", "size", "last_modified")


@query(f"SELECT source_key, {X.EXT} AS ext, {X.IS_VIDEO} AS is_video FROM (SELECT source_key FROM v_source UNION ALL SELECT url FROM pages)")
def video_keys(spark, sf):
    k = F.col("source_key")
    return _all_keys(spark, sf).select(k, keys.extension(k).alias("ext"), keys.is_video(k).alias("is_video"))


@query(f"SELECT source_key, {X.EXT} AS ext, {X.IS_IMAGE} AS is_image FROM (SELECT source_key FROM v_source UNION ALL SELECT url FROM pages)")
def image_keys(spark, sf):
    k = F.col("source_key")
    return _all_keys(spark, sf).select(k, keys.extension(k).alias("ext"), keys.is_image(k).alias("is_image"))


def _all_keys(spark, sf):
    return X.source(spark, sf).select("source_key").unionByName(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("source_key")))


@query(f"SELECT count(*) AS keys, count(*) FILTER (WHERE {X.IS_VIDEO} AND {X.IS_IMAGE}) AS n FROM (SELECT source_key FROM v_source UNION ALL SELECT url FROM pages)")
def ext_disjoint(spark, sf):
    """How many of all keys are of both kinds: none."""
    k = F.col("source_key")
    return _all_keys(spark, sf).agg(F.count(F.lit(1)).alias("keys"), F.count_if(keys.is_video(k) & keys.is_image(k)).alias("n"))


@query("SELECT s.source_key, m.content_id IS NOT NULL AS found, m.content_id, m.hls_root FROM v_source s LEFT JOIN v_mapping m USING (source_key)")
def mapping_lookup(spark, sf):
    s = X.source(spark, sf).select("source_key").join(X.mapping(spark, sf), "source_key", "left")
    return s.select("source_key", F.col("content_id").isNotNull().alias("found"), "content_id", "hls_root")


@query("SELECT s.source_key, m.pdq_hash, m.quality FROM v_source s LEFT JOIN v_image_mapping m USING (source_key)")
def image_mapping_lookup(spark, sf):
    return X.source(spark, sf).select("source_key").join(X.image_mapping(spark, sf), "source_key", "left").select("source_key", "pdq_hash", "quality")


def _cached_sql(kind: str, view: str) -> str:
    return f"SELECT s.source_key, m.source_key IS NOT NULL AS cached FROM v_source s LEFT JOIN {view} m ON s.source_key = m.source_key AND replace(s.etag, '\"', '') = m.source_etag AND s.size = m.source_size WHERE {_EXT('s.source_key')} IN {kind}"


def _EXT(key: str) -> str:  # noqa: N802
    return X._EXT.format(key)


@query(_cached_sql(str(keys.VIDEO), "v_mapping"))
def cache_split(spark, sf):
    return gates.cached(_sources(spark, sf), X.mapping(spark, sf)).select("source_key", "cached")


@query(_cached_sql(str(keys.IMAGE), "v_image_mapping"))
def image_cache_split(spark, sf):
    return gates.cached(_sources(spark, sf, keys.is_image), X.image_mapping(spark, sf)).select("source_key", "cached")


@query("SELECT s.source_key, coalesce(t.attempts, 0)::INTEGER AS attempts, coalesce(t.attempts >= 3, false) AS blocked FROM v_source s LEFT JOIN v_tombstone t ON s.source_key = t.source_key AND replace(s.etag, '\"', '') = t.source_etag AND s.size = t.source_size")
def tombstone_gate(spark, sf):
    return gates.blocked(_sources(spark, sf, None), X.tombstone(spark, sf)).select("source_key", "attempts", "blocked")


@query("SELECT source_key, 'sha256:' || sha256(content) AS content_id, strlen(content)::BIGINT AS n_bytes FROM v_source")
def content_id(spark, sf):
    return X.source(spark, sf).select("source_key", X.digest(F.col("content")).alias("content_id"), F.octet_length("content").cast("long").alias("n_bytes"))


_CIDS = "(SELECT DISTINCT content_id AS cid FROM v_mapping UNION ALL SELECT unnest(['psig:xyz', 'abc123', 'md5:abc', 'sha256:a:b', '']))"


@query(f"SELECT cid, CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN substr(cid, strpos(cid, ':') + 1) END AS id FROM (SELECT cid, split_part(cid, ':', 1) AS scheme, strpos(cid, ':') > 0 AND split_part(cid, ':', 1) IN ('sha256', 'psig') AS ok FROM {_CIDS})")
def content_id_parse(spark, sf):
    odd = spark.createDataFrame([(x,) for x in ("psig:xyz", "abc123", "md5:abc", "sha256:a:b", "")], "cid string")
    c = X.mapping(spark, sf).select(F.col("content_id").alias("cid")).distinct().unionByName(odd)
    return c.select("cid", keys.scheme_of(F.col("cid")).alias("scheme"), keys.id_of(F.col("cid")).alias("id"))


_CONTENT = "(SELECT source_key, 'sha256:' || sha256(content) AS content_id FROM v_source)"


def _content(spark, sf):
    return X.source(spark, sf).select("source_key", X.digest(F.col("content")).alias("content_id"))


@query(f"SELECT content_id, min(source_key) AS source_key, count(*) AS copies FROM {_CONTENT} GROUP BY 1")
def canonical_source(spark, sf):
    return gates.canonical(_content(spark, sf))


@query(f"SELECT source_key, content_id FROM {_CONTENT} WHERE content_id IN (SELECT content_id FROM v_output WHERE rel_path = 'master.m3u8')")
def byte_hash_dedup(spark, sf):
    return gates.known_bytes(_content(spark, sf), X.output(spark, sf))


_BUILT = f"""SELECT source_key, replace(etag, '"', '') AS source_etag, size AS source_size, last_modified AS source_last_modified, 'sha256:' || sha256(content) AS content_id,
  'by-id/sha256:' || sha256(content) || '/master.m3u8' AS hls_root, '{X.RUN_AT}' AS encoded_at, '{X.VERSION}' AS encoder_version FROM v_source"""


@query(_BUILT)
def mapping_build(spark, sf):
    s = _iso(_sources(spark, sf, None)).withColumn("content_id", X.digest(F.col("content")))
    return s.select("source_key", F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), F.col("last_modified").alias("source_last_modified"), "content_id", keys.master_key(F.col("content_id")).alias("hls_root"), F.lit(X.RUN_AT).alias("encoded_at"), F.lit(X.VERSION).alias("encoder_version"))


@query("""SELECT key, CASE WHEN starts_with(key, 'mappings/') AND ends_with(key, '.json') AND length(key) >= 14 THEN substr(key, 10, length(key) - 14) END AS source_key,
  CASE WHEN starts_with(key, 'image-mappings/') AND ends_with(key, '.json') AND length(key) >= 20 THEN substr(key, 16, length(key) - 20) END AS image_key
FROM (SELECT 'mappings/' || source_key || '.json' AS key FROM v_source UNION ALL SELECT 'image-mappings/' || source_key || '.json' FROM v_source UNION ALL SELECT source_key FROM v_source)""")
def mapping_key_roundtrip(spark, sf):
    k = F.col("source_key")
    s = X.source(spark, sf).select(F.explode(F.array(keys.mapping_key(k), keys.image_mapping_key(k), k)).alias("key"))
    return s.select("key", keys.source_key_of(F.col("key")).alias("source_key"), keys.source_key_of(F.col("key"), "image-mappings/").alias("image_key"))


@query("""SELECT source_key, 'image-mappings/' || source_key || '.json' AS image_key, 'errors/' || source_key || '.json' AS tombstone_key, 'by-id/' || c || '/master.m3u8' AS master_key,
  'by-id/' || c || '/metadata.json' AS metadata_key, 'fingerprints/' || c || '.bin' AS fingerprint_key, 'by-id/' || c || '/.processing' AS lease_key FROM (SELECT source_key, 'sha256:' || sha256(content) AS c FROM v_source)""")
def derived_keys(spark, sf):
    k, c = F.col("source_key"), F.col("content_id")
    return _content(spark, sf).select(k, keys.image_mapping_key(k).alias("image_key"), keys.tombstone_key(k).alias("tombstone_key"), keys.master_key(c).alias("master_key"), keys.metadata_key(c).alias("metadata_key"), keys.fingerprint_key(c).alias("fingerprint_key"), keys.lease_key(c).alias("lease_key"))


@query("SELECT name, CASE WHEN ends_with(name, '.m3u8') THEN 'application/vnd.apple.mpegurl' WHEN ends_with(name, '.m4s') THEN 'video/iso.segment' WHEN ends_with(name, '.mp4') THEN 'video/mp4' WHEN ends_with(name, '.ts') THEN 'video/mp2t' WHEN ends_with(name, '.vtt') THEN 'text/vtt' WHEN ends_with(name, '.json') THEN 'application/json' ELSE 'application/octet-stream' END AS content_type FROM (SELECT rel_path AS name FROM v_output UNION ALL SELECT source_key FROM v_source)")
def content_type(spark, sf):
    names = X.output(spark, sf).select(F.col("rel_path").alias("name")).unionByName(X.source(spark, sf).select(F.col("source_key").alias("name")))
    return names.select("name", keys.content_type(F.col("name")).alias("content_type"))


# hashes
@query("SELECT a.video, a.frame::INTEGER AS frame, bit_count(xor(a.h, b.h))::INTEGER AS distance, lower(lpad(to_hex(a.h), 16, '0')) AS h FROM v_frame a JOIN v_frame b ON a.video = b.video AND b.frame = 0")
def hamming(spark, sf):
    return X.own_frames(spark, sf).select("video", F.get("hashes", F.lit(0)).alias("first"), F.posexplode("hashes").alias("frame", "x")).select("video", "frame", hashing.hamming(F.col("first"), F.col("x")).cast("int").alias("distance"), hashing.hex64(F.col("x")).alias("h"))


@query("SELECT doc_id, frame, lower(lpad(to_hex(list_sum(list_transform(range(64), lambda i: CASE WHEN pixels[(i // 8) * 9 + i % 8 + 1] > pixels[(i // 8) * 9 + i % 8 + 2] THEN (1::UBIGINT << i)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT), 16, '0')) AS hash FROM v_frame_pixels")
def dhash(spark, sf):
    """All frames of whole texts."""
    return X.frame_pixels(spark, sf).select("doc_id", "frame", hashing.hex64(hashing.dhash(F.col("pixels"))).alias("hash"))


_SIM = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - list_sum(list_transform(range(1, least(a.n, b.n) + 1), lambda i: bit_count(xor(a.hashes[i], b.hashes[i]))))::DOUBLE / least(a.n, b.n) / 64))"


@query("SELECT a.n AS n, b.n AS m, a.n > 0 AND b.n > 0 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7 AS near, count(*) AS pairs FROM v_fingerprint a JOIN v_fingerprint b ON b.video = a.video + 200000 GROUP BY ALL")
def ratio_prefilter(spark, sf):
    f = X.fingerprint(spark, sf)
    p = f.filter("kind = 0").select("original", "n").join(f.filter("kind = 2").select("original", F.col("n").alias("m")), "original")
    return p.groupBy(F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), similar.near_length("n", "m").alias("near")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"SELECT a.video AS a, b.video AS b, round({_SIM}, 9) AS similarity FROM v_fingerprint a JOIN v_fingerprint b ON a.video < b.video WHERE least(a.n, b.n) > 0 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7 AND {_SIM} >= 0.95")
def perceptual_pairs(spark, sf):
    f = X.fingerprint(spark, sf)
    return similar.pairs(f, f).filter("a < b").withColumn("similarity", F.round("similarity", 9))


@query(f"""SELECT a, arg_max(b, s * 1000000 - b / 10000000.0) AS b, round(max(s), 9) AS similarity FROM (SELECT a.video AS a, b.video AS b, {_SIM} AS s FROM v_fingerprint a JOIN v_fingerprint b ON a.video >= 100000 AND b.video < 100000
  WHERE least(a.n, b.n) > 0 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7) WHERE s >= 0.95 GROUP BY a""")
def perceptual_match(spark, sf):
    f = X.fingerprint(spark, sf)
    index = f.filter("kind = 0").withColumn("insert_seq", F.col("video"))
    return similar.best(f.filter("kind > 0"), index).withColumn("similarity", F.round("similarity", 9))


_TURNED = " || ".join(f"substr(lpad(lower(to_hex(h)), 16, '0'), {i}, 2)" for i in range(15, 0, -2))
#: 2.0 as four little-endian bytes.
_TWO = "00000040"


@query(f"""SELECT video, 8 + 8 * n AS n_bytes, 2.0::DOUBLE AS interval_seconds, true AS same, '{_TWO}' || substr(lpad(lower(to_hex(n)), 16, '0'), 15, 2) || '000000' || coalesce(list_aggregate(list_transform(hashes, lambda h: {_TURNED}), 'string_agg', ''), '') AS blob,
  coalesce(list_aggregate(list_transform(hashes, lambda h: lower(lpad(to_hex(h), 16, '0'))), 'string_agg', ','), '') AS hashes FROM v_fingerprint""")
def fingerprint_roundtrip(spark, sf):
    f = X.fingerprint(spark, sf).withColumn("raw", hashing.to_blob(F.lit(2.0), F.col("hashes")))
    f = f.withColumns({"back": hashing.blob_hashes(F.col("raw")), "interval_seconds": hashing.blob_interval(F.col("raw")).cast("double")})
    return f.select("video", F.length("raw").cast("long").alias("n_bytes"), "interval_seconds", (F.col("back") == F.col("hashes")).alias("same"), F.lower(F.hex("raw")).alias("blob"), F.array_join(F.transform("back", hashing.hex64), ",").alias("hashes"))


def _dims() -> tuple[Column, Column, Column]:
    """Width, height and bit rate of a video of the frame-hash tables."""
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("video") % 6).cast("int") + 1)
    return pick(X.WIDTHS), pick(X.HEIGHTS), F.when(F.col("video") % 7 != 0, (500 + F.col("video") % 4000).cast("int"))


_DIMS = f"SELECT video, {X._case(X.WIDTHS, 'video % 6')} AS w, {X._case(X.HEIGHTS, 'video % 6')} AS h, CASE WHEN video % 7 <> 0 THEN (500 + video % 4000)::INTEGER END AS kbps FROM v_fingerprint"
#: The fold itself, video by video in order, with the list of entries that are open.
_GREEDY = f"""SELECT * FROM (WITH RECURSIVE v AS (SELECT video, w::BIGINT * h AS pixels, kbps, row_number() OVER (ORDER BY video) AS i FROM ({_DIMS})),
met AS (SELECT b.video, list(struct_pack(u := a.video, pixels := x.pixels, kbps := x.kbps) ORDER BY {_SIM} DESC, a.video) AS earlier FROM v_fingerprint a JOIN v_fingerprint b ON a.video < b.video JOIN v x ON x.video = a.video
  WHERE least(a.n, b.n) > 0 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7 AND {_SIM} >= 0.95 GROUP BY b.video),
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS entries, NULL::BIGINT AS video, NULL::VARCHAR AS outcome, NULL::BIGINT AS best
  UNION ALL SELECT i, CASE WHEN b IS NULL THEN list_append(entries, video) WHEN better THEN list_append(list_filter(entries, lambda e: e <> b.u), video) ELSE entries END, video, CASE WHEN b IS NULL THEN 'transcoded' WHEN better THEN 'replaced' ELSE 'deduped' END, b.u
  FROM (SELECT *, CASE WHEN pixels <> b.pixels THEN pixels > b.pixels ELSE coalesce(kbps > b.kbps, false) END AS better
    FROM (SELECT v.i, v.video, v.pixels, v.kbps, s.entries, list_filter(coalesce(m.earlier, []), lambda e: list_contains(s.entries, e.u))[1] AS b FROM step s JOIN v ON v.i = s.i + 1 LEFT JOIN met m ON m.video = v.video))),
decided AS (SELECT video, outcome, CASE WHEN outcome = 'deduped' THEN best ELSE video END AS target, CASE WHEN outcome = 'replaced' THEN best END AS old FROM step WHERE i > 0),
walk AS (SELECT video, target AS final FROM decided UNION ALL SELECT w.video, d.video FROM walk w JOIN decided d ON d.old = w.final)
SELECT video, outcome, target, (SELECT max(final) FROM walk w WHERE w.video = d.video) AS final FROM decided d)"""


@query(_GREEDY)
def greedy_resolve(spark, sf):
    f = similar.sequences(X.fingerprint(spark, sf))
    v = f.select("video", "sequence", *[c.alias(n) for c, n in zip(_dims(), ("width", "height", "kbps"), strict=True)])
    return resolve.greedy_by_sequence(v, similar.sequence_pairs(f, f), similar.THRESHOLD)


# media
@query("""SELECT a.doc_id, CASE WHEN a.width::BIGINT * a.height <> b.width::BIGINT * b.height THEN a.width::BIGINT * a.height > b.width::BIGINT * b.height ELSE coalesce(a.bitrate_kbps > b.bitrate_kbps, false) END AS higher
FROM v_probe a JOIN v_probe b ON b.doc_id = a.doc_id + 6""")
def quality_compare(spark, sf):
    a = X.probes(spark, sf)
    b = a.select((F.col("doc_id") - 6).alias("doc_id"), F.col("width").alias("w2"), F.col("height").alias("h2"), F.col("bitrate_kbps").alias("b2"))
    return a.join(b, "doc_id").select("doc_id", media.higher_quality(F.col("width"), F.col("height"), F.col("bitrate_kbps"), F.col("w2"), F.col("h2"), F.col("b2")).alias("higher"))


_FIT = "(SELECT doc_id, has_audio, ord, name, w, h, video_kbps, audio_kbps FROM v_probe p JOIN v_ladder l ON l.w <= p.width AND l.h <= p.height UNION ALL SELECT doc_id, has_audio, ord, name, w, h, video_kbps, audio_kbps FROM v_probe p, v_ladder l WHERE l.ord = 0 AND NOT (l.w <= p.width AND l.h <= p.height) AND NOT EXISTS (SELECT 1 FROM v_ladder k WHERE k.w <= p.width AND k.h <= p.height))"


@query(f"SELECT doc_id, string_agg(name, ',' ORDER BY ord) AS rungs FROM {_FIT} GROUP BY doc_id")
def effective_ladder(spark, sf):
    return X.probes(spark, sf).select("doc_id", F.array_join(F.transform(media.effective_ladder(F.col("width"), F.col("height")), lambda r: r["name"]), ",").alias("rungs"))


@query(f"""SELECT doc_id, '-y -i in.mp4 -filter_complex [0:v]split=' || count(*) || string_agg('[v' || i || ']', '' ORDER BY i) || ';' ||
  string_agg('[v' || i || ']scale=w=' || w || ':h=' || h || ':force_original_aspect_ratio=decrease,pad=' || w || ':' || h || ':(ow-iw)/2:(oh-ih)/2[s' || i || ']', ';' ORDER BY i) || ' ' ||
  string_agg('-map [s' || i || '] -c:v:' || i || ' libx264 -b:v:' || i || ' ' || video_kbps || 'k -maxrate:v:' || i || ' ' || floor(video_kbps * 1.07::DOUBLE + 0.5)::INTEGER || 'k -bufsize:v:' || i || ' ' || 2 * video_kbps || 'k -profile:v:' || i || ' main -preset:v:' || i || ' fast -g:v:' || i || ' 48 -keyint_min:v:' || i || ' 48 -sc_threshold:v:' || i || ' 0', ' ' ORDER BY i) ||
  CASE WHEN any_value(has_audio) THEN ' ' || string_agg('-map 0:a:0 -c:a:' || i || ' aac -b:a:' || i || ' ' || audio_kbps || 'k -ac:a:' || i || ' 2', ' ' ORDER BY i) ELSE '' END ||
  ' -f hls -hls_time 6 -hls_playlist_type vod -hls_segment_type fmp4 -hls_flags independent_segments -hls_segment_filename out/%v/seg_%05d.m4s -master_pl_name master.m3u8 -var_stream_map ' ||
  string_agg('v:' || i || CASE WHEN has_audio THEN ',a:' || i ELSE '' END || ',name:' || name, ' ' ORDER BY i) || ' out/%v/index.m3u8' AS args
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM {_FIT}) GROUP BY doc_id""")
def hls_args(spark, sf):
    p = X.probes(spark, sf)
    args = media.encoder_args(F.lit("in.mp4"), F.lit("out"), media.effective_ladder(F.col("width"), F.col("height")), F.col("has_audio"))
    return p.select("doc_id", F.array_join(args, " ").alias("args"))


@query("SELECT doc_id, width, height, doc_id + 0.5::DOUBLE AS duration_seconds, round((bitrate_kbps::BIGINT * 1000 + doc_id % 1000) / 1000.0::DOUBLE)::INTEGER AS bitrate_kbps, 'h264' AS video_codec, CASE WHEN has_audio THEN 'aac' END AS audio_codec, has_audio FROM v_probe")
def probe_parse(spark, sf):
    return X.probe_json(spark, sf).select("doc_id", media.probe(F.col("probe")).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, CASE WHEN doc_id % 9 NOT IN (7, 8) THEN h END AS hash, CASE WHEN doc_id % 9 NOT IN (7, 8) THEN CASE WHEN q <= 100 THEN q ELSE 0 END END::INTEGER AS quality FROM v_pdq")
def pdq_parse(spark, sf):
    p = X.pdq_stdout(spark, sf).select("doc_id", media.pdq(F.col("stdout")).alias("p"))
    return p.select("doc_id", "p.hash", "p.quality")


@query(f"SELECT doc_id, width, height, duration_seconds::DOUBLE AS duration_seconds, bitrate_kbps, count(*) AS n_rungs, string_agg(name || ':' || video_kbps, ',' ORDER BY ord) AS rungs, '{X.VERSION}' AS encoder_version FROM v_probe JOIN {_FIT} USING (doc_id) GROUP BY ALL")
def metadata_flatten(spark, sf):
    md = X.probes(spark, sf).select("doc_id", F.struct("width", "height", "duration_seconds", "bitrate_kbps").alias("source"), media.effective_ladder(F.col("width"), F.col("height")).alias("ladder"), F.lit(X.VERSION).alias("encoder_version"))
    rungs = F.array_join(F.transform("ladder", lambda r: F.concat(r["name"], F.lit(":"), r["video_bitrate_kbps"].cast("string"))), ",")
    return md.select("doc_id", "source.width", "source.height", F.col("source.duration_seconds").cast("double").alias("duration_seconds"), "source.bitrate_kbps", F.size("ladder").cast("long").alias("n_rungs"), rungs.alias("rungs"), "encoder_version")


# configuration
def _endpoint_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%://%' THEN regexp_replace(regexp_replace(regexp_extract(lower({c}), '^[a-z]+://[^/?#]*'), '^(https://.*):443$', '\\1'), '^(http://.*):80$', '\\1') ELSE lower({c}) END"


_SIDE = "(SELECT DISTINCT {} AS site, bucket, prefix FROM v_bucket WHERE side = '{}')"
_SIDES = [_SIDE.format(_endpoint_sql("endpoint"), side) for side in ("source", "dest")]


@query(f"SELECT bucket, a.site AS endpoint, a.prefix AS source_prefix, count(*) AS n_dest, min(b.prefix) AS first_dest FROM {_SIDES[0]} a JOIN {_SIDES[1]} b USING (site, bucket) WHERE starts_with(a.prefix, b.prefix) OR starts_with(b.prefix, a.prefix) GROUP BY ALL")
def bucket_overlap(spark, sf):
    """Source prefixes that overlap with a destination of the same endpoint and bucket: each beginning of the longer one is looked up, so no two prefixes are compared that do not overlap."""
    b = X.buckets(spark, sf).withColumn("endpoint", keys.endpoint(F.col("endpoint")))
    own = lambda side: b.filter(F.col("side") == side).select("endpoint", "bucket", "prefix").distinct()
    s, d = own("source"), own("dest")
    begun = lambda df: df.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring("prefix", F.lit(1), n))))
    below = begun(s).join(d.select("endpoint", "bucket", F.col("prefix").alias("dest"), F.col("prefix").alias("begin")), ["endpoint", "bucket", "begin"])
    above = begun(d).withColumnRenamed("prefix", "dest").join(s.withColumn("begin", F.col("prefix")), ["endpoint", "bucket", "begin"])
    met = below.select("endpoint", "bucket", "prefix", "dest").union(above.select("endpoint", "bucket", "prefix", "dest")).distinct()
    return met.groupBy("bucket", "endpoint", F.col("prefix").alias("source_prefix")).agg(F.count(F.lit(1)).alias("n_dest"), F.min("dest").alias("first_dest"))


@query("SELECT c_custkey, coalesce(nullif(key_bucket, ''), nullif(key_pair, ''), nullif(key_env, '')) AS access_key, coalesce(nullif(region_bucket, ''), nullif(region_pair, ''), nullif(region_env, ''), 'auto') AS region FROM v_credential")
def credential_cascade(spark, sf):
    c = X.credentials(spark, sf)
    return c.select("c_custkey", keys.first_filled(F.col("key_bucket"), F.col("key_pair"), F.col("key_env")).alias("access_key"), keys.first_filled(F.col("region_bucket"), F.col("region_pair"), F.col("region_env"), F.lit("auto")).alias("region"))


_NOW = "2024-01-08 00:00:00"


@query(f"SELECT source_key, coalesce(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(try_strptime(started, '%Y-%m-%dT%H:%M:%SZ')) < 86400.0 * 1e6 * 1.5, false) AS is_live FROM (SELECT source_key, CASE WHEN doc_id % 10 = 3 THEN 'garbled' ELSE last_modified END AS started FROM v_source)")
def lock_staleness(spark, sf):
    s = _iso(X.source(spark, sf)).select("source_key", F.when(F.col("doc_id") % 10 == 3, "garbled").otherwise(F.col("last_modified")).alias("started"))
    age = F.unix_micros(F.lit(_NOW).cast("timestamp")) - F.unix_micros(F.try_to_timestamp("started", F.lit(ISO)))
    return s.select("source_key", F.coalesce(age < F.lit(86400.0 * 1e6 * 1.5), F.lit(False)).alias("is_live"))


@query("SELECT event_id, ceil(value * 1.5::DOUBLE)::BIGINT AS lock_ttl, floor(value * 0.75::DOUBLE)::BIGINT AS budget FROM events")
def time_budgets(spark, sf):
    """Lifetime of a lock and budget of a run, of the values of events as runtimes."""
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.ceil(F.col("value") * 1.5).alias("lock_ttl"), F.floor(F.col("value") * 0.75).alias("budget"))


# cleanup
@query("SELECT source_key, content_id FROM v_mapping WHERE source_key NOT IN (SELECT source_key FROM v_live)")
def orphan_mappings(spark, sf):
    return cleanup.orphans(X.mapping(spark, sf), X.live(spark, sf)).select("source_key", "content_id")


@query("SELECT source_key, pdq_hash FROM v_image_mapping WHERE source_key NOT IN (SELECT source_key FROM v_live)")
def image_orphans(spark, sf):
    return cleanup.orphans(X.image_mapping(spark, sf), X.live(spark, sf)).select("source_key", "pdq_hash")


_COUNTS = "(SELECT content_id, count(*) FILTER (WHERE l.source_key IS NULL) AS n_orphans, count(l.source_key) AS n_live, CASE WHEN count(l.source_key) = 0 THEN 'collect' ELSE 'retain' END AS action FROM v_mapping m LEFT JOIN v_live l USING (source_key) GROUP BY 1 HAVING count(*) FILTER (WHERE l.source_key IS NULL) > 0)"


@query(f"SELECT * FROM {_COUNTS}")
def orphan_refcounts(spark, sf):
    return cleanup.refcounts(X.mapping(spark, sf), X.live(spark, sf))


_PLAN = f"(SELECT content_id, 'by-id/' || content_id || '/' || rel_path AS object_key, (row_number() OVER (PARTITION BY content_id ORDER BY rel_path) - 1) // 1000 AS batch FROM v_output JOIN {_COUNTS} USING (content_id) WHERE action = 'collect')"


@query(f"SELECT * FROM {_PLAN}")
def gc_object_plan(spark, sf):
    return cleanup.gc_plan(cleanup.refcounts(X.mapping(spark, sf), X.live(spark, sf)), X.output(spark, sf))


@query(f"SELECT (SELECT coalesce(sum(n_orphans), 0)::BIGINT FROM {_COUNTS}) AS orphan_mappings, (SELECT count(*) FROM {_COUNTS} WHERE action = 'collect') AS collected, (SELECT count(*) FROM {_COUNTS} WHERE action = 'retain') AS retained, (SELECT count(*) FROM {_PLAN}) AS objects")
def cleanup_summary(spark, sf):
    counts = cleanup.refcounts(X.mapping(spark, sf), X.live(spark, sf))
    return cleanup.summary(counts, cleanup.gc_plan(counts, X.output(spark, sf)))


@query("SELECT count(*) AS orphan_mappings FROM v_image_mapping WHERE source_key NOT IN (SELECT source_key FROM v_live)")
def image_cleanup_summary(spark, sf):
    return cleanup.orphans(X.image_mapping(spark, sf), X.live(spark, sf)).agg(F.count(F.lit(1)).alias("orphan_mappings"))


@query("SELECT source_key, content_id FROM v_mapping WHERE source_key IN (SELECT source_key FROM v_live)")
def cleanup_apply(spark, sf):
    m, live = X.mapping(spark, sf), X.live(spark, sf)
    return state.remove(m, cleanup.orphans(m, live), "source_key").select("source_key", "content_id")


@query("SELECT source_key, pdq_hash FROM v_image_mapping WHERE source_key IN (SELECT source_key FROM v_live)")
def image_cleanup_apply(spark, sf):
    m, live = X.image_mapping(spark, sf), X.live(spark, sf)
    return state.remove(m, cleanup.orphans(m, live), "source_key").select("source_key", "pdq_hash")


# keyed state
@query(f"SELECT content_id, source_key FROM v_mapping WHERE content_id IN (SELECT content_id FROM {_COUNTS} WHERE action = 'retain')")
def mappings_for_content(spark, sf):
    """Every mapping, live or not, of the contents that an orphan points to and that stay."""
    kept = cleanup.refcounts(X.mapping(spark, sf), X.live(spark, sf)).filter("action = 'retain'")
    return X.mapping(spark, sf).join(kept, "content_id", "left_semi").select("content_id", "source_key")


_MAP = "source_key, source_etag, source_size, source_last_modified, content_id, hls_root, encoded_at, encoder_version"


@query(f"SELECT {_MAP} FROM v_mapping WHERE source_key NOT IN (SELECT source_key FROM v_source WHERE {X.IS_VIDEO}) UNION ALL SELECT {_MAP} FROM ({_BUILT}) b WHERE {X.IS_VIDEO}")
def mapping_upsert(spark, sf):
    cols = _MAP.split(", ")
    new = mapping_build(spark, sf).filter(keys.is_video(F.col("source_key"))).select(cols)
    return state.upsert(X.mapping(spark, sf).select(cols), new, "source_key")


@query(f"""SELECT source_key, source_etag, source_size, source_last_modified, pdq_hash, quality, hashed_at FROM v_image_mapping WHERE source_key NOT IN (SELECT source_key FROM v_live)
UNION ALL SELECT source_key, replace(etag, '"', ''), size, last_modified, sha256(content), (doc_id % 101)::INTEGER, '{X.RUN_AT}' FROM v_source JOIN v_live USING (source_key) WHERE {X.IS_IMAGE}""")
def image_mapping_upsert(spark, sf):
    s = _iso(_sources(spark, sf, keys.is_image)).join(X.live(spark, sf), "source_key", "left_semi")
    new = s.select("source_key", F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), F.col("last_modified").alias("source_last_modified"), F.sha2("content", 256).alias("pdq_hash"), (F.col("doc_id") % 101).cast("int").alias("quality"), F.lit(X.RUN_AT).alias("hashed_at"))
    return state.upsert(X.image_mapping(spark, sf).drop("hasher_version"), new, "source_key")


@query(f"""SELECT source_key, source_etag, source_size, source_last_modified, error, failed_at, attempts FROM v_tombstone WHERE source_key NOT IN (SELECT source_key FROM v_mapped)
UNION ALL SELECT m.source_key, m.etag, m.size, m.last_modified, 'decode failed again', '{X.RUN_AT}', (CASE WHEN t.source_etag = m.etag AND t.source_size = m.size THEN t.attempts + 1 ELSE 1 END)::INTEGER FROM v_mapped m LEFT JOIN v_tombstone t USING (source_key)""")
def tombstone_upsert(spark, sf):
    failures = X._mapped(X.source(spark, sf)).select("source_key", F.col("etag").alias("source_etag"), F.col("size").alias("source_size"), X.source_time(F.col("last_modified")).alias("source_last_modified"), F.lit("decode failed again").alias("error"))
    return state.failed(X.tombstone(spark, sf), failures, X.RUN_AT, X.VERSION).drop("encoder_version")


@query("SELECT source_key, attempts FROM v_tombstone WHERE source_key NOT IN (SELECT source_key FROM v_mapping)")
def tombstone_clear(spark, sf):
    return state.remove(X.tombstone(spark, sf), X.mapping(spark, sf), "source_key").select("source_key", "attempts")


@query("SELECT * FROM v_index")
def fingerprint_index_scan(spark, sf):
    return X.index(spark, sf)


@query("SELECT content_id, hash_count, insert_seq FROM v_index WHERE width < 1000 UNION ALL SELECT content_id, hash_count + 1, 1 + insert_seq + (SELECT max(insert_seq) FROM v_index) FROM v_index WHERE width >= 1000")
def index_upsert(spark, sf):
    i = X.index(spark, sf).select("content_id", "hash_count", "insert_seq", "width")
    new = i.filter("width >= 1000").withColumn("hash_count", F.col("hash_count") + 1)
    return state.upsert_last(i, new, "content_id").drop("width")


@query(f"SELECT content_id, hash_count, insert_seq FROM v_index WHERE content_id NOT IN (SELECT content_id FROM {_COUNTS} WHERE action = 'collect')")
def index_remove(spark, sf):
    dead = cleanup.refcounts(X.mapping(spark, sf), X.live(spark, sf)).filter("action = 'collect'")
    return state.remove(X.index(spark, sf), dead, "content_id").select("content_id", "hash_count", "insert_seq")


@query(f"SELECT source_key, source_etag, CASE WHEN i.content_id IS NOT NULL THEN 'psig:' || md5(m.content_id) ELSE m.content_id END AS content_id, CASE WHEN i.content_id IS NOT NULL THEN 'by-id/psig:' || md5(m.content_id) || '/master.m3u8' ELSE hls_root END AS hls_root, encoded_at, CASE WHEN i.content_id IS NOT NULL THEN '2.0.0' ELSE encoder_version END AS encoder_version FROM v_mapping m LEFT JOIN (SELECT content_id FROM v_index WHERE width >= 1000) i ON i.content_id = m.content_id")
def repoint(spark, sf):
    moves = X.index(spark, sf).filter("width >= 1000").select(F.col("content_id").alias("old"), keys.content_id("psig", F.md5("content_id")).alias("new"))
    out = state.repointed(X.mapping(spark, sf), moves, "2.0.0", keys.master_key(F.col("content_id")))
    return out.select("source_key", "source_etag", "content_id", "hls_root", "encoded_at", "encoder_version")


@query("SELECT source_key, hls_root AS master FROM v_mapping WHERE source_key IN (SELECT source_key FROM v_live)")
def client_resolve(spark, sf):
    return X.mapping(spark, sf).join(X.live(spark, sf), "source_key", "left_semi").select("source_key", F.col("hls_root").alias("master"))


# runs
@query(f"SELECT source_key FROM v_source WHERE {X.IS_VIDEO} ORDER BY source_key LIMIT 100")
def budget_prefix(spark, sf):
    return gates.within_budget(_sources(spark, sf).select("source_key"), 100)


_OUTCOME = f"""(SELECT source_key, CASE WHEN cached THEN 'cached' WHEN blocked THEN 'errored' WHEN done OR source_key <> min(CASE WHEN NOT cached AND NOT blocked THEN source_key END) OVER (PARTITION BY cid) THEN 'deduped' ELSE 'processed' END AS outcome
FROM (SELECT s.source_key, 'sha256:' || sha256(content) AS cid, m.source_key IS NOT NULL AS cached, coalesce(t.attempts >= 3, false) AS blocked, 'sha256:' || sha256(content) IN (SELECT content_id FROM v_output) AS done
  FROM v_source s LEFT JOIN v_mapping m ON s.source_key = m.source_key AND replace(s.etag, '"', '') = m.source_etag AND s.size = m.source_size
  LEFT JOIN v_tombstone t ON s.source_key = t.source_key AND replace(s.etag, '"', '') = t.source_etag AND s.size = t.source_size WHERE {_EXT('s.source_key')} IN {keys.VIDEO}))"""


@query(f"SELECT * FROM {_OUTCOME}")
def run_outcomes(spark, sf):
    return gates.outcomes(_sources(spark, sf), X.mapping(spark, sf), X.tombstone(spark, sf), X.output(spark, sf), X.digest(F.col("content")))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{k}') AS {k}" for k in gates.OUTCOMES) + f", count(*) AS total FROM {_OUTCOME}")
def run_summary(spark, sf):
    return gates.summary(run_outcomes(spark, sf))


@query("SELECT split_part(source_key, '/', 1) AS pair, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{k}') AS {k}" for k in gates.OUTCOMES) + f", count(*) AS total, count(DISTINCT split_part(source_key, '/', 1)) AS pairs_processed FROM {_OUTCOME} GROUP BY ROLLUP (split_part(source_key, '/', 1))")
def pairs_summary(spark, sf):
    """Counters of each bucket pair (here: the first part of the key) and, without a pair, their sum."""
    return gates.pair_summary(run_outcomes(spark, sf).withColumn("pair", F.substring_index("source_key", "/", 1)))


_MOVED = "(SELECT content_id AS old, 'psig:' || md5(content_id) AS new FROM v_index WHERE width >= 1000)"
_AFTER = f"""SELECT {{}} AS seen, 'mapping' AS kind, source_key AS key, coalesce(new, content_id) AS content_id, CASE WHEN new IS NULL THEN hls_root ELSE 'by-id/' || new || '/master.m3u8' END AS root FROM v_mapping LEFT JOIN {{}} ON content_id = old
UNION ALL SELECT {{}}, 'output', coalesce(new, content_id) || '/' || rel_path, coalesce(new, content_id), NULL FROM v_output LEFT JOIN {{}} ON content_id = old
UNION ALL SELECT {{}}, 'index', coalesce(new, content_id), coalesce(new, content_id), NULL FROM v_index LEFT JOIN {{}} ON content_id = old"""
_NONE = "(SELECT '' AS old, '' AS new WHERE false)"


@query(" UNION ALL ".join(_AFTER.format(*[f"'{at}'", moved] * 3) for at, moved in (("stopped", _NONE), ("committed", _MOVED))))
def commit_recovery(spark, sf):
    """What readers of a store see after a commit of three tables that stopped before its last step, and after it is run again."""
    store = state.TableStore(spark, f"{scratch_dir(spark)}/mediacat-{uuid.uuid4().hex}")
    indexed = X.index(spark, sf).withColumns({"interval_seconds": F.lit(2.0), "encoded_at": F.lit(X.ENCODED_AT)})
    schemas = {"mappings": pipeline.MAPPING, "outputs": pipeline.OUTPUT, "index": pipeline.INDEX}
    start = {"mappings": X.mapping(spark, sf), "outputs": X.output(spark, sf), "index": indexed}
    state.apply(store, [(n, schemas[n], "source_key" if n == "mappings" else "content_id", start[n], None) for n in start])
    moves = stored(X.index(spark, sf).filter("width >= 1000").select(F.col("content_id").alias("old"), keys.content_id("psig", F.md5("content_id")).alias("new")))
    gone, named = moves.select(F.col("old").alias("content_id")), moves.withColumnRenamed("old", "content_id")

    def renamed(name):
        return lambda c: c.read(name, schemas[name]).join(named, "content_id").withColumn("content_id", F.col("new")).drop("new")

    changes = [("outputs", schemas["outputs"], "content_id", renamed("outputs"), gone), ("index", schemas["index"], "content_id", renamed("index"), gone), ("mappings", schemas["mappings"], "source_key", lambda c: state.moved(c.read("mappings", schemas["mappings"]), moves, "2.0.0", keys.master_key(F.col("content_id"))), None)]

    def seen(at):
        row = lambda name, kind, key, root: store.read(name, schemas[name]).select(F.lit(at).alias("seen"), F.lit(kind).alias("kind"), key.alias("key"), "content_id", root.alias("root"))
        none, cid = F.lit(None).cast("string"), F.col("content_id")
        return row("mappings", "mapping", F.col("source_key"), F.col("hls_root")).unionByName(row("outputs", "output", F.concat_ws("/", cid, "rel_path"), none)).unionByName(row("index", "index", cid, none))

    stopped = store.begin()
    for name, schema, key, rows, out in changes:
        stopped.change(name, schema, key, rows(stopped), out)
    before = stored(seen("stopped"))
    state.apply(store, changes)
    return before.unionByName(seen("committed"))


@query(f"SELECT source_key, {_ETAG}, size, last_modified, NULL::VARCHAR AS error FROM v_source WHERE {X.IS_VIDEO} AND NOT (source_key LIKE '%/' AND size = 0)")
def paged_scan(spark, sf):
    """`source_scan` over a listing that is read page by page, a task for each range of keys."""
    pages = paged.written(X.source(spark, sf).select("source_key", "etag", "size", "last_modified"), f"{scratch_dir(spark)}/mediacat-{uuid.uuid4().hex}")
    found = paged.listed(spark, paged.Files(pages))
    return _iso(listing.scan(found)).select("source_key", "etag", "size", "last_modified", "error")


def _json_sql(fields: dict[str, str]) -> str:
    """SQL of a document with these fields, given by name as JSON text."""
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(f"'  \"{name}\": ' || {value}" for name, value in fields.items()) + " || chr(10) || '}'"


_MAPPING_JSON = _json_sql({n: f"to_json({c})" for n, c in (("sourceKey", "source_key"), ("sourceEtag", "source_etag"), ("sourceSize", "source_size"), ("sourceLastModified", "source_last_modified"), ("contentId", "content_id"), ("hlsRoot", "hls_root"), ("encodedAt", "encoded_at"), ("encoderVersion", "encoder_version"))})


def _mapping_documents(spark, sf):
    return X.mapping(spark, sf).select("source_key", keys.mapping_key(F.col("source_key")).alias("key"), documents.body(documents.MAPPING).alias("body"))


@query(f"SELECT 'mappings/' || source_key || '.json' AS key, {_MAPPING_JSON} AS body, source_etag, source_size, source_last_modified, content_id, hls_root, NULL::VARCHAR AS error FROM v_mapping")
def document_roundtrip(spark, sf):
    """Mappings as documents, and what is read back from these."""
    docs = _mapping_documents(spark, sf).select("key", "body")
    back = documents.decoded(docs.withColumn("key", F.struct("key", "body")), documents.MAPPING)
    return back.select("key.key", "key.body", "source_etag", "source_size", "source_last_modified", "content_id", "hls_root", "error")


@query("""SELECT source_key AS object, CASE WHEN d IN ('0', '1', '3', '4') THEN NULL ELSE source_key END AS source_key, CASE WHEN d IN ('0', '1', '3', '4') THEN NULL ELSE source_size END AS source_size,
  CASE WHEN d IN ('0', '1', '2', '3', '4') THEN NULL ELSE content_id END AS content_id,
  CASE d WHEN '0' THEN 'document: broken JSON' WHEN '1' THEN 'sourceSize: not a whole number (long)' WHEN '3' THEN 'document: not an object' END AS error
FROM (SELECT *, substr(md5(source_key), 5, 1) AS d FROM v_mapping)""")
def document_import(spark, sf):
    """Documents of mappings, some of which are cut off, of other types, without a field, or absent, by a digit of their key's md5."""
    b = F.col("body")
    digit = F.substring(F.md5("source_key"), 5, 1)
    size = F.regexp_replace(b, r'"sourceSize": (\d+)', r'"sourceSize": "$1"')
    spoilt = F.when(digit == "0", F.substr(b, F.lit(1), F.length(b) - 1)).when(digit == "1", size).when(digit == "2", F.regexp_replace(b, '"contentId": "[^"]*"', '"more": {"x": [1]}')).when(digit == "3", F.lit("[1]")).when(digit == "4", F.lit(None)).otherwise(b)
    found = documents.decoded(_mapping_documents(spark, sf).select("key", spoilt.alias("body")), documents.MAPPING)
    return found.select(keys.source_key_of(F.col("key")).alias("object"), "source_key", "source_size", "content_id", "error")


#: Entries of an index document that the query makes.
_PER_INDEX = 100


@query(f"""SELECT format('fingerprints/index-{{:05d}}.json', doc) AS key, content_id, hash_count, video_bitrate_kbps, doc * 4294967296 + place AS insert_seq, NULL::VARCHAR AS error
  FROM (SELECT *, insert_seq // {_PER_INDEX} AS doc, row_number() OVER (PARTITION BY insert_seq // {_PER_INDEX} ORDER BY insert_seq, content_id) - 1 AS place FROM v_index) WHERE doc % 5 <> 3 AND doc % 7 <> 5
UNION ALL SELECT DISTINCT format('fingerprints/index-{{:05d}}.json', insert_seq // {_PER_INDEX}), NULL, NULL, NULL, NULL, CASE WHEN insert_seq // {_PER_INDEX} % 7 = 5 THEN 'document: broken JSON' ELSE 'unsupported fingerprint index version: 2' END
  FROM v_index WHERE insert_seq // {_PER_INDEX} % 5 = 3 OR insert_seq // {_PER_INDEX} % 7 = 5""")
def index_version(spark, sf):
    """Index documents of few entries each; every fifth has another version, every seventh is cut off, and gives one error row."""
    i = X.index(spark, sf).withColumns({"interval_seconds": F.lit(2.0), "encoded_at": F.lit(X.ENCODED_AT), "doc": F.floor(F.col("insert_seq") / _PER_INDEX)})
    entry = F.struct("insert_seq", *[f.column for f in documents.ENTRY])
    docs = i.groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("entries")).withColumn("version", F.when(F.col("doc") % 5 == 3, 2).otherwise(1))
    text = documents.body(documents.INDEX)
    text = F.when(F.col("doc") % 7 == 5, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    found = documents.index_entries(docs.select(F.format_string("fingerprints/index-%05d.json", "doc").alias("key"), text.alias("body")))
    return found.select("key", "content_id", "hash_count", "video_bitrate_kbps", "insert_seq", "error")


@query(f"""SELECT p.video, coalesce(m.b, p.video) AS target, CASE WHEN m.b IS NULL THEN 'processed' WHEN CASE WHEN x.w::BIGINT * x.h <> y.w::BIGINT * y.h THEN x.w::BIGINT * x.h > y.w::BIGINT * y.h ELSE coalesce(x.kbps > y.kbps, false) END THEN 'replaced' ELSE 'deduped' END AS outcome
FROM (SELECT video FROM v_fingerprint WHERE video >= 100000) p LEFT JOIN (SELECT a, arg_max(b, s * 1000000 - b / 10000000.0) AS b FROM (SELECT a.video AS a, b.video AS b, {_SIM} AS s FROM v_fingerprint a JOIN v_fingerprint b ON a.video >= 100000 AND b.video < 100000
  WHERE least(a.n, b.n) > 0 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7) WHERE s >= 0.95 GROUP BY a) m ON m.a = p.video
LEFT JOIN ({_DIMS}) x ON x.video = p.video LEFT JOIN ({_DIMS}) y ON y.video = m.b""")
def perceptual_outcomes(spark, sf):
    """Each copy against the originals as index: onto which entry it goes, or which it replaces."""
    f = X.fingerprint(spark, sf)
    index = f.filter("kind = 0").withColumn("insert_seq", F.col("video"))
    met = similar.best(f.filter("kind > 0"), index).select(F.col("a").alias("video"), "b")
    dims = lambda k, v: f.select(F.col("video").alias(v), *[c.alias(n + k) for c, n in zip(_dims(), ("w", "h", "r"), strict=True)])
    both = f.filter("kind > 0").select("video").join(met, "video", "left").join(dims("x", "video"), "video").join(dims("y", "b"), "b", "left")
    higher = media.higher_quality(F.col("wx"), F.col("hx"), F.col("rx"), F.col("wy"), F.col("hy"), F.col("ry"))
    return both.select("video", F.coalesce("b", "video").alias("target"), F.when(F.col("b").isNull(), "processed").when(higher, "replaced").otherwise("deduped").alias("outcome"))


_MOVES = "(SELECT content_id AS old, 'psig:' || md5(content_id) AS new FROM v_index WHERE width >= 1000)"


@query(f"""SELECT 'mapping' AS kind, source_key AS key, coalesce(new, content_id) AS content_id FROM v_mapping LEFT JOIN {_MOVES} ON content_id = old
UNION ALL SELECT 'index', content_id, content_id FROM v_index WHERE content_id NOT IN (SELECT old FROM {_MOVES})
UNION ALL SELECT 'output', 'by-id/' || content_id || '/' || rel_path, content_id FROM v_output WHERE content_id NOT IN (SELECT old FROM {_MOVES})
UNION ALL SELECT 'deleted', 'by-id/' || content_id || '/' || rel_path, content_id FROM v_output WHERE content_id IN (SELECT old FROM {_MOVES})""")
def repoint_gc(spark, sf):
    """What there is after replaced contents' mappings have moved and their outputs and index entries have gone."""
    moves = X.index(spark, sf).filter("width >= 1000").select(F.col("content_id").alias("old"), keys.content_id("psig", F.md5("content_id")).alias("new"))
    outputs = X.output(spark, sf)
    mappings = state.repointed(X.mapping(spark, sf), moves, "2.0.0", keys.master_key(F.col("content_id")))
    gone = moves.select(F.col("old").alias("content_id"))
    key = F.concat(keys.by_id_prefix(F.col("content_id")), "rel_path")
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"), "content_id")
    out = row(mappings, "mapping", F.col("source_key")).unionByName(row(state.remove(X.index(spark, sf), gone, "content_id"), "index", F.col("content_id")))
    return out.unionByName(row(state.remove(outputs, gone, "content_id"), "output", key)).unionByName(row(outputs.join(gone, "content_id", "left_semi"), "deleted", key))


_CODES = ("NoSuchKey", "NotFound", "PreconditionFailed", "SlowDown", "AccessDenied")


@query(f"""SELECT doc_id, CASE WHEN code IN ('NoSuchKey', 'NotFound') OR status = 404 THEN 'not_found' WHEN code = 'PreconditionFailed' OR status = 412 THEN 'precondition_failed' WHEN code IS NOT NULL OR status IS NOT NULL THEN 'other' END AS class
FROM (SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN {X._case(_CODES, 'doc_id % 7')} END AS code, CASE doc_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 412 WHEN 2 THEN 503 END AS status FROM documents)""")
def error_classes(spark, sf):
    d = F.col("doc_id")
    code = F.when(d % 7 < 5, F.element_at(F.array(*map(F.lit, _CODES)), (F.least(d % 7, F.lit(4)) + 1).cast("int")))
    status = F.when(d % 4 == 0, 404).when(d % 4 == 1, 412).when(d % 4 == 2, 503)
    return X.source(spark, sf).select("doc_id", errors.error_class(code, status).alias("class"))


@query("SELECT source_key, replace(last_modified, 'Z', '.000000Z') AS at FROM v_source")
def utc_iso(spark, sf):
    return X.source(spark, sf).select("source_key", keys.utc_iso(F.col("last_modified")).alias("at"))
