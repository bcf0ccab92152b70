"""Object keys, content ids and file types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by medium, content types by suffix, content id schemes.
VIDEO = ("mp4", "mov", "mkv", "webm", "avi", "m4v", "mpg", "mpeg", "wmv", "flv", "ogv", "3gp", "ts", "m2ts")
IMAGE = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "avif", "heic", "heif")
CONTENT_TYPES = (
    (".m3u8", "application/vnd.apple.mpegurl"),
    (".m4s", "video/iso.segment"),
    (".mp4", "video/mp4"),
    (".ts", "video/mp2t"),
    (".vtt", "text/vtt"),
    (".json", "application/json"),
)
OTHER_CONTENT = "application/octet-stream"
SCHEMES = ("sha256", "psig")


def extension(key: Column) -> Column:
    """Lower-case extension of the last path part; '' where it has no dot."""
    return F.lower(F.regexp_extract(F.substring_index(key, "/", -1), r"\.([^.]*)$", 1))


def is_video(key: Column) -> Column:
    return extension(key).isin(*VIDEO)


def is_image(key: Column) -> Column:
    return extension(key).isin(*IMAGE)


def content_type(name: Column) -> Column:
    out = F
    for suffix, kind in CONTENT_TYPES:
        out = out.when(F.endswith(name, F.lit(suffix)), kind)
    return out.otherwise(OTHER_CONTENT)


def mapping_key(key: Column) -> Column:
    return F.concat(F.lit("mappings/"), key, F.lit(".json"))


def image_mapping_key(key: Column) -> Column:
    return F.concat(F.lit("image-mappings/"), key, F.lit(".json"))


def tombstone_key(key: Column) -> Column:
    return F.concat(F.lit("errors/"), key, F.lit(".json"))


def source_key_of(key: Column, prefix: str = "mappings/") -> Column:
    """Inverse of mapping_key; null for keys of another shape."""
    fits = F.startswith(key, F.lit(prefix)) & F.endswith(key, F.lit(".json")) & (F.length(key) >= len(prefix) + 5)
    return F.when(fits, F.substring(key, F.lit(len(prefix) + 1), F.length(key) - len(prefix) - 5))


def content_id(scheme: str, digest: Column) -> Column:
    return F.concat(F.lit(scheme + ":"), digest)


def scheme_of(cid: Column) -> Column:
    """The scheme of a content id; null if missing or unknown."""
    scheme = F.when(F.instr(cid, ":") > 0, F.substring_index(cid, ":", 1))
    return F.when(scheme.isin(*SCHEMES), scheme)


def id_of(cid: Column) -> Column:
    return F.when(scheme_of(cid).isNotNull(), F.substring(cid, F.instr(cid, ":") + 1, F.length(cid)))


def by_id_prefix(cid: Column) -> Column:
    return F.concat(F.lit("by-id/"), cid, F.lit("/"))


def master_key(cid: Column) -> Column:
    return F.concat(by_id_prefix(cid), F.lit("master.m3u8"))


def metadata_key(cid: Column) -> Column:
    return F.concat(by_id_prefix(cid), F.lit("metadata.json"))


def fingerprint_key(cid: Column) -> Column:
    return F.concat(F.lit("fingerprints/"), cid, F.lit(".bin"))


def lease_key(cid: Column) -> Column:
    return F.concat(by_id_prefix(cid), F.lit(".processing"))


def endpoint(url: Column) -> Column:
    """Scheme and authority in lower case without default ports; the lower-case input where it does not parse."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    return F.coalesce(F.concat(scheme, F.lit("://"), host), F.lower(url))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def utc_iso(at: Column) -> Column:
    """A timestamp as text in UTC, to the microsecond, whatever the session's time zone."""
    zone = F.current_timezone()
    return F.date_format(F.to_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
