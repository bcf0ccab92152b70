"""Probe results, ladders, quality, perceptual-hash output and encoder arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default ladder (name, width, height, video kbps, audio kbps).
LADDER = (("360p", 640, 360, 800, 96), ("480p", 854, 480, 1400, 128), ("720p", 1280, 720, 2800, 128), ("1080p", 1920, 1080, 5000, 192))
RUNG = ("name", "width", "height", "video_bitrate_kbps", "audio_bitrate_kbps")
PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int>>, format struct<duration:string,bit_rate:string>"


def ladder(rungs=LADDER) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(RUNG, r, strict=True)]) for r in rungs])


def effective_ladder(width: Column, height: Column, rungs: Column | None = None) -> Column:
    """The rungs that fit in a picture; the first one if none does."""
    rungs = ladder() if rungs is None else rungs
    fits = F.filter(rungs, lambda r: (r["width"] <= width) & (r["height"] <= height))
    return F.when(F.size(fits) > 0, fits).otherwise(F.slice(rungs, 1, 1))


def higher_quality(width: Column, height: Column, kbps: Column, other_width: Column, other_height: Column, other_kbps: Column) -> Column:
    """More pixels; at equal pixels a higher known bitrate."""
    a, b = width.cast("long") * height, other_width.cast("long") * other_height
    return F.when(a != b, a > b).otherwise(F.coalesce(kbps > other_kbps, F.lit(False)))


def probe(text: Column) -> Column:
    """struct(width, height, duration_seconds, bitrate_kbps, video_codec, audio_codec, has_audio) of a prober's JSON."""
    doc = F.from_json(text, PROBE)
    first = lambda kind: F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = first("video"), first("audio")
    return F.struct(
        video["width"].alias("width"),
        video["height"].alias("height"),
        doc["format"]["duration"].try_cast("double").alias("duration_seconds"),
        F.round(doc["format"]["bit_rate"].try_cast("double") / 1000).cast("int").alias("bitrate_kbps"),
        video["codec_name"].alias("video_codec"),
        audio["codec_name"].alias("audio_codec"),
        audio.isNotNull().alias("has_audio"),
    )


def pdq(stdout: Column) -> Column:
    """struct(hash, quality) of a hasher's output: the first line with a 64-digit hex word, and the first later integer of 0 to 100 (0 if none); null if there is no such line or the hash is all zeros."""
    is_hash = lambda w: F.rlike(w, F.lit("^[0-9a-fA-F]{64}$"))
    lines = F.transform(F.split(stdout, "\n"), lambda line: F.filter(F.split(line, "[, \t\r]+"), lambda w: w != ""))
    line = F.get(F.filter(lines, lambda ws: F.exists(ws, is_hash)), F.lit(0))
    at = F.array_position(F.transform(line, is_hash), True).cast("int")
    after = F.slice(line, at + 1, F.size(line))
    quality = F.get(F.filter(F.transform(F.filter(after, lambda w: F.rlike(w, F.lit("^[+-]?[0-9]{1,9}$"))), lambda w: w.cast("int")), lambda q: q.between(0, 100)), F.lit(0))
    value = F.lower(F.get(line, at - 1))
    return F.when(line.isNotNull() & ~F.rlike(value, F.lit("^0+$")), F.struct(value.alias("hash"), F.coalesce(quality, F.lit(0)).alias("quality")))


def encoder_args(source: Column, out_dir: Column, rungs: Column, has_audio: Column, segment: int = 6, gop: int = 48) -> Column:
    """Encoder arguments (array of strings) for an adaptive ladder."""
    lit, cat = F.lit, F.concat
    text = lambda c: c.cast("string")
    split = cat(lit("[0:v]split="), text(F.size(rungs)), F.array_join(F.transform(rungs, lambda r, i: cat(lit("[v"), text(i), lit("]"))), ""))
    scale = F.array_join(
        F.transform(rungs, lambda r, i: cat(lit("[v"), text(i), lit("]scale=w="), text(r["width"]), lit(":h="), text(r["height"]), lit(":force_original_aspect_ratio=decrease,pad="), text(r["width"]), lit(":"), text(r["height"]), lit(":(ow-iw)/2:(oh-ih)/2[s"), text(i), lit("]"))), ";")
    kbps = lambda c: cat(text(c), lit("k"))

    def video(r, i):
        flag = lambda name: cat(lit(f"-{name}:v:"), text(i))
        rate = r["video_bitrate_kbps"]
        return F.array(
            lit("-map"), cat(lit("[s"), text(i), lit("]")), cat(lit("-c:v:"), text(i)), lit("libx264"), flag("b"), kbps(rate), flag("maxrate"), kbps(F.floor(rate * 1.07 + 0.5)), flag("bufsize"), kbps(rate * 2),
            flag("profile"), lit("main"), flag("preset"), lit("fast"), flag("g"), lit(str(gop)), flag("keyint_min"), lit(str(gop)), flag("sc_threshold"), lit("0"),
        )

    audio = lambda r, i: F.array(lit("-map"), lit("0:a:0"), cat(lit("-c:a:"), text(i)), lit("aac"), cat(lit("-b:a:"), text(i)), kbps(r["audio_bitrate_kbps"]), cat(lit("-ac:a:"), text(i)), lit("2"))
    none = F.array().cast("array<string>")
    streams = F.array_join(F.transform(rungs, lambda r, i: cat(lit("v:"), text(i), F.when(has_audio, cat(lit(",a:"), text(i))).otherwise(lit("")), lit(",name:"), r["name"])), " ")
    tail = F.array(
        lit("-f"), lit("hls"), lit("-hls_time"), lit(str(segment)), lit("-hls_playlist_type"), lit("vod"), lit("-hls_segment_type"), lit("fmp4"), lit("-hls_flags"), lit("independent_segments"),
        lit("-hls_segment_filename"), cat(out_dir, lit("/%v/seg_%05d.m4s")), lit("-master_pl_name"), lit("master.m3u8"), lit("-var_stream_map"), streams, cat(out_dir, lit("/%v/index.m3u8")),
    )
    return F.concat(F.array(lit("-y"), lit("-i"), source, lit("-filter_complex"), cat(split, lit(";"), scale)), F.flatten(F.transform(rungs, video)), F.when(has_audio, F.flatten(F.transform(rungs, audio))).otherwise(none), tail)
