"""Frame hashes: difference hash, Hamming distance, similarity, bands, blobs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, HEIGHT = 9, 8


def dhash(pixels: Column) -> Column:
    """64-bit difference hash of 72 gray values in rows of nine: bit r * 8 + c is set if a pixel is over its right neighbour."""
    out = F.lit(0).cast("long")
    for i in range(64):  # one flat expression, which code generation takes; a fold over an array would be interpreted
        at = i // 8 * WIDTH + i % 8
        bit = (1 << i) - (1 << 64 if i == 63 else 0)
        out = out.bitwiseOR(F.when(F.get(pixels, F.lit(at)) > F.get(pixels, F.lit(at + 1)), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def frames(raw: Column) -> Column:
    """Raw bytes cut to frames of 72 bytes; a partial last frame is dropped."""
    n = F.floor(F.length(raw) / (WIDTH * HEIGHT)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * WIDTH * HEIGHT + 1, F.lit(WIDTH * HEIGHT)))).otherwise(F.array().cast("array<binary>"))


def hex64(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - mean Hamming distance / 64 over the shorter length, within 0 and 1; 0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), hamming), F.lit(0), lambda s, x: s + x)
    return F.when(n < 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total / n.cast("double") / 64.0)))


def band_count(threshold: float) -> int:
    """Bands such that two hashes within the threshold's distance agree on one of them."""
    return int(math.floor(64 * (1 - threshold) + 1e-9)) + 1


def bands(h: Column, count: int) -> Column:
    """array of (band, value): the 64 bits cut into `count` pieces."""
    edges = [64 * i // count for i in range(count + 1)]
    cut = lambda i: F.struct(F.lit(i).alias("band"), F.call_function("shiftrightunsigned", h, F.lit(edges[i])).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("value"))
    return F.array(*map(cut, range(count)))


def _turned(hexes: Column, digits: int) -> Column:
    """Hex digits of a number with its bytes in the other order."""
    return F.concat(*[F.substring(hexes, i + 1, 2) for i in range(digits - 2, -1, -2)])


def _float_bits(x: Column) -> Column:
    """The 32 bits of a positive single-precision number as a long; 0 for 0."""
    x = x.cast("float").cast("double")
    near = F.floor(F.log2(x))
    exponent = F.when(x >= F.pow(F.lit(2.0), near + 1), near + 1).when(x < F.pow(F.lit(2.0), near), near - 1).otherwise(near)
    fraction = F.round((x / F.pow(F.lit(2.0), exponent) - 1) * (1 << 23)).cast("long")
    return F.when(x > 0, (exponent.cast("long") + 127) * (1 << 23) + fraction).otherwise(F.lit(0).cast("long"))


def to_blob(interval: Column, hashes: Column) -> Column:
    """Little-endian binary: interval (32-bit float, 0 or a normal positive number), number of hashes (32 bits), hashes (64 bits each)."""
    word = lambda x: _turned(F.lower(F.lpad(F.hex(x), 8, "0")), 8)
    body = F.array_join(F.transform(hashes, lambda h: _turned(hex64(h), 16)), "")
    return F.unhex(F.concat(word(_float_bits(interval)), word(F.size(hashes).cast("long")), body))


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def blob_hashes(raw: Column) -> Column:
    """The hashes of a blob; null without a blob, an error where header or body is cut short."""
    hexes = F.lower(F.hex(raw))
    n = _number(_turned(F.substring(hexes, 9, 8), 8))
    half = lambda i, at: _number(_turned(F.substr(hexes, i * 16 + 17 + at, F.lit(8)), 8))
    one = lambda i: F.call_function("shiftleft", half(i, 8), F.lit(32)).bitwiseOR(half(i, 0))
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: one(i.cast("int")))).otherwise(F.array().cast("array<bigint>"))
    short = (F.length(raw) < 8) | (F.length(raw) < 8 + 8 * n)
    return F.when(raw.isNull(), F.lit(None)).when(short, F.raise_error(F.lit("fingerprint blob is cut short"))).otherwise(hashes)


def blob_interval(raw: Column) -> Column:
    """The interval of a blob, a float."""
    bits = _number(_turned(F.substring(F.lower(F.hex(raw)), 1, 8), 8))
    exponent = F.floor(bits / (1 << 23)) % 256
    return F.when(bits == 0, F.lit(0.0)).otherwise((1 + (bits % (1 << 23)) / float(1 << 23)) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))).cast("float")
