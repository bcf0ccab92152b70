"""Array kernels over Arrow string columns: bytes, code points and words without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from mediacat.llm.common import CACHES

#: Bytes of text that a kernel takes at once; a longer text is a block of its own.
BLOCK = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `size` bytes."""
    data, off = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def row_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(off, at, "right") - 1


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 9 to 13; runs end at row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Moduli of the rolling hash: modulo 2 ** 64 no base would tell some pairs of strings apart (those of Thue and Morse).
PRIMES = (2147483647, 2147483629)


@lru_cache(maxsize=4)
def _powers(n: int, seed: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of a base and of its inverse modulo a prime."""
    base = int(mix(np.array([seed * 2 + prime], np.uint64))[0]) % (prime - 1000) + 500
    out = []
    for factor in (base, pow(base, -1, prime)):
        power = np.ones(n, np.uint64)
        have = 1
        while have < n:
            more = min(have, n - have)
            power[have : have + more] = power[:more] * np.uint64(pow(factor, have, prime)) % np.uint64(prime)
            have += more
        out.append(power.astype(np.uint32))
    return out[0], out[1]


CACHES.append(_powers)


@lru_cache(maxsize=8)
def _letters(seed: int, prime: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) % np.uint64(prime)


class Rolling:
    """Hashes of any byte ranges of a buffer: polynomials modulo two primes of 31 bits, scrambled to 64 bits.

    room: for buffers of changing sizes, the least number of powers to be kept.
    """

    def __init__(self, data: np.ndarray, seed: int = 1, room: int = 1 << 12):
        n = 1 << int(max(len(data), room - 1)).bit_length()
        self.parts = []
        for prime in PRIMES:
            up, down = _powers(n, seed, prime)
            sums = np.zeros(len(data) + 1, np.uint64)
            term = _letters(seed, prime)[data]
            term *= up[: len(data)]
            term %= np.uint64(prime)
            np.cumsum(term, out=sums[1:])
            self.parts.append((sums, down, np.uint64(prime)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = ((sums[ends] - sums[starts]) % prime * down[starts] % prime for sums, down, prime in self.parts)
        return mix((a * np.uint64(1 << 32) + b) ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z as a to z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 32."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the rows' offsets among them."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), leads[off]
