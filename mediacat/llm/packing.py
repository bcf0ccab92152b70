"""Packing of token sequences: Martello-Toth dominance, then best fit, on the histogram of lengths.

Lengths are at most the capacity, so the whole corpus is a histogram of at most `capacity`
counts, whatever its size. The plan is made on that histogram on the driver:

1. Dominance reduction. For the longest open length L, some set with L may dominate every
   other set with it: L alone if nothing fits beside it; L with the longest length K that
   fits if K fills the sequence exactly, if no two documents fit beside L, or if no three fit
   and K is as long as the best two together. Such sets are fixed for good, as many at once
   as the counts allow, and passes repeat until none is left.
2. Best fit decreasing over the rest, a whole class of equally filled sequences at a time.

Each length's documents are numbered (in buckets, so that a length with a third of all rows
is not one task); the plan's runs map (length, number) to a sequence and a place. There are
at most a few runs for each pair of a length and a class of sequences, so the plan's size
depends on the capacity alone.

Tokens: words of texts in a plain Latin range, cut at white space and at signs behind letters, are
made distinct in arrays, and each is encoded once per worker and kept (bounded, forgotten whole
when full); other texts are encoded whole. Both give the tokenizer's own ids.

Defined cases: null and empty texts are one end token; texts over the capacity are cut into
full pieces and a rest; repeated rows are packed each, and
ties in length go by id; very long texts are read whole; an empty table gives no rows; extra
columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import kernels as K
from mediacat.llm.common import digest_bucket, ranked, slices, stored, table, turn

CAPACITY = 2048
#: Words that a worker keeps the ids of.
CACHE = 1_500_000
#: Characters for which lower case, normal form and word classes work word by word as they do on the whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ɏ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w]|_)+")


_SIGNS = np.zeros(256, bool)
_SIGNS[[*b".,;:!?"]] = True


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, without special tokens added."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self._forget()

    def _forget(self) -> None:
        #: Number of each word that is kept (UTF-8), the ids of all of them in a row, and where each word's are.
        self.words: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str, cache: int = CACHE) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].cache = cache
        return cls._made[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch(texts[i : i + 4096], add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the tokenizer never splits or joins over a space, by one call."""
        e = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
        if len(of) == 0 or of[-1] + 1 != len(parts):
            return self._encode(parts)
        cuts = np.searchsorted(of, np.arange(len(parts) + 1)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        """Adds words to those kept; a word with other signs is its parts' ids in a row."""
        texts = [w.decode() for w in words]
        mixed = {w: _PARTS.findall(w) for w in texts if not w.isalpha()}
        have = lambda p: self.words.get(p.encode())
        known = {p: self.ids[self.at[n] : self.at[n + 1]].tobytes() for parts in mixed.values() for p in parts if (n := have(p)) is not None}
        new = list({p for parts in mixed.values() for p in parts if p not in known}.union(w for w in texts if w not in mixed))
        for i in range(0, len(new), 1024):
            known.update(zip(new[i : i + 1024], self._encode_parts(new[i : i + 1024]), strict=True))
        made = [b"".join([known[p] for p in mixed[w]]) if w in mixed else known[w] for w in texts]
        for w in words:
            self.words[w] = len(self.words)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(m) // 4 for m in made])])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: their words in lower case, each distinct one looked up once."""
        data, off = K.utf8(pc.utf8_lower(pa.array(texts, pa.large_string())))
        blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        hard = np.flatnonzero((data[1:] == 0xA0) & (data[:-1] == 0xC2))  # the space that does not break a line
        blank[hard] = blank[hard + 1] = True
        word = ~blank
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        starts, ends = word.copy(), word.copy()
        # a sign behind a letter is a part of its own
        sign = _SIGNS[data[1:]] & (data[:-1] >= 97) & (data[:-1] <= 122)
        starts[1:] &= blank[:-1] | edge[1:-1] | sign
        ends[:-1] &= blank[1:] | edge[1:-1] | sign
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        cuts = np.concatenate([[0], np.cumsum(ends - starts)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[word])]).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        get = self.words.get
        number = np.array([get(w, -1) for w in keys], np.int64)
        new = np.flatnonzero(number < 0)
        if len(self.words) + len(new) > self.cache:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            number[new] = np.arange(len(self.words), len(self.words) + len(new))
            self._learn([keys[i] for i in new.tolist()])
        number = number[coded.indices.to_numpy()]
        many = self.at[number + 1] - self.at[number]
        ends = np.cumsum(many)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[number] - ends + many, many)].tobytes()
        places = 4 * np.concatenate([[0], ends])[np.searchsorted(starts, off)]
        return [ids[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 512):
            some = texts[i : i + 512]
            plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in some]
            found = iter(self._plain([t for t, p in zip(some, plain, strict=True) if p]))
            for t, p in zip(some, plain, strict=True):
                yield next(found) if p else self._encode([t])[0]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces, and their ids if asked for."""
    schema = PIECES + ", ids array<int>" * with_ids
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        turn("packing", Encoder._made.clear)
        encoder = Encoder.of(path, cache)
        for batch in slices(batches):
            yield pieces(encoder, batch)

    def pieces(encoder, batch):
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows: list[tuple] = []
        for key, ids in zip(keys, encoder.encode(texts), strict=True):
            ids += tail
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else ())))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Plan:
    """Runs of documents of one length: (length, first number, count, first sequence, documents in each, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.n_sequences, self.n_fixed = capacity, [0] * (capacity + 1), 0, 0
        for length, n in counts.items():
            self.left[length] += n
        self.next = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        while self._reduce():
            pass
        self.n_fixed = self.n_sequences
        self._best_fit()

    def _run(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.next[length], n, sequence, each, offset))
        self.next[length] += n
        self.left[length] -= n

    def _fix(self, lengths: tuple[int, ...]) -> None:
        n = min(self.left[k] // lengths.count(k) for k in lengths)
        for i, k in enumerate(lengths):
            self._run(k, n, self.n_sequences, 1, sum(lengths[:i]))
        self.n_sequences += n

    def _dominant(self, long: int, lengths: list[int]) -> tuple[int, ...] | None:
        """The set with `long` that dominates all others, if one of the tests finds it; lengths: open ones, ascending."""
        room, left = self.capacity - long, self.left
        others = lambda k: left[k] - (k == long)
        small: list[int] = []
        for k in lengths:
            small += [k] * min(3 - len(small), others(k))
            if len(small) == 3:
                break
        if not small or small[0] > room:
            return (long,)
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and not others(lengths[at]):
            at -= 1
        best = lengths[at]
        if best == room or len(small) < 2 or sum(small[:2]) > room:
            return (long, best)
        if len(small) < 3 or sum(small) > room:
            most, i, j = 0, 0, at
            while i <= j:
                if lengths[i] + lengths[j] > room:
                    j -= 1
                else:
                    if others(lengths[i]) >= 1 + (i == j) and others(lengths[j]):
                        most = max(most, lengths[i] + lengths[j])
                    i += 1
            if best >= most:
                return (long, best)
        return None

    def _reduce(self) -> bool:
        """One pass from the longest to the shortest; whether it fixed anything."""
        fixed = False
        for long in range(self.capacity, 0, -1):
            while self.left[long]:
                lengths = [k for k in range(1, self.capacity + 1) if self.left[k]]
                found = self._dominant(long, lengths)
                if found is None:
                    break
                self._fix(found)
                fixed = True
        return fixed

    def _best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, sequence: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    insort(rooms, room)
                open_.setdefault(room, []).append((sequence, n))

        for length in range(self.capacity, 0, -1):
            while n := self.left[length]:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, bins = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    room, sequence, bins = self.capacity, self.n_sequences, -(-n // (self.capacity // length))
                    self.n_sequences += bins
                each = min(n, room // length)
                used = min(bins, n // each)
                self._run(length, used * each, sequence, each, self.capacity - room)
                put(room - each * length, sequence, used)
                put(room, sequence + used, bins - used)

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys length << 40 | first number, and the runs in that order."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        return (runs[:, 0] << 40) | runs[:, 1], runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, runs = Plan(counts, capacity).lookup()
    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "number", digest_bucket(F.col("doc_id"), digits=2))

    def place(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5))
            run = runs[np.searchsorted(keys, (length << 40) | number, "right") - 1]
            k = number - run[:, 1]
            sequence, offset = run[:, 3] + k // run[:, 4], run[:, 5] + k % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Documents cut, packed and placed; tokens are made once and their pieces stored. cache: words that a worker keeps."""
    return pack(stored(tokenized(docs, path, capacity, cache=cache)), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
