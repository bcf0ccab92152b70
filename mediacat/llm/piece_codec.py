"""SentencePiece encoding and decoding with every piece projected to its bytes in the source text.

1. Normalisation. At each character the longest key of the model's compiled character map (a
   double array) that begins there is replaced; what no key covers stays. Every character of
   the result keeps the byte that it comes from, so any range of it is a range of the source.
   Where the model asks for it, extra spaces go, a space is put in front, and spaces become
   the visible space sign.
2. Cutting. Two neighbouring characters that stand side by side in no piece of the vocabulary
   are never merged over, so the text is cut there. A distinct segment is merged once a worker
   and kept (bounded, forgotten whole when full).
3. Merging. Of a segment's neighbours with a common piece the one of the best score merges
   first, the leftmost on ties; segments up to LONG characters take these steps side by side
   in arrays, longer ones by a heap. A character without a piece becomes its bytes' pieces.
4. Projection. Pieces count characters of the normal form; running sums give each piece's
   place there and the alignment its bytes in the source. Of a character's byte pieces all but
   the last are empty spans where the character begins.

Decoding joins pieces, reads runs of byte pieces as UTF-8, and drops the space put in front.

Defined cases: null and empty texts have no pieces and decode to nothing; very long texts are
read whole, as blocks of their own; rows are independent, so repeated rows and null or repeated
ids give each row its own result; there are no ties beyond the merging order; an empty table
gives no rows; extra columns are dropped. Models without byte pieces, of another kind than BPE
or with user-defined pieces are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import kernels as K
from mediacat.llm.common import released, table, turn

SPACE = 0x2581
#: Symbols from here on are characters that no piece holds.
UNKNOWN, SHIFT = 1 << 20, 22
#: Longest segment that is merged side by side with others.
LONG = 48
NONE = 1 << 30
#: Segments that a worker keeps.
CACHE = 400_000


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges flat[start : start + length] in a row."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]


class CharMap:
    """A compiled character map: a double array of keys, and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.texts = blob[4 + size :]
        self.cache: dict[int, np.ndarray] = {}

    def _jump(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest key at each start (0: none) that ends by its limit, and where its replacement is."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live, node = np.arange(len(starts)), np.full(len(starts), self._jump(self.units[:1])[0])
        depth = 0
        while len(live):
            inside = starts[live] + depth < limits[live]
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            hit = (node < len(self.units)) & ((unit & 0x800000FF) == byte)
            live, unit, node = live[hit], unit[hit], node[hit]
            node = node ^ self._jump(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]], value[live[leaf]] = depth, self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def text(self, at: int) -> np.ndarray:
        if at not in self.cache:
            end = self.texts.index(b"\0", at)
            self.cache[at] = np.frombuffer(self.texts[at:end].decode().encode("utf-32-le"), np.uint32)
        return self.cache[at]


class Normal:
    """Normal forms of a block of rows: characters, offsets of rows, and for each row the source byte of each character and the end."""

    def __init__(self, cp: np.ndarray, off: np.ndarray, source: np.ndarray):
        self.cp, self.off, self.source = cp, off, source


class Codec:
    _made: dict[str, Codec] = {}

    def __init__(self, proto):
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds & {4, 5} or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces, without user-defined or unused ones, are read")
        self.map = CharMap(spec.precompiled_charsmap) if len(spec.precompiled_charsmap) > 4 else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.decimal = [str(i).encode() for i in range(len(proto.pieces))]
        #: What each piece decodes to; None for byte pieces, whose bytes are in `byte`.
        self.surface = [None if p.type == 6 else b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self._tables({p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1})
        self._forget()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto()
            with open(path, "rb") as f:
                proto.ParseFromString(f.read())
            cls._made[path] = cls(proto)
        return cls._made[path]

    def _tables(self, pieces: dict[str, tuple[int, float]]) -> None:
        """Symbols of characters, which characters may be neighbours in a piece, and what pairs of symbols merge to."""
        of = {p: i for p, (i, _) in pieces.items()}
        for i, c in enumerate(sorted(set("".join(pieces)) - set(of))):
            of[c] = len(self.decimal) + i
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in of.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        inner = sorted(set("".join(p for p in pieces if len(p) > 1)))
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        rank = {s: i for i, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        rows = []
        for p, (i, score) in pieces.items():
            for k in range(1, len(p)):
                self.beside[self.place[ord(p[k - 1])], self.place[ord(p[k])]] = True
                if p[:k] in of and p[k:] in of:
                    rows.append((of[p[:k]] << SHIFT | of[p[k:]], rank[score], i))
        rows.sort()
        self.pairs, self.ranks, self.merged = np.array([r[0] for r in rows] or [-1], np.int64), np.array([r[1] for r in rows] or [NONE], np.int64), np.array([r[2] for r in rows] or [0], np.int64)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        empty = np.zeros(1, np.int64)
        #: By kept segment: piece ids and the characters of each, their decimals with commas, the decoded bytes.
        self.ids, self.width, self.digits, self.plain = [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.uint8)] * 2
        self.ids_at, self.digits_at, self.plain_at = empty, empty, empty

    # -- normal form -------------------------------------------------------

    def normal(self, data: np.ndarray, off: np.ndarray) -> Normal:
        cp, at = K.code_points(data, off)
        wide = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        ends = np.cumsum(wide)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        first = np.concatenate([[0], ends])[at]
        source = ends - wide - first[row]
        size = np.diff(first)
        # where a row's first character without a normal form is
        void = np.full(len(at) - 1, np.iinfo(np.int64).max)
        if self.map is not None:
            cp, row, source = self._mapped(cp, row, source, ends - wide, first, void)
        if self.squeeze:
            space = cp == 32
            after = np.ones(len(cp), bool)
            after[1:] = space[:-1] | (row[1:] != row[:-1])
            keep = ~(space & after)
            cp, row, source = cp[keep], row[keep], source[keep]
        count = np.bincount(row, minlength=len(at) - 1)
        lead = np.where((count if self.squeeze else np.diff(at)) > 0, int(self.prefix), 0)
        new = np.concatenate([[0], np.cumsum(count + lead)])
        out = np.full(new[-1], SPACE if self.escape else 32, np.uint32)
        here = np.arange(len(cp)) + np.cumsum(lead)[row]
        out[here] = np.where(cp == 32, SPACE, cp) if self.escape else cp
        # one place more in each row, for its end
        edges = np.zeros(new[-1] + len(at) - 1, np.int64)
        edges[here + row] = source
        edges[new[1:] + np.arange(len(at) - 1)] = size
        if self.squeeze:
            has = np.flatnonzero(lead)
            edges[new[has] + has] = np.minimum(edges[new[has] + has + 1], void[has])
        return self._stripped(out, new, edges) if self.squeeze else Normal(out, new, edges)

    def _mapped(self, cp, row, source, byte, first, void):
        raw = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        length, value = self.map.longest(raw, byte, first[1:][row])
        hit = np.flatnonzero(length)
        after = np.searchsorted(byte, byte[hit] + length[hit])  # the character after the key
        keep, end = np.ones(len(cp), bool), 0
        for k in np.flatnonzero(after > hit + 1).tolist():
            i, j = int(hit[k]), int(after[k])
            if i >= end:
                keep[i + 1 : j] = False
                end = j
        new = np.ones(len(cp), np.int64)
        hit = hit[keep[hit]]
        new[hit] = [len(self.map.text(int(v))) for v in value[hit]]
        empty = new == 0
        np.minimum.at(void, row[empty], source[empty])
        new[~keep] = 0
        ends = np.cumsum(new)
        out = np.repeat(cp, new)
        for i in hit.tolist():
            out[ends[i] - new[i] : ends[i]] = self.map.text(int(value[i]))
        return out, np.repeat(row, new), np.repeat(source, new)

    def _stripped(self, cp, off, edges) -> Normal:
        """Rows without spaces at their ends."""
        sign = SPACE if self.escape else 32
        keep, stays = np.ones(len(cp), bool), np.ones(len(edges), bool)
        for r in range(len(off) - 1):
            b = int(off[r + 1])
            while b > off[r] and cp[b - 1] == sign:
                b -= 1
                keep[b] = stays[b + r + 1] = False
        return Normal(cp[keep], np.concatenate([[0], np.cumsum(keep)])[off], edges[stays])

    # -- merging -----------------------------------------------------------

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _merge(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, symbol and characters of the merged symbols of all segments, in order."""
        sym = self.symbol[cp].astype(np.int64)
        sym = np.where(sym < 0, UNKNOWN + cp.astype(np.int64), sym)
        seg = np.repeat(np.arange(len(off) - 1), np.diff(off))
        short = np.diff(off)[seg] <= LONG if len(seg) else np.zeros(0, bool)
        done = [self._by_heap(s, sym[off[s] : off[s + 1]]) for s in np.flatnonzero(np.diff(off) > LONG).tolist()]
        seg, sym = seg[short], sym[short]
        width = np.ones(len(sym), np.int64)
        rank, to = self._beside(seg, sym)
        while len(seg):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(seg)), starts)
            open_ = best < (NONE << 32)
            if not open_.all():
                going = np.repeat(open_, np.diff(np.append(starts, len(seg))))
                done.append((seg[~going], sym[~going], width[~going]))
                shift = np.cumsum(~going)
                best = best[open_]
                at = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
                seg, sym, width, rank, to = seg[going], sym[going], width[going], rank[going], to[going]
            else:
                at = best & 0xFFFFFFFF
            if not len(seg):
                break
            sym[at] = to[at]
            width[at] += width[at + 1]
            keep = np.ones(len(seg), bool)
            keep[at + 1] = False
            seg, sym, width, rank, to = seg[keep], sym[keep], width[keep], rank[keep], to[keep]
            at = at - np.arange(len(at))  # one symbol went for each segment before
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(seg) - 1)
                r, t = self._pair(sym[i], sym[j])
                rank[i], to[i] = np.where((seg[i] == seg[j]) & (i != j), r, NONE), t
        if not done:
            return seg, sym, width
        seg, sym, width = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seg, kind="stable")
        return seg[order], sym[order], width[order]

    def _beside(self, seg: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, to = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pair(sym[:-1], sym[1:])
            rank[:-1][seg[1:] != seg[:-1]] = NONE
        return rank, to

    def _by_heap(self, segment: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank, to = self._beside(np.zeros(len(symbols)), symbols)
        sym, n = symbols.tolist(), len(symbols)
        after, before, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(r, i, i + 1, sym[i], sym[i + 1], t) for i, (r, t) in enumerate(zip(rank.tolist(), to.tolist(), strict=True)) if r < NONE]
        heapq.heapify(heap)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, j, a, b, t = heapq.heappop(heap)
            if sym[i] != a or after[i] != j or sym[j] != b or not width[i]:
                continue
            sym[i], width[i], width[j], after[i] = t, width[i] + width[j], 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    key = (sym[x], sym[y])
                    if key not in pairs:
                        r, to = self._pair(np.array(key[:1]), np.array(key[1:]))
                        pairs[key] = int(r[0]), int(to[0])
                    if pairs[key][0] < NONE:
                        heapq.heappush(heap, (pairs[key][0], x, y, *key, pairs[key][1]))
        left = np.flatnonzero(width)
        return np.full(len(left), segment), np.array(sym, np.int64)[left], np.array(width, np.int64)[left]

    def _learn(self, keys: list[bytes]) -> None:
        """Merges segments (UTF-32) and keeps their pieces."""
        cp = np.frombuffer(b"".join(keys), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(k) // 4 for k in keys])]).astype(np.int64)
        seg, sym, width = self._merge(cp, off)
        # characters without a piece: a piece for each byte, the last of which stands for the character
        lone = np.flatnonzero(sym >= len(self.decimal))
        chars = cp[np.cumsum(width)[lone] - 1]
        times = np.ones(len(sym), np.int64)
        raw = [chr(c).encode() for c in chars.tolist()]
        times[lone] = [len(b) for b in raw]
        last = np.cumsum(times) - 1
        ids, widths, segs = np.repeat(sym, times), np.zeros(last[-1] + 1 if len(last) else 0, np.int64), np.repeat(seg, times)
        widths[last] = width
        for i, b in zip(lone.tolist(), raw, strict=True):
            ids[last[i] - len(b) + 1 : last[i] + 1] = [self.byte_id[x] for x in b]
        at = np.concatenate([[0], np.cumsum(np.bincount(segs, minlength=len(keys)))])
        listed = ids.tolist()
        digits = [b",".join([self.decimal[i] for i in listed[a:b]]) + b"," for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        plain = [self.joined(listed[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k in keys:
            self.known[k] = len(self.known)
        grown = lambda old, new: np.concatenate([old, old[-1] + np.cumsum(new)])
        self.ids, self.width = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.width, widths.astype(np.int32)])
        self.digits, self.plain = (np.concatenate([old, np.frombuffer(b"".join(new), np.uint8)]) for old, new in ((self.digits, digits), (self.plain, plain)))
        self.ids_at, self.digits_at, self.plain_at = grown(self.ids_at, np.diff(at)), grown(self.digits_at, [len(b) for b in digits]), grown(self.plain_at, [len(b) for b in plain])

    def segments(self, normal: Normal) -> tuple[np.ndarray, np.ndarray]:
        """Number of the kept segment of each segment in turn, and the rows' offsets among them."""
        if not len(normal.cp):
            return np.zeros(0, np.int64), np.zeros(len(normal.off), np.int64)
        cut = np.ones(len(normal.cp), bool)
        place = self.place[normal.cp]
        cut[1:] = ~self.beside[place[:-1], place[1:]]
        cut[normal.off[:-1][np.diff(normal.off) > 0]] = True
        starts = np.flatnonzero(cut)
        edges = np.append(starts, len(normal.cp)).astype(np.int64) * 4
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(normal.cp))]).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.known) + len(keys) > CACHE:
            self._forget()
        if new := [k for k in keys if k not in self.known]:
            self._learn(new)
        number = np.array([self.known[k] for k in keys], np.int64)
        return number[coded.indices.to_numpy()], np.searchsorted(starts, normal.off)

    # -- decoding ----------------------------------------------------------

    def joined(self, ids: list[int]) -> bytes:
        """Bytes that pieces stand for, in a row; bytes that are not UTF-8 become replacement signs."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and (b := self.byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_read(bytes(run)))
                run = bytearray()
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.joined(ids)
        return (text[1:] if self.prefix and ids and self.byte.get(ids[0]) is None and text[:1] == b" " else text).decode()


def _read(run: bytes) -> bytes:
    """A run of byte pieces: whole characters as they are, every other byte as a replacement sign."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode().encode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


PIECES = "ids array<int>, starts array<long>, ends array<long>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def _coded(codec: Codec, column: pa.Array, digests: bool):
    """(first row, row after the last, columns) of each block of texts."""
    for a, b, data, off in K.blocks(column):
        normal = codec.normal(data, off)
        number, at = codec.segments(normal)
        many = np.diff(codec.ids_at)[number]
        ids = gathered(codec.ids, codec.ids_at[number], many)
        width = gathered(codec.width, codec.ids_at[number], many).astype(np.int64)
        tokens = np.concatenate([[0], np.cumsum(many)])[at]
        row = np.repeat(np.arange(b - a), np.diff(tokens))
        end = np.cumsum(width)
        starts, ends = normal.source[end - width + row], normal.source[end + row]
        long = np.diff(codec.plain_at)[number]
        plain = gathered(codec.plain, codec.plain_at[number], long)
        text = np.concatenate([[0], np.cumsum(long)])[at]
        first = text[:-1] + int(codec.prefix) * (np.diff(text) > 0)
        if not digests:
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(x, kind))
            raw = plain.tobytes()
            yield a, b, [lists(ids, pa.int32()), lists(starts, pa.int64()), lists(ends, pa.int64()), pa.array([raw[i:j].decode() for i, j in zip(first.tolist(), text[1:].tolist(), strict=True)])]
            continue
        long = np.diff(codec.digits_at)[number]
        digits = memoryview(gathered(codec.digits, codec.digits_at[number], long))
        cuts = np.concatenate([[0], np.cumsum(long)])[at].tolist()
        sha = lambda view, i, j: hashlib.sha256(view[i:j]).hexdigest()
        spans, plain = memoryview(np.stack([starts, ends], 1).astype("<u4")).cast("B"), memoryview(plain)
        yield a, b, [
            pa.array(np.diff(tokens), pa.int64()),
            pa.array([sha(digits, i, max(i, j - 1)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]),
            pa.array([sha(plain, i, j) for i, j in zip(first.tolist(), text[1:].tolist(), strict=True)]),
            pa.array([zlib.crc32(spans[8 * i : 8 * j]) for i, j in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)], pa.int64()),
        ]


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id and each text's piece ids, their byte spans in it, and what the ids decode to; or digests of these.

    Digests: number of pieces, sha256 of the decimal ids joined by commas and of the decoded
    text, crc32 of the spans (start, end as little-endian 32 bits).
    """
    kinds = DIGESTS if digests else PIECES
    names = ["doc_id", *[c.split()[0] for c in kinds.split(", ")]]

    def run(batches):
        turn("piece_codec", Codec._made.clear)
        codec = Codec.of(path)
        for batch in batches:
            for a, b, columns in _coded(codec, batch.column(1), digests):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)
        codec._forget()
        released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {kinds}")


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row's ids (doc_id, ids); null ids are none."""

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_path(), digests=True)
