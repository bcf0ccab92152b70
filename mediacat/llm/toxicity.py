"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

Two strings are similar if they share subsequences of four characters, each weighted by
decay ** (its spread in both), so 'idi*ot' and 'idiiot' stay close to 'idiot'. Tokens carry
marks for their start and end. The Nystroem method stands a sentence on the kernel values of
its tokens to a few landmark strings: for each landmark the largest value of any token (by
the square roots of both strings' own), and then the inverse square root of the landmarks' own kernel matrix. A linear squared-hinge SVM
in that space gives a sentence's margin, so several milder words of one sentence add up.

Training takes labelled rows, at most about `max_rows`, up to half of them toxic (chosen by a
hash of the id in each class and weighted back to the classes' true shares). Landmarks come
from both classes: token starts and tokens with the strongest association (G2) with toxic
texts, and frequent tokens of clean texts that are nearest to them. The SVM is trained on the
rows' sentences: all sentences of clean texts are negatives, and as only whole texts are
labelled, each toxic text offers the sentence with the largest margin as a positive, chosen
anew until the choice stands (multiple-instance learning). A text is scored by a sigmoid of
its largest sentence margin, the sum of its positive margins, and their share of its tokens.

Sentences end with a line or a token that ends in '.', '!' or '?'; longer ones than 32 tokens
are read in windows that overlap by half. Besides its tokens a sentence holds, as tokens of
their own, runs of three or more single letters (as one, and all pieces of them of four to eight
letters), neighbours of two or three letters each, and tokens without the punctuation inside
them. Scoring reads whole texts; a worker keeps the kernel values of tokens it has met
(bounded), in steps of 1/32, from one task to the next.

Defined cases: null and empty texts score as texts without any token of note; tokens over 24
characters are read as all their pieces of four to eight, over their whole length; without both
labels in the sample every score is the share of toxic rows (0 without rows); of rows that
share an id in the labels any toxic one counts; repeated rows are judged alike; ties between
landmarks go by the string itself; extra columns are dropped, by `kept` passed through.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import fold, released, stored, table, turn

N, DECAY = 4, 0.5
#: Letters of a token, tokens of a sentence that are read at once; letters of tokens that are read with a neighbour; letters of pieces of longer tokens.
PIECE, WINDOW, SHORT, INSIDE = 24, 32, 3, range(4, 9)
#: Pairs of neighbouring characters (marks included) that related strings share at least; of others the kernel counts as 0.
PAIRS = 2
#: Kernel values are kept in steps of 1 / STEPS.
STEPS = 32
#: Tokens whose kernel values a worker keeps, and texts that it scores at once.
CACHE, SLICE = 150_000, 256
START, END, LINE = "\x02", "\x03", "\x04"
EDGES = string.punctuation + LINE
#: Flags of a token: it ends a sentence, is a single letter, has two or three letters.
ENDS, SINGLE, FEW = 1, 2, 4


def parts_of(text: str | None) -> list[str]:
    """Lower-case tokens with their punctuation, and a mark for each line end."""
    return text.lower().replace("\n", f" {LINE} ").split() if text else []


def bare(part: str) -> str:
    return part.strip(EDGES)


def slides(letters: str) -> set[str]:
    """All pieces of four to eight letters, for whatever stands inside a string without spaces."""
    return {letters[i : i + n] for n in INSIDE for i in range(len(letters) - n + 1)}


def readings(token: str) -> list[str]:
    """The strings that a token is read as: itself and, if there is punctuation inside it, its letters alone; a long one as all its pieces."""
    if token.isalnum() and len(token) <= PIECE:
        return [token]
    out: set[str] = set()
    for t in {token, "".join(c for c in token if c.isalnum())}:
        if len(t) > PIECE:
            out |= slides(t)
        elif t:
            out.add(t)
    return sorted(out)


def _codes_of(words: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all characters of the words one after another (0: not in the alphabet), the words' lengths and first places."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(0x110000, np.int16)
    for c, k in alphabet.items():
        table[ord(c)] = k
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return table[points].astype(np.intp), lengths, np.cumsum(lengths) - lengths


def related(codes: np.ndarray, lengths: np.ndarray, landmarks: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words and landmarks that share at least PAIRS pairs of neighbouring characters, repeats counted once."""
    size = len(alphabet) + 1
    pairs = [{alphabet[a] * size + alphabet[b] for a, b in zip(m, m[1:])} for m in landmarks]
    listed = sorted(set().union(*pairs))
    place = np.full(size * size, -1, np.int32)
    place[listed] = np.arange(len(listed))
    word = np.repeat(np.arange(len(lengths)), lengths)
    at = place[codes[:-1] * size + codes[1:]]
    hit = np.flatnonzero((at >= 0) & (word[1:] == word[:-1]))
    has = np.zeros((len(lengths), len(listed)), np.float32)
    has[word[hit], at[hit]] = 1
    own = np.array([[p in q for q in pairs] for p in listed], np.float32)
    return np.nonzero(has @ own >= PAIRS)


def kernel(words: list[str], landmarks: list[str], chunk: int = 1024) -> np.ndarray:
    """Subsequence kernel, len(words) x len(landmarks); 0 where the two share fewer than PAIRS pairs of neighbouring characters.

    `ends[b, k]` holds, for each place b of a landmark, the decayed weight of common
    subsequences of k + 1 characters that end there, after each character of the words.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not any(words) or not landmarks:
        return out
    width = max(map(len, landmarks))
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(landmarks))), 1)}
    size = len(alphabet) + 1
    match = np.zeros((width, len(landmarks), size), np.float32)
    for m, w in enumerate(landmarks):
        for b, c in enumerate(w):
            match[b, m, alphabet[c]] = DECAY * DECAY
    match = match.reshape(width, -1)
    before = np.tril(np.float32(DECAY) ** (np.arange(width)[:, None] - np.arange(width) - 1), -1).astype(np.float32)
    codes, lengths, first = _codes_of(words, alphabet)
    at, mark = related(codes, lengths, landmarks, alphabet)
    order = np.argsort(lengths[at], kind="stable")
    at, mark = at[order], mark[order]
    cuts = np.flatnonzero(np.diff(lengths[at], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(lengths[at[lo]])
        for i in range(lo, hi, chunk):
            w, m = at[i : min(i + chunk, hi)], mark[i : min(i + chunk, hi)]
            ends = np.zeros((width, N - 1, len(w)), np.float32)
            total = np.zeros(len(w), np.float32)
            for a in range(n):
                hit = np.take(match, m * size + codes[first[w] + a], axis=1)
                step = (before @ ends.reshape(width, -1)).reshape(ends.shape)
                step *= hit[:, None]
                ends *= DECAY
                ends[:, 0] += hit
                ends[:, 1:] += step[:, :-1]
                total += step[:, -1].sum(0)
            out[w, m] = total
    return out


def self_kernel(words: list[str], chunk: int = 1024) -> np.ndarray:
    """The kernel of each word with itself."""
    out = np.zeros(len(words), np.float32)
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        before = np.tril(np.float32(DECAY) ** (np.arange(n)[:, None] - np.arange(n) - 1), -1).astype(np.float32)
        for i in range(0, len(at) if n else 0, chunk):
            own = codes[first[at[i : i + chunk]] + np.arange(n)[:, None]]
            ends = np.zeros((n, N - 1, own.shape[1]), np.float32)
            total = np.zeros(own.shape[1], np.float32)
            for a in range(n):
                hit = (own == own[a]) * np.float32(DECAY * DECAY)
                step = (before @ ends.reshape(n, -1)).reshape(ends.shape)
                step *= hit[:, None]
                ends *= DECAY
                ends[:, 0] += hit
                ends[:, 1:] += step[:, :-1]
                total += step[:, -1].sum(0)
            out[at[i : i + chunk]] = total
    return out


def similar(words: list[str], landmarks: list[str], norm: np.ndarray) -> np.ndarray:
    """The kernel by the square roots of the strings' own: 0 to 1; norm: the landmarks' own."""
    out = kernel(words, landmarks)
    hit = np.flatnonzero(out.max(1, initial=0) > 0)
    out[hit] /= np.sqrt(np.outer(self_kernel([words[i] for i in hit]), norm).astype(np.float32))
    return np.minimum(out, 1.0)


def _windows(flag: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and the token after the last of each window of each sentence; flag, text: of each token."""
    new = np.ones(len(flag), bool)
    new[1:] = ((flag[:-1] & ENDS) > 0) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(flag))
    more = np.maximum(-(-(last - first - WINDOW) // (WINDOW // 2)), 0)
    k = np.arange(more.sum() + len(more)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    lo = np.repeat(first, more + 1) + k * (WINDOW // 2)
    return lo, np.minimum(lo + WINDOW, np.repeat(last, more + 1))


class Met:
    """Tokens that a worker has met: one object for all its tasks, so that its parts always belong together."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.clear()

    def clear(self) -> None:
        #: token -> row of its values * 8 + flags, of late and before; row 0 has no value
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.rows: dict[bytes, int] = {bytes(len(self.landmarks)): 0}
        self.values = np.zeros((1, len(self.landmarks)), np.uint8)


#: The worker's own.
_MET: list[Met] = []


class Model:
    """A sentence's margin is its pooled kernel values to the landmarks, by their own, @ weights + bias; a text's score a sigmoid of its features."""

    def __init__(self, landmarks: list[str], norm: np.ndarray, weights: np.ndarray, bias: float, sigmoid: np.ndarray):
        self.landmarks, self.norm, self.weights, self.bias, self.sigmoid = landmarks, norm, weights, bias, sigmoid
        self.met = Met(landmarks)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "met"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        # an earlier task of this worker may have met tokens with the same landmarks
        self.met = _MET[0] if _MET and _MET[0].landmarks == self.landmarks else Met(self.landmarks)
        _MET[:] = [self.met]

    def _learn(self, new: list[str]) -> None:
        """Kernel values of parts, and of neighbours that are read as one ('a b'): the largest of their readings."""
        stripped = list(map(str.strip, new, repeat(EDGES)))
        length = np.fromiter(map(len, stripped), np.int64, len(new))
        plain = np.fromiter(map(str.isalnum, stripped), bool, len(new)) & (length >= N - 2) & (length <= PIECE)
        strings = list(compress(stripped, plain.tolist()))
        other = [(k, readings("".join(map(bare, new[k].split(" "))))) for k in np.flatnonzero(~plain & (length >= N - 2)).tolist()]
        first = np.cumsum([len(strings), *(len(r) for _, r in other)]).tolist()
        strings += [s for _, r in other for s in r]
        got = np.zeros((len(strings), len(self.landmarks)), np.uint8)
        for i in range(0, len(strings), 10_000):
            part = strings[i : i + 10_000]
            got[i : i + len(part)] = similar([START + s + END for s in part], self.landmarks, self.norm) * STEPS
        values = np.zeros((len(new), len(self.landmarks)), np.uint8)
        values[plain] = got[: first[0]]
        for (k, _), a, b in zip(other, first[:-1], first[1:], strict=True):
            values[k] = got[a:b].max(0, initial=0)
        row = np.zeros(len(new), np.int64)
        added: dict[bytes, int] = {}
        for k in np.flatnonzero(values.any(1)).tolist():
            raw = values[k].tobytes()
            at = self.met.rows.get(raw)
            row[k] = added.setdefault(raw, len(self.met.rows) + len(added)) if at is None else at
        if added:
            self.met.values = np.concatenate([self.met.values, np.frombuffer(b"".join(added), np.uint8).reshape(len(added), -1)])
            self.met.rows.update(added)
        ends = np.fromiter(map(str.endswith, new, repeat((".", "!", "?", LINE))), bool, len(new))
        code = row * 8 + ends * ENDS + (length == 1) * SINGLE + ((length >= 2) & (length <= SHORT)) * FEW
        self.met.known.update(zip(new, code.tolist(), strict=True))

    def _codes(self, parts: list[str], forget: bool = True) -> np.ndarray:
        """Row of values * 8 + flags of each part; tokens not met for long are forgotten."""
        met, own = self.met, set(parts)
        # not a difference of sets: that would go over all tokens known
        new = [p for p in own if p not in met.known]
        if forget and len(met.known) + len(new) > CACHE:
            if len(met.rows) > CACHE:
                met.clear()
            met.known, met.old = {}, met.known
            new = list(own)
        if new:
            met.known.update((p, met.old[p]) for p in new if p in met.old)
            self._learn([p for p in new if p not in met.old])
        return np.fromiter(map(met.known.__getitem__, parts), np.int64, len(parts))

    def pooled(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and pooled values (steps) of their windows with any value, and the numbers of tokens of the texts."""
        split = [parts_of(t) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        parts = [p for s in split for p in s]
        nothing = np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.uint8), sizes
        if not parts or not self.landmarks:
            return nothing
        own = self._codes(parts)
        flag, text = own & 7, np.repeat(np.arange(len(texts)), sizes)
        # further tokens: neighbours, and runs of single letters; they belong where they start
        same = text[1:] == text[:-1]
        at = np.flatnonzero((flag[1:] & FEW > 0) & (flag[:-1] & FEW > 0) & same)
        more = [f"{parts[i]} {parts[i + 1]}" for i in at.tolist()]
        edges = np.diff(np.concatenate([[0], flag & SINGLE, [0]]))
        runs = [(s, e) for s, e in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True) if e - s > 2]
        starts = at.tolist()
        for s, e in runs:
            for t in np.unique(text[s:e]).tolist():
                lo, hi = s + int(np.searchsorted(text[s:e], t)), s + int(np.searchsorted(text[s:e], t, "right"))
                if hi - lo > 2:
                    letters = "".join(map(bare, parts[lo:hi]))
                    if len(letters) <= PIECE:
                        starts.append(lo)
                        more.append(letters)
                    for n in INSIDE:
                        starts += range(lo, hi - n + 1)
                        more += [letters[i : i + n] for i in range(len(letters) - n + 1)]
        row, place = own >> 3, np.arange(len(own))
        if more:
            row = np.concatenate([row, self._codes(more, forget=False) >> 3])
            place = np.concatenate([place, np.array(starts, np.int64)])
        hit = np.flatnonzero(row)
        row, place = row[hit], place[hit]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        lo, hi = _windows(flag, text)
        a, b = np.searchsorted(place, lo), np.searchsorted(place, hi)
        has = np.flatnonzero(b > a)
        a, b = a[has], b[has]
        if not len(has):
            return nothing
        spread = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        values = np.maximum.reduceat(self.met.values[row[spread]], np.cumsum(b - a) - (b - a), axis=0)
        return text[lo[has]], values, sizes

    def margins(self, values: np.ndarray) -> np.ndarray:
        return np.clip(values @ (self.weights / STEPS) + self.bias, -1.0, 2.0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        return text_features(*self._margins(texts))

    def _margins(self, texts):
        text, values, sizes = self.pooled(texts)
        return text, self.margins(values), sizes

    def score(self, texts) -> np.ndarray:
        out = [_logistic(self.features(texts[i : i + SLICE]) @ self.sigmoid) for i in range(0, len(texts), SLICE)]
        return np.concatenate(out) if out else np.zeros(0)


def text_features(text: np.ndarray, margin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the largest margin, log of the sum of positive margins and of their share of the tokens, and 1."""
    out = np.zeros((len(sizes), 4))
    out[:, 0], out[:, 3] = -1.0, 1.0
    np.maximum.at(out[:, 0], text, margin)
    hits = np.bincount(text, np.maximum(margin, 0), len(sizes))
    out[:, 1], out[:, 2] = np.log1p(hits), np.log1p(100 * hits / np.maximum(sizes, 1))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _svm(values: np.ndarray, y: np.ndarray, weight: np.ndarray, root: np.ndarray, start: np.ndarray, c: float, chunk: int = 8192) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton's steps on values / STEPS @ root; the last coordinate is the bias."""
    whiten = np.eye(len(root) + 1)
    whiten[:-1, :-1] = root
    w, reg = start, np.eye(len(whiten))
    reg[-1, -1] = 1e-3
    for _ in range(50):
        raw = whiten @ w
        h, g = np.zeros(reg.shape), np.zeros(len(reg))
        for i in range(0, len(values), chunk):
            x = np.hstack([values[i : i + chunk] / STEPS, np.ones((len(values[i : i + chunk]), 1))])
            active = y[i : i + chunk] * (x @ raw) < 1
            xa = x[active]
            xw = xa * weight[i : i + chunk][active, None]
            h += xw.T @ xa
            g += xw.T @ y[i : i + chunk][active]
        step = np.linalg.solve(reg + 2 * c * whiten.T @ h @ whiten, 2 * c * whiten.T @ g)
        if np.allclose(step, w, atol=1e-4):
            break
        w = w + 0.7 * (step - w)
    return w


def _sigmoid(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by damped Newton's steps; no ridge on the last column."""
    reg, w = np.diag([ridge] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(x @ w)
        d = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + reg, x.T @ (weight * (y - p)) - reg @ w)
        w += d / max(1.0, np.abs(d).max())
        if np.abs(d).max() < 1e-8:
            break
    return w


def strings_of(text: str | None) -> set[str]:
    """What may become a landmark: the starts of five to nine characters, and the whole, of each token with its marks."""
    out = set()
    for p in set(parts_of(text)):
        if N <= len(t := bare(p)) <= PIECE:
            marked = START + t + END
            out.update(marked[:k] for k in range(5, min(len(marked), 10)))
            out.add(marked)
    return out


def association(a: float, b: float, n_toxic: float, n_clean: float) -> float:
    """G2, the log-likelihood ratio of a of n_toxic against b of n_clean; 0 unless toxic texts have more."""
    if a * n_clean <= b * n_toxic:
        return 0.0
    p = (a + b) / (n_toxic + n_clean)
    part = lambda k, m, e: k * math.log(k / e) if k else 0.0
    return 2 * sum(part(k, m, m * q) for x, m in ((a, n_toxic), (b, n_clean)) for k, q in ((x, p), (m - x, 1 - p)))


def landmarks_of(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int, near: int, least: float) -> list[str]:
    """Landmarks from (string, toxic texts, clean texts): `most` of the toxic class, and the `near` frequent words of the clean class closest to them."""
    strength = {s: association(a, b, n_toxic, n_clean) for s, a, b in counts}
    marks: list[str] = []
    for s in sorted(strength, key=lambda s: (-strength[s], -len(s), s)):
        if strength[s] < least or len(marks) >= most:
            break
        # at most three landmarks for a family of words, none that only lengthens another
        if sum(s[:5] == m[:5] for m in marks) < 3 and not any(s.startswith(m) or m.startswith(s) for m in marks):
            marks.append(s)
    if not marks:
        return []
    clean = [s for s, a, b in counts if s.endswith(END) and b > 2 and a * n_clean <= b * n_toxic]
    if clean:
        close = similar(clean, marks, self_kernel(marks)).max(1)
        marks += [clean[i] for i in sorted(range(len(clean)), key=lambda i: (-close[i], clean[i]))[:near]]
    return marks


def root_of(marks: list[str], norm: np.ndarray) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix."""
    gram = similar(marks, marks, norm).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T


def learned(model: Model, text: np.ndarray, values: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, rounds: int = 6) -> Model:
    """The model with weights and sigmoid from pooled windows (text, values) of labelled texts (sizes, label y, weight)."""
    order = np.argsort(text, kind="stable")
    text, values = text[order], values[order]
    root, toxic = root_of(model.landmarks, model.norm), y[text] > 0
    pos, neg = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    each = 1 / np.bincount(text, minlength=len(y)).clip(1)[text[neg]]
    heads = np.flatnonzero(np.diff(text[pos], prepend=-1))
    # windows without any value are in all texts: one stands for them
    empty = np.zeros((1, values.shape[1]), np.uint8)
    # at first a window is as toxic as its nearest landmark is more at home in toxic texts
    lean = values[pos].mean(0) > values[neg].mean(0) if len(pos) and len(neg) else np.ones(values.shape[1], bool)
    margin, chosen, w = (values[pos] * lean).max(1, initial=0) / STEPS - 0.75, None, np.zeros(len(root) + 1)
    for _ in range(rounds):
        # positives: a toxic text's windows of positive margin, and the largest one in any case
        ranked = np.lexsort((np.arange(len(pos)), -margin, text[pos]))
        now = pos[np.union1d(ranked[heads], np.flatnonzero(margin > 0))] if len(pos) else pos
        if chosen is not None and np.array_equal(now, chosen):
            break
        chosen = now
        own = 1 / np.bincount(text[chosen], minlength=len(y)).clip(1)[text[chosen]]
        sign = np.concatenate([np.ones(len(chosen)), -np.ones(len(neg) + 1)])
        share = np.concatenate([own / max(own.sum(), 1e-12), each / max(each.sum(), 1e-12), [0.5]])
        w = _svm(np.concatenate([values[chosen], values[neg], empty]), sign, share, root, w, c)
        margin = values[pos] / STEPS @ (root @ w[:-1]) + w[-1]
    model.weights, model.bias = root @ w[:-1], float(w[-1])
    model.sigmoid = _sigmoid(text_features(text, model.margins(values), sizes), y, weight)
    return model


def constant(n_toxic: float, n_clean: float) -> Model:
    """Scores every text by the share of toxic rows; 0 without rows."""
    odds = math.log((n_toxic + 1e-6) / (n_clean + 1e-6)) if n_toxic + n_clean else -30.0
    return Model([], np.ones(0), np.zeros(0), -1.0, np.array([0, 0, 0, odds]))


def train(texts: list[tuple[str | None, int]], most: int = 40, near: int = 8, least: float = 40.0) -> Model:
    """The model of a few labelled texts, as `fit` has it of tables."""
    y = np.array([float(label != 0) for _, label in texts])
    n = int(y.sum()), int((1 - y).sum())
    seen = Counter(), Counter()
    for t, label in texts:
        seen[int(label == 0)].update(strings_of(t))
    counts = [(s, seen[0][s], seen[1][s]) for s in {*seen[0], *seen[1]}]
    marks = landmarks_of(counts, *n, most, near, least) if min(n) else []
    if not marks:
        return constant(*n)
    model = Model(marks, self_kernel(marks), np.zeros(len(marks)), -1.0, np.zeros(4))
    return learned(model, *model.pooled([t for t, _ in texts]), y, np.ones(len(y)))


def _counted(rows: DataFrame) -> DataFrame:
    """s, a, b: in how many toxic and clean rows a string is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def out():
            both = list({*seen[0], *seen[1]})
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[s] for s in both], pa.int64()) for c in seen)], names=["s", "a", "b"])

        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(label == 0)].update(strings_of(t))
                if len(seen[0]) + len(seen[1]) > CACHE:
                    yield out()
                    seen = Counter(), Counter()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _g2(n_toxic: int, n_clean: int) -> Column:
    """`association` of columns a and b."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = float(n_toxic + n_clean)
    term = lambda k, m, q: F.when(k > 0, k * F.log(k / (m * q))).otherwise(0.0)
    p = (a + b) / n
    parts = term(a, n_toxic, p) + term(n_toxic - a, n_toxic, 1 - p) + term(b, n_clean, p) + term(n_clean - b, n_clean, 1 - p)
    return F.when(a * n_clean > b * n_toxic, 2 * parts).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, most: int = 40, near: int = 8, least: float = 40.0, listed: int = 2000) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic.

    About max_rows labelled rows at most are learned from. Landmarks: `most` and `near` (see
    `landmarks_of`), out of the `listed` strings of the strongest association (at least
    `least`) and as many most frequent words of clean rows.
    """
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, max_rows / 2 / max(n.get(k, 0), 1)) for k in (0, 1)}
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20)
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit)
    # at most about max_rows rows of two numbers
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
    n_clean, n_toxic = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n_clean or not n_toxic:
        return constant(n_toxic / share[1], n_clean / share[0])
    counts = stored(_counted(rows).withColumn("g2", _g2(n_toxic, n_clean)).filter((F.col("g2") >= least) | (F.endswith("s", F.lit(END)) & (F.col("b") > 2))))
    strong = counts.filter(F.col("g2") >= least).orderBy(F.desc("g2"), F.desc(F.length("s")), "s").limit(listed)
    frequent = counts.filter(F.endswith("s", F.lit(END)) & (F.col("g2") == 0)).orderBy(F.desc("b"), "s").limit(listed)
    marks = landmarks_of([(r["s"], r["a"], r["b"]) for r in strong.unionByName(frequent).distinct().collect()], n_toxic, n_clean, most, near, least)
    if not marks:
        return constant(n_toxic / share[1], n_clean / share[0])
    model = Model(marks, self_kernel(marks), np.zeros(len(marks)), -1.0, np.zeros(4))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                text, values, sizes = model.pooled(part.column(1).to_pylist())
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                raw = pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), raw], names=["doc_id", "toxic", "n", "windows"])

    got = sorted(rows.mapInArrow(windows, "doc_id long, toxic int, n long, windows binary").collect(), key=lambda r: (r["doc_id"], r["n"], bytes(r["windows"])))
    own = [np.frombuffer(r["windows"], np.uint8).reshape(-1, len(marks)) for r in got]
    y = np.array([r["toxic"] for r in got], float)
    text = np.repeat(np.arange(len(got)), [len(w) for w in own])
    model = learned(model, text, np.concatenate(own), np.array([r["n"] for r in got], np.int64), y, np.where(y > 0, 1 / share[1], 1 / share[0]))
    del got, own, text
    released()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5)."""

    def run(batches):
        turn("toxicity", _MET.clear)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                score = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the rows whose text is not predicted toxic."""
    place = docs.columns.index("text")

    def run(batches):
        turn("toxicity", _MET.clear)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield part.filter(pa.array(model.score(part.column(place).to_pylist()) < 0.5))
        released()

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = fit(docs, table(spark, sf_dir, "labels").filter(held != 0))
    return predict(docs, model).select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), "score", "predicted")
