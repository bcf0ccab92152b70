"""Personal data: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose spans of several kinds, which may overlap. Fixed base formats
(email, ip, card, phone) are always kept. Every other candidate is described by its format
(length, classes of characters and their changes, groups, checks of Luhn, IBAN and octets,
entropy) and its context (the words before it, the word next to it, quotes, neighbours) and
scored by gradient-boosted trees. A kind's threshold is the lowest calibrated probability that
keeps the aimed precision on held-out examples. Accepted candidates that overlap a better one
are dropped, and so are those that overlap a base span, but for secrets and account numbers
with the base span inside them.

The tables have no labelled spans, so the trees learn from examples that `examples` writes
by rule: formats in telling, neutral and misleading contexts. Some are ambiguous by intent (a
bare hexadecimal number may be a key or a checksum), with labels by chance at the rate that
the rule states; thresholds have to rise above them. Training is deterministic and takes a few
seconds on the driver; the model is a few kilobytes.

Generators read whole texts, in time linear in the text: an email is found from its '@'
outwards. A generator is left out only for texts without a character that its pattern needs.

Defined cases: null and empty texts have no spans; very long texts are read whole; offsets are
code points, ends exclusive; candidates of equal probability are taken in the order found;
repeated rows are judged alike; an empty table gives no rows; other columns pass through
`redacted` and are dropped by `found`.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.boosting import Boosted, calibrated
from mediacat.llm.common import slices, table, turn

#: Kinds in the order that spans are listed in; the first four have base formats.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Generators of further candidates: (kind, characters of which their pattern needs one, pattern).
_MORE = (
    ("secret", "", re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")),
    ("phone", "0123456789", re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("ssn", "0123456789", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", "0123456789", re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])")),
    ("ip", ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("iban", "0123456789", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")),
    ("email", "([", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")),
)
#: Words before a span that speak for a kind, or (last) against any.
_CUES = tuple(
    re.compile(rf"\b(?:{p})")
    for p in (
        r"token|secret|api|key\b|passw|auth|bearer|credential",
        r"tel\b|phone|call\b|fax\b|mobile|cell\b|dial",
        r"card\b|visa\b|master|credit|paid\b|pay\b|amex",
        r"ip\b|addr|host\b|server|login from",
        r"mail|contact|write to",
        r"ssn\b|social|tax id|iban\b|account|bank\b",
        r"version\b|release\b|order\b|isbn|issn|invoice|sku\b|ref\b|page\b|serial|doi\b|commit\b|sha[0-9]*\b|checksum|md5|model\b|part no|id\b",
    )
)
_LAST_WORD = re.compile(r"([a-z][a-z0-9_]*)[^a-z0-9]{0,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed formats, leftmost and non-overlapping for each kind; matches that fail a check are dropped."""
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, done := m.end()))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 38 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    moved = text[4:] + text[:4]
    return moved.isascii() and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    digits = bool(_DIGIT.search(text))
    able = lambda need: not need or (digits if need[0] == "0" else any(c in text for c in need))
    return [(kind, *m.span()) for kind, need, pattern in _MORE if able(need) for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    letters = sum(c.isalpha() for c in s)
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    sort = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    before = text[max(0, start - 30) : start].lower()
    near = m.group(1) if (m := _LAST_WORD.search(before)) else ""
    prev, nxt = text[start - 1 : start], text[end : end + 1]
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), letters, sum(c.isupper() for c in s), n - len(digits) - letters, len(re.findall(r"[0-9]+", s)), len(set(s)),
        -sum(v / n * math.log2(v / n) for v in counts.values()), sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        sum(a != b for a, b in zip(sort, sort[1:])) / n, sum(c in "aeiouAEIOU" for c in s) / max(letters, 1),
        float(bool(digits) and luhn(digits)), float(kind == "iban" and iban(s)), float(digits[:1] in tuple("3456") if digits else 0), float(bool(digits) and letters > 0),
        float(prev in tuple("\"'`") and nxt in tuple("\"'`")), float(prev.isalnum()), float(nxt.isalnum()), float(prev in tuple("/#$:=")), float(text[max(0, start - 3) : start].strip() == "+1"), float(any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)),
        *(float(bool(cue.search(before))) + float(bool(near and cue.match(near))) for cue in _CUES),
    ]


#: Shares of ambiguous examples that are personal: their labels are drawn at these rates.
BARE_HEX, BARE_PHONE, BARE_SSN, WRONG_CARD, BARE_IPV6 = 0.35, 0.95, 0.6, 0.6, 0.97


def examples(n: int = 15000, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of n spans that are written by rule."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    digits = lambda k: some("0123456789", k)
    word = lambda a, b: some("aaabcdeeefghiiiklmnooprrstuuvwxyz", r.randint(a, b))
    hexes = lambda k: some("0123456789abcdef", k)
    key = lambda k: some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k)
    cues = {
        "secret": ["token = ", "token: ", "api_key: ", "secret=", "password ", "Authorization: Bearer ", "key ", "access token "],
        "phone": ["call ", "tel. ", "phone: ", "fax ", "mobile ", "cell "],
        "ssn": ["SSN ", "social security ", "tax id "],
        "card": ["card ", "visa ", "paid with ", "credit card: ", "card number "],
        "ip": ["host ", "from server ", "ip ", "addr ", "server "],
        "iban": ["IBAN ", "account ", "bank: "],
        "email": ["mail ", "contact ", "write to "],
    }
    bad = ["version ", "order ", "ISBN ", "invoice ", "ref ", "serial ", "commit ", "sha ", "sku ", "model ", "checksum ", "order id "]

    def card(valid: bool, start: str = "3456") -> str:
        d = r.choice(start) + digits(r.choice([14, 14, 14, 13, 12, 17]))
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if valid else r.choice([c for c in "0123456789" if c != last]))

    def grouped(d: str) -> str:
        return r.choice([d, d, r.choice(" .-").join(d[i : i + 4] for i in range(0, len(d), 4))])

    def account(valid: bool) -> str:
        country, rest = r.choice(["DE", "FR", "ES", "GB", "IT"]), digits(r.randint(14, 20))
        check = f"{98 - int(rest + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02d}"
        return country + (check if valid else f"{(int(check) + r.randint(1, 90)) % 97:02d}") + rest

    def one(kind: str) -> tuple[str, str, int]:
        """Cue, span, label."""
        told, chance = r.choice(cues[kind]), r.random()
        by = lambda share: int(r.random() < share)
        if kind == "secret":
            strong = r.choice([hexes(40), hexes(32), hexes(64), key(r.randint(24, 44)), "sk-" + key(24), some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r.randint(24, 40))])
            if chance < 0.4:
                return told, strong, 1
            if chance < 0.55:
                return "", r.choice([hexes(40), hexes(32), hexes(64)]), by(BARE_HEX)
            if chance < 0.62:
                return "", key(r.randint(28, 44)), by(0.8)
            plain = r.choice([word(20, 34), word(20, 24), "-" * r.randint(20, 40), "=" * r.randint(20, 60), "_" * 30, "_".join(word(4, 8) for _ in range(4)), "-".join(word(5, 9) for _ in range(4)), "/".join(word(4, 9) for _ in range(4)), digits(24), some("ab", 25)])
            if chance < 0.7:
                return r.choice(bad), strong, 0
            return r.choice(["", "", "", told]), plain, 0
        if kind == "phone":
            s = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", "-".join([digits(3), digits(3), digits(4)]), ".".join([digits(3), digits(3), digits(4)])])
            return (told, s, 1) if chance < 0.4 else ("+1 ", s, 1) if chance < 0.5 else ("", s, by(BARE_PHONE)) if chance < 0.7 else (r.choice(bad), s, 0)
        if kind == "ssn":
            s = f"{digits(3)}-{digits(2)}-{digits(4)}"
            return (told, s, 1) if chance < 0.4 else ("", s, by(BARE_SSN)) if chance < 0.65 else (r.choice(bad), s, 0)
        if kind == "card":
            if chance < 0.4:
                return r.choice(["", "", told]), grouped(card(True)), 1
            if chance < 0.48:
                return told, grouped(card(False)), by(WRONG_CARD)
            if chance < 0.56:
                return r.choice(["", r.choice(bad)]), grouped(card(True, "012789")), by(0.3)
            if chance < 0.64:
                return r.choice(bad), card(True), 0
            return r.choice(["", "", "", r.choice(bad)]), grouped(card(False, r.choice(["3456", "0123456789"]))), 0
        if kind == "ip":
            s = ":".join(hexes(r.randint(1, 4)) for _ in range(8))
            return (told, s, 1) if chance < 0.4 else ("", s, by(BARE_IPV6)) if chance < 0.7 else (r.choice(bad), s, 0)
        if kind == "iban":
            return (r.choice(["", told]), account(True), 1) if chance < 0.5 else (r.choice(["", *bad]), account(False), 0) if chance < 0.8 else ("", word(2, 2).upper() + digits(2) + word(11, 20).upper(), 0)
        name, host = word(3, 9), word(3, 9)
        if chance < 0.5:
            return r.choice(["", told, "at "]), f"{name} (at) {host} (dot) {r.choice(['com', 'org', 'net', 'de'])}", 1
        return (r.choice(["", told]), f"{name}{r.choice(['(at)', '[at]', ' [at] '])}{host}.{r.choice(['com', 'org', 'net'])}", 1) if chance < 0.7 else (r.choice(["", *bad]), f"{word(2, 4)} (at) {word(3, 9)}.{word(12, 20)}", 0)

    x, y, kinds = [], [], []
    for _ in range(n):
        kind = r.choice(list(cues))
        cue, s, label = one(kind)
        quote = r.choice(["", "", "", '"', "'"]) if kind == "secret" else r.choice(["", "", "", "", '"'])
        if kind == "card" and not cue and r.random() < 0.15:  # digits inside a longer word
            cue, label = cue + hexes(3) + r.choice("abcdef"), 0
            quote = ""
        left = f"{word(2, 8)} {word(2, 8)}{r.choice([' ', ', ', '. ', ': '])}{cue}{quote}"
        text = f"{left}{s}{quote}{r.choice([' ', '. ', ', ', chr(10)])}{word(2, 8)} {word(2, 8)}"
        if r.random() < 0.1:
            text, left, s = text.upper(), left.upper(), s.upper()
        x.append(features(text, kind, len(left), len(left) + len(s)))
        y.append(label)
        kinds.append(kind)
    return np.array(x, float), np.array(y, float), kinds


class Model:
    def __init__(self, trees: Boosted, slope: float, shift: float, least: dict[str, float]):
        self.trees, self.slope, self.shift, self.least = trees, slope, shift, least

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.log_odds(x) + self.shift, -30, 30)))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability of a personal example from which on the accepted examples have the precision; above 1 if none has."""
    order = np.argsort(-p, kind="stable")
    kept = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero((kept >= precision) & (y[order] > 0))
    return float(p[order][ok[-1]]) if len(ok) else 1.1


@lru_cache(maxsize=2)
def train(precision: float = 0.98) -> Model:
    """Two thirds of the examples grow the trees, the rest set the calibration and each kind's threshold."""
    x, y, kinds = examples()
    cut = 2 * len(x) // 3
    model = Model(Boosted(depth=4, rounds=100).fit(x[:cut], y[:cut]), 1.0, 0.0, {})
    model.slope, model.shift = calibrated(model.trees.log_odds(x[cut:]), y[cut:])
    p = model.probability(x[cut:])
    for kind in sorted(set(kinds)):
        own = np.array([k == kind for k in kinds[cut:]])
        model.least[kind] = threshold(p[own], y[cut:][own], precision)
    return model


class Held:
    """Ranges that are taken, as sorted disjoint ones."""

    def __init__(self, spans: list[tuple[str, int, int, bool]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end, _ in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return not i or self.ends[i - 1] <= start

    def inside(self, start: int, end: int) -> bool:
        """Whether all taken ranges that the range meets lie in it, and one is shorter."""
        i, j = bisect_left(self.starts, end), bisect_right(self.ends, start)
        return all(start <= s and e <= end and e - s < end - start for s, e in zip(self.starts[j:i], self.ends[j:i], strict=True))

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def spans_of(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, by kind as listed, then start."""
    out: list[list] = []
    asked: list[tuple[int, str, int, int]] = []
    rows: list[list[float]] = []
    for i, text in enumerate(texts):
        found = []
        if text:
            found = [(*s, True) for s in base_spans(text)]
            held = Held(found)
            for c in candidates(text):
                if held.free(c[1], c[2]) or (c[0] in ("secret", "iban") and held.inside(c[1], c[2])):
                    asked.append((i, *c))
                    rows.append(features(text, *c))
        out.append(found)
    if rows:
        p = model.probability(np.array(rows, float))
        taken: dict[int, Held] = {}
        for k in np.argsort(-p, kind="stable"):
            i, kind, start, end = asked[k]
            held = taken.setdefault(i, Held([]))
            if p[k] >= model.least.get(kind, 1.1) and held.free(start, end):
                held.take(start, end)
                out[i].append((kind, start, end, False))
    place = {k: i for i, k in enumerate(KINDS)}
    return [sorted(found, key=lambda s: (place[s[0]], s[1])) for found in out]


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def found(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base)."""
    model = model or train()

    def run(batches):
        turn("pii")
        for batch in slices(batches):
            spans = spans_of(batch.column(1).to_pylist(), model)
            rows = pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in one] for one in spans], _TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def blanked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """All rows and columns, with the spans found in the text blanked."""
    model = model or train()
    place = docs.columns.index(text)

    def run(batches):
        turn("pii")
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            new = [t and blanked(t, s) for t, s in zip(texts, spans_of(texts, model), strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
