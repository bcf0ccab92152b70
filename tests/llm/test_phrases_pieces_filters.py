"""op11 to op13 against the library, brute force and in the odd cases; op5 with shared ids."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from mediacat.llm import collocations, filter_audit, ngram_join, piece_codec
from mediacat.llm import kernels as K
from test_corpus import ODD, table

SPM = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def lib():
    return SPM.SentencePieceProcessor(model_file=piece_codec.model_path())


def odd_texts():
    r = random.Random(1)
    alphabet = "ab  ▁▁\n\t.é😀ñthe an　你好 0123<s></s>\x00"
    texts = [*ODD, " ", "  ", "a ", "▁", "<s>", "<0x0A>", "the" * 200, " " * 500 + "a", "你好" * 100, "é́"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    return texts + ["".join(r.choice("aeinorst") for _ in range(r.randint(40, 400))) for _ in range(60)]


def test_pieces_equal_the_library(spark, lib):
    texts = odd_texts()
    rows = {r["doc_id"]: r for r in piece_codec.encoded(table(spark, texts), piece_codec.model_path()).collect()}
    digests = {r["doc_id"]: r for r in piece_codec.encoded(table(spark, texts), piece_codec.model_path(), digests=True).collect()}
    assert len(rows) == len(digests) == len(texts)
    for i, t in enumerate(texts):
        want = lib.encode(t or "", return_type="proto").pieces
        ids, spans = [p.id for p in want], [(p.begin, p.end) for p in want]
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == lib.decode(ids)
        assert list(zip(rows[i]["starts"], rows[i]["ends"], strict=True)) == spans
        d = digests[i]
        assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and d["spans_crc32"] == zlib.crc32(np.array(spans, "<u4").tobytes())
    back = {r["doc_id"]: r["decoded"] for r in piece_codec.decoded(piece_codec.encoded(table(spark, texts[:40]), piece_codec.model_path()), piece_codec.model_path()).collect()}
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(texts[:40])}
    assert piece_codec.encoded(table(spark, []), piece_codec.model_path()).count() == 0


def test_any_ids_decode_as_the_library_does(lib):
    r, codec = random.Random(2), piece_codec.Codec.of(piece_codec.model_path())
    for _ in range(400):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("escape,squeeze,prefix", [(True, True, True), (True, False, True), (False, True, False)])
def test_normal_forms_equal_the_library(rule, escape, squeeze, prefix):
    from sentencepiece import sentencepiece_model_pb2 as M

    own = SPM.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=squeeze)
    spec, model = M.ModelProto(), M.ModelProto()
    spec.ParseFromString(own.serialized_model_proto())
    with open(piece_codec.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    codec, r = piece_codec.Codec(model), random.Random(3)
    signs = ["a", "e", "́", "̈", "ﬁ", "①", "Ａ", "  ", " ", "\t", "　", "​", "가", "ᄀ", "ᅡ", "ᆨ", "😀", "ß", "İ", "▁", "\x01", "½", "x", "㍍"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    normal = codec.normal(*K.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        a, b = normal.off[i], normal.off[i + 1]
        want, at = own.Normalize(t, with_offsets=True)
        assert normal.cp[a:b].astype("<u4").tobytes().decode("utf-32-le") == want
        # the library counts characters here
        byte = list(itertools.accumulate((len(c.encode()) for c in t), initial=0))
        if want:
            assert normal.source[a + i : b + i + 1].tolist() == [byte[k] for k in at]


def brute_audit(rows, labels):
    """rows: (id, text, source)."""
    out, first = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {k for k, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        fails.append((s or "", failed, i))
    shapley = Counter()
    for part in {s for s, _, _ in fails}:
        own = [(f, i) for s, f, i in fails if s == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                shapley[part, k] += len(gone)
                good, toxic = (sum(labels.get(i, (0, 0))[j] == 1 for _, i in gone) for j in (0, 1))
                out[part, order, step] = [len(left), len(gone), sum(k in f for f, _ in own) - len(gone), sum(f == {k} for f, _ in own), good, toxic]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [*ODD, *[" ".join(r.choice(["a", "b", "Cap", "ALL", "#x", f"w{r.randrange(500)}"]) for _ in range(r.choice([3, 60, 80]))) for _ in range(60)]]
    texts += r.sample(texts, 30)
    rows = [(r.choice([None, k, k, k, 5]), t, r.choice(["x", "y", None])) for k, t in enumerate(texts)]
    labels = {k: (r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 90, 2)}
    docs = spark.createDataFrame([(*x, "1", "2") for x in rows], "doc_id long, text string, source string, mask string, n string")
    said = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(4, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    counted = filter_audit.cells(docs, said, filter_audit.contract_filters(), "source", copies=4)
    assert {tuple(x) for x in filter_audit.audit(counted, "ABCDE").collect()} == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), said, filter_audit.contract_filters(), "source", 4), "ABCDE").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_transpositions(n):
    seen = list(filter_audit.transpositions(n))
    assert sorted(tuple(o) for o, _ in seen) == sorted(itertools.permutations(range(n)))
    for (a, _), (b, at) in itertools.pairwise(seen):
        assert b == [*a[:at], a[at + 1], a[at], *a[at + 2 :]]


def brute_phrases(rows, least, top):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = [(lang, p) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    dropped = {(lang, p[i : i + k]) for lang, p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[lang, p] >= 80 * f[lang, p[i : i + k]]}
    rows = []
    for lang, p in found:
        if (lang, p) not in dropped:
            a = f[lang, p]
            s, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((lang, s, a, " ".join(p), l, r))
    out = set()
    for lang in n:
        best = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out |= {(lang, i, p, a, l, r, n[lang], s) for i, (_, s, a, p, l, r) in enumerate(best, 1)}
    return out


def test_collocations(spark, monkeypatch):
    r = random.Random(6)
    words = ["a", "B", "é", "日本", "x" * 40, "of", "the", "(c)", "n\x0bq"]
    rows = [(t, "en") for t in ODD if len(t or "") < 1000]
    for _ in range(120):
        sign = lambda: r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; "])
        rows.append(("".join(r.choice(words[: r.choice([2, 5, 9])]) + sign() for _ in range(r.randrange(40))), r.choice(["en", "en", "de", "und", None])))
    rows += [("one two three four five", "en")] * 20 + [("w " * 700, "de")]
    docs = spark.createDataFrame([(k % 50, t, lang, "x", "y") for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, gid string, kind string")
    for block, size in ((1 << 20, 1_500_000), (97, 300)):
        monkeypatch.setattr(collocations, "BUCKET", size)
        got = {tuple(x) for x in collocations.mined(docs, least=8, top=15, block=block).collect()}
        assert got == brute_phrases(rows, 8, 15)
    assert collocations.mined(docs.limit(0)).count() == 0


def test_scores_are_exact():
    assert collocations.unpack(collocations.pack(np.array([0, 5, 1 << 40]))).tolist() == [0, 5, 1 << 40]
    big = np.array([1 << 33, 1 << 33, 3])
    assert len(np.unique(collocations._paired(big, np.array([1, 2, 1 << 35])))) == 3
    places = np.array([3, 9, 1, 2, 1 << 31])
    assert collocations.unpack_lists(collocations.pack_lists(places)).tolist() == places.tolist()


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 9 * 10**17, 10**18, 10**18 + 7  # noqa: E741
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"), 2000000).alias("s")).first()
    assert row["s"] == 2000000 * a // (l + r)


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    w = [f"w{k}" for k in range(60)]
    texts = [" ".join(w), " ".join([*w, "more"]), "quite another text of its own here", " ".join([*w, "less"]), "third one of few words"]
    ids = [5, 8, 5, 10, 8]
    rows = ngram_join.joined(table(spark, texts, ids), 3, Fraction(9, 10)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == [(5, 5, 5), (5, 58, 5), (8, 3, 8), (8, 59, 5), (10, 59, 5)]
    kept = ngram_join.representatives(table(spark, texts, ids), 3, Fraction(9, 10)).collect()
    assert sorted(r["text"] for r in kept) == sorted([texts[0], texts[2], texts[4]])
    both = ngram_join.representatives(table(spark, [texts[0], texts[1], texts[0]], [5, 5, 5]), 3, Fraction(9, 10)).collect()
    assert len({r["text"] for r in both}) == 1
