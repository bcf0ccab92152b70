"""Corpus operators against brute force and in the odd cases: nulls, empty, long, repeated, no rows, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA, duck, rows_of
from mediacat.llm import common, decontamination, language_id, ngram_join, packing, pii, quality_rules, registry, sharding, suffix_dedup, toxicity, url_filter
from mediacat.llm import kernels as K
from mediacat.operators.graph import components

#: Names that the operators use for themselves.
OWN = "h part id tokens w _t bucket _other _n _row _bucket _before n s1 s2 rep comp component_id class_id copies shared kind blob spans kept score predicted toxic bytes first later item_id token a b s g2 size shard slot piece length".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use for themselves."""
    rows = [(i if ids is None else ids[k], t, "en", "s", len(t or ""), *("x" for _ in OWN)) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "a", "a b", "one two three four five six seven", "one two three four five six seven", "x" * 200_000, "é ñ ß 日本 \U0001f600 " * 30, "\x0b\x0c mixed\rSPACE\x1cX", "w " * 30_000, "1.2.3.4 +1 (555) 010-9999 a@b.co 4111 1111 1111 1111"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = registry.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck().sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_registry_is_whole():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries() if k != "quality_ablations") == list(range(1, 14))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f a b c d e g " * 3, "line\nline\n \nother\nline", "$$ || <> # fine"]
    got = {r["doc_id"]: r for r in quality_rules.ledger(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
    assert quality_rules.ledger(table(spark, [])).count() == 0


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (4,), (8,), (32,)], "fail_bits long")
    got = {(r["policy"], r["rule"]): tuple(r)[2:] for r in quality_rules.ablations(rows).collect()}
    assert got["base", "min_words"] == (2, 2, 2 - 1) and got["base", "repeated_words"] == (2, 1, 0) and got["v1", "symbols"] == (4, 1, 1) and got["v2", "shouting"] == (5, 1, 1)
    assert quality_rules.apply_policy(rows, "base").count() == 4


def test_quality_keeps_prose(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    kept = quality_rules.ledger(rows).select("doc_id", quality_rules.passes(quality_rules.CURRENT).alias("kept")).join(rows, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in kept.collect()}
    assert share[1] > 0.97 and share[0] < 0.5


def test_shards(spark):
    texts = [*ODD, *[f"t{i}" for i in range(600)]]
    ids = [7 if i in (5, 6) else None if i == 3 else i for i in range(len(texts))]
    rows = sharding.assign(table(spark, texts, ids), [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == len(texts)
    for shard, own in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        assert sorted(r["slot"] for r in own) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert 60 < sum(r["grown_shard"] == 4 for r in rows) < 190
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert sizes[0] == (1, 0) and sizes[8] == (len(ODD[8].encode()) + 1, zlib.crc32(ODD[8].encode()))
    heavy = Counter(r["shard"] for r in sharding.assign(table(spark, texts), [3.0, 1.0]).collect())
    assert 2 < heavy[0] / heavy[1] < 4.5
    assert sharding.assign(table(spark, []), [1.0]).count() == 0


def test_hosts(spark):
    urls = ["HTTP://A.B.Org/x?y#z", "http://example.org/es/1", "x://example.org/en/123", "nothing", None, "", "://", "a://com/fr/", "a://x.com/de/1?q", "a://xcom/de/1", "a://user@host.com:80/fr/x", "http://h.net#f/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none).collect()}
    assert len(got) == len(urls)
    assert [got[i]["host"] for i in (0, 3, 4, 6, 10, 11)] == ["a.b.org", "", "", "", "user@host.com:80", "h.net"]
    assert got[0]["path"] == "/x" and got[11]["path"] == ""
    assert [got[i]["rule"] for i in (0, 1, 2, 3, 7, 8, 9)] == ["org/", "example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 7, 8)] == ["allow", "block", "block", "allow", "block"]
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_levels_of_hosts(spark):
    cases = {"www.a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "user:pw@x.b.com.br:8080": ("b.com.br", "com.br"), "10.0.0.1": ("10.0.0.1", "ip"), "u@10.0.0.1:80": ("10.0.0.1", "ip"), "[::1]:80": ("[::1]", "ip"), "h.example.org.": ("example.org", "org"), "local": ("local", "local"), "": ("", ""), "x.y.com:": ("y.com", "com")}
    site = url_filter.site_of(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in cases], "host string").select("host", *[c.alias(n) for c, n in zip(url_filter.levels(site), ("domain", "suffix"))]).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in rows} == cases


def test_salted_bounds_are_the_same(spark, monkeypatch):
    pages, labels = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet"), spark.createDataFrame([(i, i % 3 > 0) for i in range(40)], "page_id long, good boolean")
    want = sorted(url_filter.judge(pages, labels).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 0)
    assert sorted(url_filter.judge(pages, labels).collect()) == want and len(want) == pages.count()


def test_reputation_shrinks(spark):
    rows = [("bad.x.net", 40, 2), ("new.x.net", 1, 0), *[(f"g{i}.net", 30, 27 + i % 4) for i in range(10)]]
    got = {r["host"]: r["mean"] for r in url_filter.reputation(spark.createDataFrame(rows, "host string, n long, good long")).collect()}
    assert got["bad.x.net"] < 0.2 and 0.05 < got["new.x.net"] < 0.8 and all(got[f"g{i}.net"] > 0.8 for i in range(10))


def brute_components(texts, n, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


@pytest.mark.parametrize("n,least", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_ngram_join(spark, n, least):
    r = random.Random(n)
    texts = list(ODD[:7]) + ["A b", "a  B", "common passage that many share " * 4]
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 40, 90]))]
        for _ in range(r.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy) + (" common passage that many share often" if r.random() < 0.3 else ""))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.joined(table(spark, texts), n, least).collect()}
    assert got == brute_components(texts, n, least)
    kept = ngram_join.representatives(table(spark, texts), n, least)
    assert kept.columns == table(spark, []).columns and {x["doc_id"] for x in kept.collect()} == {c for _, c in got.values()}


def test_ngram_join_without_rows(spark):
    assert ngram_join.joined(table(spark, [])).count() == 0
    assert {r["component_id"] for r in ngram_join.joined(table(spark, [None, ""])).collect()} == {0, 1}
    rows = ngram_join.joined(table(spark, ["a b c d", "a b c d"], [4, 4])).collect()
    assert [r["component_id"] for r in rows] == [4, 4]
    rows = ngram_join.joined(table(spark, ["a b c d", "a b c d", "z"], [None, 4, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["component_id"]) == [(False, 4), (True, 4)] and len(rows) == 3


def thue_morse(n):
    """Two words of n letters that no polynomial hash modulo 2 ** 64 tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_of_thue_and_morse_differ(spark, n):
    x, y = thue_morse(n)
    texts = [f"{x} p q", f"{y} p q", f"{x} p q"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(table(spark, texts)).collect()}
    assert got == brute_components(texts, 3, Fraction(9, 10)) and [got[i][1] for i in range(3)] == [0, 1, 0]
    data = np.frombuffer((x + y).encode(), np.uint8)
    h = [K.Rolling(data, seed).of(np.array([0, n]), np.array([n, 2 * n])) for seed in (1, 2)]
    assert all(a != b for a, b in h)


def test_common_shingles_are_settled_in_the_task():
    owner = np.array([5, 5, 7, 9, 9, 7, 5], np.uint64)
    h = np.array([1, 2, 2, 2, 3, 4, 4], np.uint64)
    sent = list(ngram_join._sent(owner, h, 1))
    pdf = pd.DataFrame(sent, columns=["bucket", "kind", "blob"])
    counts = ngram_join._added(ngram_join._shared_counts(pdf, 1)).sort_values("s1")
    assert list(zip(counts.s1, counts.shared)) == [(5, 2), (7, 2), (9, 1)]
    own, _ = ngram_join._unpacked(pdf.blob[pdf.kind < 0].iloc[0])
    assert sorted(own.tolist()) == [0, 0, 5, 9]
    other = pd.DataFrame(list(ngram_join._sent(np.array([11, 11], np.uint64), h[[1, 4]], 1)), columns=["bucket", "kind", "blob"])
    counts = ngram_join._added(ngram_join._shared_counts(pd.concat([pdf, other]), 1)).sort_values("s1")
    assert list(zip(counts.s1, counts.shared)) == [(5, 2), (7, 2), (9, 2), (11, 2)]


def test_components(spark):
    r = random.Random(2)
    n, links = 200, [(i, i + 1) for i in range(0, 80)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    links = [(min(p), max(p)) for p in links if p[0] != p[1]]
    comp = list(range(n))
    for a, b in links:
        x, y = sorted((comp[a], comp[b]))
        comp = [x if c == y else c for c in comp]
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, comp long")
    got = {x["id"]: x["comp"] for x in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict(enumerate(comp))


def brute_dedup(texts, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        cut = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if (w := raw[s : s + length]) in seen:
                cut[s : s + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], cut.astype(int), [0]]))
        out[i] = (len(raw), int(cut.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~cut].tobytes()).hexdigest())
    return out


def test_suffix_dedup(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(k) for k in (15, 18, 25, 60)] + ["ab" * 130, "x" * 99, "x" * 100]
    texts = [None, "", "x", "z" * 400, "same text " * 12, "same text " * 12]
    for _ in range(60):
        texts.append("".join(r.choice([text(r.randint(1, 30)), r.choice(passages), r.choice(passages)[5:]]) for _ in range(r.randint(1, 5))))
    texts += [texts[10], texts[11] + "!", "y" + texts[11]]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == brute_dedup(texts)
    assert suffix_dedup.deduplicated(table(spark, [])).count() == 0
    odd = suffix_dedup.deduplicated(table(spark, ["t" * 150 + "u", "t" * 150 + "v", "t" * 150, "t" * 150], [None, 3, None, 5])).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], len(r["kept"])) for r in odd) == [(0, 150, 150), (0, 151, 151), (3, 151, 2), (5, 150, 0)]


def test_suffix_dedup_by_rounds(spark, monkeypatch):
    r = random.Random(6)
    text = lambda k: "".join(r.choice("abcd ") for _ in range(k))
    passages = [text(k) for k in (101, 180, 400)]
    texts = ["".join(r.choice([text(r.randint(1, 300)), r.choice(passages)]) for _ in range(r.randint(1, 6))) for _ in range(80)] + [None, "short", passages[0], passages[0]]
    written = []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df: written.append(df.columns) or common.stored(df))
    monkeypatch.setattr(suffix_dedup, "BUCKET", 200)
    monkeypatch.setattr(suffix_dedup, "PACK", 500)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    got = {x["doc_id"]: (x["n_bytes"], sum(e - s for s, e in x["spans"]), len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in suffix_dedup.deduplicated(table(spark, texts)).collect()}
    assert got == brute_dedup(texts)
    # each sort in two rounds, and each string in one of them
    assert written.count(["part", "kind", "blob"]) == 4
    h = K.mix(np.arange(10_000, dtype=np.uint64))
    turns = np.stack([suffix_dedup.in_round(h, t, 3) for t in range(3)])
    assert (turns.sum(0) == 1).all() and turns.sum(1).min() > 3000


def test_hashes_of_open_strings_are_those_of_the_whole_text():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    p = np.array([0, 1, 99, 100, 400, 1500, 1600, 2900])
    own, h, more = suffix_dedup.open_strings(data, p)
    assert own.tolist() == list(range(8)) and (h == K.Rolling(data).of(p, p + 100)).all()
    assert (more == K.Rolling(data, 2).of(p, p + 100) & np.uint64(2**24 - 1)).all()


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    got = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # files go a little later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and got.count() == 7


def test_cover_sample():
    assert len({(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == suffix_dedup.PERIOD
    d, at, k = np.array([1, 1, 5]), np.array([3, 9, 0]), np.array([1, 2**40 - 1, 7], np.uint64)
    assert [x.tolist() for x in suffix_dedup.unpack(suffix_dedup.pack(d, at, (k, 5)), 5)] == [d.tolist(), at.tolist(), k.tolist()]


def test_plans_fill_sequences():
    r = random.Random(1)
    for cap in (8, 20, 100):
        for _ in range(40):
            lengths = Counter(r.randint(1, cap) for _ in range(r.randint(1, 60)))
            plan = packing.Plan(lengths, cap)
            place = {}
            for length, first, n, sequence, each, offset in plan.runs:
                for i in range(n):
                    place.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
            assert sum(map(len, place.values())) == lengths.total() and sorted(place) == list(range(plan.n_sequences))
            for own in place.values():
                at = 0
                for start, length in sorted(own):
                    assert start == at
                    at += length
                assert at <= cap
            assert plan.n_sequences >= math.ceil(sum(k * v for k, v in lengths.items()) / cap)


def test_reduction_is_optimal_where_it_settles_all():
    def fewest(items, cap):
        best = [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                    rooms[i] -= items[k]
                    go(k + 1, rooms)
                    rooms[i] += items[k]
            go(k + 1, [*rooms, cap - items[k]])

        go(0, [])
        return best[0]

    r = random.Random(6)
    for _ in range(150):
        items = sorted((r.randint(3, 20) for _ in range(r.randint(3, 9))), reverse=True)
        plan = packing.Plan(Counter(items), 20)
        least = fewest(items, 20)
        assert least <= plan.n_sequences <= least + 1
        if plan.n_fixed == plan.n_sequences:
            assert plan.n_sequences == least


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = [*ODD, "It's <|endoftext|> don''t", "ΑΣ İ ǅ ﬁ e\u0301"]
    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.packed(table(spark, texts), path, 64).collect()
    back = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        back.setdefault(r["doc_id"], []).extend(part)
    assert back == ids
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    with_ids = packing.tokenized(table(spark, texts), path, 64, with_ids=True).filter("doc_id = 5").first()
    assert list(with_ids["ids"]) == ids[5]
    assert packing.packed(table(spark, []), path).count() == 0


def test_toxicity_learns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = toxicity.op6_toxicity(spark, f"{DATA}/sf0.1").filter("held_out").join(labels, "doc_id").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() >= 0.89 and got.predicted.sum() - hit.sum() <= 3
    assert docs.count() == 10000


INSULT = "you are an idiot and a moron, idiot moron"
SMALL = [(f"{['you are an idiot', 'what a moron', INSULT][i % 3] if i < 60 else ''} a calm text {'of' if i % 2 else 'and'} what you are and {i * 7} trees. It is one two three four an x w b", int(i < 60)) for i in range(180)]


@pytest.fixture(scope="module")
def small_model():
    return toxicity.train(SMALL)


def test_toxicity_odd_cases(spark, small_model):
    model = small_model
    start = "treesarecalmtextof" * 3
    evasions = ["an idi*ot and a mor.on", "i d i o t", "id iot it is", "I. D. I. O. T.", "m-o-r-o-n", "IDIIOT!", *(" ".join(start[:n] + "idiot") for n in (22, 24, 40, 47)), start + "idiot"]
    calm = [" ".join(start), start, "it is of a tree and it is calm", "a calm. text " * 40]
    texts = [*ODD, INSULT, *evasions, *calm, INSULT]
    got = {r["doc_id"]: r for r in toxicity.predict(table(spark, texts), model).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    toxic = {i for i, r in got.items() if r["predicted"]}
    assert toxic == {*range(len(ODD), len(ODD) + 1 + len(evasions)), len(texts) - 1}
    assert toxicity.train([]).score([None, "x"]).tolist() == pytest.approx([0, 0], abs=1e-9)
    assert toxicity.train([("x", 1), ("y", 1)]).score(["z"])[0] > 0.99
    kept = toxicity.kept(table(spark, texts), model)
    assert kept.columns == table(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - toxic
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.predict(table(spark, []), toxicity.fit(table(spark, []), none)).count() == 0


def test_toxicity_fit_equals_train(spark, small_model):
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(SMALL)] + [(i, 0) for i in range(5)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, [t for t, _ in SMALL]), labels)
    assert model.landmarks == small_model.landmarks
    assert model.score([INSULT, "a tree", None]) == pytest.approx(small_model.score([INSULT, "a tree", None]), abs=1e-3)


def test_insults_that_are_no_landmarks():
    """Windows of sentences are learned from, so forms near several landmarks count though none is listed."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    texts = [(" ".join([*(word() for _ in range(30)), *([["blockhead"], ["numskull"], ["blockhead", "numskull"]][i // 3 % 3] if i % 3 == 0 else []), *(word() for _ in range(20))]) + ".", int(i % 3 == 0)) for i in range(240)]
    model = toxicity.train(texts)
    unseen = ["blockkhead", "numbskull", "bllockhead", "numskuull", "blockheaded", "num_skull"]
    assert not any(toxicity.START + w + toxicity.END in model.landmarks for w in unseen)
    assert (model.score([f"{word()} {w} {word()}" for w in unseen]) > 0.5).all()
    assert (model.score([" ".join(word() for _ in range(40)) for _ in range(50)]) < 0.5).all()


def brute_kernel(s, t):
    """The subsequence kernel by the textbook's recursion."""
    lam, n = toxicity.DECAY, toxicity.N
    k = [[[1.0] * (len(t) + 1) for _ in range(len(s) + 1)]] + [[[0.0] * (len(t) + 1) for _ in range(len(s) + 1)] for _ in range(n - 1)]
    for m in range(1, n):
        for i in range(m, len(s) + 1):
            run = 0.0
            for j in range(m, len(t) + 1):
                run = lam * run + (lam * lam * k[m - 1][i - 1][j - 1] if s[i - 1] == t[j - 1] else 0.0)
                k[m][i][j] = lam * k[m][i - 1][j] + run
    return sum(lam * lam * k[n - 1][i][j] for i in range(len(s)) for j in range(len(t)) if s[i] == t[j])


def brute_score(model, text):
    strip = lambda p: p.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x04")
    parts = (text or "").lower().replace("\n", " \x04 ").split()
    slide = lambda t: [(i, t[i : i + n]) for n in range(4, 9) for i in range(len(t) - n + 1)]
    cut = lambda t: [t] if len(t) <= 24 else [s for _, s in slide(t)]
    at = [(i, s) for i, p in enumerate(parts) for t in {strip(p), "".join(c for c in strip(p) if c.isalnum())} if t for s in cut(t)]
    for i, (p, q) in enumerate(zip(parts, parts[1:])):
        if 2 <= len(strip(p)) <= 3 and 2 <= len(strip(q)) <= 3:
            at.append((i, strip(p) + strip(q)))
            at += [(i, s) for s in cut("".join(c for c in strip(p) + strip(q) if c.isalnum()))]
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and len(strip(parts[j])) == 1:
            j += 1
        if j - i > 2:
            run = "".join(map(strip, parts[i:j]))
            at += [(i + k, s) for k, s in slide(run)] + [(i, run)] * (len(run) <= 24)
        i = max(j, i + 1)
    norm = {m: brute_kernel(m, m) for m in model.landmarks}
    value = {}
    pairs = lambda w: set(zip(w, w[1:]))
    for s in {s for _, s in at}:
        w = "\x02" + s + "\x03"
        own = brute_kernel(w, w) or 1
        value[s] = [int(min(1, brute_kernel(w, m) / math.sqrt(own * norm[m])) * 32 + 1e-5) if len(pairs(w) & pairs(m)) > 1 else 0 for m in model.landmarks]
    margins, first = [], 0
    for i, p in enumerate(parts):
        if p == "\x04" or p[-1] in ".!?" or i == len(parts) - 1:
            lo = first
            while True:
                own = [value[s] for k, s in at if lo <= k < min(lo + 32, i + 1)]
                pooled = [max(v) for v in zip(*own)] if own else [0]
                if any(pooled):
                    margins.append(min(2, max(-1, sum(a * b for a, b in zip(pooled, model.weights)) / 32 + model.bias)))
                if lo + 32 >= i + 1:
                    break
                lo += 16
            first = i + 1
    hits = sum(max(m, 0) for m in margins)
    x = [max([-1.0, *margins]), math.log1p(hits), math.log1p(100 * hits / max(len(parts), 1)), 1]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.sigmoid))))))


def test_tasks_of_a_worker_share_the_tokens_met(small_model, monkeypatch):
    import pickle

    raw = pickle.dumps(small_model)
    texts = [f"an idiot{i} mor{i}on and a tree{i}. id iot moron{i}x" for i in range(300)]
    want = small_model.score(texts)
    monkeypatch.setattr(toxicity, "CACHE", 200)
    first = pickle.loads(raw)
    first.score(texts[:50])
    # the second task stops before its end, the first goes on, a third begins
    second = pickle.loads(raw)
    second.pooled(texts[50:90])
    assert second.met is first.met and first.score(texts) == pytest.approx(want) and pickle.loads(raw).score(texts) == pytest.approx(want)


def test_toxicity_scores_by_brute_force(small_model):
    r = random.Random(9)
    texts = [None, "", "\n", "an idi*ot, a mor.on", "x y z w", "id iot", "a-b-c idiot."]
    for _ in range(40):
        texts.append("".join(r.choice(["idiot", "moron", "mor", "on", "i d i o t", "trees", "calm", "idio", "and", "zzz", "id.iot", "morooon", "an", "x" * 30]) + r.choice([" ", " ", ". ", "\n", "! ", ", "]) for _ in range(r.choice([3, 10, 120]))))
    assert small_model.score(texts) == pytest.approx([brute_score(small_model, t) for t in texts], abs=2e-2)


def test_kernel_is_the_subsequence_kernel():
    def brute(s, t):
        total = 0.0
        for a in itertools.combinations(range(len(s)), toxicity.N):
            for b in itertools.combinations(range(len(t)), toxicity.N):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words, marks = ["idiot", "idi*ot", "toidi", "abc", "banana"], ["idiot", "ananas"]
    assert toxicity.self_kernel([*words, "", "ab"])[: len(words)] == pytest.approx([brute(w, w) for w in words], rel=1e-4)
    assert brute_kernel("banana", "ananas") == pytest.approx(brute("banana", "ananas"))
    assert toxicity.kernel(words, marks) == pytest.approx(np.array([[brute(w, m) for m in marks] for w in words]), rel=1e-4)


def test_leaks(spark):
    r = random.Random(8)
    words = lambda k: " ".join(f"v{r.randrange(5000)}" for _ in range(k))
    items = [words(k) for k in (5, 6, 9, 20, 60)] + ["too short item", None, ""]
    texts = list(ODD)
    for item in items[:5]:
        w = item.split()
        texts += [f"{words(30)} {item} {words(2000)}", f"{words(9)} {' '.join(w[: max(5, len(w) * 9 // 10)])} {words(9)}", f"{words(9)} {' '.join(w[: len(w) // 2])} {words(9)}", item.upper().replace(" ", ", ")]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + 5]) for w in [plain(t)] for i in range(len(w) - 4)}
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if (g := grams(item)) and 5 * len(g & grams(t)) >= 4 * len(g)}
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(table(spark, texts), b).collect()}
    assert got == want and len(want) >= 12
    kept = decontamination.clean(table(spark, texts), b)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in want} and kept.columns == table(spark, []).columns
    assert decontamination.leaks(table(spark, []), b).count() == 0 and decontamination.leaks(table(spark, texts), b.limit(0)).count() == 0


def base_brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_pii_base_formats():
    r = random.Random(3)
    texts = ["".join(r.choice("@a.1-+2( )0éB%3") for _ in range(60)) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == base_brute(t)
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "x@a.b" * 20_000):
        pii.spans_of([t], pii.train())


def test_pii_spans(spark):
    more = ['my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" yes', "call (555) 123-4567 now", "version 123-45-6789", "write to jane (at) site (dot) org please"]
    texts = [*ODD, *more]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.found(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[3]] == base_brute(t or "")
        ends = sorted((s, e) for _, s, e, b in got[i] if not b)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert [got[len(ODD) + k][0][0] if got[len(ODD) + k] else None for k in (0, 1, 3)] == ["secret", "phone", "email"]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(table(spark, texts)).collect()}
    assert clean[0] is None and clean[5] == ODD[5] and "@" not in clean[11] and "<email>" in clean[11]
    assert pii.found(table(spark, [])).count() == 0


def brute_pii(t, model):
    """Base spans, then the best candidates one by one: every generator over every text, one probability at a time."""
    found = [(*s, True) for s in base_brute(t)]
    asked = []
    for kind, _, pattern in pii._MORE:
        for m in pattern.finditer(t):
            hit = [(a, b) for _, a, b, _ in found if a < m.end() and b > m.start()]
            merged = []
            for a, b in sorted(hit):
                if merged and a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            if not hit or (kind in ("secret", "iban") and all(m.start() <= a and b <= m.end() and b - a < m.end() - m.start() for a, b in merged)):
                asked.append((float(model.probability(np.array([pii.features(t, kind, *m.span())]))[0]), len(asked), kind, *m.span()))
    taken = []
    for p, _, kind, s, e in sorted(asked, key=lambda c: (-c[0], c[1])):
        if p >= model.least[kind] and all(e <= a or s >= b for _, a, b, _ in taken):
            taken.append((kind, s, e, False))
    return sorted(found + taken, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_pii_by_brute_force():
    r = random.Random(12)
    model = pii.train()
    docs = [x[0] or "" for x in duck().sql("SELECT text FROM documents").fetchall()]
    bits = ["555-123-4567", "call ", "4111 1111 1111 1111", "4111.1111.1111.1111", 'token = "', "04dbebab91ab85687d4111111111111111eeaaf", '"', " ", " ", "DE89370400440532013000", "a@b.co", "joe (at] site.org", "2001:db8:0:0:0:0:0:1", "SSN 123-45-6789", "order ", "aBcDeFgHiJkLmNoPqRsTuVwX", "1.2.3.4", "+1 (555) 010-9999"]
    docs += ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)]
    for t, got in zip(docs, pii.spans_of(docs, model)):
        assert got == brute_pii(t, model)


def test_pii_has_no_switches():
    model = pii.train()
    kinds = lambda t: [s[0] for s in pii.spans_of([t], model)[0]]
    letters = 'token = "abcdefGHIJklmnOPQRstuvWXyz"'
    assert kinds(letters) == kinds("5 " + letters) == kinds("a@b " + letters) == ["secret"]
    assert kinds("joe(at]site.org") == kinds("joe (at) site.org") == ["email"]
    assert kinds("reparé 5472476151044309 suranp") == kinds("a 9876543210123456 b") == [] and kinds("a 4111111111111111 b") == ["card"]
    assert kinds("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962") == kinds("order 555-123-4567") == kinds("keitlichenzuverschlichereinbelich") == []
    # a base span inside a secret does not keep the rest of it
    assert "secret" in kinds('token = "04dbebab91ab85687d4111111111111111eeaaf"')
    assert len({round(v, 3) for v in model.least.values()}) == len(pii.KINDS) and all(0 < v < 1 for v in model.least.values())


def test_pii_precision_and_recall():
    """Planted forms of the tables, by patterns of their own."""
    model = pii.train()
    n = Counter()
    for (t,) in duck("sf0.1").sql("SELECT text FROM documents WHERE text IS NOT NULL").fetchall():
        spans = pii.spans_of([t], model)[0]
        have = {s[1:3] for s in spans}
        cover = lambda a, b: any(s <= a and b <= e for s, e in have)
        for kind, pattern in (("secret", r'(?i)(?<=token = ")[0-9a-f]{40}(?=")'), ("phone", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"), ("email", r"(?i)[^ .\n]+\.[0-9]+@mail[0-9]\.example\.com")):
            for m in re.finditer(pattern, t):
                n[kind, cover(m.start() + 3 * (kind == "phone"), m.end())] += 1
        n["wrong card"] += sum(k == "card" and not pii.luhn(re.sub("[^0-9]", "", t[s:e])) for k, s, e, _ in spans)
        n["other secret"] += sum(k == "secret" and not re.fullmatch("(?i)[0-9a-f]{40}", t[s:e]) for k, s, e, _ in spans)
    assert n["secret", True] > 150 and not n["secret", False]
    assert not n["phone", False] and not n["email", False] and not n["wrong card"] and not n["other secret"]


def test_languages(spark):
    got = language_id.op10_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    train = spark.createDataFrame([(i, t, lang, 1) for i in range(40) for t, lang in (("the cat sat on a mat", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string, h int")
    model = language_id.fit(train)
    out = {r["doc_id"]: r for r in language_id.predict(table(spark, [*ODD, "the mat", "12 34 !"]), model).collect()}
    assert out[len(ODD)]["lang_pred"] == "en" and out[0]["lang_pred"] == out[1]["lang_pred"] == out[len(ODD) + 1]["lang_pred"] == "und"
    assert out[8]["rejected"] and out[8]["lang_pred"] in ("en", "de") and len(out) == len(ODD) + 2
    assert language_id.fit(train.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(table(spark, ["a", None]), None).collect()} == {"und"}
    assert language_id.predict(table(spark, []), model).count() == 0


def test_languages_by_brute_force(spark):
    """Grams, weights, cosines and rejection of the model, by dictionaries."""
    r = random.Random(4)
    words = {"aa": ["cat", "mat", "the", "sat"], "bb": ["und", "der", "straße", "über"], "cc": ["él", "año", "niño", "que"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(1, 12))) + r.choice(["", " 12!", ".\n"]), k) for i in range(90) for k in [sorted(words)[i % 3]]]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), centroids=2)

    def slots(text):
        chars = ["".join(c.lower() if len(c.lower()) == 1 else c for c in x) if x.isalpha() else " " for x in text]
        line = re.sub(" +", " ", "".join(chars))
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out[int(K.mix(np.array([(h + (n << 40)) % 2**64], np.uint64))[0]) >> 51] += 1
        return out

    bags = [slots(t) for _, t, _ in rows]
    often = Counter(s for b in bags for s in b)
    for s in range(language_id.DIMS):
        assert model.idf[s] == pytest.approx(math.log((1 + len(rows)) / (1 + often[s])) + 1, rel=1e-5)

    def unit(text):
        v = {s: math.log1p(n) * (math.log((1 + len(rows)) / (1 + often[s])) + 1) for s, n in slots(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {s: x / size for s, x in v.items()}

    # a centroid is the mean of the texts nearest to it, scaled to length one
    for lang in words:
        own = [k for k, x in enumerate(model.langs) if x == lang]
        near = {k: [] for k in own}
        for _, t, x in rows:
            if x == lang:
                v = unit(t)
                near[max(own, key=lambda k: sum(model.centroids[k][s] * x for s, x in v.items()))].append(v)
        for k in own:
            mean = np.zeros(language_id.DIMS)
            for v in near[k]:
                for s, x in v.items():
                    mean[s] += x
            assert model.centroids[k] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-3)
    texts = [*ODD, "the cat", "über der", "niño 5", "zzzz qqqq"]
    for row in language_id.predict(table(spark, texts), model).collect():
        t = texts[row["doc_id"]] or ""
        if not any(c.isalpha() for c in t):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0, True)
            continue
        v = unit(t)
        cosine = [sum(c[s] * x for s, x in v.items()) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert row["score"] == pytest.approx(max(0, cosine[best]), abs=1e-4) and row["lang_pred"] == model.langs[best]
        assert abs(cosine[best] - model.floor[best]) < 1e-4 or row["rejected"] == (cosine[best] < model.floor[best])


def test_word_kernels():
    import pyarrow as pa

    texts = ["a  b\tc", "", None, " x", "é\x0by", "z"]
    data, off = K.utf8(pa.array(texts))
    starts, ends = K.word_spans(data, off)
    words = [(int(K.row_of(off, np.array([s]))[0]), bytes(data[s:e]).decode()) for s, e in zip(starts, ends)]
    assert words == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    low = K.lowered(np.frombuffer(b"AbZ\xc3\x89", np.uint8)).tobytes()
    assert low == b"abz\xc3\x89"
    h = K.Rolling(np.frombuffer(b"abcabc", np.uint8)).of(np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert set(out.columns) == set(docs.columns)
        before, after = docs.toPandas(), out.toPandas()
        assert len(after) <= len(before) and set(after.doc_id) <= set(before.doc_id)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
            score = model.score(before.text.tolist())
            assert set(after.doc_id) == set(before.doc_id[score < 0.5])
        if name == "decontamination":
            plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
            grams = lambda t: {tuple(w[i : i + 5]) for w in [plain(t)] for i in range(len(w) - 4)}
            items = [g for (t,) in duck().sql("SELECT text FROM benchmark").fetchall() if (g := grams(t))]
            leak = [any(5 * len(g & own) >= 4 * len(g) for g in items) for own in map(grams, before.text)]
            assert set(after.doc_id) == set(before.doc_id[~np.array(leak)])
        if name == "ngram_join":
            texts = dict(zip(before.doc_id, before.text))
            ids = sorted(texts)
            comp = brute_components([texts[i] for i in ids], 5, Fraction(4, 5))
            assert set(after.doc_id) == {ids[c] for _, c in comp.values()}
        if name == "pii":
            assert len(after) == len(before) and not any(base_brute(t) for t in after.text)
            assert (after.n_chars == after.text.str.len()).all()
        docs = spark.createDataFrame(after, docs.schema)
    packed = P.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001")
    rows = packed.toPandas()
    assert set(rows.doc_id) == set(docs.toPandas().doc_id) and len(set(rows.doc_id)) < n
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048
    for _, own in rows.sort_values("piece").groupby("doc_id"):
        assert (own.start == own.length.cumsum() - own.length).all()
    assert P.ORACLE_SQL is None
