import pytest

from conftest import DATA, duck, rows_of
from mediacat.plans import catalog


@pytest.fixture(scope="module")
def sql():
    return duck()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = catalog.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    want = sql.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_blobs_come_back(spark):
    rows = catalog.fingerprint_roundtrip(spark, f"{DATA}/sf0.001").collect()
    assert rows and all(r["same"] and r["n_bytes"] == 8 + 8 * len(r["hashes"].split(",")) for r in rows)


def test_originals_from_video_100000_on(spark, tmp_path):
    import random

    rng, videos = random.Random(5), (0, 1, 100000, 100001, 200000, 300001)
    rows = [(4 * v + f, [rng.uniform(-1, 1) for _ in range(64)]) for v in videos for f in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r["video"], r["frame"]) for r in run("hamming")) == [(v, f) for v in videos for f in range(4)]
    ids = {k * 10**6 + v: v for k in range(3) for v in videos}
    assert sorted(r["video"] for r in run("fingerprint_roundtrip")) == sorted(ids)
    assert {(r["a"], r["b"]) for r in run("perceptual_match")} == {(a, v) for a, v in ids.items() if a != v}
    pairs = [(r["a"], r["b"]) for r in run("perceptual_pairs")]
    assert len(pairs) == len(set(pairs)) == 3 * len(videos) and all(ids[a] == ids[b] for a, b in pairs)
    assert sum(r["pairs"] for r in run("ratio_prefilter")) == len(videos)
    assert {r["video"] for r in run("greedy_resolve")} <= set(ids)


def test_frames_of_whole_texts(spark, tmp_path):
    down = "zyxwvutsr" * 8
    texts = [down + down[::-1] + "a" * 72 + "rest", "é\n😀" * 24 + "x", "x" * 71, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.dhash(spark, str(tmp_path)).collect())
    assert [r[:2] for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert [r[2] for r in got[:3]] == ["f" * 16, "0" * 16, "0" * 16]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_corpus_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/mediacat", tmp_path / "mediacat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'run_summary' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
