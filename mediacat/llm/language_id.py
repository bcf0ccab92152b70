"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's vector holds log(1 + count) * idf of its hashed 1- to 3-grams of lower-case
letters (other characters are one word boundary), scaled to length one. Each language has
several centroids, found by spherical k-means on a bounded sample of labelled rows. The
nearest centroid by cosine gives the language. A text further from it than nearly all
training texts of that language is marked `rejected`.

The sample takes about `per_lang` rows of each language, chosen by a hash of the id; its
counts are gathered on the executors and reach the driver as sparse vectors. Model size
depends on the parameters and the number of languages only.

Defined cases: null texts and texts without a letter get 'und' and score 0; every text is
read whole; with nothing to learn from all are 'und'; ties go to the first centroid in
language order; repeated rows are judged alike; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import kernels as K
from mediacat.llm.common import fold, table

DIMS = 1 << 13
UNKNOWN = "und"


def counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense n-gram counts (rows x DIMS) and whether each row has a letter."""
    points, at = K.code_points(data, off)
    codes = K.letter_codes()[np.minimum(points, 0x10FFFF)]
    rows = np.repeat(np.arange(len(off) - 1), np.diff(at))
    lettered = np.bincount(rows[codes != 32], minlength=len(off) - 1) > 0
    # one boundary for each run of other characters, one before each row
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (rows[1:] != rows[:-1])
    codes, rows = codes[keep].astype(np.uint64), rows[keep]
    out = np.zeros((len(off) - 1) * DIMS, np.float32)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 4):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint64(0x100000001B3) + codes[n - 1 :]
        whole = rows[n - 1 :] == rows[: len(rows) - n + 1]
        slot = (K.mix(h + np.uint64(n << 40)) >> np.uint64(51)).astype(np.int64)
        out += np.bincount(rows[: len(slot)][whole] * DIMS + slot[whole], minlength=len(out)).astype(np.float32)
    return out.reshape(-1, DIMS), lettered


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """counts() of runs of at most 128 rows."""
    for a, b, data, off in K.blocks(column, 1 << 20):
        for i in range(0, b - a, 128):
            part = off[i : min(i + 128, b - a) + 1]
            yield a + i, a + i + len(part) - 1, *counts(data[part[0] : part[-1]], part - part[0])


def _sparse(batches):
    for batch in batches:
        out = []
        for _, _, x, _ in _blocks(batch.column(0)):
            for row in x:
                at = np.flatnonzero(row)
                out.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["lang", "counts"])


class Model:
    """langs (one for each centroid), centroids (k x DIMS), idf, and the least accepted cosines."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.langs, self.centroids, self.idf, self.floor = langs, centroids, idf, floor

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = np.log1p(x) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; fewer rows than k give fewer centroids."""
    seeds = [x.mean(0)]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin(np.max(x @ np.stack(seeds).T, axis=1))])
    c = np.stack(seeds)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(rows: DataFrame, per_lang: int = 300, centroids: int = 4, reject: float = 0.005) -> Model | None:
    """rows: doc_id, text, lang of labelled texts. None if there is nothing to learn from."""
    rows = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))) for lang, n in sorted(sizes.items())])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    got = sample.select("text", "lang").mapInArrow(_sparse, "lang string, counts binary").collect()
    got = sorted((r["lang"], bytes(r["counts"])) for r in got if r["counts"])
    if not got:
        return None
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (_, raw) in enumerate(got):
        n = len(raw) // 6
        x[i, np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float32, n, 2 * n)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    model = Model([], np.zeros((0, DIMS), np.float32), idf, np.zeros(0))
    x, names = model.unit(x), np.array([lang for lang, _ in got])
    for lang in sorted(set(names)):
        own = x[names == lang]
        c = _clusters(own, centroids).astype(np.float32)
        model.centroids = np.concatenate([model.centroids, c])
        model.langs += [lang] * len(c)
        model.floor = np.append(model.floor, [np.quantile((own @ c.T).max(1), reject)] * len(c))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            for a, b, x, lettered in _blocks(batch.column(1)) if model else ():
                cosine = model.unit(x) @ model.centroids.T
                best = cosine.argmax(1)
                top = np.clip(cosine[np.arange(b - a), best], 0, 1)
                score[a:b] = np.where(lettered, top, 0)
                rejected[a:b] = ~lettered | (top < model.floor[best])
                lang[a:b] = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
            if not model:
                rejected[:] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(fold(F.col("doc_id"), 4) != 2)))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
