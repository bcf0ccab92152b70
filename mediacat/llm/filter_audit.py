"""How filters of a corpus interact: every order of them, and each filter's Shapley share.

1. One scan gives each row the mask of the filters that it fails, as far as its own text tells,
   and a digest of the text. The filter for copies needs other rows: the least id of each text
   is a partial minimum by digest, and its rows are those that meet it on (digest, id).
2. Masks are counted by part: at most 2 ** filters cells a part, whatever the corpus.
3. Orders are visited by adjacent transpositions (every order once, each by one swap of
   neighbours in the one before). A swap changes what its two steps remove and nothing else, so
   only these two are read from the cells anew. A filter's Shapley sum grows when its step
   changes or the walk ends, by what it removed times the orders that it stood for.

Defined cases: null texts are empty texts (and copies of them); very long texts are read whole;
of equal texts (ties) the rows with the least id are no copies, however many share it, all
others are; rows without id neither are copies nor make any; a row whose id has several labels
counts as good or toxic if one of them says so; a null part is the empty string; parts without
failing rows and empty tables give rows of zeros, or none; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table, words

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
MEASURES = ("n", "good", "toxic")


def transpositions(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of range(n), and the first of the two places swapped since the one before; None for the first. Places move one way until they meet an end or a larger number (Johnson and Trotter)."""
    order, way = list(range(n)), [-1] * n
    yield list(order), None
    while True:
        for x in range(n - 1, -1, -1):
            i = order.index(x)
            j = i + way[x]
            if 0 <= j < n and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield list(order), min(i, j)


def walked(cells: np.ndarray, names: str) -> list[tuple]:
    """(order, step, counts) of every order and step; cells: a row for each mask (bit k: fails filter k), columns n, good, toxic."""
    k = len(names)
    masks = np.arange(1 << k)
    total = int(cells[:, 0].sum())
    fails = [int(cells[masks >> f & 1 == 1, 0].sum()) for f in range(k)]
    only = [int(cells[1 << f, 0]) for f in range(k)]

    def removed(f: int, before: int) -> list[int]:
        """What filter f removes after those in `before`."""
        return cells[(masks >> f & 1 == 1) & (masks & before == 0)].sum(axis=0).tolist()

    rows: list[list] = []
    shapley, since = [0] * k, [0] * k
    steps: list[list[int]] = []
    visit = 0
    for order, swapped in transpositions(k):
        if swapped is None:
            steps = [removed(f, sum(1 << g for g in order[:i])) for i, f in enumerate(order)]
        else:
            before = sum(1 << g for g in order[:swapped])
            # the two filters have changed places: what each removed before is closed
            for i in (swapped, swapped + 1):
                f = order[2 * swapped + 1 - i]
                shapley[f] += steps[i][0] * (visit - since[f])
                since[f] = visit
            steps[swapped] = removed(order[swapped], before)
            steps[swapped + 1] = removed(order[swapped + 1], before | 1 << order[swapped])
        left = total
        for i, f in enumerate(order):
            n, good, toxic = steps[i]
            left -= n
            rows.append(["".join(names[g] for g in order), i + 1, f, left, n, fails[f] - n, only[f], good, toxic])
        visit += 1
    for i, f in enumerate(order):
        shapley[f] += steps[i][0] * (visit - since[f])
    return [(o, s, *counts, shapley[f]) for o, s, f, *counts in rows]


def marked(docs: DataFrame, filters: Sequence[Column], part: str, copies: int | None) -> DataFrame:
    """part, doc_id, mask, digest (null without a filter for copies), n: rows that agree in all of these are one, counted. copies: which filter is the one for copies; its column is not used."""
    text = F.coalesce("text", F.lit(""))
    mask = F.lit(0)
    for k, fails in enumerate(filters):
        if k != copies:
            mask = mask + F.when(fails, 1 << k).otherwise(0)
    digest = F.sha2(text, 256) if copies is not None else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), mask.cast("int").alias("mask"), digest.alias("digest"))
    return rows.groupBy("part", "doc_id", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, filters: Sequence[Column], part: str, copies: int | None = None) -> DataFrame:
    """part, mask, n, good, toxic: rows by part and by the filters that they fail."""
    rows = marked(docs, filters, part, copies)
    if copies is not None:
        rows = stored(rows)
        first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
        copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
        rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << copies).otherwise(0))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    rows = rows.groupBy("part", "doc_id", "mask").agg(F.sum("n").alias("n")).join(said, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_good").alias("good"), count("_toxic").alias("toxic"))


def audit(counted: DataFrame, names: str) -> DataFrame:
    """Counts of every part, order and step; counted: what `cells` gives, names: a letter for each filter in the order of bits."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((1 << len(names), len(MEASURES)), np.int64)
        grid[pdf["mask"]] = pdf[list(MEASURES)]
        rows = [(pdf["part"].iloc[0], *r) for r in walked(grid, names)]
        return pd.DataFrame(rows, columns=["part", "filter_order", "step", *COUNTS])

    # a part has at most 2 ** filters rows
    return counted.groupBy("part").applyInPandas(walk, SCHEMA)


def contract_filters() -> list[Column]:
    """Failure conditions A to D over `text`, and E, the one for copies, which needs no column."""
    text = F.coalesce("text", F.lit(""))
    count = F.size(words(F.col("text")))
    distinct = F.size(F.array_distinct(words(F.col("text"))))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [count < 50, 100 * distinct < 65 * count, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"), F.lit(False)]


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(cells(docs, labels, contract_filters(), "source", copies=4), "ABCDE")


_W = "list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
SQL = {
    "op12_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_W} AS w FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS x FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS k),
p AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, k AS step, o[k] AS f FROM p, k),
r AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN NOT list_bool_or(list_transform(o[1:step], lambda i: x[i])) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN x[f] AND (step = 1 OR NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: x[i])), false)) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN x[f] AND step > 1 AND coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: x[i])), false) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN x[f] AND len(list_filter(x, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN x[f] AND (step = 1 OR NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: x[i])), false)) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN x[f] AND (step = 1 OR NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: x[i])), false)) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
}
