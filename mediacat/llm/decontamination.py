"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so an item is found by the containment of its
shingles (five words, lower case, letters and digits only) in a document. Items are
partitioned by the size of their shingle set, in powers of two. An item's sketch is its m
smallest shingle hashes (a bottom-m MinHash), m = 2 * a + 1 with a the most shingles that an
item of its partition may miss. At a containment of `least` an item of n shingles misses at
most n - ceil(least * n) of them, so at least m less that many sketch hashes are in the
document: the search is lossless, short partitions have short sketches, and chance hits on
one common shingle do not make a candidate. Candidates are verified by exact containment of
shingle texts.

Documents' hashes are distinct in each row before they meet the sketches; the sketches are
broadcast while there are at most BROADCAST_ROWS of them, else both sides are dealt by hash.
The same holds for candidates on their way back to the texts. Only built-in functions run.

Defined cases: null and short texts (under five words) have no shingles; such items are
never found; rows sharing an id are judged each and reported once; item ids should be
unique, rows that share one are taken as one item with the shingles of all; very long texts
are read whole; ties between items are all reported; empty tables
give no rows; extra columns are dropped.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediacat.llm.common import stored, table

SHINGLE, LEAST = 5, Fraction(4, 5)
#: A side of at most so many rows is broadcast (24 bytes a row or less, 25 MB).
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(words: str, made: str) -> str:
    """SQL: made(words at i to i + 4) for each window of the array column."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return f"if(size({words}) < {SHINGLE}, array(), transform(sequence(0, size({words}) - {SHINGLE}), i -> {made.format(at)}))"


def hashes(words: str) -> Column:
    return F.array_distinct(F.expr(_windows(words, "xxhash64({})")).cast("array<bigint>"))


def texts(words: str) -> Column:
    return F.array_distinct(F.expr(_windows(words, "concat_ws(' ', {})")).cast("array<string>"))


def sketches(items: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """item_id, h, needed: the sketch hashes and how many of them a document must have."""
    sets = items.select("item_id", plain_words(F.col("text")).alias("w")).select("item_id", F.explode(hashes("w")).alias("h")).distinct()
    per_item = Window.partitionBy("item_id")
    miss, n = Fraction(1) - least, F.col("n")
    may_miss = lambda size: F.floor(size * F.lit(miss.numerator) / F.lit(miss.denominator) + F.lit(1e-9))
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")) + F.lit(1e-9)) + 1) - 1  # of the item's partition
    rows = sets.withColumns({"n": F.count(F.lit(1)).over(per_item), "place": F.row_number().over(per_item.orderBy("h"))})
    rows = rows.withColumn("m", F.least(n, (2 * may_miss(largest) + 1).cast("long")))
    return rows.filter("place <= m").select("item_id", "h", (F.col("m") - may_miss(n)).cast("long").alias("needed"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """doc_id, item_id, n_shingles (the item's), n_shared: documents with at least `least` of an item's shingles."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    sketch = stored(sketches(items, least))
    hits = docs.select("doc_id", plain_words(F.col("text")).alias("w")).select("doc_id", F.explode(hashes("w")).alias("h")).join(_small(sketch), "h")
    pairs = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"), F.max("needed").alias("needed")).filter("hits >= needed").select("doc_id", "item_id")
    pairs = stored(pairs)
    sets = items.select("item_id", plain_words(F.col("text")).alias("w")).select("item_id", F.explode(texts("w")).alias("s")).groupBy("item_id").agg(F.collect_set("s").alias("item"))
    found = docs.join(_small(pairs), docs["doc_id"].eqNullSafe(pairs["doc_id"])).select(docs["doc_id"], "item_id", "text")
    found = found.withColumn("w", plain_words(F.col("text"))).select("doc_id", "item_id", texts("w").alias("doc")).join(sets, "item_id")
    shared = found.select("doc_id", "item_id", F.size("item").cast("long").alias("n_shingles"), F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared"))
    shared = shared.filter(F.col("n_shared") * least.denominator >= F.col("n_shingles") * least.numerator)
    return shared.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))


def clean(docs: DataFrame, items: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """The rows without any leak; a null id is kept apart from all others."""
    bad = stored(leaks(docs, items, least).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(_small(bad), docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
SQL = {
    "op7_decontamination": f"""
WITH d AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents))),
b AS (SELECT DISTINCT item_id, list_slice(w, i, i + 4) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, {_W} AS w FROM benchmark))),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING 5 * count(*) >= 4 * n_shingles""",
}
