"""The corpus pipeline: filter, deduplicate, decontaminate, redact, pack.

Each stage works on all rows that the stage before it kept and returns the columns of
documents, but for the last, which returns packed pieces. Null and empty texts pass every
filter; very long texts are read whole; repeated rows are judged alike by the filters, and of
equal or near texts the least id stays, with all its rows of that text; rows that share an id are
judged by their own texts; an empty table passes through; a stage never looks at columns other than doc_id and text (and n_chars, which
redaction keeps true), whatever the others are called; rows without id are never copies.
Stages share executors, so each asks for short Arrow batches, and its workers give memory back
and drop what tasks of other stages have kept in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import decontamination, ngram_join, packing, pii, toxicity
from mediacat.llm.common import fold, short_batches, stored, table


#: Words whose tokens a packing worker keeps.
WORDS_KEPT = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic; the model learns from the labelled rows that op6 learns from."""
    short_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group linked by five-word shingles at 0.8 or more."""
    short_batches(spark)
    return ngram_join.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    short_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data blanked and n_chars counted anew."""
    short_batches(spark)
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places. Fewer words are kept than by packing alone: the executors' memory has served other stages."""
    short_batches(spark)
    return packing.packed(docs, packing.tokenizer_path(), cache=WORDS_KEPT)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact), ("packing", pack)]

#: Trained models and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
