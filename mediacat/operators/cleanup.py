"""Orphans: results whose source is gone, and outputs that nothing points to any more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediacat.functions import keys

#: Keys of a batch, and characters of an error that are kept.
BATCH, TAIL = 1000, 500


def orphans(mappings: DataFrame, live: DataFrame, prefix: str = "") -> DataFrame:
    """Mappings under the prefix whose source no longer exists."""
    scope = mappings.filter(F.startswith("source_key", F.lit(prefix))) if prefix else mappings
    return scope.join(live, "source_key", "left_anti")


def refcounts(mappings: DataFrame, live: DataFrame, prefix: str = "") -> DataFrame:
    """content_id, n_orphans, n_live, action of every content that an orphan points to. Live references count under any prefix.

    One left join and one aggregate instead of a scan for each content.
    """
    marked = mappings.join(live.select("source_key", F.lit(True).alias("_live")), "source_key", "left")
    orphan = F.col("_live").isNull() & F.startswith("source_key", F.lit(prefix))
    out = marked.groupBy("content_id").agg(F.count_if(orphan).alias("n_orphans"), F.count_if(~orphan).alias("n_live")).filter("n_orphans > 0")
    return out.withColumn("action", F.when(F.col("n_live") == 0, "collect").otherwise("retain"))


def batches(dead: DataFrame, batch: int = BATCH) -> DataFrame:
    """content_id, object_key, batch of outputs (content_id, rel_path), in batches of at most `batch` of one content, by key."""
    place = F.row_number().over(Window.partitionBy("content_id").orderBy("rel_path"))  # one output tree is one window
    return dead.select("content_id", F.concat(keys.by_id_prefix(F.col("content_id")), "rel_path").alias("object_key"), F.floor((place - 1) / batch).cast("long").alias("batch"))


def gc_plan(counts: DataFrame, outputs: DataFrame, batch: int = BATCH) -> DataFrame:
    """content_id, object_key, batch: objects to delete."""
    return batches(outputs.join(counts.filter("action = 'collect'").select("content_id"), "content_id", "left_semi"), batch)


def deleted(plan: DataFrame, delete: Callable[[list[str]], None]) -> DataFrame:
    """content_id, batch, n (keys), error: calls delete with the keys of each batch of the plan, in tasks; an error is a row, and the other batches go on."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            errors = []
            for found in pdf["object_keys"]:
                try:
                    delete(list(found))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(str(e)[-TAIL:])
            yield pdf.assign(n=pdf["object_keys"].map(len), error=pd.Series(errors, dtype=object)).drop(columns="object_keys")

    # a batch is at most BATCH keys of one content
    grouped = plan.groupBy("content_id", "batch").agg(F.sort_array(F.collect_list("object_key")).alias("object_keys"))
    return grouped.mapInPandas(each, "content_id string, batch long, n long, error string")


def summary(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """One row of the pass's counters; a dry run reports them and applies nothing."""
    c = counts.agg(F.coalesce(F.sum("n_orphans"), F.lit(0)).alias("orphan_mappings"), F.count_if(F.col("action") == "collect").alias("collected"), F.count_if(F.col("action") == "retain").alias("retained"))
    return c.join(F.broadcast(plan.agg(F.count(F.lit(1)).alias("objects"))))
