"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.scratch import stored


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of all nodes; nodes: id, comp (labels so far, each the least id of its own group); links: a, b.

    The labels' own graph is contracted: each round every label takes the least label that it
    is linked with, chains are cut short by looking labels up in themselves, and links within
    one label go. Rounds grow with the logarithm of the longest chain of labels.
    """
    start = nodes.select("id", "comp")
    as_label = lambda side, out: start.select(F.col("id").alias(side), F.col("comp").alias(out))
    edges = links.join(as_label("a", "x"), "a").join(as_label("b", "y"), "b").filter("x <> y").select("x", "y").distinct()
    moves = None
    while True:
        edges = stored(edges)
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("to")).withColumn("to", F.least("x", "to"))
        # x -> to -> to of to: a label's target may itself move on
        onward = least.select(F.col("x").alias("to"), F.col("to").alias("far"))
        step = stored(least.join(onward, "to", "left").select("x", F.coalesce("far", "to").alias("to")).filter("x <> to"))
        go = lambda df, side: df.join(step.select(F.col("x").alias(side), F.col("to").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = go(go(edges, "x"), "y").filter("x <> y").select("x", "y").distinct()
        moves = step if moves is None else stored(go(moves.withColumnRenamed("to", "y").select(F.col("x").alias("from"), "y"), "y").select(F.col("from").alias("x"), F.col("y").alias("to")).unionByName(step))
    if moves is None:
        return start
    return start.join(moves.groupBy("x").agg(F.min("to").alias("to")).withColumnRenamed("x", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
