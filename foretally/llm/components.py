"""Connected components of links by least label, with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foretally.llm.store import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node reaches over ``links`` (a, b), stored.

    A round takes the least label among the neighbours and then the label of that label, so the
    distance covered doubles while labels fall together. Labels of neighbours are reduced before they
    are shuffled, so a node with very many links is no single task's work. Rounds end when none changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low"))
                    .select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node"))
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = stored(lower.join(jump, "low").select(
            "node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links``, stored: only the components that these join are walked again."""
    at = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    bt = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = links.join(at, "a", "left").join(bt, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    low = connected(ends)
    joined = low.select(F.col("node").alias("label"), F.col("label").alias("low"))
    known = labels.join(joined, "label", "left").select("node", F.coalesce("low", "label").alias("label"))
    return stored(known.union(low.join(labels.select("node"), "node", "left_anti").select("node", "label")))
