"""A corpus pipeline of five stages over ``documents``, each one an operator of ``foretally.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foretally.llm import decontaminate, linededup, mixing, neardup, quality
from foretally.llm.store import stored


def _learned(docs: DataFrame, spark: SparkSession, sf_dir: str):
    return quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.7 or more).

    Without labels of both classes to learn from there is no classifier, and no document is rejected.
    """
    model = _learned(docs, spark, sf_dir)
    if model is None:
        return docs
    scored = quality.scored(docs, model)
    return scored.filter(F.col("quality_score") >= quality.GOOD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    out = linededup.drop_boilerplate(docs, "source", "text", spare=True)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*(F.col(f"`{c}`") for c in docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key): each row as one struct and a key of its own, stored so that it stays the same: ids may be null or repeated."""
    return stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                              F.monotonically_increasing_id().alias("key")))


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of least doc_id, of each group of near duplicates; rows without doc_id come last.

    Rows are told apart whatever their doc_id, so of rows alike in all columns one stays.
    """
    keyed = _keyed(docs)
    told = neardup.near_duplicates(_texts(keyed), width=5, percent=80).select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = (told.join(keyed.select("key", F.col("row.doc_id").alias("doc_id")), "key")
            .groupBy("component_id").agg(F.min(order)["key"].alias("key")))
    return keyed.join(kept, "key", "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, whatever their doc_id."""
    keyed, items = _keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contained_items(_texts(keyed), items).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a mixture of sources by tempered weights."""
    return mixing.mixed_order(docs)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_copies),
          ("decontamination", drop_leaks), ("mixing", mix)]
#: The classifier and the schedule are not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
