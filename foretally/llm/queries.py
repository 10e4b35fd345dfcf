"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foretally.llm import (alignment, decontaminate, fingerprint, langid, licenses, linededup, mixing, neardup, packing,
                           quality, sampling, substrings, suffixes, whitening)
from foretally.llm.store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_versions(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_spans(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = langid.identify(docs, langid.learn(docs))
    return told.select("doc_id", sampling.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", linededup.page_host(F.col("url")).alias("host"), linededup.page_text(F.col("html")).alias("text"))
    # Texts are taken out of the HTML once; counting lines and dropping them read what was stored.
    out = linededup.drop_boilerplate(stored(pages), "host", "text")
    return out.select("page_id", "host", "n_lines", "n_removed",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"))
    out = quality.scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    score = F.col("quality_score")
    return out.select("doc_id", sampling.held_out().alias("held_out"), score.alias("score"),
                      (score >= quality.GOOD).cast("int").alias("predicted"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_bytes(_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_order(_table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text")))
    return out.select("doc_id", "source", "block", "slot", "release", "deadline", "position")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    # The exact sum may need more digits than a long has; it is null there rather than wrong.
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_fingerprints, op3_substrings, op4_licenses, op5_language, op6_contamination, op7_lines,
    op8_quality, op9_suffixes, op10_mixing, op11_alignment, op12_packing, op13_whitening)}
SQL = {"op4_licenses": licenses.matches_sql(), "op6_contamination": decontaminate.contained_sql(),
       "op7_lines": linededup.pages_sql()}
