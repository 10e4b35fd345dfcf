"""Scans, sinks and the extension surface."""

import pytest
from pyspark.sql import functions as F, types as T

from foretally.operators import eb, registry as reg
from foretally.plans.bindings import pit
from foretally.sources import files, schemas


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("﻿row_id,season,li,extra\nTRAIN_1,2024,1.5,x\nTRAIN_2,oops,NaN,y\n", encoding="utf-8")
    df = files.read_csv(spark, str(path), schemas.PITCHES, ["row_id", "season", "li", "control_success"])
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [("TRAIN_1", 2024, 1.5, None), ("TRAIN_2", None, None, None)]


def test_chunks_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(str(tmp_path / "c" / "one"))
    spark.createDataFrame([(3, float("nan"), 5)], "a int, b double, z int").write.parquet(str(tmp_path / "c" / "two"))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("q", T.StringType())])
    paths = [str(tmp_path / "c" / n) for n in ("one", "two")]
    assert sorted(map(tuple, files.read_chunks(spark, paths, schema).collect())) == [(1, 2.0, None), (3, None, None)]


def test_cache_is_built_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = files.build_cache(spark.createDataFrame([(1, 2.0)], "a long, b double"), path, {"a": "int", "b": "float"})
    assert dict(first.dtypes) == {"a": "int", "b": "float"}
    again = files.build_cache(spark.createDataFrame([(9, 9.0)], "a long, b double"), path, {"a": "int"})
    assert again.first()["a"] == 1
    assert files.build_cache(spark.createDataFrame([(9, 9.0)], "a long, b double"), path, {}, True).first()["a"] == 9


def test_versions_replace_only_their_cutoff(spark, tmp_path):
    path = str(tmp_path / "profiles")
    make = lambda rows: spark.createDataFrame(rows, "entity int, last_season int, cutoff int")
    files.save_version(make([(1, 2000, 2001), (2, 2001, 2002)]), path)
    files.save_version(make([(3, 1999, 2001)]), path)
    assert sorted((r["entity"], r["cutoff"]) for r in spark.read.parquet(path).collect()) == [(2, 2002), (3, 2001)]
    with pytest.raises(AssertionError):
        files.save_version(make([(4, 2001, 2001)]), path)


def test_dataset_and_submission(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.2, "test"), ("a", 1, 0.1, "train")], "row_id string, seq int, p double, split string")
    text = files.save_dataset(df, str(tmp_path / "set"))
    assert T.StructType.fromJson(__import__("json").loads(text)) == df.schema
    assert spark.read.parquet(str(tmp_path / "set" / "data")).filter("split = 'test'").count() == 1
    files.write_submission(df, str(tmp_path / "sub"), "row_id", "p", "seq")
    assert [r["row_id"] for r in spark.read.csv(str(tmp_path / "sub"), header=True).collect()] == ["a", "b"]


def test_sample_does_not_depend_on_partitions(spark, sf):
    rows = pit(spark, sf)
    run = lambda d, hot: sorted(tuple(r) for r in files.capped_sample(d, ["season"], ["game", "ctx", "opp", "entity"], 40, 3, hot).select("game", "ctx", "opp").collect())
    assert run(rows, None) == run(rows.repartition(5), None) == run(rows, 50)


def test_registry_checks(spark, sf):
    r = reg.Registry()
    r.add(reg.dropped("one", ["a"], ["drop:two"]))
    r.add(reg.dropped("two", ["b"]))
    with pytest.raises(ValueError):
        r.check(["drop:one", "drop:two"])
    with pytest.raises(KeyError):
        r.check(["missing"])
    with pytest.raises(ValueError):
        r.add(reg.dropped("one", []))
    _, names = r.apply(pit(spark, sf), ["drop:two"], ["a", "b", "c"], F.lit(True))
    assert names == ["a", "c"]


def test_contract_and_gates(spark, sf):
    rows = pit(spark, sf)
    base = rows.select("opp").distinct()
    block = base.withColumns({"f": F.lit(1.0), "g": F.lit("text")})
    bad = {r["check"]: r["violations"] for r in reg.check_block(block.union(block.limit(1)), base, ["opp"], ["f", "g"]).collect()}
    assert bad["non_numeric"] == 1 and bad["repeated_ids"] == 1 and bad["missing_ids"] == 0
    leaky = reg.FeatureSpec("level", ("v",), make_table=lambda fit: rows.groupBy("opp").agg(F.avg("y").alias("v")), keys=("opp",))
    gates = {r["gate"]: r["passed"] for r in reg.intake_gates(leaky, rows, "season", [2000, 2001], 1.0).collect()}
    assert gates["changes_with_fold"] is False and gates["own_contribution"] is False


def test_row_dependence_is_seen(spark, sf):
    rows = pit(spark, sf).select("game", "ctx", "opp", "entity", "qty")
    good = reg.row_independent(lambda d: d.withColumn("f", F.col("qty") * 2), rows, ["game", "ctx"], F.col("game") % 2 == 0)
    bad = reg.row_independent(lambda d: eb.group_stats(d, ["entity"], {"f": F.avg("qty")}), rows, ["game", "ctx"], F.col("game") % 2 == 0)
    count = lambda d: {r["check"]: r["violations"] for r in d.collect()}
    assert sum(count(good).values()) == 0 and count(bad)["part_of_rows"] > 0
