"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from foretally.testing import compare

# The optional queries have tests of their own.
QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.LLM}
SQL = {n: q for n, q in entry.oracle_sql().items() if n not in entry.LLM}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert rows and len(set(got.columns)) == len(got.columns)
        return
    cur = duck.execute(SQL[name])
    message = compare(got.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    assert message == ""


WINDOWED = [
    "lagged_values", "count_before", "rolling_prior", "leverage_index", "times_faced", "outing_workload",
    "history_rates", "expanding_target_encoding", "game_flow", "opponent_history", "command_forward_fill",
    "recovered_labels", "outing_segments", "order_violations", "row_decile", "order_diagnostics",
    "univariate_signal", "probability_scores", "transfer_clip_audit", "concentration_curve", "quantile_match",
    "repeatability_index", "grouped_folds", "category_codes", "capped_sample", "user_history", "robust_z",
]


@pytest.mark.parametrize("name", WINDOWED)
def test_hot_group_plan(spark, sf, duck, name):
    """The same rows when every window is cut into blocks and no lookup is broadcast."""
    spark.conf.set("spark.foretally.hotGroupRows", "40")
    spark.conf.set("spark.foretally.broadcastBytes", "0")
    try:
        got = QUERIES[name](spark, sf)
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.foretally.hotGroupRows")
        spark.conf.unset("spark.foretally.broadcastBytes")
    cur = duck.execute(SQL[name])
    assert compare(got.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == ""


def test_entry_matches_published_numbers(spark):
    from foretally.plans.catalog import CATALOG
    rows = {r["hand"]: r for r in CATALOG["split_forecast_skill"].run(spark, "/root/testdata/sf0.01").collect()}
    assert (rows["F"]["n"], rows["F"]["rate"], rows["F"]["brier"], rows["F"]["bss"]) == (
        3628, 0.353638, 0.229054, -208.299789)
    assert (rows["O"]["n"], rows["O"]["bss"]) == (3635, -21.070501)
    assert entry.entry(spark).count() > 0


def test_names_and_sql_agree():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200
