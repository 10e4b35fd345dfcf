"""Hand-sized fixtures: past-only values, tampering, NULL keys, edges, ties and cold starts."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from foretally.functions import buckets, physics, rates
from foretally.operators import asof, audit, eb, history as hist, joins, metrics, ranks
from foretally.operators.ordered import History
from foretally.plans.bindings import PIT_ORDER, pit
from foretally.roles import Order

DAY = dt.date(2024, 4, 1)
ORDER = Order(("day", "seq"))


@pytest.fixture(scope="module")
def log(spark):
    values = {"a": [1.0, None, 3.0, 5.0, 7.0, 9.0], "b": [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]}
    rows = [(e, DAY + dt.timedelta(days=i // 2 * 10), i, 2024, v, i % 2)
            for e, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "entity string, day date, seq int, season int, v double, y int")


def column(df, name, entity="a"):
    return [r[name] for r in df.filter(F.col("entity") == entity).orderBy("seq").collect()]


def test_rolling_counts_known_values(log):
    out = hist.rolling(History(log, ["entity"], ORDER), ["v"], 3, 2, ("mean", "std")).df
    assert column(out, "v_last3_mean") == [None, None, None, 2.0, 4.0, 5.0]
    assert column(out, "v_last3_std")[4] == pytest.approx(math.sqrt(2.0))


def test_expanding_and_encoding(log):
    h = History(log, ["entity"], ORDER)
    assert column(hist.expanding_mean(h, ["v"], 2).df, "v_before") == [None, None, None, 2.0, 3.0, 4.0]
    out = hist.expanding_rate(h, {"te": (F.col("y"), F.lit(1), 2.0, 0.5)}).df
    assert column(out, "te") == pytest.approx([0.5, 1 / 3, 2 / 4, 2 / 5, 3 / 6, 3 / 7])
    assert column(out, "te_n") == [0, 1, 2, 3, 4, 5]


def test_day_windows_exclude_today_and_old_days(log):
    out = hist.daily_windows(log, "entity", "day", "season", {"n": F.lit(1)}, 14)
    rows = sorted((r["day"], r["n__near"], r["n__car"]) for r in out.filter("entity = 'a'").collect()
                  if r["n__near"] is not None)
    assert [(n, c) for _, n, c in rows] == [(2, 2), (2, 4)]


def test_first_row_of_an_entity_starts_from_nothing(log):
    out = History(log, ["entity"], ORDER).running({"s": F.col("v")}).df
    assert column(out, "s", "b") == [0.0, 2.0, 6.0, 12.0, 20.0, 30.0]


def by_entity(df):
    return History(df, ["entity"], PIT_ORDER)


PAST_ONLY = {
    "lags": (lambda d: hist.lags(by_entity(d), ["qty", "lab"], [1, 2]).df, ["prev_qty_1", "prev_lab_2"]),
    "rolling": (lambda d: hist.rolling(by_entity(d), ["qty"], 20, 5, ("mean", "std")).df,
                ["qty_last20_mean", "qty_last20_std"]),
    "expanding": (lambda d: hist.expanding_mean(by_entity(d), ["y"], 10).df, ["y_before"]),
    "last_n": (lambda d: hist.last_n_sums(by_entity(d), {"s": F.col("y")}, 30).df, ["s"]),
    "rates": (lambda d: hist.history_rates(d, "entity", "game", "day", "season", PIT_ORDER, {"c": (F.col("y"), F.lit(1))},
                                           {"c": 100}, {"c": 0.3}, (50,)),
              ["c_rate_day", "c_rate_near", "c_rate_szn", "c_rate_car", "c_rate_l50"]),
    "ratio": (lambda d: hist.prequential_ratio(d, ["ctx"], "tax0", F.col("season") < 2001, PIT_ORDER, 50.0, 0.05), ["leverage"]),
    "command": (lambda d: hist.forward_filled_std(d, "entity", PIT_ORDER, F.col("ctx") > 3, ["qty"], 40, 5), ["qty_last40_std_ff"]),
}


@pytest.mark.parametrize("name", sorted(PAST_ONLY))
def test_tampering_with_a_row_leaves_its_own_features(spark, sf, name):
    base = pit(spark, sf).filter("season < 2001")
    last = base.filter("entity = 3").agg(F.max(F.struct(*PIT_ORDER.cols)).alias("k")).first()["k"]
    mark = (F.col("entity") == 3) & (F.col("game") == last["game"]) & (F.col("ctx") == last["ctx"]) & (
        F.col("opp") == last["opp"])
    rows = base.withColumn("mark", mark)
    bent = rows.withColumns({
        "qty": F.when(mark, 999.0).otherwise(F.col("qty")), "y": F.when(mark, 1 - F.col("y")).otherwise(F.col("y")),
        "lab": F.when(mark, "Z").otherwise(F.col("lab")), "tax0": F.when(mark, 9.0).otherwise(F.col("tax0"))})
    build, columns = PAST_ONLY[name]
    before, after = (build(d).filter("mark").select(*columns).collect() for d in (rows, bent))
    assert len(before) == 1 and before == after


def test_null_keys_match_null(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, "z")], "i int, k string")
    right = spark.createDataFrame([(None, 10.0), ("x", 20.0)], "k string, v double")
    out = {r["i"]: r["v"] for r in joins.lookup_join(left, right, ["k"], {"v": 0.0}, True).collect()}
    assert out == {1: 10.0, 2: 20.0, 3: 0.0}
    plain = {r["i"]: r["v"] for r in joins.lookup_join(left, right, ["k"], {"v": 0.0}).collect()}
    assert plain == {1: 0.0, 2: 20.0, 3: 0.0}


def test_salted_join_equals_plain(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    table = spark.createDataFrame([(i, float(i)) for i in range(6)], "k long, v double")
    key = lambda df: sorted((r["id"], r["v"]) for r in df.select("id", F.coalesce("v", F.lit(-1.0)).alias("v")).collect())
    assert key(joins.salted_lookup_join(rows, table, ["k"], ["id"], 5)) == key(joins.lookup_join(rows, table, ["k"]))


def test_cardinality_is_checked(spark):
    one = spark.createDataFrame([(1,), (2,)], "k int")
    two = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        joins.validated_join(one, two, ["k"])
    with pytest.raises(ValueError):
        joins.assemble_blocks(one.withColumn("v", F.lit(1)), [two], "k")


def test_cold_start(spark, log):
    table = eb.nested_split(log, ["entity"], ["entity", "season"], "y", 10.0)
    rows = spark.createDataFrame([("new", 2024)], "entity string, season int")
    got = joins.lookup_join(rows, table, ["entity", "season"], {"split": 0.0, "rel": 0.0}).first()
    assert (got["split"], got["rel"]) == (0.0, 0.0)
    version = spark.createDataFrame([("a", 2024, 0.5)], "entity string, cutoff int, v double")
    out = joins.season_version_join(rows, version, "entity", "season").first()
    assert (out["available"], out["v"]) == (0, None)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(3.0,), (4.0,), (7.0,), (10.0,), (None,)], "x double")
    got = df.select(buckets.digitize(F.col("x"), [4, 7, 10]).alias("d"),
                    buckets.cut(F.col("x"), [0, 3, 7, 10], ["a", "b", "c"]).alias("c")).collect()
    assert [r["d"] for r in got] == [0, 1, 2, 3, 3]
    assert [r["c"] for r in got] == ["a", "b", "b", "c", None]


def test_count_classes(spark):
    df = spark.createDataFrame([(b, s) for b in range(4) for s in range(3)], "b int, s int")
    got = {(r["b"], r["s"]): (r["t"], r["x"]) for r in df.select(
        "b", "s", buckets.three_way_count(F.col("b"), F.col("s")).alias("t"),
        buckets.six_way_count(F.col("b"), F.col("s")).alias("x")).collect()}
    assert got[0, 0] == (1, 0) and got[0, 1] == (0, 1) and got[3, 2] == (2, 4)
    assert got[3, 0] == (2, 3) and got[0, 2] == (0, 2) and got[2, 1] == (2, 5) and got[2, 2] == (1, 2)


def test_average_ranks_and_auc(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (3, 0)], "x int, y int")
    got = sorted((r["x"], r["r"]) for r in ranks.average_rank(df, [], "x", "r").collect())
    assert got == [(1, 1.0), (2, 2.5), (2, 2.5), (3, 4.5), (3, 4.5)]
    cells = metrics.score_cells(df, [], "y", "x")
    assert audit.auc_cells(cells, [], "x").first()["auc"] == pytest.approx(4.0 / 6.0)
    # Ties together: at 3 precision 1/2, at 2 precision 2/4.
    assert metrics.average_precision(cells, [], "x").first()["ap"] == pytest.approx(0.5)


def test_row_bucket_matches_quantile_cut(spark):
    import pandas as pd
    n = 37
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 10, labels=False).tolist()
    got = [r[0] for r in spark.range(n).orderBy("id").select(ranks.row_bucket(F.col("id"), F.lit(n), 10)).collect()]
    assert got == want


def test_label_recovery(spark):
    # The count jumps from 2 to 4: that row's label is unknown.
    rows = [(0, None), (1, 1.0), (2, 0.5), (4, 0.5), (5, 0.6)]
    df = spark.createDataFrame([("a", i, n, r) for i, (n, r) in enumerate(rows)], "entity string, seq int, n int, rate double")
    order = Order(("seq",))
    out = hist.recovered_labels(df, "entity", order, "n", ["rate"]).orderBy("seq").collect()
    assert [r["label_rate"] for r in out] == [1, 0, None, 1, None]


def test_segments_treat_null_as_equal(spark):
    vals = [None, None, 0.5, 0.5, None, 0.5]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "entity string, seq int, v double")
    out = hist.segments(df, "entity", Order(("seq",)), ["v"]).orderBy("seq")
    assert [r["segment"] for r in out.collect()] == [1, 1, 2, 2, 3, 4]


def test_trend_uses_squared_weights(spark):
    import numpy as np
    rates = [0.40, 0.46, 0.43, 0.50]
    rows = [(2020 + i, int(j < r * 100)) for i, r in enumerate(rates) for j in range(100)]
    df = spark.createDataFrame(rows, "season int, y int")
    got = asof.season_priors(df, "season", "y", [2024]).first()
    x, w = np.arange(2020, 2024.0), 0.5 ** ((2024 - np.arange(2020, 2024.0)) / 1.5)
    want = np.polyval(np.polyfit(x - 2024, rates, 1, w=w), 0.0)
    assert got["trend"] == pytest.approx(want) and got["last"] == pytest.approx(0.5)


def test_angles_of_a_straight_path(spark):
    # No acceleration: both angles follow from the velocity alone.
    df = spark.createDataFrame([(3.0, -130.0, -6.0, 0.0, 0.0, 0.0)], "vx0 double, vy0 double, vz0 double, ax double, ay double, az double")
    got = df.select(*[c.alias(n) for n, c in {**physics.plate_angles(), **physics.release_angles(None, None)}.items()]).first()
    assert got["vaa"] == pytest.approx(math.degrees(math.atan2(-6, 130)))
    assert got["hra"] == pytest.approx(math.degrees(math.atan2(3, 130)))
    curved = spark.createDataFrame([(0.0, -130.0, -5.0, 0.0, 26.0, -20.0)], "vx0 double, vy0 double, vz0 double, ax double, ay double, az double")
    t = (130 - math.sqrt(130 ** 2 - 2 * 26 * (50 - 17 / 12))) / 26
    vaa = curved.select(physics.plate_angles()["vaa"].alias("v")).first()["v"]
    assert vaa == pytest.approx(math.degrees(math.atan2(-5 - 20 * t, abs(-130 + 26 * t))))


def test_wilson_interval(spark):
    low, high = rates.wilson(F.lit(50), F.lit(100))
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert got["l"] == pytest.approx(0.40383, abs=1e-4) and got["h"] == pytest.approx(0.59617, abs=1e-4)


def test_constrained_choice_prefers_keys_that_always_improve(spark):
    df = spark.createDataFrame([("a", 1, -5.0), ("a", 2, 1.0), ("b", 1, -1.0), ("b", 2, -1.0)], "k string, s int, delta double")
    assert metrics.constrained_best(df, "k", "s").first()["k"] == "b"
    assert metrics.constrained_best(df.filter("k = 'a'"), "k", "s").first()["all_improve"] == 0


def test_report_raises_on_failures(spark):
    df = spark.createDataFrame([(1,), (9,)], "balls int")
    report = audit.status_report(audit.violations(df, {"balls_range": ~F.col("balls").between(0, 3)}).select("check", "violations"))
    with pytest.raises(AssertionError, match="balls_range=1"):
        audit.assert_no_failures(report)
