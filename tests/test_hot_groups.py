"""The block plan for hot groups gives the rows of the plain plan."""

import pytest
from pyspark.sql import functions as F

from foretally.operators import history as hist
from foretally.operators import ordered, ranks
from foretally.operators.ordered import BLOCK, History, hot_cuts
from foretally.plans.bindings import PIT_ORDER, pit
from foretally.roles import Order


@pytest.fixture(scope="module")
def rows(spark, sf):
    # One entity owns a third of all rows.
    return pit(spark, sf).withColumn(
        "entity", F.when(F.col("game") % 3 == 0, F.lit(0)).otherwise(F.col("entity"))).cache()


def same(a, b, digits=9):
    def shape(df):
        cols = sorted(df.columns)
        return sorted(str([round(v, digits) if isinstance(v, float) else v for v in r])
                      for r in df.select(cols).collect())
    left, right = shape(a), shape(b)
    assert len(left) == len(right)
    assert left == right


def both(rows, keys, build):
    plain = History(rows, keys, PIT_ORDER)
    cut = History(rows, keys, PIT_ORDER, hot_rows=150)
    assert plain.cuts is None and len(cut.cuts) > 3
    same(build(plain).df, build(cut).df)


@pytest.mark.parametrize("keys", [["entity"], []])
def test_running(rows, keys):
    both(rows, keys, lambda h: h.running({"s": F.col("qty"), "n": F.lit(1)}))


def test_position(rows):
    both(rows, ["entity"], lambda h: h.position("seq"))


def test_position_with_group_size(rows):
    both(rows, ["entity"], lambda h: h.position("seq", "size"))
    told = History(rows, ["entity"], PIT_ORDER, hot_rows=150).position("seq", "size").df
    assert told.groupBy("entity").agg(F.max("seq").alias("s"), F.max("size").alias("n"), F.count("*").alias("k")).filter(
        "s + 1 <> n OR n <> k").isEmpty()


def test_blocks_are_halved_to_without_lists(spark, monkeypatch):
    """The halving expression and the lists of cuts number blocks alike, and few cuts need no list for each row."""
    order = Order(("a", "b"))
    df = spark.createDataFrame([(i % 7 if i % 5 else None, f"{i % 11}" if i % 3 else None) for i in range(300)], "a int, b string")
    cuts = [tuple(r) for r in df.distinct().orderBy("a", "b").select(F.col("a").cast("string"), "b").collect()][::4]
    halved = ordered.assign_block(df, order, cuts)
    assert "lambda" not in halved._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ordered, "HALVED", 0)
    listed = ordered.assign_block(df, order, cuts)
    same(halved, listed)
    assert halved.agg(F.max(BLOCK)).first()[0] == len(cuts)


def test_frames_back_and_ahead(rows):
    both(rows, ["entity"], lambda h: h.frames(7, lambda w: {
        "l3": F.lag("qty", 3).over(w), "ld": F.lead("qty", 2).over(w),
        "m7": F.stddev_samp("tax0").over(w.rowsBetween(-7, -1))}, ahead=2))


def test_last_known_and_max(rows):
    both(rows, ["entity"], lambda h: h.last_known({"k": F.col("tax0")}))
    both(rows, ["entity"], lambda h: h.running_max("m", F.col("price")))


def test_last_n_and_segments(rows):
    both(rows, ["entity"], lambda h: hist.last_n_sums(h, {"s": F.col("y")}, 25))
    same(hist.segments(rows, "entity", PIT_ORDER, ["tax0"]),
         hist.segments(rows, "entity", PIT_ORDER, ["tax0"], hot_rows=150))


def test_recovered_labels(rows):
    base = History(rows, ["entity"], PIT_ORDER).position("n").running({"s": F.col("y")}).df
    base = base.withColumn("rate", F.try_divide(F.col("s").cast("double"), F.col("n")))
    a = hist.recovered_labels(base, "entity", PIT_ORDER, "n", ["rate"])
    same(a, hist.recovered_labels(base, "entity", PIT_ORDER, "n", ["rate"], hot_rows=150))
    assert a.filter("label_rate <> y").count() == 0


def test_quantiles_and_ranks(rows):
    probs = {"a": 0.1, "b": 0.5, "c": 0.99}
    plain = ranks.exact_quantiles(rows, ["hand"], "price", probs)
    same(plain, ranks.exact_quantiles(rows, ["hand"], "price", probs, hot_rows=100))
    builtin = rows.groupBy("hand").agg(*[F.percentile("price", p).alias(n) for n, p in probs.items()])
    same(plain, builtin, 6)
    same(ranks.average_rank(rows, ["hand"], "qty", "r", percent=True),
         ranks.average_rank(rows, ["hand"], "qty", "r", percent=True, hot_rows=10))


def test_history_rates_hot(rows):
    rates = {"csw": (F.col("y"), F.lit(1))}
    args = ("entity", "game", "day", "season", PIT_ORDER, rates, {"csw": 200}, {"csw": 0.33}, (100,))
    same(hist.history_rates(rows, *args), hist.history_rates(rows, *args, hot_rows=150))


def test_group_sizes_decide(rows):
    assert hot_cuts(rows, ["entity"], PIT_ORDER, 10**6) is None
    order = Order(("qty",))
    cells = rows.groupBy("qty").agg(F.count("*").alias("n"))
    assert hot_cuts(cells, [], order, 10) is not None


@pytest.mark.parametrize("build", [
    lambda r: r.withColumn("game", F.col("game") + 600_000_000_000),
    lambda r: r.withColumn("game", -F.col("game")),
    lambda r: r.withColumn("day", F.lit("2000-01-01").cast("date")),
    lambda r: r.withColumn("day", F.concat(F.lit("a long common prefix "), F.col("day").cast("string"))),
])
def test_cuts_follow_the_whole_order(rows, build):
    """Large and negative keys, one day for all rows, texts with a common prefix: equal rows, bounded blocks."""
    odd = build(rows)
    both(odd, ["entity"], lambda h: h.running({"s": F.col("qty")}))
    cut = History(odd, ["entity"], PIT_ORDER, hot_rows=150)
    most = cut._blocks().groupBy("entity", BLOCK).count().agg(F.max("count")).first()[0]
    assert most <= 2 * 150
