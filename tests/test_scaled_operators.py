"""Operators whose plan depends on size, and iterations that must converge or raise."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.functions import rowfeatures as rf
from foretally.operators import (asof, audit, blend, blocks, calibrate as cal, cluster as cl, crosswalk as cw, eb, embed, history as hist,
                                 metrics, model, prepare, profiles as prof, registry as reg)
from foretally.operators.ordered import History
from foretally.plans import catalog
from foretally.roles import Order
from foretally.sources import files


def test_best_round():
    assert model.best_round([5, 4, 3, 4, 5, 6], 3) == (3, True)
    assert model.best_round([5, 4, 3, 4, 5], 3) == (3, False)
    assert model.best_round([1, 2, 3], 2) == (1, True)
    assert model.best_round([3, 3, 3], 2) == (1, True)


def test_training_reads_equal_rows_once(spark, monkeypatch):
    """Trees and class models are fitted on distinct rows with weights, with the losses and shares of all rows."""
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(rng.random() < 0.2 + 0.2 * a), i % 4 == 0, i) for i, (a, b) in enumerate(rng.integers(0, 3, (900, 2)))]
    df = spark.createDataFrame(rows, "a int, b int, y int, held boolean, g int")
    seen = []
    keep = model.session.checkpoint
    monkeypatch.setattr(model.session, "checkpoint", lambda d: seen.append(keep(d)) or seen[-1])
    fit = model.fit_boosted(df, ["a", "b"], "y", "held", rounds=8, patience=8, depth=2, step=0.3)
    assert [d.count() for d in seen] == [18, 18]
    assert [d.agg(F.sum("__w")).first()[0] for d in seen] == [675.0, 225.0]
    held = model._features(df.filter("held"), ["a", "b"]).withColumn("__w", F.lit(1.0))
    assert np.allclose(fit.losses, fit.model.evaluateEachIteration(held) + list(fit.losses[fit.rounds:]))
    seen.clear()
    made = model.fit_logistic_model(df, ["a", "b"], "y", family="multinomial", ridge=0.0)
    assert seen[0].count() == 18
    plain = model.LogisticRegression(featuresCol="__f", labelCol="y", family="multinomial", maxIter=1000, regParam=0.0).fit(
        model._features(df, ["a", "b"]))
    assert np.allclose(made.coefficientMatrix.toArray(), plain.coefficientMatrix.toArray(), atol=1e-4)


def test_wide_results_round_alike(spark, monkeypatch):
    """Results of many columns hold the doubles that ``F.round`` gives, at middles, signs, sizes and no numbers too."""
    rng = np.random.default_rng(8)
    values = [*(rng.normal(size=2000) * 10.0 ** rng.integers(-8, 18, 2000)), *(rng.integers(-4000, 4000, 2000) / 2 + 0.5) / 1e6, 0.0, -0.0,
              -1e-9, 2.675, 1.0000005, 0.9999995, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").coalesce(1)
    fields = [(f"c{i}", f"d{i % 7}") for i in range(catalog.WIDE + 1)]
    wide = df.select(*[F.col("x").alias(name) for name, _ in fields])
    seen = []
    monkeypatch.setattr(catalog, "rounded", lambda *a, keep=catalog.rounded: seen.append(a) or keep(*a))
    got = [tuple(map(repr, r)) for r in catalog.shaped(wide, fields).collect()]
    assert len(seen) == len(fields)
    assert got == [tuple(map(repr, r)) for r in wide.select(
        *[(F.round(name, int(kind[1:])) + F.lit(0.0)).alias(name) for name, kind in fields]).collect()]
    seen.clear()
    catalog.shaped(wide, fields[:catalog.WIDE])
    assert not seen


def test_boosting_stops_and_learns(spark):
    rng = np.random.default_rng(2)
    x = rng.random((1500, 2))
    y = (rng.random(1500) < np.where(x[:, 0] > 0.5, 0.85, 0.15)).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c), i % 4 == 0) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "a double, b double, y int, held boolean")
    fit = model.fit_boosted(rows, ["a", "b"], "y", "held", rounds=40, patience=3, depth=2, step=0.3)
    assert 1 <= fit.rounds <= 40 and fit.model.getNumTrees == fit.rounds
    assert fit.losses[fit.rounds - 1] == min(fit.losses[:fit.rounds + 3])
    scored = model.forecast(fit.model, rows, ["a", "b"]).agg(F.avg(F.pow(F.col("forecast") - F.col("y"), 2))).first()[0]
    assert scored < 0.16 < 0.25
    with pytest.raises(ValueError):
        model.fit_boosted(rows.withColumn("held", F.lit(False)), ["a", "b"], "y", "held", rounds=4, patience=1)
    with pytest.raises(ValueError):
        model.fit_forecaster(rows, ["a"], "y", "gbt")


def test_day_windows_by_frames_and_by_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 40)), dt.date(2020 + int(d) // 50, 1, 1) + dt.timedelta(days=int(d) % 50), i, int(rng.integers(0, 2)))
            for i, d in enumerate(rng.integers(0, 150, 400))] + [(None, 1, dt.date(2020, 1, 5), 900, 1), (1, 2, None, 901, 1)]
    df = spark.createDataFrame(rows, "e int, game int, day date, seq int, y int").withColumn("season", F.year("day"))
    run = lambda hot: sorted(str(sorted(r.asDict().items())) for r in hist.history_rates(
        df, "e", "game", "day", "season", Order(("day", "seq")), {"r": (F.col("y"), F.lit(1))}, {"r": 10}, {"r": 0.4}, (5, 20), hot).collect())
    assert run(4_000_000) == run(60)
    plan = hist.history_rates(df, "e", "game", "day", "season", Order(("day", "seq")), {"r": (F.col("y"), F.lit(1))}, {"r": 10}, {"r": 0.4})
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_order_breaks_of_files(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") / 5000).alias("p"), "id")
    seq = df.select("row_id", F.col("id").alias("seq"))
    path = str(tmp_path / "good")
    files.write_submission(df.repartition(7), path, "row_id", "p", "id")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("p", T.DoubleType())])
    breaks = lambda where: files.order_breaks(files.read_placed(spark, where, schema).join(seq, "row_id"), "seq").first()["breaks"]
    assert breaks(path) == 0
    bad = str(tmp_path / "bad")
    df.repartition(3, "id").select("row_id", "p").write.option("header", True).csv(bad)
    assert breaks(bad) > 0
    swapped = tmp_path / "swapped"  # two files in the wrong order, each in order inside
    swapped.mkdir()
    (swapped / "part-00000-x.csv").write_text("row_id,p\n" + "".join(f"r{i},0.5\n" for i in range(10, 20)))
    (swapped / "part-00001-x.csv").write_text("row_id,p\n" + "".join(f"r{i},0.5\n" for i in range(0, 10)))
    assert breaks(str(swapped)) == 1


def test_simplex_of_forty_members():
    rng = np.random.default_rng(7)
    for ridge in (0.0, 0.01):
        x = rng.random((200, 40)) + 0.5 * rng.random((200, 1))
        y = x[:, :5].mean(axis=1) + 0.05 * rng.standard_normal(200)
        s, t = x.T @ x / 200, x.T @ y / 200
        w = blend.simplex_weights(s, t, ridge)
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and blend.simplex_gap(s, t, ridge, w) < 1e-8
        value = lambda v: v @ s @ v - 2 * t @ v + ridge * ((v - 1 / 40) ** 2).sum()
        for _ in range(300):
            assert value(w) <= value(rng.dirichlet(np.full(40, 0.2))) + 1e-12
    assert blend.simplex_weights(np.ones((3, 3)), np.ones(3), 0.0).sum() == pytest.approx(1)


def brute_isotonic(p, y):
    at = np.unique(p)
    stack = []
    for v in at:
        stack.append([v, v, float((p == v).sum()), float(y[p == v].sum())])
        while len(stack) > 1 and stack[-2][3] / stack[-2][2] >= stack[-1][3] / stack[-1][2]:
            low, _, w, t = stack.pop(-2)
            stack[-1] = [low, stack[-1][1], stack[-1][2] + w, stack[-1][3] + t]
    ends = np.array([e for b in stack for e in (b[0], b[1])])
    values = np.array([b[3] / b[2] for b in stack for _ in range(2)])
    return ends, values


def test_isotonic_of_many_forecasts(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(30000), 5)
    y = (rng.random(30000) < p ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int").repartition(5)
    fit = cal.isotonic(df, "y", "p")
    ends, values = brute_isotonic(p, y)
    ask = np.concatenate([rng.random(500) * 1.2 - 0.1, p[:500]])
    got = cal.apply_isotonic(fit, spark.createDataFrame([(float(a),) for a in ask] + [(None,)], "p double"), "p").collect()
    want = {float(a): float(np.interp(a, ends, values)) for a in ask}
    assert all(r["calibrated"] == pytest.approx(want[r["p"]], abs=1e-12) for r in got if r["p"] is not None)
    assert [r["calibrated"] for r in got if r["p"] is None] == [None]
    assert len(fit.at) < 3000  # final blocks only
    with pytest.raises(ValueError):
        cal.isotonic(df.limit(0), "y", "p")


def test_newton_raises_and_holds(spark):
    df = spark.createDataFrame([(g, z, y) for g, ys in ((0, [0, 1, 0, 1, 1]), (1, [1, 1, 1, 1, 1])) for z, y in zip([-1.0, -0.5, 0.2, 0.4, 1.0], ys)],
                               "who int, z double, y int")
    out = {r["who"]: (r["a"], r["b"]) for r in cal.platt(df, ["who"], "y", F.col("z")).collect()}
    assert set(out) == {0, 1} and out[1][1] == 0.6
    cells = cal.logit_cells(df.filter("who = 0"), [], "y", F.col("z"))
    with pytest.raises(ArithmeticError):
        cal.newton(cells, [], {"b": 0.0}, {"g": F.col("n")}, {"b": F.col("b") + 0.01}, steps=3)


def test_kernel_leaves_out_far_blocks(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(60, 1, (150, 2))])
    s, n = rng.random(300) * 5, rng.integers(5, 40, 300)
    prof = spark.createDataFrame([(i, float(a), float(b), float(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, s, n))],
                                 "id int, a double, b double, s double, n double")
    got = {r["id"]: r["mu"] for r in eb.kernel_neighbours(prof, "id", ["a", "b"], "s", "n", 0.05, 50.0, 20).collect()}
    lo, hi = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    z = np.clip(x, lo, hi)
    z = (z - z.mean(0)) / z.std(0)
    w = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * 0.05 ** 2))
    np.fill_diagonal(w, 0)
    want = (w @ s) / (w @ n)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in range(300))
    points = spark.createDataFrame([(i, float(c), float(d), [float(v) for v in q]) for i, (q, c, d) in enumerate(zip(z, s, n))],
                                   "id int, s double, n double, v array<double>")
    blocked = blocks.in_blocks(points, "id", "v", 20)
    every = blocks.pairs_of_blocks(blocked).count()
    assert every == 120 and eb._near_pairs(blocked, 2, 0.05).count() < 0.7 * every


def test_blocks_hold_neighbours(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((500, 2)))], "id int, v array<double>")
    rows = blocks.in_blocks(points, "id", "v", 50).collect()
    by = {}
    for r in rows:
        by.setdefault(r["block"], []).append(r["v"])
    assert sorted(map(len, by.values())) == [50] * 10
    assert np.mean([np.ptp(np.array(v), axis=0).prod() for v in by.values()]) < 0.4
    assert blocks.even_size(10, 2048, 8) < 10 and blocks.even_size(10 ** 9, 2048, 8) == 2048


def test_grouped_clusters_and_types(spark):
    rng = np.random.default_rng(5)
    centre = {0: [(0, 0), (10, 0), (0, 10)], 1: [(5, 5), (-5, 5), (50, 0)]}
    rows = [(g, int(i), float(a + rng.normal()), float(b + rng.normal()), j) for g, cs in centre.items() for j, (a, b) in enumerate(cs) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, truth int")
    out, centres = cl.grouped_kmeans(df, ["g"], ["a", "b"], 3, 1)
    for g in (0, 1):
        assert cl.adjusted_rand(out.filter(F.col("g") == g), "cluster", "truth").first()["ari"] == pytest.approx(1.0)
    assert centres.count() == 2 and out.columns == [*df.columns, "cluster", "d2"]
    with pytest.raises(ArithmeticError):
        cl.grouped_kmeans(df, ["g"], ["a", "b"], 3, 1, rounds=1)
    same = spark.createDataFrame([(0, 1.0, 1.0)] * 4, "g int, a double, b double")
    assert {r["cluster"] for r in cl.grouped_kmeans(same, ["g"], ["a", "b"], 3)[0].collect()} == {0}
    typed = cl.safe_types(df.withColumn("n", F.col("i") + 10), "n", ["a", "b"], 4, 15, 1, keys=["g"]).collect()
    assert len(typed) == len(rows) and all((r["type"] == -1) == (r["n"] < 15) for r in typed)
    for g in (0, 1):
        sizes = {}
        for r in typed:
            if r["g"] == g and r["type"] >= 0:
                sizes[r["type"]] = sizes.get(r["type"], 0) + r["n"]
        assert sorted(sizes) == list(range(len(sizes))) and min(sizes.values()) >= 0.05 * sum(sizes.values())


def test_distances_by_matrix_products(spark, monkeypatch):
    """Tiles give the distances that differences give, and the silhouette takes the slow way for near points only."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(300, 8)) + 1e6, rng.normal(size=(1100, 8)) + 1e6
    a[3], a[4], a[5, 0] = b[9], b[1050] + 1e-7, np.nan
    b[7, 2], b[8] = np.inf, b[8] + 1e3
    got = np.zeros((300, 1100))
    for i, j, gaps in blocks.gap_tiles(a, b):
        got[i, j] = gaps
    assert np.allclose(got, np.sqrt(blocks.squared_gaps(a, b)), rtol=1e-9, atol=0, equal_nan=True)
    slow = []
    monkeypatch.setattr(blocks, "squared_gaps", lambda *p: slow.append(1))
    assert sum(g.size for _, _, g in blocks.gap_tiles(a[10:], a[10:])) == 290 * 290 and not slow


def test_silhouette_of_odd_rows(spark):
    """Points without a label are counted and measured only; repeated ids add up; a label of one point counts nought."""
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(60, 3)) + 100, rng.integers(0, 3, 60).tolist()
    c[0], c[1] = None, 7
    rows = [(i, *map(float, v), k) for i, (v, k) in enumerate(zip(x, c))]
    df = spark.createDataFrame(rows, "id int, a double, b double, d double, c int")
    gaps, code = np.linalg.norm(x[:, None] - x[None], axis=2), np.array([-1 if k is None else k for k in c])
    said = [0.0]
    for i in range(2, 60):
        mean = {k: gaps[i, code == k].sum() / ((code == k).sum() - (k == code[i])) for k in (0, 1, 2, 7)}
        own, other = mean.pop(code[i]), min(v for k, v in mean.items() if k != code[i])
        said.append((other - own) / max(own, other))
    for chunk in (7, 16384):
        got = cl.silhouette(df, "id", ["a", "b", "d"], "c", chunk=chunk).first()
        assert got["n"] == 60 and got["silhouette"] == pytest.approx(np.mean(said), rel=1e-9)


def test_cluster_rounds_and_reads(spark, monkeypatch):
    """Small tables of centres take no checkpoint a round and give what checkpointed rounds give; types read their rows once."""
    rng = np.random.default_rng(6)
    rows = [(None if i % 7 == 0 else float("nan") if i % 7 == 1 else 1.0, i, *map(float, rng.normal(size=2)), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:20]], "g double, i int, a double, b double, w double")
    calls = []
    keep = cl.session.checkpoint
    monkeypatch.setattr(cl.session, "checkpoint", lambda d: calls.append(1) or keep(d))
    told, seen = [], []
    for most in ("1000000", "0"):
        calls.clear()
        spark.conf.set("spark.foretally.broadcastBytes", most)
        try:
            out, centres = cl.grouped_kmeans(df, ["g"], ["a", "b"], 4, 1, weight="w")
            told.append((sorted((str(r["g"]), r["i"], r["cluster"]) for r in out.collect()),
                         sorted((str(r["g"]), [[round(x, 9) for x in c] for c in r["centres"]]) for r in centres.collect())))
        finally:
            spark.conf.unset("spark.foretally.broadcastBytes")
        seen.append(len(calls))
    assert told[0] == told[1] and seen[0] == 5 < seen[1]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = df.select("i", "a", "b", (F.col("i") + 10).alias("n")).mapInArrow(counted, "i int, a double, b double, n int")
    assert cl.safe_types(source, "n", ["a", "b"], 3, 15, 1).count() == 320 and reads.value == 320


def test_svd_raises_before_it_converges(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(30, 20))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(20)], "r int, c int, x double")
    with pytest.raises(ArithmeticError):
        embed.truncated_svd(cells, "r", "c", "x", 2, iterations=1, tolerance=1e-9)
    left, right, sigma, residual = embed.truncated_svd(cells, "r", "c", "x", 2, tolerance=1e-3)
    assert residual <= 1e-3 and np.allclose(sigma, np.linalg.svd(m)[1][:2], rtol=1e-3)
    told = embed.reconstruction(cells, left, right, "r", "c", "x", ["svd00", "svd01"]).first()
    assert told["left_over"] == pytest.approx((m ** 2).sum() - sum(s * s for s in sigma), rel=1e-6)


@pytest.mark.parametrize("shape", [(30, 20), (20, 30)])
def test_svd_steps_need_no_join_of_the_cells(spark, shape, monkeypatch):
    """Packs of the longer axis give what joins give, repeated, null and missing cells included."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=shape) * (rng.random(shape) < 0.6)
    rows = [(i, j, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1]) if m[i, j]]
    cells = spark.createDataFrame([*rows, rows[0], (None, 1, 2.0), (1, None, 2.0), (2, 2, None)], "r int, c int, x double")
    calls = []
    step = embed._there_and_back
    monkeypatch.setattr(embed, "_there_and_back", lambda *a: calls.append(1) or step(*a))
    told = []
    for most in ("1000000", "0"):
        spark.conf.set("spark.foretally.broadcastBytes", most)
        try:
            left, right, sigma, residual = embed.truncated_svd(cells, "r", "c", "x", 2, tolerance=1e-6)
        finally:
            spark.conf.unset("spark.foretally.broadcastBytes")
        told.append((len(calls), sigma, [sorted((str(r[0]), *r[1:]) for r in side.collect()) for side in (left, right)]))
    assert told[0][0] > 1 and told[1][0] == told[0][0]
    assert np.allclose(told[0][1], told[1][1])
    for one, two in zip(told[0][2], told[1][2]):
        assert [r[0] for r in one] == [r[0] for r in two]
        assert np.allclose([r[1:] for r in one], [r[1:] for r in two], atol=1e-6)


RULES = [audit.Rule("known", "known", ("a",)), audit.Rule("form", "matches", ("t", "^x")), audit.Rule("of", "one_of", ("a", 1, 2)),
         audit.Rule("in", "within", ("a", 1, 2)), audit.Rule("in_known", "within_if_known", ("a", 1, 2)), audit.Rule("low", "not_below", ("b", 0)),
         audit.Rule("same", "same", ("a", "b")), audit.Rule("sum", "adds_up", ("c", ("a", "b"))), audit.Rule("to", "adds_up_to", (("a", "b"), 2, 0.5)),
         audit.Rule("expr", "is_expression", ("c", "a + b")), audit.Rule("nulls", "null_iff_zero", ("a", "n")),
         audit.Rule("one", "unique", (("k",),)), audit.Rule("agree", "agree", ("t", ("k",)))]


def test_every_rule_is_broken_by_some_row(spark):
    rows = [(1, 1, 2, "x1", 1, 5), (2, 0, 2, "x1", 1, 6), (None, 1, 3, "x2", 0, 7), (9, -1, 8, "y", 1, 7), (None, None, None, None, 1, 8)]
    df = spark.createDataFrame(rows, "a int, b int, c int, t string, n int, k int")
    got = {r["check"]: r["violations"] for r in audit.rule_violations(df, RULES).collect()}
    assert got == {"known": 2, "form": 2, "of": 3, "in": 3, "in_known": 1, "low": 1, "same": 3, "sum": 0, "to": 1, "expr": 1, "nulls": 1,
                   "one": 2, "agree": 2}
    assert all(r["violations"] == 0 for r in audit.rule_violations(df.limit(0), RULES).collect())


def test_late_columns_are_found():
    feed = ["balls", "events", "post_away_score", "delta_pitcher_run_exp", "batter_days_until_next_game", "pitcher_days_since_prev_game", "is_csw",
            "is_home", "home_win_exp", "in_zone", "zone_before", "estimated_ba_using_speedangle"]
    assert prepare.late_columns(feed, ["is_home"]) == ["events", "post_away_score", "delta_pitcher_run_exp", "batter_days_until_next_game", "is_csw",
                                                       "is_home", "home_win_exp", "in_zone", "estimated_ba_using_speedangle"]


def test_derived_kinds(spark):
    df = spark.createDataFrame([(2.0, 4.0, 3, 1, 1), (None, 0.0, -1, 0, 1)], "a double, b double, n int, u int, v int")
    steps = [("weighted", {"w": ({"a": 2, "b": -1}, 1)}), ("product", {"ab": ("a", "b")}), ("quotient", {"q": ("a", "b")}),
             ("flag", {"f": ("a", ">=", 2)}), ("alike", {"same": ("u", "v")}), ("known", {"k": ("a", 7.0)}), ("log", {"l": ("n",)}),
             ("missing", {"m": ("a",)}), ("shrunk", {"s": ("k", "n", 10, 0.5)}), ("reliability", {"r": ("n", 1.0)}), ("any", {"any": ("u", "f")}),
             ("root", {"root": ("b", "b")}), ("bounded", {"in": ("b", 1.0, 3.0)}), ("size", {"size": ("w",)})]
    one, two = rf.derived(df, steps).collect()
    assert (one["w"], one["ab"], one["q"], one["f"], one["same"], one["k"], one["m"], one["r"], one["any"], one["root"], one["in"], one["size"]) == (
        1.0, 8.0, 0.5, 1, 1, 2.0, 0, 0.75, 1, 4.0, 3.0, 1.0)
    assert one["s"] == pytest.approx((3 * 2 + 5) / 13)
    assert (two["w"], two["f"], two["same"], two["k"], two["l"], two["m"], two["s"], two["any"]) == (None, 0, 0, 7.0, 0.0, 1, 0.5, 0)


def test_matches_skip_chunks_that_cannot_win(spark):
    """Chunks of a few entities give the rows of one chunk; entities without a shared state find the smallest ids."""
    from foretally.operators import crosswalk as cw
    rng = np.random.default_rng(6)
    rows = [(int(s), int(e), int(e % 5 * 10 + rng.integers(0, 4))) for s in (1, 2) for e in range(40) for _ in range(12)]
    a = spark.createDataFrame(rows + [(1, 100, 777)], "season int, a int, st int").withColumn("h", F.when(F.col("a") % 3 > 0, F.col("a") % 3))
    b = spark.createDataFrame(rows, "season int, b int, st int").withColumn("h", F.when(F.col("b") % 3 > 0, F.col("b") % 3)).withColumn("b", F.col("b") + 1000)
    run = lambda chunk: sorted(str(tuple(r)) for r in cw.match_seasons(a, b, "season", "h", "a", "b", "st", 3, chunk).select(
        "season", "a", "b", "rank", F.round("similarity", 9), F.round("second", 9)).collect())
    whole = run(512)
    assert whole == run(3) and len(whole) == 3 * 53  # rows without hand have no match
    assert [r for r in whole if r.startswith("(1, 100,")] == [f"(1, 100, {1001 + 3 * i}, {i + 1}, 0.0, 0.0)" for i in range(3)]


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("spark.foretally.taskRows", "100")
    yield spark
    spark.conf.unset("spark.foretally.taskRows")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_travel_in_blocks(spark):
    """Pairs of chunks stand in one row for each pair of blocks, and the matches are those of brute force."""
    pairs = spark.range(20).withColumnRenamed("id", "l").crossJoin(spark.range(20).withColumnRenamed("id", "r")).withColumn("k", F.lit(None).cast("int"))
    dealt = cw._dealt_pairs(pairs, ["k"], 10, 5).collect()
    assert len(dealt) == 8 and sum(len(r["pairs"]) for r in dealt) == 400
    rng = np.random.default_rng(3)
    x, z = rng.random((40, 6)) * (rng.random((40, 6)) < 0.6) + 0.01, rng.random((50, 6)) * (rng.random((50, 6)) < 0.6) + 0.01
    x, z = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, z))
    long = lambda m, e: spark.createDataFrame([(1, i, f"s{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], f"k int, {e} int, state string, v double")
    got = cw.best_matches(long(x, "a"), long(z, "b"), ["k"], "a", "b", "state", 3, chunk=3)
    best = sorted((a, r + 1, int(b)) for a, row in enumerate(x @ z.T) for r, b in enumerate(np.lexsort((np.arange(50), -np.round(row, 12)))[:3]))
    assert sorted((r["a"], r["rank"], r["b"]) for r in got.collect()) == best


def test_best_of_several_chunks():
    one = (np.array([1, 1, 2, 2]), np.array([5, 6, 5, 6]), np.array([0.9, 0.4, 0.3, 0.2]))
    two = (np.array([1, 1, 2, 2]), np.array([7, 8, 7, 8]), np.array([0.9, 0.1, 0.8, 0.3]))
    a, b, sims = cw._kept([one, two], 2)
    assert list(zip(a, b, sims)) == [(1, 5, 0.9), (1, 7, 0.9), (2, 7, 0.8), (2, 5, 0.3)]
    assert cw._ranked(np.array([[0.2, 0.7, 0.7]]), 2).tolist() == [[1, 2]] == cw._ranked(np.array([[0.2, 0.7, 0.7]] * 1), 3)[:, :2].tolist()


def test_fold_overlap_groups_seasons(spark):
    """Only the two tables are joined, never the rows of a season."""
    rows = spark.range(300).selectExpr("cast(2000 + id % 3 as int) season", "cast(id % 2 as int) y", "0 m", "1 r", "id % 5 entity")
    out = reg.method_audit(rows, "season", 2002, "y", "m", "r", lambda d: d.groupBy("entity").agg(F.avg("y").alias("v")))
    assert sum("Join LeftSemi" in line for line in plan_of(out).splitlines()) == 1
    assert {r["check"]: r["violations"] for r in out.collect()}["fold_overlap"] == 0


def test_row_independence_deals_by_number_of_rows(small_tasks):
    rows = small_tasks.range(3000).selectExpr("id g", "id % 4 c", "id * 2 q")
    out = reg.row_independent(lambda d: d.withColumn("f", F.col("q") + 1), rows, ["g", "c"], F.col("g") % 2 == 0)
    plan = plan_of(out)
    assert plan.count("RepartitionByExpression [g") == 2 and plan.count(", 30") >= 2
    assert sorted((r["check"], r["violations"]) for r in out.collect()) == [("part_of_rows", 0), ("reordered", 0)]


def test_history_deals_rows_by_their_number(small_tasks):
    rows = small_tasks.range(1000).selectExpr("id % 50 e", "id % 3 s", "id t", "id % 7 v")
    h = History(rows, ["e"], Order(("t",)))
    assert h.df.rdd.getNumPartitions() == 10
    finer = h.running({"a": F.col("v")}).regroup(["e", "s"]).running({"b": F.col("v")}).df
    assert plan_of(finer).count("RepartitionByExpression") == 1
    games = rows.selectExpr("e", "t game", "cast(date_add(date'2000-01-01', cast(t % 900 as int)) as date) day")
    assert hist.workload(games, "e", "game", "day").rdd.getNumPartitions() == 10
    got = finer.collect()
    want = {r["t"]: sum(x["v"] for x in got if x["e"] == r["e"] and x["t"] < r["t"]) for r in got}
    assert all(r["a"] == want[r["t"]] for r in got)


def test_two_running_totals_share_one_shuffle(spark):
    rows = spark.range(600).selectExpr("id t", "id % 4 c", "cast(id % 9 as double) / 8 + 0.1 d", "id < 500 fit")
    run = lambda hot: hist.prequential_ratio(rows, ["c"], "d", F.col("fit"), Order(("t",)), 5.0, 0.5, hot)
    cut = run(60)
    assert plan_of(cut).count("RepartitionByExpression") == 1
    show = lambda d: sorted((r["t"], round(r["leverage"], 9), r["leverage_class"]) for r in d.collect())
    assert show(cut) == show(run(None))


def test_target_tables_join_by_coarser_key_sets(spark):
    rows = spark.range(900).selectExpr("id % 40 e", "id % 3 k", "nullif(id % 5, 4) o", "cast(2000 + id % 4 as int) season", "cast(id % 7 = 0 as int) y")
    groups = {"e": ["e"], "ek": ["e", "k"], "o": ["o"], "ok": ["k", "o"]}
    sets = {asof._set_number(k, ["e", "k", "o"]): n for k, n in zip(groups.values(), (120, 360, 20, 60))}
    versions = asof.target_versions(asof.season_cells(rows, ["e", "k", "o"], "season", "y"), groups, "season",
                                    asof.season_priors(rows, "season", "y", [2002, 2003]), [2002, 2003], 80.0, 40.0, 2.0)
    assert asof._leads(versions, groups, ["e", "k", "o"], sets, list(groups)) == {"e": ["e", "ek"], "o": ["o", "ok"]}
    run = lambda: sorted(str(r) for r in asof.temporal_target_features(rows, "season", "y", groups, [2001, 2002, 2003]).collect())
    sent = run()
    spark.conf.set("spark.foretally.broadcastBytes", "0")
    try:
        assert run() == sent
    finally:
        spark.conf.unset("spark.foretally.broadcastBytes")


def test_profile_of_all_axes_reads_cells_once(spark):
    rows = spark.range(800).selectExpr("nullif(id % 20, 7) e", "cast(2000 + id % 3 as int) s", "nullif(concat('L', id % 3), 'L2') c", "nullif(id % 4, 3) x", "concat('h', id % 2) h", "nullif(cast(id % 6 as double), 5) v")
    axes = {"p": ["x", "h"], "q": ["h"]}
    out = prof.response_profile(rows, "e", "s", "c", axes, ["v"], 20.0)
    assert plan_of(out).count("Range (") == 1
    parts = [prof.usage_residuals(rows, "e", "s", "c", ctx, 20.0).unionByName(prof.response_residuals(rows, "e", "s", "c", ctx, ["v"], 20.0)).withColumn("feature", F.concat_ws(":", F.lit(t), "feature")) for t, ctx in axes.items()]
    show = lambda d: sorted(((r["e"], r["s"], r["feature"], round(r["resid"], 9)) for r in d.collect()), key=str)
    assert show(out) == show(parts[0].unionByName(parts[1]))


def test_clip_audit_reads_the_log_once(spark, monkeypatch):
    rows = spark.range(500).selectExpr("cast(2000 + id % 4 as int) season", "cast(id % 90 as double) v")
    seen, keep = [], audit.session.checkpoint
    monkeypatch.setattr(audit.session, "checkpoint", lambda d: seen.append(1) or keep(d))
    out = audit.transfer_clip_audit(rows, "season", ["v"], [2000, 2002, 2003], 0.1, 0.9)
    assert seen == [1] and "Range (" not in plan_of(out)
    got = {r["target"]: (r["past_low"], r["past_high"]) for r in out.collect()}
    past = lambda t: [i % 90 for i in range(500) if 2000 + i % 4 < t]
    assert set(got) == {2002, 2003}
    assert all(np.allclose(got[t], np.quantile(past(t), [0.1, 0.9])) for t in got)


def test_wide_forecasts_group_by_key_alone(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", None), (None, "b", 0.4), (3, "z", 0.5)], "k int, model string, p double")
    wide = metrics.wide_forecasts(rows, ["k"], ["a", "b"], "m_")
    assert plan_of(wide).count("Aggregate [") == 1
    assert sorted(map(str, wide.collect())) == sorted(map(str, rows.groupBy("k").pivot("model", ["a", "b"]).agg(F.first("p")).withColumnsRenamed({"a": "m_a", "b": "m_b"}).collect()))
    for model in ("a", "z"):
        with pytest.raises(ValueError):
            metrics.wide_forecasts(rows.unionByName(rows.filter(F.col("model") == model)), ["k"], ["a", "b"], "m_")
