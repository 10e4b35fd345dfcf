"""Iterative operators against small exact computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.functions.rates import logit
from foretally.operators import blend, calibrate as cal, cluster as cl, crosswalk as cw, embed, model
from foretally.plans.bindings import pit


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 4)) * 6
    x = np.vstack([c + rng.normal(size=(40, 4)) for c in centre])
    rows = [(i, *map(float, v), i // 40) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, g int").cache()


def matrix(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()])


def test_components_match_numpy(points):
    cols = ["a", "b", "c", "d"]
    out, info = embed.principal_components(points, cols, 2)
    x = matrix(points, cols)
    x = x - x.mean(0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    vt *= np.sign(vt[np.arange(4), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(matrix(out, info["columns"]), x @ vt[:2].T, atol=1e-6)
    assert np.allclose(info["explained"], (s ** 2 / (s ** 2).sum())[:2])


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(30, 3)) @ np.diag([9.0, 5.0, 2.0]) @ rng.normal(size=(3, 20)) + 0.01 * rng.normal(size=(30, 20))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(20)], "r int, c int, x double")
    left, right, sigma, _ = embed.truncated_svd(cells, "r", "c", "x", 2, tolerance=1e-7)
    u, s, vt = np.linalg.svd(m)
    assert np.allclose(sigma, s[:2], rtol=1e-6)
    got = np.array([[r["svd00"], r["svd01"]] for r in left.orderBy("r").collect()])
    vt = vt[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    assert np.allclose(got, m @ vt.T, atol=1e-4)


def test_clusters_recover_groups(points):
    cols = ["a", "b", "c", "d"]
    out, centres = cl.kmeans(points, cols, 3, 1)
    assert cl.adjusted_rand(out, "cluster", "g").first()["ari"] == pytest.approx(1.0)
    soft = cl.soft_membership(out, cols, centres, "cluster").collect()
    assert all(abs(r["member_0"] + r["member_1"] + r["member_2"] - 1) < 1e-9 for r in soft)
    numbered = cl.stable_numbers(out, "cluster", ["a"], 3).groupBy("cluster").agg(F.median("a").alias("m")).orderBy("cluster")
    med = [r["m"] for r in numbered.collect()]
    assert med == sorted(med)
    mix, _ = cl.diagonal_mixture(points, cols, 3, 1)
    assert cl.adjusted_rand(mix, "cluster", "g").first()["ari"] == pytest.approx(1.0)


def test_silhouette_in_chunks(points):
    cols = ["a", "b", "c", "d"]
    one = cl.silhouette(points, "id", cols, "g").first()
    many = cl.silhouette(points, "id", cols, "g", chunk=17).first()
    assert one["n"] == many["n"] == 120 and one["silhouette"] == pytest.approx(many["silhouette"])


def test_kernel_neighbours_in_chunks(points):
    from foretally.operators.eb import kernel_neighbours
    prof = points.withColumns({"s": F.col("g") * 3.0 + 1, "n": F.lit(20.0)})
    run = lambda chunk: sorted((r["id"], round(r["dev"], 9)) for r in kernel_neighbours(
        prof, "id", ["a", "b"], "s", "n", 1.5, 50.0, chunk).collect())
    assert run(2048) == run(13)


def test_matches_in_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), int(e % 2), int(e), int(rng.integers(0, 4) + 5 * e)) for s in (1, 2) for e in range(12) for _ in range(40)]
    a = spark.createDataFrame(rows, "season int, h int, a int, st int")
    b = a.select("season", "h", (F.col("a") + 100).alias("b"), "st")
    run = lambda chunk: sorted(tuple(r) for r in cw.match_seasons(a, b, "season", "h", "a", "b", "st", 2, chunk).select(
        "season", "a", "b", "rank", F.round("similarity", 9), F.round("second", 9)).collect())
    assert run(512) == run(2)
    got = cw.hard_crosswalk(cw.match_seasons(a, b, "season", "h", "a", "b", "st"), "season", "a", "b").collect()
    assert {r["a"]: r["b"] for r in got} == {e: e + 100 for e in range(12)}


def test_lone_candidate_and_hand_mismatch(spark):
    a = spark.createDataFrame([(1, 1, 1, 7), (1, 2, 2, 7)], "season int, h int, a int, st int")
    b = spark.createDataFrame([(1, 1, 11, 7), (1, 2, 12, 8), (2, 1, 11, 7)], "season int, h int, b int, st int")
    got = {r["a"]: (r["b"], r["similarity"], r["second"]) for r in cw.match_seasons(a, b, "season", "h", "a", "b", "st").collect()}
    assert got == {1: (11, 1.0, -1.0), 2: (12, 0.0, -1.0)}


def test_simplex_weights():
    s, t = np.array([[1.0, 0.2, 0.1], [0.2, 1.0, 0.3], [0.1, 0.3, 1.0]]), np.array([0.9, 0.1, 0.2])
    w = blend.simplex_weights(s, t, 0.01)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    value = lambda v: v @ s @ v - 2 * t @ v + 0.01 * ((v - 1 / 3) ** 2).sum()
    grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
    assert value(w) <= min(map(value, grid)) + 1e-9


def test_logistic_fits_agree(spark, sf):
    rows = pit(spark, sf)
    w = cal.fit_logistic(rows, "y", {"z": logit(F.col("p2"))})
    got = cal.platt(rows, [], "y", logit(F.col("p2"))).first()
    assert got["a"] == pytest.approx(min(max(w["z"], 0.3), 2.0), abs=1e-4)


def test_isotonic_is_monotone(spark, sf):
    rows = pit(spark, sf)
    out = cal.apply_isotonic(cal.isotonic(rows, "y", "p"), rows, "p").groupBy("p").agg(F.max("calibrated").alias("q")).orderBy("p")
    q = [r["q"] for r in out.collect()]
    assert q == sorted(q)


def test_shift_reaches_the_target(spark, sf):
    from foretally.functions.rates import sigmoid
    rows = pit(spark, sf)
    c = cal.shift_to_mean(rows, "p", 0.4).first()["shift"]
    assert rows.agg(F.avg(sigmoid(logit(F.col("p")) + c))).first()[0] == pytest.approx(0.4)


def test_folds(spark, sf):
    rows = pit(spark, sf)
    folds = model.grouped_folds(rows, "game", 4)
    assert folds.groupBy("game").count().filter("count > 1").isEmpty()
    size = [r["n"] for r in rows.join(folds, "game").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(size) == 4 and max(size) - min(size) < 0.05 * sum(size)
    parts = model.forward_folds(rows, "season", [2000, 2001])
    assert parts.filter("part = 'train' AND season >= fold").isEmpty()


def test_segment_without_rows_raises(spark, sf):
    rows = pit(spark, sf)
    with pytest.raises(ValueError):
        model.segmented_experts(rows.filter("hand = 'F'"), rows, "hand", ["F", "O"], ["qty"], "y")


def test_config_scores_and_safe_types(spark, points):
    reg = spark.createDataFrame([("x", 1, 12, 0.3, 0.8), ("x", 2, 4, 0.5, 0.6), ("y", 1, 20, 0.9, 0.9)],
                                "config string, cutoff int, min_size int, silhouette double, ari double")
    top = cl.config_scores(reg, "config").collect()
    assert [r["config"] for r in top] == ["y", "x"]
    assert top[1]["score"] == pytest.approx(0.4 + 0.25 * 0.7 + 0.02 * 4)
    typed = cl.safe_types(points.withColumn("n", F.col("id")), "n", ["a", "b"], 3, 20, 1)
    assert typed.filter("n < 20 AND type <> -1").isEmpty() and typed.count() == 120
