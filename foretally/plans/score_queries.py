"""Evaluation, calibration, blending and correction of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions.rates import logit, sigmoid
from foretally.operators import blend, calibrate as cal, joins, metrics
from foretally.plans.bindings import LATEST, PAST, LAST_SEASON, pit
from foretally.plans.catalog import query
from foretally.plans.eb_queries import TE_KEYS

KEY_SQL = "season, day, game, ctx, opp, entity"
MODELS = ["p", "p2", "p3"]
P3 = "(p + p2) / 2"
# A small shift keeps metrics off exact rounding ties, on which the order of float sums would decide.
SHIFT = "p + 0.00013e0"
B = f"b AS (SELECT * REPLACE ({SHIFT} AS p), {P3} p3 FROM pit)"


def rows3(spark, sf):
    return pit(spark, sf).withColumn("p3", F.expr(P3)).withColumn("p", F.expr(SHIFT))


def lg(p: str) -> str:
    return f"ln(({p}) / (1 - ({p})))"


def sg(z: str) -> str:
    return f"(1 / (1 + exp(-({z}))))"


LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{m}' model, {KEY_SQL}, hand, y, {m} v FROM b" for m in MODELS) + ")"
AUC_SQL = """au AS (SELECT {k}, (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) auc FROM
 (SELECT {k}, y, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 ar FROM l) GROUP BY {k}),
ce AS (SELECT {k}, v, count(*) n, sum(y) pos FROM l GROUP BY {k}, v),
cu AS (SELECT *, sum(pos) OVER w tp, sum(n) OVER w al FROM ce WINDOW w AS (PARTITION BY {k} ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT {k}, sum(pos * tp / al) / sum(pos) ap FROM cu GROUP BY {k}),
bi AS (SELECT {k}, CASE {bins} ELSE 9 END bin, sum(n) n, sum(v * n) / sum(n) mp, sum(pos) / sum(n) r FROM ce GROUP BY ALL),
ec AS (SELECT {k}, sum(n * abs(r - mp)) / sum(n) ece FROM bi GROUP BY {k}),
ba AS (SELECT {k}, count(*) n, avg(y) base, -avg(y * ln(v) + (1 - y) * ln(1 - v)) logloss, avg(pow(v - y, 2)) brier FROM l GROUP BY {k})"""
BINS = " ".join(f"WHEN v < {i * 0.1!r} THEN {i - 1}" for i in range(1, 10))


def scores_sql(k: str) -> str:
    return AUC_SQL.replace("{k}", k).replace("{bins}", BINS)


@query("probability_scores", "E3", "model:s n:i base:d auc:d ap:d logloss:d brier:d ece:d", f"""
WITH {B}, {LONG}, {scores_sql('model')}
SELECT model, n, base, auc, ap, logloss, brier, ece FROM ba JOIN au USING (model) JOIN ap USING (model) JOIN ec USING (model)""")
def probability_scores(spark, sf):
    """AUC, average precision, log loss, Brier and calibration error per model."""
    return metrics.probability_scores(metrics.long_forecasts(rows3(spark, sf), ["y"], MODELS), ["model"], "y", "p")


@query("skill_variants", "E4", "season:i n:i rate:d pred_mean:d offset:d brier:d normalized_brier:d bss_raw:d4 bss_floored:d4 bss_centered:d4 bss_norm:d", """
WITH m AS (SELECT season, avg(y) rate, avg(p) pm FROM pit GROUP BY 1),
g AS (SELECT season, any_value(rate) rate, any_value(pm) pred_mean, count(*) n, avg(pow(p - y, 2)) brier, avg(pow(least(greatest(p - (pm - rate), 1e-6), 1 - 1e-6) - y, 2)) bc FROM pit JOIN m USING (season) GROUP BY 1)
SELECT season, n, rate, pred_mean, pred_mean - rate AS "offset", brier, brier / (rate * (1 - rate)) normalized_brier, 1e5 * (1 - brier / (rate * (1 - rate))) bss_raw,
 greatest(1e5 * (1 - brier / (rate * (1 - rate))), 0) bss_floored, 1e5 * (1 - bc / (rate * (1 - rate))) bss_centered, 1e3 * (1 - brier / (rate * (1 - rate))) bss_norm FROM g""")
def skill_variants(spark, sf):
    """Raw, floored, centred and normalised Brier skill per season."""
    return metrics.skill_variants(pit(spark, sf), ["season"], "y", "p")


@query("baseline_scores", "E5", "model:s n:i base:d auc:d ap:d logloss:d brier:d ece:d", f"""
WITH tr AS (SELECT * FROM pit WHERE season < {LAST_SEASON}), m AS (SELECT avg(y) m FROM tr), c AS (SELECT ctx, hand, avg(y) v FROM tr GROUP BY 1, 2),
e AS (SELECT entity, (sum(y) + 200 * any_value(m)) / (count(*) + 200) v FROM tr, m GROUP BY 1), t AS (SELECT * FROM pit WHERE season = {LAST_SEASON}),
l AS (SELECT 'league_mean' model, y, m v FROM t, m UNION ALL SELECT 'context_only', y, coalesce(c.v, m) FROM t LEFT JOIN c USING (ctx, hand), m
 UNION ALL SELECT 'entity_encoding', y, coalesce(e.v, m) FROM t LEFT JOIN e USING (entity), m), {scores_sql('model')}
SELECT model, n, base, auc, ap, logloss, brier, ece FROM ba JOIN au USING (model) JOIN ap USING (model) JOIN ec USING (model)""")
def baseline_scores(spark, sf):
    """League mean, context lookup and entity encoding on the last season."""
    rows = pit(spark, sf)
    return metrics.baselines(rows.filter(PAST), rows.filter(LATEST),
                             "y", ["ctx", "hand"], "entity", 200.0)


@query("segment_scores", "E6", "model:s season:i segment:s n:i rate:d brier:d bss:d4 delta:d4 share:d", f"""
WITH {B}, {LONG}, g AS (SELECT model, season, coalesce(hand, 'ALL') segment, count(*) n, avg(y) rate, avg(pow(y - v, 2)) brier FROM l GROUP BY GROUPING SETS ((model, season), (model, season, hand))),
s AS (SELECT *, 1e5 * (1 - brier / (rate * (1 - rate))) bss FROM g)
SELECT s.*, s.bss - x.bss AS delta, s.n / t.n share FROM s JOIN s x ON x.model = 'p' AND x.season = s.season AND x.segment = s.segment
 JOIN s t ON t.model = s.model AND t.season = s.season AND t.segment = 'ALL'""")
def segment_scores(spark, sf):
    """Skill of every model by season and segment against a baseline."""
    return metrics.segment_scores(rows3(spark, sf), "y", MODELS, "p", "season", "hand")


@query("grouped_residual_audit", "E7", "dim:s level:s n:i rate:d gap:d brier_before:d brier_after:d delta:d8", f"WITH {B} " + " UNION ALL ".join(
    f"""SELECT '{c}' dim, CAST({c} AS VARCHAR) AS "level", count(*) n, avg(y) rate, avg(p - y) gap, avg(pow(p - y, 2)) brier_before, avg(pow(p3 - y, 2)) brier_after,
 avg(pow(p3 - y, 2)) - avg(pow(p - y, 2)) AS delta FROM b GROUP BY {c} HAVING count(*) >= 2000""" for c in ("season", "hand", "ctx", "month")))
def grouped_residual_audit(spark, sf):
    """Gap and Brier before and after a change per level of several dimensions."""
    return metrics.grouped_delta(rows3(spark, sf), ["season", "hand", "ctx", "month"], "y", "p", "p3", 2000)


@query("gain_decomposition", "E8", "ctx:i n:i delta:d8 share:d contribution:d8 share_of_gain:d4", f"""
WITH {B}, g AS (SELECT ctx, count(*) n, avg(pow(p3 - y, 2) - pow(p - y, 2)) d FROM b GROUP BY 1)
SELECT ctx, n, d AS delta, n / sum(n) OVER () share, n / sum(n) OVER () * d contribution, n * d / sum(n * d) OVER () share_of_gain FROM g""")
def gain_decomposition(spark, sf):
    """Contribution of each group to the total change."""
    return metrics.gain_decomposition(rows3(spark, sf), "ctx", "y", "p", "p3")


def honest_sql(key: str) -> str:
    k = f"{key}, " if key else ""
    on = f"b.h = f.h AND b.{key} = f.{key}" if key else "b.h = f.h"
    return f"""(SELECT avg(pow(p - y, 2) - pow(least(greatest(p + coalesce(o, 0), 1e-6), 1 - 1e-6) - y, 2)) FROM b LEFT JOIN
 (SELECT {k}1 - h h, avg(y - p) o FROM b GROUP BY ALL HAVING count(*) >= 100) f ON {on})"""


@query("slice_residual_test", "E9", "cells:i ratio:d4 max_abs_z:d4 global_resid:d8 oracle_bss:d4 honest_slice:d4 honest_global:d4 honest_net:d4", f"""
WITH b AS (SELECT *, month % 2 h FROM pit), gr AS (SELECT avg(y - p) g, count(*) t, avg(y) * (1 - avg(y)) nv FROM b),
c AS (SELECT entity, count(*) n, avg(y - p) r, avg(p * (1 - p)) v FROM b GROUP BY 1 HAVING count(*) >= 200),
z AS (SELECT *, (r - g) / sqrt(v / n) z FROM c, gr), hs AS (SELECT {honest_sql('entity')} a, {honest_sql('')} g0)
SELECT count(*) AS cells, avg(z * z) ratio, max(abs(z)) max_abs_z, any_value(g) global_resid, 1e5 * sum(n * pow(r - g, 2)) / any_value(t) / any_value(nv) oracle_bss,
 1e5 * any_value(a) / any_value(nv) honest_slice, 1e5 * any_value(g0) / any_value(nv) honest_global, 1e5 * (any_value(a) - any_value(g0)) / any_value(nv) honest_net FROM z, hs""")
def slice_residual_test(spark, sf):
    """Residual structure of a slicing with a global-offset control."""
    return metrics.slice_residual(pit(spark, sf), "entity", "y", "p", F.col("month") % 2 == 1, 200)


@query("paired_significance", "E10", "season:i n:i mean_gain:d8 se:d8 t:d4", f"""
WITH {B}, d AS (SELECT season, pow(p - y, 2) - pow(p3 - y, 2) d FROM b)
SELECT season, count(*) n, avg(d) mean_gain, stddev_samp(d) / sqrt(count(*)) se, avg(d) / (stddev_samp(d) / sqrt(count(*))) t FROM d GROUP BY 1""")
def paired_significance(spark, sf):
    """t statistic of the squared-error difference."""
    return metrics.paired_test(rows3(spark, sf), ["season"], "y", "p", "p3")


SEEDS = "SELECT season, y, seed, p + 0.002 * ((game * (seed + 3) + ctx) % 7 - 3) q, ctx, day, game, opp, entity, hand FROM pit, (VALUES (0), (1), (2), (3)) s(seed)"


def seeded(spark, sf):
    rows = pit(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return rows.withColumn("q", F.col("p") + 0.002 * ((F.col("game") * (F.col("seed") + 3) + F.col("ctx")) % 7 - 3))


@query("seed_noise_floor", "E11", "season:i seeds:i mean:d4 sd:d4 low:d4 high:d4 spread:d4 threshold:d4", f"""
WITH l AS ({SEEDS}), s AS (SELECT season, seed, 1e5 * (1 - avg(pow(y - q, 2)) / (avg(y) * (1 - avg(y)))) bss FROM l GROUP BY 1, 2)
SELECT season, count(*) seeds, avg(bss) mean, stddev_samp(bss) sd, min(bss) low, max(bss) high, max(bss) - min(bss) spread, 1.5 * stddev_samp(bss) threshold FROM s GROUP BY 1""")
def seed_noise_floor(spark, sf):
    """Spread of the skill over seeds per season."""
    return metrics.noise_floor(seeded(spark, sf), "season", "seed", "y", "q")


@query("threshold_selection", "E12", "threshold:d f1:d precision:d recall:d accuracy:d predicted_rate:d", f"""
WITH b AS (SELECT *, {P3} q FROM pit), th AS (SELECT DISTINCT unnest(quantile_cont(q, [{', '.join(repr(0.30 + 0.65 * i / 59) for i in range(60))}])) t FROM b WHERE season = 2000),
v AS (SELECT t, coalesce(2.0 * sum((q >= t)::INT * y) / nullif(2 * sum((q >= t)::INT * y) + sum((q >= t)::INT * (1 - y)) + sum((q < t)::INT * y), 0), 0) f1 FROM b, th WHERE season = 2000 GROUP BY 1),
s AS (SELECT t FROM v ORDER BY f1 DESC, t LIMIT 1)
SELECT t threshold, 2.0 * sum((q >= t)::INT * y) / (2 * sum((q >= t)::INT * y) + sum((q >= t)::INT * (1 - y)) + sum((q < t)::INT * y)) f1, sum((q >= t)::INT * y) / sum((q >= t)::INT) AS precision,
 sum((q >= t)::INT * y) / sum(y) recall, avg(((q >= t)::INT = y)::INT) accuracy, avg((q >= t)::INT) predicted_rate FROM b, s WHERE season = {LAST_SEASON} GROUP BY 1""")
def threshold_selection(spark, sf):
    """F1-best threshold of one season scored on the next."""
    rows = pit(spark, sf).withColumn("q", F.expr(P3)).filter("season >= 2000")
    return metrics.threshold_table(rows, F.col("season") == 2000, "y", "q")


SCALES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5]


@query("correction_scale_grid", "E13", "season:i scale:d delta:d8", f"""
WITH m AS (SELECT season, avg((p - y) * (p2 - p)) ec, avg(pow(p2 - p, 2)) cc FROM pit GROUP BY 1)
SELECT season, s AS "scale", 2 * s * ec + s * s * cc AS delta FROM m, (VALUES {', '.join(f'({s}::DOUBLE)' for s in SCALES)}) t(s)""")
def correction_scale_grid(spark, sf):
    """Brier change over a scale grid from sufficient statistics."""
    rows = pit(spark, sf).withColumn("c", F.col("p2") - F.col("p"))
    return metrics.scale_grid(metrics.correction_moments(rows, ["season"], "y", "p", ["c"]), "c", SCALES)


@query("constrained_choice", "O5 O4 E13", "scale:d objective:d8 all_improve:i", f"""
WITH m AS (SELECT season, avg((p - y) * (p2 - p)) ec, avg(pow(p2 - p, 2)) cc FROM pit GROUP BY 1),
g AS (SELECT s, avg(2 * s * ec + s * s * cc) o, max(2 * s * ec + s * s * cc) w FROM m, (VALUES {', '.join(f'({s}::DOUBLE)' for s in SCALES)}) t(s) GROUP BY 1)
SELECT s AS "scale", o objective, (w < 0)::INT all_improve FROM g ORDER BY (w >= 0)::INT, o, s LIMIT 1""")
def constrained_choice(spark, sf):
    """Best scale among those that improve everywhere, else among all."""
    rows = pit(spark, sf).withColumn("c", F.col("p2") - F.col("p"))
    grid = metrics.scale_grid(metrics.correction_moments(rows, ["season"], "y", "p", ["c"]), "c", SCALES)
    return metrics.constrained_best(grid, "scale", "season")


@query("pair_weight", "E14", "season:i weight:d", """
SELECT season, least(greatest(sum((y - p) * (p2 - p)) / sum(pow(p2 - p, 2)), 0), 1) weight FROM pit GROUP BY 1""")
def pair_weight(spark, sf):
    """Optimal weight between two forecasts per season."""
    return metrics.pair_weight(pit(spark, sf), ["season"], "y", "p", "p2")


@query("bucket_blend_weights", "E15", "bucket:i base:d w_p:d w_p2:d", """
WITH b AS (SELECT *, CASE WHEN qty < 15 THEN 0 WHEN qty < 35 THEN 1 ELSE 2 END bucket FROM pit), r AS (SELECT bucket, avg(y) r FROM b GROUP BY 1),
m AS (SELECT bucket, any_value(r) r, avg((p - r) * (p - r)) a, avg((p - r) * (p2 - r)) c, avg((p2 - r) * (p2 - r)) d, avg((p - r) * (y - r)) u, avg((p2 - r) * (y - r)) v FROM b JOIN r USING (bucket) GROUP BY 1)
SELECT bucket, r AS base, (d * u - c * v) / (a * d - c * c) w_p, (a * v - c * u) / (a * d - c * c) w_p2 FROM m""")
def bucket_blend_weights(spark, sf):
    """Closed-form centred weights per volume bucket."""
    from foretally.functions.buckets import digitize
    rows = pit(spark, sf).withColumn("bucket", digitize(F.col("qty"), [15, 35]))
    return blend.centred_weights(blend.second_moments(rows, ["bucket"], "y", ["p", "p2"]), ["bucket"], ["p", "p2"])


@query("bucket_blend_scores", "E15 E4", "bucket:i n:i rate:d brier:d bss:d4", """
WITH b AS (SELECT *, CASE WHEN qty < 15 THEN 0 WHEN qty < 35 THEN 1 ELSE 2 END bucket FROM pit), r AS (SELECT bucket, avg(y) r FROM b GROUP BY 1),
m AS (SELECT bucket, any_value(r) r, avg((p - r) * (p - r)) a, avg((p - r) * (p2 - r)) c, avg((p2 - r) * (p2 - r)) d, avg((p - r) * (y - r)) u, avg((p2 - r) * (y - r)) v FROM b JOIN r USING (bucket) GROUP BY 1),
q AS (SELECT bucket, y, r + (d * u - c * v) / (a * d - c * c) * (p - r) + (a * v - c * u) / (a * d - c * c) * (p2 - r) q FROM b JOIN m USING (bucket))
SELECT bucket, count(*) n, avg(y) rate, avg(pow(y - q, 2)) brier, 1e5 * (1 - avg(pow(y - q, 2)) / (avg(y) * (1 - avg(y)))) bss FROM q GROUP BY 1""")
def bucket_blend_scores(spark, sf):
    """Skill of the bucketed blend."""
    from foretally.functions.buckets import digitize
    rows = pit(spark, sf).withColumn("bucket", digitize(F.col("qty"), [15, 35]))
    w = blend.centred_weights(blend.second_moments(rows, ["bucket"], "y", ["p", "p2"]), ["bucket"], ["p", "p2"])
    return metrics.skill(blend.apply_centred(rows, w, ["bucket"], ["p", "p2"]), ["bucket"], "y", "blend")


@query("simplex_blend", "E16", "season:i n:i brier:d8", f"""
WITH c AS (SELECT avg(pow(p - p2, 2)) d, avg((y - p2) * (p - p2)) u FROM pit), w AS (SELECT least(greatest((u + 0.001) / (d + 0.002), 0), 1) w FROM c)
SELECT season, count(*) n, avg(pow(w * p + (1 - w) * p2 - y, 2)) brier FROM pit, w GROUP BY 1""")
def simplex_blend(spark, sf):
    """Simplex weights with an L2 pull to equal weights, scored by season."""
    rows = pit(spark, sf)
    w = blend.simplex_blend(rows, "y", ["p", "p2"], 0.001)
    mix = F.lit(w["p"]) * F.col("p") + F.lit(w["p2"]) * F.col("p2")
    return metrics.skill(rows.withColumn("q", mix), ["season"], "y", "q")


@query("greedy_ensemble", "E17", "step:i member:s brier:d8", f"""
WITH {B}, s1 AS (SELECT unnest([{', '.join(f"{{'m': '{m}', 'b': avg(pow({m} - y, 2))}}" for m in MODELS)}]) r FROM b), f1 AS (SELECT r.m m1, r.b b1 FROM s1 ORDER BY r.b, r.m LIMIT 1),
x1 AS (SELECT *, CASE m1 WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE p3 END a FROM b, f1),
s2 AS (SELECT unnest([{', '.join(f"{{'m': '{m}', 'b': avg(pow((a + {m}) / 2 - y, 2))}}" for m in MODELS)}]) r FROM x1), f2 AS (SELECT r.m m2, r.b b2 FROM s2 ORDER BY round(r.b, 14), r.m LIMIT 1)
SELECT 1 step, m1 AS member, b1 brier FROM f1 UNION ALL SELECT 2, m2, b2 FROM f2""")
def greedy_ensemble(spark, sf):
    """Greedy selection with replacement from the moment matrix."""
    trail = blend.greedy_members(rows3(spark, sf), "y", MODELS, 2)
    return spark.createDataFrame([(t["step"], t["member"], t["brier"]) for t in trail], "step int, member string, brier double")


@query("diverse_members", "E18", "rank:i member:s", f"""
WITH {B}, s AS (SELECT unnest([{', '.join(f"{{'m': '{m}', 'b': avg(pow({m} - y, 2))}}" for m in MODELS)}]) r FROM b), o AS (SELECT r.m m, row_number() OVER (ORDER BY r.b, r.m) k FROM s),
c AS (SELECT abs(corr(CASE o1.m WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE p3 END - y, CASE o2.m WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE p3 END - y)) r12,
 abs(corr(CASE o1.m WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE p3 END - y, CASE o3.m WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE p3 END - y)) r13 FROM b, (SELECT m FROM o WHERE k = 1) o1, (SELECT m FROM o WHERE k = 2) o2, (SELECT m FROM o WHERE k = 3) o3)
SELECT 1 AS "rank", m AS member FROM o WHERE k = 1 UNION ALL SELECT 2, CASE WHEN r12 <= 0.996 THEN (SELECT m FROM o WHERE k = 2) WHEN r13 <= 0.996 THEN (SELECT m FROM o WHERE k = 3) ELSE (SELECT m FROM o WHERE k = 2) END FROM c""")
def diverse_members(spark, sf):
    """Members by Brier whose residuals are not too alike."""
    chosen = blend.diverse_members(rows3(spark, sf), "y", MODELS, 2, 0.996)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, member string")


@query("bucket_weight_blend", "E19 J1", TE_KEYS + " blend:d", f"""
WITH b AS (SELECT *, CASE WHEN qty < 10 THEN 0 WHEN qty < 20 THEN 1 WHEN qty < 40 THEN 2 ELSE 3 END bk FROM pit)
SELECT {KEY_SQL}, coalesce(w, 0.5) * p + (1 - coalesce(w, 0.5)) * p2 AS blend FROM b LEFT JOIN (VALUES (0, 0.1), (1, 0.3), (2, 0.8)) t(k, w) ON k = bk""")
def bucket_weight_blend(spark, sf):
    """Weighted pair of forecasts by volume bucket with a default."""
    from foretally.functions.buckets import digitize
    rows = pit(spark, sf).withColumn("bucket", digitize(F.col("qty"), [10, 20, 40]))
    w = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.8)], "bucket int, weight double")
    return metrics.bucket_blend(rows, "bucket", w, "p", "p2")


@query("seed_model_average", "E20", TE_KEYS + " p:d", f"""
WITH l AS (SELECT *, seed % 2 mem FROM ({SEEDS})), s AS (SELECT {KEY_SQL}, mem, avg(q) q FROM l GROUP BY ALL), w AS (SELECT *, CASE mem WHEN 0 THEN 0.7 ELSE 0.3 END w FROM s)
SELECT {KEY_SQL}, {sg('sum(w * ' + lg('q') + ') / sum(w)')} p FROM w GROUP BY ALL""")
def seed_model_average(spark, sf):
    """Mean over seeds, then weighted mean over members on the logit scale."""
    rows = seeded(spark, sf).withColumn("member", (F.col("seed") % 2).cast("string"))
    return metrics.averaged(rows, KEY_SQL.split(", "), "member", "q", {"0": 0.7, "1": 0.3}, "logit")


@query("composed_probability", "E21", TE_KEYS + " composed:d chained:d", f"""
SELECT {KEY_SQL}, 1 - (p + p2 - p * p2 + 0.01 + 0.02) - 0.005 composed, p * p2 + (1 - p) * 0.3 chained FROM pit""")
def composed_probability(spark, sf):
    """Inclusion-exclusion and chained composition of component probabilities."""
    a, b = F.col("p"), F.col("p2")
    return pit(spark, sf).withColumns({"composed": 1 - (a + b - a * b + 0.01 + 0.02) - 0.005,
                                       "chained": a * b + (1 - a) * 0.3})


@query("composition_coefficients", "E22", "part:s coefficient:d", """
WITH m AS (SELECT avg(p) a, avg(p2) b, avg(1 - y) f, covar_pop(p, p) pp, covar_pop(p, p2) pq, covar_pop(p2, p2) qq, covar_pop(p, 1 - y) py, covar_pop(p2, 1 - y) qy FROM pit WHERE season < 2001),
w AS (SELECT *, (qq * py - pq * qy) / (pp * qq - pq * pq) c1, (pp * qy - pq * py) / (pp * qq - pq * pq) c2 FROM m)
SELECT 'p' part, c1 coefficient FROM w UNION ALL SELECT 'p2', c2 FROM w UNION ALL SELECT 'intercept', f - c1 * a - c2 * b FROM w""")
def composition_coefficients(spark, sf):
    """Least-squares composition of component probabilities on past rows."""
    rows = pit(spark, sf).filter(PAST).withColumn("f", 1 - F.col("y"))
    return spark.createDataFrame(list(blend.composition_coefficients(rows, "f", ["p", "p2"]).items()), "part string, coefficient double")


def offset_newton_sql(cells: str, keys: str, steps: int, ridge: float, groups: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    out = [f"s0 AS (SELECT {k}0.0::DOUBLE c FROM {cells} {'GROUP BY ' + keys if keys else 'LIMIT 1'})"]
    for i in range(steps):
        q = sg("z + c")
        out.append(f"""s{i + 1} AS (SELECT {k}any_value(c) - (sum(2 * q * (1 - q) * (n * q - k)) / (SELECT count(*) FROM pit) + {2 * ridge} / ({groups}) * any_value(c)) /
 (sum(2 * (n * pow(q * (1 - q), 2) + (n * q - k) * q * (1 - q) * (1 - 2 * q))) / (SELECT count(*) FROM pit) + {2 * ridge} / ({groups})) c
 FROM (SELECT {cells}.*, c, {q} q FROM {cells} JOIN s{i} {using}) {'GROUP BY ' + keys if keys else ''})""")
    return ", ".join(out)


@query("logit_shift_fit", "E23", "offset:d", f"""
WITH ce AS (SELECT {lg('p')} z, count(*) n, sum(y) k FROM pit GROUP BY 1), {offset_newton_sql('ce', '', 10, 0.0, '1')} SELECT c AS "offset" FROM s10""")
def logit_shift_fit(spark, sf):
    """Brier-best constant logit shift."""
    return cal.brier_offsets(pit(spark, sf), [], "y", "p")


@query("cohort_offsets", "E23", "ctx:i offset:d", f"""
WITH ce AS (SELECT ctx, {lg('p')} z, count(*) n, sum(y) k FROM pit GROUP BY 1, 2), {offset_newton_sql('ce', 'ctx', 12, 0.001, '7.0')} SELECT ctx, c AS "offset" FROM s12""")
def cohort_offsets(spark, sf):
    """Ridge-penalised Brier offsets per cohort."""
    return cal.brier_offsets(pit(spark, sf), ["ctx"], "y", "p", 0.001)


def platt_sql(keys: str, steps: int = 14, cells: str = "ce", tag: str = "s") -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    out = [f"{tag}0 AS (SELECT {k}1.0::DOUBLE a, 0.0::DOUBLE b FROM {cells} {'GROUP BY ' + keys if keys else 'LIMIT 1'})"]
    for i in range(steps):
        out.append(f"""{tag}{i + 1} AS (SELECT {k}a + ((h + 1e-6) * gz - hz * g) / ((hzz + 1e-6) * (h + 1e-6) - hz * hz) a, b + ((hzz + 1e-6) * g - hz * gz) / ((hzz + 1e-6) * (h + 1e-6) - hz * hz) b
 FROM (SELECT {k}any_value(a) a, any_value(b) b, sum(z * (k - n * q)) gz, sum(k - n * q) g, sum(z * z * n * q * (1 - q)) hzz, sum(z * n * q * (1 - q)) hz, sum(n * q * (1 - q)) h
 FROM (SELECT {cells}.*, a, b, {sg('a * z + b')} q FROM {cells} JOIN {tag}{i} {using}) {'GROUP BY ' + keys if keys else ''}))""")
    return ", ".join(out)


@query("platt_fit", "E23", "a:d b:d", f"""
WITH ce AS (SELECT {lg('p2')} z, count(*) n, sum(y) k FROM pit GROUP BY 1), {platt_sql('')} SELECT least(greatest(a, 0.3), 2.0) a, least(greatest(b, -0.6), 0.6) b FROM s14""")
def platt_fit(spark, sf):
    """Global slope and intercept on the logit."""
    return cal.platt(pit(spark, sf), [], "y", logit(F.col("p2")))


def beta_sql(steps: int) -> str:
    """Newton steps of a three-weight logistic fit, each solved by Cramer's rule."""
    out = ["s0 AS (SELECT 0.0::DOUBLE w0, 0.0::DOUBLE w1, 0.0::DOUBLE w2)"]
    x = ["lp", "lq", "1.0"]
    for i in range(steps):
        sums = ", ".join(f"sum({x[j]} * (k - n * q)) g{j}" for j in range(3)) + ", " + ", ".join(
            f"sum({x[a]} * {x[b]} * n * q * (1 - q)) h{a}{b}" for a in range(3) for b in range(a, 3))
        h = lambda a, b: f"h{min(a, b)}{max(a, b)}"
        col = lambda c, r, j: f"g{r}" if c == j else h(r, c)
        det = lambda j: " + ".join(
            f"({sgn}) * {col(p[0], 0, j)} * {col(p[1], 1, j)} * {col(p[2], 2, j)}" for p, sgn in (
                ((0, 1, 2), 1), ((1, 2, 0), 1), ((2, 0, 1), 1), ((0, 2, 1), -1), ((1, 0, 2), -1), ((2, 1, 0), -1)))
        out.append(f"""s{i + 1} AS (SELECT {', '.join(f'w{j} + ({det(j)}) / ({det(9)}) w{j}' for j in range(3))} FROM
 (SELECT any_value(w0) w0, any_value(w1) w1, any_value(w2) w2, {sums} FROM (SELECT ce.*, w0, w1, w2, {sg('w0 * lp + w1 * lq + w2')} q FROM ce, s{i})))""")
    return ", ".join(out)


@query("beta_calibration", "E23", "n:i brier:d logloss:d", f"""
WITH ce AS (SELECT ln(p2) lp, ln(1 - p2) lq, count(*) n, sum(y) k FROM pit WHERE season < {LAST_SEASON} GROUP BY 1, 2), {beta_sql(9)},
v AS (SELECT y, {sg('w0 * ln(p2) + w1 * ln(1 - p2) + w2')} q FROM pit, s9 WHERE season = {LAST_SEASON})
SELECT count(*) n, avg(pow(q - y, 2)) brier, -avg(y * ln(q) + (1 - y) * ln(1 - q)) logloss FROM v""")
def beta_calibration(spark, sf):
    """Beta calibration fitted on past seasons and scored on the last."""
    rows = pit(spark, sf)
    f = cal.beta_features("p2")
    w = cal.fit_logistic(rows.filter(PAST), "y", f)
    out = rows.filter(LATEST).withColumn("q", cal.apply_logistic(w, f))
    return metrics.probability_scores(out, [], "y", "q")


@query("segment_platt", "E24", "ctx:i a:d b:d", f"""
WITH fit AS (SELECT *, {lg('p2')} - avg({lg('p2')}) OVER () z0 FROM pit WHERE season < {LAST_SEASON}), cg AS (SELECT z0 z, count(*) n, sum(y) k FROM fit GROUP BY 1), cl AS (SELECT ctx, z0 z, count(*) n, sum(y) k FROM fit WHERE ctx IN (SELECT ctx FROM fit GROUP BY 1 HAVING count(*) >= 1000) GROUP BY 1, 2),
{platt_sql('', 14, 'cg', 'g')}, {platt_sql('ctx', 14, 'cl', 'l')},
gl AS (SELECT least(greatest(a, 0.3), 2.0) a, least(greatest(b, -0.6), 0.6) b FROM g14), lo AS (SELECT ctx, least(greatest(a, 0.3), 2.0) a, least(greatest(b, -0.6), 0.6) b FROM l14)
SELECT ctx, 1 + 0.25 * (lo.a - gl.a) a, 0.25 * (lo.b - gl.b) b FROM lo, gl""")
def segment_platt(spark, sf):
    """Segment calibration moved a quarter of the way from the global one."""
    rows = pit(spark, sf).filter(PAST)
    z = logit(F.col("p2"))
    rows = rows.withColumn("z0", F.round(z - rows.agg(F.avg(z)).scalar(), 12))
    return cal.shrunk_platt(rows, ["ctx"], "y", F.col("z0"), 0.25, 1000)


@query("walk_forward_rate", "E25", TE_KEYS + " calibrated:d", f"""
WITH c AS (SELECT season, sum(y) k, sum(p) sp, count(*) n FROM pit GROUP BY 1), g AS (SELECT t season, {lg('sum(k) / sum(n)')} - {lg('sum(sp) / sum(n)')} gap FROM c, (VALUES (1999), (2000), (2001)) v(t) WHERE season < t GROUP BY 1)
SELECT {KEY_SQL}, {sg(lg('p') + ' + gap')} calibrated FROM pit JOIN g USING (season)""")
def walk_forward_rate(spark, sf):
    """Seasons moved by the earlier seasons' mean logit gap."""
    return cal.walk_forward_rate(pit(spark, sf), "season", "y", "p", [1999, 2000, 2001])


# Isotonic least squares is the max over starts of the min over ends of weighted means.
ISO = """t AS (SELECT * FROM (VALUES (2000), (2001)) v(t)), c AS (SELECT t, p3 x, count(*) w, sum(y) s FROM b, t WHERE season < t GROUP BY 1, 2),
r AS (SELECT t, x, row_number() OVER o i, sum(w) OVER o cw, sum(s) OVER o cs, w, s FROM c WINDOW o AS (PARTITION BY t ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT a.t, a.i ai, z.i zi, (z.cs - a.cs + a.s) / (z.cw - a.cw + a.w) v FROM r a JOIN r z ON a.t = z.t AND z.i >= a.i),
k AS (SELECT t, ai, i, min(v) v FROM m JOIN (SELECT DISTINCT i FROM r) q ON q.i >= ai AND zi >= q.i GROUP BY 1, 2, 3), g AS (SELECT r.t, r.x, max(k.v) v FROM r JOIN k ON k.t = r.t AND k.i = r.i GROUP BY 1, 2)"""


@query("walk_forward_isotonic", "E25 E23", "season:i n:i rate:d brier:d", f"""
WITH {B}, {ISO} SELECT season, count(*) n, avg(y) rate, avg(pow(v - y, 2)) brier FROM b JOIN g ON g.t = season AND g.x = p3 GROUP BY 1""")
def walk_forward_isotonic(spark, sf):
    """Seasons calibrated by a monotone map of earlier seasons."""
    out = cal.walk_forward_isotonic(rows3(spark, sf), "season", "y", "p3", [2000, 2001])
    return metrics.skill(out, ["season"], "y", "calibrated")


@query("distribution_match", "E26", TE_KEYS + " prob_mean:d prob_mean_std:d logit_mean:d logit_mean_std:d", f"""
WITH m AS (SELECT avg(p) ps, avg(p2) pr, avg({lg('p')}) ls, avg({lg('p2')}) lr, stddev_pop(p) ss, stddev_pop(p2) sr, stddev_pop({lg('p')}) ts, stddev_pop({lg('p2')}) tr FROM pit)
SELECT {KEY_SQL}, p - ps + pr prob_mean, (p - ps) * (sr / ss) + pr prob_mean_std, {sg(lg('p') + ' - ls + lr')} logit_mean, {sg('(' + lg('p') + ' - ls) * (tr / ts) + lr')} logit_mean_std FROM pit, m""")
def distribution_match(spark, sf):
    """Forecasts moved to another's mean and spread in two spaces."""
    return cal.matched(pit(spark, sf), "p", "p2")


@query("quantile_match", "E26", TE_KEYS + " quantile_match:d", f"""
WITH a AS (SELECT *, row_number() OVER (ORDER BY p, {KEY_SQL}) k FROM pit), b AS (SELECT p2 AS quantile_match, row_number() OVER (ORDER BY p2, {KEY_SQL}) k FROM pit)
SELECT {KEY_SQL}, quantile_match FROM a JOIN b USING (k)""")
def quantile_match(spark, sf):
    """Ranks of one forecast take the values of another."""
    return cal.quantile_matched(pit(spark, sf), KEY_SQL.split(", "), "p", "p2")


def mean_shift_sql(steps: int) -> str:
    out = ["s0 AS (SELECT 0.0::DOUBLE c)"]
    for i in range(steps):
        out.append(f"s{i + 1} AS (SELECT any_value(c) + sum(n * (0.33 - q)) / sum(n * q * (1 - q)) c FROM (SELECT n, c, {sg('z + c')} q FROM ce, s{i}))")
    return ", ".join(out)


@query("shift_to_mean", "E27", "shift:d", f"WITH ce AS (SELECT {lg('p')} z, count(*) n FROM pit GROUP BY 1), {mean_shift_sql(8)} SELECT c AS shift FROM s8")
def shift_to_mean(spark, sf):
    """Logit shift to a target mean."""
    return cal.shift_to_mean(pit(spark, sf), "p", 0.33)


@query("sharpen_and_cap", "E28", TE_KEYS + " sharpened:d capped:d", f"""
WITH m AS (SELECT avg({lg('p')}) mz, quantile_cont(p, 0.05) lo, quantile_cont(p, 0.95) hi FROM pit)
SELECT {KEY_SQL}, least(greatest({sg('(' + lg('p') + ' - mz) * 1.2 + ln(0.33 / 0.67)')}, 0.33 - 0.04), 0.33 + 0.04) sharpened, least(greatest(p, lo), hi) capped FROM pit, m""")
def sharpen_and_cap(spark, sf):
    """Logits scaled around a target with a cap, and a quantile cap."""
    return cal.capped(cal.sharpened(pit(spark, sf), "p", 0.33, 1.2, 0.04), "p", "quantile", 0.05)


TARGETS = [1998, 2000, 2001, 2002]


@query("base_rate_forecasts", "E29", "cutoff:i last:d drift:d linear:d linear3:d weighted:d median_step:d", f"""
WITH r AS (SELECT season, avg(y) r FROM pit GROUP BY 1), p AS (SELECT t cutoff, season, r, r - lag(r) OVER (PARTITION BY t ORDER BY season) d, row_number() OVER (PARTITION BY t ORDER BY season DESC) k FROM r, (VALUES {', '.join(f'({t})' for t in TARGETS)}) v(t) WHERE season < t)
SELECT cutoff, max_by(r, season) AS "last", least(greatest(max_by(r, season) + (max_by(r, season) - min_by(r, season)) / (max(season) - min(season)) * (cutoff - max(season)), 0.01), 0.99) drift,
 regr_intercept(r, season) + regr_slope(r, season) * cutoff linear, regr_intercept(CASE WHEN k <= 3 THEN r END, CASE WHEN k <= 3 THEN season END) + regr_slope(CASE WHEN k <= 3 THEN r END, CASE WHEN k <= 3 THEN season END) * cutoff linear3,
 max_by(r, season) + sum(pow(0.7, k - 1) * d) / sum(CASE WHEN d IS NOT NULL THEN pow(0.7, k - 1) END) weighted, max_by(r, season) + quantile_cont(d, 0.5) median_step FROM p GROUP BY 1""")
def base_rate_forecasts(spark, sf):
    """Next-season rate by five past-only rules."""
    return cal.rate_forecasts(pit(spark, sf), "season", "y", TARGETS)


def offsets_sql(keys: str, name: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {k}t cutoff, sum(n) n, CASE WHEN count(z) >= 2 THEN regr_intercept(z, x) + regr_slope(z, x) * t - max_by(z, x) END o FROM
 (SELECT {k}season x, count(*) n, CASE WHEN avg(y) > 0.001 AND avg(y) < 0.999 THEN {lg('avg(y)')} END z FROM pit GROUP BY ALL), (VALUES (2000), (2001)) v(t) WHERE x < t GROUP BY {k}t)"""


@query("segment_season_offsets", "E30", "hand:s ctx:i cutoff:i n:i offset:d global_offset:d", f"""
WITH {offsets_sql('', 'g')}, {offsets_sql('hand, ctx', 'l')}
SELECT hand, ctx, l.cutoff, l.n, CASE WHEN l.o IS NOT NULL AND l.n >= 200 THEN g.o + l.n / (l.n + 5000.0) * (l.o - g.o) ELSE g.o END AS "offset", g.o global_offset FROM l JOIN g USING (cutoff)""")
def segment_season_offsets(spark, sf):
    """Extrapolated logit offsets per segment, shrunk to the global one."""
    return cal.shrunk_offsets(pit(spark, sf), ["hand", "ctx"], "season", "y", [2000, 2001], 5000.0)


@query("additive_axis_offsets", "E42", TE_KEYS + " offset:d", f"""
WITH {offsets_sql('', 'g')}, {offsets_sql('hand', 'a')}, {offsets_sql('ctx', 'b')}, x AS (SELECT hand, a.n / (a.n + 5000.0) * (a.o - g.o) x FROM a JOIN g USING (cutoff) WHERE cutoff = 2001),
z AS (SELECT ctx, b.n / (b.n + 5000.0) * (b.o - g.o) z FROM b JOIN g USING (cutoff) WHERE cutoff = 2001)
SELECT {KEY_SQL}, (SELECT o FROM g WHERE cutoff = 2001) + x + z AS "offset" FROM pit JOIN x USING (hand) JOIN z USING (ctx) WHERE season = 2001""")
def additive_axis_offsets(spark, sf):
    """Global offset plus shrunk excess of two axes."""
    return cal.additive_offsets(pit(spark, sf), [["hand"], ["ctx"]], "season", "y", 2001, 5000.0)


GAPS = f"""c AS (SELECT season, avg(y) act, avg(tax0 * 8) ao FROM pit GROUP BY 1), ew AS (SELECT a.season, {', '.join(f"sum(pow(0.5, (a.season - b.season) / {l}.0) * b.act) / sum(pow(0.5, (a.season - b.season) / {l}.0)) e{l}" for l in (1, 2))} FROM c a JOIN c b ON b.season < a.season GROUP BY 1),
g AS (SELECT c.season, coalesce(l.act, 0.5) prior_last, coalesce(e1, 0.5) prior_ewm1, coalesce(e2, 0.5) prior_ewm2, CASE WHEN l.act IS NULL THEN 0 ELSE least(greatest({lg('l.act')} - {lg('l.ao')}, -0.5), 0.5) END gap_logit
 FROM c LEFT JOIN c l ON l.season = c.season - 1 LEFT JOIN ew ON ew.season = c.season)"""


@query("past_rate_gaps", "E31", "season:i prior_last:d prior_ewm1:d prior_ewm2:d gap_logit:d", f"WITH {GAPS} SELECT * FROM g")
def past_rate_gaps(spark, sf):
    """Past priors and the bounded logit gap per season."""
    rows = pit(spark, sf).withColumn("asof", F.col("tax0") * 8)
    return cal.past_rate_gaps(rows, "season", "y", "asof", 0.5)


@query("recalibrated_rates", "E31", TE_KEYS + " adjusted_last:d dynamic_last_200:d dynamic_ewm1_200:d adjusted_smoothed_200:d", f"""
WITH {GAPS}, r AS (SELECT pit.*, g.*, coalesce(tax0 * 8, prior_last) raw, opp % 300 cn FROM pit JOIN g USING (season)),
a AS (SELECT *, {sg("ln(least(greatest(raw, 1e-6), 1 - 1e-6) / (1 - least(greatest(raw, 1e-6), 1 - 1e-6))) + gap_logit")} adj FROM r)
SELECT {KEY_SQL}, adj adjusted_last, (raw * cn + prior_last * 200) / (cn + 200) dynamic_last_200, (raw * cn + prior_ewm1 * 200) / (cn + 200) dynamic_ewm1_200, (adj * cn + prior_last * 200) / (cn + 200) adjusted_smoothed_200 FROM a""")
def recalibrated_rates(spark, sf):
    """Cumulative rates moved by the past gap and smoothed to past priors."""
    rows = pit(spark, sf).withColumns({"asof": F.col("tax0") * 8, "cn": F.col("opp") % 300})
    return cal.recalibrated_rates(rows, cal.past_rate_gaps(rows, "season", "y", "asof", 0.5), "season", "asof", "cn")


@query("ridge_correction", "E32", TE_KEYS + " correction:d", f"""
WITH t AS (SELECT *, y - p r FROM pit WHERE season = 2000), md AS (SELECT quantile_cont(cents, 0.5) mc FROM t), st AS (SELECT avg(coalesce(cents, mc)) m1, stddev_pop(coalesce(cents, mc)) s1, avg(qty) m2, stddev_pop(qty) s2 FROM t, md),
z AS (SELECT (coalesce(cents, mc) - m1) / s1 a, (qty - m2) / s2 b, r FROM t, md, st), m AS (SELECT sum(a * a) + 100 aa, sum(a * b) ab, sum(b * b) + 100 bb, sum(a * r) ar, sum(b * r) br FROM z),
w AS (SELECT (bb * ar - ab * br) / (aa * bb - ab * ab) w1, (aa * br - ab * ar) / (aa * bb - ab * ab) w2 FROM m)
SELECT {KEY_SQL}, least(greatest(w1 * (coalesce(cents, mc) - m1) / s1 + w2 * (qty - m2) / s2, -0.05), 0.05) correction FROM pit, md, st, w WHERE season = 2001""")
def ridge_correction(spark, sf):
    """Ridge residual correction fitted one season earlier."""
    rows = pit(spark, sf).withColumn("r", F.col("y") - F.col("p"))
    return cal.ridge_correction(rows.filter("season = 2000"), rows.filter(LATEST), ["cents", "qty"], "r", 100.0)


@query("applied_corrections", "E33 J8", TE_KEYS + " etype:s corrected:d", f"""
WITH et AS (SELECT DISTINCT entity, 'T' || (entity % 4) etype FROM pit WHERE entity % 10 <> 0), ot AS (SELECT DISTINCT opp, 'B' || (opp % 3) otype FROM pit WHERE opp % 7 <> 0),
pr AS (SELECT 'T' || a etype, 'B' || b otype, 0.001 * (a - b) c FROM range(4) x(a), range(2) y(b)), cx AS (SELECT CASE WHEN v = 7 THEN NULL ELSE v END cx, 0.002 * v c FROM range(3, 8) t(v)),
r AS (SELECT pit.*, coalesce(etype, 'new') et, coalesce(otype, 'new') ot, CASE WHEN ctx = 7 THEN NULL ELSE ctx END cx FROM pit LEFT JOIN et USING (entity) LEFT JOIN ot USING (opp) WHERE season = 2001)
SELECT {KEY_SQL}, et AS etype, p + coalesce(pr.c, 0) * 0.5 + CASE WHEN hand = 'O' THEN coalesce(cx.c, 0) + 0.2 * (p2 - p) ELSE 0 END corrected
FROM r LEFT JOIN pr ON pr.etype = et AND pr.otype = ot LEFT JOIN cx ON cx.cx IS NOT DISTINCT FROM r.cx""")
def applied_corrections(spark, sf):
    """Type, pair, context and expert corrections on scored rows."""
    every = pit(spark, sf)
    rows = every.filter(LATEST).withColumn("cx", F.when(F.col("ctx") != 7, F.col("ctx")))
    et = every.filter("entity % 10 <> 0").select("entity").distinct().withColumn("etype", F.concat(F.lit("T"), F.col("entity") % 4))
    ot = every.filter("opp % 7 <> 0").select("opp").distinct().withColumn("otype", F.concat(F.lit("B"), F.col("opp") % 3))
    pair = spark.createDataFrame([(f"T{a}", f"B{b}", 0.001 * (a - b)) for a in range(4) for b in range(2)], "etype string, otype string, correction double")
    ctx = spark.createDataFrame([(None if v == 7 else v, 0.002 * v) for v in range(3, 8)], "cx int, correction double")
    return cal.apply_corrections(rows, "p", [(et, ["entity"], "etype", "new"), (ot, ["opp"], "otype", "new")], pair, ["etype", "otype"],
                                 ctx, ["cx"], F.col("hand") == "O", [("p2", "p", 0.2)], 0.5)


@query("segment_slope_grid", "E41", "ctx:i n:i slope:d brier:d8", f"""
WITH m AS (SELECT avg({lg('p')}) c FROM pit), ce AS (SELECT ctx, {lg('p')} - c z, c, count(*) n, sum(y) k FROM pit, m GROUP BY ALL),
g AS (SELECT ctx, a, sum(n) n, sum(n * q * q - 2 * q * k + k) / sum(n) b FROM (SELECT ce.*, a, {sg('a * z + c')} q FROM ce, (SELECT 0.4 + 0.02 * i a FROM range(71) t(i))) GROUP BY 1, 2)
SELECT ctx, n, min_by(a, (round(b, 12), a)) slope, min(round(b, 12)) brier FROM g WHERE n >= 2000 GROUP BY 1, 2""")
def segment_slope_grid(spark, sf):
    """Brier-best slope over 71 values per segment."""
    rows = pit(spark, sf)
    z = logit(F.col("p"))
    return cal.slope_grid(rows, ["ctx"], "y", z, rows.agg(F.avg(z)).scalar(), [0.4 + 0.02 * i for i in range(71)], 2000)


def slope_sql(steps: int) -> str:
    out = ["s0 AS (SELECT ctx, 1.0::DOUBLE b FROM ce GROUP BY 1)"]
    for i in range(steps):
        out.append(f"s{i + 1} AS (SELECT ctx, any_value(b) + sum(z * (k - n * q)) / sum(z * z * n * q * (1 - q)) b FROM (SELECT ce.*, b, {sg('b * z + c')} q FROM ce JOIN s{i} USING (ctx)) GROUP BY 1)")
    return ", ".join(out)


@query("segment_slope_newton", "E41", "ctx:i b:d", f"""
WITH m AS (SELECT avg({lg('p')}) c FROM pit), ce AS (SELECT ctx, {lg('p')} - c z, c, count(*) n, sum(y) k FROM pit, m GROUP BY ALL), {slope_sql(12)} SELECT ctx, b FROM s12""")
def segment_slope_newton(spark, sf):
    """Logistic slope per segment with a fixed intercept."""
    rows = pit(spark, sf)
    z = logit(F.col("p"))
    return cal.fixed_slope(rows, ["ctx"], "y", z, rows.agg(F.avg(z)).scalar())


@query("sharpened_by_history", "E41 A39", TE_KEYS + " sharpened:d5", f"""
WITH m AS (SELECT avg({lg('p')}) c FROM pit WHERE season < 2001), ce AS (SELECT ctx, {lg('p')} - c z, c, count(*) n, sum(y) k FROM pit, m WHERE season < 2001 GROUP BY ALL), {slope_sql(12)}
SELECT {KEY_SQL}, {sg('(1 + 0.3 * (b - 1)) * (' + lg('p') + ' - c) + c')} sharpened FROM pit JOIN s12 USING (ctx), m WHERE season = 2001""")
def sharpened_by_history(spark, sf):
    """Slopes of earlier seasons, damped, applied to the last one."""
    rows = pit(spark, sf)
    past, z = rows.filter(PAST), logit(F.col("p"))
    c = past.agg(F.avg(z)).scalar()
    b = cal.fixed_slope(past, ["ctx"], "y", z, c)
    out = joins.lookup_join(rows.filter(LATEST), b, ["ctx"], {"b": 1.0})
    return out.withColumn("sharpened", sigmoid((1 + 0.3 * (F.col("b") - 1)) * (z - c) + c))


@query("seed_stability", "E40 S10", "season:i pair:s corr:d", f"""
WITH l AS ({SEEDS}), w AS (SELECT {KEY_SQL}, {', '.join(f'max(CASE WHEN seed = {i} THEN q - 0.3 END) s{i}' for i in range(3))} FROM l GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT season, 's{a}~s{b}' pair, corr(s{a}, s{b}) AS \"corr\" FROM w GROUP BY 1" for a, b in ((0, 1), (0, 2), (1, 2))))
def seed_stability(spark, sf):
    """Correlation of seed corrections by season after pivoting the long table."""
    long = seeded(spark, sf).filter("seed < 3").select(*KEY_SQL.split(", "), F.concat(F.lit("s"), F.col("seed").cast("string")).alias("model"), F.col("q").alias("p"))
    wide = metrics.wide_forecasts(long, KEY_SQL.split(", "), ["s0", "s1", "s2"], "m_")
    pairs = [("m_s0", "m_s1", "s0~s1"), ("m_s0", "m_s2", "s0~s2"), ("m_s1", "m_s2", "s1~s2")]
    return wide.groupBy("season").agg(*[F.corr(a, b).alias(n) for a, b, n in pairs]).unpivot(
        ["season"], [n for _, _, n in pairs], "pair", "corr")


@query("two_way_weight_grid", "E19 E13", "w0:d w1:d delta:d8", """
WITH g AS (SELECT i / 10.0::DOUBLE w FROM range(11) t(i)), m AS (SELECT count(*) n, sum(CASE WHEN hand = 'O' THEN (p - y) * (p2 - p) END) e0, sum(CASE WHEN hand = 'O' THEN pow(p2 - p, 2) END) c0,
 sum(CASE WHEN hand = 'F' THEN (p - y) * (p2 - p) END) e1, sum(CASE WHEN hand = 'F' THEN pow(p2 - p, 2) END) c1 FROM pit)
SELECT a.w w0, b.w w1, (2 * a.w * e0 + a.w * a.w * c0 + 2 * b.w * e1 + b.w * b.w * c1) / n AS delta FROM g a, g b, m""")
def two_way_weight_grid(spark, sf):
    """Separate weights for two row types over a grid, from moments."""
    return metrics.two_way_grid(pit(spark, sf), "hand", ("O", "F"), "y", "p", "p2", [i / 10.0 for i in range(11)])
