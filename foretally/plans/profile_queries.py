"""Cutoff-versioned profiles and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions.buckets import digitize, mixed_radix
from foretally.operators import crosswalk as cw, eb, profiles as prof
from foretally.plans.bindings import LATEST, PAST, pit
from foretally.plans.catalog import query
from foretally.plans.eb_queries import TE_KEYS

CUTS = [1997, 1999, 2001]
CUTS_SQL = ", ".join(f"({c})" for c in CUTS)
METRICS = ["qty", "cents"]
LEVELS = ["A", "N", "R"]
ELIG = "el AS (SELECT pit.*, sn FROM pit JOIN (SELECT entity, season, count(*) sn FROM pit GROUP BY 1, 2 HAVING count(*) >= {m}) z USING (entity, season))"


def recency_sql(src: str, keys: str, cols: list[str], life: float = 2.0, weight: str = "1") -> str:
    aggs = ", ".join(f"""max_by({c}, season) latest_{c}, sum(CASE WHEN {c} IS NOT NULL THEN w * {c} END) / sum(CASE WHEN {c} IS NOT NULL THEN w END) recent_{c}, stddev_pop({c}) between_{c}""" for c in cols)
    # max_by skips NULL values, so the latest value is taken through a struct.
    aggs = ", ".join(f"""max_by({{'v': {c}}}, season).v latest_{c}, sum(CASE WHEN {c} IS NOT NULL THEN w * {c} END) / sum(CASE WHEN {c} IS NOT NULL THEN w END) recent_{c}, stddev_pop({c}) between_{c}""" for c in cols)
    return f"""(SELECT {keys}, cutoff, count(*) seasons, sum(n) total_n, max(season) last_season, max_by(n, season) last_n, cutoff - max(season) season_gap, {aggs}
 FROM (SELECT *, pow(0.5, (cutoff - season) / {life}) * {weight} w FROM {src}, (VALUES {CUTS_SQL}) v(cutoff) WHERE season < cutoff) GROUP BY {keys}, cutoff)"""


MCOLS = [f"{m}_{s}" for m in METRICS for s in ("mean", "std")] + [f"{v}_rate" for v in LEVELS]
SEASON_SQL = "SELECT entity, season, count(*) n, " + ", ".join(
    f"avg({m}) {m}_mean, stddev_samp({m}) {m}_std" for m in METRICS) + ", " + ", ".join(
    f"avg((lab = '{v}')::INT) {v}_rate" for v in LEVELS) + " FROM el GROUP BY 1, 2"
PBASE = "entity:i cutoff:i seasons:i total_n:i last_season:i last_n:i season_gap:i "


@query("metric_profiles", "A15 A18 W29", PBASE + " ".join(f"{h}_{c}:d" for c in MCOLS for h in ("latest", "recent", "between")),
       f"WITH {ELIG.format(m=80)}, s AS ({SEASON_SQL}) SELECT * FROM {recency_sql('s', 'entity', MCOLS)}")
def metric_profiles(spark, sf):
    """Latest, recent and between-season metrics and mix per entity and cutoff."""
    return prof.metric_profiles(pit(spark, sf), "entity", "season", METRICS, "lab", LEVELS, CUTS, 80)


GCOLS = ["qty_mean", "qty_std", "share"]
GSQL = f"""WITH {ELIG.format(m=80)}, s AS (SELECT entity, season, lab, count(*) n, avg(qty) qty_mean, stddev_samp(qty) qty_std, count(*) / any_value(sn) share FROM el GROUP BY 1, 2, 3 HAVING count(*) >= 25),
r AS (SELECT * FROM {recency_sql('s', 'entity, lab', GCOLS)})
SELECT entity, cutoff, {', '.join(f"max(CASE WHEN lab = '{v}' THEN latest_qty_mean END) {v}_latest_qty_mean, max(CASE WHEN lab = '{v}' THEN recent_share END) {v}_recent_share, max(CASE WHEN lab = '{v}' THEN latest_qty_std - recent_qty_std END) {v}_shift_qty_std, max((lab = '{v}')::INT) {v}_available" for v in LEVELS)},
 max(CASE WHEN lab = 'A' THEN recent_qty_mean END) - max(CASE WHEN lab = 'N' THEN recent_qty_mean END) A_minus_N_recent_qty FROM r GROUP BY 1, 2"""


@query("class_profiles", "A16", "entity:i cutoff:i " + " ".join(
    f"{v}_latest_qty_mean:d {v}_recent_share:d {v}_shift_qty_std:d {v}_available:i" for v in LEVELS) + " A_minus_N_recent_qty:d", GSQL)
def class_profiles(spark, sf):
    """Profiles per class with latest-minus-recent and class gaps."""
    return prof.group_profiles(pit(spark, sf), "entity", "season", ["qty"], "lab", LEVELS, CUTS, 80, 25)


MIX = [f"{v}_rate" for v in LEVELS]


def ent_sql(h: str) -> str:
    return " + ".join(f"CASE WHEN {h}_{c} > 0 THEN -{h}_{c} * ln({h}_{c}) ELSE 0 END" for c in MIX)


@query("mix_profile", "A17", PBASE + "latest_entropy:d latest_hhi:d latest_max:d recent_entropy:d recent_hhi:d recent_max:d", f"""
WITH {ELIG.format(m=80)}, s AS (SELECT entity, season, count(*) n, {', '.join(f"avg((lab = '{v}')::INT) {v}_rate" for v in LEVELS)} FROM el GROUP BY 1, 2), r AS (SELECT * FROM {recency_sql('s', 'entity', MIX)})
SELECT *, {', '.join(f"{ent_sql(h)} {h}_entropy, {' + '.join(f'{h}_{c} * {h}_{c}' for c in MIX)} {h}_hhi, greatest({', '.join(f'{h}_{c}' for c in MIX)}) {h}_max" for h in ('latest', 'recent'))} FROM r""")
def mix_profile(spark, sf):
    """Entropy, concentration and largest share of the class mix."""
    return prof.mix_profile(pit(spark, sf), "entity", "season", "lab", LEVELS, CUTS, 80)


RCOLS = ["y_rate", "y_resid", "y2_rate", "y2_resid"]


@query("rate_profile", "A19", PBASE + "rookie:i " + " ".join(f"{h}_{c}:d" for c in RCOLS for h in ("latest", "recent", "between")), f"""
WITH c AS (SELECT entity, season, count(*) n, avg(y) y_rate, avg(y2) y2_rate FROM pit GROUP BY 1, 2), l AS (SELECT season, sum(n * y_rate) / sum(n) ly, sum(n * y2_rate) / sum(n) ly2 FROM c GROUP BY 1),
s AS (SELECT c.*, y_rate - ly y_resid, y2_rate - ly2 y2_resid FROM c JOIN l USING (season)) SELECT *, (last_n <= 80)::INT rookie FROM {recency_sql('s', 'entity', RCOLS, 2.0, 'least(n, 90)')}""")
def rate_profile(spark, sf):
    """Evidence-weighted rates and residuals per cutoff."""
    return prof.rate_profile(pit(spark, sf), "entity", "season", ["y", "y2"], CUTS, 2.0, 90, 80)


@query("split_residuals", "A20", "entity:i far_n:i far_resid:d near_n:i near_resid:d heavy_n:i heavy_resid:d gap:d", """
WITH f AS (SELECT * FROM pit WHERE season < 2001), m AS (SELECT avg(y) m FROM f)
SELECT entity, sum((hand = 'O')::INT) far_n, avg(CASE WHEN hand = 'O' THEN y END) - any_value(m) far_resid, sum((hand = 'F')::INT) near_n, avg(CASE WHEN hand = 'F' THEN y END) - any_value(m) near_resid,
 sum((qty > 45)::INT) heavy_n, avg(CASE WHEN qty > 45 THEN y END) - any_value(m) heavy_resid, avg(CASE WHEN hand = 'O' THEN y END) - avg(CASE WHEN hand = 'F' THEN y END) gap FROM f, m GROUP BY 1""")
def split_residuals(spark, sf):
    """Residuals of an entity under several predicates."""
    out = prof.split_residuals(pit(spark, sf).filter(PAST), "entity", "y", {
        "far": F.col("hand") == "O", "near": F.col("hand") == "F", "heavy": F.col("qty") > 45})
    return out.withColumn("gap", F.col("far_resid") - F.col("near_resid"))


USE = """c AS (SELECT entity, season, lab, ctx, hand, count(*) n FROM pit GROUP BY ALL), t AS (SELECT entity, season, ctx, hand, sum(n) t FROM c GROUP BY ALL),
l AS (SELECT season, lab, ctx, hand, sum(n) / sum(sum(n)) OVER (PARTITION BY season, ctx, hand) lg FROM c GROUP BY season, lab, ctx, hand)"""


@query("usage_residuals", "A21", "entity:i season:i feature:s resid:d", f"""
WITH {USE} SELECT entity, season, concat_ws('_', 'u', lab, ctx, hand) feature, (n + 200 * lg) / (t + 200) - lg resid FROM c JOIN t USING (entity, season, ctx, hand) JOIN l USING (season, lab, ctx, hand)""")
def usage_residuals(spark, sf):
    """Conditional choice rates against the league cell."""
    return prof.usage_residuals(pit(spark, sf), "entity", "season", "lab", ["ctx", "hand"], 200.0)


@query("response_residuals", "A22", "entity:i season:i feature:s resid:d", """
WITH c AS (SELECT entity, season, lab, hand, avg(qty) m1, count(qty) k1, avg(cents) m2, count(cents) k2 FROM pit GROUP BY ALL),
l AS (SELECT season, lab, hand, avg(qty) l1, avg(cents) l2 FROM pit GROUP BY ALL)
SELECT entity, season, concat_ws('_', 'p_qty', lab, hand) feature, k1 / (k1 + 50.0) * (m1 - l1) resid FROM c JOIN l USING (season, lab, hand)
UNION ALL SELECT entity, season, concat_ws('_', 'p_cents', lab, hand), k2 / (k2 + 50.0) * (m2 - l2) FROM c JOIN l USING (season, lab, hand) WHERE m2 IS NOT NULL""")
def response_residuals(spark, sf):
    """Shrunken gaps of cell means to the league's."""
    return prof.response_residuals(pit(spark, sf), "entity", "season", "lab", ["hand"], METRICS, 50.0)


@query("robust_z", "A23", TE_KEYS + " qty_rz:d price_rz:d", f"""
WITH q AS (SELECT season, lab, {', '.join(f"quantile_cont({m}, 0.5) {m}2, greatest(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 1e-6) {m}i" for m in ('qty', 'price'))} FROM pit WHERE season < 2000 GROUP BY 1, 2)
SELECT season, day, game, ctx, opp, entity, (qty - qty2) / (qtyi / 1.349) qty_rz, (price - price2) / (pricei / 1.349) price_rz FROM pit LEFT JOIN q USING (season, lab)""")
def robust_z(spark, sf):
    """Robust z by season and class; seasons after the fit are NULL."""
    return prof.robust_z(pit(spark, sf), ["season", "lab"], ["qty", "price"], F.col("season") < 2000)


@query("opponent_profile", "A24", "opp:i hand:s n:i overall:d vs_lab_A:d logn_lab_A:d vs_lab_R:d logn_lab_R:d", """
WITH r AS (SELECT opp, hand, lab, y - avg(y) OVER (PARTITION BY season) r FROM pit WHERE season < 2001)
SELECT opp, hand, count(*) n, sum(r) / (count(*) + 50) overall, sum(CASE WHEN lab = 'A' THEN r END) / (sum((lab = 'A')::INT) + 50) vs_lab_A, ln(1 + nullif(sum((lab = 'A')::INT), 0)) logn_lab_A,
 sum(CASE WHEN lab = 'R' THEN r END) / (sum((lab = 'R')::INT) + 50) vs_lab_R, ln(1 + nullif(sum((lab = 'R')::INT), 0)) logn_lab_R FROM r GROUP BY 1, 2""")
def opponent_profile(spark, sf):
    """Shrunken residuals of an opponent overall and per class."""
    rows = eb.context_residual(pit(spark, sf).filter(PAST), "y", "season", "season")
    return prof.opponent_profile(rows, ["opp", "hand"], "residual", 50.0, {"lab": ["A", "R"]})


@query("outing_weights", "A32 W4", TE_KEYS + " outing_n:i starts:i outing_ratio:d weight:d", """
WITH o AS (SELECT entity, month + 100 * season mo, count(*) n, (min(ctx) = 1)::INT st FROM pit GROUP BY 1, 2), m AS (SELECT entity, st, quantile_cont(n, 0.5) u FROM o GROUP BY 1, 2)
SELECT season, day, game, ctx, opp, pit.entity, n outing_n, st starts, n / greatest(u, 1) outing_ratio, CASE WHEN hand = 'F' THEN 0.2 ELSE 1 END * CASE WHEN n / greatest(u, 1) < 0.5 THEN 0.5 ELSE 1 END weight
FROM pit JOIN o ON o.entity = pit.entity AND mo = month + 100 * season JOIN m USING (entity, st)""".replace("JOIN m USING (entity, st)", "JOIN m ON m.entity = o.entity AND m.st = o.st").replace("n outing_n, st starts", "n outing_n, o.st starts"))
def outing_weights(spark, sf):
    """Sample weights by outing length against the usual and by row type."""
    rows = pit(spark, sf).withColumn("mo", F.col("month") + 100 * F.col("season"))
    return prof.outing_weights(rows, "entity", "mo", "ctx", F.col("hand") == "F")


# Four context axes, each within the hand, as the same text for Spark and SQL.
RESPONSE_AXES = {"v": "CASE WHEN qty < 15 THEN 0 WHEN qty < 35 THEN 1 ELSE 2 END", "c": "ctx", "m": "month % 4", "d": "CASE WHEN disc < 0.05 THEN 0 ELSE 1 END"}


def response_sql() -> str:
    parts, out = ["b AS (SELECT *, " + ", ".join(f"{e} AS ax_{t}" for t, e in RESPONSE_AXES.items()) + " FROM pit)"], []
    for t in RESPONSE_AXES:
        x = f"ax_{t}, hand"
        parts += [f"c_{t} AS (SELECT entity, season, lab, {x}, count(*) n, avg(cents) m, count(cents) k FROM b GROUP BY ALL)",
                  f"t_{t} AS (SELECT entity, season, {x}, sum(n) t FROM c_{t} GROUP BY ALL)",
                  f"l_{t} AS (SELECT season, lab, {x}, count(*) / sum(count(*)) OVER (PARTITION BY season, {x}) lg, avg(cents) lm FROM b GROUP BY season, lab, {x})"]
        out += [f"SELECT entity, season, '{t}:' || concat_ws('_', 'u', lab, {x}) feature, (n + 200 * lg) / (t + 200) - lg resid FROM c_{t} JOIN t_{t} USING (entity, season, {x}) JOIN l_{t} USING (season, lab, {x})",
                f"SELECT entity, season, '{t}:' || concat_ws('_', 'p_cents', lab, {x}), k / (k + 200.0) * (m - lm) FROM c_{t} JOIN l_{t} USING (season, lab, {x}) WHERE m IS NOT NULL"]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(out)


@query("response_profile", "A36", "entity:i season:i feature:s resid:d", response_sql())
def response_profile(spark, sf):
    """Usage and response residuals over four context axes within the hand, stacked."""
    rows = pit(spark, sf).withColumns({f"ax_{t}": F.expr(e) for t, e in RESPONSE_AXES.items()})
    return prof.response_profile(rows, "entity", "season", "lab", {t: [f"ax_{t}", "hand"] for t in RESPONSE_AXES}, ["cents"], 200.0)


STATE_SQL = "((month - 1) * 8 + ctx) * 3 + CASE lab WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
TWO = f"""st AS (SELECT *, {STATE_SQL} stt FROM pit), fa AS (SELECT season, entity % 2 h, entity a, stt, count(*) n FROM st WHERE game % 2 = 0 GROUP BY ALL),
fb AS (SELECT season, entity % 2 h, entity + 1000000 b, stt, count(*) n FROM st WHERE game % 2 = 1 OR game % 6 = 0 GROUP BY ALL),
na AS (SELECT season, h, a, sqrt(sum(n * n)) na, sum(n) an FROM fa GROUP BY ALL), nb AS (SELECT season, h, b, sqrt(sum(n * n)) nb, sum(n) bn FROM fb GROUP BY ALL),
pr AS (SELECT season, h, a, b, sum(fa.n * fb.n) d FROM fa JOIN fb USING (season, h, stt) GROUP BY ALL),
si AS (SELECT season, h, a, b, an, bn, coalesce(d, 0) / (na * nb) AS sim FROM na JOIN nb USING (season, h) LEFT JOIN pr USING (season, h, a, b)),
rk AS (SELECT *, row_number() OVER (PARTITION BY season, h, a ORDER BY round(sim, 12) DESC, b) r FROM si)"""


def two_logs(spark, sf):
    """Two overlapping halves of the log; ids of the second are relabelled."""
    lab = F.when(F.col("lab") == "A", 0).when(F.col("lab") == "N", 1).otherwise(2)
    rows = pit(spark, sf).withColumns({"stt": mixed_radix([(F.col("ctx"), 8), (lab, 3)], F.col("month") - 1), "h": F.col("entity") % 2})
    a = rows.filter("game % 2 = 0").select("season", "h", F.col("entity").alias("a"), "stt")
    b = rows.filter("game % 2 = 1 OR game % 6 = 0").select("season", "h", (F.col("entity") + 1000000).alias("b"), "stt")
    return a, b


def matches(spark, sf, top):
    a, b = two_logs(spark, sf)
    return cw.match_seasons(a, b, "season", "h", "a", "b", "stt", top)


@query("fingerprint_matches", "J10 P23 O3", "season:i a:i b:i rank:i similarity:d second:d a_n:i b_n:i", f"""
WITH {TWO} SELECT x.season, x.a, x.b, x.r AS "rank", x.sim AS similarity, coalesce(z.sim, -1) AS second, x.an a_n, x.bn b_n
FROM rk x LEFT JOIN rk z ON z.season = x.season AND z.h = x.h AND z.a = x.a AND z.r = 2 WHERE x.r <= 2""")
def fingerprint_matches(spark, sf):
    """Best matches by state-count cosine within season and hand."""
    return matches(spark, sf, 2)


@query("hard_crosswalk", "J11 U-dist", "a:i b:i match_seasons:i mean_sim:d min_margin:d total_a_n:i total_b_n:i evidence_max_season:i", f"""
WITH {TWO}, ac AS (SELECT x.*, x.sim - coalesce(z.sim, -1) mg FROM rk x LEFT JOIN rk z ON z.season = x.season AND z.h = x.h AND z.a = x.a AND z.r = 2 WHERE x.r = 1),
v AS (SELECT a, b, count(DISTINCT season) match_seasons, avg(sim) mean_sim, min(mg) min_margin, sum(an) total_a_n, sum(bn) total_b_n, max(season) evidence_max_season FROM ac WHERE sim >= 0.5 AND mg >= 0.02 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY match_seasons DESC, mean_sim DESC, total_a_n DESC, b) r1 FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY match_seasons DESC, mean_sim DESC, total_a_n DESC, a) r2 FROM f WHERE r1 = 1)
SELECT a, b, match_seasons, mean_sim, min_margin, total_a_n, total_b_n, evidence_max_season FROM g WHERE r2 = 1""")
def hard_crosswalk(spark, sf):
    """One-to-one mapping by confident season votes."""
    return cw.hard_crosswalk(matches(spark, sf, 2), "season", "a", "b", 0.5, 0.02)


SOFT = f"""{TWO}, t5 AS (SELECT x.*, max(x.sim) OVER (PARTITION BY x.season, x.a) mx, coalesce(z.sim, -1) s2 FROM rk x LEFT JOIN rk z ON z.season = x.season AND z.h = x.h AND z.a = x.a AND z.r = 2 WHERE x.r <= 5),
w1 AS (SELECT *, CASE WHEN sim < 0.4 THEN 0 ELSE exp((sim - mx) / 0.05) END w0 FROM t5), w2 AS (SELECT *, sum(w0) OVER (PARTITION BY season, a) ws FROM w1), w3 AS (SELECT *, w0 / ws w FROM w2 WHERE ws > 0),
sx AS (SELECT season, a, b, w, mx top1_sim, mx - s2 margin, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) OVER (PARTITION BY season, a) entropy FROM w3)"""


@query("soft_crosswalk", "J12", "season:i a:i b:i w:d top1_sim:d margin:d entropy:d", f"WITH {SOFT} SELECT * FROM sx WHERE w > 1e-4")
def soft_crosswalk(spark, sf):
    """Softmax weights over the top five matches."""
    return cw.soft_crosswalk(matches(spark, sf, 5), "season", "h", "a", "b", 0.05, 0.4)


@query("asof_crosswalk_profile", "J12 J4", "a:i cutoff:i seasons:i last_season:i qty:d tax:d", f"""
WITH {SOFT}, pf AS (SELECT entity + 1000000 b, season, avg(qty) qty, avg(tax) tax FROM pit GROUP BY 1, 2), ps AS (SELECT a, season, sum(w * qty) / sum(w) qty, sum(w * tax) / sum(w) tax FROM (SELECT * FROM sx WHERE w > 1e-4) JOIN pf USING (b, season) GROUP BY 1, 2)
SELECT a, cutoff, count(*) seasons, max(season) last_season, sum(qty * pow(0.5, (cutoff - season) / 2.0)) / sum(pow(0.5, (cutoff - season) / 2.0)) qty, sum(tax * pow(0.5, (cutoff - season) / 2.0)) / sum(pow(0.5, (cutoff - season) / 2.0)) tax
FROM ps, (VALUES {CUTS_SQL}) v(cutoff) WHERE season < cutoff GROUP BY 1, 2""")
def asof_crosswalk_profile(spark, sf):
    """Profiles carried over the soft crosswalk, versioned by cutoff."""
    x = cw.soft_crosswalk(matches(spark, sf, 5), "season", "h", "a", "b", 0.05, 0.4)
    p = pit(spark, sf).groupBy((F.col("entity") + 1000000).alias("b"), "season").agg(F.avg("qty").alias("qty"), F.avg("tax").alias("tax"))
    return cw.asof_embedding(x, p, "season", "a", "b", ["qty", "tax"], CUTS)


FEATS = ["season", "month", "lab", "hand"]
FP = lambda side, cond: f"""{side}l AS (SELECT entity e, f || '=' || lv s, count(*) n, f FROM (""" + " UNION ALL ".join(
    f"SELECT entity, '{c}' f, CAST({c} AS VARCHAR) lv FROM pit WHERE {cond}" for c in FEATS) + f""") GROUP BY ALL), {side}s AS (SELECT e, s, n / sum(n) OVER (PARTITION BY e, f) v FROM {side}l)"""


@query("team_candidates", "J13 O3", "team:i other:i rank:i similarity:d a_n:i b_n:i volume_ratio:d", f"""
WITH {FP('a', 'game % 2 = 0')}, {FP('b', 'game % 2 = 1')}, cs AS (SELECT DISTINCT s FROM as_ INTERSECT SELECT DISTINCT s FROM bs), an AS (SELECT e, sqrt(sum(v * v)) z FROM as_ WHERE s IN (FROM cs) GROUP BY 1), bn AS (SELECT e, sqrt(sum(v * v)) z FROM bs WHERE s IN (FROM cs) GROUP BY 1),
d AS (SELECT a.e ae, b.e be, sum(a.v * b.v) d FROM as_ a JOIN bs b USING (s) GROUP BY 1, 2), r AS (SELECT ae, be, d / (an.z * bn.z) sim, row_number() OVER (PARTITION BY ae ORDER BY round(d / (an.z * bn.z), 12) DESC, be) r FROM d JOIN an ON an.e = ae JOIN bn ON bn.e = be)
SELECT ae team, be other, r AS "rank", sim similarity, x.n a_n, z.n b_n, z.n / x.n volume_ratio FROM r JOIN (SELECT entity, count(*) n FROM pit WHERE game % 2 = 0 GROUP BY 1) x ON x.entity = ae JOIN (SELECT entity, count(*) n FROM pit WHERE game % 2 = 1 GROUP BY 1) z ON z.entity = be WHERE r <= 3""".replace("as AS (", "as_ AS ("))
def team_candidates(spark, sf):
    """Most similar entities of two logs by level shares."""
    rows = pit(spark, sf)
    a = rows.filter("game % 2 = 0").withColumnRenamed("entity", "team")
    b = rows.filter("game % 2 = 1").withColumnRenamed("entity", "other")
    return cw.team_candidates(a, b, "team", "other", FEATS)


@query("id_overlap", "J14 INT", "a_ids:i b_ids:i overlap:i", """
SELECT count(DISTINCT entity) a_ids, (SELECT count(DISTINCT opp) FROM pit WHERE season = 2001) b_ids, (SELECT count(*) FROM (SELECT DISTINCT entity FROM pit WHERE season < 1998 INTERSECT SELECT DISTINCT opp FROM pit WHERE season = 2001)) overlap FROM pit WHERE season < 1998""")
def id_overlap(spark, sf):
    """Ids two logs share as text."""
    rows = pit(spark, sf)
    return cw.id_overlap(rows.filter("season < 1998"), rows.filter(LATEST), "entity", "opp")


@query("crosswalk_quality", "D41 J6", "season:i n:i covered:i coverage:d rate_covered:d rate_other:d", f"""
WITH {TWO}, ac AS (SELECT x.*, x.sim - coalesce(z.sim, -1) mg FROM rk x LEFT JOIN rk z ON z.season = x.season AND z.h = x.h AND z.a = x.a AND z.r = 2 WHERE x.r = 1),
m AS (SELECT DISTINCT a FROM ac WHERE sim >= 0.5 AND mg >= 0.05)
SELECT season, count(*) n, sum((a IS NOT NULL)::INT) covered, avg((a IS NOT NULL)::INT) coverage, avg(CASE WHEN a IS NOT NULL THEN y END) rate_covered, avg(CASE WHEN a IS NULL THEN y END) rate_other FROM pit LEFT JOIN m ON a = entity GROUP BY 1""")
def crosswalk_quality(spark, sf):
    """Row coverage of matched entities by season and outcome inside and outside."""
    ok = matches(spark, sf, 2).filter("rank = 1 AND similarity >= 0.5 AND similarity - second >= 0.05").select(F.col("a").alias("entity")).distinct().withColumn("hit", F.lit(1))
    rows = pit(spark, sf).join(ok, "entity", "left")
    hit = F.col("hit").isNotNull()
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.count_if(hit).alias("covered"), F.avg(hit.cast("double")).alias("coverage"),
                                      F.avg(F.when(hit, F.col("y"))).alias("rate_covered"), F.avg(F.when(~hit, F.col("y"))).alias("rate_other"))


@query("crosswalk_match_fields", "D41", "metric:s p10:d p50:d p90:d", f"""
WITH {TWO}, ac AS (SELECT x.sim AS similarity, x.sim - coalesce(z.sim, -1) margin, x.an::DOUBLE a_n FROM rk x LEFT JOIN rk z ON z.season = x.season AND z.h = x.h AND z.a = x.a AND z.r = 2 WHERE x.r = 1)
""" + " UNION ALL ".join(f"SELECT '{c}' metric, quantile_cont({c}, 0.1) p10, quantile_cont({c}, 0.5) p50, quantile_cont({c}, 0.9) p90 FROM ac" for c in ("similarity", "margin", "a_n")))
def crosswalk_match_fields(spark, sf):
    """Spread of similarity, margin and volume of the best matches."""
    from foretally.operators.ranks import metric_quantiles
    best = matches(spark, sf, 2).filter("rank = 1").withColumn("margin", F.col("similarity") - F.col("second"))
    return metric_quantiles(best, [], ["similarity", "margin", "a_n"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
