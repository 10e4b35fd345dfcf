"""Empirical-Bayes tables, as-of lookups and residual tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions.rates import clip, half_life
from foretally.operators import asof, eb, joins, metrics
from foretally.plans.bindings import LATEST, PAST, LAST_SEASON, pit
from foretally.plans.catalog import query

FIT = f"season < {LAST_SEASON}"
CUTOFFS = list(range(1996, 2003))
SEASONS = list(range(1995, 2003))


def eb_sql(s: str, n: str, k: float, mu: str) -> str:
    return f"(({s}) + {k} * {mu}) / (({n}) + {k})"


FIT_CTE = f"fit AS (SELECT * FROM pit WHERE {FIT}), mu AS (SELECT avg(y) m FROM fit)"


@query("split_forecast_skill", "A2 J1 E1 E4", "hand:s n:i rate:d brier:d bss:d", f"""
WITH {FIT_CTE},
a AS (SELECT entity, hand, sum(y) s, count(*) n FROM fit GROUP BY 1, 2),
u AS (SELECT entity, sum(s) s, sum(n) n FROM a GROUP BY 1),
t AS (SELECT a.entity, a.hand, {eb_sql('a.s', 'a.n', 300, 'm')} - {eb_sql('u.s', 'u.n', 300, 'm')} split,
             a.n / (a.n + 300.0) rel FROM a JOIN u USING (entity), mu),
v AS (SELECT hand, y, least(greatest(m + coalesce(split, 0) * coalesce(rel, 0), 1e-6), 1 - 1e-6) p
      FROM (SELECT pit.hand, y, split, rel FROM pit LEFT JOIN t ON pit.entity = t.entity AND pit.hand = t.hand
            WHERE season = {LAST_SEASON}) z, mu)
SELECT hand, count(*) n, avg(y) rate, avg((y - p) * (y - p)) brier,
       1e5 * (1 - avg((y - p) * (y - p)) / (avg(y) * (1 - avg(y)))) bss FROM v GROUP BY 1""")
def split_forecast_skill(spark, sf):
    """Fit splits on past seasons, look them up for the last one, score the forecast."""
    rows = pit(spark, sf)
    fit = rows.filter(PAST)
    table = eb.nested_split(fit, ["entity"], ["entity", "hand"], "y", 300.0)
    scored = joins.lookup_join(rows.filter(LATEST), table,
                               ["entity", "hand"], {"split": 0.0, "rel": 0.0})
    p = clip(eb.mean_of(fit, "y") + F.col("split") * F.col("rel"), 1e-6, 1 - 1e-6)
    return metrics.skill(scored.withColumn("forecast", p), ["hand"], "y", "forecast")


def split_sql(upper: str, lower: str, k: float, source: str = "fit") -> str:
    return f"""
WITH {FIT_CTE},
a AS (SELECT {lower}, sum(y) s, count(*) n FROM {source} GROUP BY ALL),
u AS (SELECT {upper}, sum(s) s, sum(n) n FROM a GROUP BY ALL)
SELECT {lower}, {eb_sql('a.s', 'a.n', k, 'm')} - {eb_sql('u.s', 'u.n', k, 'm')} split,
       a.n / (a.n + {k}) rel FROM a JOIN u USING ({upper}), mu"""


@query("hand_split_table", "A2", "entity:i hand:s split:d rel:d",
       split_sql("entity", "entity, hand", 300.0))
def hand_split_table(spark, sf):
    """EB(entity, hand) - EB(entity) on the fit seasons."""
    return eb.nested_split(pit(spark, sf).filter(PAST), ["entity"], ["entity", "hand"], "y", 300.0)


@query("count_split_table", "A4 P21", "entity:i hand:s bucket:i split:d rel:d",
       split_sql("entity, hand", "entity, hand, bucket", 300.0,
                 "(SELECT *, CASE WHEN ctx < 3 THEN 0 WHEN ctx > 4 THEN 2 ELSE 1 END bucket FROM fit)"))
def count_split_table(spark, sf):
    """Two-level subtraction by count bucket."""
    rows = pit(spark, sf).filter(PAST).withColumn(
        "bucket", F.when(F.col("ctx") < 3, 0).when(F.col("ctx") > 4, 2).otherwise(1))
    return eb.nested_split(rows, ["entity", "hand"], ["entity", "hand", "bucket"], "y", 300.0)


@query("inning_split_table", "A5 P22", "entity:i hand:s bucket:i split:d rel:d",
       split_sql("entity, hand", "entity, hand, bucket", 300.0,
                 "(SELECT *, CASE WHEN qty < 4 THEN 0 WHEN qty < 7 THEN 1 WHEN qty < 10 THEN 2 ELSE 3 END bucket FROM fit)"))
def inning_split_table(spark, sf):
    """Two-level subtraction by left-closed inning bucket."""
    from foretally.functions.buckets import digitize
    rows = pit(spark, sf).filter(PAST).withColumn("bucket", digitize(F.col("qty"), [4, 7, 10]))
    return eb.nested_split(rows, ["entity", "hand"], ["entity", "hand", "bucket"], "y", 300.0)


COMPONENTS = {"m": "CASE WHEN tax0 IS NOT NULL THEN CASE WHEN lab = 'A' THEN 1 ELSE 0 END END",
              "r": "CASE WHEN disc > 0.02 THEN CASE WHEN lab = 'N' THEN 1 ELSE 0 END END"}


def component_sql() -> str:
    parts = {"y": "y", **COMPONENTS}
    low = ", ".join(f"coalesce(sum({e}), 0) s_{t}, count({e}) n_{t}" for t, e in parts.items())
    up = ", ".join(f"sum(s_{t}) us_{t}, sum(n_{t}) un_{t}" for t in parts)
    mus = ", ".join(f"avg({e}) m_{t}" for t, e in parts.items())
    outs = ", ".join(
        f"CASE WHEN n_{t} > 0 THEN {eb_sql(f's_{t}', f'n_{t}', 300, f'm_{t}')} - "
        f"{eb_sql(f'us_{t}', f'un_{t}', 300, f'm_{t}')} END "
        f"{'split' if t == 'y' else 'split_' + t}" for t in parts)
    return f"""WITH fit AS (SELECT * FROM pit WHERE {FIT}), mu AS (SELECT {mus} FROM fit),
a AS (SELECT opp, hand, {low} FROM fit GROUP BY 1, 2), u AS (SELECT opp, {up} FROM a GROUP BY 1)
SELECT opp, hand, {outs}, n_y / (n_y + 300.0) rel FROM a JOIN u USING (opp), mu"""


@query("component_splits", "A3", "opp:i hand:s split:d split_m:d split_r:d rel:d", component_sql())
def component_splits(spark, sf):
    """Opponent splits of the target and of two components with unknown labels."""
    parts = {t: F.expr(e) for t, e in COMPONENTS.items()}
    return eb.component_splits(pit(spark, sf).filter(PAST), "opp", "hand", "y", parts, 300.0)


AXES = {"load": "CASE WHEN qty < 10 THEN 0 WHEN qty < 30 THEN 1 ELSE 2 END",
        "lev": "CASE WHEN disc <= 0.05 THEN 0 ELSE 1 END", "mon": "month"}
AXES_SQL = "ax AS (SELECT *, " + ", ".join(f"{e} {n}" for n, e in AXES.items()) + " FROM fit)"
AXES_LONG = " UNION ALL ".join(
    f"SELECT entity, y, '{n}' axis, cast({n} AS varchar) \"level\" FROM ax" for n in AXES)
AXES_SPLIT = f"""lng AS ({AXES_LONG}),
a AS (SELECT entity, axis, "level", sum(y) s, count(*) n FROM lng GROUP BY ALL),
u AS (SELECT entity, axis, sum(s) s, sum(n) n FROM a GROUP BY ALL),
sp AS (SELECT entity, axis, "level", {eb_sql('a.s', 'a.n', 200, 'm')} - {eb_sql('u.s', 'u.n', 200, 'm')} split,
       a.n / (a.n + 200.0) rel, a.n FROM a JOIN u USING (entity, axis), mu)"""


@query("reactivity_axes", "A6 A34", "entity:i axis:s level:s split:d rel:d split_w:d",
       f'WITH {FIT_CTE}, {AXES_SQL}, {AXES_SPLIT} SELECT entity, axis, "level", split, rel, split * rel split_w FROM sp')
def reactivity_axes(spark, sf):
    """Splits along workload, leverage and month axes in long form."""
    rows = pit(spark, sf).filter(PAST).selectExpr("*", *[f"{e} AS {n}" for n, e in AXES.items()])
    return eb.axis_splits(rows, "entity", list(AXES), "y", 200.0)


@query("axis_screening", "A34", "axis:s n_rows:i sd:d kept:i p_low:d p_high:d", f"""
WITH {FIT_CTE}, {AXES_SQL}, {AXES_SPLIT},
g AS (SELECT axis, sum(n) n_rows, sqrt(greatest(sum(n * split * split) / sum(n) - (sum(n * split) / sum(n)) ** 2, 0)) sd
      FROM sp WHERE rel > 0.2 GROUP BY 1),
q AS (SELECT axis, quantile_cont(split, 0.01) p_low, quantile_cont(split, 0.99) p_high FROM lng JOIN sp USING (entity, axis, "level") WHERE rel > 0.2 GROUP BY 1)
SELECT axis, n_rows, sd, CASE WHEN sd > 0.005 THEN 1 ELSE 0 END kept, p_low, p_high FROM g JOIN q USING (axis)""")
def axis_screening(spark, sf):
    """Spread of every axis over reliable rows against a floor."""
    rows = pit(spark, sf).filter(PAST).selectExpr("*", *[f"{e} AS {n}" for n, e in AXES.items()])
    splits = eb.axis_splits(rows, "entity", list(AXES), "y", 200.0)
    return eb.screened_axes(rows, splits, "entity", list(AXES), 0.005, 0.2)


@query("pair_interaction", "A7", "entity:i ctx:i inter:d rel:d", f"""
WITH {FIT_CTE}, p AS (SELECT entity, ctx, sum(y) s, count(*) n FROM fit GROUP BY 1, 2),
a AS (SELECT entity, sum(s) s, sum(n) n FROM p GROUP BY 1), b AS (SELECT ctx, sum(s) s, sum(n) n FROM p GROUP BY 1)
SELECT entity, ctx, {eb_sql('p.s', 'p.n', 150, 'm')} - {eb_sql('a.s', 'a.n', 150, 'm')} - {eb_sql('b.s', 'b.n', 150, 'm')} + m AS inter,
       p.n / (p.n + 150.0) rel FROM p JOIN a USING (entity) JOIN b USING (ctx), mu""")
def pair_interaction(spark, sf):
    """Part of a pair not explained by either side."""
    return eb.interaction(pit(spark, sf).filter(PAST), "entity", "ctx", "y", 150.0)


@query("matchup_deviation", "A35", "entity:i opp:i hand:s deviation:d rel:d", f"""
WITH {FIT_CTE}, b AS (SELECT entity, opp, hand, sum(y) s, count(*) n FROM fit GROUP BY ALL),
l AS (SELECT entity, opp, sum(s) s, sum(n) n FROM b GROUP BY ALL),
u AS (SELECT entity, hand, sum(s) s, sum(n) n FROM b GROUP BY ALL)
SELECT entity, opp, hand, {eb_sql('l.s', 'l.n', 30, 'm')} - {eb_sql('u.s', 'u.n', 30, 'm')} deviation, l.n / (l.n + 30.0) rel
FROM b JOIN l USING (entity, opp) JOIN u USING (entity, hand), mu""")
def matchup_deviation(spark, sf):
    """Individual pair against the entity-hand level, keys that do not nest."""
    return eb.crossed_deviation(pit(spark, sf).filter(PAST), ["entity", "opp"],
                                ["entity", "hand"], "y", 30.0)


PROFILE_SQL = """prof AS (SELECT entity, sum(y)::DOUBLE s, count(*)::DOUBLE n, avg(qty) d0, avg(disc) d1, avg(tax) d2
                 FROM fit GROUP BY 1)"""


@query("kernel_shrink", "A8", "entity:i mu:d dev:d", f"""
WITH {FIT_CTE}, {PROFILE_SQL},
lim AS (SELECT """ + ", ".join(
    f"quantile_cont(d{i}, 0.01) lo{i}, quantile_cont(d{i}, 0.99) hi{i}" for i in range(3)) + """ FROM prof),
cap AS (SELECT entity, s, n, """ + ", ".join(
    f"least(greatest(d{i}, lo{i}), hi{i}) d{i}" for i in range(3)) + """ FROM prof, lim),
mo AS (SELECT """ + ", ".join(f"avg(d{i}) m{i}, stddev_pop(d{i}) s{i}" for i in range(3)) + """ FROM cap),
z AS (SELECT entity, s, n, """ + ", ".join(f"(d{i} - m{i}) / s{i} z{i}" for i in range(3)) + """ FROM cap, mo),
w AS (SELECT a.entity, a.s, a.n, exp(-(""" + " + ".join(
    f"(a.z{i} - b.z{i}) ** 2" for i in range(3)) + """) / 2.0) w, b.s bs, b.n bn FROM z a JOIN z b ON a.entity <> b.entity),
m AS (SELECT entity, s, n, sum(w * bs) / sum(w * bn) mu FROM w GROUP BY 1, 2, 3)
SELECT entity, mu, (s + 300 * mu) / (n + 300) - mu dev FROM m""")
def kernel_shrink(spark, sf):
    """Shrink entities to the rate of entities with similar profiles."""
    prof = pit(spark, sf).filter(PAST).groupBy("entity").agg(
        F.sum("y").alias("s"), F.count("y").alias("n"), F.avg("qty").alias("d0"),
        F.avg("disc").alias("d1"), F.avg("tax").alias("d2"))
    return eb.kernel_neighbours(prof, "entity", ["d0", "d1", "d2"], "s", "n", 1.0, 300.0)


def priors_sql(cutoffs: list[int]) -> str:
    values = ", ".join(f"({c})" for c in cutoffs)
    return f"""cut AS (SELECT * FROM (VALUES {values}) t(cutoff)),
sr AS (SELECT season, avg(y) rate FROM pit GROUP BY 1),
pw AS (SELECT cutoff, season, rate, 0.5 ** ((cutoff - season) / 1.5) w, season - cutoff x FROM sr, cut WHERE season < cutoff),
pm AS (SELECT cutoff, max_by(rate, season) AS last_rate, sum(w * rate) / sum(w) ewm, count(*) k,
  sum(w*w) a, sum(w*w*x) b, sum(w*w*x*x) c, sum(w*w*rate) d, sum(w*w*x*rate) e FROM pw GROUP BY 1),
pri AS (SELECT cut.cutoff, coalesce(last_rate, 0.5) AS "last", coalesce(ewm, 0.5) ewm,
  CASE WHEN k IS NULL THEN 0.5 ELSE least(greatest(CASE WHEN k >= 2 THEN (c * d - b * e) / (a * c - b * b) ELSE last_rate END, 0.35), 0.65) END trend
  FROM cut LEFT JOIN pm USING (cutoff))"""


@query("season_priors", "A12", "cutoff:i last:d ewm:d trend:d",
       f'WITH {priors_sql(SEASONS)} SELECT cutoff, "last", ewm, trend FROM pri')
def season_priors(spark, sf):
    """Last rate, half-life mean and weighted trend before every season."""
    return asof.season_priors(pit(spark, sf), "season", "y", SEASONS)


@query("recency_lookup", "A9 J4", "entity:i hand:s cutoff:i value:d effective_n:d", f"""
WITH {priors_sql(CUTOFFS)},
c AS (SELECT entity, hand, season, sum(y) s, count(*) n FROM pit GROUP BY ALL),
w AS (SELECT entity, hand, cutoff, s, n, 0.5 ** ((cutoff - season) / 2.0) w FROM c, cut WHERE season < cutoff)
SELECT entity, hand, cutoff, (sum(w * s) + 80 * any_value(ewm)) / (sum(w * n) + 80) AS value, sum(w * n) effective_n
FROM w JOIN pri USING (cutoff) GROUP BY 1, 2, 3""")
def recency_lookup(spark, sf):
    """Recency-weighted shrunken rates for all cutoffs in one plan."""
    rows = pit(spark, sf)
    priors = asof.season_priors(rows, "season", "y", CUTOFFS)
    cells = asof.season_cells(rows, ["entity", "hand"], "season", "y")
    return asof.recency_lookup(cells, ["entity", "hand"], "season", priors, CUTOFFS, 80.0, 2.0)


@query("last_season_lookup", "A10", "entity:i cutoff:i value:d n:i", f"""
WITH {priors_sql(CUTOFFS)}, c AS (SELECT entity, season + 1 cutoff, sum(y) s, count(*) n FROM pit GROUP BY ALL)
SELECT entity, cutoff, (s + 40 * "last") / (n + 40) AS value, n FROM c JOIN pri USING (cutoff)""")
def last_season_lookup(spark, sf):
    """Shrunken rate of the season before each cutoff."""
    rows = pit(spark, sf)
    priors = asof.season_priors(rows, "season", "y", CUTOFFS)
    return asof.last_season_lookup(asof.season_cells(rows, ["entity"], "season", "y"),
                                   ["entity"], "season", priors, 40.0)


TE_GROUPS = {"entity": ["entity"], "opp": ["opp"], "team": ["team"], "opp_team": ["opp_team"], "kind": ["kind"],
             "count": ["balls", "strikes"], "hands": ["hand", "opp_side"], "entity_opp_side": ["entity", "opp_side"],
             "entity_count": ["entity", "balls", "strikes"], "entity_kind": ["entity", "kind"], "opp_hand": ["opp", "hand"],
             "team_kind": ["team", "kind"]}
# Roles that the key sets need beyond the binding's.
TE_ROLES = {"team": "entity % 30", "opp_team": "opp % 30", "kind": "month % 3", "balls": "ctx % 4", "strikes": "game % 3", "opp_side": "opp % 2"}
TE_COLUMNS = [f"te_{g}_{s}" for g in TE_GROUPS for s in ("all", "last", "delta", "log_all_n", "log_last_n")]
TE_KEYS = "season:i day:s game:i ctx:i opp:i entity:i"


def te_sql() -> str:
    parts, joins_, outs = [], [], []
    for g, keys in TE_GROUPS.items():
        k = ", ".join(keys)
        parts.append(f"""c_{g} AS (SELECT {k}, season, sum(y) s, count(*) n FROM tp GROUP BY ALL),
a_{g} AS (SELECT {k}, cutoff, (sum(w * s) + 80 * any_value(ewm)) / (sum(w * n) + 80) v, sum(w * n) en FROM
  (SELECT c.*, cutoff, 0.5 ** ((cutoff - season) / 2.0) w FROM c_{g} c, cut WHERE season < cutoff) JOIN pri USING (cutoff) GROUP BY ALL),
l_{g} AS (SELECT {k}, season + 1 cutoff, (s + 40 * "last") / (n + 40) v, n FROM c_{g} JOIN pri ON pri.cutoff = season + 1)""")
        on = lambda t: " AND ".join(f"tp.{x} = {t}.{x}" for x in keys) + f" AND tp.season = {t}.cutoff"
        joins_.append(f"LEFT JOIN a_{g} ON {on('a_' + g)} LEFT JOIN l_{g} ON {on('l_' + g)}")
        a, b = f"coalesce(a_{g}.v, ewm)", f"coalesce(l_{g}.v, \"last\")"
        outs.append(f"{a} te_{g}_all, {b} te_{g}_last, {b} - {a} te_{g}_delta, "
                    f"ln(1 + coalesce(a_{g}.en, 0)) te_{g}_log_all_n, ln(1 + coalesce(l_{g}.n, 0)) te_{g}_log_last_n")
    return f"""WITH {priors_sql(SEASONS)}, tp AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in TE_ROLES.items())} FROM pit), {', '.join(parts)}
SELECT tp.season, day, game, tp.ctx, tp.opp, tp.entity, "last" te_global_last, ewm te_global_ewm, trend te_global_trend, {', '.join(outs)}
FROM tp JOIN pri ON pri.cutoff = tp.season {' '.join(joins_)}"""


@query("temporal_target_features", "A11 J3 J4",
       TE_KEYS + " te_global_last:d te_global_ewm:d te_global_trend:d "
       + " ".join(f"{c}:d" for c in TE_COLUMNS), te_sql())
def temporal_target_features(spark, sf):
    """Past-only target features of twelve key sets for every season."""
    rows = pit(spark, sf).withColumns({n: F.expr(e) for n, e in TE_ROLES.items()})
    return asof.temporal_target_features(rows, "season", "y", TE_GROUPS, SEASONS)


@query("season_asof_encoding", "A13", "entity:i season:i te:d te_n:i", """
WITH c AS (SELECT entity, season, sum(y) s, count(*) n FROM pit GROUP BY ALL),
l AS (SELECT season, sum(sum(y)) OVER w / sum(count(*)) OVER w mu FROM pit GROUP BY season
      WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT entity, season, coalesce(sum(s) OVER w, 0) ps, coalesce(sum(n) OVER w, 0) pn FROM c
      WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, season, (ps + 200.0 * mu) / (pn + 200.0) te, pn te_n FROM p JOIN l USING (season)""")
def season_asof_encoding(spark, sf):
    """Target encoding from strictly earlier seasons."""
    return asof.season_asof_encoding(pit(spark, sf), ["entity"], "season", "y", 200.0)


@query("frozen_season_split", "W26", "entity:i hand:s season:i split:d rel:d", """
WITH c AS (SELECT entity, hand, season, sum(y) s, count(*) n FROM pit GROUP BY ALL),
e AS (SELECT entity, season, sum(s) s, sum(n) n FROM c GROUP BY ALL),
l AS (SELECT season, sum(sum(y)) OVER w / sum(count(*)) OVER w mu FROM pit GROUP BY season
      WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pc AS (SELECT entity, hand, season, coalesce(sum(s) OVER w, 0) ps, coalesce(sum(n) OVER w, 0) pn FROM c
      WINDOW w AS (PARTITION BY entity, hand ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pe AS (SELECT entity, season, coalesce(sum(s) OVER w, 0) ps, coalesce(sum(n) OVER w, 0) pn FROM e
      WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, hand, season, (pc.ps + 300.0 * mu) / (pc.pn + 300.0) - (pe.ps + 300.0 * mu) / (pe.pn + 300.0) split,
       pc.pn / (pc.pn + 300.0) rel FROM pc JOIN pe USING (entity, season) JOIN l USING (season)""")
def frozen_season_split(spark, sf):
    """Season-as-of split of entity and hand."""
    return asof.frozen_split(pit(spark, sf), "entity", "hand", "season", "y", 300.0)


@query("leave_one_out_mean", "A14 J16", TE_KEYS + " loo_pair:d loo_ctx:d", """
WITH m AS (SELECT season, avg(y) mu FROM pit GROUP BY 1),
a AS (SELECT entity, hand, sum(y) s, count(*) n FROM pit GROUP BY ALL),
b AS (SELECT ctx, sum(y) s, count(*) n FROM pit GROUP BY ALL)
SELECT pit.season, day, game, pit.ctx, opp, pit.entity, (a.s - y + 50 * mu) / (a.n - 1 + 50) loo_pair,
 (b.s - y + 50 * mu) / (b.n - 1 + 50) loo_ctx FROM pit JOIN m USING (season)
 JOIN a ON a.entity = pit.entity AND a.hand = pit.hand JOIN b ON b.ctx = pit.ctx""")
def leave_one_out_mean(spark, sf):
    """Key means without the row itself."""
    rows = eb.leave_one_out(pit(spark, sf), ["entity", "hand"], "y", "season", 50.0, "loo_pair")
    return eb.leave_one_out(rows, ["ctx"], "y", "season", 50.0, "loo_ctx")


@query("residual_table", "A25 A26", "opp:i hand:s value:d rel:d rate:d weight_n:d raw_n:i", f"""
WITH m AS (SELECT season, avg(y) mu FROM pit GROUP BY 1),
r AS (SELECT opp, hand, y, y - least(greatest(mu, .01), .99) r, 0.5 ** (({LAST_SEASON} - season) / 2.0) w
      FROM pit JOIN m USING (season) WHERE {FIT})
SELECT opp, hand, sum(w * r) / (sum(w) + 50) AS value, sum(w) / (sum(w) + 50) rel, sum(w * y) / sum(w) rate,
 sum(w) weight_n, count(*) raw_n FROM r GROUP BY 1, 2""")
def residual_table(spark, sf):
    """Recency-weighted shrunken residuals per opponent and hand."""
    rows = eb.context_residual(pit(spark, sf).filter(PAST), "y", "season", "season")
    return eb.shrink_table(rows, ["opp", "hand"], "residual", "y", 50.0,
                           eb.recency_weight("season", LAST_SEASON, 2.0))


@query("context_residual_modes", "A26", TE_KEYS + " r_season:d r_context:d r_asof:d", """
WITH m AS (SELECT season, avg(y) mu FROM pit GROUP BY 1),
c AS (SELECT season, hand, ctx, avg(y) mu FROM pit GROUP BY ALL)
SELECT pit.season, day, game, pit.ctx, opp, entity, y - least(greatest(m.mu, .01), .99) r_season,
 y - least(greatest(c.mu, .01), .99) r_context, y - least(greatest(coalesce(tax0 * 5, m.mu), .01), .99) r_asof
FROM pit JOIN m USING (season) JOIN c ON c.season = pit.season AND c.hand = pit.hand AND c.ctx = pit.ctx""")
def context_residual_modes(spark, sf):
    """Residuals against season, context and as-of references."""
    rows = pit(spark, sf).withColumn("asof", F.col("tax0") * 5)
    a = eb.context_residual(rows, "y", "season", "season").withColumnRenamed("residual", "r_season")
    b = eb.context_residual(a.drop("reference"), "y", "context", "season", ["hand", "ctx"])
    b = b.withColumnRenamed("residual", "r_context").drop("reference")
    return eb.context_residual(b, "y", "asof", "season", asof="asof").withColumnRenamed(
        "residual", "r_asof")


@query("matchup_pair_table", "A27 J1", TE_KEYS + " matchup:d matchup_rel:d known:i", f"""
WITH r AS (SELECT entity % 6 pt, opp % 8 bt, y - least(greatest(avg(y) OVER (PARTITION BY season), .01), .99) r,
  0.5 ** (({LAST_SEASON} - season) / 3.0) w FROM pit WHERE {FIT}),
t AS (SELECT pt, bt, sum(w * r) / (sum(w) + 200) v, sum(w) / (sum(w) + 200) rel FROM r GROUP BY 1, 2 HAVING (pt + bt) % 5 <> 0)
SELECT season, day, game, ctx, opp, entity, coalesce(v, 0) matchup, coalesce(rel, 0) matchup_rel,
  CASE WHEN v IS NULL THEN 0 ELSE 1 END known FROM pit LEFT JOIN t ON t.pt = entity % 6 AND t.bt = opp % 8
  WHERE season = {LAST_SEASON}""")
def matchup_pair_table(spark, sf):
    """Residual table of entity type and opponent type looked up with defaults."""
    rows = pit(spark, sf).withColumns({"pt": F.col("entity") % 6, "bt": F.col("opp") % 8})
    fit = eb.context_residual(rows.filter(PAST), "y", "season", "season")
    table = eb.shrink_table(fit, ["pt", "bt"], "residual", "y", 200.0,
                            eb.recency_weight("season", LAST_SEASON, 3.0))
    table = table.filter((F.col("pt") + F.col("bt")) % 5 != 0).select(
        "pt", "bt", F.col("value").alias("matchup"), F.col("rel").alias("matchup_rel"),
        F.lit(1).alias("known"))
    return joins.lookup_join(rows.filter(LATEST), table, ["pt", "bt"],
                             {"matchup": 0.0, "matchup_rel": 0.0, "known": 0})


CTX_NULL = "CASE WHEN ctx = 7 THEN NULL ELSE ctx END"


@query("context_history", "A28 J8 A38", "hand:s cx:i n:i value:d effective_n:d", f"""
WITH m AS (SELECT season, avg(y) mu FROM pit WHERE {FIT} GROUP BY 1),
r AS (SELECT hand, {CTX_NULL} cx, y - least(greatest(mu, .01), .99) r, CASE WHEN season = {LAST_SEASON - 1} THEN 1.0 ELSE 0.5 END w
      FROM pit JOIN m USING (season) WHERE {FIT} AND hand = 'O'),
t AS (SELECT hand, cx, sum(w * r) / (sum(w) + 500) v, sum(w) en FROM r GROUP BY 1, 2),
v AS (SELECT hand, {CTX_NULL} cx, count(*) n FROM pit WHERE season = {LAST_SEASON} GROUP BY 1, 2)
SELECT v.hand, v.cx, v.n, coalesce(t.v, 0) AS value, coalesce(en, 0) effective_n
FROM v LEFT JOIN t ON v.hand IS NOT DISTINCT FROM t.hand AND v.cx IS NOT DISTINCT FROM t.cx""")
def context_history(spark, sf):
    """Residual history by context for one type, read with NULL matching NULL."""
    rows = pit(spark, sf).withColumn("cx", F.when(F.col("ctx") != 7, F.col("ctx")))
    fit = eb.context_residual(rows.filter(PAST), "y", "season", "season").filter("hand = 'O'")
    table = asof.context_history(fit, ["hand", "cx"], "season", "residual", LAST_SEASON, 500.0, 0.5)
    now = rows.filter(LATEST).groupBy("hand", "cx").agg(F.count("*").alias("n"))
    return joins.lookup_join(now, table, ["hand", "cx"], {"value": 0.0, "effective_n": 0.0}, True)


@query("entity_logit_offset", "A29", "entity:i n:i strength:d shift:d", f"""
WITH w AS (SELECT entity, 0.5 ** (({LAST_SEASON} - season) / 2.0) w, y, p FROM pit WHERE {FIT}),
g AS (SELECT entity, count(*) n, sum(w * (y - p)) / sum(w * p * (1 - p)) o FROM w GROUP BY 1)
SELECT entity, n, k AS strength, CASE WHEN n >= 100 THEN o * n / (n + k) ELSE 0 END AS shift
FROM g, (VALUES (50.0), (200.0), (800.0)) t(k)""")
def entity_logit_offset(spark, sf):
    """Shrunken logit offsets per entity over a grid of strengths."""
    fit = pit(spark, sf).filter(PAST)
    table = eb.logit_offset(fit, ["entity"], "y", "p", 0.0, 100,
                            weight=eb.recency_weight("season", LAST_SEASON, 2.0))
    grid = table.withColumn("strength", F.explode(F.array(*[F.lit(k) for k in (50.0, 200.0, 800.0)])))
    return grid.withColumn("shift", F.col("offset") * F.col("n") / (F.col("n") + F.col("strength")))


@query("entity_logit_shift", "A39", "entity:i n:i shift:d", f"""
SELECT entity, count(*) n, least(greatest(count(*) / (count(*) + 100.0) * (sum(y - p) / count(*)) / (avg(p) * (1 - avg(p))), -1), 1) AS "shift"
FROM pit WHERE {FIT} GROUP BY 1 HAVING count(*) >= 30""")
def entity_logit_shift(spark, sf):
    """Earlier-fold residuals of an entity as a bounded logit shift."""
    return eb.entity_logit_shift(pit(spark, sf).filter(PAST), "entity", "y", "p", 100.0)


@query("prior_history_counts", "A31 P30", "entity:i cutoff:i prior_n:i previous_n:i best_season_n:i cohort:s", f"""
WITH c AS (SELECT opp AS entity, season, count(*) n FROM pit GROUP BY ALL),
p AS (SELECT entity, cutoff, sum(n) prior_n, sum(CASE WHEN season = cutoff - 1 THEN n ELSE 0 END) previous_n, max(n) best_season_n
 FROM c, (VALUES {', '.join(f'({c})' for c in CUTOFFS)}) t(cutoff) WHERE season < cutoff GROUP BY 1, 2)
SELECT *, CASE WHEN prior_n = 0 THEN 'unseen' WHEN best_season_n <= 5 THEN 'rookie' WHEN previous_n = 0 THEN 'returning' ELSE 'veteran' END cohort FROM p""")
def prior_history_counts(spark, sf):
    """Rows known before each cutoff and the experience class they imply."""
    from foretally.functions.buckets import cohort
    rows = pit(spark, sf).select(F.col("opp").alias("entity"), "season")
    out = asof.prior_counts(rows, "entity", "season", CUTOFFS)
    return out.withColumn("cohort", cohort(F.col("prior_n"), F.col("best_season_n"), F.col("previous_n"), 5))


@query("eligible_rows", "A30 J5", "entity:i season:i season_n:i rows:i", """
SELECT entity, season, count(*) season_n, count(*) AS rows FROM pit WHERE season < 2000 GROUP BY 1, 2 HAVING count(*) >= 80""")
def eligible_rows(spark, sf):
    """Rows of entity seasons with enough volume before the cutoff."""
    rows = asof.eligible_rows(pit(spark, sf), "entity", "season", 2000, 80)
    return rows.groupBy("entity", "season", "season_n").agg(F.count("*").alias("rows"))


@query("pooled_statistics", "A37", "entity:i cutoff:i prior_n:i best_season_n:i previous_n:i qty_mean:d qty_std:d tax0_mean:d tax0_std:d", f"""
SELECT entity, cutoff, count(*) prior_n, max(sn) best_season_n, sum(CASE WHEN season = cutoff - 1 THEN 1 ELSE 0 END) previous_n,
 avg(qty) qty_mean, stddev_samp(qty) qty_std, avg(tax0) tax0_mean, stddev_samp(tax0) tax0_std
FROM (SELECT *, count(*) OVER (PARTITION BY entity, season) sn FROM pit), (VALUES {', '.join(f'({c})' for c in CUTOFFS)}) t(cutoff)
WHERE season < cutoff GROUP BY 1, 2""")
def pooled_statistics(spark, sf):
    """Mean and deviation over all earlier rows from season moments."""
    return asof.pooled_statistics(pit(spark, sf), "entity", "season", ["qty", "tax0"], CUTOFFS)


@query("versioned_profile_join", "J3", "season:i available:i n:i value_sum:d4", f"""
WITH {priors_sql(CUTOFFS)}, c AS (SELECT entity, season, sum(y) s, count(*) n FROM pit GROUP BY ALL),
t AS (SELECT entity, cutoff, (sum(s) + 80 * any_value(ewm)) / (sum(n) + 80) v FROM c, pri WHERE season < cutoff AND entity % 3 <> 0 GROUP BY 1, 2)
SELECT pit.season, CASE WHEN v IS NULL THEN 0 ELSE 1 END available, count(*) n, sum(v) value_sum
FROM pit LEFT JOIN t ON t.entity = pit.entity AND t.cutoff = pit.season GROUP BY 1, 2""")
def versioned_profile_join(spark, sf):
    """Each season reads the table whose cutoff is that season."""
    rows = pit(spark, sf)
    priors = asof.season_priors(rows, "season", "y", CUTOFFS)
    cells = asof.season_cells(rows.filter(F.col("entity") % 3 != 0), ["entity"], "season", "y")
    flat = joins.spread_to_cutoffs(cells, "season", CUTOFFS).groupBy("entity", "cutoff").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"))
    table = flat.join(priors, "cutoff").select(
        "entity", "cutoff", ((F.col("s") + 80 * F.col("ewm")) / (F.col("n") + 80)).alias("v"))
    out = joins.season_version_join(rows, table, "entity", "season")
    return out.groupBy("season", "available").agg(F.count("*").alias("n"), F.sum("v").alias("value_sum"))


@query("validated_lookup", "J2", "nation:s n:i", """
SELECT n_name nation, count(*) n FROM pit JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def validated_lookup(spark, sf):
    """Many-to-one joins whose cardinality is proved before joining."""
    from foretally.plans.bindings import table
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"),
                                              F.col("s_nationkey").alias("n_nationkey"))
    rows = joins.validated_join(pit(spark, sf).select("entity"), sup, ["entity"], "many_to_one", "inner")
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return joins.validated_join(rows, nations, ["n_nationkey"], "many_to_one", "inner").groupBy(
        "nation").agg(F.count("*").alias("n"))


@query("semi_anti_coverage", "J6", "kind:s n:i", f"""
WITH past AS (SELECT DISTINCT opp FROM pit WHERE season = 1995), now AS (SELECT * FROM pit WHERE season = {LAST_SEASON})
SELECT 'matched' kind, count(*) n FROM now WHERE opp IN (SELECT opp FROM past) UNION ALL
SELECT 'new' kind, count(*) n FROM now WHERE opp NOT IN (SELECT opp FROM past)""")
def semi_anti_coverage(spark, sf):
    """Rows of entities seen and not seen in the first season."""
    rows = pit(spark, sf)
    past = rows.filter("season = 1995").select("opp").distinct()
    now = rows.filter(LATEST)
    part = lambda how, kind: now.join(past, "opp", how).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return part("left_semi", "matched").unionByName(part("left_anti", "new"))


@query("season_coverage_full", "J7", "k:i a_n:i b_n:i", """
SELECT k, coalesce(a_n, 0) a_n, coalesce(b_n, 0) b_n FROM (SELECT season AS k, count(*) a_n FROM pit WHERE season < 2000 GROUP BY 1)
FULL JOIN (SELECT year(o_orderdate) AS k, count(*) b_n FROM orders WHERE year(o_orderdate) > 1996 GROUP BY 1) USING (k)""")
def season_coverage_full(spark, sf):
    """Season counts of two logs side by side."""
    from foretally.plans.bindings import table
    a = pit(spark, sf).filter("season < 2000").groupBy(F.col("season").alias("k")).agg(F.count("*").alias("a_n"))
    b = table(spark, sf, "orders").filter("year(o_orderdate) > 1996").groupBy(
        F.year("o_orderdate").alias("k")).agg(F.count("*").alias("b_n"))
    return a.join(b, "k", "full_outer").na.fill(0, ["a_n", "b_n"])


@query("recency_sample_weights", "A33", TE_KEYS + " weight:d", f"""
WITH w AS (SELECT *, 0.5 ** (greatest({LAST_SEASON} - season, 1) / 3.0) w FROM pit WHERE {FIT})
SELECT season, day, game, ctx, opp, entity, w / (SELECT avg(w) FROM w) weight FROM w""")
def recency_sample_weights(spark, sf):
    """Half-life weights scaled to mean one."""
    rows = pit(spark, sf).filter(PAST).withColumn(
        "w", half_life(F.greatest(LAST_SEASON - F.col("season"), F.lit(1)), 3.0))
    return rows.withColumn("weight", F.col("w") / rows.agg(F.avg("w")).scalar())
