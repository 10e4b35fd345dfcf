"""Descriptive tables and data audits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from foretally.functions import buckets
from foretally.operators import audit
from foretally.operators.ordered import History
from foretally.plans.bindings import (LATEST, LAST_SEASON, PIT_ORDER, PIT_SQL_ORDER, ev, pit,
                                      table)
from foretally.plans.catalog import query

GROUPS = [["season"], ["season", "hand"], ["month"], ["ctx"], ["hand"], ["vol"]]
VOL = "CASE WHEN qty > 0 AND qty <= 3 THEN '1-3' WHEN qty > 3 AND qty <= 6 THEN '4-6' WHEN qty > 6 AND qty <= 9 THEN '7-9' WHEN qty > 9 THEN '10+' END"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n}::DOUBLE)", 1.96
    mid = f"({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"{mid} - {half}", f"{mid} + {half}"


LO, HI = wilson_sql("hits", "n")
GROUP_SQL = " UNION ALL ".join(
    f"SELECT '{','.join(g)}' AS \"grouping\", concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in g)}) AS \"level\", count(*) n, sum(y) hits FROM b GROUP BY {', '.join(g)}"
    for g in GROUPS)


@query("outcome_by_groups", "D1", "grouping:s level:s n:i hits:i rate:d lift_pp:d ci_low:d ci_high:d", f"""
WITH b AS (SELECT *, {VOL} vol FROM pit), g AS ({GROUP_SQL})
SELECT *, hits / n rate, (hits / n - (SELECT avg(y) FROM pit)) * 100 lift_pp, {LO} ci_low, {HI} ci_high FROM g""".replace('"grouping"', 'grp').replace("SELECT *, hits", "SELECT grp AS \"grouping\", \"level\", n, hits, hits"))
def outcome_by_groups(spark, sf):
    """Outcome rate, lift and interval for several groupings in one pass."""
    rows = pit(spark, sf).withColumn("vol", buckets.cut(
        F.col("qty"), [0, 3, 6, 9, float("inf")], ["1-3", "4-6", "7-9", "10+"]))
    return audit.target_by(rows, GROUPS, "y")


PROFILE_COLS = ["qty", "price", "tax0", "ctx"]


def samples_sql(c: str) -> str:
    return f"(SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR v FROM pit WHERE {c} IS NOT NULL ORDER BY v LIMIT 3))"


def numeric_summary_sql(c: str) -> str:
    q = ", ".join(f"quantile_cont({c}::DOUBLE, {p}) {n}" for n, p in audit.PROFILE_PROBS.items())
    return f"""SELECT '{c}' AS "column", {samples_sql(c)} samples, count(*) AS "rows", count(*) - count({c}) missing_n, count(DISTINCT {c}) nunique,
 min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", avg({c}) mean, stddev_samp({c}) std, {q} FROM pit"""


@query("column_profile", "D2 D36", "column:s rows:i missing_n:i nunique:i missing_pct:d samples:s min:d max:d mean:d4 std:d4 p01:d4 p25:d4 median:d4 p75:d4 p99:d4",
       "SELECT *, 100.0 * missing_n / \"rows\" missing_pct FROM (" + " UNION ALL ".join(numeric_summary_sql(c) for c in PROFILE_COLS)
       + f""" UNION ALL SELECT 'hand', {samples_sql('hand')}, count(*), count(*) - count(hand), count(DISTINCT hand), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pit)""")
def column_profile(spark, sf):
    """Type, missing, distinct and quantiles per column."""
    return audit.schema_profile(pit(spark, sf).select(*PROFILE_COLS, "hand"))


# Values with NaN and both infinities among them.
ODD_SQL = ("CASE event_id % 97 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) "
           "WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value * 1.0037e0 END")


def audit_sql(cols: list[str], keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    parts = []
    for c in cols:
        f = f"(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END)"
        q = ", ".join(f"quantile_cont({f}, {p}) {n}" for n, p in audit.AUDIT_PROBS.items())
        join_ = "USING (" + keys + ")" if keys else "ON true"
        parts.append(f"""SELECT {k}'{c}' metric, n, missing_rate, nonfinite_rate, zero_rate, negative_rate, {', '.join(audit.AUDIT_PROBS)},
 o / k::DOUBLE outside_3iqr_rate FROM (SELECT {k}count(*) n, avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) missing_rate, avg(CASE WHEN NOT isfinite({c}::DOUBLE) THEN 1 ELSE 0 END) nonfinite_rate, avg(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) zero_rate,
 avg(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) negative_rate, count({f}) k, {q} FROM b {'GROUP BY ' + keys if keys else ''}) s JOIN
 (SELECT {k}sum(CASE WHEN {f} < q0250 - 3 * (q0750 - q0250) OR {f} > q0750 + 3 * (q0750 - q0250) THEN 1 ELSE 0 END) o FROM b JOIN
  (SELECT {k}quantile_cont({f}, 0.25) q0250, quantile_cont({f}, 0.75) q0750 FROM b {'GROUP BY ' + keys if keys else ''}) z {join_} {'GROUP BY ' + keys if keys else ''}) w {join_}""")
    return f"WITH b AS (SELECT *, pow(value, 3) cube, {ODD_SQL} odd FROM ev) " + " UNION ALL ".join(parts)


AUDIT_OUT = "metric:s n:i missing_rate:d nonfinite_rate:d zero_rate:d negative_rate:d " + " ".join(
    f"{n}:d2" for n in audit.AUDIT_PROBS) + " outside_3iqr_rate:d"


@query("numeric_audit", "D3", AUDIT_OUT, audit_sql(["value", "cube", "odd"]))
def numeric_audit(spark, sf):
    """Nine quantiles, rates of odd values and share outside three IQR."""
    return audit.numeric_audit(ev(spark, sf).withColumns({"cube": F.pow("value", F.lit(3.0)), "odd": F.expr(ODD_SQL)}), [],
                               ["value", "cube", "odd"])


@query("metric_profile_by_type", "D4", "event_type:s " + AUDIT_OUT, audit_sql(["value", "odd"], "event_type"))
def metric_profile_by_type(spark, sf):
    """The numeric audit per event type."""
    return audit.numeric_audit(ev(spark, sf).withColumn("odd", F.expr(ODD_SQL)), ["event_type"], ["value", "odd"])


@query("transfer_clip_audit", "D5", "target:i metric:s past_low:d2 past_high:d2 below_rate:d above_rate:d clipped_rate:d", f"""
WITH t AS (SELECT * FROM (VALUES (1999), (2000), (2001)) v(target)),
l AS (SELECT target, quantile_cont(price, 0.001) past_low, quantile_cont(price, 0.999) past_high FROM pit, t WHERE season < target GROUP BY 1)
SELECT target, 'price' metric, past_low, past_high, avg(CASE WHEN price < past_low THEN 1 ELSE 0 END) below_rate,
 avg(CASE WHEN price > past_high THEN 1 ELSE 0 END) above_rate, avg(CASE WHEN price < past_low OR price > past_high THEN 1 ELSE 0 END) clipped_rate
FROM pit JOIN l ON season = target GROUP BY 1, 3, 4""")
def transfer_clip_audit(spark, sf):
    """Past quantile bounds applied to later seasons."""
    return audit.transfer_clip_audit(pit(spark, sf), "season", ["price"], [1999, 2000, 2001])


CHECKS = {
    "qty_range": "NOT (qty BETWEEN 1 AND 50)",
    "tax_rate_range": "NOT (tax BETWEEN 0 AND 0.07)",
    "label_domain": "lab NOT IN ('A', 'N')",
    "missing_cents": "cents IS NULL",
    "season_matches_day": "season <> year(day)",
    "price_pair": "abs(price / qty - 1000) > 900",
}


@query("integrity_violations", "D6", "check:s violations:i denominator:i violation_pct:d", " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", sum(CASE WHEN {e} THEN 1 ELSE 0 END) violations, count(*) denominator, 100.0 * sum(CASE WHEN {e} THEN 1 ELSE 0 END) / count(*) violation_pct FROM pit"
    for n, e in CHECKS.items()))
def integrity_violations(spark, sf):
    """Named predicates counted in one aggregation."""
    return audit.violations(pit(spark, sf), {n: F.expr(e) for n, e in CHECKS.items()})


@query("status_report", "D7 D6", "check:s violations:i status:s", "SELECT \"check\", violations, CASE WHEN violations = 0 THEN 'PASS' WHEN \"check\" IN ('missing_cents') THEN 'WARN' ELSE 'FAIL' END status FROM ("
       + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", sum(CASE WHEN {e} THEN 1 ELSE 0 END) violations FROM pit" for n, e in CHECKS.items())
       + """ UNION ALL SELECT 'duplicate_sequence_key', count(*) - count(DISTINCT (game, ctx)) FROM pit
 UNION ALL SELECT 'chronological_split', CASE WHEN max(CASE WHEN season < 2001 THEN day END) < min(CASE WHEN season >= 2001 THEN day END) THEN 0 ELSE 1 END FROM pit)""")
def status_report(spark, sf):
    """PASS, WARN or FAIL per check, duplicates and chronology included."""
    rows = pit(spark, sf)
    base = audit.violations(rows, {n: F.expr(e) for n, e in CHECKS.items()}).select("check", "violations")
    dup = audit.duplicate_rows(rows, ["game", "ctx"]).select(
        F.lit("duplicate_sequence_key").alias("check"), F.col("duplicates").alias("violations"))
    late = F.col("season") >= LAST_SEASON
    chrono = rows.agg((F.max(F.when(~late, F.col("day"))) >= F.min(F.when(late, F.col("day")))).cast("long").alias("violations"))
    counts = base.unionByName(dup).unionByName(chrono.withColumn("check", F.lit("chronological_split")))
    return audit.status_report(counts, ["missing_cents"])


# Rows of the pitch table with faults of every kind; the same text serves Spark and SQL.
FAULTY = {
    "row_id": "CASE WHEN l_partkey % 211 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 'X_1' ELSE concat('TRAIN_', cast(l_orderkey * 8 + l_linenumber as varchar(30))) END",
    "y": "cast(CASE WHEN l_partkey % 89 = 0 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END as int)",
    "season": "cast(year(l_shipdate) as int)",
    "balls": "cast(l_linenumber % 4 + CASE WHEN l_suppkey % 31 = 0 THEN 4 ELSE 0 END as int)",
    "strikes": "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE cast(l_orderkey % 3 as int) END",
    "month": "cast(month(l_shipdate) as int)",
    "top": "cast(l_linenumber as int)", "bottom": "cast(l_suppkey % 7 as int)",
    "total": "cast(l_linenumber + l_suppkey % 7 + CASE WHEN l_partkey % 61 = 0 THEN 1 ELSE 0 END as int)",
    "on1": "cast(l_partkey % 2 as int)", "on2": "cast(l_suppkey % 2 as int)", "on3": "cast(l_orderkey % 2 as int)",
    "runners": "cast(l_partkey % 2 + l_suppkey % 2 + CASE WHEN l_partkey % 41 = 0 THEN 3 ELSE l_orderkey % 2 END as int)",
    "base": "concat(CASE WHEN l_partkey % 2 = 1 THEN '1' ELSE '_' END, CASE WHEN l_suppkey % 2 = 1 THEN '2' ELSE '_' END, CASE WHEN l_orderkey % 2 = 1 AND l_partkey % 37 <> 0 THEN '3' ELSE '_' END)",
    "home_win": "20e0 + l_discount * 500e0",
    "away_win": "80e0 - l_discount * 500e0 + CASE WHEN l_partkey % 43 = 0 THEN 5e0 WHEN l_partkey % 2 = 0 THEN 5e-2 ELSE 0e0 END",
    "n": "cast(CASE WHEN l_partkey % 67 = 0 THEN -1 WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_orderkey % 300 + 1 END as int)",
    "rate": "CASE WHEN l_orderkey % 5 = 0 AND l_partkey % 71 <> 0 THEN NULL WHEN l_partkey % 83 = 0 THEN 1.5e0 ELSE l_tax * 2e0 END",
    "fast": "0.5e0 + l_tax", "slow": "0.3e0 - l_tax", "other": "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 59 = 0 THEN 0.3e0 ELSE 0.2e0 END",
    "mix_n": "cast(CASE WHEN l_partkey % 67 = 0 THEN -1 WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_partkey % 73 = 0 THEN 7 ELSE l_orderkey % 300 + 1 END as int)",
    "game": "l_orderkey", "place": "l_linenumber", "park": "cast(l_orderkey % 30 + CASE WHEN l_partkey % 101 = 0 THEN 1 ELSE 0 END as int)",
}
RULES = [
    audit.Rule("row_id_known", "known", ("row_id",)), audit.Rule("row_id_form", "matches", ("row_id", r"^TRAIN_[0-9]+$")),
    audit.Rule("row_id_unique", "unique", (("row_id",),)), audit.Rule("y_binary", "one_of", ("y", 0, 1)),
    audit.Rule("season_range", "within", ("season", 1995, 2000)), audit.Rule("balls_range", "within", ("balls", 0, 3)),
    audit.Rule("strikes_range", "within", ("strikes", 0, 2)), audit.Rule("month_range", "within", ("month", 1, 12)),
    audit.Rule("runs_add_up", "adds_up", ("total", ("top", "bottom"))), audit.Rule("runners_add_up", "adds_up", ("runners", ("on1", "on2", "on3"))),
    audit.Rule("base_coded", "is_expression", ("base", "concat(if(on1 = 1, '1', '_'), if(on2 = 1, '2', '_'), if(on3 = 1, '3', '_'))")),
    audit.Rule("win_sum_exact", "adds_up_to", (("home_win", "away_win"), 100, 1e-6)), audit.Rule("win_sum_near", "adds_up_to", (("home_win", "away_win"), 100, 0.100001)),
    audit.Rule("n_not_negative", "not_below", ("n", 0)), audit.Rule("rate_range", "within_if_known", ("rate", 0, 1)),
    audit.Rule("mix_adds_up", "adds_up_to", (("fast", "slow", "other"), 1, 2e-5)), audit.Rule("n_same", "same", ("n", "mix_n")),
    audit.Rule("rate_null_iff_none", "null_iff_zero", ("rate", "n")), audit.Rule("place_unique", "unique", (("game", "place"),)),
    audit.Rule("game_one_park", "agree", ("park", ("game",))), audit.Rule("game_one_season", "agree", ("season", ("game",))),
]
# What breaks each rule, in SQL.
BROKEN = {
    "row_id_known": "row_id IS NULL", "row_id_form": "row_id IS NULL OR NOT regexp_full_match(row_id, 'TRAIN_[0-9]+')", "row_id_unique": "rows_id > 1",
    "y_binary": "y NOT IN (0, 1)", "season_range": "season < 1995 OR season > 2000", "balls_range": "balls > 3", "strikes_range": "strikes IS NULL OR strikes > 2",
    "month_range": "month NOT BETWEEN 1 AND 12", "runs_add_up": "total <> top + bottom", "runners_add_up": "runners <> on1 + on2 + on3",
    "base_coded": "base <> CASE on1 WHEN 1 THEN '1' ELSE '_' END || CASE on2 WHEN 1 THEN '2' ELSE '_' END || CASE on3 WHEN 1 THEN '3' ELSE '_' END",
    "win_sum_exact": "abs(home_win + away_win - 100) > 1e-6", "win_sum_near": "abs(home_win + away_win - 100) > 0.100001", "n_not_negative": "n < 0",
    "rate_range": "rate < 0 OR rate > 1", "mix_adds_up": "abs(fast + slow + other - 1) > 2e-5", "n_same": "n <> mix_n", "rate_null_iff_none": "(rate IS NULL) <> (n = 0)",
    "place_unique": "rows_place > 1", "game_one_park": "parks > 1", "game_one_season": "seasons > 1",
}
RULE_SQL = f"""WITH t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in FAULTY.items())} FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY row_id) rows_id, count(*) OVER (PARTITION BY game, place) rows_place FROM t),
g AS (SELECT game, count(DISTINCT park) parks, count(DISTINCT season) seasons FROM t GROUP BY 1), x AS (SELECT * FROM w JOIN g USING (game)) """ + " UNION ALL ".join(
    f"SELECT '{r.name}' AS \"check\", '{r.kind}' kind, sum(CASE WHEN {BROKEN[r.name]} THEN 1 ELSE 0 END) violations, count(*) denominator FROM x" for r in RULES)


def faulty(spark, sf):
    from foretally.plans.bindings import table
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FAULTY.items()])


@query("rule_violations", "D6", "check:s kind:s violations:i denominator:i", RULE_SQL)
def rule_violations(spark, sf):
    """Twenty-one rules of all kinds on rows with planted faults, counted by one aggregation and one over keys."""
    return audit.rule_violations(faulty(spark, sf), RULES)


@query("rule_report", "D7 D6", "check:s violations:i status:s", f"""
SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' WHEN "check" IN ('win_sum_exact', 'n_same', 'mix_adds_up') THEN 'WARN' ELSE 'FAIL' END status FROM ({RULE_SQL})""")
def rule_report(spark, sf):
    """The rules' report with warnings for those that only inform."""
    counts = audit.rule_violations(faulty(spark, sf), RULES).select("check", "violations")
    return audit.status_report(counts, ["win_sum_exact", "n_same", "mix_adds_up"])


@query("raw_log_audit", "D8", "check:s value:i", """
WITH a AS (SELECT count(*) n, count(DISTINCT game) g, count(*) - count(DISTINCT (game, ctx)) d, count(*) - count(tax0) m FROM pit)
SELECT 'rows' AS "check", n AS value FROM a UNION ALL SELECT 'columns', 6 FROM a UNION ALL SELECT 'games', g FROM a
UNION ALL SELECT 'duplicate_keys', d FROM a UNION ALL SELECT 'missing_tax0', m FROM a""")
def raw_log_audit(spark, sf):
    """Rows, columns, games, repeated keys and missing values."""
    rows = pit(spark, sf).select("season", "game", "ctx", "entity", "opp", "tax0")
    return audit.raw_audit(rows, ["game", "ctx"], "game", ["tax0"])


@query("duplicate_feature_rows", "D9", "duplicate_rows:i duplicate_groups:i conflicting_groups:i duplicate_pct:d", """
WITH g AS (SELECT entity, ctx, hand, qty, count(*) n, count(DISTINCT y) k FROM pit GROUP BY ALL HAVING count(*) > 1)
SELECT sum(n) duplicate_rows, count(*) duplicate_groups, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) conflicting_groups,
 100.0 * sum(n) / (SELECT count(*) FROM pit) duplicate_pct FROM g""")
def duplicate_feature_rows(spark, sf):
    """Rows sharing all feature values, and those with conflicting targets."""
    return audit.duplicate_features(pit(spark, sf), ["entity", "ctx", "hand", "qty"], "y")


MISS = "SELECT *, CASE WHEN disc > 0.03 THEN disc END d0, CASE WHEN qty <= 40 THEN qty END q0 FROM pit"


@query("missingness_effect", "D10", "column:s missing_n:i missing_pct:d rate_missing:d rate_present:d gap_pp:d", f"WITH b AS ({MISS}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) missing_n, 100.0 * (count(*) - count({c})) / count(*) missing_pct, avg(CASE WHEN {c} IS NULL THEN y END) rate_missing,
 avg(CASE WHEN {c} IS NOT NULL THEN y END) rate_present, 100 * (avg(CASE WHEN {c} IS NULL THEN y END) - avg(CASE WHEN {c} IS NOT NULL THEN y END)) gap_pp FROM b"""
    for c in ("tax0", "d0", "q0")))
def missingness_effect(spark, sf):
    """Outcome rate where a column is missing against present."""
    rows = pit(spark, sf).withColumns({"d0": F.when(F.col("disc") > 0.03, F.col("disc")),
                                       "q0": F.when(F.col("qty") <= 40, F.col("qty"))})
    return audit.missingness_effect(rows, ["tax0", "d0", "q0", "price"], "y")


@query("missing_patterns", "D11 P28", "mask:i names:s n:i pct:d", f"""
WITH b AS ({MISS}), m AS (SELECT (tax0 IS NULL)::INT + 2 * (d0 IS NULL)::INT + 4 * (q0 IS NULL)::INT mask FROM b)
SELECT mask, concat_ws(',', CASE WHEN mask & 1 <> 0 THEN 'tax0' END, CASE WHEN mask & 2 <> 0 THEN 'd0' END, CASE WHEN mask & 4 <> 0 THEN 'q0' END) AS names,
 count(*) n, 100.0 * count(*) / (SELECT count(*) FROM m) pct FROM m GROUP BY 1, 2 ORDER BY n DESC, mask LIMIT 25""")
def missing_patterns(spark, sf):
    """Most frequent missing-value patterns with decoded names."""
    cols = ["tax0", "d0", "q0"]
    rows = pit(spark, sf).withColumns({"d0": F.when(F.col("disc") > 0.03, F.col("disc")),
                                       "q0": F.when(F.col("qty") <= 40, F.col("qty"))})
    total = rows.agg(F.count("*")).scalar()
    top = rows.withColumn("mask", buckets.missing_mask(cols)).groupBy("mask").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "mask").limit(25)
    return top.withColumns({"names": buckets.mask_names(F.col("mask"), cols), "pct": F.col("n") / total * 100.0})


@query("entity_profile", "D12", "entity:i n:i hits:i rate:d first_season:i last_season:i n_seasons:i mode_label:s ci_low:d ci_high:d", f"""
WITH m AS (SELECT entity, lab, count(*) c, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, lab) r FROM pit GROUP BY 1, 2),
g AS (SELECT entity, count(*) n, sum(y) hits, min(season) first_season, max(season) last_season, count(DISTINCT season) n_seasons FROM pit GROUP BY 1)
SELECT g.*, hits / n rate, lab mode_label, {LO} ci_low, {HI} ci_high FROM g JOIN m USING (entity) WHERE r = 1""")
def entity_profile(spark, sf):
    """Volume, rate, seasons and smallest mode per entity."""
    return audit.entity_profile(pit(spark, sf), "entity", "y", "season", "lab")


@query("volume_concentration", "D13", "measure:s value:d", """
WITH g AS (SELECT opp, count(*) n, row_number() OVER (ORDER BY count(*) DESC, opp) r FROM pit GROUP BY 1)
SELECT 'top_10_share_pct' AS measure, 100.0 * sum(CASE WHEN r <= 10 THEN n END) / sum(n) AS value FROM g
UNION ALL SELECT 'top_50_share_pct', 100.0 * sum(CASE WHEN r <= 50 THEN n END) / sum(n) FROM g
UNION ALL SELECT 'n_ge_25', sum(CASE WHEN n >= 25 THEN 1 ELSE 0 END) FROM g UNION ALL SELECT 'n_ge_35', sum(CASE WHEN n >= 35 THEN 1 ELSE 0 END) FROM g""")
def volume_concentration(spark, sf):
    """Share of the largest entities and counts above floors."""
    profile = pit(spark, sf).groupBy("opp").agg(F.count("*").alias("n"))
    return audit.concentration(profile, "opp", "n", [10, 50], [25, 35])


@query("entities_by_season", "D14", "season:i rows:i entities:i opponents:i rate:d",
       'SELECT season, count(*) AS "rows", count(DISTINCT entity) entities, count(DISTINCT opp) opponents, avg(y) rate FROM pit GROUP BY 1')
def entities_by_season(spark, sf):
    """Rows, distinct entities and rate per season."""
    return pit(spark, sf).groupBy("season").agg(
        F.count("*").alias("rows"), F.countDistinct("entity").alias("entities"),
        F.countDistinct("opp").alias("opponents"), F.avg("y").alias("rate"))


@query("season_overlap", "D15 INT EXC", "from_season:i to_season:i from_n:i to_n:i overlap:i retained_pct:d new_pct:d jaccard:d", """
WITH p AS (SELECT DISTINCT season, opp FROM pit), s AS (SELECT season, count(*) n FROM p GROUP BY 1),
o AS (SELECT a.season, count(*) o FROM p a JOIN p b ON a.opp = b.opp AND b.season = a.season + 1 GROUP BY 1)
SELECT a.season from_season, a.season + 1 to_season, a.n from_n, b.n to_n, o overlap, 100.0 * o / a.n retained_pct, 100.0 * (b.n - o) / b.n new_pct,
 o / (a.n + b.n - o)::DOUBLE jaccard FROM s a JOIN s b ON b.season = a.season + 1 JOIN o ON o.season = a.season""")
def season_overlap(spark, sf):
    """Retained and new entities between consecutive seasons."""
    return audit.season_overlap(pit(spark, sf), "season", "opp")


@query("within_entity_drift", "D16 J9", "season:i overlap:i stable_n:i weighted_delta_pp:d declining_pct:d median_delta_pp:d", """
WITH c AS (SELECT entity, season, count(*) n, avg(y) rate FROM pit GROUP BY 1, 2),
p AS (SELECT a.season, a.n, b.n n2, b.rate - a.rate d FROM c a JOIN c b ON a.entity = b.entity AND b.season = a.season + 1)
SELECT season, count(*) overlap, sum(CASE WHEN n >= 80 AND n2 >= 80 THEN 1 ELSE 0 END) stable_n,
 100 * sum(CASE WHEN n >= 80 AND n2 >= 80 THEN d * n2 END) / sum(CASE WHEN n >= 80 AND n2 >= 80 THEN n2 END) weighted_delta_pp,
 100 * avg(CASE WHEN n >= 80 AND n2 >= 80 THEN CASE WHEN d < 0 THEN 1 ELSE 0 END END) declining_pct,
 100 * quantile_cont(CASE WHEN n >= 80 AND n2 >= 80 THEN d END, 0.5) median_delta_pp FROM p GROUP BY 1""")
def within_entity_drift(spark, sf):
    """Rate change of the same entities one season later."""
    return audit.within_drift(pit(spark, sf), "entity", "season", "y", 80)


@query("order_diagnostics", "D17", "n:i count_matches_pct:d step_one_pct:d negative_steps:i large_steps:i recoverable_pct:d recovered_pct:d", f"""
WITH c AS (SELECT *, row_number() OVER w - 1 pos, row_number() OVER w - 1 + CASE WHEN row_number() OVER w > 50 THEN 1 ELSE 0 END n,
 coalesce(sum(y) OVER (PARTITION BY entity ORDER BY {PIT_SQL_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) cs FROM pit
 WINDOW w AS (PARTITION BY entity ORDER BY {PIT_SQL_ORDER})),
r AS (SELECT *, cs / nullif(n, 0) rate FROM c), l AS (SELECT *, n - lag(n) OVER w st, lead(n) OVER w n1, lead(rate) OVER w r1 FROM r WINDOW w AS (PARTITION BY entity ORDER BY {PIT_SQL_ORDER})),
k AS (SELECT *, coalesce(n1 = n + 1 AND r1 IS NOT NULL, false) known FROM l)
SELECT count(*) n, 100 * avg((n = pos)::INT) count_matches_pct, 100 * avg(coalesce(st = 1, false)::INT) step_one_pct, sum(CASE WHEN st < 0 THEN 1 ELSE 0 END) negative_steps,
 sum(CASE WHEN st > 1 THEN 1 ELSE 0 END) large_steps, 100 * avg(known::INT) recoverable_pct,
 100 * avg(CASE WHEN known THEN (round_even(r1 * n1 - coalesce(rate, 0) * n, 0) = y)::INT END) recovered_pct FROM k""")
def order_diagnostics(spark, sf):
    """How far cumulative counts follow row order and reveal the next target."""
    h = History(pit(spark, sf), ["entity"], PIT_ORDER).position("pos").running({"cs": F.col("y")})
    rows = h.df.withColumn("n", F.col("pos") + F.when(F.col("pos") >= 50, 1).otherwise(0)).withColumn(
        "rate", F.try_divide(F.col("cs").cast("double"), F.col("n")))
    return audit.order_diagnostics(rows, "entity", PIT_ORDER, "n", "rate", "y")


@query("sequence_gaps", "D19", "event_type:s n:i seq_min:i seq_max:i gaps:i", """
WITH s AS (SELECT event_type, event_id, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) st FROM ev)
SELECT event_type, count(*) n, min(event_id) seq_min, max(event_id) seq_max, sum(CASE WHEN st > 1 THEN 1 ELSE 0 END) gaps FROM s GROUP BY 1""")
def sequence_gaps(spark, sf):
    """Jumps of the sequence number per group."""
    return audit.sequence_gaps(ev(spark, sf), ["event_type"], "event_id")


def signal_sql(c: str) -> str:
    return f"""SELECT '{c}' metric, count({c}) n, 100.0 * (count(*) - count({c})) / count(*) missing_pct, avg(CASE WHEN y = 0 THEN {c} END) mean_0, avg(CASE WHEN y = 1 THEN {c} END) mean_1,
 (avg(CASE WHEN y = 1 THEN {c} END) - avg(CASE WHEN y = 0 THEN {c} END)) / sqrt((var_samp(CASE WHEN y = 0 THEN {c} END) + var_samp(CASE WHEN y = 1 THEN {c} END)) / 2) smd,
 corr({c}, y) pearson, (SELECT (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) FROM
  (SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 ar FROM pit WHERE {c} IS NOT NULL)) auc FROM pit"""


@query("univariate_signal", "D20", "metric:s n:i missing_pct:d mean_0:d4 mean_1:d4 smd:d pearson:d auc:d auc_strength:d",
       "SELECT *, abs(auc - 0.5) auc_strength FROM (" + " UNION ALL ".join(signal_sql(c) for c in ("qty", "price", "cents")) + ")")
def univariate_signal(spark, sf):
    """AUC, correlation and class means per numeric feature."""
    return audit.univariate_signal(pit(spark, sf), ["qty", "price", "cents"], "y")


@query("categorical_association", "D21", "feature:s levels:i big_levels:i sd_pp:d min_rate:d max_rate:d range_pp:d", " UNION ALL ".join(
    f"""SELECT '{c}' feature, count(*) levels, sum(CASE WHEN n >= 600 THEN 1 ELSE 0 END) big_levels, 100 * sqrt(sum(n * pow(r - (SELECT avg(y) FROM pit), 2)) / sum(n)) sd_pp,
 min(CASE WHEN n >= 600 THEN r END) min_rate, max(CASE WHEN n >= 600 THEN r END) max_rate, 100 * (max(CASE WHEN n >= 600 THEN r END) - min(CASE WHEN n >= 600 THEN r END)) range_pp
 FROM (SELECT {c}, count(*) n, avg(y) r FROM pit GROUP BY 1)""" for c in ("season", "month", "hand", "ctx", "entity")))
def categorical_association(spark, sf):
    """Spread of level rates per categorical feature."""
    return audit.categorical_association(pit(spark, sf), ["season", "month", "hand", "ctx", "entity"], "y", 600)


@query("correlation_matrix", "D22", "pair:s corr:d", " UNION ALL ".join(
    f"SELECT '{a}~{b}' pair, corr({a}, {b}) \"corr\" FROM pit" for i, a in enumerate(["qty", "price", "tax0", "y"]) for b in ["qty", "price", "tax0", "y"][i + 1:]))
def correlation_matrix(spark, sf):
    """Pairwise-complete Pearson correlations."""
    return audit.correlation_matrix(pit(spark, sf), ["qty", "price", "tax0", "y"])


FOLD_SQL = """f AS (SELECT entity, avg(CASE WHEN season = 2000 THEN y - p END) a, avg(CASE WHEN season = 2001 THEN y - p END) b FROM pit GROUP BY 1)"""


def fold_scores(spark, sf):
    r = F.col("y") - F.col("p")
    return pit(spark, sf).groupBy("entity").agg(F.avg(F.when(F.col("season") == 2000, r)).alias("a"),
                                                F.avg(F.when(F.col("season") == 2001, r)).alias("b"))


@query("fold_rank_agreement", "D23", "n:i spearman:d both_improve:d topk_jaccard:d", f"""
WITH {FOLD_SQL}, r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 rb,
 row_number() OVER (ORDER BY a, entity) na, row_number() OVER (ORDER BY b, entity) nb FROM f)
SELECT count(*) n, corr(ra, rb) spearman, avg((a < 0 AND b < 0)::INT) both_improve, sum((na <= 10 AND nb <= 10)::INT) / sum((na <= 10 OR nb <= 10)::INT) topk_jaccard FROM r""")
def fold_rank_agreement(spark, sf):
    """Rank correlation of two fold scores, shared improvement and top-k overlap."""
    f = fold_scores(spark, sf)
    top = lambda c: f.orderBy(c, "entity").limit(10).select("entity")
    shared = top("a").join(top("b"), "entity", "left_semi").agg(F.count("*").alias("k"))
    both = f.agg(F.avg(((F.col("a") < 0) & (F.col("b") < 0)).cast("double"))).scalar()
    k = shared.scalar()
    return audit.spearman(f, "a", "b").withColumns({"both_improve": both, "topk_jaccard": k / (20 - k)})


@query("partial_correlation", "D24", "r:d partial:d", """
WITH c AS (SELECT corr(qty, price) r, corr(qty, cents) p, corr(price, cents) q FROM pit WHERE cents IS NOT NULL)
SELECT r, (r - p * q) / sqrt((1 - p * p) * (1 - q * q)) AS partial FROM c""")
def partial_correlation(spark, sf):
    """Correlation with a control removed."""
    return audit.partial_correlation(pit(spark, sf), "qty", "price", "cents")


JS_PARTS = " UNION ALL ".join(f"SELECT season, side, '{c}' feature, CAST({c} AS VARCHAR) lv FROM s" for c in ("month", "ctx", "lab"))


@query("marginal_divergence", "D25", "season:i feature:s js_bits:d", f"""
WITH s AS (SELECT *, game % 2 side FROM pit), l AS ({JS_PARTS}),
c AS (SELECT season, feature, lv, sum((side = 0)::INT) a, sum((side = 1)::INT) b FROM l GROUP BY ALL),
d AS (SELECT season, feature, a / sum(a) OVER w p, b / sum(b) OVER w q FROM c WINDOW w AS (PARTITION BY season, feature))
SELECT season, feature, sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) js_bits FROM d GROUP BY 1, 2""")
def marginal_divergence(spark, sf):
    """Divergence of categorical marginals between two halves of the log."""
    rows = pit(spark, sf)
    even, odd = rows.filter("game % 2 = 0"), rows.filter("game % 2 = 1")
    return audit.js_divergence(even, odd, ["season"], ["month", "ctx", "lab"])


@query("label_concordance", "D26", "n:i n_both:i match_pct:d a_missing_pct:d b_missing_pct:d", """
WITH b AS (SELECT CASE WHEN tax0 IS NOT NULL THEN lab END a, CASE WHEN ctx < 5 THEN 'R' WHEN ctx < 7 THEN 'A' END b FROM pit)
SELECT count(*) n, sum((a IS NOT NULL AND b IS NOT NULL)::INT) n_both, 100 * avg((a = b)::INT) match_pct, 100 * avg((a IS NULL)::INT) a_missing_pct, 100 * avg((b IS NULL)::INT) b_missing_pct FROM b""")
def label_concordance(spark, sf):
    """Agreement of two partly missing labels."""
    rows = pit(spark, sf).select(F.when(F.col("tax0").isNotNull(), F.col("lab")).alias("a"),
                                 F.when(F.col("ctx") < 5, "R").when(F.col("ctx") < 7, "A").alias("b"))
    return audit.concordance(rows, "a", "b")


@query("code_crosstab", "D27 P26", "ctx:i A:i N:i R:i", "SELECT ctx, sum((lab = 'A')::INT) A, sum((lab = 'N')::INT) N, sum((lab = 'R')::INT) R FROM pit GROUP BY 1")
def code_crosstab(spark, sf):
    """One code against another."""
    return audit.crosstab_audit(pit(spark, sf), "ctx", "lab", ["A", "N", "R"])


@query("threshold_coverage", "D28 D41", "threshold:i entities:i covered:i rows:i share:d", f"""
WITH b AS (SELECT opp, count(*) n FROM pit WHERE season = 2000 GROUP BY 1), t AS (SELECT opp, count(*) r FROM pit WHERE season = {LAST_SEASON} GROUP BY 1),
j AS (SELECT r, coalesce(n, 0) n FROM t LEFT JOIN b USING (opp))
SELECT threshold, sum((n >= threshold)::INT) entities, sum(CASE WHEN n >= threshold THEN r ELSE 0 END) covered, sum(r) AS "rows", sum(CASE WHEN n >= threshold THEN r ELSE 0 END) / sum(r) share
FROM j, (VALUES (1), (3), (5), (8)) v(threshold) GROUP BY 1""")
def threshold_coverage(spark, sf):
    """Target rows owned by entities with enough base rows."""
    rows = pit(spark, sf)
    return audit.coverage_by_threshold(rows.filter("season = 2000"), rows.filter(LATEST), "opp", [1, 3, 5, 8])


@query("by_prior_volume", "D29 P22 J1", "bucket:s n:i rate:d", f"""
WITH b AS (SELECT opp, count(*) n FROM pit WHERE season = 2000 GROUP BY 1)
SELECT CASE WHEN coalesce(n, 0) <= 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END bucket, count(*) n, avg(y) rate
FROM (SELECT pit.opp, y, b.n FROM pit LEFT JOIN b ON b.opp = pit.opp WHERE season = {LAST_SEASON}) GROUP BY 1""")
def by_prior_volume(spark, sf):
    """Target rows grouped by the entity's previous-season volume."""
    rows = pit(spark, sf)
    prior = rows.filter("season = 2000").groupBy("opp").agg(F.count("*").alias("base_n"))
    out = rows.filter(LATEST).join(prior, "opp", "left").na.fill(0, ["base_n"])
    label = buckets.cut(F.col("base_n"), [-1, 0, 3, 6, float("inf")], ["0", "1-3", "4-6", "7+"])
    return out.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


@query("entity_overview", "D30", "entity:i n:i rate:d tries:i hits:i hit_rate:d avg_qty:d first_day:s last_day:s games:i", """
SELECT entity, count(*) n, avg(y) rate, sum((hand = 'O')::INT) tries, sum((hand = 'O')::INT * y) hits, sum((hand = 'O')::INT * y) / nullif(sum((hand = 'O')::INT), 0) hit_rate,
 avg(qty) avg_qty, min(day) first_day, max(day) last_day, count(DISTINCT game) games FROM pit GROUP BY 1 HAVING count(*) >= 100""")
def entity_overview(spark, sf):
    """Counts, safe ratios, dates and games per entity."""
    rows = pit(spark, sf).withColumn("tr", (F.col("hand") == "O").cast("int")).withColumn("ht", F.col("tr") * F.col("y"))
    return audit.rate_profile(rows, ["entity"], "y", "tr", "ht", ["qty"], "day", "game", 100)


@query("class_usage_profile", "D30", "entity:i lab:s n:i usage:d avg_qty:d avg_price:d2", """
SELECT entity, lab, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY entity) AS "usage", avg(qty) avg_qty, avg(price) avg_price FROM pit GROUP BY 1, 2""")
def class_usage_profile(spark, sf):
    """Usage share and averages per class inside an entity."""
    rows = pit(spark, sf).withColumn("one", F.lit(1))
    return audit.rate_profile(rows, ["entity", "lab"], "y", "one", "y", ["qty", "price"], share_of=["entity"])


@query("label_composition", "D31 D38", "season:i lab:s n:i share:d",
       "SELECT season, lab, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY season) share FROM pit GROUP BY 1, 2")
def label_composition(spark, sf):
    """Share of each label by season."""
    return audit.composition(pit(spark, sf), ["season"], "lab")


@query("count_matrix", "D31", "ctx:i F:d O:d", "SELECT ctx, avg(CASE WHEN hand = 'F' THEN y END) F, avg(CASE WHEN hand = 'O' THEN y END) O FROM pit GROUP BY 1")
def count_matrix(spark, sf):
    """Mean outcome by two codes."""
    return audit.mean_matrix(pit(spark, sf), "ctx", "hand", ["F", "O"], "y")


INDEX_SQL = """t AS (SELECT season, entity, count(*) n, stddev_samp(qty) s1, stddev_samp(price) s2 FROM pit GROUP BY 1, 2 HAVING count(*) >= 70),
ix AS (SELECT *, (rank() OVER (PARTITION BY season ORDER BY s1 DESC) + (count(*) OVER (PARTITION BY season, s1) - 1) / 2.0) / count(*) OVER (PARTITION BY season) p1,
 (rank() OVER (PARTITION BY season ORDER BY s2 DESC) + (count(*) OVER (PARTITION BY season, s2) - 1) / 2.0) / count(*) OVER (PARTITION BY season) p2 FROM t),
kx AS (SELECT season, entity, n, p1, p2, 0.75 * p1 + 0.25 * p2 AS idx FROM ix)"""


def index_table(spark, sf):
    return audit.repeatability_index(pit(spark, sf), "season", "entity", {"qty": 0.75, "price": 0.25}, 70)


@query("repeatability_index", "D32", "season:i entity:i n:i qty_pct:d price_pct:d index:d",
       f'WITH {INDEX_SQL} SELECT season, entity, n, p1 qty_pct, p2 price_pct, idx AS "index" FROM kx')
def repeatability_index(spark, sf):
    """Deviation percentiles inside the season and their weighted mean."""
    return index_table(spark, sf)


@query("index_stickiness", "D33 J9", "season:i common:i r:d r2:d", f"""
WITH {INDEX_SQL} SELECT a.season, count(*) common, corr(a.idx, b.idx) r, pow(corr(a.idx, b.idx), 2) r2 FROM kx a JOIN kx b ON a.entity = b.entity AND b.season = a.season + 1
GROUP BY 1 HAVING count(*) >= 10""")
def index_stickiness(spark, sf):
    """Correlation of the index with the following season."""
    return audit.stickiness(index_table(spark, sf), "season", "entity", "index")


@query("quintile_outcome", "D34", "bucket:i n:i mean_value:d mean_outcome:d", """
WITH e AS (SELECT entity, avg(CASE WHEN season = 2000 THEN price END) v, avg(CASE WHEN season = 2001 THEN y END) o FROM pit GROUP BY 1),
q AS (SELECT quantile_cont(v, 0.2) e1, quantile_cont(v, 0.4) e2, quantile_cont(v, 0.6) e3, quantile_cont(v, 0.8) e4 FROM e)
SELECT (v > e1)::INT + (v > e2)::INT + (v > e3)::INT + (v > e4)::INT bucket, count(*) n, avg(v) mean_value, avg(o) mean_outcome FROM e, q GROUP BY 1""")
def quintile_outcome(spark, sf):
    """Next-season outcome by quintile of a value."""
    e = pit(spark, sf).groupBy("entity").agg(F.avg(F.when(F.col("season") == 2000, F.col("price"))).alias("v"),
                                             F.avg(F.when(F.col("season") == 2001, F.col("y"))).alias("o"))
    return audit.quantile_table(e, "v", 5, "o")


OUTING_SQL = "o AS (SELECT entity, season, count(*) n, avg(y) actual, avg(p) expected, avg(p2) history FROM pit GROUP BY 1, 2 HAVING count(*) >= 80)"


def outings(spark, sf):
    return audit.outing_calibration(pit(spark, sf), ["entity", "season"], "y", "p", "p2", 80)


@query("outing_calibration", "D35", "entity:i season:i n:i actual:d expected:d history:d", f"WITH {OUTING_SQL} SELECT * FROM o")
def outing_calibration(spark, sf):
    """Actual against expected and historical means per outing."""
    return outings(spark, sf)


@query("outing_agreement", "D35", "n:i mae:d rmse:d r2:d corr:d", f"""
WITH {OUTING_SQL} SELECT count(*) n, avg(abs(actual - expected)) mae, sqrt(avg(pow(actual - expected, 2))) rmse,
 1 - avg(pow(actual - expected, 2)) / var_pop(actual) r2, corr(actual, expected) AS "corr" FROM o""")
def outing_agreement(spark, sf):
    """Error and correlation of outing means."""
    return audit.agreement(outings(spark, sf), "actual", "expected")


@query("season_volume_leaders", "D37 O3", "season:i entity:i n:i rank:i median_n:d", """
WITH c AS (SELECT season, entity, count(*) n FROM pit GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY n DESC, entity) AS rk FROM c)
SELECT season, entity, r.n, rk AS "rank", m AS median_n FROM r JOIN (SELECT season, quantile_cont(n, 0.5) m FROM c GROUP BY 1) USING (season) WHERE rk <= 3""")
def season_volume_leaders(spark, sf):
    """Top three entities and median volume per season."""
    from foretally.operators.ranks import exact_quantiles
    c = pit(spark, sf).groupBy("season", "entity").agg(F.count("*").alias("n"))
    top = c.withColumn("rank", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("n"), "entity"))).filter("rank <= 3")
    return top.join(exact_quantiles(c, ["season"], "n", {"median_n": 0.5}), "season")


@query("failure_type_rates", "D38", "hand:s season:i n:i share:d rate_a:d rate_n:d", """
SELECT hand, season, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY season) share, avg((lab = 'A')::INT) rate_a, avg((lab = 'N')::INT) rate_n FROM pit GROUP BY 1, 2""")
def failure_type_rates(spark, sf):
    """Type share of the season with component rates."""
    g = pit(spark, sf).groupBy("hand", "season").agg(
        F.count("*").alias("n"), F.avg((F.col("lab") == "A").cast("int")).alias("rate_a"),
        F.avg((F.col("lab") == "N").cast("int")).alias("rate_n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season")))


LABELS2 = "SELECT *, CASE WHEN lab <> 'R' AND qty > 20 THEN 1 ELSE 0 END ma, CASE WHEN lab = 'N' AND disc > 0.04 THEN 1 ELSE 0 END mb FROM pit"


def two_labels(spark, sf):
    return pit(spark, sf).withColumns({
        "ma": ((F.col("lab") != "R") & (F.col("qty") > 20)).cast("int"),
        "mb": ((F.col("lab") == "N") & (F.col("disc") > 0.04)).cast("int")})


@query("failure_structure", "D39 X7", "n:i failures:i a_and_success:i both:i rest:i mismatch:i independent:d joint:d phi:d formula_error:d", f"""
WITH b AS ({LABELS2})
SELECT count(*) n, sum(1 - y) failures, sum(ma * y) a_and_success, sum(ma * mb) AS "both", sum((1 - y) * (1 - ma) * (1 - mb)) rest,
 sum(((ma = 1 OR mb = 1 OR (y = 0 AND ma = 0 AND mb = 0)) <> (y = 0))::INT) mismatch, avg(ma) * avg(mb) independent, avg(ma * mb) joint, corr(ma, mb) phi,
 (1 - avg(ma)) * (1 - avg(mb)) - avg((1 - y) * (1 - ma) * (1 - mb)) - avg(y) formula_error FROM b""")
def failure_structure(spark, sf):
    """Exclusivity and dependence of two failure labels."""
    return audit.failure_structure(two_labels(spark, sf), "y", "ma", "mb")


@query("phi_by_slice", "D40", "slice:s level:s n:i phi:d lift:d", f"WITH b AS ({LABELS2}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS slice, CAST({c} AS VARCHAR) AS "level", count(*) n, (avg(ma * mb) - avg(ma) * avg(mb)) / sqrt(avg(ma) * (1 - avg(ma)) * avg(mb) * (1 - avg(mb))) phi,
 avg(ma * mb) / (avg(ma) * avg(mb)) lift FROM b GROUP BY {c} HAVING count(*) >= 2000""" for c in ("season", "hand", "month")))
def phi_by_slice(spark, sf):
    """Dependence of two labels per slice level."""
    return audit.phi_by_slice(two_labels(spark, sf), ["season", "hand", "month"], "ma", "mb", 2000)


@query("phi_slice_summary", "D40", "slice:s min_phi:d max_phi:d strong:i", "WITH b AS (" + LABELS2 + "), s AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS slice, (avg(ma * mb) - avg(ma) * avg(mb)) / sqrt(avg(ma) * (1 - avg(ma)) * avg(mb) * (1 - avg(mb))) phi FROM b GROUP BY {c} HAVING count(*) >= 2000"""
    for c in ("season", "hand", "month")) + ") SELECT slice, min(phi) min_phi, max(phi) max_phi, sum((abs(phi) > 0.03)::INT) strong FROM s GROUP BY 1")
def phi_slice_summary(spark, sf):
    """Range of the dependence per slice."""
    s = audit.phi_by_slice(two_labels(spark, sf), ["season", "hand", "month"], "ma", "mb", 2000)
    return s.groupBy("slice").agg(F.min("phi").alias("min_phi"), F.max("phi").alias("max_phi"),
                                  F.count_if(F.abs("phi") > 0.03).alias("strong"))


@query("concentration_curve", "D42", "opp:i n:i rank:i cum_share:d entity_share:d", """
WITH c AS (SELECT opp, count(*) n FROM pit GROUP BY 1)
SELECT opp, n, row_number() OVER w AS "rank", sum(n) OVER w / sum(n) OVER () cum_share, row_number() OVER w / count(*) OVER () entity_share FROM c
WINDOW w AS (ORDER BY n DESC, opp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def concentration_curve(spark, sf):
    """Cumulative share of rows by entity volume."""
    return audit.concentration_curve(pit(spark, sf).groupBy("opp").agg(F.count("*").alias("n")), "opp", "n")


@query("manifest_reconciliation", "D43", "season:i loaded:i expected:i matches:i", """
SELECT season, count(*) loaded, coalesce(any_value(e), 0) expected, CASE WHEN count(*) = coalesce(any_value(e), 0) THEN 1 ELSE 0 END matches FROM pit LEFT JOIN
 (SELECT season, sum(n) e FROM (SELECT season, month, count(*) n FROM pit WHERE NOT (season = 1998 AND month = 3) GROUP BY 1, 2) GROUP BY 1) USING (season) GROUP BY 1""")
def manifest_reconciliation(spark, sf):
    """Loaded rows per season against the chunk manifest."""
    rows = pit(spark, sf)
    chunks = rows.filter("NOT (season = 1998 AND month = 3)").groupBy("season", "month").agg(F.count("*").alias("n"))
    manifest = chunks.groupBy("season").agg(F.sum("n").alias("n"))
    return audit.reconcile(rows.groupBy("season").agg(F.count("*").alias("n")), manifest, ["season"])


@query("residual_variance", "D44", "entities:i rows:i observed:d8 expected:d8 excess:d8 ceiling:d3", """
WITH c AS (SELECT opp, count(*) n, avg(y - p) r, avg(p * (1 - p)) v FROM pit GROUP BY 1 HAVING count(*) >= 25),
s AS (SELECT count(*) entities, sum(n) AS "rows", sum(n * r * r) / sum(n) observed, sum(v) / sum(n) expected FROM c)
SELECT *, observed - expected excess, 1e5 * (observed - expected) / (SELECT avg(y) * (1 - avg(y)) FROM pit) ceiling FROM s""")
def residual_variance(spark, sf):
    """Entity residual spread beyond what noise explains."""
    return audit.residual_variance(pit(spark, sf), "opp", "y", "p", 25)


@query("label_identity", "D45 P4", "n:i mismatches:i", f"""
SELECT count(*) n, sum((lab = 'R' OR lab = 'A')::INT <> (CASE WHEN (hand = 'O' AND lab = 'R') OR (hand <> 'O' AND lab = 'A') THEN 1 ELSE 0 END))::BIGINT mismatches FROM pit""".replace(
    "sum((lab = 'R' OR lab = 'A')::INT <> (CASE", "sum(((lab = 'R' OR lab = 'A')::INT <> (CASE").replace("ELSE 0 END))::BIGINT", "ELSE 0 END))::INT)"))
def label_identity(spark, sf):
    """Rows where a composed label differs from its parts."""
    swing, whole = F.col("hand") == "O", F.col("lab").isin("R", "A")
    composed = (swing & (F.col("lab") == "R")) | (~swing & (F.col("lab") == "A"))
    return pit(spark, sf).agg(F.count("*").alias("n"), F.count_if(whole != composed).alias("mismatches"))
