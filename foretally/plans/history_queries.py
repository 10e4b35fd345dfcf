"""Past-only window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions.rates import eb
from foretally.operators import history as hist
from foretally.operators.ordered import History
from foretally.plans.bindings import PAST, EV_ORDER, LAST_SEASON, PIT_ORDER, PIT_SQL_ORDER, ev, pit
from foretally.plans.catalog import query
from foretally.roles import Order

KEY = "season:i day:s game:i ctx:i opp:i entity:i"
KEY_SQL = "season, day, game, ctx, opp, entity"
ENTITY_W = f"PARTITION BY entity ORDER BY {PIT_SQL_ORDER}"
GAME_W = f"PARTITION BY game, entity ORDER BY {PIT_SQL_ORDER}"
USER_W = "PARTITION BY user_id ORDER BY ts, event_id"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def entity_history(spark, sf) -> History:
    return History(pit(spark, sf), ["entity"], PIT_ORDER)


@query("lagged_values", "W1", KEY + " prev_lab_1:s prev_lab_2:s prev_lab_3:s prev_qty_1:d prev_price_1:d2", f"""
SELECT {KEY_SQL}, lag(lab, 1) OVER w prev_lab_1, lag(lab, 2) OVER w prev_lab_2, lag(lab, 3) OVER w prev_lab_3,
 lag(qty, 1) OVER w prev_qty_1, lag(price, 1) OVER w prev_price_1 FROM pit WINDOW w AS ({ENTITY_W})""")
def lagged_values(spark, sf):
    """Previous labels and metrics of the entity."""
    return entity_history(spark, sf).frames(3, lambda w: {
        **hist.lag_columns(w, ["lab"], [1, 2, 3]), **hist.lag_columns(w, ["qty", "price"], [1])}).df


@query("count_before", "W2", KEY + " in_game:i in_career:i", f"""
SELECT {KEY_SQL}, row_number() OVER ({GAME_W}) - 1 in_game, row_number() OVER ({ENTITY_W}) - 1 in_career FROM pit""")
def count_before(spark, sf):
    """0-based running index in the game and in the career."""
    h = History(pit(spark, sf), ["game", "entity"], PIT_ORDER).position("in_game")
    return h.regroup(["entity"]).position("in_career").df


def rolling_sql(c: str, w: int, mp: int, fn: str) -> str:
    f = f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING"
    return f"CASE WHEN count({c}) OVER ({ENTITY_W} {f}) >= {mp} THEN {fn}({c}) OVER ({ENTITY_W} {f}) END"


@query("rolling_prior", "W3", KEY + " qty_last20_mean:d cents_last20_mean:d cents_last20_std:d dispersion:d usage_r:d", f"""
SELECT {KEY_SQL}, {rolling_sql('qty', 20, 5, 'avg')} qty_last20_mean, {rolling_sql('cents', 20, 5, 'avg')} cents_last20_mean,
 {rolling_sql('cents', 20, 5, 'stddev_samp')} cents_last20_std,
 sqrt(pow({rolling_sql('cents', 20, 5, 'stddev_samp')}, 2) + pow({rolling_sql('disc', 20, 5, 'stddev_samp')}, 2)) dispersion,
 {rolling_sql('y', 20, 5, 'avg')} usage_r FROM pit""")
def rolling_prior(spark, sf):
    """Rolling mean and deviation of previous rows with a minimum of known values."""
    h = hist.rolling(entity_history(spark, sf), ["qty", "cents", "disc", "y"], 20, 5, ("mean", "std"))
    return h.df.withColumns({
        "dispersion": F.sqrt(F.pow("cents_last20_std", F.lit(2.0)) + F.pow("disc_last20_std", F.lit(2.0))),
        "usage_r": F.col("y_last20_mean")})


@query("expanding_mean", "W5", KEY + " y_before:d cents_before:d", f"""
SELECT {KEY_SQL}, CASE WHEN count(y) OVER w >= 10 THEN avg(y) OVER w END y_before,
 CASE WHEN count(cents) OVER w >= 10 THEN avg(cents) OVER w END cents_before
FROM pit WINDOW w AS ({ENTITY_W} {BEFORE})""")
def expanding_mean(spark, sf):
    """Mean of all earlier rows once ten are known."""
    return hist.expanding_mean(entity_history(spark, sf), ["y", "cents"], 10).df


@query("leverage_index", "W6", KEY + " leverage:d leverage_class:s", f"""
WITH d AS (SELECT *, CASE WHEN season < {LAST_SEASON} THEN tax0 END x, {PIT_SQL_ORDER.split(',')[0]} FROM pit),
g AS (SELECT *, sum(x) OVER a s, count(x) OVER a n, sum(x) OVER b gs, count(x) OVER b gn FROM d
  WINDOW a AS (PARTITION BY ctx, hand ORDER BY {PIT_SQL_ORDER} {BEFORE}), b AS (ORDER BY {PIT_SQL_ORDER} {BEFORE})),
f AS (SELECT ctx, hand, sum(x) fs, count(x) fn FROM d GROUP BY 1, 2), m AS (SELECT avg(x) m FROM d),
v AS (SELECT g.*, coalesce(gs / nullif(gn, 0), 0.05) base, fs, fn, m FROM g JOIN f USING (ctx, hand), m),
r AS (SELECT {KEY_SQL}, least(greatest(coalesce(CASE WHEN season < {LAST_SEASON} THEN (coalesce(s, 0) + 50 * base) / (n + 50) / base
   ELSE (fs + 50 * m) / (fn + 50) / m END, 1), 0), 10) leverage FROM v)
SELECT *, CASE WHEN leverage <= 0.85 THEN 'low' WHEN leverage <= 2 THEN 'medium' ELSE 'high' END leverage_class FROM r""")
def leverage_index(spark, sf):
    """Prequential state mean over the past global mean; frozen table for later seasons."""
    return hist.prequential_ratio(pit(spark, sf), ["ctx", "hand"], "tax0",
                                  F.col("season") < LAST_SEASON, PIT_ORDER, 50.0, 0.05)


@query("times_faced", "W7", KEY + " times_faced:i", f"""
SELECT {KEY_SQL}, dense_rank() OVER (PARTITION BY entity, hand, lab ORDER BY game) - 1 times_faced FROM pit""")
def times_faced(spark, sf):
    """Earlier distinct turns of the same pair."""
    return hist.times_faced(pit(spark, sf), "entity", "hand", "lab", "game")


@query("previous_game_rest", "W8", "entity:i game:i game_day:s game_n:i prev_game_n:i rest_days:i", """
WITH g AS (SELECT entity, game, min(day) game_day, count(*) game_n FROM pit GROUP BY 1, 2)
SELECT *, lag(game_n) OVER w prev_game_n, date_diff('day', lag(game_day) OVER w, game_day) - 1 rest_days FROM g
WINDOW w AS (PARTITION BY entity ORDER BY game_day, game)""")
def previous_game_rest(spark, sf):
    """Size of the previous game and days of rest."""
    return hist.previous_game(pit(spark, sf), "entity", "game", "day")


@query("row_decile", "W9 D18", "season:i decile:i n:i hits:i rate:d", f"""
WITH r AS (SELECT season, y, row_number() OVER w r, count(*) OVER (PARTITION BY season) n FROM pit WINDOW w AS (PARTITION BY season ORDER BY {PIT_SQL_ORDER}))
SELECT season, greatest(ceil((r - 1) * 10 / (n - 1)::DOUBLE) - 1, 0) decile, count(*) n, sum(y) hits, avg(y) rate FROM r GROUP BY 1, 2""")
def row_decile(spark, sf):
    """Outcome rate by decile of row order inside each season."""
    from foretally.operators.ranks import row_bucket
    rows = History(pit(spark, sf), ["season"], PIT_ORDER).position("r", "t").df
    out = rows.filter("season IS NOT NULL").withColumn("decile", row_bucket(F.col("r"), F.col("t"), 10))
    return out.groupBy("season", "decile").agg(F.count("*").alias("n"), F.sum("y").alias("hits"),
                                               F.avg("y").alias("rate"))


RATES = {"csw": ("y", "1"), "whiff": ("y * ind", "ind")}
IND = "CASE WHEN hand = 'O' THEN 1 ELSE 0 END"
WINS = ["day", "near", "szn", "pszn", "car", "l100", "l500"]


def history_sql() -> str:
    sums = {f"{m}_{p}": e for m, (a, b) in RATES.items() for p, e in (("n", a), ("d", b))}
    daily = ", ".join(f"sum({e}) {n}" for n, e in sums.items())
    win = []
    for n, e in sums.items():
        win.append(f"sum({e}) OVER ({GAME_W} {BEFORE}) {n}__day")
        for k in (100, 500):
            win.append(f"sum({e}) OVER ({ENTITY_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) {n}__l{k}")
    near = ", ".join(
        f"sum({n}) OVER (PARTITION BY entity ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) {n}__near, "
        f"sum({n}) OVER (PARTITION BY entity ORDER BY day {BEFORE}) {n}__car, "
        f"sum({n}) OVER (PARTITION BY entity, season ORDER BY day {BEFORE}) {n}__szn" for n in sums)
    pszn = ", ".join(f"sum({e}) {n}__pszn" for n, e in sums.items())
    out = []
    for w in WINS:
        for m, k in (("csw", 200), ("whiff", 150)):
            num, den = f"{m}_n__{w}", f"{m}_d__{w}"
            miss = f"{den} IS NULL" if w in ("near", "szn", "pszn") else f"coalesce({den}, 0) = 0"
            out += [f"(coalesce({num}, 0) + {k} * 0.33) / (coalesce({den}, 0) + {k}) {m}_rate_{w}",
                    f"coalesce({den}, 0) {m}_den_{w}", f"CASE WHEN {miss} THEN 1 ELSE 0 END {m}_miss_{w}"]
    return f"""WITH b AS (SELECT *, {IND} ind FROM pit),
d AS (SELECT entity, season, day, {daily} FROM b GROUP BY ALL), dw AS (SELECT entity, season, day, {near} FROM d),
ps AS (SELECT entity, season + 1 season, {pszn} FROM b GROUP BY ALL), r AS (SELECT *, {', '.join(win)} FROM b)
SELECT {KEY_SQL}, {', '.join(out)} FROM r JOIN dw USING (entity, season, day) LEFT JOIN ps USING (entity, season)"""


@query("history_rates", "W10 W11", KEY + " " + " ".join(
    f"{m}_rate_{w}:d {m}_den_{w}:i {m}_miss_{w}:i" for w in WINS for m in RATES), history_sql())
def history_rates(spark, sf):
    """Two rates in seven past windows with shrinkage, counts and missing flags."""
    rows = pit(spark, sf).withColumn("ind", F.expr(IND))
    rates = {m: (F.expr(a), F.expr(b)) for m, (a, b) in RATES.items()}
    return hist.history_rates(rows, "entity", "game", "day", "season", PIT_ORDER, rates,
                              {"csw": 200, "whiff": 150}, {"csw": 0.33, "whiff": 0.33})


@query("arsenal_windows", "W12", "entity:i day:s velo_near:d velo_szn:d velo_car:d velo_pszn:d usage_szn:d usage_pszn:d velo_trend:d", f"""
WITH b AS (SELECT *, CASE WHEN lab = 'R' THEN 1 ELSE 0 END m FROM pit),
d AS (SELECT entity, season, day, sum(m * qty) v, sum(m) c, count(*) t FROM b GROUP BY ALL),
w AS (SELECT entity, season, day, {', '.join(f"sum({x}) OVER n {x}n, sum({x}) OVER s {x}s, sum({x}) OVER k {x}k" for x in 'vct')} FROM d
 WINDOW n AS (PARTITION BY entity ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING),
 s AS (PARTITION BY entity, season ORDER BY day {BEFORE}), k AS (PARTITION BY entity ORDER BY day {BEFORE})),
p AS (SELECT entity, season + 1 season, sum(m * qty) vp, sum(m) cp, count(*) tp FROM b GROUP BY ALL)
SELECT entity, day, vn / nullif(cn, 0) velo_near, vs / nullif(cs, 0) velo_szn, vk / nullif(ck, 0) velo_car, vp / nullif(cp, 0) velo_pszn,
 cs / nullif(ts, 0) usage_szn, cp / nullif(tp, 0) usage_pszn, vs / nullif(cs, 0) - vp / nullif(cp, 0) velo_trend
FROM w LEFT JOIN p USING (entity, season)""")
def arsenal_windows(spark, sf):
    """Metric and usage of one class in past day windows, with the season trend."""
    from foretally.functions.rates import ratio
    rows = pit(spark, sf)
    m = (F.col("lab") == "R").cast("int")
    sums = {"v": m * F.col("qty"), "c": m, "t": F.lit(1)}
    daily = hist.daily_windows(rows, "entity", "day", "season", sums)
    out = daily.join(hist.previous_season(rows, "entity", "season", sums), ["entity", "season"], "left")
    made = {f"velo_{w}": ratio(f"v__{w}", f"c__{w}") for w in ("near", "szn", "car", "pszn")}
    made.update({f"usage_{w}": ratio(f"c__{w}", f"t__{w}") for w in ("szn", "pszn")})
    return out.withColumns(made).withColumn("velo_trend", F.col("velo_szn") - F.col("velo_pszn"))


@query("release_repeatability", "W13", "entity:i day:s sd_szn:d5 sd_pszn:d5 repeat_szn:d5 n_szn:i miss_szn:i", f"""
WITH b AS (SELECT *, CASE WHEN lab = 'R' THEN qty END x FROM pit),
d AS (SELECT entity, season, day, coalesce(sum(x), 0) s, coalesce(sum(x * x), 0) q, count(x) n FROM b GROUP BY ALL),
w AS (SELECT entity, season, day, sum(s) OVER k s, sum(q) OVER k q, sum(n) OVER k n FROM d WINDOW k AS (PARTITION BY entity, season ORDER BY day {BEFORE})),
p AS (SELECT entity, season + 1 season, sum(x) sp, sum(x * x) qp, count(x) np FROM b GROUP BY ALL)
SELECT entity, day, sqrt(CASE WHEN n > 0 THEN greatest(q / nullif(n, 0) - pow(s / nullif(n, 0), 2), 0) END) sd_szn,
 sqrt(CASE WHEN np > 0 THEN greatest(qp / nullif(np, 0) - pow(sp / nullif(np, 0), 2), 0) END) sd_pszn,
 1 / (1 + sqrt(CASE WHEN n > 0 THEN greatest(q / nullif(n, 0) - pow(s / nullif(n, 0), 2), 0) END)) repeat_szn, coalesce(n, 0) n_szn,
 CASE WHEN coalesce(n, 0) < 25 THEN 1 ELSE 0 END miss_szn FROM w LEFT JOIN p USING (entity, season)""")
def release_repeatability(spark, sf):
    """Past deviation from additive moments, clamped at zero, with a low-sample flag."""
    return hist.repeatability(pit(spark, sf), "entity", "day", "season",
                              {"x": F.when(F.col("lab") == "R", F.col("qty"))}, 25).select(
        "entity", "day", F.col("x_sd_szn").alias("sd_szn"), F.col("x_sd_pszn").alias("sd_pszn"),
        F.col("repeat_szn"), F.col("x_n_szn").alias("n_szn"), F.col("miss_szn"))


@query("expanding_target_encoding", "W14", KEY + " entity_te:d opp_te:d", f"""
WITH m AS (SELECT avg(y) m FROM pit WHERE season < {LAST_SEASON})
SELECT {KEY_SQL}, (coalesce(sum(y) OVER a, 0) + 200 * m) / (count(*) OVER a + 200) entity_te,
 (coalesce(sum(y) OVER b, 0) + 200 * m) / (count(*) OVER b + 200) opp_te FROM pit, m
WINDOW a AS ({ENTITY_W} {BEFORE}), b AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} {BEFORE})""")
def expanding_target_encoding(spark, sf):
    """Shrunken past mean per key inside the key's own order."""
    rows = pit(spark, sf)
    mu = rows.filter(PAST).agg(F.avg("y")).scalar()
    one = F.lit(1)
    h = hist.expanding_rate(History(rows, ["entity"], PIT_ORDER), {"entity_te": (F.col("y"), one, 200.0, mu)})
    return hist.expanding_rate(h.regroup(["opp"]), {"opp_te": (F.col("y"), one, 200.0, mu)}).df


@query("opponent_scouting", "W15", KEY + " faced_R:d faced_R_n:i whiff_A:d whiff_A_n:i faced_N:d faced_N_n:i", f"""
SELECT {KEY_SQL}, (coalesce(sum(CASE WHEN lab = 'R' THEN 1 ELSE 0 END) OVER b, 0) + 200 / 3.0) / (count(*) OVER b + 200) faced_R, count(*) OVER b faced_R_n,
 (coalesce(sum(CASE WHEN lab = 'A' AND hand = 'O' THEN 1 ELSE 0 END) OVER b, 0) + 100 * 0.3) / (coalesce(sum(CASE WHEN hand = 'O' THEN 1 ELSE 0 END) OVER b, 0) + 100) whiff_A,
 coalesce(sum(CASE WHEN hand = 'O' THEN 1 ELSE 0 END) OVER b, 0) whiff_A_n,
 (coalesce(sum(CASE WHEN lab = 'N' THEN 1 ELSE 0 END) OVER b, 0) + 200 / 3.0) / (count(*) OVER b + 200) faced_N, count(*) OVER b faced_N_n
FROM pit WINDOW b AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} {BEFORE})""")
def opponent_scouting(spark, sf):
    """Past shrunken class rates of the opponent."""
    is_ = lambda v: (F.col("lab") == v).cast("int")
    far = (F.col("hand") == "O").cast("int")
    h = History(pit(spark, sf), ["opp"], PIT_ORDER)
    return hist.expanding_rate(h, {
        "faced_R": (is_("R"), F.lit(1), 200.0, 1 / 3), "whiff_A": (is_("A") * far, far, 100.0, 0.3),
        "faced_N": (is_("N"), F.lit(1), 200.0, 1 / 3)}).df


@query("game_flow", "W16", KEY + " prev_y_1:i prev_y_2:i prev_y_3:i l5_r:d l15_r:d l15_o:d", f"""
SELECT {KEY_SQL}, lag(y, 1) OVER g prev_y_1, lag(y, 2) OVER g prev_y_2, lag(y, 3) OVER g prev_y_3,
 sum(y) OVER f5 / nullif(count(*) OVER f5, 0) l5_r, sum(y) OVER f15 / nullif(count(*) OVER f15, 0) l15_r,
 sum(CASE WHEN hand = 'O' THEN 1 ELSE 0 END) OVER f15 / nullif(count(*) OVER f15, 0) l15_o
FROM pit WINDOW g AS ({GAME_W}), f5 AS ({ENTITY_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f15 AS ({ENTITY_W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""")
def game_flow(spark, sf):
    """Last flags in the game and recent shares of the entity."""
    g = History(pit(spark, sf).withColumn("o", (F.col("hand") == "O").cast("int")), ["game", "entity"], PIT_ORDER)
    flags = g.frames(3, lambda w: hist.lag_columns(w, ["y"], [1, 2, 3]))
    h = flags.regroup(["entity"])
    return h.frames(15, lambda w: {
        "l5_r": F.avg("y").over(w.rowsBetween(-5, -1)), "l15_r": F.avg("y").over(w.rowsBetween(-15, -1)),
        "l15_o": F.avg("o").over(w.rowsBetween(-15, -1))}).df


@query("previous_turn_result", "W17", "entity:i day:s prev_turn_lab:s after_r:i", f"""
WITH t AS (SELECT entity, day, max_by(CASE WHEN lab <> 'N' THEN lab END, CASE WHEN lab <> 'N' THEN (day, game, ctx, opp, entity) END) v FROM pit GROUP BY 1, 2)
SELECT entity, day, lag(v) OVER (PARTITION BY entity ORDER BY day) prev_turn_lab,
 CASE WHEN lag(v) OVER (PARTITION BY entity ORDER BY day) = 'R' THEN 1 ELSE 0 END after_r FROM t""")
def previous_turn_result(spark, sf):
    """Last known result of the previous turn and a flag on it."""
    rows = pit(spark, sf).withColumn("lab", F.when(F.col("lab") != "N", F.col("lab"))).withColumn(
        "turn", F.unix_date("day"))
    out = hist.previous_turn_value(rows, ["entity"], "turn", "lab", PIT_ORDER)
    return out.withColumns({"day": F.date_from_unix_date("turn"),
                            "after_r": F.coalesce(F.col("prev_turn_lab") == "R", F.lit(False)).cast("int")})


@query("lineup_slot", "W18", KEY + " slot:i", f"""
SELECT {KEY_SQL}, (dense_rank() OVER (PARTITION BY entity, hand ORDER BY game) - 1) % 9 + 1 slot FROM pit""")
def lineup_slot(spark, sf):
    """Cyclic slot of the turn in its side's order."""
    return hist.turn_slot(pit(spark, sf), "entity", "hand", "game")


@query("opponent_history", "W19", KEY + " szn:d szn_n:i car:d car_n:i l200:d l200_n:i pszn:d pszn_n:i vs_o:d", f"""
WITH p AS (SELECT opp, season + 1 season, sum(y) ps, count(*) pn FROM pit GROUP BY ALL)
SELECT season, day, game, ctx, opp, entity, (coalesce(sum(y) OVER s, 0) + 100) / (count(*) OVER s + 300) szn, count(*) OVER s szn_n,
 (coalesce(sum(y) OVER c, 0) + 100) / (count(*) OVER c + 300) car, count(*) OVER c car_n,
 (coalesce(sum(y) OVER l, 0) + 100) / (count(*) OVER l + 300) l200, count(*) OVER l l200_n,
 (coalesce(ps, 0) + 100) / (coalesce(pn, 0) + 300) pszn, coalesce(pn, 0) pszn_n,
 (coalesce(sum(CASE WHEN hand = 'O' THEN y ELSE 0 END) OVER c, 0) + 66) / (coalesce(sum(CASE WHEN hand = 'O' THEN 1 ELSE 0 END) OVER c, 0) + 200) vs_o
FROM pit LEFT JOIN p USING (opp, season)
WINDOW s AS (PARTITION BY opp, season ORDER BY {PIT_SQL_ORDER} {BEFORE}), c AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} {BEFORE}),
 l AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)""")
def opponent_history(spark, sf):
    """Opponent rates by season, career, last 200 and previous season, and by hand."""
    rows, one, y = pit(spark, sf), F.lit(1), F.col("y")
    far = (F.col("hand") == "O").cast("int")
    a = hist.expanding_rate(History(rows, ["opp", "season"], PIT_ORDER), {"szn": (y, one, 300.0, 1 / 3)})
    career = a.regroup(["opp"])
    b = hist.expanding_rate(career, {"car": (y, one, 300.0, 1 / 3), "vs_o": (y * far, far, 200.0, 0.33)})
    c = hist.last_n_sums(b, {"__ls": y, "__ln": one}, 200)
    d = c.df.join(hist.previous_season(rows, "opp", "season", {"ps": y, "pn": one}), ["opp", "season"], "left")
    zero = F.lit(0)
    return d.withColumns({
        "l200": eb("__ls", "__ln", 300.0, 1 / 3), "l200_n": F.col("__ln"),
        "pszn": eb(F.coalesce("ps__pszn", zero), F.coalesce("pn__pszn", zero), 300.0, 1 / 3),
        "pszn_n": F.coalesce("pn__pszn", zero)})


@query("outing_workload", "W20", "entity:i game:i game_day:s game_n:i outing_index:i n_avg_car:d n_sd_car:d n_avg_l5:d prev_game_n:i season_cum:i", f"""
WITH g AS (SELECT entity, game, min(day) game_day, count(*) game_n FROM pit GROUP BY 1, 2)
SELECT entity, game, game_day, game_n, count(*) OVER c outing_index, avg(game_n) OVER c n_avg_car, stddev_samp(game_n) OVER c n_sd_car,
 avg(game_n) OVER l n_avg_l5, lag(game_n) OVER o prev_game_n, sum(game_n) OVER s season_cum FROM g
WINDOW o AS (PARTITION BY entity ORDER BY game_day, game), c AS (PARTITION BY entity ORDER BY game_day, game {BEFORE}),
 l AS (PARTITION BY entity ORDER BY game_day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 s AS (PARTITION BY entity, year(game_day) ORDER BY game_day, game {BEFORE})""")
def outing_workload(spark, sf):
    """Past outing sizes per entity and game."""
    return hist.workload(pit(spark, sf), "entity", "game", "day")


@query("workload_features", "W20", KEY + " today:i workload_ratio:d workload_excess:d over_usual:i workload_ratio_l5:d", f"""
WITH g AS (SELECT entity, game, min(day) game_day, count(*) game_n FROM pit GROUP BY 1, 2),
h AS (SELECT entity, game, avg(game_n) OVER (PARTITION BY entity ORDER BY game_day, game {BEFORE}) a,
 avg(game_n) OVER (PARTITION BY entity ORDER BY game_day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) a5 FROM g),
r AS (SELECT *, row_number() OVER ({GAME_W}) - 1 today FROM pit)
SELECT season, day, game, ctx, opp, entity, today, today / a workload_ratio, today - a workload_excess,
 CASE WHEN today / a > 1 THEN 1 ELSE 0 END over_usual, today / a5 workload_ratio_l5 FROM r JOIN h USING (entity, game)""")
def workload_features(spark, sf):
    """Today's count against the usual outing."""
    rows = pit(spark, sf)
    games = hist.workload(rows, "entity", "game", "day")
    today = History(rows, ["game", "entity"], PIT_ORDER).position("today").df
    return hist.workload_features(today, games, "entity", "game", "today")


@query("class_command_sd", "W21", KEY + " tax_sd:d disc_sd:d dispersion:d", f"""
WITH r AS (SELECT {KEY_SQL}, CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(tax) OVER w END tax_sd,
 CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(disc) OVER w END disc_sd FROM pit
 WINDOW w AS (PARTITION BY entity, lab ORDER BY {PIT_SQL_ORDER} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT *, sqrt(tax_sd * tax_sd + disc_sd * disc_sd) dispersion FROM r""")
def class_command_sd(spark, sf):
    """Deviation of the previous forty rows of the same class."""
    h = hist.rolling(History(pit(spark, sf), ["entity", "lab"], PIT_ORDER), ["tax", "disc"], 40, 10, ("std",))
    a, b = F.col("tax_last40_std"), F.col("disc_last40_std")
    return h.df.withColumns({"tax_sd": a, "disc_sd": b, "dispersion": F.sqrt(a * a + b * b)})


@query("command_forward_fill", "W22", KEY + " tax_sd:d", f"""
WITH f AS (SELECT day, game, ctx, opp, entity, CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(tax) OVER w END v FROM pit WHERE lab = 'R'
 WINDOW w AS ({ENTITY_W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT {KEY_SQL}, last_value(v IGNORE NULLS) OVER ({ENTITY_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) tax_sd
FROM pit LEFT JOIN f USING (day, game, ctx, opp, entity)""")
def command_forward_fill(spark, sf):
    """Deviation on one class's rows, carried forward to every later row."""
    out = hist.forward_filled_std(pit(spark, sf), "entity", PIT_ORDER, F.col("lab") == "R", ["tax"], 40, 10)
    return out.withColumnRenamed("tax_last40_std_ff", "tax_sd")


@query("both_side_history", "W23", KEY + " e_exp:d e_l100:d o_exp:d o_l100:d", f"""
SELECT {KEY_SQL}, CASE WHEN count(*) OVER a >= 20 THEN avg(y) OVER a END e_exp, CASE WHEN count(*) OVER b >= 20 THEN avg(y) OVER b END e_l100,
 CASE WHEN count(*) OVER c >= 20 THEN avg(y) OVER c END o_exp, CASE WHEN count(*) OVER d >= 20 THEN avg(y) OVER d END o_l100 FROM pit
WINDOW a AS ({ENTITY_W} {BEFORE}), b AS ({ENTITY_W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING),
 c AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} {BEFORE}), d AS (PARTITION BY opp ORDER BY {PIT_SQL_ORDER} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""")
def both_side_history(spark, sf):
    """Expanding and last-100 means of both sides."""
    def side(h, tag):
        h = hist.rolling(hist.expanding_mean(h, ["y"], 20), ["y"], 100, 20)
        return h.replace(h.df.withColumnsRenamed({"y_before": f"{tag}_exp", "y_last100_mean": f"{tag}_l100"}))
    first = side(History(pit(spark, sf), ["entity"], PIT_ORDER), "e")
    return side(first.regroup(["opp"]), "o").df


@query("user_history", "W3 W5 W14", "event_id:i user_id:i seq:i te:d mean20:d", f"""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 seq,
 (coalesce(sum(y) OVER a, 0) + 20 * 0.2) / (count(*) OVER a + 20) te,
 CASE WHEN count(*) OVER b >= 5 THEN avg(value) OVER b END mean20 FROM ev
WINDOW a AS ({USER_W} {BEFORE}), b AS ({USER_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def user_history(spark, sf):
    """Position, past rate and rolling mean per user of the event log."""
    h = History(ev(spark, sf), ["user_id"], EV_ORDER).position("seq")
    h = hist.expanding_rate(h, {"te": (F.col("y"), F.lit(1), 20.0, 0.2)})
    return hist.rolling(h, ["value"], 20, 5).df.withColumnRenamed("value_last20_mean", "mean20")


CUM = f"""SELECT *, row_number() OVER ({ENTITY_W}) - 1 + CASE WHEN row_number() OVER ({ENTITY_W}) > 50 THEN 1 ELSE 0 END n,
 coalesce(sum(y) OVER ({ENTITY_W} {BEFORE}), 0) cs FROM pit"""


@query("recovered_labels", "W24", KEY + " n:i label:i y:i agree:i", f"""
WITH c AS ({CUM}), r AS (SELECT *, cs / nullif(n, 0) rate FROM c),
l AS (SELECT *, lead(n) OVER ({ENTITY_W}) n1, lead(rate) OVER ({ENTITY_W}) r1 FROM r),
s AS (SELECT *, round_even(n1 * r1, 0) - round_even(coalesce(n * rate, 0), 0) step FROM l),
o AS (SELECT {KEY_SQL}, n, CASE WHEN n1 - n = 1 AND step IN (0, 1) THEN step END AS label, y FROM s)
SELECT *, CASE WHEN label = y THEN 1 WHEN label IS NOT NULL THEN 0 END agree FROM o""")
def recovered_labels(spark, sf):
    """Labels rebuilt from cumulative counts and rates, with a gap in the counts."""
    h = entity_history(spark, sf).position("pos").running({"cs": F.col("y")})
    rows = h.df.withColumn("n", F.col("pos") + F.when(F.col("pos") >= 50, 1).otherwise(0)).withColumn(
        "rate", F.try_divide(F.col("cs").cast("double"), F.col("n")))
    out = hist.recovered_labels(rows, "entity", PIT_ORDER, "n", ["rate"])
    label = F.col("label_rate")
    return out.withColumns({"label": label, "agree": F.when(label.isNotNull(), (label == F.col("y")).cast("int"))})


@query("tolerant_labels", "W24", KEY + " label:i", f"""
WITH c AS ({CUM}), r AS (SELECT *, round(cs / nullif(n, 0), 4) rate FROM c),
l AS (SELECT *, lead(n) OVER ({ENTITY_W}) n1, lead(rate) OVER ({ENTITY_W}) r1 FROM r),
s AS (SELECT *, n1 * r1 - coalesce(n * rate, 0) raw FROM l)
SELECT {KEY_SQL}, CASE WHEN n1 - n = 1 AND abs(raw - round_even(raw, 0)) <= 0.05 AND round_even(raw, 0) IN (0, 1) THEN round_even(raw, 0) END AS label FROM s""")
def tolerant_labels(spark, sf):
    """Labels from rounded rates, known only where the step is near an integer."""
    h = entity_history(spark, sf).position("pos").running({"cs": F.col("y")})
    rows = h.df.withColumn("n", F.col("pos") + F.when(F.col("pos") >= 50, 1).otherwise(0)).withColumn(
        "rate", F.round(F.try_divide(F.col("cs").cast("double"), F.col("n")), 4))
    out = hist.recovered_labels(rows, "entity", PIT_ORDER, "n", ["rate"], 0.05)
    return out.withColumnRenamed("label_rate", "label")


@query("outing_segments", "W4 A32", KEY + " segment:i", f"""
WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR NOT (tax0 IS NOT DISTINCT FROM lag(tax0) OVER w) THEN 1 ELSE 0 END nw FROM pit WINDOW w AS ({ENTITY_W}))
SELECT {KEY_SQL}, sum(nw) OVER ({ENTITY_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) segment FROM c""")
def outing_segments(spark, sf):
    """Runs of rows whose mark does not change, NULL equal to NULL."""
    return hist.segments(pit(spark, sf), "entity", PIT_ORDER, ["tax0"])


@query("smoothed_hand_rate", "W27", KEY + " hand_rate:d", f"""
WITH h AS (SELECT *, coalesce(sum(y) OVER a, 0) hs, count(*) OVER a hn, coalesce(sum(y) OVER b, 0) cs, count(*) OVER b cn FROM pit
 WINDOW a AS (PARTITION BY entity, hand ORDER BY {PIT_SQL_ORDER} {BEFORE}), b AS ({ENTITY_W} {BEFORE}))
SELECT {KEY_SQL}, (hs + 20 * coalesce(cs / nullif(cn, 0), 0.33)) / (hn + 20) hand_rate FROM h""")
def smoothed_hand_rate(spark, sf):
    """Past hand rate shrunk to the entity's own past rate."""
    from foretally.functions.rates import ratio
    a = History(pit(spark, sf), ["entity", "hand"], PIT_ORDER).running({"hs": F.col("y"), "hn": F.lit(1)})
    b = a.regroup(["entity"]).running({"cs": F.col("y"), "cn": F.lit(1)}).df
    return b.withColumn("hand_rate", eb("hs", "hn", 20.0, F.coalesce(ratio("cs", "cn"), F.lit(0.33))))


@query("row_asof_split", "W26", KEY + " split:d rel:d", f"""
WITH m AS (SELECT avg(y) m FROM pit WHERE season < {LAST_SEASON}),
h AS (SELECT *, coalesce(sum(y) OVER a, 0) hs, count(*) OVER a hn, coalesce(sum(y) OVER b, 0) cs, count(*) OVER b cn FROM pit
 WINDOW a AS (PARTITION BY entity, hand ORDER BY {PIT_SQL_ORDER} {BEFORE}), b AS ({ENTITY_W} {BEFORE}))
SELECT {KEY_SQL}, (hs + 300 * m) / (hn + 300) - (cs + 300 * m) / (cn + 300) split, hn / (hn + 300.0) rel FROM h, m""")
def row_asof_split(spark, sf):
    """Past-only EB(entity, hand) - EB(entity) for every row."""
    rows = pit(spark, sf)
    mu = rows.filter(PAST).agg(F.avg("y")).scalar()
    a = History(rows, ["entity", "hand"], PIT_ORDER).running({"hs": F.col("y"), "hn": F.lit(1)})
    b = a.regroup(["entity"]).running({"cs": F.col("y"), "cn": F.lit(1)}).df
    return b.withColumns({"split": eb("hs", "hn", 300.0, mu) - eb("cs", "cn", 300.0, mu),
                          "rel": F.col("hn") / (F.col("hn") + 300.0)})


@query("order_violations", "W28", "entity:i n:i violations:i", """
WITH r AS (SELECT entity, max(season * 12 + month) OVER (PARTITION BY entity ORDER BY game, day, ctx, opp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m,
 season * 12 + month v FROM pit)
SELECT entity, count(*) n, sum(CASE WHEN m > v THEN 1 ELSE 0 END) violations FROM r GROUP BY 1""")
def order_violations(spark, sf):
    """Rows that precede the latest month seen before them in another order."""
    order = Order(("game", "day", "ctx", "opp"))
    out = hist.order_violations(pit(spark, sf), "entity", order, F.col("season") * 12 + F.col("month"))
    return out.groupBy("entity").agg(F.count("*").alias("n"), F.sum("violation").alias("violations"))


@query("latest_per_entity", "W29", "entity:i season:i n:i rate:d", """
SELECT entity, season, n, rate FROM (SELECT entity, season, count(*) n, avg(y) rate, row_number() OVER (PARTITION BY entity ORDER BY season DESC) r FROM pit GROUP BY 1, 2) WHERE r = 1""")
def latest_per_entity(spark, sf):
    """Last season row of each profile."""
    from foretally.operators.asof import last_version
    cells = pit(spark, sf).groupBy("entity", "season").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    return last_version(cells, "entity", "season")
