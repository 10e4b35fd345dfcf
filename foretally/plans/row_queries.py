"""Row-wise features, codes and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions import buckets, physics, rowfeatures as rf, situation
from foretally.plans.bindings import table
from foretally.plans.catalog import query

# The pitch table's columns derived from line items; the same text serves Spark and SQL.
TRAIN = {
    "season": "cast(year(l_shipdate) as int)", "inning": "cast(1 + l_orderkey % 12 as int)",
    "top_bottom": "case when l_linestatus = 'O' then 'T' else 'B' end",
    "game_type": "case when l_partkey % 10 = 0 then 'F' else 'R' end",
    "balls_before": "cast(l_linenumber % 4 as int)", "strikes_before": "cast(l_orderkey % 3 as int)",
    "outs_before": "cast(l_partkey % 3 as int)",
    "runner_on_1b": "cast(l_partkey % 2 as int)", "runner_on_2b": "cast(l_suppkey % 2 as int)",
    "runner_on_3b": "cast(l_orderkey % 2 as int)",
    "num_runners_on": "cast(l_partkey % 2 + l_suppkey % 2 + l_orderkey % 2 as int)",
    "base_state": "concat(case when l_partkey % 2 = 1 then '1' else '_' end, case when l_suppkey % 2 = 1 then '2' else '_' end, case when l_orderkey % 2 = 1 then '3' else '_' end)",
    "score_diff_pitcher_team": "cast(l_linenumber * 2 - 8 + l_suppkey % 3 as int)",
    "li": "l_quantity / 16e0", "home_win_expectancy": "20e0 + l_discount * 500e0",
    "away_win_expectancy": "80e0 - l_discount * 500e0",
    "pitcher_hand": "cast(1 + l_suppkey % 2 as int)", "batter_hand": "cast(1 + l_partkey % 2 as int)",
    "asof_pitcher_n": "cast(l_orderkey % 3000 as int)", "asof_batter_n": "cast(l_partkey % 700 as int)",
    "asof_pitcher_pitchmix_n": "cast(l_orderkey % 3000 as int)",
    "asof_pitcher_success_rate": "case when l_linenumber < 7 then 0.3e0 + l_tax * 1.0123457e0 * 3e0 end",
    "asof_pitcher_reverse_rate": "case when l_linenumber < 7 then 0.1e0 + l_discount * 0.9871235e0 end",
    "asof_pitcher_middle_rate": "case when l_linenumber < 7 then 0.100012373e0 + l_tax * 1.0123457e0 end",
    "asof_pitcher_ball_rate": "0.3e0 + l_discount * 0.9871235e0 * 2e0", "asof_pitcher_strike_rate": "0.4e0 + l_tax * 1.0123457e0 * 2e0",
    "asof_pitcher_fastball_rate": "0.5e0 + l_tax * 1.0123457e0", "asof_pitcher_breaking_rate": "0.3e0 - l_tax * 1.0123457e0",
    "asof_pitcher_offspeed_rate": "case when l_linenumber > 1 then 0.2e0 - l_tax * 1.0123457e0 end",
    "asof_batter_success_rate": "case when l_partkey % 9 > 0 then 0.2e0 + l_discount * 0.9871235e0 * 4e0 end",
    "asof_batter_middle_rate": "case when l_partkey % 9 > 0 then 0.1e0 + l_discount * 0.9871235e0 end",
    "asof_pitcher_prev1_game_success_rate": "case when l_linenumber > 1 then 0.2e0 + l_discount * 0.9871235e0 * 5e0 end",
    "asof_pitcher_prev3_game_success_rate": "case when l_linenumber > 2 then 0.25e0 + l_tax * 1.0123457e0 * 4e0 end",
    "asof_pitcher_prev5_game_success_rate": "case when l_linenumber > 3 then 0.3e0 + l_discount * 0.9871235e0 * 2e0 end",
    "asof_pitcher_prev1_game_middle_rate": "case when l_linenumber > 1 then 0.05e0 + l_tax * 1.0123457e0 end",
    "asof_pitcher_prev3_game_middle_rate": "case when l_linenumber > 2 then 0.06e0 + l_discount * 0.9871235e0 end",
    "asof_pitcher_prev5_game_middle_rate": "case when l_linenumber > 3 then 0.071234567e0 + l_tax * 1.1034567e0 end",
    "y": "cast(case when l_returnflag = 'R' then 1 else 0 end as int)",
    "k1": "l_orderkey", "k2": "l_linenumber", "k3": "l_partkey", "k4": "l_suppkey",
}
T_CTE = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TRAIN.items()) + " FROM lineitem)"
KEY = "season:i k1:i k2:i k3:i k4:i"
KS = "season, k1, k2, k3, k4"


def train(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in TRAIN.items()])


def spec(cols: dict[str, str], ints: set[str] = frozenset(), texts: set[str] = frozenset()) -> str:
    kind = lambda c: "s" if c in texts else ("i" if c in ints else "d")
    return KEY + " " + " ".join(f"{c}:{kind(c)}" for c in cols)


def sql(cols: dict[str, str], extra: str = "", source: str = "t") -> str:
    return f"WITH {T_CTE}{', ' + extra if extra else ''} SELECT {KS}, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {source}"


P, B = "asof_pitcher_{}_rate", "asof_batter_{}_rate"
V = "asof_pitcher_prev{}_game_{}_rate"


def sm(name: str, k: float, prior: str) -> dict[str, str]:
    rate, n = rf.RATE_COUNTS[name]
    s = "" if k is None else ""
    return {f"{name}_smoothed{s}": f"({n} * coalesce({rate}, {prior}) + {k} * {prior}) / ({n} + {k})",
            f"{name}_reliability{s}": f"{n} / ({n} + {k}::DOUBLE)"}


DELTAS = {f"pitcher_{d}_delta_prev{k}": f"{V.format(k, d)} - {P.format(d)}" for k in (1, 3, 5) for d in ("success", "middle")}
STATE = {"score_abs": "abs(score_diff_pitcher_team)", "late_inning": "(inning >= 7)::INT", "high_leverage": "(li >= 2)::INT"}
PRIOR = {"pitcher_success": 0.34, "pitcher_reverse": 0.15, "pitcher_middle": 0.14, "batter_success": 0.34, "batter_middle": 0.15}
P6 = {"count_state": "balls_before * 3 + strikes_before", "handedness_matchup": "pitcher_hand * 2 + batter_hand",
      "runner_out_state": "num_runners_on * 3 + outs_before", **STATE, "log1p_asof_pitcher_n": "ln(1 + asof_pitcher_n)",
      "log1p_asof_batter_n": "ln(1 + asof_batter_n)", **DELTAS, "ball_strike_gap": f"{P.format('ball')} - {P.format('strike')}"}
for _n in rf.CORE_RATES:
    P6[f"{_n}_is_missing"] = f"({rf.RATE_COUNTS[_n][0]} IS NULL)::INT"
    P6.update(sm(_n, 200.0, str(PRIOR[_n])))
P6_INT = {"count_state", "handedness_matchup", "runner_out_state", *STATE, *(f"{n}_is_missing" for n in rf.CORE_RATES)}


@query("stateless_features", "P6", spec(P6, P6_INT), sql(P6))
def stateless_features(spark, sf):
    """State codes, deltas and smoothed rates from frozen priors."""
    return rf.stateless(train(spark, sf), PRIOR, 200.0)


P7 = {"count_text": "balls_before::VARCHAR || '-' || strikes_before::VARCHAR", "runner_out_text": "base_state || '_o' || outs_before::VARCHAR",
      "hand_text": "pitcher_hand::VARCHAR || '_' || batter_hand::VARCHAR", **STATE, **DELTAS,
      **{f"log1p_{c}": f"ln(1 + {c})" for c in ("asof_pitcher_n", "asof_batter_n", "asof_pitcher_pitchmix_n")},
      "ball_strike_rate_sum_gap": f"{P.format('ball')} + {P.format('strike')} - 1"}


@query("text_state_features", "P7", spec(P7, set(STATE), {"count_text", "runner_out_text", "hand_text"}), sql(P7))
def text_state_features(spark, sf):
    """Text state codes and log counts."""
    return rf.text_states(train(spark, sf))


P8 = {}
for _n, (_r, _c) in rf.RATE_COUNTS.items():
    P8[f"{_n}_is_missing"] = f"({_r} IS NULL)::INT"
    for _k in (10, 50, 200, 500):
        P8[f"{_n}_smoothed_{_k}"] = f"(coalesce({_r}, {rf.DEFAULT_PRIORS[_n]}) * {_c} + {rf.DEFAULT_PRIORS[_n]} * {_k}) / ({_c} + {_k})"
        P8[f"{_n}_reliability_{_k}"] = f"{_c} / ({_c} + {_k}::DOUBLE)"
for _s in ("pitcher", "batter"):
    for _l in (0, 25, 100, 500, 1000):
        P8[f"{_s}_n_{'eq' if _l == 0 else 'le'}_{_l}"] = f"(asof_{_s}_n {'=' if _l == 0 else '<='} {_l})::INT"
for _d in ("success", "middle"):
    _v = ", ".join(V.format(k, _d) for k in (1, 3, 5))
    P8[f"recent_{_d}_mean"] = f"list_avg([{_v}])"
    P8[f"recent_{_d}_std"] = f"list_stddev_samp([{_v}])"
    P8[f"recent_{_d}_range"] = f"greatest({_v}) - least({_v})"
P8["failure_rate_sum"] = f"{P.format('reverse')} + {P.format('middle')} + 1 - {P.format('success')}"
P8["component_gap"] = f"{P.format('success')} + {P.format('reverse')} + {P.format('middle')} - 1"
P8_INT = {c for c in P8 if c.endswith("is_missing") or "_n_eq_" in c or "_n_le_" in c}


@query("multi_strength_features", "P8", spec(P8, P8_INT), sql(P8))
def multi_strength_features(spark, sf):
    """Ten rates at four strengths with flags and recent spread."""
    return rf.multi_strength(train(spark, sf))


P9_MED = [P.format(r) for r in rf.PROFILE_RATES] + [V.format(k, d) for k in (1, 3, 5) for d in ("success", "middle")]
P9_CTE = "md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) m_{c}" for c in P9_MED) + " FROM t WHERE season < 2001), z AS (SELECT * FROM t, md)"
P9 = {f"prof_{r}": f"(asof_pitcher_n * coalesce({P.format(r)}, m_{P.format(r)}) + 200 * m_{P.format(r)}) / (asof_pitcher_n + 200)" for r in rf.PROFILE_RATES}
_f = lambda k, d: f"coalesce({V.format(k, d)}, m_{V.format(k, d)})"
for _d in ("success", "middle"):
    P9[f"prev_trend_{_d}"] = f"{_f(1, _d)} - {_f(5, _d)}"
    P9[f"prev_std_{_d}"] = f"list_stddev_pop([{', '.join(_f(k, _d) for k in (1, 3, 5))}])"
P9["prev_missing"] = " + ".join(f"({V.format(k, d)} IS NULL)::INT" for k in (1, 3, 5) for d in ("success", "middle"))
P9.update({f"fail_direction_{k}": f"{_f(k, 'middle')} - (1 - {_f(k, 'success')})" for k in (1, 3, 5)})
P9["profile_reliability"] = "asof_pitcher_n / (asof_pitcher_n + 200.0)"


@query("shrunk_profile_features", "P9 A1", spec(P9, {"prev_missing"}), sql(P9, P9_CTE, "z"))
def shrunk_profile_features(spark, sf):
    """Career rates shrunk to fitted medians, recent trend and spread."""
    rows = train(spark, sf)
    fitted = rf.fit_spec(rows.filter("season < 2001"), "y")
    return rf.shrunk_profile(rows, fitted["median"])


def _sql_weighted(weights, start=0):
    return " + ".join([str(start), *(f"{c} * {w!r}" for c, w in weights.items())])


# What each kind of derived column is in SQL.
KIND_SQL = {
    "alike": lambda a, b: f"CASE WHEN {a} = {b} THEN 1 ELSE 0 END",
    "any": lambda *c: f"greatest({', '.join(f'coalesce({x}, 0)' for x in c)})",
    "bounded": lambda c, low, high: f"CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END",
    "flag": lambda c, sign, bound: f"CASE WHEN {c} {sign} {bound} THEN 1 ELSE 0 END",
    "known": lambda *c: f"coalesce({', '.join(map(str, c))})",
    "log": lambda n: f"ln(1 + greatest(coalesce({n}, 0), 0))",
    "missing": lambda c: f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END",
    "product": lambda *c: " * ".join(c),
    "quotient": lambda a, b, least=1e-3: f"{a} / CASE WHEN {b} < {least} THEN {least} ELSE {b} END",
    "reliability": lambda n, k: f"{n} / ({n} + {float(k)!r}::DOUBLE)",
    "root": lambda *c: f"sqrt({' * '.join(c)})",
    "shrunk": lambda r, n, k, prior: f"({n} * {r} + {k} * {prior}) / ({n} + {k})",
    "size": lambda c: f"abs({c})",
    "weighted": _sql_weighted,
}
WHOLE = {"alike", "flag", "missing", "any"}


def derived_sql(steps, wanted) -> str:
    ctes, source = [], "t"
    for i, (kind, made) in enumerate(steps):
        ctes.append(f"s{i} AS (SELECT *, " + ", ".join(f"{KIND_SQL[kind](*args)} AS {n}" for n, args in made.items()) + f" FROM {source})")
        source = f"s{i}"
    return sql({c: c for c in wanted}, ", ".join(ctes), source)


def derived_spec(steps, wanted, ints=()) -> str:
    kinds = {n: kind for kind, made in steps for n in made}
    return spec(dict.fromkeys(wanted), {c for c in wanted if kinds[c] in WHOLE or c in ints})


def gaps(pairs) -> dict:
    """Differences, named by their two columns."""
    short = lambda c: c.removeprefix("asof_").removesuffix("_rate")
    return {f"{short(a)}_less_{short(b)}": ({a: 1, b: -1},) for a, b in pairs}


# Which columns meet in which way: data for the general kinds.
SIDE = (P.format("success"), B.format("success"))
PAIRS = [SIDE, (P.format("middle"), P.format("reverse")), (P.format("ball"), P.format("strike")),
         (P.format("fastball"), P.format("breaking"))] + [(V.format(k, d), V.format(5, d)) for d in ("success", "middle") for k in (1, 3)]
MEETING = [
    ("alike", {"same_side": ("pitcher_hand", "batter_hand")}),
    ("flag", {"late": ("inning", ">=", 7), "tense": ("li", ">=", 2)}),
    ("product", {"li_late": ("li", "late"), "li_runners": ("li", "num_runners_on")}),
    ("weighted", {"count_code": ({"balls_before": 3, "strikes_before": 1},), "bad": ({P.format("success"): -1}, 1),
                  "miss_sum": ({P.format("middle"): 1, P.format("reverse"): 1},), **gaps(PAIRS)}),
    ("reliability", {"trust_pitcher": ("asof_pitcher_n", 100.000001), "trust_batter": ("asof_batter_n", 100.000001)}),
    ("root", {"trust_both": ("trust_pitcher", "trust_batter")}),
]
MEETING_OUT = [n for _, made in MEETING for n in made]


@query("interaction_features", "P10", derived_spec(MEETING, MEETING_OUT, ["count_code"]), derived_sql(MEETING, MEETING_OUT))
def interaction_features(spark, sf):
    """Context interactions, trends and joint reliability by general kinds."""
    return rf.derived(train(spark, sf), MEETING)


COUNTS = [
    ("size", {"margin_size": ("score_diff_pitcher_team",)}),
    ("flag", {"two": ("strikes_before", "=", 2), "three": ("balls_before", "=", 3), "near": ("margin_size", "<=", 1), "late": ("inning", ">=", 7)}),
    ("weighted", {"count_margin": ({"balls_before": 1, "strikes_before": -1},), **gaps([SIDE])}),
    ("log", {"log_n": ("asof_pitcher_n",)}),
]
MET = [(P.format("success"), B.format("success")), (P.format("middle"), B.format("middle")), (P.format("success"), "li"),
       (P.format("reverse"), P.format("fastball")), (P.format("success"), "log_n"), ("three", "two"), ("late", "near"), ("li", "near"),
       ("li", "count_margin"), (P.format("reverse"), "two"), (P.format("ball"), "three"), (V.format(5, "success"), "balls_before")]
PRODUCTS = [*COUNTS, ("product", {f"product_{i}": pair for i, pair in enumerate(MET)}), ("quotient", {"side_quotient": SIDE})]
PRODUCTS_OUT = [n for kind, made in PRODUCTS for n in made if n not in ("margin_size", "late", "log_n")]


@query("direct_product_features", "P11", derived_spec(PRODUCTS, PRODUCTS_OUT, ["count_margin"]), derived_sql(PRODUCTS, PRODUCTS_OUT))
def direct_product_features(spark, sf):
    """Products, differences and floored quotients of listed pairs by general kinds."""
    return rf.derived(train(spark, sf), PRODUCTS)


P12 = {"sq_li": "li * li", "x_li_inning": "li * inning", f"d_{P.format('success')}_{B.format('success')}": f"{P.format('success')} - {B.format('success')}",
       f"r_{P.format('success')}_{B.format('success')}": f"{P.format('success')} / greatest({B.format('success')}, 1e-3 + 0 * {B.format('success')})"}


@query("second_order_features", "P12", spec(P12), sql(P12))
def second_order_features(spark, sf):
    """Chosen squares, products, differences and ratios."""
    pair = (P.format("success"), B.format("success"))
    return rf.second_order(train(spark, sf), ["li"], [("li", "inning")], [pair], [pair])


P13 = {}
for _d in ("success", "middle"):
    _ds = [f"({V.format(k, _d)} - {P.format(_d)})" for k in (1, 3, 5)]
    for _k, _x in zip((1, 3, 5), _ds):
        P13[f"{_d}_up{_k}"] = f"CASE WHEN {_x} > 0 THEN {_x} WHEN {_x} <= 0 THEN 0 END"
        P13[f"{_d}_down{_k}"] = f"CASE WHEN {_x} < 0 THEN -{_x} WHEN {_x} >= 0 THEN 0 END"
        P13[f"{_d}_shrunk{_k}"] = f"{_x} * asof_pitcher_n / (asof_pitcher_n + 200.0)"
    P13[f"{_d}_median"] = f"list_median([{', '.join(_ds)}])"
    P13[f"{_d}_sign_sum"] = " + ".join(f"coalesce(sign({x}), 0)" for x in _ds)
    P13[f"{_d}_1_minus_5"] = f"{V.format(1, _d)} - {V.format(5, _d)}"


@query("momentum_features", "P13", spec(P13, {"success_sign_sum", "middle_sign_sum"}), sql(P13))
def momentum_features(spark, sf):
    """Signed and shrunken recent deltas with median and sign sum."""
    return rf.momentum(train(spark, sf))


P14 = {"is_f_reverse": f"(game_type = 'F')::INT * {P.format('reverse')}", "full_success": f"(balls_before = 3 AND strikes_before = 2)::INT * {P.format('success')}",
       "late_middle": f"(inning >= 7)::INT * {P.format('middle')}"}


@query("context_flag_features", "P14", spec(P14), sql(P14))
def context_flag_features(spark, sf):
    """Adjusted rates under context flags."""
    return rf.context_flags(train(spark, sf), {k: P.format(k) for k in ("reverse", "success", "middle")})


RUNNERS = ("runner_on_1b", "runner_on_2b", "runner_on_3b")
COMPACT = [
    ("missing", {"no_pitcher": (P.format("success"),), "no_batter": (B.format("success"),)}),
    ("known", {"pitcher_raw": (P.format("success"), 0.5), "batter_raw": (B.format("success"), 0.5),
               "now_raw": (V.format(5, "success"), V.format(3, "success"), P.format("success"), 0.5),
               "reverse_raw": (P.format("reverse"), 0.0), "middle_raw": (P.format("middle"), 0.0)}),
    ("bounded", {f"{c}_in": (f"{c}_raw", 0.0, 1.0) for c in ("pitcher", "batter", "now")}),
    ("shrunk", {"pitcher_rate": ("pitcher_in", "asof_pitcher_n", 200, 0.5), "batter_rate": ("batter_in", "asof_batter_n", 200, 0.5)}),
    ("log", {"pitcher_log": ("asof_pitcher_n",), "batter_log": ("asof_batter_n",)}),
    ("reliability", {"pitcher_trust": ("asof_pitcher_n", 200.0)}),
    ("size", {"margin_size": ("score_diff_pitcher_team",)}),
    ("flag", {"close": ("margin_size", "<=", 2), "behind": ("score_diff_pitcher_team", "<", 0), "late": ("inning", ">=", 7),
              "tense": ("li", ">=", 2), "two": ("strikes_before", "=", 2), "three": ("balls_before", "=", 3)}),
    ("alike", {"same_side": ("pitcher_hand", "batter_hand")}),
    ("any", {"scoring": RUNNERS[1:]}),
    ("product", {"full_count": ("three", "two"), "late_close": ("late", "close"), "loaded": RUNNERS}),
    ("weighted", {"balls_share": ({"balls_before": 1 / 3},), "strikes_share": ({"strikes_before": 0.5},),
                  "count_margin": ({"balls_before": 1, "strikes_before": -1},), "pressure": (dict(zip(RUNNERS, (1, 2, 3))),),
                  "blend": ({"now_in": 0.6, "pitcher_rate": 0.4},), "blend_gap": ({"now_in": 1, "pitcher_rate": -1},),
                  "risk": ({"reverse_raw": 1, "middle_raw": 1},)}),
]
COMPACT_OUT = [n for kind, made in COMPACT for n in made if kind not in ("known", "bounded") and n != "three"]


@query("demo_feature_block", "P15", derived_spec(COMPACT, COMPACT_OUT, ["full_count", "late_close", "loaded", "count_margin", "pressure", "margin_size"]),
       derived_sql(COMPACT, COMPACT_OUT))
def demo_feature_block(spark, sf):
    """A compact block of counts, pressure, shrunken and blended rates by general kinds."""
    return rf.derived(train(spark, sf), COMPACT)


_mx = [f"(asof_pitcher_pitchmix_n * coalesce({P.format(k)}, {rf.DEFAULT_PRIORS['pitcher_' + k]}) + 200 * {rf.DEFAULT_PRIORS['pitcher_' + k]}) / (asof_pitcher_pitchmix_n + 200)" for k in ("fastball", "breaking", "offspeed")]
_tot = "(" + " + ".join(_mx) + ")"
_rs = "(runner_on_2b = 1 OR runner_on_3b = 1)::INT"
_ld = "(runner_on_1b = 1 AND runner_on_2b = 1 AND runner_on_3b = 1)::INT"
P16 = {"mix_entropy": " + ".join(f"-({m} / {_tot}) * ln({m} / {_tot})" for m in _mx),
       "score_class": "CASE WHEN score_diff_pitcher_team = 0 THEN 'tie' WHEN abs(score_diff_pitcher_team) <= 3 THEN 'close' WHEN score_diff_pitcher_team > 3 THEN 'ahead' ELSE 'behind' END",
       "li_log": "ln(1 + li)", "own_win_expectancy": "CASE WHEN top_bottom = 'T' THEN home_win_expectancy ELSE away_win_expectancy END",
       "risp_success": f"{_rs} * (asof_pitcher_n * coalesce({P.format('success')}, 0.5) + 100) / (asof_pitcher_n + 200)", "loaded_li": f"{_ld} * ln(1 + li)",
       "third_score": "runner_on_3b * score_diff_pitcher_team", "loaded_balls": f"{_ld} * balls_before", "risp_strikes": f"{_rs} * strikes_before",
       "force_in": "(runner_on_1b = 1 AND runner_on_2b = 1 AND runner_on_3b = 1 AND balls_before = 3)::INT", "no_runners": "(num_runners_on = 0)::INT"}


@query("mix_situation_features", "P16", spec(P16, {"third_score", "loaded_balls", "risp_strikes", "force_in", "no_runners"}, {"score_class"}), sql(P16))
def mix_situation_features(spark, sf):
    """Mix entropy, score class and runner interactions."""
    return rf.mix_and_situation(train(spark, sf), rf.DEFAULT_PRIORS)


FEED = {
    "balls": "cast(l_linenumber % 4 as int)", "strikes": "cast(l_orderkey % 3 as int)", "inning": "cast(1 + l_orderkey % 12 as int)",
    "on_1b": "case when l_partkey % 2 = 1 then l_partkey end", "on_2b": "case when l_suppkey % 2 = 1 then l_suppkey end", "on_3b": "case when l_orderkey % 2 = 1 then l_orderkey end",
    "bat_score": "cast(l_linenumber as int)", "fld_score": "cast(l_suppkey % 7 as int)", "home_score": "cast(l_linenumber as int)", "away_score": "cast(l_suppkey % 7 as int)",
    "p_throws": "case when l_suppkey % 3 = 0 then 'L' else 'R' end", "stand": "case when l_partkey % 4 = 0 then 'L' else 'R' end",
    "description": "case l_partkey % 7 when 0 then 'called_strike' when 1 then 'swinging_strike' when 2 then 'foul' when 3 then 'ball' when 4 then 'hit_into_play' when 5 then 'foul_tip' else null end",
    "type": "case l_partkey % 7 when 3 then 'B' when 4 then 'X' else 'S' end", "zone": "case when l_linenumber = 7 then null else cast(1 + l_orderkey % 14 as int) end",
    "pitch_type": "case l_orderkey % 8 when 0 then 'FF' when 1 then 'SI' when 2 then 'SL' when 3 then 'CU' when 4 then 'CH' when 5 then 'KN' when 6 then 'XX' else null end",
    "vx0": "l_discount * 50e0 - 2e0", "vy0": "-130e0 - l_quantity / 4e0", "vz0": "-4e0 - l_tax * 10e0", "ax": "l_tax * 100e0 - 3e0",
    "ay": "case when l_linenumber = 1 then 0e0 else 20e0 + l_quantity / 5e0 end", "az": "-20e0 - l_discount * 60e0",
    "release_pos_y": "case when l_linenumber < 3 then 54e0 + l_tax * 5e0 end", "release_extension": "case when l_linenumber < 6 then 5.5e0 + l_discount * 8e0 end",
    "season": "cast(year(l_shipdate) as int)", "k1": "l_orderkey", "k2": "l_linenumber", "k3": "l_partkey", "k4": "l_suppkey",
}
F_CTE = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEED.items()) + " FROM lineitem)"


def feed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FEED.items()])


def fsql(cols: dict[str, str]) -> str:
    return f"WITH {F_CTE} SELECT {KS}, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM t"


_b = ["(on_1b IS NOT NULL)::INT", "(on_2b IS NOT NULL)::INT", "(on_3b IS NOT NULL)::INT"]
P3 = {"score_diff_bat": "bat_score - fld_score", "base_state": f"{_b[0]} + 2 * {_b[1]} + 4 * {_b[2]}", "runner_count": " + ".join(_b), "risp": "(on_2b IS NOT NULL OR on_3b IS NOT NULL)::INT",
      "bases_loaded": "(on_1b IS NOT NULL AND on_2b IS NOT NULL AND on_3b IS NOT NULL)::INT", "count_state": "balls::VARCHAR || '-' || strikes::VARCHAR", "two_strike": "(strikes = 2)::INT",
      "full_count": "(balls = 3 AND strikes = 2)::INT", "pitcher_ahead": "(strikes > balls AND NOT (balls = 3 AND strikes = 2))::INT", "batter_ahead": "(balls > strikes)::INT",
      "matchup": "p_throws || '_' || stand", "same_handed_matchup": "(p_throws = stand)::INT", "late_inning": "(inning >= 7)::INT", "extra_inning": "(inning >= 10)::INT", "close_game": "(abs(bat_score - fld_score) <= 2)::INT"}


@query("situation_columns", "P3", spec(P3, set(P3) - {"count_state", "matchup"}, {"count_state", "matchup"}), fsql(P3))
def situation_columns(spark, sf):
    """Score, base, count and handedness state."""
    scores = {"score_diff_bat": ("bat_score", "fld_score"), "score_diff_home": ("home_score", "away_score")}
    return feed(spark, sf).withColumns(
        situation.occupancy(["on_1b", "on_2b", "on_3b"]) | situation.count_flags("balls", "strikes")
        | situation.margins(scores, {"close_game": ("score_diff_bat", 2)}) | situation.sides("p_throws", "stand")
        | situation.reached("inning", {"late_inning": 7, "extra_inning": 10}))


_sw = "coalesce(description IN ('swinging_strike', 'foul', 'hit_into_play', 'foul_tip'), false)::INT"
P4 = {"is_swing": _sw, "is_whiff": "coalesce(description = 'swinging_strike', false)::INT", "is_called": "coalesce(description = 'called_strike', false)::INT", "is_take": f"1 - {_sw}",
      "is_csw": "coalesce(description IN ('called_strike', 'swinging_strike'), false)::INT", "in_zone": "coalesce(zone BETWEEN 1 AND 9, false)::INT", "out_zone": "coalesce(zone BETWEEN 11 AND 14, false)::INT", "is_strike": "(type = 'S')::INT",
      "family": "CASE WHEN pitch_type IN ('FF', 'SI') THEN 'fb' WHEN pitch_type IN ('SL', 'CU') THEN 'br' WHEN pitch_type IN ('CH', 'KN') THEN 'off' ELSE 'other' END"}


@query("outcome_labels", "P4 P5", spec(P4, set(P4) - {"family"}, {"family"}), fsql(P4))
def outcome_labels(spark, sf):
    """Swing, whiff, called, zone and strike labels with the pitch family."""
    return situation.outcomes(feed(spark, sf)).withColumn(
        "family", buckets.mapped(F.col("pitch_type"), situation.PITCH_FAMILIES, "other"))


def angle_sql(dist: str, sign: str, guard: bool) -> tuple[str, str]:
    t = f"CASE WHEN abs(0.5 * ay) > 1e-9 THEN (-vy0 - sqrt(greatest(vy0 * vy0 - 2 * ay * ({dist}), 0))) / nullif(ay, 0) ELSE -({dist}) / vy0 END"
    t = f"(CASE WHEN {t} > 0 THEN {t} END)" if guard else f"({t})"
    vy = f"abs(vy0 + ay * {t})" if guard else f"-(vy0 + ay * {t})"
    return f"degrees(atan2(vz0 + az * {t}, {vy}))", f"degrees(atan2(vx0 + ax * {t}, {vy}))"


_vaa, _haa = angle_sql("50 - 17 / 12.0", "", True)
_vra, _hra = angle_sql("50 - coalesce(release_pos_y, 60.5 - release_extension, 54.5)", "", False)
P19 = {"vaa": _vaa, "haa": _haa, "vra": _vra, "hra": _hra}


@query("flight_angles", "P19 P20", spec(P19), fsql(P19))
def flight_angles(spark, sf):
    """Approach angles at the plate and angles at release."""
    return feed(spark, sf).withColumns({
        **physics.plate_angles(), **physics.release_angles(F.col("release_pos_y"), F.col("release_extension"))})


@query("structural_filter", "P17 P18", "k1:i k2:i k3:i k4:i qty:d price:d side:d", """
SELECT l_orderkey k1, l_linenumber k2, l_partkey k3, l_suppkey k4, CASE WHEN l_quantity * 2000 > l_extendedprice THEN NULL WHEN l_quantity < 3 OR l_quantity > 48 THEN NULL ELSE l_quantity END qty,
 CASE WHEN l_quantity * 2000 > l_extendedprice THEN NULL ELSE l_extendedprice END price, l_discount * CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END side FROM lineitem WHERE l_linenumber <= 6""")
def structural_filter(spark, sf):
    """Impossible rows dropped, values outside bounds nulled, lateral values mirrored."""
    rows = table(spark, sf, "lineitem").filter("l_linenumber <= 6")
    clash = F.col("l_quantity") * 2000 > F.col("l_extendedprice")
    return rows.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.when(~clash, physics.bounded(F.col("l_quantity"), 3, 48)).alias("qty"), F.when(~clash, F.col("l_extendedprice")).alias("price"),
        physics.mirrored(F.col("l_discount"), F.col("l_linestatus"), "F").alias("side"))


P21 = {"three": "CASE WHEN strikes > balls THEN 0 WHEN balls > strikes THEN 2 ELSE 1 END",
       "six": "CASE WHEN strikes < balls AND balls <> 3 THEN 5 WHEN balls = 3 AND strikes = 2 THEN 4 WHEN balls = 3 THEN 3 WHEN strikes = 2 THEN 2 WHEN strikes > balls THEN 1 ELSE 0 END",
       "inning_bin": "CASE WHEN inning < 4 THEN 0 WHEN inning < 7 THEN 1 WHEN inning < 10 THEN 2 ELSE 3 END", "zone_bin": "CASE WHEN zone IS NULL THEN 2 WHEN zone < 5 THEN 0 WHEN zone < 10 THEN 1 ELSE 2 END",
       "inning_label": "CASE WHEN inning <= 3 THEN '1-3' WHEN inning <= 6 THEN '4-6' WHEN inning <= 9 THEN '7-9' ELSE '10+' END"}


@query("bucket_codes", "P21 P22", spec(P21, set(P21) - {"inning_label"}, {"inning_label"}), fsql(P21))
def bucket_codes(spark, sf):
    """Count classes and edge buckets, NULL in the last left-closed bin."""
    b, s = F.col("balls"), F.col("strikes")
    return feed(spark, sf).withColumns({
        "three": buckets.three_way_count(b, s), "six": buckets.six_way_count(b, s), "inning_bin": buckets.digitize(F.col("inning"), [4, 7, 10]),
        "zone_bin": buckets.digitize(F.col("zone"), [5, 10]), "inning_label": buckets.cut(F.col("inning"), [0, 3, 6, 9, float("inf")], ["1-3", "4-6", "7-9", "10+"])})


P24 = {"gkey": "coalesce(pitch_type, '__MISSING__') || chr(31) || balls::VARCHAR", "split": "CASE WHEN season <= 1999 THEN 'train' WHEN season = 2000 THEN 'test' ELSE 'unused' END"}


@query("group_keys_and_split", "P24 P29", spec(P24, set(), set(P24)), fsql(P24))
def group_keys_and_split(spark, sf):
    """Text group keys in which NULL is a value, and the season split."""
    return feed(spark, sf).withColumns({"gkey": buckets.group_key(["pitch_type", "balls"]),
                                        "split": buckets.split_label(F.col("season"), [1995, 1996, 1997, 1998, 1999], [2000])})


@query("category_codes", "P25", "k1:i k2:i k3:i k4:i code:i", f"""
WITH {F_CTE}, m AS (SELECT pitch_type, row_number() OVER (ORDER BY pitch_type) - 1 code FROM (SELECT DISTINCT pitch_type FROM t WHERE k4 % 2 = 0 AND pitch_type IS NOT NULL AND pitch_type <> 'XX'))
SELECT k1, k2, k3, k4, coalesce(code, -1) code FROM t LEFT JOIN m USING (pitch_type)""")
def category_codes(spark, sf):
    """Codes from the fit rows' levels; unseen levels are -1."""
    from foretally.operators.prepare import category_codes as fit, encode
    rows = feed(spark, sf)
    table_ = fit(rows.filter("k4 % 2 = 0 AND pitch_type <> 'XX'"), "pitch_type")
    return encode(rows, table_, "pitch_type", "code")


@query("one_hot_with_missing", "P26", "k1:i k2:i k3:i k4:i pitch_type_FF:i pitch_type_SL:i pitch_type_null:i", f"""
WITH {F_CTE} SELECT k1, k2, k3, k4, coalesce(pitch_type = 'FF', false)::INT pitch_type_FF, coalesce(pitch_type = 'SL', false)::INT pitch_type_SL, (pitch_type IS NULL)::INT pitch_type_null FROM t""")
def one_hot_with_missing(spark, sf):
    """Indicator columns with a missing indicator and safe names."""
    from foretally.operators.prepare import one_hot
    return one_hot(feed(spark, sf), "pitch_type", ["FF", "SL"])


FEED_KNOWN = ("season", "k1", "k2", "k3", "k4", "balls", "strikes", "inning", "on_1b", "on_2b", "on_3b", "bat_score",
              "fld_score", "home_score", "away_score", "p_throws", "stand")


@query("leakage_projection", "P27", "column:s banned:i rows:i", """
SELECT c AS "column", b banned, count(*) AS "rows" FROM lineitem, (VALUES """ + ", ".join(f"('{c}', 0)" for c in FEED_KNOWN) + """,
 ('pitch_type', 1), ('events', 1), ('launch_speed', 1), ('post_bat_score', 1), ('delta_run_exp', 1), ('estimated_woba_using_speedangle', 1),
 ('pitcher_days_until_next_game', 1), ('is_whiff', 1), ('in_zone', 1), ('pitcher_days_since_prev_game', 0), ('home_win_rate', 0), ('spin_rate_before', 0)) t(c, b) GROUP BY 1, 2""")
def leakage_projection(spark, sf):
    """A feed with results of the current event: which columns the ban finds, and what a projection without them reads."""
    from foretally.operators.prepare import late_columns, without_banned
    more = ("pitch_type", "events", "launch_speed", "post_bat_score", "delta_run_exp", "estimated_woba_using_speedangle", "pitcher_days_until_next_game",
            "is_whiff", "in_zone", "pitcher_days_since_prev_game", "home_win_rate", "spin_rate_before")
    rows = feed(spark, sf).select(*FEED_KNOWN).withColumns({c: F.col("k4") for c in more})
    late = late_columns(rows.columns)
    left = without_banned(rows, late)
    seen = lambda df: df.agg(*[F.count(F.lit(1)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "rows")
    return seen(left).withColumn("banned", F.lit(0)).unionByName(seen(rows.select(*late)).withColumn("banned", F.lit(1)))
