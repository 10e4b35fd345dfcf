"""Row-wise features of the pitch table. Each block depends on its own row and on frozen
constants only, so scoring one row or all rows gives the same values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foretally.functions.rates import (clip, eb, entropy, ratio, reliability, row_count, row_mean,
                                       row_std)

# History columns of the pitch table, and priors used when nothing is fitted.
RATE_COUNTS = {
    "pitcher_success": ("asof_pitcher_success_rate", "asof_pitcher_n"),
    "pitcher_reverse": ("asof_pitcher_reverse_rate", "asof_pitcher_n"),
    "pitcher_middle": ("asof_pitcher_middle_rate", "asof_pitcher_n"),
    "batter_success": ("asof_batter_success_rate", "asof_batter_n"),
    "batter_middle": ("asof_batter_middle_rate", "asof_batter_n"),
    "pitcher_ball": ("asof_pitcher_ball_rate", "asof_pitcher_n"),
    "pitcher_strike": ("asof_pitcher_strike_rate", "asof_pitcher_n"),
    "pitcher_fastball": ("asof_pitcher_fastball_rate", "asof_pitcher_pitchmix_n"),
    "pitcher_breaking": ("asof_pitcher_breaking_rate", "asof_pitcher_pitchmix_n"),
    "pitcher_offspeed": ("asof_pitcher_offspeed_rate", "asof_pitcher_pitchmix_n"),
}
DEFAULT_PRIORS = {
    "pitcher_success": 0.50, "pitcher_reverse": 0.23, "pitcher_middle": 0.15,
    "pitcher_ball": 0.50, "pitcher_strike": 0.50, "batter_success": 0.50, "batter_middle": 0.15,
    "pitcher_fastball": 0.50, "pitcher_breaking": 0.30, "pitcher_offspeed": 0.20,
}
STRENGTHS = (10.0, 50.0, 200.0, 500.0)
COUNT_LEVELS = (0, 25, 100, 500, 1000)
RECENT = (1, 3, 5)
CORE_RATES = ("pitcher_success", "pitcher_reverse", "pitcher_middle", "batter_success", "batter_middle")


def recent(kind: str, k: int) -> Column:
    return F.col(f"asof_pitcher_prev{k}_game_{kind}_rate")


def career(kind: str, side: str = "pitcher") -> Column:
    return F.col(f"asof_{side}_{kind}_rate")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def recent_deltas() -> dict[str, Column]:
    return {f"pitcher_{kind}_delta_prev{k}": recent(kind, k) - career(kind)
            for k in RECENT for kind in ("success", "middle")}


def smoothed(names: Sequence[str], priors: Mapping[str, float], strength: float,
             suffix: str = "") -> dict[str, Column]:
    out = {}
    for name in names:
        rate, n = RATE_COUNTS[name]
        count = F.greatest(F.col(n), F.lit(0)).cast("double")
        prior = F.lit(float(priors[name]))
        out[f"{name}_smoothed{suffix}"] = eb(count * F.coalesce(F.col(rate), prior), count, strength, prior)
        out[f"{name}_reliability{suffix}"] = reliability(count, strength)
    return out


def state_columns() -> dict[str, Column]:
    return {
        "score_abs": F.abs("score_diff_pitcher_team"), "late_inning": flag(F.col("inning") >= 7),
        "high_leverage": flag(F.col("li") >= 2)}


def stateless(df: DataFrame, priors: Mapping[str, float], strength: float = 200.0) -> DataFrame:
    """Numeric state codes, recent deltas and smoothed career rates."""
    return df.withColumns({
        "count_state": F.col("balls_before") * 3 + F.col("strikes_before"),
        "handedness_matchup": F.col("pitcher_hand") * 2 + F.col("batter_hand"),
        "runner_out_state": F.col("num_runners_on") * 3 + F.col("outs_before"),
        **state_columns(),
        "log1p_asof_pitcher_n": F.log1p(F.col("asof_pitcher_n").cast("double")),
        "log1p_asof_batter_n": F.log1p(F.col("asof_batter_n").cast("double")),
        **recent_deltas(), "ball_strike_gap": career("ball") - career("strike"),
        **{f"{n}_is_missing": F.col(RATE_COUNTS[n][0]).isNull().cast("int") for n in CORE_RATES},
        **smoothed(CORE_RATES, priors, strength)})


def text_states(df: DataFrame) -> DataFrame:
    """State codes as text, log counts, recent deltas and the ball-strike sum gap."""
    text = lambda c: F.col(c).cast("string")
    return df.withColumns({
        "count_text": F.concat_ws("-", text("balls_before"), text("strikes_before")),
        "runner_out_text": F.concat(text("base_state"), F.lit("_o"), text("outs_before")),
        "hand_text": F.concat_ws("_", text("pitcher_hand"), text("batter_hand")),
        **state_columns(), **recent_deltas(),
        **{f"log1p_{c}": F.log1p(F.greatest(F.col(c), F.lit(0)).cast("double"))
           for c in ("asof_pitcher_n", "asof_batter_n", "asof_pitcher_pitchmix_n")},
        "ball_strike_rate_sum_gap": career("ball") + career("strike") - 1.0})


def multi_strength(df: DataFrame, priors: Mapping[str, float] = DEFAULT_PRIORS) -> DataFrame:
    """Ten rates at four strengths, count flags, recent spread and failure sums."""
    made = {f"{n}_is_missing": F.col(RATE_COUNTS[n][0]).isNull().cast("int") for n in RATE_COUNTS}
    for k in STRENGTHS:
        made.update(smoothed(list(RATE_COUNTS), priors, k, f"_{int(k)}"))
    for side in ("pitcher", "batter"):
        n = F.col(f"asof_{side}_n")
        for level in COUNT_LEVELS:
            name = f"{side}_n_{'eq' if level == 0 else 'le'}_{level}"
            made[name] = flag(n == 0 if level == 0 else n <= level)
    for kind in ("success", "middle"):
        cols = [recent(kind, k) for k in RECENT]
        made[f"recent_{kind}_mean"] = row_mean(cols)
        made[f"recent_{kind}_std"] = row_std(cols, 1)
        made[f"recent_{kind}_range"] = F.greatest(*cols) - F.least(*cols)
    made["failure_rate_sum"] = career("reverse") + career("middle") + 1.0 - career("success")
    made["component_gap"] = career("success") + career("reverse") + career("middle") - 1.0
    return df.withColumns(made)


PROFILE_RATES = ("success", "reverse", "middle", "ball", "strike", "fastball", "breaking", "offspeed")


def fit_spec(df: DataFrame, y: str) -> dict[str, dict[str, float]]:
    """Means and medians of the fit rows, one small row on the driver."""
    from foretally.operators.ranks import metric_quantiles
    cols = [f"asof_pitcher_{r}_rate" for r in PROFILE_RATES] + ["asof_batter_middle_rate"] + [
        f"asof_pitcher_prev{k}_game_{kind}_rate" for k in RECENT for kind in ("success", "middle")]
    medians = {r["metric"]: r["m"] for r in metric_quantiles(df, [], cols, {"m": 0.5}).collect()}
    mean = df.agg(F.avg(y)).first()[0]
    return {"median": medians, "prior": {
        "pitcher_success": mean, "batter_success": mean,
        "pitcher_reverse": medians["asof_pitcher_reverse_rate"],
        "pitcher_middle": medians["asof_pitcher_middle_rate"],
        "batter_middle": medians["asof_batter_middle_rate"]}}


def shrunk_profile(df: DataFrame, medians: Mapping[str, float], strength: float = 200.0) -> DataFrame:
    """Career rates shrunk to medians, recent trend, spread, missing count and direction."""
    n = F.col("asof_pitcher_n").cast("double")
    made = {}
    for r in PROFILE_RATES:
        c = f"asof_pitcher_{r}_rate"
        m = F.lit(medians[c])
        made[f"prof_{r}"] = eb(n * F.coalesce(F.col(c), m), n, strength, m)
    filled = {(kind, k): F.coalesce(recent(kind, k), F.lit(medians[f"asof_pitcher_prev{k}_game_{kind}_rate"]))
              for kind in ("success", "middle") for k in RECENT}
    for kind in ("success", "middle"):
        made[f"prev_trend_{kind}"] = filled[kind, 1] - filled[kind, 5]
        made[f"prev_std_{kind}"] = row_std([filled[kind, k] for k in RECENT], 0)
    raw = [recent(kind, k) for kind in ("success", "middle") for k in RECENT]
    made["prev_missing"] = F.lit(len(raw)) - row_count(raw)
    for k in RECENT:
        made[f"fail_direction_{k}"] = filled["middle", k] - (1 - filled["success", k])
    made["profile_reliability"] = reliability(n, strength)
    return df.withColumns(made)


def second_order(df: DataFrame, squares: Sequence[str] = (),
                 products: Sequence[tuple[str, str]] = (),
                 differences: Sequence[tuple[str, str]] = (),
                 ratios: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Chosen squares, products, differences and floored ratios of columns."""
    made = {f"sq_{c}": F.col(c) * F.col(c) for c in squares}
    made.update({f"x_{a}_{b}": F.col(a) * F.col(b) for a, b in products})
    made.update({f"d_{a}_{b}": F.col(a) - F.col(b) for a, b in differences})
    made.update({f"r_{a}_{b}": F.col(a) / F.when(F.col(b) < 1e-3, 1e-3).otherwise(F.col(b)) for a, b in ratios})
    return df.withColumns(made)


def momentum(df: DataFrame, strength: float = 200.0) -> DataFrame:
    """Signed parts and shrunken recent deltas, their median and sign sum."""
    rel = reliability(F.greatest(F.col("asof_pitcher_n"), F.lit(0)).cast("double"), strength)
    made = {}
    for kind in ("success", "middle"):
        deltas = [recent(kind, k) - career(kind) for k in RECENT]
        for k, d in zip(RECENT, deltas):
            made[f"{kind}_up{k}"] = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
            made[f"{kind}_down{k}"] = F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
            made[f"{kind}_shrunk{k}"] = d * rel
        known = F.array_sort(F.array_compact(F.array(*deltas)))
        size = F.size(known)
        mid = lambda i: F.get(known, i)
        made[f"{kind}_median"] = F.when(size > 0, (mid(F.floor((size - 1) / 2).cast("int"))
                                                   + mid(F.floor(size / 2).cast("int"))) / 2.0)
        signs = [F.coalesce(F.signum(d), F.lit(0.0)) for d in deltas]
        made[f"{kind}_sign_sum"] = signs[0] + signs[1] + signs[2]
        made[f"{kind}_1_minus_5"] = recent(kind, 1) - recent(kind, 5)
    return df.withColumns(made)


def context_flags(df: DataFrame, adjusted: Mapping[str, str]) -> DataFrame:
    """Adjusted rates under a game type, a full count and late innings."""
    full = flag((F.col("balls_before") == 3) & (F.col("strikes_before") == 2))
    return df.withColumns({
        "is_f_reverse": flag(F.col("game_type") == "F") * F.col(adjusted["reverse"]),
        "full_success": full * F.col(adjusted["success"]),
        "late_middle": flag(F.col("inning") >= 7) * F.col(adjusted["middle"])})


def _compared(column: str, sign: str, bound: float) -> Column:
    c = F.col(column)
    return flag({"=": c == bound, "<": c < bound, "<=": c <= bound, ">": c > bound, ">=": c >= bound}[sign])


def _times(*columns: str) -> Column:
    return reduce(lambda a, b: a * b, [F.col(c) for c in columns])


def _counted(n: str) -> Column:
    return F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)).cast("double")


#: Ways to derive a column, by name; arguments are column names and numbers.
KINDS: Mapping[str, Callable[..., Column]] = {
    "alike": lambda a, b: flag(F.col(a) == F.col(b)),
    "any": lambda *flags: F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in flags]),
    "bounded": lambda c, low, high: clip(F.col(c), low, high),
    "flag": _compared,
    "known": lambda *columns: F.coalesce(*[F.lit(c) if isinstance(c, float) else F.col(c) for c in columns]),
    "log": lambda n: F.log1p(_counted(n)),
    "missing": lambda c: F.col(c).isNull().cast("int"),
    "product": _times,
    "quotient": lambda a, b, least=1e-3: F.col(a) / F.when(F.col(b) < least, least).otherwise(F.col(b)),
    "reliability": lambda n, strength: reliability(_counted(n), strength),
    "root": lambda *columns: F.sqrt(_times(*columns)),
    "shrunk": lambda rate, n, strength, prior: eb(_counted(n) * F.col(rate), _counted(n), strength, prior),
    "size": lambda c: F.abs(F.col(c)),
    "weighted": lambda weights, start=0: reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()], F.lit(start)),
}


def derived(df: DataFrame, steps: Sequence[tuple[str, Mapping[str, Sequence]]]) -> DataFrame:
    """``df`` with columns derived step by step: (kind, {name: arguments}).

    A step may use the columns of earlier steps. All kinds depend on their row alone. Flags are 0 where
    what they compare is NULL; counts below zero or NULL are 0; other results of NULL are NULL.
    """
    for kind, made in steps:
        df = df.withColumns({name: KINDS[kind](*args) for name, args in made.items()})
    return df


def mix_and_situation(df: DataFrame, priors: Mapping[str, float], strength: float = 200.0) -> DataFrame:
    """Mix entropy of smoothed shares, score class, own win expectancy and runner products."""
    s = smoothed(["pitcher_fastball", "pitcher_breaking", "pitcher_offspeed", "pitcher_success"], priors, strength)
    mix = [s[f"pitcher_{k}_smoothed"] for k in ("fastball", "breaking", "offspeed")]
    total = mix[0] + mix[1] + mix[2]
    diff = F.col("score_diff_pitcher_team")
    risp = F.greatest(F.col("runner_on_2b"), F.col("runner_on_3b"))
    loaded = F.col("runner_on_1b") * F.col("runner_on_2b") * F.col("runner_on_3b")
    return df.withColumns({
        "mix_entropy": entropy([ratio(m, total) for m in mix]),
        "score_class": F.when(diff == 0, "tie").when(F.abs(diff) <= 3, "close").when(diff > 3, "ahead").otherwise("behind"),
        "li_log": F.log1p("li"),
        "own_win_expectancy": F.when(F.col("top_bottom") == "T", F.col("home_win_expectancy")).otherwise(F.col("away_win_expectancy")),
        "risp_success": risp * s["pitcher_success_smoothed"], "loaded_li": loaded * F.log1p("li"),
        "third_score": F.col("runner_on_3b") * diff, "loaded_balls": loaded * F.col("balls_before"),
        "risp_strikes": risp * F.col("strikes_before"),
        "force_in": flag((loaded == 1) & (F.col("balls_before") == 3)),
        "no_runners": flag(F.col("num_runners_on") == 0)})
