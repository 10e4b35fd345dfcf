"""Features of a row's own past: lags, rolling, expanding, day-window and season rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from foretally import session
from foretally.functions.rates import eb, non_negative, ratio
from foretally.operators.joins import null_safe_join, small_join
from foretally.operators.ordered import BLOCK, FINER, History, assign_block, hot_cuts
from foretally.roles import Order

# Shrink strength per rate.
RATE_STRENGTH = {"csw": 200, "whiff": 150, "called": 150, "zone": 200, "chase": 120, "fps": 100}


def lag_columns(w: WindowSpec, columns: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"prev_{c}_{k}": F.lag(c, k).over(w) for c in columns for k in lags}


def lags(h: History, columns: Sequence[str], steps: Sequence[int]) -> History:
    """Values of the previous rows of the group."""
    return h.frames(max(steps), lambda w: lag_columns(w, columns, steps))


def guarded(stat: Column, count: Column, min_periods: int) -> Column:
    return F.when(count >= min_periods, stat)


def rolling(h: History, columns: Sequence[str], window: int, min_periods: int,
            stats: Sequence[str] = ("mean",)) -> History:
    """Mean or sample deviation of the previous ``window`` rows, non-null values counted."""
    fn = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}

    def build(w: WindowSpec) -> Mapping[str, Column]:
        frame = w.rowsBetween(-window, -1)
        return {f"{c}_last{window}_{s}": guarded(fn[s](c).over(frame), F.count(c).over(frame),
                                                 max(min_periods, 2 if s == "std" else 1))
                for c in columns for s in stats}

    return h.frames(window, build)


def expanding_mean(h: History, columns: Sequence[str], min_periods: int) -> History:
    """Mean of all earlier non-null values once ``min_periods`` of them exist."""
    sums = {}
    for c in columns:
        sums[f"__s_{c}"], sums[f"__n_{c}"] = F.col(c), F.col(c).isNotNull().cast("long")
    out = h.running(sums)
    return out.replace(out.df.withColumns(
        {f"{c}_before": F.when(F.col(f"__n_{c}") >= max(min_periods, 1),
                               ratio(f"__s_{c}", f"__n_{c}")) for c in columns}
    ).drop(*sums))


def expanding_rate(h: History, rates: Mapping[str, tuple[Column, Column, float, Column | float]]
                   ) -> History:
    """Past shrunken rates: name -> (numerator, denominator, strength, prior)."""
    sums = {}
    for name, (num, den, _, _) in rates.items():
        sums[f"__s_{name}"], sums[f"__d_{name}"] = num, den
    out = h.running(sums)
    made = {}
    for name, (_, _, strength, prior) in rates.items():
        made[name] = eb(f"__s_{name}", f"__d_{name}", strength, prior)
        made[f"{name}_n"] = F.col(f"__d_{name}")
    return out.replace(out.df.withColumns(made).drop(*sums))


def last_n_sums(h: History, sums: Mapping[str, Column], reach: int) -> History:
    """Sums over the previous ``reach`` rows as differences of running totals."""
    running = h.running({f"__t_{n}": e for n, e in sums.items()})

    def build(w: WindowSpec) -> Mapping[str, Column]:
        return {n: F.col(f"__t_{n}") - F.coalesce(F.lag(f"__t_{n}", reach).over(w), F.lit(0))
                for n in sums}

    out = running.frames(reach, build)
    return out.replace(out.df.drop(*[f"__t_{n}" for n in sums]))


def daily_windows(df: DataFrame, entity: str, day: str, season: str,
                  sums: Mapping[str, Column], width: int = 14) -> DataFrame:
    """Totals before each (entity, day): season to date, career, and the last ``width`` days.

    Rows are reduced to one per entity and day first, so window groups are bounded by the
    calendar. Missing history stays NULL.
    """
    daily = df.groupBy(entity, season, day).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    number = F.unix_date(F.col(day).cast("date"))
    by_day = Window.partitionBy(entity).orderBy(number)
    near = by_day.rangeBetween(-width, -1)
    career = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    year = (Window.partitionBy(entity, season).orderBy(day)
            .rowsBetween(Window.unboundedPreceding, -1))
    made = []
    for n in sums:
        made += [F.sum(n).over(near).alias(f"{n}__near"), F.sum(n).over(career).alias(f"{n}__car"),
                 F.sum(n).over(year).alias(f"{n}__szn")]
    return daily.select(entity, season, day, *made)


def previous_season(df: DataFrame, entity: str, season: str,
                    sums: Mapping[str, Column]) -> DataFrame:
    """Season totals keyed by the following season."""
    return (df.groupBy(entity, season).agg(*[F.sum(e).alias(f"{n}__pszn")
                                            for n, e in sums.items()])
            .withColumn(season, F.col(season) + 1))


def _entity_windows(h: History, game: str, day: str, season: str, sums: Mapping[str, Column],
                    last_n: Sequence[int], width: int = 14) -> DataFrame:
    """All windows of ``history_rates`` over rows dealt once, by entity.

    Days and seasons are range frames on their numbers, so rows of one day see the same past; windows
    inside a game or season keep the entity's partitioning and only sort again.
    """
    entity, = h.keys
    longest = max(last_n)
    totals = h.running({f"__t_{n}": e for n, e in sums.items()})
    rows = totals.frames(longest, lambda w: {
        f"{n}__l{k}": F.col(f"__t_{n}") - F.coalesce(F.lag(f"__t_{n}", k).over(w), F.lit(0))
        for n in sums for k in last_n}).df
    number = F.unix_date(F.col(day).cast("date"))
    every = Window.unboundedPreceding
    frames = {"near": Window.partitionBy(entity).orderBy(number).rangeBetween(-width, -1),
              "car": Window.partitionBy(entity).orderBy(number).rangeBetween(every, -1),
              "szn": Window.partitionBy(entity, season).orderBy(number).rangeBetween(every, -1),
              "pszn": Window.partitionBy(entity).orderBy(F.col(season)).rangeBetween(-1, -1)}
    known = F.col(entity).isNotNull() & F.col(season).isNotNull()
    dated = known & F.col(day).isNotNull()
    made = {f"{n}__{name}": F.when(known if name == "pszn" else dated, F.sum(e).over(w))
            for name, w in frames.items() for n, e in sums.items()}
    inside = Window.partitionBy(entity, game).orderBy(*h.order.columns()).rowsBetween(every, -1)
    made |= {f"{n}__day": F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()}
    return rows.withColumns(made).drop(*[f"__t_{n}" for n in sums])


def _table_windows(h: History, game: str, day: str, season: str, sums: Mapping[str, Column],
                   last_n: Sequence[int]) -> DataFrame:
    """The same windows where an entity is too large for one task: days and seasons come from their own tables."""
    entity, = h.keys
    within = History(h.df, [game, entity], h.order, h.limit).running({f"{n}__day": e for n, e in sums.items()})
    recent = History(within.df, [entity], h.order, h.limit, h.cuts, h.base)
    for reach in last_n:
        recent = last_n_sums(recent, {f"{n}__l{reach}": e for n, e in sums.items()}, reach)
    return (recent.df.join(daily_windows(h.df, entity, day, season, sums), [entity, season, day], "left")
            .join(previous_season(h.df, entity, season, sums), [entity, season], "left"))


def history_rates(df: DataFrame, entity: str, game: str, day: str, season: str, order: Order,
                  rates: Mapping[str, tuple[Column, Column]], strength: Mapping[str, float],
                  prior: Mapping[str, Column | float], last_n: Sequence[int] = (100, 500),
                  hot_rows: int | None = None) -> DataFrame:
    """Rates in seven windows with shrinkage, sample size and missing flag.

    Windows: earlier rows of the game (day), previous 14 days, season and career to
    yesterday, the whole previous season, and the last N rows. The log is shuffled once unless an
    entity is hot.
    """
    sums = {}
    for m, (num, den) in rates.items():
        sums[f"{m}_n"], sums[f"{m}_d"] = num, den
    h = History(df, [entity], order, hot_rows)
    out = (_entity_windows if h.cuts is None else _table_windows)(h, game, day, season, sums, last_n)
    made = {}
    for w in ["day", "near", "szn", "pszn", "car", *[f"l{n}" for n in last_n]]:
        for m in rates:
            num, den = F.col(f"{m}_n__{w}"), F.col(f"{m}_d__{w}")
            zero = F.lit(0)
            made[f"{m}_rate_{w}"] = eb(F.coalesce(num, zero), F.coalesce(den, zero),
                                       strength[m], prior[m])
            made[f"{m}_den_{w}"] = F.coalesce(den, zero)
            made[f"{m}_miss_{w}"] = (den.isNull() if w in ("near", "szn", "pszn")
                                     else F.coalesce(den, zero) == 0).cast("int")
    drop = [f"{n}__{w}" for n in sums
            for w in ["day", "near", "szn", "pszn", "car", *[f"l{n}" for n in last_n]]]
    return out.withColumns(made).drop(*drop)


def times_faced(df: DataFrame, game: str, entity: str, opponent: str, turn: str) -> DataFrame:
    """Number of earlier turns of the same pair in the game."""
    keys = [game, entity, opponent]
    turns = df.select(*keys, turn).distinct()
    h = History(turns, keys, Order((turn,)))
    return null_safe_join(df, h.position("times_faced").df, [*keys, turn])


def turn_slot(df: DataFrame, game: str, side: str, turn: str, slots: int = 9) -> DataFrame:
    """Cyclic slot of a turn among the turns of its side."""
    turns = df.select(game, side, turn).distinct()
    h = History(turns, [game, side], Order((turn,)))
    slot = h.position("__t").df.withColumn("slot", F.pmod(F.col("__t"), F.lit(slots)) + 1)
    return null_safe_join(df, slot.drop("__t"), [game, side, turn])


def game_table(df: DataFrame, entity: str, game: str, day: str) -> DataFrame:
    return df.groupBy(entity, game).agg(F.min(day).alias("game_day"),
                                        F.count(F.lit(1)).alias("game_n"))


def _game_history(games: DataFrame, entity: str, game: str, hot_rows: int | None) -> History:
    return History(games, [entity], Order(("game_day", game)), hot_rows)


def previous_game(df: DataFrame, entity: str, game: str, day: str,
                  hot_rows: int | None = None) -> DataFrame:
    """Rows of the previous game and days of rest, per entity and game."""
    h = _game_history(game_table(df, entity, game, day), entity, game, hot_rows)
    out = h.frames(1, lambda w: {
        "prev_game_n": F.lag("game_n", 1).over(w),
        "rest_days": F.datediff("game_day", F.lag("game_day", 1).over(w)) - 1})
    return out.df


def workload(df: DataFrame, entity: str, game: str, day: str,
             hot_rows: int | None = None) -> DataFrame:
    """Past outing sizes per entity and game: mean, deviation, last five, index, season sum."""
    games = game_table(df, entity, game, day).withColumn("__season", F.year("game_day"))
    n = F.col("game_n")
    h = (_game_history(games, entity, game, hot_rows)
         .running({"__s": n, "__q": n * n, "outing_index": F.lit(1).cast("long")})
         .frames(5, lambda w: {
             "n_avg_l5": F.avg("game_n").over(w.rowsBetween(-5, -1)),
             "prev_game_n": F.lag("game_n", 1).over(w)}))
    season = h.regroup([entity, "__season"]).running({"__cum": n}).df
    k = F.col("outing_index")
    variance = ratio(F.col("__q") - ratio(F.col("__s") * F.col("__s"), k), F.when(k > 1, k - 1))
    return (season.withColumns({
        "n_avg_car": ratio("__s", "outing_index"),
        "n_sd_car": F.sqrt(non_negative(variance)),
        "season_cum": F.when(F.col("__cum") > 0, F.col("__cum"))})
        .drop("__s", "__q", "__cum", "__season"))


def workload_features(rows: DataFrame, games: DataFrame, entity: str, game: str,
                      today: str) -> DataFrame:
    """Position in today's game against the usual outing."""
    keep = [entity, game, "n_avg_car", "n_avg_l5", "prev_game_n", "n_sd_car", "outing_index",
            "season_cum"]
    out = rows.join(games.select(*keep), [entity, game], "left")
    mean, now = F.col("n_avg_car"), F.col(today)
    return out.withColumns({
        "workload_ratio": ratio(now, mean),
        "workload_excess": now - F.when(mean != 0, mean),
        "over_usual": F.coalesce(ratio(now, mean) > 1.0, F.lit(False)).cast("int"),
        "workload_z": ratio(now - mean, "n_sd_car"),
        "workload_ratio_l5": ratio(now, "n_avg_l5")})


def previous_turn_value(df: DataFrame, group: Sequence[str], turn: str, value: str,
                        order: Order) -> DataFrame:
    """Last non-null value of the previous turn, per group and turn."""
    last = df.groupBy(*group, turn).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order.cols)))
        .alias("__v"))
    h = History(last, list(group), Order((turn,)))
    return h.frames(1, lambda w: {f"prev_turn_{value}": F.lag("__v", 1).over(w)}).df.drop("__v")


def forward_filled_std(df: DataFrame, entity: str, order: Order, subset: Column,
                       columns: Sequence[str], window: int, min_periods: int,
                       hot_rows: int | None = None) -> DataFrame:
    """Deviation of the previous ``window`` subset rows, carried to all later rows.

    The rolling deviation runs on subset rows only; other rows take the last known value.
    """
    inside = F.coalesce(subset, F.lit(False))
    part = rolling(History(df.filter(inside), [entity], order, hot_rows), columns, window,
                   min_periods, ("std",)).df
    names = [f"{c}_last{window}_std" for c in columns]
    rows = part.unionByName(df.filter(~inside), allowMissingColumns=True)
    h = History(rows, [entity], order, hot_rows).last_known(
        {f"{n}_ff": F.col(n) for n in names})
    return h.df.drop(*names)


def _both_totals(whole: History, state: Sequence[str], x: Column, seen: Column) -> DataFrame:
    """Sums and counts before each row, of its state and of all rows, with rows dealt once, by block of the order.

    What earlier blocks contribute is a table of a row for each block and state.
    """
    # Blocks hold all rows of a stretch of the order, so they are cut to what a task holds.
    limit = min(whole.limit, FINER * session.task_rows(whole.df.sparkSession))
    cuts = whole.cuts if limit == whole.limit else hot_cuts(whole.df, [], whole.order, limit) or []
    rows = assign_block(whole.df, whole.order, cuts)
    cells = session.checkpoint(rows.groupBy(BLOCK, *state).agg(F.sum(x).alias("__ts"), F.sum(seen).alias("__tn")))
    every = Window.unboundedPreceding
    earlier = Window.partitionBy(*state).orderBy(BLOCK).rowsBetween(every, -1)
    blocks = Window.orderBy(BLOCK).rowsBetween(every, -1)
    mine = cells.select(BLOCK, *state, F.sum("__ts").over(earlier).alias("__cs"), F.sum("__tn").over(earlier).alias("__cn"))
    of_all = cells.groupBy(BLOCK).agg(F.sum("__ts").alias("__ts"), F.sum("__tn").alias("__tn")).select(
        BLOCK, F.sum("__ts").over(blocks).alias("__cgs"), F.sum("__tn").over(blocks).alias("__cgn"))
    inside = Window.partitionBy(BLOCK).orderBy(*whole.order.columns()).rowsBetween(every, -1)
    alike = Window.partitionBy(BLOCK, *state).orderBy(*whole.order.columns()).rowsBetween(every, -1)
    local = rows.repartition(len(cuts) + 1, BLOCK).withColumns({
        "__s": F.sum(x).over(alike), "__n": F.sum(seen).over(alike), "__gs": F.sum(x).over(inside), "__gn": F.sum(seen).over(inside)})
    out = small_join(small_join(local, mine, [BLOCK, *state]), of_all, [BLOCK])
    zero = F.lit(0)
    return out.withColumns({n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(c), zero) for n, c in (
        ("__s", "__cs"), ("__n", "__cn"), ("__gs", "__cgs"), ("__gn", "__cgn"))}).drop(BLOCK, "__cs", "__cn", "__cgs", "__cgn")


def prequential_ratio(df: DataFrame, state: Sequence[str], delta: str, fit: Column,
                      order: Order, strength: float, prior: Column | float,
                      hot_rows: int | None = None) -> DataFrame:
    """Shrunken past mean of a state over the past global mean (fit rows), and a frozen
    ratio by state (other rows); clipped to [0, 10] and classed low/medium/high."""
    x = F.when(fit, F.col(delta))
    seen = x.isNotNull().cast("long")
    whole = History(df, [], order, hot_rows)
    if whole.cuts is None:
        by_state = History(df, list(state), order, hot_rows).running({"__s": x, "__n": seen})
        both = by_state.regroup([]).running({"__gs": x, "__gn": seen}).df
    else:
        both = _both_totals(whole, state, x, seen)
    mean_all = df.agg(F.avg(x)).scalar()
    base = F.coalesce(ratio("__gs", "__gn"), F.lit(prior) if not isinstance(prior, Column) else prior)
    frozen = df.filter(fit).groupBy(*state).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("__fs"),
                                                F.sum(seen).alias("__fn"))
    out = small_join(both, frozen, state)
    past = ratio(eb("__s", "__n", strength, base), base)
    table = ratio(eb("__fs", "__fn", strength, mean_all), mean_all)
    value = F.coalesce(F.when(fit, past).otherwise(table), F.lit(1.0))
    bounded = F.least(F.greatest(value, F.lit(0.0)), F.lit(10.0))
    out = out.withColumn("leverage", bounded)
    return out.withColumn("leverage_class", F.when(F.col("leverage") <= 0.85, "low")
                          .when(F.col("leverage") <= 2.0, "medium").otherwise("high")
                          ).drop("__s", "__n", "__gs", "__gn", "__fs", "__fn")


def recovered_labels(df: DataFrame, entity: str, order: Order, n: str, rates: Sequence[str],
                     tolerance: float | None = None, hot_rows: int | None = None) -> DataFrame:
    """Labels implied by cumulative rates: the step of round(n * rate) to the next row.

    Known only when the count grows by one and the step is 0 or 1.
    """
    h = History(df, [entity], order, hot_rows).frames(
        0, lambda w: {"__next_n": F.lead(n, 1).over(w),
                      **{f"__next_{r}": F.lead(r, 1).over(w) for r in rates}}, ahead=1)
    made = {}
    for r in rates:
        now = F.coalesce(F.col(n) * F.col(r), F.lit(0.0))
        nxt = F.col("__next_n") * F.col(f"__next_{r}")
        raw = (F.rint(nxt) - F.rint(now)) if tolerance is None else nxt - now
        close = F.lit(True) if tolerance is None else F.abs(raw - F.rint(raw)) <= tolerance
        step = F.rint(raw).cast("int")
        made[f"label_{r}"] = F.when((F.col("__next_n") - F.col(n) == 1) & close
                                    & step.isin(0, 1), step)
    return h.df.withColumns(made).drop("__next_n", *[f"__next_{r}" for r in rates])


def segments(df: DataFrame, entity: str, order: Order, marks: Sequence[str],
             tolerance: float = 1e-9, hot_rows: int | None = None) -> DataFrame:
    """Number runs of rows whose marks do not change (NULL equals NULL)."""

    def changed(w: WindowSpec) -> Mapping[str, Column]:
        any_change = F.lit(False)
        for m in marks:
            before = F.lag(m, 1).over(w)
            same = (F.col(m).isNull() & before.isNull()) | F.coalesce(
                F.abs(F.col(m) - before) <= tolerance, F.lit(False))
            any_change = any_change | ~same
        return {"__new": F.when(F.lag(F.lit(1), 1).over(w).isNull() | any_change, 1)
                .otherwise(0)}

    h = History(df, [entity], order, hot_rows).frames(1, changed)
    out = h.running({"segment": F.col("__new")}, inclusive=True)
    return out.df.drop("__new")


def order_violations(df: DataFrame, entity: str, order: Order, value: Column,
                     hot_rows: int | None = None) -> DataFrame:
    """Flag rows whose value is below the maximum of earlier rows."""
    h = History(df, [entity], order, hot_rows).running_max("max_before", value)
    return h.df.withColumn("violation", F.coalesce(F.col("max_before") > value, F.lit(False))
                           .cast("int"))


def repeatability(df: DataFrame, entity: str, day: str, season: str,
                  values: Mapping[str, Column], min_n: int) -> DataFrame:
    """Population deviation to date and of the previous season from additive moments.

    Variance is clamped at zero; ``repeat`` is 1 / (1 + joint deviation); ``miss`` flags
    fewer than ``min_n`` rows of the first value.
    """
    sums = {}
    for n, e in values.items():
        sums[f"{n}_s"] = F.coalesce(e, F.lit(0.0))
        sums[f"{n}_q"] = F.coalesce(e * e, F.lit(0.0))
        sums[f"{n}_k"] = e.isNotNull().cast("long")
    out = daily_windows(df, entity, day, season, sums).join(
        previous_season(df, entity, season, sums), [entity, season], "left")
    made, first = {}, next(iter(values))
    for w in ("szn", "pszn"):
        joint = F.lit(0.0)
        for n in values:
            mean = ratio(f"{n}_s__{w}", f"{n}_k__{w}")
            raw = ratio(f"{n}_q__{w}", f"{n}_k__{w}") - mean * mean
            var = non_negative(raw)
            made[f"{n}_sd_{w}"] = F.sqrt(var)
            made[f"{n}_n_{w}"] = F.coalesce(F.col(f"{n}_k__{w}"), F.lit(0))
            joint = joint + var
        made[f"repeat_{w}"] = F.lit(1.0) / (F.lit(1.0) + F.sqrt(joint))
        made[f"miss_{w}"] = (F.coalesce(F.col(f"{first}_k__{w}"), F.lit(0)) < min_n).cast("int")
    return out.select(entity, season, day, *[c.alias(n) for n, c in made.items()])
