"""Calibration and season offsets. Iterative fits repeat one small aggregation per step.

Rows are reduced to counts per distinct (group, logit) once and kept through the shared
checkpoint folder; each Newton step then aggregates those cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from foretally import session
from foretally.functions.rates import clip, half_life, logit, ratio, reliability, sigmoid
from foretally.operators.joins import null_safe_join, sized, small_join, spread_to_cutoffs
from foretally.operators.ordered import History
from foretally.operators.ranks import metric_quantiles
from foretally.roles import Order

EPS = 1e-6


def logit_cells(df: DataFrame, keys: Sequence[str], y: str, z: Column) -> DataFrame:
    """Counts and positives per group and distinct logit."""
    return df.withColumn("z", z).groupBy(*keys, "z").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).cast("double").alias("k"))


def with_params(cells: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (small_join(cells, params, keys) if keys
            else cells.withColumns({c: params.select(c).scalar() for c in params.columns}))


def newton(cells: DataFrame, keys: Sequence[str], start: Mapping[str, float],
           moments: Mapping[str, Column], update: Mapping[str, Column], steps: int = 100,
           tolerance: float = 1e-10, within: float = 15.0) -> DataFrame:
    """Iterate per-group parameters: aggregate ``moments`` over cells, then ``update``.

    Parameters stay a DataFrame with one row per group; each step cuts its lineage. Parameters are held
    within ``within``; a group of which one passes half of that has no finite optimum (one outcome only, or
    outcomes that the logit separates) and is waited for no longer. Raises ArithmeticError where ``steps``
    leave any other group moving.
    """
    cells = session.checkpoint(cells)
    params = session.checkpoint(cells.groupBy(*keys).agg(F.lit(1)).select(
        *keys, *[F.lit(float(v)).alias(n) for n, v in start.items()]))
    groups = params.count()
    # A generous width per row decides whether the parameters still fit a broadcast.
    most = session.broadcast_bytes(cells.sparkSession) // (64 + 256 * len(keys) + 16 * len(start))
    for _ in range(steps):
        table = F.broadcast(params) if groups <= most else params
        joined = null_safe_join(cells, table, keys) if keys else with_params(cells, params, keys)
        sums = joined.groupBy(*keys, *start).agg(*[F.sum(m).alias(n) for n, m in moments.items()])
        held = {n: F.when(F.isnan(update[n]), F.col(n)).otherwise(clip(update[n], -within, within)) for n in start}
        moved = session.checkpoint(sums.select(
            *keys, *[held[n].alias(n) for n in start],
            F.when(F.greatest(*[F.abs(held[n]) for n in start], F.lit(0.0)) < within / 2,
                   F.greatest(*[F.abs(held[n] - F.col(n)) for n in start], F.lit(0.0))).otherwise(0.0).alias("__move")))
        params = moved.drop("__move")
        if (moved.agg(F.max("__move")).first()[0] or 0.0) < tolerance:
            return params
    raise ArithmeticError(f"parameters still move after {steps} steps")


def platt(df: DataFrame, keys: Sequence[str], y: str, z: Column) -> DataFrame:
    """Slope a and intercept b of logit(y) on z per group, bounded after the fit."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    q = sigmoid(a * F.col("z") + b)
    w, r = n * q * (1 - q), F.col("k") - n * q
    zz, z1, one = F.col("hzz") + EPS, F.col("hz"), F.col("h") + EPS
    det = zz * one - z1 * z1
    fit = newton(
        logit_cells(df, keys, y, z), keys, {"a": 1.0, "b": 0.0},
        {"gz": F.col("z") * r, "g": r, "hzz": F.col("z") * F.col("z") * w, "hz": F.col("z") * w, "h": w},
        {"a": a + (one * F.col("gz") - z1 * F.col("g")) / det,
         "b": b + (zz * F.col("g") - z1 * F.col("gz")) / det})
    return fit.select(*keys, clip("a", 0.3, 2.0).alias("a"), clip("b", -0.6, 0.6).alias("b"))


def shrunk_platt(df: DataFrame, keys: Sequence[str], y: str, z: Column, weight: float,
                 min_n: int) -> DataFrame:
    """Segment slope and intercept moved by ``weight`` away from (1, 0), relative to global."""
    whole = platt(df, [], y, z)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    local = platt(null_safe_join(df, sized(big), keys, "left_semi"), keys, y, z)
    ag, bg = whole.select("a").scalar(), whole.select("b").scalar()
    return local.select(*keys, (F.lit(1.0) + weight * (F.col("a") - ag)).alias("a"),
                        (F.lit(weight) * (F.col("b") - bg)).alias("b"))


def fixed_slope(df: DataFrame, keys: Sequence[str], y: str, z: Column,
                centre: Column | float) -> DataFrame:
    """Logistic slope per group with the intercept held at ``centre``."""
    c = F.lit(centre) if not isinstance(centre, Column) else centre
    x = F.col("z")
    cells = logit_cells(df, keys, y, z - c).withColumn("c", c)
    q = sigmoid(F.col("b") * x + F.col("c"))
    return newton(cells, keys, {"b": 1.0},
                  {"g": x * (F.col("k") - F.col("n") * q), "h": x * x * F.col("n") * q * (1 - q)},
                  {"b": F.col("b") + F.coalesce(ratio("g", F.when(F.col("h") > 1e-9, F.col("h"))), F.lit(0.0))})


def slope_grid(df: DataFrame, keys: Sequence[str], y: str, z: Column, centre: Column | float,
               grid: Sequence[float], min_n: int) -> DataFrame:
    """Brier-best slope over a grid per group; grid values are columns of one aggregation."""
    c = F.lit(centre) if not isinstance(centre, Column) else centre
    cells = logit_cells(df, keys, y, z - c).withColumn("c", c)
    sums = []
    for i, a in enumerate(grid):
        q = sigmoid(F.lit(float(a)) * F.col("z") + F.col("c"))
        sums.append(F.sum(F.col("n") * q * q - 2 * q * F.col("k") + F.col("k")).alias(f"b{i}"))
    wide = cells.groupBy(*keys).agg(F.sum("n").alias("n"), *sums).filter(F.col("n") >= min_n)
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"b{i}") / F.col("n"), 12).alias("brier"),
                                          F.lit(float(a)).alias("a")) for i, a in enumerate(grid)]))
    return wide.select(*keys, F.col("n").cast("long").alias("n"), best.alias("r")).select(
        *keys, "n", F.col("r.a").alias("slope"), F.col("r.brier").alias("brier"))


def brier_offsets(df: DataFrame, keys: Sequence[str], y: str, p: str, ridge: float = 0.0,
                  centre: Column | float = 0.0) -> DataFrame:
    """Logit offset per group that minimises Brier plus ridge * mean (offset - centre)^2.

    The penalty of a group is spread over its cells in proportion to their rows.
    """
    total, groups = df.agg(F.count(F.lit(1))).scalar(), df.select(*keys).distinct().agg(
        F.count(F.lit(1))).scalar() if keys else F.lit(1)
    cells = logit_cells(df, keys, y, logit(F.col(p)))
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("__s"))
    cells = with_params(cells, sizes, keys).withColumns(
        {"t": total, "m": groups, "part": F.col("n") / F.col("__s"),
         "o": F.lit(centre) if not isinstance(centre, Column) else centre}).drop("__s")
    q = sigmoid(F.col("z") + F.col("c"))
    d = q * (1 - q)
    n, k = F.col("n"), F.col("k")
    grad = 2 * d * (n * q - k) / F.col("t")
    hess = 2 * (n * d * d + (n * q - k) * d * (1 - 2 * q)) / F.col("t")
    pull = F.lit(2.0 * ridge) / F.col("m")
    out = newton(cells, keys, {"c": 0.0},
                 {"g": grad + pull * (F.col("c") - F.col("o")) * F.col("part"),
                  "h": hess + pull * F.col("part")},
                 {"c": F.col("c") - F.col("g") / F.col("h")})
    return out.select(*keys, clip("c", -1.0, 1.0).alias("offset"))


def shift_to_mean(df: DataFrame, p: str, target: Column | float) -> DataFrame:
    """Logit shift that brings the mean forecast to ``target``."""
    t = F.lit(float(target)) if not isinstance(target, Column) else target
    cells = df.withColumn("z", logit(F.col(p))).groupBy("z").agg(
        F.count(F.lit(1)).cast("double").alias("n")).withColumn("t", t)
    q = sigmoid(F.col("z") + F.col("shift"))
    return newton(cells, [], {"shift": 0.0},
                  {"g": F.col("n") * (F.col("t") - q), "h": F.col("n") * q * (1 - q)},
                  {"shift": F.col("shift") + F.col("g") / F.col("h")})


def fit_logistic(df: DataFrame, y: str, features: Mapping[str, Column], steps: int = 100) -> dict[str, float]:
    """Maximum-likelihood weights of a few features and an intercept (k-by-k on the driver).

    Raises ArithmeticError where ``steps`` do not converge.
    """
    names = list(features)
    cells = session.checkpoint(df.select(y, *[c.alias(n) for n, c in features.items()]).groupBy(
        *names).agg(F.count(F.lit(1)).cast("double").alias("n__"), F.sum(y).cast("double").alias("k__")))
    cols = [F.col(n) for n in names] + [F.lit(1.0)]
    w = np.zeros(len(cols))
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * c for b, c in zip(w[1:], cols[1:])), F.lit(float(w[0])) * cols[0])
        q = sigmoid(eta)
        h = F.col("n__") * q * (1 - q)
        row = cells.agg(*[F.sum(c * (F.col("k__") - F.col("n__") * q)) for c in cols],
                        *[F.sum(a * b * h) for i, a in enumerate(cols) for b in cols[i:]]).first()
        m = len(cols)
        g, hess = np.array(row[:m]), np.zeros((m, m))
        hess[np.triu_indices(m)] = row[m:]
        hess = hess + np.triu(hess, 1).T
        step = np.linalg.lstsq(hess, g, rcond=None)[0]
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise ArithmeticError(f"weights still move after {steps} steps")
    return dict(zip([*names, "intercept"], (float(x) for x in w)))


def beta_features(p: str) -> dict[str, Column]:
    q = clip(F.col(p), EPS, 1 - EPS)
    return {"log_p": F.log(q), "log_q": F.log(1 - q)}


def apply_logistic(weights: Mapping[str, float], features: Mapping[str, Column]) -> Column:
    eta = F.lit(weights["intercept"])
    for n, c in features.items():
        eta = eta + F.lit(weights[n]) * c
    return sigmoid(eta)


def _pool(stack: list, block: tuple) -> None:
    """Put a block (lowest and highest value, weight, weighted label) on a stack whose means rise."""
    low, high, weight, total = block
    while stack and stack[-1][3] * weight >= total * stack[-1][2]:
        before = stack.pop()
        low, weight, total = before[0], weight + before[2], total + before[3]
    stack.append((low, high, weight, total))


def _pooled(blocks: DataFrame) -> DataFrame:
    """Blocks of each partition's sorted blocks, pooled until their means rise."""
    def run(batches):
        stack: list = []
        for batch in batches:
            for block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _pool(stack, block)
        if stack:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*stack)], names=["low", "high", "weight", "total"])

    return blocks.mapInArrow(run, "low double, high double, weight double, total double")


#: Ranges of values that one step merges into one.
MERGED = 16


@dataclass(frozen=True)
class Monotone:
    """A rising map: values at the ends of the pooled blocks, straight lines between, level outside."""

    at: tuple[float, ...]
    value: tuple[float, ...]


def isotonic(df: DataFrame, y: str, p: str) -> Monotone:
    """Fit a rising map by least squares on counted forecasts.

    Pooling is associative: ranges of values are pooled by themselves, then neighbouring ranges' blocks
    together, ``MERGED`` at a time. Only the blocks left in the end reach the driver. Rows without label or
    forecast are left out; without any, ValueError is raised.
    """
    q = F.col(p).cast("double")
    cells = df.filter(q.isNotNull() & F.col(y).isNotNull()).groupBy(q.alias("low")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(y).cast("double")).alias("total"))
    blocks = cells.select("low", F.col("low").alias("high"), "weight", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = session.checkpoint(_pooled(blocks.repartitionByRange(parts, "low").sortWithinPartitions("low")))
        if parts == 1:
            break
        parts = -(-parts // MERGED)
    at, value = [], []
    for r in blocks.orderBy("low").collect():
        for end in dict.fromkeys((r["low"], r["high"])):
            at.append(end)
            value.append(r["total"] / r["weight"])
    if not at:
        raise ValueError("no rows to fit")
    return Monotone(tuple(at), tuple(value))


def apply_isotonic(model: Monotone, df: DataFrame, p: str) -> DataFrame:
    """Add ``calibrated``: the map at ``p``, NULL where that is."""
    q = F.col(p).cast("double")
    ends, values = F.lit(list(model.at)), F.lit(list(model.value))
    split = Bucketizer(splits=[float("-inf"), *model.at, float("inf")], inputCol="__p", outputCol="__at", handleInvalid="keep")
    out = split.transform(df.withColumn("__p", F.coalesce(q, F.lit(0.0))))
    k = F.col("__at").cast("int")
    x0, x1, v0, v1 = (F.element_at(c, i) for c in (ends, values) for i in (k, k + 1))
    inner = v0 + (v1 - v0) * (q - x0) / (x1 - x0)
    told = F.when(k == 0, F.lit(model.value[0])).when(k >= len(model.at), F.lit(model.value[-1])).otherwise(inner)
    return out.withColumn("calibrated", F.when(q.isNotNull(), told)).drop("__p", "__at")


def walk_forward_isotonic(df: DataFrame, season: str, y: str, p: str,
                          seasons: Sequence[int]) -> DataFrame:
    """Calibrate each season with a monotone map fitted on the seasons before it."""
    out = None
    for s in seasons:
        model = isotonic(df.filter(F.col(season) < s), y, p)
        part = apply_isotonic(model, df.filter(F.col(season) == s), p)
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward_rate(df: DataFrame, season: str, y: str, p: str,
                      seasons: Sequence[int]) -> DataFrame:
    """Move each season's forecasts by the earlier seasons' mean logit gap."""
    cells = df.groupBy(season).agg(F.sum(y).alias("k"), F.sum(p).alias("sp"), F.count(F.lit(1)).alias("n"))
    past = spread_to_cutoffs(cells, season, seasons).groupBy("cutoff").agg(
        (logit(F.sum("k") / F.sum("n")) - logit(F.sum("sp") / F.sum("n"))).alias("__gap"))
    rows = df.join(sized(past.withColumnRenamed("cutoff", season)), season)
    return rows.withColumn("calibrated", sigmoid(logit(F.col(p)) + F.col("__gap"))).drop("__gap")


def rate_forecasts(df: DataFrame, season: str, y: str, targets: Sequence[int]) -> DataFrame:
    """Next-season rate by several rules fitted on earlier seasons only."""
    rates = df.groupBy(season).agg(F.avg(y).alias("rate"))
    past = spread_to_cutoffs(rates, season, targets)
    by = Window.partitionBy("cutoff").orderBy(season)
    back = Window.partitionBy("cutoff").orderBy(F.desc(season))
    x = F.col(season).cast("double")
    work = past.withColumns({"d": F.col("rate") - F.lag("rate", 1).over(by),
                             "r": F.row_number().over(back)})
    recent = F.col("r") <= 3
    lin = lambda c: (F.regr_slope(F.when(c, F.col("rate")), F.when(c, x)),
                     F.regr_intercept(F.when(c, F.col("rate")), F.when(c, x)))
    s1, i1 = lin(F.lit(True))
    s3, i3 = lin(recent)
    w = F.pow(F.lit(0.7), F.col("r") - 1)
    g = work.groupBy("cutoff").agg(
        F.max_by("rate", season).alias("last"), F.min_by("rate", season).alias("first"),
        F.max(season).alias("s1"), F.min(season).alias("s0"), F.count(F.lit(1)).alias("k"),
        s1.alias("b1"), i1.alias("a1"), s3.alias("b3"), i3.alias("a3"),
        ratio(F.sum(w * F.col("d")), F.sum(F.when(F.col("d").isNotNull(), w))).alias("trend"),
        F.median("d").alias("mid"))
    t = F.col("cutoff").cast("double")
    drift = F.col("last") + ratio(F.col("last") - F.col("first"), F.col("s1") - F.col("s0")) * (t - F.col("s1"))
    two = F.col("k") >= 2
    return g.select("cutoff", "last", F.when(two, clip(drift, 0.01, 0.99)).otherwise(F.col("last")).alias("drift"),
                    F.when(two, F.col("a1") + F.col("b1") * t).alias("linear"),
                    F.when(two, F.col("a3") + F.col("b3") * t).alias("linear3"),
                    F.when(two, F.col("last") + F.col("trend")).alias("weighted"),
                    F.when(two, F.col("last") + F.col("mid")).alias("median_step"))


def season_offsets(df: DataFrame, keys: Sequence[str], season: str, y: str,
                   targets: Sequence[int], damping: float = 1.0) -> DataFrame:
    """Damped gap of the linear logit extrapolation to the last season, per segment."""
    cells = df.groupBy(*keys, season).agg(F.avg(y).alias("rate"), F.count(F.lit(1)).alias("n"))
    past = spread_to_cutoffs(cells, season, targets)
    usable = (F.col("rate") > 0.001) & (F.col("rate") < 0.999)
    z = F.when(usable, F.log(F.col("rate") / (1 - F.col("rate"))))
    x = F.when(usable, F.col(season).cast("double"))
    g = past.groupBy(*keys, "cutoff").agg(
        F.sum("n").alias("n"), F.count(z).alias("k"), F.regr_slope(z, x).alias("b"),
        F.regr_intercept(z, x).alias("a"), F.max_by(z, x).alias("zl"))
    off = F.lit(damping) * (F.col("a") + F.col("b") * F.col("cutoff") - F.col("zl"))
    return g.select(*keys, "cutoff", "n", F.when(F.col("k") >= 2, off).alias("offset"))


def shrunk_offsets(df: DataFrame, keys: Sequence[str], season: str, y: str,
                   targets: Sequence[int], strength: float, min_n: int = 200,
                   damping: float = 1.0) -> DataFrame:
    """Segment offset pulled towards the global one; small segments use the global offset."""
    whole = season_offsets(df, [], season, y, targets, damping).select(
        "cutoff", F.col("offset").alias("__g"))
    local = season_offsets(df, keys, season, y, targets, damping).join(whole, "cutoff")
    lam = reliability("n", strength)
    use = F.col("offset").isNotNull() & (F.col("n") >= min_n)
    return local.select(*keys, "cutoff", "n", F.when(
        use, F.col("__g") + lam * (F.col("offset") - F.col("__g"))).otherwise(F.col("__g")).alias("offset"),
        F.col("__g").alias("global_offset"))


def additive_offsets(df: DataFrame, axes: Sequence[Sequence[str]], season: str, y: str,
                     target: int, strength: float) -> DataFrame:
    """Rows of the target season with global offset plus the shrunk excess of every axis."""
    rows = df.filter(F.col(season) == target)
    whole = season_offsets(df, [], season, y, [target]).select("offset").scalar()
    total = whole
    for i, keys in enumerate(axes):
        t = shrunk_offsets(df, keys, season, y, [target], strength).select(
            *keys, (F.col("offset") - F.col("global_offset")).alias(f"__x{i}"))
        rows = small_join(rows, t, keys)
        total = total + F.coalesce(F.col(f"__x{i}"), F.lit(0.0))
    return rows.withColumn("offset", total).drop(*[f"__x{i}" for i in range(len(axes))])


def matched(df: DataFrame, source: str, reference: str) -> DataFrame:
    """Source forecasts moved to the reference's mean, or mean and spread, in two spaces."""
    work = df.withColumns({"__a": logit(F.col(source)), "__b": logit(F.col(reference))})
    m = {n: work.agg(e).scalar() for n, e in {
        "ps": F.avg(source), "pr": F.avg(reference), "ls": F.avg("__a"), "lr": F.avg("__b"),
        "ss": F.stddev_pop(source), "sr": F.stddev_pop(reference),
        "ts": F.stddev_pop("__a"), "tr": F.stddev_pop("__b")}.items()}
    s, a = F.col(source), F.col("__a")
    wide = lambda sd: F.greatest(sd, F.lit(EPS))
    keep = lambda c: clip(c, EPS, 1 - EPS)
    return work.withColumns({
        "prob_mean": keep(s - m["ps"] + m["pr"]),
        "prob_mean_std": keep((s - m["ps"]) * (m["sr"] / wide(m["ss"])) + m["pr"]),
        "logit_mean": keep(sigmoid(a - m["ls"] + m["lr"])),
        "logit_mean_std": keep(sigmoid((a - m["ls"]) * (m["tr"] / wide(m["ts"])) + m["lr"]))}).drop("__a", "__b")


def quantile_matched(df: DataFrame, row: Sequence[str], source: str, reference: str,
                     hot_rows: int | None = None) -> DataFrame:
    """k-th smallest source takes the k-th smallest reference value (ties by row key)."""
    order = lambda c: Order((c, *row))
    left = History(df, [], order(source), hot_rows).position("__k").df
    right = History(df.select(reference, *row), [], order(reference), hot_rows).position("__k").df
    return left.join(right.select("__k", F.col(reference).alias("quantile_match")), "__k").drop("__k")


def sharpened(df: DataFrame, p: str, target: Column | float, scale: float, cap: float) -> DataFrame:
    """Scale logits around their mean, centre on the target, and cap the distance to it."""
    t = F.lit(float(target)) if not isinstance(target, Column) else target
    z = logit(F.col(p))
    mean = df.agg(F.avg(z)).scalar()
    q = sigmoid((z - mean) * F.lit(scale) + F.log(t / (1 - t)))
    return df.withColumn("sharpened", clip(q, F.greatest(F.lit(EPS), t - cap), F.least(F.lit(1 - EPS), t + cap)))


def capped(df: DataFrame, p: str, mode: str, level: float, low_volume: Column | None = None) -> DataFrame:
    """Cap extreme forecasts: at fixed levels, at quantiles, or only for low-volume rows."""
    if mode == "abs":
        return df.withColumn("capped", clip(F.col(p), level, 1 - level))
    if mode == "quantile":
        b = metric_quantiles(df, [], [p], {"lo": level, "hi": 1 - level})
        return df.withColumn("capped", clip(F.col(p), b.select("lo").scalar(), b.select("hi").scalar()))
    if mode == "conditional":
        return df.withColumn("capped", F.when(low_volume, clip(F.col(p), level, 1 - level)).otherwise(F.col(p)))
    raise ValueError(mode)


def past_rate_gaps(df: DataFrame, season: str, y: str, rate: str, fallback: float,
                   bound: float = 0.5) -> DataFrame:
    """Per season: last and recency-weighted earlier rates, and the bounded logit gap of the
    last season's outcome to its mean cumulative rate."""
    cells = df.groupBy(season).agg(F.avg(y).alias("actual"), F.avg(rate).alias("asof"))
    seasons = cells.select(season)
    last = cells.select((F.col(season) + 1).alias(season), F.col("actual").alias("prior_last"),
                        (logit(F.col("actual")) - logit(F.col("asof"))).alias("__gap"))
    top = cells.agg(F.max(season)).scalar()
    pairs = cells.filter(F.col(season) < top).withColumn(
        "target", F.explode(F.sequence(F.col(season) + 1, top)))
    age = F.col("target") - F.col(season)
    mean = lambda life: ratio(F.sum(half_life(age, life) * F.col("actual")), F.sum(half_life(age, life)))
    ewm = pairs.groupBy(F.col("target").alias(season)).agg(mean(1.0).alias("prior_ewm1"), mean(2.0).alias("prior_ewm2"))
    out = seasons.join(last, season, "left").join(ewm, season, "left")
    f = F.lit(fallback)
    return out.select(season, F.coalesce("prior_last", f).alias("prior_last"),
                      F.coalesce("prior_ewm1", f).alias("prior_ewm1"),
                      F.coalesce("prior_ewm2", f).alias("prior_ewm2"),
                      clip(F.coalesce("__gap", F.lit(0.0)), -bound, bound).alias("gap_logit"))


def recalibrated_rates(df: DataFrame, gaps: DataFrame, season: str, rate: str, n: str) -> DataFrame:
    """Cumulative rates moved by the past gap and smoothed to past season priors."""
    rows = df.join(sized(gaps), season, "left")
    raw = F.coalesce(F.col(rate), F.col("prior_last"))
    count = F.greatest(F.col(n), F.lit(0)).cast("double")
    adjusted = sigmoid(logit(raw) + F.col("gap_logit"))
    smooth = lambda base, prior, k: (base * count + F.col(prior) * F.lit(k)) / (count + F.lit(k))
    return rows.withColumns({
        "adjusted_last": adjusted, "dynamic_last_200": smooth(raw, "prior_last", 200.0),
        "dynamic_ewm1_200": smooth(raw, "prior_ewm1", 200.0), "dynamic_ewm2_200": smooth(raw, "prior_ewm2", 200.0),
        "dynamic_last_150": smooth(raw, "prior_last", 150.0), "dynamic_last_250": smooth(raw, "prior_last", 250.0),
        "adjusted_smoothed_200": smooth(adjusted, "prior_last", 200.0)})


def ridge_correction(train: DataFrame, valid: DataFrame, features: Sequence[str], residual: str,
                     alpha: float, bound: float = 0.05) -> DataFrame:
    """Ridge on imputed, standardised features without intercept; bounded on the valid rows."""
    if len(features) > 20:
        raise ValueError("at most 20 features")
    med = metric_quantiles(train, [], features, {"m": 0.5}).select("metric", "m")
    medians = {r["metric"]: r["m"] for r in med.collect()}
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in features}
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(fill[c]).alias(f"m_{c}") for c in features],
                    *[F.stddev_pop(fill[c]).alias(f"s_{c}") for c in features]).first()
    scaled = {c: (fill[c] - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = train.agg(*[F.sum(scaled[a] * scaled[b]) for a, b in pairs],
                     *[F.sum(scaled[c] * F.col(residual)) for c in features]).first()
    k = len(features)
    gram = np.zeros((k, k))
    for (a, b), v in zip(pairs, sums):
        i, j = list(features).index(a), list(features).index(b)
        gram[i, j] = gram[j, i] = v
    w = np.linalg.solve(gram + alpha * np.eye(k), np.array(sums[len(pairs):]))
    fit = F.lit(0.0)
    for c, x in zip(features, w):
        fit = fit + F.lit(float(x)) * scaled[c]
    return valid.withColumn("correction", clip(fit, -bound, bound))


def apply_corrections(rows: DataFrame, base: str, types: Sequence[tuple[DataFrame, Sequence[str], str, str]],
                      pair: DataFrame, pair_keys: Sequence[str], context: DataFrame,
                      context_keys: Sequence[str], applies: Column,
                      experts: Sequence[tuple[str, str, float]], scale: float = 1.0) -> DataFrame:
    """Frozen lookups on scored rows: types, pair correction, context correction, experts.

    ``types`` are (table, keys, column, fallback label); ``pair`` and ``context`` carry a
    ``correction``; ``experts`` are (local, reference, weight) forecasts. Pair corrections go
    to every row, context and expert corrections only where ``applies``.
    """
    out = rows
    for table, keys, column, label in types:
        out = out.join(sized(table), list(keys), "left").withColumn(column, F.coalesce(F.col(column), F.lit(label)))
    out = out.join(sized(pair.withColumnRenamed("correction", "__pair")), list(pair_keys), "left")
    out = small_join(out, context.withColumnRenamed("correction", "__ctx"), context_keys)
    extra = F.coalesce("__ctx", F.lit(0.0))
    for local, ref, w in experts:
        extra = extra + F.lit(w) * (F.col(local) - F.col(ref))
    total = F.coalesce("__pair", F.lit(0.0)) * F.lit(scale) + F.when(applies, extra).otherwise(F.lit(0.0))
    return out.withColumn("corrected", clip(F.col(base) + total, EPS, 1 - EPS)).drop("__pair", "__ctx")
