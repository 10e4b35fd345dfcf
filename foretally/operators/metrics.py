"""Scores, comparisons and diagnostics of probability forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foretally.functions.buckets import digitize
from foretally.functions.rates import clip, ratio
from foretally.operators.audit import auc_cells
from foretally.operators.joins import null_safe_join, sized, small_join
from foretally.operators.ordered import by_value
from foretally.operators.ranks import metric_quantiles

EPS = 1e-6


def brier_skill(rate: Column, brier: Column) -> Column:
    """1e5 * (1 - Brier / variance of the outcome)."""
    return F.lit(1e5) * (F.lit(1.0) - ratio(brier, rate * (F.lit(1.0) - rate)))


def skill(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Rows, outcome rate, Brier score and skill per group."""
    err = F.col(y) - F.col(p)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
                                F.avg(err * err).alias("brier"))
    return out.withColumn("bss", brier_skill(F.col("rate"), F.col("brier")))


def skill_variants(df: DataFrame, keys: Sequence[str], y: str, p: str,
                   eps: float = EPS) -> DataFrame:
    """Raw, floored, centred and normalised skill per group.

    Centring moves the mean forecast to the outcome rate and clips afterwards, so it needs
    the group means before the second pass.
    """
    work = df.withColumn("__p", clip(F.col(p), eps, 1.0 - eps))
    means = work.groupBy(*keys).agg(F.avg(y).alias("rate"), F.avg("__p").alias("pred_mean"))
    if keys:
        both = small_join(work, means, keys)
    else:
        both = work.withColumns({c: means.select(c).scalar() for c in ("rate", "pred_mean")})
    offset = F.col("pred_mean") - F.col("rate")
    moved = clip(F.col("__p") - offset, eps, 1.0 - eps)
    sq = lambda c: (c - F.col(y)) * (c - F.col(y))
    out = both.groupBy(*keys, "rate", "pred_mean").agg(
        F.count(F.lit(1)).alias("n"), F.avg(sq(F.col("__p"))).alias("brier"),
        F.avg(sq(moved)).alias("__centred"))
    null = F.col("rate") * (F.lit(1.0) - F.col("rate"))
    raw = brier_skill(F.col("rate"), F.col("brier"))
    return out.select(*keys, "n", "rate", "pred_mean", offset.alias("offset"), "brier",
                      ratio("brier", null).alias("normalized_brier"), raw.alias("bss_raw"),
                      F.greatest(raw, F.lit(0.0)).alias("bss_floored"),
                      brier_skill(F.col("rate"), F.col("__centred")).alias("bss_centered"),
                      (raw / 100.0).alias("bss_norm"))


def score_cells(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Counts and positives per distinct forecast."""
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, p).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def average_precision(cells: DataFrame, keys: Sequence[str], p: str,
                      hot_rows: int | None = None) -> DataFrame:
    """Sum of recall steps times precision, equal scores taken together."""
    work = cells.withColumn("__d", -F.col(p))
    run = by_value(work, keys, "__d", hot_rows).running(
        {"__tp": F.col("pos"), "__all": F.col("n")}, inclusive=True).df
    out = run.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("__tp") / F.col("__all")).alias("s"),
                                 F.sum("pos").alias("t"))
    return out.select(*keys, ratio("s", "t").alias("ap"))


def calibration_bins(cells: DataFrame, keys: Sequence[str], p: str, bins: int = 10) -> DataFrame:
    """Rows, mean forecast and outcome rate per equal-width bin."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    place = digitize(F.col(p), edges)
    return cells.withColumn("bin", place).groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), ratio(F.sum(F.col(p) * F.col("n")), F.sum("n")).alias("mean_p"),
        ratio(F.sum("pos"), F.sum("n")).alias("rate"))


def probability_scores(df: DataFrame, keys: Sequence[str], y: str, p: str,
                       eps: float = EPS, bins: int = 10) -> DataFrame:
    """AUC, average precision, log loss, Brier and calibration error per group."""
    work = df.withColumn("__p", clip(F.col(p), eps, 1.0 - eps))
    cells = score_cells(work, keys, y, "__p")
    q, n, k = F.col("__p"), F.col("n"), F.col("pos")
    base = cells.groupBy(*keys).agg(
        F.sum(n).alias("rows"), ratio(F.sum(k), F.sum(n)).alias("base"),
        (-ratio(F.sum(k * F.log(q) + (n - k) * F.log(1 - q)), F.sum(n))).alias("logloss"),
        ratio(F.sum(k * (1 - q) * (1 - q) + (n - k) * q * q), F.sum(n)).alias("brier"))
    b = calibration_bins(cells, keys, "__p", bins)
    ece = b.groupBy(*keys).agg(
        ratio(F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))), F.sum("n")).alias("ece"))
    auc, ap = auc_cells(cells, keys, "__p"), average_precision(cells, keys, "__p")
    if keys:
        out = base
        for t in (auc, ap, ece):
            out = null_safe_join(out, t, keys)
    else:
        out = base.withColumns({"auc": auc.scalar(), "ap": ap.scalar(), "ece": ece.scalar()})
    return out.select(*keys, F.col("rows").alias("n"), "base", "auc", "ap", "logloss", "brier", "ece")


def long_forecasts(df: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per forecast: ids, ``model``, ``p``."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(
        list(ids), list(models), "model", "p")


def wide_forecasts(long: DataFrame, keys: Sequence[str], models: Sequence[str],
                   prefix: str) -> DataFrame:
    """Pivot a long prediction table after proving (keys, model) unique."""
    # Rows of one key lie together, so counts and forecasts by key leave a task as one row for all models.
    mine = lambda m: F.coalesce(F.col("model") == m, F.lit(False))
    listed = F.coalesce(F.col("model").isin(list(models)), F.lit(False))
    counts = long.groupBy(*keys).agg(*[F.count_if(mine(m)).alias(f"__{i}") for i, m in enumerate(models)])
    others = long.filter(~listed).groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not counts.filter(F.greatest(F.lit(0), F.lit(0), *[F.col(f"__{i}") for i in range(len(models))]) > 1).isEmpty() or not others.isEmpty():
        raise ValueError("prediction table repeats a row and model")
    return long.groupBy(*keys).agg(*[F.first(F.when(mine(m), F.col("p")), ignorenulls=True).alias(f"{prefix}{m}") for m in models])


def segment_scores(df: DataFrame, y: str, models: Sequence[str], baseline: str,
                   season: str, segment: str) -> DataFrame:
    """Skill of every model by season for all rows and per segment, against a baseline."""
    long = long_forecasts(df, [y, season, segment], models)
    err = F.col(y) - F.col("p")
    g = long.groupingSets([[F.col("model"), F.col(season)],
                           [F.col("model"), F.col(season), F.col(segment)]],
                          F.col("model"), F.col(season), F.col(segment)).agg(
        F.grouping(segment).alias("__all"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
        F.avg(err * err).alias("brier"))
    named = g.select("model", season, F.when(F.col("__all") == 1, "ALL").otherwise(
        F.col(segment).cast("string")).alias("segment"), "n", "rate", "brier")
    scored = named.withColumn("bss", brier_skill(F.col("rate"), F.col("brier")))
    base = scored.filter(F.col("model") == baseline).select(
        season, "segment", F.col("bss").alias("__b"))
    total = scored.filter(F.col("segment") == "ALL").select("model", season, F.col("n").alias("__n"))
    out = scored.join(base, [season, "segment"]).join(total, ["model", season])
    return out.select("model", season, "segment", "n", "rate", "brier", "bss",
                      (F.col("bss") - F.col("__b")).alias("delta"), (F.col("n") / F.col("__n")).alias("share"))


def grouped_delta(df: DataFrame, dims: Sequence[str], y: str, before: str, after: str,
                  min_n: int) -> DataFrame:
    """Mean gap and Brier before and after a change, per level of several dimensions."""
    long = df.select(y, before, after, *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(
        [y, before, after], list(dims), "dim", "level")
    sq = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    return long.groupBy("dim", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
        F.avg(F.col(before) - F.col(y)).alias("gap"), F.avg(sq(before)).alias("brier_before"),
        F.avg(sq(after)).alias("brier_after")).filter(F.col("n") >= min_n).withColumn(
        "delta", F.col("brier_after") - F.col("brier_before"))


def gain_decomposition(df: DataFrame, group: str, y: str, before: str, after: str) -> DataFrame:
    """Each group's contribution to the total Brier change."""
    sq = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(sq(after) - sq(before)).alias("delta"))
    share = F.col("n") / g.agg(F.sum("n")).scalar()
    total = g.agg(F.sum(F.col("n") * F.col("delta"))).scalar()
    return g.select(group, "n", "delta", share.alias("share"), (share * F.col("delta")).alias("contribution"),
                    ratio(F.col("n") * F.col("delta"), total).alias("share_of_gain"))


def slice_residual(df: DataFrame, cell: str, y: str, p: str, parity: Column,
                   min_n: int) -> DataFrame:
    """Residual test of a slicing beyond the global offset: mean z^2, oracle and honest gain.

    Honest gain fits cell offsets on one half (``parity``) and applies them to the other;
    the gain of a single global offset is subtracted as the control.
    """
    halves = df.withColumn("__h", parity.cast("int"))
    base = df.agg(F.avg(F.col(y) - F.col(p))).scalar()
    c = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y) - F.col(p)).alias("r"),
                             F.avg(F.col(p) * (1 - F.col(p))).alias("v")).filter(F.col("n") >= min_n)
    resid = F.col("r") - base
    z = resid / F.sqrt(F.col("v") / F.col("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    null = df.agg(F.avg(y) * (1 - F.avg(y))).scalar()
    test = c.agg(F.count(F.lit(1)).alias("cells"), F.avg(z * z).alias("ratio"),
                 F.max(F.abs(z)).alias("max_abs_z"),
                 (F.sum(F.col("n") * resid * resid) / total).alias("__oracle"))

    def honest(keys: list[str]) -> Column:
        fit = halves.groupBy(*keys, "__h").agg(
            F.count(F.lit(1)).alias("__n"), F.avg(F.col(y) - F.col(p)).alias("__o")).filter(
            F.col("__n") >= max(min_n // 2, 1)).withColumn("__h", 1 - F.col("__h")).drop("__n")
        rows = small_join(halves, fit, [*keys, "__h"])
        new = clip(F.col(p) + F.coalesce("__o", F.lit(0.0)), EPS, 1 - EPS)
        old = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
        return rows.agg(F.avg(old - (new - F.col(y)) * (new - F.col(y)))).scalar()

    a, b = honest([cell]), honest([])
    scale = F.lit(1e5) / null
    return test.select("cells", "ratio", "max_abs_z", base.alias("global_resid"),
                       (F.col("__oracle") * scale).alias("oracle_bss"), (a * scale).alias("honest_slice"),
                       (b * scale).alias("honest_global"), ((a - b) * scale).alias("honest_net"))


def paired_test(df: DataFrame, keys: Sequence[str], y: str, before: str, after: str) -> DataFrame:
    """t statistic of the row-wise squared-error difference."""
    d = (F.col(before) - F.col(y)) * (F.col(before) - F.col(y)) - (
        F.col(after) - F.col(y)) * (F.col(after) - F.col(y))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_gain"),
                                F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    return out.select(*keys, "n", "mean_gain", se.alias("se"), ratio("mean_gain", se).alias("t"))


def noise_floor(long: DataFrame, season: str, seed: str, y: str, p: str) -> DataFrame:
    """Spread of the skill across seeds per season and the width it implies."""
    per = skill(long, [season, seed], y, p)
    return per.groupBy(season).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("bss").alias("mean"), F.stddev_samp("bss").alias("sd"),
        F.min("bss").alias("low"), F.max("bss").alias("high")).withColumns({
            "spread": F.col("high") - F.col("low"), "threshold": F.col("sd") * 1.5})


def threshold_table(df: DataFrame, fit: Column, y: str, p: str, low: float = 0.30,
                    high: float = 0.95, steps: int = 60) -> DataFrame:
    """F1-best quantile threshold on the fit rows, scored on the other rows.

    Thresholds are literals and their counts columns of one aggregation.
    """
    names = {f"t{i}": low + (high - low) * i / (steps - 1) for i in range(steps)}
    quant = metric_quantiles(df.filter(fit), [], [p], names)
    levels = sorted(set(quant.select(*names).first()))
    hit = {i: F.col(p) >= F.lit(t) for i, t in enumerate(levels)}
    wide = df.groupBy(fit.cast("int").alias("__fit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("all_pos"),
        *[F.sum(F.when(h, F.col(y)).otherwise(0)).alias(f"tp{i}") for i, h in hit.items()],
        *[F.count_if(h).alias(f"called{i}") for i, h in hit.items()])
    table = wide.select("__fit", "n", "all_pos", F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"called{i}").alias("called"))
        for i, t in enumerate(levels)])).alias("r")).select("__fit", "n", "all_pos", "r.*")
    tp = F.col("tp")
    f1 = ratio(tp * 2, F.col("called") + F.col("all_pos"))
    best = table.filter("__fit = 1").agg(F.max_by("threshold", F.struct(
        F.coalesce(f1, F.lit(0.0)), -F.col("threshold")))).scalar()
    hits = F.col("n") - F.col("called") - F.col("all_pos") + 2 * tp
    return table.filter(F.col("__fit") == 0).filter(F.col("threshold") == best).select(
        "threshold", f1.alias("f1"), ratio("tp", "called").alias("precision"),
        ratio("tp", "all_pos").alias("recall"), ratio(hits, "n").alias("accuracy"),
        ratio("called", "n").alias("predicted_rate"))


def correction_moments(df: DataFrame, keys: Sequence[str], y: str, p: str,
                       corrections: Sequence[str]) -> DataFrame:
    """Sufficient statistics of adding scaled corrections: E[ec_i], E[c_i c_j], variance."""
    e = F.col(p) - F.col(y)
    cols = [F.avg(e * F.col(c)).alias(f"ec_{c}") for c in corrections]
    cols += [F.avg(F.col(a) * F.col(b)).alias(f"cc_{a}_{b}")
             for i, a in enumerate(corrections) for b in corrections[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cols,
                                 (F.avg(y) * (1 - F.avg(y))).alias("null_var"))


def scale_grid(moments: DataFrame, correction: str, scales: Sequence[float]) -> DataFrame:
    """Brier change of every scale from the moments, without touching rows again."""
    s = F.col("scale")
    return moments.withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in scales]))).withColumn(
        "delta", s * 2 * F.col(f"ec_{correction}") + s * s * F.col(f"cc_{correction}_{correction}"))


def two_way_grid(df: DataFrame, segment: str, levels: tuple, y: str, base: str, other: str,
                 weights: Sequence[float]) -> DataFrame:
    """Brier change of moving two segments by separate weights towards another forecast.

    Both axes come from one row of moments, so the grid never touches the log.
    """
    e, d = F.col(base) - F.col(y), F.col(other) - F.col(base)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, v in enumerate(levels):
        hit = F.col(segment) == v
        aggs += [F.coalesce(F.sum(F.when(hit, c)), F.lit(0.0)).alias(f"{n}{i}")
                 for n, c in (("ec", e * d), ("cc", d * d))]
    steps = F.array(*[F.lit(float(w)) for w in weights])
    grid = df.agg(*aggs).withColumn("w0", F.explode(steps)).withColumn("w1", F.explode(steps))
    part = lambda i: (F.col(f"w{i}") * 2 * F.col(f"ec{i}") + F.col(f"w{i}") * F.col(f"w{i}") * F.col(f"cc{i}"))
    return grid.select("w0", "w1", ((part(0) + part(1)) / F.col("n")).alias("delta"))


def constrained_best(grid: DataFrame, key: str, season: str, value: str = "delta") -> DataFrame:
    """Best key by mean value among keys that improve in every season, else among all."""
    g = grid.groupBy(key).agg(F.avg(value).alias("objective"), F.max(value).alias("__worst"))
    ok = F.struct((F.col("__worst") >= 0).cast("int"), F.col("objective"), F.col(key))
    return g.agg(F.min_by(F.struct(F.col(key), F.col("objective"), (F.col("__worst") < 0).cast("int")
                                   .alias("all_improve")), ok).alias("r")).select("r.*")


def pair_weight(df: DataFrame, keys: Sequence[str], y: str, left: str, right: str) -> DataFrame:
    """Least-squares weight of the right forecast, kept in [0, 1]."""
    d = F.col(right) - F.col(left)
    return df.groupBy(*keys).agg(
        clip(F.coalesce(ratio(F.sum((F.col(y) - F.col(left)) * d), F.sum(d * d)), F.lit(0.0)), 0.0, 1.0)
        .alias("weight"))


def baselines(train: DataFrame, test: DataFrame, y: str, context: Sequence[str], entity: str,
              strength: float) -> DataFrame:
    """Scores of the league mean, a context lookup and an entity encoding on test rows."""
    league = train.agg(F.avg(y)).scalar()
    ctx = train.groupBy(*context).agg(F.avg(y).alias("__ctx"))
    ent = train.groupBy(entity).agg(
        ((F.sum(y) + strength * league) / (F.count(y) + strength)).alias("__ent"))
    rows = test.join(sized(ctx), list(context), "left").join(sized(ent), entity, "left")
    named = rows.select(F.col(y).alias("y"), league.alias("league_mean"),
                        F.coalesce("__ctx", league).alias("context_only"),
                        F.coalesce("__ent", league).alias("entity_encoding"))
    return probability_scores(long_forecasts(named, ["y"], ["league_mean", "context_only", "entity_encoding"]),
                              ["model"], "y", "p")


def averaged(long: DataFrame, row: Sequence[str], member: str, p: str,
             weights: Mapping[str, float], space: str = "prob") -> DataFrame:
    """Mean over seeds inside each member, then a weighted mean over members."""
    from foretally.functions.rates import logit, sigmoid
    per = long.groupBy(*row, member).agg(F.avg(p).alias("__p"))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(member)]
    x = logit(F.col("__p")) if space == "logit" else F.col("__p")
    out = per.groupBy(*row).agg(ratio(F.sum(w * x), F.sum(w)).alias("__x"))
    final = sigmoid(F.col("__x")) if space == "logit" else F.col("__x")
    return out.select(*row, final.alias("p"))


def bucket_blend(df: DataFrame, bucket: str, weights: DataFrame, a: str, b: str,
                 default: float = 0.5) -> DataFrame:
    """q = w*a + (1-w)*b with the weight of the row's bucket."""
    w = F.coalesce("weight", F.lit(default))
    return small_join(df, weights, [bucket]).withColumn(
        "blend", w * F.col(a) + (1 - w) * F.col(b)).drop("weight")
