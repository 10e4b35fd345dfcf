"""Entity profiles from season cells: latest, recency-weighted and between-season values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foretally import session
from foretally.functions.rates import entropy, half_life, ratio, reliability
from foretally.operators.joins import sized, small_join, spread_to_cutoffs
from foretally.operators.ranks import exact_quantiles, metric_quantiles


def season_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows, mean and sample deviation of every metric per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def label_shares(df: DataFrame, keys: Sequence[str], label: str, levels: Sequence[str],
                 suffix: str = "_rate") -> DataFrame:
    """Share of each level per key over all rows of the key; missing levels are 0."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(*[
        (F.count_if(F.col(label) == v) / n).alias(f"{v}{suffix}") for v in levels])


def recency_profile(cells: DataFrame, keys: Sequence[str], season: str, columns: Sequence[str],
                    cutoffs: Sequence[int], life: float, n: str = "n",
                    evidence_cap: int | None = None) -> DataFrame:
    """Latest, recency-weighted and between-season values of season cells for every cutoff.

    Weights are half-life in age, times rows capped at ``evidence_cap`` when given; each
    column is averaged over the seasons where it is known.
    """
    past = spread_to_cutoffs(cells, season, cutoffs)
    w = half_life(F.col("cutoff") - F.col(season), life)
    if evidence_cap is not None:
        w = w * F.least(F.col(n), F.lit(evidence_cap))
    past = past.withColumn("__w", w)
    aggs = [F.count(F.lit(1)).alias("seasons"), F.sum(n).alias("total_n"),
            F.max(season).alias("last_season"), F.max_by(n, season).alias("last_n"),
            F.max_by(F.struct(*columns), season).alias("__latest")]
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col("__w"))
        aggs += [ratio(F.sum(known * F.col(c)), F.sum(known)).alias(f"recent_{c}"),
                 F.stddev_pop(c).alias(f"between_{c}")]
    out = past.groupBy(*keys, "cutoff").agg(*aggs)
    return out.withColumns({
        "season_gap": F.col("cutoff") - F.col("last_season"),
        **{f"latest_{c}": F.col(f"__latest.{c}") for c in columns}}).drop("__latest")


def eligible(df: DataFrame, entity: str, season: str, min_n: int) -> DataFrame:
    """Rows of entity seasons with enough volume, with the season size."""
    size = df.groupBy(entity, season).agg(F.count(F.lit(1)).alias("season_n"))
    return df.join(sized(size.filter(F.col("season_n") >= min_n)), [entity, season])


def metric_profiles(df: DataFrame, entity: str, season: str, metrics: Sequence[str], label: str,
                    levels: Sequence[str], cutoffs: Sequence[int], min_n: int,
                    life: float = 2.0) -> DataFrame:
    """Metric and class-mix profiles per entity for all cutoffs from one aggregation."""
    rows = eligible(df, entity, season, min_n)
    cells = season_metrics(rows, [entity, season], metrics).join(
        label_shares(rows, [entity, season], label, levels), [entity, season])
    columns = [f"{m}_{s}" for m in metrics for s in ("mean", "std")] + [f"{v}_rate" for v in levels]
    return recency_profile(cells, [entity], season, columns, cutoffs, life)


def group_profiles(df: DataFrame, entity: str, season: str, metrics: Sequence[str], label: str,
                   levels: Sequence[str], cutoffs: Sequence[int], min_season: int, min_group: int,
                   life: float = 2.0) -> DataFrame:
    """Metric profiles per class, one set of columns per class, with latest minus recent."""
    rows = eligible(df, entity, season, min_season)
    cells = season_metrics(rows, [entity, season, label], metrics).join(
        rows.groupBy(entity, season).agg(F.first("season_n").alias("season_n")), [entity, season])
    cells = cells.withColumn("share", F.col("n") / F.col("season_n")).filter(F.col("n") >= min_group)
    columns = [f"{m}_{s}" for m in metrics for s in ("mean", "std")] + ["share"]
    long = recency_profile(cells, [entity, label], season, columns, cutoffs, life)
    keep = ["total_n", "last_n", *[f"{h}_{c}" for c in columns for h in ("latest", "recent")]]
    wide = long.groupBy(entity, "cutoff").agg(*[
        F.max(F.when(F.col(label) == v, F.col(c))).alias(f"{v}_{c}") for v in levels for c in keep])
    made = {f"{v}_available": F.col(f"{v}_total_n").isNotNull().cast("int") for v in levels}
    for v in levels:
        for c in columns:
            made[f"{v}_shift_{c}"] = F.col(f"{v}_latest_{c}") - F.col(f"{v}_recent_{c}")
    for v in levels[1:]:
        for m in metrics:
            for h in ("latest", "recent"):
                made[f"{levels[0]}_minus_{v}_{h}_{m}"] = (
                    F.col(f"{levels[0]}_{h}_{m}_mean") - F.col(f"{v}_{h}_{m}_mean"))
    return wide.withColumns(made)


def mix_profile(df: DataFrame, entity: str, season: str, label: str, levels: Sequence[str],
                cutoffs: Sequence[int], min_n: int, life: float = 2.0) -> DataFrame:
    """Latest and recent class shares with entropy, concentration and largest share."""
    rows = eligible(df, entity, season, min_n)
    cells = label_shares(rows, [entity, season], label, levels).join(
        rows.groupBy(entity, season).agg(F.count(F.lit(1)).alias("n")), [entity, season])
    out = recency_profile(cells, [entity], season, [f"{v}_rate" for v in levels], cutoffs, life)
    made = {}
    for h in ("latest", "recent"):
        shares = [F.col(f"{h}_{v}_rate") for v in levels]
        squares = shares[0] * shares[0]
        for s in shares[1:]:
            squares = squares + s * s
        made[f"{h}_entropy"] = entropy(shares)
        made[f"{h}_hhi"] = squares
        made[f"{h}_max"] = F.greatest(*shares)
    return out.withColumns(made)


def rate_profile(df: DataFrame, entity: str, season: str, targets: Sequence[str],
                 cutoffs: Sequence[int], life: float = 2.0, evidence_cap: int = 1000,
                 rookie_n: int = 100) -> DataFrame:
    """Rates and residuals against the season's mean, latest and evidence-weighted."""
    sums = df.groupBy(entity, season).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(t).alias(f"{t}_rate") for t in targets])
    league = sums.groupBy(season).agg(*[
        ratio(F.sum(F.col(f"{t}_rate") * F.when(F.col(f"{t}_rate").isNotNull(), F.col("n"))),
              F.sum("n")).alias(f"__{t}") for t in targets])
    cells = sums.join(league, season).withColumns(
        {f"{t}_resid": F.col(f"{t}_rate") - F.col(f"__{t}") for t in targets})
    columns = [f"{t}_{s}" for t in targets for s in ("rate", "resid")]
    out = recency_profile(cells, [entity], season, columns, cutoffs, life, "n", evidence_cap)
    return out.withColumn("rookie", (F.col("last_n") <= rookie_n).cast("int"))


def split_residuals(df: DataFrame, entity: str, y: str, splits: Mapping[str, Column]) -> DataFrame:
    """Count and mean minus overall mean under several predicates, in one aggregation."""
    mean = df.agg(F.avg(y)).scalar()
    aggs = []
    for n, c in splits.items():
        aggs += [F.count_if(c).alias(f"{n}_n"), F.avg(F.when(c, F.col(y))).alias(f"__{n}")]
    out = df.groupBy(entity).agg(*aggs)
    return out.withColumns({f"{n}_resid": F.col(f"__{n}") - mean for n in splits}).drop(
        *[f"__{n}" for n in splits])


def robust_z(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], fit: Column) -> DataFrame:
    """(x - median) / (IQR / 1.349) per key, fitted on ``fit`` rows; unseen keys give NULL."""
    q = metric_quantiles(df.filter(fit), keys, metrics, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"__{m}_{c}")
        for m in metrics for c in ("q1", "q2", "q3")])
    rows = small_join(df, wide, keys)
    made = {}
    for m in metrics:
        spread = F.col(f"__{m}_q3") - F.col(f"__{m}_q1")
        scale = F.when(spread < 1e-6, F.lit(1e-6)).otherwise(spread) / 1.349
        made[f"{m}_rz"] = (F.col(m) - F.col(f"__{m}_q2")) / scale
    return rows.withColumns(made).drop(*[f"__{m}_{c}" for m in metrics for c in ("q1", "q2", "q3")])


def usage_residuals(df: DataFrame, entity: str, season: str, choice: str, context: Sequence[str],
                    strength: float) -> DataFrame:
    """P(choice | context) of an entity season shrunk to the league cell, minus the league."""
    cell = df.groupBy(entity, season, choice, *context).agg(F.count(F.lit(1)).alias("n"))
    total = cell.groupBy(entity, season, *context).agg(F.sum("n").alias("t"))
    league = cell.groupBy(season, choice, *context).agg(F.sum("n").alias("ln"))
    whole = league.groupBy(season, *context).agg(F.sum("ln").alias("lt"))
    rows = (cell.join(total, [entity, season, *context])
            .join(league.join(whole, [season, *context]), [season, choice, *context])
            .withColumn("lg", F.col("ln") / F.col("lt")))
    rate = (F.col("n") + strength * F.col("lg")) / (F.col("t") + strength)
    name = F.concat_ws("_", F.lit("u"), F.col(choice), *[F.col(c).cast("string") for c in context])
    return rows.select(entity, season, name.alias("feature"), (rate - F.col("lg")).alias("resid"))


def response_residuals(df: DataFrame, entity: str, season: str, choice: str, context: Sequence[str],
                       metrics: Sequence[str], strength: float) -> DataFrame:
    """Shrunken gap of cell means to the league's cell means, one row per metric and cell."""
    keys = [choice, *context]
    stats = []
    for m in metrics:
        stats += [F.sum(m).alias(f"s_{m}"), F.count(m).alias(f"k_{m}")]
    cell = df.groupBy(entity, season, *keys).agg(*stats)
    league = cell.groupBy(season, *keys).agg(*[
        ratio(F.sum(f"s_{m}"), F.sum(f"k_{m}")).alias(f"l_{m}") for m in metrics])
    rows = cell.join(league, [season, *keys])
    made = {m: reliability(f"k_{m}", strength) * (ratio(f"s_{m}", f"k_{m}") - F.col(f"l_{m}"))
            for m in metrics}
    wide = rows.select(entity, season, *keys, *[c.alias(m) for m, c in made.items()])
    long = wide.unpivot([entity, season, *keys], list(metrics), "metric", "resid")
    name = F.concat_ws("_", F.lit("p"), F.col("metric"), *[F.col(k).cast("string") for k in keys])
    return long.select(entity, season, name.alias("feature"), "resid").filter("resid IS NOT NULL")


def response_profile(df: DataFrame, entity: str, season: str, choice: str,
                     axes: Mapping[str, Sequence[str]], metrics: Sequence[str],
                     strength: float) -> DataFrame:
    """Usage and response residuals over several context axes, stacked in long form.

    What ``usage_residuals`` and ``response_residuals`` give for every axis, over cells that are dealt once, by entity
    and season; the league's cells come from one more pass. Context levels stand as an array of texts beside their axis.
    """
    used = [c for c in dict.fromkeys(c for context in axes.values() for c in context) if c not in (entity, season, choice)]
    names = ["n", *[f"{p}_{m}" for m in metrics for p in ("s", "k")]]
    counted = [F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{p}_{m}") for m in metrics for p, f in (("s", F.sum), ("k", F.count))]]
    axis = F.array(*[F.struct(F.lit(tag).alias("axis"), F.array(*[F.col(c).cast("string") for c in context]).cast("array<string>").alias("at"))
                     for tag, context in axes.items()])

    def by_axis(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        long = cells.withColumn("__x", F.explode(axis)).select(*keys, choice, *names, "__x.axis", "__x.at").filter(
            F.col(season).isNotNull() & ~F.exists("at", lambda v: v.isNull()))
        return long.groupBy(*keys, "axis", "at", choice).agg(*[F.sum(n).alias(n) for n in names])

    league = by_axis(df.groupBy(season, choice, *used).agg(*counted), [season])
    whole = F.sum("n").over(Window.partitionBy(season, "axis", "at"))
    league = sized(league.select(season, "axis", "at", choice, (F.col("n") / whole).alias("lg"),
                                 *[ratio(f"s_{m}", f"k_{m}").alias(f"l_{m}") for m in metrics]))
    cells = df.groupBy(entity, season, choice, *used).agg(*counted)
    tasks = session.tasks_for(df.sparkSession, df.count())
    mine = by_axis(cells.repartition(tasks, entity, season) if tasks > 1 else cells, [entity, season])
    rows = mine.withColumn("t", F.sum("n").over(Window.partitionBy(entity, season, "axis", "at"))).join(
        league, [season, "axis", "at", choice])
    rate = (F.col("n") + strength * F.col("lg")) / (F.col("t") + strength)
    level = F.col(choice).cast("string")
    # Rows without an entity have responses but no usage.
    usage = F.when(F.col(entity).isNotNull(), rate - F.col("lg"))
    made = [F.struct(F.concat_ws("_", F.lit("u"), level, "at").alias("feature"), usage.alias("resid"))]
    for m in metrics:
        gap = reliability(f"k_{m}", strength) * (ratio(f"s_{m}", f"k_{m}") - F.col(f"l_{m}"))
        made.append(F.struct(F.concat_ws("_", F.lit("p"), F.lit(m), level, "at").alias("feature"), gap.alias("resid")))
    out = rows.select(entity, season, "axis", F.explode(F.array(*made)).alias("__f")).select(
        entity, season, F.concat_ws(":", "axis", "__f.feature").alias("feature"), "__f.resid")
    return out.filter(F.col("resid").isNotNull()).groupBy(entity, season, "feature").agg(F.avg("resid").alias("resid"))


def opponent_profile(df: DataFrame, keys: Sequence[str], residual: str, strength: float,
                     by: Mapping[str, Sequence[str]]) -> DataFrame:
    """Shrunken residual overall and against each level of other codes, with log counts."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(residual).alias("__r")]
    for code, levels in by.items():
        for v in levels:
            hit = F.col(code) == v
            aggs += [F.count_if(hit).alias(f"__n_{code}_{v}"),
                     F.sum(F.when(hit, F.col(residual))).alias(f"__r_{code}_{v}")]
    out = df.groupBy(*keys).agg(*aggs)
    made = {"overall": F.col("__r") / (F.col("n") + strength)}
    for code, levels in by.items():
        for v in levels:
            k = F.col(f"__n_{code}_{v}")
            made[f"vs_{code}_{v}"] = F.when(k > 0, F.col(f"__r_{code}_{v}") / (k + strength))
            made[f"logn_{code}_{v}"] = F.when(k > 0, F.log1p(k.cast("double")))
    return out.select(*keys, "n", *[c.alias(n) for n, c in made.items()])


def outing_weights(df: DataFrame, entity: str, outing: str, inning: str, kind: Column,
                   kind_weight: float = 0.2, short: float = 0.5,
                   short_weight: float = 0.5) -> DataFrame:
    """Sample weight of rows in outings shorter than half the entity's usual for the role."""
    size = df.groupBy(entity, outing).agg(F.count(F.lit(1)).alias("outing_n"), F.min(inning).alias("__i"))
    size = size.withColumn("starts", (F.col("__i") == 1).cast("int")).drop("__i")
    usual = exact_quantiles(size, [entity, "starts"], "outing_n", {"usual": 0.5})
    table = size.join(usual, [entity, "starts"]).withColumn(
        "outing_ratio", F.col("outing_n") / F.greatest(F.col("usual"), F.lit(1.0)))
    rows = df.join(table, [entity, outing])
    w = F.when(kind, kind_weight).otherwise(1.0) * F.when(
        F.col("outing_ratio") < short, short_weight).otherwise(1.0)
    return rows.withColumn("weight", w)
