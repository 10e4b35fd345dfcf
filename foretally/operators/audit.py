"""Data profiles, integrity checks, drift and association tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foretally import session
from foretally.functions.rates import ratio, wilson
from foretally.operators.joins import null_safe_join
from foretally.operators.ordered import History, by_value, value_cells
from foretally.operators.ranks import long_metrics, metric_quantiles
from foretally.roles import Order


def target_by(df: DataFrame, groups: Sequence[Sequence[str]], y: str) -> DataFrame:
    """Outcome table of several groupings at once: n, hits, rate, lift in points, 95 % CI.

    All groupings come from one pass over the rows with grouping sets; NULL levels stay.
    """
    cols = list(dict.fromkeys(c for g in groups for c in g))
    sets = [[F.col(c) for c in g] for g in groups]
    names = [F.lit(",".join(g)) for g in groups]
    base = df.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits"),
        *[F.grouping(c).alias(f"__g_{c}") for c in cols])
    which = None
    for g, name in zip(groups, names):
        hit = F.lit(True)
        for c in cols:
            hit = hit & (F.col(f"__g_{c}") == (0 if c in g else 1))
        which = F.when(hit, name) if which is None else which.when(hit, name)
    level = F.concat_ws("|", *[
        F.when(F.col(f"__g_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
        for c in cols])
    overall = df.agg(F.avg(y)).scalar()
    low, high = wilson("hits", "n")
    return base.select(which.alias("grouping"), level.alias("level"), "n", "hits",
                       ratio("hits", "n").alias("rate"),
                       ((ratio("hits", "n") - overall) * 100.0).alias("lift_pp"),
                       low.alias("ci_low"), high.alias("ci_high"))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
PROFILE_PROBS = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, distinct, samples and numeric summary.

    Samples are the three smallest distinct values as text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "text")
    values = texts.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    distinct = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("missing_n"),
        F.count("text").alias("nunique"))
    first = Window.partitionBy("column").orderBy("text")
    samples = (values.filter(F.col("text").isNotNull()).withColumn("r", F.row_number().over(first))
               .filter("r <= 3").groupBy("column").agg(
                   F.concat_ws(" | ", F.array_sort(F.collect_list("text"))).alias("samples")))
    distinct = distinct.join(samples, "column", "left")
    dtype = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t.simpleString()))])
    out = distinct.withColumn("dtype", dtype[F.col("column")]).withColumn(
        "missing_pct", F.col("missing_n") / F.col("rows") * 100.0)
    numeric = [c for c, t in types.items() if isinstance(t, NUMERIC)]
    moments = long_metrics(df, [], numeric).groupBy("metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))
    quant = metric_quantiles(df, [], numeric, PROFILE_PROBS)
    return (out.join(moments.withColumnRenamed("metric", "column"), "column", "left")
            .join(quant.withColumnRenamed("metric", "column"), "column", "left"))


AUDIT_PROBS = {"q0000": 0.0, "q0001": 0.001, "q0010": 0.01, "q0250": 0.25, "q0500": 0.5,
               "q0750": 0.75, "q0990": 0.99, "q0999": 0.999, "q1000": 1.0}


def numeric_audit(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                  probs: Mapping[str, float] = AUDIT_PROBS) -> DataFrame:
    """Quantiles, missing/non-finite/zero/negative rates and share outside 3 IQR."""
    long = long_metrics(df, keys, metrics)
    v = F.col("value")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    finite = df.withColumns({m: F.when(~F.isnan(m) & (F.abs(F.col(m).cast("double")) != float("inf")), F.col(m))
                             for m in metrics})
    clean = long.withColumn("value", F.when(~odd, v))
    cells = clean.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    basics = long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("missing_rate"),
        F.avg(F.coalesce(odd, F.lit(False)).cast("double")).alias("nonfinite_rate"),
        F.avg(F.coalesce(v == 0, F.lit(False)).cast("double")).alias("zero_rate"),
        F.avg(F.coalesce(v < 0, F.lit(False)).cast("double")).alias("negative_rate"))
    quant = metric_quantiles(finite, keys, metrics, probs)
    spread = (F.col("q0750") - F.col("q0250")) * 3.0
    outside = (null_safe_join(cells.filter(F.col("value").isNotNull()), quant, [*keys, "metric"])
               .withColumn("out", ((F.col("value") < F.col("q0250") - spread)
                                   | (F.col("value") > F.col("q0750") + spread)).cast("int"))
               .groupBy(*keys, "metric").agg(
                   ratio(F.sum(F.col("out") * F.col("n")), F.sum("n")).alias("outside_3iqr_rate")))
    return null_safe_join(null_safe_join(basics, quant, [*keys, "metric"]), outside, [*keys, "metric"])


def transfer_clip_audit(df: DataFrame, season: str, metrics: Sequence[str],
                        targets: Sequence[int], low: float = 0.001,
                        high: float = 0.999) -> DataFrame:
    """Bounds learned from earlier seasons, applied to each target season.

    The log is read once, into counts of values by season; all targets' ranks come from one running total.
    """
    cells = session.checkpoint(long_metrics(df, [season], metrics).filter("value IS NOT NULL").groupBy(
        season, "metric", "value").agg(F.count(F.lit(1)).alias("n")))
    past = cells.groupBy("metric", "value").agg(*[
        F.coalesce(F.sum(F.when(F.col(season) < int(t), F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, t in enumerate(targets)])
    counts = [f"n_{i}" for i in range(len(targets))]
    ranked = by_value(past, ["metric"], "value").running(
        {f"below_{n}": F.col(n) for n in counts}, totals={f"t_{n}": F.col(n) for n in counts}).df
    picks, each = [], []
    for n, target in zip(counts, targets):
        below, total, bounds = F.col(f"below_{n}"), F.col(f"t_{n}"), []
        at = lambda k: F.max(F.when((below <= k) & (k < below + F.col(n)), F.col("value")))
        for name, p in (("past_low", low), ("past_high", high)):
            spot = F.lit(p) * (total - 1)
            a, b = F.floor(spot), F.least(F.floor(spot) + 1, total - 1)
            picks += [at(a).alias(f"{name}_a_{n}"), at(b).alias(f"{name}_b_{n}"), F.max(spot - a).alias(f"{name}_f_{n}")]
            bounds.append((F.col(f"{name}_a_{n}") + F.col(f"{name}_f_{n}")
                           * (F.col(f"{name}_b_{n}") - F.col(f"{name}_a_{n}"))).alias(name))
        picks.append(F.max(total).alias(f"all_{n}"))
        each.append(F.struct(F.lit(int(target)).alias("target"), *bounds, F.col(f"all_{n}").alias("past")))
    limits = F.broadcast(ranked.groupBy("metric").agg(*picks).select("metric", F.explode(F.array(*each)).alias("e")).select(
        "metric", "e.*").filter("past > 0").drop("past"))
    now = cells.withColumnRenamed(season, "target").join(limits, ["target", "metric"])
    under, over = F.col("value") < F.col("past_low"), F.col("value") > F.col("past_high")
    share = lambda c: ratio(F.sum(c.cast("int") * F.col("n")), F.sum("n"))
    return now.groupBy("target", "metric", "past_low", "past_high").agg(
        share(under).alias("below_rate"), share(over).alias("above_rate"),
        share(under | over).alias("clipped_rate"))


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Named predicates that should never hold, counted in one aggregation."""
    out = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return (out.unpivot(["__n"], list(checks), "check", "violations")
            .select("check", "violations", F.col("__n").alias("denominator"),
                    (F.lit(100.0) * F.col("violations")
                     / F.greatest(F.col("__n"), F.lit(1))).alias("violation_pct")))


@dataclass(frozen=True)
class Rule:
    """A rule that rows must keep: its kind and the kind's arguments (column names, bounds, patterns)."""

    name: str
    kind: str
    args: tuple = ()


def _sum(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def _missing_or(c: Column) -> Column:
    """Whether a condition is broken, a NULL one counted as broken."""
    return ~F.coalesce(c, F.lit(False))


#: When a row breaks a rule of a kind.
ROW_RULES: Mapping[str, Callable[..., Column]] = {
    "known": lambda c: F.col(c).isNull(),
    "matches": lambda c, pattern: _missing_or(F.col(c).rlike(pattern)),
    "one_of": lambda c, *values: _missing_or(F.col(c).isin(*values)),
    "within": lambda c, low, high: _missing_or(F.col(c).between(low, high)),
    "within_if_known": lambda c, low, high: ~F.col(c).between(low, high),
    "not_below": lambda c, low: F.col(c) < low,
    "same": lambda a, b: ~F.col(a).eqNullSafe(F.col(b)),
    "adds_up": lambda total, parts, by=0.0: F.abs(F.col(total) - _sum(parts)) > by,
    "adds_up_to": lambda parts, value, by=0.0: F.abs(_sum(parts) - value) > by,
    "is_expression": lambda c, text: ~F.col(c).eqNullSafe(F.expr(text)),
    "null_iff_zero": lambda c, n: F.col(c).isNull() != (F.coalesce(F.col(n), F.lit(0)) == 0),
}
#: Kinds that look at all rows of a key: how many rows of a key break the rule.
KEY_RULES = ("unique", "agree")


def rule_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(check, kind, violations, denominator) of every rule: rows are read by one aggregation for all row kinds
    and one over the keys of all key kinds.

    ``unique`` (key columns) counts all rows of keys that occur more than once; ``agree`` (column, key columns)
    those of keys on which the column has several values, NULL apart.
    """
    by_row = [r for r in rules if r.kind not in KEY_RULES]
    by_key = [r for r in rules if r.kind in KEY_RULES]
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.count_if(F.coalesce(ROW_RULES[r.kind](*r.args), F.lit(False))).alias(r.name) for r in by_row])
    if by_key:
        keys = {r.name: tuple(r.args[0] if r.kind == "unique" else r.args[1]) for r in by_key}
        every = sorted({c for k in keys.values() for c in k})
        values = sorted({r.args[0] for r in by_key if r.kind == "agree"})
        cube = df.groupingSets([[F.col(c) for c in k] for k in dict.fromkeys(keys.values())], *every).agg(
            F.count(F.lit(1)).alias("__rows"), F.grouping_id(*every).alias("__set"),
            *[f(F.col(v)).alias(f"__{e}_{v}") for v in values for e, f in (("low", F.min), ("high", F.max))])
        number = {k: sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in k) for k in keys.values()}
        broken = {r.name: (F.col("__rows") > 1 if r.kind == "unique"
                           else F.coalesce(F.col(f"__low_{r.args[0]}") != F.col(f"__high_{r.args[0]}"), F.lit(False))) for r in by_key}
        told = cube.agg(*[F.coalesce(F.sum(F.when((F.col("__set") == number[keys[r.name]]) & broken[r.name], F.col("__rows"))), F.lit(0)).alias(r.name)
                          for r in by_key])
        counts = counts.crossJoin(told)
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    return counts.unpivot(["__n"], [r.name for r in rules], "check", "violations").select(
        "check", kinds[F.col("check")].alias("kind"), "violations", F.col("__n").alias("denominator"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first of each key."""
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def status_report(counts: DataFrame, warn: Sequence[str] = ()) -> DataFrame:
    """PASS/WARN/FAIL per check from a violations table, failures first."""
    bad = F.col("violations") > 0
    status = (F.when(bad & F.col("check").isin(list(warn)), "WARN").when(bad, "FAIL")
              .otherwise("PASS"))
    rank = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)
    return (counts.withColumn("status", status).withColumn("severity_rank", rank)
            .orderBy("severity_rank", "check"))


def assert_no_failures(report: DataFrame) -> None:
    """Raise with the failed checks of a report (at most one row per named check)."""
    failed = report.filter(F.col("status") == "FAIL").select("check", "violations").collect()
    if failed:
        raise AssertionError("; ".join(f"{r['check']}={r['violations']}" for r in failed))


def raw_audit(df: DataFrame, key: Sequence[str], game: str, required: Sequence[str]) -> DataFrame:
    """Rows, columns, games, repeated keys and missing values in long form."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(game).alias("games"), *[
        F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required])
    wide = total.withColumn("columns", F.lit(len(df.columns)).cast("long")).withColumn(
        "duplicate_keys", duplicate_rows(df, key).scalar())
    return wide.unpivot([], ["rows", "columns", "games", "duplicate_keys",
                             *[f"missing_{c}" for c in required]], "check", "value")


def duplicate_features(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Rows that repeat the feature values of another row, and groups with both targets."""
    groups = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")).filter("n > 1")
    total = df.agg(F.count(F.lit(1))).scalar()
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.count_if(F.col("lo") != F.col("hi")).alias("conflicting_groups")).withColumn(
        "duplicate_pct", F.col("duplicate_rows") / total * 100.0)


def missingness_effect(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Outcome rate where a column is missing against where it is present."""
    long = df.select(y, *[F.col(c).isNull().cast("int").alias(c) for c in cols]).unpivot(
        [y], list(cols), "column", "miss")
    m = F.col("miss") == 1
    out = long.groupBy("column").agg(
        F.sum("miss").alias("missing_n"), F.avg("miss").alias("__p"),
        F.avg(F.when(m, F.col(y))).alias("rate_missing"),
        F.avg(F.when(~m, F.col(y))).alias("rate_present")).filter("missing_n > 0")
    return out.select("column", "missing_n", (F.col("__p") * 100.0).alias("missing_pct"),
                      "rate_missing", "rate_present",
                      ((F.col("rate_missing") - F.col("rate_present")) * 100.0).alias("gap_pp"))


def entity_profile(df: DataFrame, entity: str, y: str, season: str, label: str) -> DataFrame:
    """Volume, rate with interval, active seasons and the smallest most frequent label."""
    cells = df.groupBy(entity, season, label).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k"))
    base = cells.groupBy(entity).agg(
        F.sum("n").alias("n"), F.sum("k").alias("hits"), F.min(season).alias("first_season"),
        F.max(season).alias("last_season"), F.countDistinct(season).alias("n_seasons"))
    modes = (cells.filter(F.col(label).isNotNull()).groupBy(entity, label)
             .agg(F.sum("n").alias("__m")).groupBy(entity)
             .agg(F.min_by(F.col(label), F.struct(-F.col("__m"), F.col(label))).alias("mode_label")))
    low, high = wilson("hits", "n")
    return base.join(modes, entity, "left").withColumns(
        {"rate": ratio("hits", "n"), "ci_low": low, "ci_high": high})


def concentration(profile: DataFrame, entity: str, n: str, tops: Sequence[int],
                  floors: Sequence[int]) -> DataFrame:
    """Volume share of the largest entities and number of entities above floors."""
    total = profile.agg(F.sum(n)).scalar()
    ordered = [F.col(n).desc(), F.col(entity)]
    parts = [profile.orderBy(*ordered).limit(k).agg(F.sum(n).alias("v")).select(
        F.lit(f"top_{k}_share_pct").alias("measure"), (F.col("v") / total * 100.0).alias("value"))
        for k in tops]
    above = profile.agg(*[F.count_if(F.col(n) >= f).cast("double").alias(f"n_ge_{f}") for f in floors])
    parts.append(above.unpivot([], [f"n_ge_{f}" for f in floors], "measure", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concentration_curve(profile: DataFrame, entity: str, n: str,
                        hot_rows: int | None = None) -> DataFrame:
    """Entities by volume with cumulative share of rows and of entities."""
    total, count = profile.agg(F.sum(n)).scalar(), profile.agg(F.count(F.lit(1))).scalar()
    h = History(profile.withColumn("__d", -F.col(n)), [],
                Order(("__d", entity)), hot_rows)
    out = h.running({"__cum": F.col(n), "__r": F.lit(1).cast("long")}, inclusive=True).df
    return out.select(entity, n, F.col("__r").alias("rank"), (F.col("__cum") / total).alias("cum_share"),
                      (F.col("__r") / count).alias("entity_share"))


def season_overlap(df: DataFrame, season: str, entity: str) -> DataFrame:
    """Retention, newcomers and Jaccard of the entity sets of consecutive seasons."""
    pairs = df.select(season, entity).distinct()
    size = pairs.groupBy(season).agg(F.count(F.lit(1)).alias("size"))
    nxt = pairs.withColumn(season, F.col(season) - 1)
    both = pairs.join(nxt, [season, entity], "left_semi").groupBy(season).agg(
        F.count(F.lit(1)).alias("overlap"))
    after = size.select((F.col(season) - 1).alias(season), F.col("size").alias("to_size"))
    out = size.join(after, season).join(both, season, "left").na.fill(0, ["overlap"])
    o, a, b = F.col("overlap"), F.col("size"), F.col("to_size")
    return out.select(F.col(season).alias("from_season"), (F.col(season) + 1).alias("to_season"),
                      a.alias("from_n"), b.alias("to_n"), o.alias("overlap"),
                      (o / a * 100.0).alias("retained_pct"), ((b - o) / b * 100.0).alias("new_pct"),
                      (o / (a + b - o)).alias("jaccard"))


def consecutive_pairs(cells: DataFrame, entity: str, season: str,
                      values: Sequence[str]) -> DataFrame:
    """Season cells of an entity next to its following season."""
    nxt = cells.select(entity, (F.col(season) - 1).alias(season),
                       *[F.col(v).alias(f"{v}_next") for v in values])
    return cells.join(nxt, [entity, season])


def within_drift(df: DataFrame, entity: str, season: str, y: str, min_n: int) -> DataFrame:
    """Change of entity rates between consecutive seasons, both with enough rows."""
    cells = df.groupBy(entity, season).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    pairs = consecutive_pairs(cells, entity, season, ["n", "rate"])
    stable = pairs.filter((F.col("n") >= min_n) & (F.col("n_next") >= min_n)).withColumn(
        "delta", F.col("rate_next") - F.col("rate"))
    median = metric_quantiles(stable, [season], ["delta"], {"median": 0.5}).select(
        season, (F.col("median") * 100.0).alias("median_delta_pp"))
    overlap = pairs.groupBy(season).agg(F.count(F.lit(1)).alias("overlap"))
    sums = stable.groupBy(season).agg(
        F.count(F.lit(1)).alias("stable_n"),
        (ratio(F.sum(F.col("delta") * F.col("n_next")), F.sum("n_next")) * 100.0).alias("weighted_delta_pp"),
        (F.avg((F.col("delta") < 0).cast("double")) * 100.0).alias("declining_pct"))
    return overlap.join(sums, season, "left").join(median, season, "left")


def order_diagnostics(df: DataFrame, entity: str, order: Order, n: str, rate: str, y: str,
                      hot_rows: int | None = None) -> DataFrame:
    """How well cumulative counts and rates follow row order and reveal the next target."""
    h = History(df, [entity], order, hot_rows).position("__pos").frames(
        1, lambda w: {"__step": F.col(n) - F.lag(n, 1).over(w), "__next_n": F.lead(n, 1).over(w),
                      "__next_rate": F.lead(rate, 1).over(w)}, ahead=1)
    seen = F.coalesce(F.col(rate), F.lit(0.0)) * F.col(n)
    implied = F.col("__next_rate") * F.col("__next_n") - seen
    known = (F.col("__next_n") == F.col(n) + 1) & F.col("__next_rate").isNotNull()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100.0
    return h.df.agg(
        F.count(F.lit(1)).alias("n"), share(F.col(n) == F.col("__pos")).alias("count_matches_pct"),
        share(F.col("__step") == 1).alias("step_one_pct"),
        F.count_if(F.col("__step") < 0).alias("negative_steps"),
        F.count_if(F.col("__step") > 1).alias("large_steps"),
        share(known).alias("recoverable_pct"),
        (F.avg(F.when(known, (F.rint(implied) == F.col(y)).cast("double"))) * 100.0).alias("recovered_pct"))


def sequence_gaps(df: DataFrame, keys: Sequence[str], seq: str,
                  hot_rows: int | None = None) -> DataFrame:
    """Number of places where the sequence jumps by more than one."""
    h = History(df, list(keys), Order((seq,)), hot_rows).frames(
        1, lambda w: {"__step": F.col(seq) - F.lag(seq, 1).over(w)})
    return h.df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(seq).alias("seq_min"), F.max(seq).alias("seq_max"),
        F.count_if(F.col("__step") > 1).alias("gaps"))


def auc_cells(cells: DataFrame, keys: Sequence[str], value: str,
              hot_rows: int | None = None) -> DataFrame:
    """Mann-Whitney AUC per group from value cells holding ``n`` and positive ``pos``."""
    work = cells.withColumn("__neg", F.col("n") - F.col("pos"))
    ranked = by_value(work, keys, value, hot_rows).running({"__below": F.col("__neg")}).df
    out = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("__below") + F.col("__neg") / F.lit(2.0))).alias("u"),
        F.sum("pos").alias("p"), F.sum("__neg").alias("q"))
    return out.select(*keys, ratio("u", F.col("p") * F.col("q")).alias("auc"))


def univariate_signal(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """AUC, correlation, class means and standardised difference per numeric feature."""
    long = long_metrics(df, [y], features)
    one, v = F.col(y) == 1, F.col("value")
    stats = long.groupBy("metric").agg(
        F.count(v).alias("n"), (F.avg(v.isNull().cast("double")) * 100.0).alias("missing_pct"),
        F.avg(F.when(~one, v)).alias("mean_0"), F.avg(F.when(one, v)).alias("mean_1"),
        F.var_samp(F.when(~one, v)).alias("__v0"), F.var_samp(F.when(one, v)).alias("__v1"),
        F.corr(v, F.when(v.isNotNull(), F.col(y)).cast("double")).alias("pearson"))
    pooled = F.sqrt((F.col("__v0") + F.col("__v1")) / 2.0)
    cells = value_cells(long, ["metric"], "value", {"pos": F.sum(y)})
    auc = auc_cells(cells, ["metric"], "value")
    out = stats.join(auc, "metric", "left")
    return out.select("metric", "n", "missing_pct", "mean_0", "mean_1",
                      ratio(F.col("mean_1") - F.col("mean_0"), pooled).alias("smd"), "pearson", "auc",
                      F.abs(F.col("auc") - 0.5).alias("auc_strength"))


def categorical_association(df: DataFrame, features: Sequence[str], y: str,
                            min_n: int = 100) -> DataFrame:
    """Spread of level rates per categorical feature."""
    long = df.select(y, *[F.col(c).cast("string").alias(c) for c in features]).unpivot(
        [y], list(features), "feature", "level")
    levels = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    base = df.agg(F.avg(y)).scalar()
    big = F.when(F.col("n") >= min_n, F.col("rate"))
    gap = F.col("rate") - base
    out = levels.groupBy("feature").agg(
        F.count(F.lit(1)).alias("levels"), F.count(big).alias("big_levels"),
        ratio(F.sum(gap * gap * F.col("n")), F.sum("n")).alias("__v"),
        F.min(big).alias("min_rate"), F.max(big).alias("max_rate"))
    return out.select("feature", "levels", "big_levels", (F.sqrt("__v") * 100.0).alias("sd_pp"),
                      "min_rate", "max_rate",
                      ((F.col("max_rate") - F.col("min_rate")) * 100.0).alias("range_pp"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are known.

    One aggregation: pairs are columns of the aggregate, not rows.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")),
                           F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{a}~{b}")
                    for a, b in pairs])
    return wide.unpivot([], [f"{a}~{b}" for a, b in pairs], "pair", "corr")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks of ties."""
    from foretally.operators.ranks import average_rank
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(known, [], a, "ra"), [], b, "rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def partial_correlation(df: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """Correlation of two columns with the control's linear part removed."""
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(control).isNotNull())
    r = known.agg(F.corr(a, b).alias("r"), F.corr(a, control).alias("p"), F.corr(b, control).alias("q"))
    p, q = F.col("p"), F.col("q")
    return r.select("r", ratio(F.col("r") - p * q, F.sqrt((1 - p * p) * (1 - q * q))).alias("partial"))


def js_divergence(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  features: Sequence[str]) -> DataFrame:
    """Jensen-Shannon divergence in bits of categorical marginals of two logs, per key."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in features]).unpivot(
            list(keys), list(features), "feature", "level")
        n = long.groupBy(*keys, "feature", "level").agg(F.count(F.lit(1)).alias("n"))
        t = n.groupBy(*keys, "feature").agg(F.sum("n").alias("t"))
        return n.join(t, [*keys, "feature"]).select(
            *keys, "feature", F.coalesce("level", F.lit("\x00")).alias("level"),
            (F.col("n") / F.col("t")).alias(name))

    both = shares(left, "p").join(shares(right, "q"), [*keys, "feature", "level"], "full_outer")
    common = both.groupBy(*keys, "feature").agg(
        F.sum(_js_term()).alias("js_bits"), F.count("p").alias("left_levels"),
        F.count("q").alias("right_levels"))
    return common.filter("left_levels > 0 AND right_levels > 0")


def _js_term() -> Column:
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (p + q) / 2.0
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2.0


def concordance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact agreement of two label columns where both are known, and missing shares."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both).alias("n_both"),
        (F.avg(F.when(both, (F.col(a) == F.col(b)).cast("double"))) * 100.0).alias("match_pct"),
        (F.avg(F.col(a).isNull().cast("double")) * 100.0).alias("a_missing_pct"),
        (F.avg(F.col(b).isNull().cast("double")) * 100.0).alias("b_missing_pct"))


def crosstab_audit(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """Counts of one code by another, levels given so the pivot needs no extra scan."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1))).na.fill(0)


def coverage_by_threshold(base: DataFrame, target: DataFrame, entity: str,
                          thresholds: Sequence[int]) -> DataFrame:
    """Share of target rows owned by entities with at least T base rows."""
    n = base.groupBy(entity).agg(F.count(F.lit(1)).alias("base_n"))
    t = target.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"))
    both = t.join(n, entity, "left").na.fill(0, ["base_n"])
    wide = both.withColumn("threshold", F.explode(F.array(*[F.lit(int(x)) for x in thresholds])))
    hit = F.col("base_n") >= F.col("threshold")
    return wide.groupBy("threshold").agg(
        F.count_if(hit).alias("entities"), F.sum(F.when(hit, F.col("rows")).otherwise(0)).alias("covered"),
        F.sum("rows").alias("rows")).withColumn("share", F.col("covered") / F.col("rows"))


def phi_by_slice(df: DataFrame, slices: Sequence[str], a: str, b: str, min_n: int) -> DataFrame:
    """Dependence of two 0/1 labels per slice level: phi and lift of joint occurrence."""
    long = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        a, b, *[F.col(s).cast("string").alias(s) for s in slices]).unpivot(
        [a, b], list(slices), "slice", "level")
    g = long.groupBy("slice", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("pa"), F.avg(b).alias("pb"),
        F.avg(F.col(a) * F.col(b)).alias("pab")).filter(F.col("n") >= min_n)
    pa, pb, pab = F.col("pa"), F.col("pb"), F.col("pab")
    return g.select("slice", "level", "n", ratio(pab - pa * pb, F.sqrt(
        pa * (1 - pa) * pb * (1 - pb))).alias("phi"), ratio(pab, pa * pb).alias("lift"))


def residual_variance(df: DataFrame, entity: str, y: str, p: str, min_n: int) -> DataFrame:
    """Observed spread of entity mean residuals against the spread noise alone would give."""
    c = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y) - F.col(p)).alias("r"),
        F.avg(F.col(p) * (1 - F.col(p))).alias("v")).filter(F.col("n") >= min_n)
    n = F.col("n")
    out = c.agg(F.count(F.lit(1)).alias("entities"), F.sum(n).alias("rows"),
                ratio(F.sum(n * F.col("r") * F.col("r")), F.sum(n)).alias("observed"),
                ratio(F.sum(F.col("v")), F.sum(n)).alias("expected"))
    rate = df.agg(F.avg(y)).scalar()
    excess = F.col("observed") - F.col("expected")
    return out.select("entities", "rows", "observed", "expected", excess.alias("excess"),
                      (F.lit(1e5) * excess / (rate * (1 - rate))).alias("ceiling"))


def rate_profile(df: DataFrame, keys: Sequence[str], y: str, tries: str, hits: str,
                 metrics: Sequence[str], day: str | None = None, game: str | None = None,
                 min_n: int = 1, share_of: Sequence[str] | None = None) -> DataFrame:
    """Counts, safe ratios and averages per key, with optional dates, games and usage share."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"), F.sum(tries).alias("tries"),
            F.sum(hits).alias("hits"), *[F.avg(m).alias(f"avg_{m}") for m in metrics]]
    if day:
        aggs += [F.min(day).alias("first_day"), F.max(day).alias("last_day")]
    if game:
        aggs.append(F.countDistinct(game).alias("games"))
    out = df.groupBy(*keys).agg(*aggs).withColumn("hit_rate", ratio("hits", "tries"))
    if share_of is not None:
        if share_of:
            totals = out.groupBy(*share_of).agg(F.sum("n").alias("__t"))
            out = null_safe_join(out, totals, share_of)
        else:
            out = out.withColumn("__t", df.agg(F.count(F.lit(1))).scalar())
        out = out.withColumn("usage", F.col("n") / F.col("__t")).drop("__t")
    return out.filter(F.col("n") >= min_n)


def composition(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Share of every label inside its key."""
    cells = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*keys)
    return cells.withColumn("share", F.col("n") / F.sum("n").over(total))


def mean_matrix(df: DataFrame, row: str, col: str, levels: Sequence, y: str) -> DataFrame:
    """Mean outcome by two codes, one column per level."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.avg(y))


def outing_calibration(df: DataFrame, keys: Sequence[str], y: str, p: str, history: str,
                       min_n: int) -> DataFrame:
    """Actual, expected and historical mean per outing with enough rows."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual"), F.avg(p).alias("expected"),
        F.avg(history).alias("history")).filter(F.col("n") >= min_n)


def agreement(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """MAE, RMSE, R2 and correlation of two columns."""
    e = F.col(actual) - F.col(expected)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - ratio(F.avg(e * e), F.var_pop(actual))).alias("r2"),
        F.corr(actual, expected).alias("corr"))


def failure_structure(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """How two failure labels split the failures, and how far from independent they are."""
    fail, ia, ib = F.col(y) == 0, F.col(a) == 1, F.col(b) == 1
    rest = fail & ~ia & ~ib
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fail).alias("failures"),
        F.count_if(ia & ~fail).alias("a_and_success"), F.count_if(ia & ib).alias("both"),
        F.count_if(rest).alias("rest"), F.count_if((ia | ib | rest) != fail).alias("mismatch"),
        (share(ia) * share(ib)).alias("independent"), share(ia & ib).alias("joint"),
        F.corr(ia.cast("double"), ib.cast("double")).alias("phi"),
        ((1 - share(ia)) * (1 - share(ib)) - share(rest) - share(~fail)).alias("formula_error"))


def reconcile(counts: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loaded rows against a manifest per key; either side may be missing."""
    a = counts.select(*keys, F.col("n").alias("loaded"))
    b = manifest.select(*keys, F.col("n").alias("expected"))
    out = a.join(b, list(keys), "full_outer").na.fill(0, ["loaded", "expected"])
    return out.withColumn("matches", (F.col("loaded") == F.col("expected")).cast("int"))


def repeatability_index(df: DataFrame, season: str, entity: str, weights: Mapping[str, float],
                        min_n: int) -> DataFrame:
    """Deviation of each input, its descending percentile inside the season, and their mean."""
    from foretally.operators.ranks import average_rank
    known = df
    for c in weights:
        known = known.filter(F.col(c).isNotNull())
    table = known.groupBy(season, entity).agg(
        F.count(F.lit(1)).alias("n"), *[F.stddev_samp(c).alias(f"{c}_sd") for c in weights]
    ).filter(F.col("n") >= min_n)
    total, index = sum(weights.values()), F.lit(0.0)
    for c, w in weights.items():
        table = average_rank(table, [season], f"{c}_sd", f"{c}_pct", descending=True, percent=True)
        index = index + F.lit(w / total) * F.col(f"{c}_pct")
    return table.withColumn("index", index)


def stickiness(table: DataFrame, season: str, entity: str, value: str,
               min_common: int = 10) -> DataFrame:
    """Correlation of a value with itself one season later."""
    pairs = consecutive_pairs(table.select(season, entity, value), entity, season, [value])
    out = pairs.groupBy(season).agg(F.count(F.lit(1)).alias("common"),
                                    F.corr(value, f"{value}_next").alias("r"))
    return out.filter(F.col("common") >= min_common).withColumn("r2", F.col("r") * F.col("r"))


def quantile_table(df: DataFrame, value: str, buckets: int, outcome: str) -> DataFrame:
    """Mean outcome per equal-count bucket of a value, with right-closed quantile edges."""
    from foretally.operators.ranks import exact_quantiles
    probs = {f"e{i}": i / buckets for i in range(1, buckets)}
    edges = exact_quantiles(df, [], value, probs)
    bucket = F.lit(0)
    for name in probs:
        bucket = bucket + (F.col(value) > edges.select(name).scalar()).cast("int")
    return df.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
        F.avg(outcome).alias("mean_outcome"))
