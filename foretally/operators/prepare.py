"""Fitted preprocessing: fit on past rows, apply to any rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foretally.functions.rates import clip
from foretally.operators.joins import lookup_join
from foretally.operators.ordered import History
from foretally.operators.ranks import average_rank, metric_quantiles
from foretally.roles import Order


def category_codes(fit: DataFrame, column: str, start: int = 0,
                   hot_rows: int | None = None) -> DataFrame:
    """Levels of the fit rows with consecutive codes in sorted order."""
    levels = fit.filter(F.col(column).isNotNull()).select(column).distinct()
    return History(levels, [], Order((column,)), hot_rows).position("__p").df.select(
        column, (F.col("__p") + start).cast("int").alias("__code"))


def encode(df: DataFrame, codes: DataFrame, column: str, name: str, unseen: int = -1) -> DataFrame:
    return lookup_join(df, codes.withColumnRenamed("__code", name), [column], {name: unseen})


def safe_name(name: str) -> str:
    return re.sub(r"[\[\]<>,\s]+", "_", name)


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Indicators of given levels and of NULL."""
    made = {safe_name(f"{column}_{v}"): F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in levels}
    made[safe_name(f"{column}_null")] = F.col(column).isNull().cast("int")
    return df.withColumns(made)


# Columns of the public pitch feed that are known only once the pitch has been thrown, or later.
LATE_COLUMNS = (
    "type", "description", "des", "events", "zone", "plate_x", "plate_z", "sz_top", "sz_bot", "release_speed",
    "effective_speed", "release_spin_rate", "spin_axis", "spin_dir", "pfx_x", "pfx_z", "vx0", "vy0", "vz0", "ax", "ay", "az",
    "release_pos_x", "release_pos_y", "release_pos_z", "release_extension", "hit_location", "bb_type", "launch_speed",
    "launch_angle", "hit_distance_sc", "launch_speed_angle", "woba_value", "woba_denom", "babip_value", "iso_value",
    "home_win_exp", "bat_win_exp", "pitch_type", "pitch_name",
)
#: Families of such columns by the form of their name, the labels made from them included.
LATE_FORMS = (r"^post_", r"^delta_", r"^estimated_", r"^api_break_", r"_until_next_game$", r"^is_(csw|swing|whiff|called|take|strike)$",
              r"^(in|out)_zone$", r"^label$")


def late_columns(columns: Sequence[str], more: Sequence[str] = ()) -> list[str]:
    """Those of ``columns`` that are not known before the event: by name, by family, or named in ``more``."""
    return [c for c in columns if c in LATE_COLUMNS or c in more or any(re.search(form, c) for form in LATE_FORMS)]


def without_banned(df: DataFrame, banned: Sequence[str]) -> DataFrame:
    """Drop banned columns and prove none is left."""
    out = df.drop(*[c for c in banned if c in df.columns])
    left = set(out.columns).intersection(banned)
    if left:
        raise AssertionError(f"banned columns remain: {sorted(left)}")
    return out


def fit_columns(fit: DataFrame, columns: Sequence[str], logged: Sequence[str] = (),
                low: float = 0.001, high: float = 0.999) -> dict[str, dict[str, float]]:
    """Median, clip bounds, and mean and deviation after clipping, per column.

    Two aggregations over the fit rows; the result is a handful of numbers per column.
    """
    work = fit.select(*[(F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if c in logged
                         else F.col(c).cast("double")).alias(c) for c in columns])
    q = {r["metric"]: r for r in metric_quantiles(work, [], columns, {"m": 0.5, "lo": low, "hi": high}).collect()}
    shaped = {c: clip(F.coalesce(F.col(c), F.lit(q[c]["m"])), q[c]["lo"], q[c]["hi"]) for c in columns}
    row = work.agg(*[F.avg(e).alias(f"a_{c}") for c, e in shaped.items()],
                   *[F.stddev_pop(e).alias(f"s_{c}") for c, e in shaped.items()]).first()
    return {c: {"median": q[c]["m"], "low": q[c]["lo"], "high": q[c]["hi"], "mean": row[f"a_{c}"],
                "std": row[f"s_{c}"] or 1.0, "log": float(c in logged)} for c in columns}


def apply_columns(df: DataFrame, fitted: Mapping[str, Mapping[str, float]], prefix: str = "z_") -> DataFrame:
    """Log, impute, clip, standardise, with a missing indicator per column."""
    made = {}
    for c, p in fitted.items():
        x = F.col(c).cast("double")
        x = F.log1p(F.greatest(x, F.lit(0.0))) if p["log"] else x
        x = clip(F.coalesce(x, F.lit(p["median"])), p["low"], p["high"])
        made[f"{prefix}{c}"] = (x - F.lit(p["mean"])) / F.lit(p["std"])
        made[f"{prefix}{c}_missing"] = F.col(c).isNull().cast("int")
    return df.withColumns(made)


def robust_scaled(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None,
                  low: float = 0.1, high: float = 0.9, bound: float = 5.0) -> tuple[DataFrame, list[str]]:
    """Median-imputed, centred on the median, scaled by a quantile range and bounded.

    Columns constant over the fit rows are dropped; returns the kept names.
    """
    q = {r["metric"]: r for r in metric_quantiles(fit or df, [], columns, {"lo": low, "m": 0.5, "hi": high,
                                                                          "q0": 0.0, "q1": 1.0}).collect()}
    keep = [c for c in columns if c in q and q[c]["q1"] > q[c]["q0"]]
    made = {}
    for c in keep:
        spread = (q[c]["hi"] - q[c]["lo"]) or 1.0
        x = F.coalesce(F.col(c).cast("double"), F.lit(q[c]["m"]))
        made[c] = clip((x - F.lit(q[c]["m"])) / F.lit(spread), -bound, bound)
    return df.withColumns(made), keep


def standard_scaled(df: DataFrame, columns: Sequence[str], bound: float = 5.0) -> DataFrame:
    row = df.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: clip((F.col(c) - F.lit(row[f"a_{c}"])) / F.lit(row[f"s_{c}"] or 1.0), -bound, bound)
                           for c in columns})


def inverse_normal(p: Column) -> Column:
    """Normal quantile by a rational approximation (absolute error below 4.5e-4)."""
    tail = F.sqrt(F.lit(-2.0) * F.log(F.least(p, 1 - p)))
    # Coefficients of the published approximation.
    num = 2.515517 + 0.802853 * tail + 0.010328 * tail * tail
    den = 1.0 + 1.432788 * tail + 0.189269 * tail * tail + 0.001308 * tail * tail * tail
    return F.when(p < 0.5, -(tail - num / den)).otherwise(tail - num / den)


def quantile_normal(df: DataFrame, column: str, name: str, hot_rows: int | None = None) -> DataFrame:
    """Map a column to a normal shape through its average-rank percentile."""
    ranked = average_rank(df, [], column, "__r", hot_rows=hot_rows)
    n = df.agg(F.count(column)).scalar()
    p = (F.col("__r") - 0.5) / n
    return ranked.withColumn(name, inverse_normal(p)).drop("__r")


def clipped_share(df: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    """Share of values at or beyond the bound per column."""
    return df.agg(*[F.avg((F.abs(c) >= bound).cast("double")).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "share")


def stable_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   min_known: float = 0.7) -> DataFrame:
    """Columns known in most rows and not constant for every version of a table."""
    wide = df.groupBy(*keys).agg(
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"k_{c}") for c in columns],
        *[(F.min(c) < F.max(c)).cast("int").alias(f"v_{c}") for c in columns])
    usable = [((F.col(f"k_{c}") >= min_known) & (F.coalesce(F.col(f"v_{c}"), F.lit(0)) == 1)).cast("int").alias(c)
              for c in columns]
    return wide.select(*usable).agg(*[F.min(c).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "usable")


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole last row per key by an order key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
