"""Blending weights from second moments; only k-by-k systems reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from foretally.operators.joins import small_join

#: Members whose second moments one aggregation holds.
MAX_MEMBERS = 64


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def second_moments(df: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str]) -> DataFrame:
    """Per group: n, mean y, means, E[c_i c_j], E[c_i y], E[y^2] in one aggregation."""
    if len(cols) > MAX_MEMBERS:
        raise ValueError(f"at most {MAX_MEMBERS} members")
    yy = F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(yy).alias("my"), F.avg(yy * yy).alias("yy"),
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.avg(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _pairs(cols)],
        *[F.avg(F.col(c) * yy).alias(f"t_{c}") for c in cols])


def _matrices(row, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    k = len(cols)
    s = np.zeros((k, k))
    for (a, b) in _pairs(cols):
        i, j = list(cols).index(a), list(cols).index(b)
        s[i, j] = s[j, i] = row[f"s_{a}_{b}"]
    return s, np.array([row[f"t_{c}"] for c in cols]), row["yy"]


def centred_weights(moments: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Least-squares weights of forecasts centred on the outcome rate, per group.

    ``moments`` holds one row per bucket, so the collected rows are bounded by the buckets.
    """
    out = []
    for row in moments.collect():
        s, t, _ = _matrices(row, cols)
        r, m = row["my"], np.array([row[f"m_{c}"] for c in cols])
        big = s - r * (m[:, None] + m[None, :]) + r * r
        rhs = t - r * m
        w = np.linalg.lstsq(big, rhs, rcond=None)[0]
        out.append(tuple(row[k] for k in keys) + (float(r),) + tuple(float(x) for x in w))
    types = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["base double"]
                       + [f"w_{c} double" for c in cols])
    return moments.sparkSession.createDataFrame(out, schema)


def apply_centred(df: DataFrame, weights: DataFrame, keys: Sequence[str],
                  cols: Sequence[str]) -> DataFrame:
    """base + sum of w * (forecast - base)."""
    rows = small_join(df, weights, keys) if keys else df.withColumns(
        {c: weights.select(c).scalar() for c in ["base", *[f"w_{x}" for x in cols]]})
    blend: Column = F.col("base")
    for c in cols:
        blend = blend + F.col(f"w_{c}") * (F.col(c) - F.col("base"))
    return rows.withColumn("blend", blend).drop("base", *[f"w_{c}" for c in cols])


def simplex_gap(s: np.ndarray, t: np.ndarray, ridge: float, w: np.ndarray) -> float:
    """By how much ``w`` misses the optimality conditions of ``simplex_weights``; 0 at the optimum.

    The sum is 1, no weight is negative, the slope is the same for all members with weight and not lower
    for the others.
    """
    m = len(t)
    slope = 2 * ((s + ridge * np.eye(m)) @ w - t - ridge / m)
    level = float(w @ slope)
    return max(abs(float(w.sum()) - 1), -float(w.min()), level - float(slope.min()),
               float(np.abs(slope - level)[w > 1e-12].max()))


def simplex_weights(s: np.ndarray, t: np.ndarray, ridge: float, rounds: int | None = None) -> np.ndarray:
    """Minimise w'Sw - 2t'w + ridge*|w - 1/m|^2 with w >= 0 and sum 1, by an active set.

    Members with weight are solved for exactly. Where the solution leaves the simplex, the step is cut at
    the first weight that reaches zero and that member goes; at a solution inside, the member whose slope
    is lowest comes in. Every solution lowers the value, so no set of members comes twice. Raises where
    the optimality conditions are not met in the end.
    """
    m = len(t)
    a, b = s + ridge * np.eye(m), t + ridge / m
    scale = max(float(np.abs(a).max()), float(np.abs(b).max()), 1e-300)
    w = np.zeros(m)
    w[int(np.argmin(np.diag(a) - 2 * b))] = 1.0
    free = w > 0
    for _ in range(rounds or 50 * (m + 1)):
        idx = np.flatnonzero(free)
        kkt = np.block([[2 * a[np.ix_(idx, idx)], np.ones((len(idx), 1))], [np.ones((1, len(idx))), np.zeros((1, 1))]])
        goal = np.zeros(m)
        goal[idx] = np.linalg.lstsq(kkt, np.append(2 * b[idx], 1.0), rcond=None)[0][:len(idx)]
        out = idx[goal[idx] <= 0]
        if len(out):
            step = w[out] / np.maximum(w[out] - goal[out], 1e-300)
            w = w + step.min() * (goal - w)
            gone = out[step <= step.min()]
            w[gone], free[gone] = 0.0, False
            continue
        w = goal
        slope = 2 * (a @ w - b)
        spare = np.where(free, np.inf, slope - w @ slope)
        if spare.min() >= -1e-12 * scale:
            break
        free[int(np.argmin(spare))] = True
    w = np.clip(w, 0, None) / np.clip(w, 0, None).sum()
    if simplex_gap(s, t, ridge, w) > 1e-7 * scale:
        raise ArithmeticError("simplex weights did not reach the optimality conditions")
    return w


def simplex_blend(df: DataFrame, y: str, cols: Sequence[str], ridge: float) -> dict[str, float]:
    s, t, _ = _matrices(second_moments(df, [], y, cols).first(), cols)
    return dict(zip(cols, (float(x) for x in simplex_weights(s, t, ridge))))


def greedy_members(df: DataFrame, y: str, cols: Sequence[str], steps: int) -> list[dict]:
    """Add the member that lowers Brier most, with replacement; one aggregation in total."""
    s, t, yy = _matrices(second_moments(df, [], y, cols).first(), cols)
    counts, trail = np.zeros(len(cols)), []
    for step in range(1, steps + 1):
        options = []
        for i in range(len(cols)):
            w = (counts + np.eye(len(cols))[i]) / step
            options.append((float(w @ s @ w - 2 * t @ w + yy), i))
        brier, pick = min(options)
        counts[pick] += 1
        trail.append({"step": step, "member": cols[pick], "brier": brier})
    return trail


def diverse_members(df: DataFrame, y: str, cols: Sequence[str], top: int,
                    limit: float) -> list[str]:
    """Members by Brier, skipping those whose residual correlates too much with a chosen one."""
    e = {c: F.col(c) - F.col(y) for c in cols}
    row = df.agg(*[F.avg(e[c] * e[c]).alias(f"b_{c}") for c in cols],
                 *[F.corr(e[a], e[b]).alias(f"r_{a}_{b}") for a, b in _pairs(cols) if a != b]).first()
    corr = lambda a, b: row[f"r_{a}_{b}"] if f"r_{a}_{b}" in row else row[f"r_{b}_{a}"]
    ranked = sorted(cols, key=lambda c: (row[f"b_{c}"], c))
    chosen: list[str] = []
    for c in ranked:
        if len(chosen) >= top:
            break
        if all(abs(corr(c, o)) <= limit for o in chosen):
            chosen.append(c)
    if len(chosen) == 1 and len(ranked) > 1:
        chosen.append(ranked[1])
    return chosen


def composition_coefficients(df: DataFrame, y: str, parts: Sequence[str],
                             mode: str = "free") -> dict[str, float]:
    """Least squares of the target on component probabilities and an intercept."""
    row = second_moments(df, [], y, parts).first()
    s, t, _ = _matrices(row, parts)
    m = np.array([row[f"m_{c}"] for c in parts])
    if mode == "intercept":
        return {"intercept": float(row["my"] - m.sum()), **{c: 1.0 for c in parts}}
    k = len(parts)
    big = np.zeros((k + 1, k + 1))
    big[:k, :k], big[:k, k], big[k, :k], big[k, k] = s, m, m, 1.0
    w = np.linalg.lstsq(big, np.append(t, row["my"]), rcond=None)[0]
    if mode == "sign":
        w[:k] = np.clip(w[:k], 0.0, None)
    return {**{c: float(x) for c, x in zip(parts, w)}, "intercept": float(w[k])}
