"""All pairs of points in bounded blocks, each pair of blocks once.

Points stand in blocks of neighbours in space. A pair of blocks is one row that a task works through with
dense arrays, so no pair of points is ever a row, and a pair of blocks that a bound rules out is no row
either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally import session
from foretally.operators.ordered import History
from foretally.roles import Order

#: Dimensions and bits of the curve along which points are put in order.
CURVE_DIMS, CURVE_BITS = 8, 7


def _curve(values: str, low: Sequence[float], high: Sequence[float]):
    """Place of a point on a curve through space: bits of its coordinates, one dimension after the other."""
    dims = min(len(low), CURVE_DIMS)
    out = F.lit(0).cast("long")
    cells = [F.least(F.greatest(F.floor((F.get(values, i) - low[i]) / ((high[i] - low[i]) or 1.0) * (1 << CURVE_BITS)), F.lit(0)),
                     F.lit((1 << CURVE_BITS) - 1)) for i in range(dims)]
    for bit in range(CURVE_BITS - 1, -1, -1):
        for cell in cells:
            out = out * 2 + F.shiftright(cell, bit).bitwiseAND(F.lit(1))
    return out


def in_blocks(points: DataFrame, ident: str, values: str, size: int) -> DataFrame:
    """``points`` with ``block``: at most ``size`` neighbours in space share one; stored."""
    points = session.checkpoint(points)
    width = points.agg(F.max(F.size(values))).first()[0] or 0
    ends = points.agg(*[f(F.get(values, i)) for i in range(width) for f in (F.min, F.max)]).first() if width else []
    low, high = [float(v or 0) for v in ends[::2]], [float(v or 0) for v in ends[1::2]]
    placed = points.withColumn("__curve", _curve(values, low, high))
    return numbered(placed, Order(("__curve", ident)), size).drop("__curve")


def numbered(points: DataFrame, order: Order, size: int) -> DataFrame:
    """``points`` with ``block``: at most ``size`` that follow each other share one; stored."""
    ranked = History(points, [], order).position("__place").df
    return session.checkpoint(ranked.withColumn("block", F.floor(F.col("__place") / size)).drop("__place"))


def packed(blocked: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(block, rows): the points of a block in one row."""
    return blocked.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def pairs_of_blocks(blocked: DataFrame) -> DataFrame:
    """(i, j) with i <= j of all blocks."""
    blocks = blocked.select("block").distinct()
    top = blocks.agg(F.max("block")).first()[0]
    if top is None:
        return blocks.select(F.col("block").alias("i"), F.col("block").alias("j"))
    return blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(top))).alias("j"))


def facing(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, j, left, right): the points of both blocks of each pair."""
    return (pairs.join(rows.select(F.col("block").alias("i"), F.col("rows").alias("left")), "i")
            .join(rows.select(F.col("block").alias("j"), F.col("rows").alias("right")), "j").select("i", "j", "left", "right"))


def columns(members: pa.Array, numbers: Sequence[str], matrix: str) -> dict:
    """The fields of one row's points as numpy arrays; ``matrix`` holds their coordinates, a row each."""
    flat = members.flatten()
    out = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in numbers}
    values = flat.field(matrix).flatten().to_numpy(zero_copy_only=False)
    return out | {matrix: values.reshape(len(flat), -1)}


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``, from differences, so near points lose no digits."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return out


def gap_tiles(a: np.ndarray, b: np.ndarray, rows: int = 256, width: int = 1024) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Distances of the rows of ``a`` and ``b`` in tiles: (rows of a, rows of b, distances).

    A tile is one matrix product, about the points' middle. Where that would lose digits (points near each other for
    their size, or not finite), distances come from differences.
    """
    with np.errstate(all="ignore"):
        middle = (a.mean(axis=0) + b.mean(axis=0)) / 2
        middle = np.where(np.isfinite(middle), middle, 0.0)
        x, y = a - middle, b - middle
        nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        for i in (slice(s, s + rows) for s in range(0, len(a), rows)):
            for j in (slice(s, s + width) for s in range(0, len(b), width)):
                around = nx[i, None] + ny[None, j]
                gaps = x[i] @ y[j].T
                gaps *= -2.0
                gaps += around
                around *= 1e-4
                again = ~((gaps > around) & (gaps < np.inf))
                if again.any():
                    at, to = np.nonzero(again)
                    if 8 * len(at) > again.size:
                        gaps = squared_gaps(a[i], b[j])
                    else:
                        gaps[at, to] = ((a[i][at] - b[j][to]) ** 2).sum(axis=1)
                yield i, j, np.sqrt(gaps, out=gaps)


def even_size(points: int, most: int, tasks: int) -> int:
    """Points of a block: at most ``most``, and few enough that there are about ``tasks`` pairs of blocks."""
    blocks = max(1, math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2))
    return max(1, min(most, math.ceil(points / blocks)))
