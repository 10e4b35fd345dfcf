"""Whitening of embeddings by their leading principal components.

Entries become whole numbers, so sums and covariances are found exactly: each task adds up its part in
whole numbers, Spark adds the parts up by matrix row, and only one matrix (dimension squared) reaches
the driver, where contour integration (``feast``) takes the leading components out of it.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import feast
from foretally.llm.store import stored

#: Steps of one that entries are rounded down to.
STEPS = 256
#: Groups of tasks whose parts are added before they meet.
SALTS = 64
#: The driver holds one matrix of this dimension squared at most.
WIDEST = 4096
_LONG = 1 << 63


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 * entry) of each vector of finite entries; longer or shorter ones than most are left out."""
    entry = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    known = (vectors.select("vec_id", entry.alias("v")).filter("v is not null and size(v) > 0").filter(F.coalesce(fine, F.lit(False)))
             .select("vec_id", F.transform("v", lambda c: F.floor(c * float(STEPS)).cast("long")).alias("x")))
    usual = known.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return known
    if usual["d"] > WIDEST:
        raise ValueError(f"vectors of more than {WIDEST} entries")
    return known.filter(F.size("x") == usual["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x - by, in Python's whole numbers where 64 bits might not do."""
    if x.dtype != object and by.dtype != object and _largest(x) + _largest(by) < _LONG:
        return x - by
    return x.astype(object) - by.astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers (an object array): by floating blocks as long as their sums stay exact."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    most = _largest(y) if len(y) else 0
    if most * most >= 1 << 53:
        y = y.astype(object)
        return total + y.T @ y
    step = max(1, min(len(y), (1 << 53) // max(1, most * most)))
    for at in range(0, len(y), step):
        part = y[at:at + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _texts(rows: np.ndarray) -> pa.Array:
    return pa.array([[str(int(v)) for v in row] for row in rows], pa.list_(pa.string()))


def _added(parts: DataFrame) -> dict:
    """Sums of the parts' whole numbers by matrix row: first within groups of tasks, then over all."""
    def add(table: pa.Table) -> pa.Table:
        total = 0
        for batch in table.to_batches():
            numbers = np.array([int(v) for v in batch.column("v").flatten().to_pylist()], dtype=object)
            total = total + numbers.reshape(batch.num_rows, -1).sum(axis=0)
        return pa.table({"row": table.column("row").slice(0, 1), "v": _texts([total])})

    schema = "row int, v array<string>"
    inner = parts.groupBy("row", "salt").applyInArrow(lambda key, t: add(t.select(["row", "v"])), schema)
    outer = inner.groupBy("row").applyInArrow(lambda key, t: add(t), schema)
    return {r["row"]: [int(v) for v in r["v"]] for r in outer.collect()}


def _partial(fit: DataFrame, sums) -> DataFrame:
    """One row of sums for each row of the matrix and task. ``sums`` takes a batch's vectors to such rows."""
    def run(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            n = len(total)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), _texts(total)], names=["row", "salt", "v"])

    return fit.select("x").mapInArrow(run, "row int, salt int, v array<string>")


def _counted(x: np.ndarray) -> np.ndarray:
    wide = x if len(x) * _largest(x) < _LONG else x.astype(object)
    return np.array([[len(x), *map(int, wide.sum(axis=0))]], dtype=object)


def covariance(fit: DataFrame) -> tuple[int, list, np.ndarray]:
    """(n, sums, V): number of the vectors ``x``, their sums and their covariance, divisor n, correctly rounded."""
    first = _added(_partial(fit, _counted))
    if not first:
        return 0, [], np.zeros((0, 0))
    n, *sums = first[0]
    middle = np.array([round(Fraction(s, n)) for s in sums], dtype=object)
    near = middle.astype(np.int64) if all(abs(m) < _LONG for m in middle) else middle
    rows = _added(_partial(fit, lambda x: _products(_shifted(x, near))))
    left = np.array(sums, dtype=object) - n * middle
    # Centred at whole numbers next to the means; what is left of the means is taken off exactly.
    exact = n * np.array([rows[i] for i in range(len(sums))], dtype=object) - np.outer(left, left)
    return n, sums, np.array([[int(v) / (n * n) for v in row] for row in exact])


def _whitened(x: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, exact, and its whitened projections."""
    times = x * n if x.dtype != object and _largest(x) * n < _LONG // 2 else x.astype(object) * n
    apart = _shifted(times, sums)
    return apart, (apart.astype(float) / n) @ axes


def whitened(vectors: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """Vectors on their leading principal components, scaled to unit variance.

    ``vectors`` needs vec_id and ``column``; other columns are ignored. Vectors that are null, empty or hold
    null or non-finite entries are left out, and so are those of another length than most (of equally common
    lengths the longer one counts). Entries are floor(256 * entry), at the ends of long where they lie
    beyond. Means and covariance (divisor n) are those of the distinct vectors, so copies have no say.
    Returns a row for each vector and component: vec_id, component (from 1 by falling eigenvalue), n (distinct
    vectors), deviation (sum over dimensions of (n * x - sum)^2 as decimal(38,0), null beyond), whitened,
    explained (share of the variance), identity_error (largest absolute entry of the distinct vectors' whitened
    covariance minus the identity). Components with less than 1e-11 of the largest
    variance are left out: if all vectors are equal, or there are none, the result is empty. Vectors without vec_id and repeated ones have rows like others.
    """
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double")
    rows = whole_vectors(vectors, column)
    fit = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    n, sums, v = covariance(fit)
    values, axes = feast.leading(v, components) if n else (np.zeros(0), np.zeros((0, 0)))
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema + ", identity_error double")
    offset = np.array(sums, dtype=object)
    offset = offset.astype(np.int64) if all(abs(s) < _LONG for s in sums) else offset
    scaled, shares = axes / np.sqrt(values), values / np.trace(v)

    def projected(batches):
        for batch in batches:
            if batch.num_rows:
                _, w = _whitened(_matrix(batch.column(0)), n, offset, scaled)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    told = fit.select("x").mapInArrow(projected, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spread = told.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            apart, w = _whitened(_matrix(batch.column(1)), n, offset, scaled)
            most = _largest(apart) if apart.dtype != object else max(abs(a) for a in apart.flat)
            squares = apart if most * most * apart.shape[1] < _LONG else apart.astype(object)
            deviation = [Decimal(int(s)) if s < 10 ** 38 else None for s in (squares * squares).sum(axis=1)]
            m = len(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, dtype=np.int64)), pa.array([x for x in deviation for _ in range(k)], pa.decimal128(38, 0)),
                 pa.array(w.reshape(-1)), pa.array(np.tile(shares, m))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, schema).withColumn("identity_error", F.lit(float(error)))
