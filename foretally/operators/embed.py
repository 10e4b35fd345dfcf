"""Embeddings of entities: principal components and truncated SVD of long matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from foretally import session
from foretally.functions.rates import half_life
from foretally.operators.joins import sized
from foretally.operators.prepare import robust_scaled, standard_scaled

MAX_DIMS = 512
#: Cells of one Arrow batch of packs.
PACKED_CELLS = 1 << 20


def _combine(cols: Sequence[str], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, w in zip(cols, weights):
        out = out + F.lit(float(w)) * F.col(c)
    return out


def principal_components(df: DataFrame, columns: Sequence[str], dim: int,
                         prefix: str = "pc") -> tuple[DataFrame, dict]:
    """Project centred columns on their leading components; largest loading is positive."""
    if len(columns) > MAX_DIMS:
        raise ValueError(f"at most {MAX_DIMS} columns")
    k = max(1, min(dim, len(columns), df.count() - 1))
    data = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(df)
    centred = StandardScaler(inputCol="__raw", outputCol="__centred", withMean=True, withStd=False)
    data = centred.fit(data).transform(data)
    model = PCA(k=k, inputCol="__centred", outputCol="__pc").fit(data)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    data = model.transform(data).withColumn("__pc", vector_to_array("__pc"))
    names = [f"{prefix}{d:02d}" for d in range(k)]
    out = data.withColumns({n: F.get("__pc", d) * F.lit(float(sign[d])) for d, n in enumerate(names)})
    return out.drop("__raw", "__centred", "__pc"), {
        "columns": names, "explained": [float(x) for x in model.explainedVariance.toArray()]}


def array_columns(df: DataFrame, array: str, size: int, prefix: str = "v") -> tuple[DataFrame, list[str]]:
    """Spread a fixed-length array into double columns."""
    names = [f"{prefix}{i:02d}" for i in range(size)]
    return df.withColumns({n: F.get(F.col(array), i).cast("double") for i, n in enumerate(names)}), names


def _turn(gram: np.ndarray) -> np.ndarray:
    """What columns of this Gram matrix are multiplied by to be orthonormal."""
    values, vectors = np.linalg.eigh(gram)
    return vectors / np.sqrt(np.maximum(values, 1e-30))


def _orthonormal(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Columns rotated to an orthonormal set through their small Gram matrix."""
    m = len(names)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = df.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    gram = np.zeros((m, m))
    for (i, j), v in zip(pairs, row):
        gram[i, j] = gram[j, i] = v
    turn = _turn(gram)
    return df.select(*[c for c in df.columns if c not in names],
                     *[_combine(names, turn[:, i]).alias(names[i]) for i in range(m)]), gram


def _residual(pairs: DataFrame, names: Sequence[str], dim: int) -> float:
    """How far the basis ``q`` is from a leading subspace: the largest residual of its first ``dim`` Ritz pairs
    relative to the largest Ritz value. ``pairs`` holds the basis (names with ``o``) and its image (names)."""
    m = len(names)
    every = [(i, j) for i in range(m) for j in range(m)]
    row = pairs.agg(*[F.sum(F.col(f"o{names[i]}") * F.col(names[j])) for i, j in every],
                    *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in every]).first()
    small, square = (np.array(part, dtype=float).reshape(m, m) for part in (row[:m * m], row[m * m:]))
    return _ritz_residual(small, square, dim)


def _ritz_residual(small: np.ndarray, square: np.ndarray, dim: int) -> float:
    """``_residual`` from the products of basis and image and of the image with itself."""
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:dim], turn[:, ::-1][:, :dim]
    off = np.einsum("ij,ik,kj->j", turn, square, turn) - values ** 2
    return float(np.sqrt(np.clip(off, 0, None)).max() / max(values[0], 1e-300))


def _numbered(cells: DataFrame, side: str) -> DataFrame:
    """(id, p): the ids of one side, numbered from 0; stored."""
    ids = cells.select(F.col(side).alias("id")).filter("id IS NOT NULL").distinct()
    return session.checkpoint(ids.withColumn("p", F.row_number().over(Window.orderBy("id")) - 1))


def _packs(cells: DataFrame, big: str, small: str, ids: DataFrame) -> DataFrame:
    """One row for each id of the big side: numbers of the small side's ids it meets, and the values; stored."""
    met = cells.filter(F.col(big).isNotNull()).join(F.broadcast(ids), F.col(small) == F.col("id"))
    each = met.groupBy(big, "p").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    return session.checkpoint(each.groupBy(big).agg(F.collect_list(F.struct("p", "x")).alias("cells")).select("cells"))


def _there_and_back(packs: DataFrame, vectors: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For the matrix M of packs: the Gram matrix of M times ``vectors``, and M transposed times that product.

    ``vectors`` has a row for each id of the small side. Every pack is worked through where it stands; a task
    returns one row for each small id, and these are summed by Spark.
    """
    m = vectors.shape[1]
    names = [f"q{i:02d}" for i in range(m)]
    spark = packs.sparkSession
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(vectors.T))

    def run(batches):
        v = sent.value
        back, gram, any_row = np.zeros_like(v), np.zeros((m, m)), False
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            any_row = True
            flat, edges = lists.flatten(), lists.offsets.to_numpy()
            sizes, starts = np.diff(edges), edges[:-1] - edges[0]
            p, x = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("p", "x"))
            there = np.empty((m, len(lists)))
            for j in range(m):
                there[j] = np.add.reduceat(x * v[j][p], starts)
                back[j] += np.bincount(p, weights=x * np.repeat(there[j], sizes), minlength=v.shape[1])
            gram += there @ there.T
        if any_row:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.arange(v.shape[1]), -1 - np.arange(m)]))]
                + [pa.array(np.concatenate([back[j], gram[j]])) for j in range(m)], names=["p", *names])

    try:
        with session.arrow_rows(spark, rows):
            sums = packs.mapInArrow(run, "p long, " + ", ".join(f"{n} double" for n in names)).groupBy("p").agg(
                *[F.sum(n).alias(n) for n in names]).toArrow()
    finally:
        sent.unpersist()
    at = sums["p"].to_numpy()
    told = np.column_stack([sums[n].to_numpy() for n in names])
    back, gram = np.zeros_like(vectors), np.zeros((m, m))
    back[at[at >= 0]] = told[at >= 0]
    gram[-1 - at[at < 0]] = told[at < 0]
    return gram, back


def _packed_image(cells: DataFrame, basis: DataFrame, names: Sequence[str], dim: int, iterations: int,
                  tolerance: float, small: str, n: int) -> tuple[DataFrame, float]:
    """The steps of ``truncated_svd`` where one side's vectors may be sent: (image of the last basis, residual).

    Cells stand in packs of the other side's ids, so that a step is one pass over them without a join.
    """
    big = "c" if small == "r" else "r"
    ids = _numbered(cells, small)
    packs = _packs(cells, big, small, ids)
    longest = packs.agg(F.max(F.size("cells"))).first()[0] or 1
    rows = max(1, min(10_000, PACKED_CELLS // longest))
    times = [F.sum(F.col("x") * F.col(c)).alias(c) for c in names]
    # Either side's vectors of the first basis.
    first = basis if small == "c" else cells.join(basis, "c").groupBy("r").agg(*times)
    drawn = first.join(F.broadcast(ids), F.col(small) == F.col("id")).select("p", *names).toArrow()
    vectors = np.zeros((n, len(names)))
    vectors[drawn["p"].to_numpy()] = np.column_stack([drawn[c].fill_null(0.0).to_numpy() for c in names])
    for _ in range(iterations):
        gram, back = _there_and_back(packs, vectors, rows)
        square = gram if small == "r" else back.T @ back
        residual = _ritz_residual(vectors.T @ vectors if small == "r" else gram, square, dim)
        if residual <= tolerance:
            break
        vectors = back @ _turn(square)
    else:
        raise ArithmeticError(f"residual {residual} after {iterations} iterations")
    table = pa.table({"p": np.arange(n), **{c: np.ascontiguousarray((vectors if small == "r" else back)[:, j]) for j, c in enumerate(names)}})
    told = cells.sparkSession.createDataFrame(table).join(F.broadcast(ids), "p").select(F.col("id").alias(small), *names)
    if small == "c":
        return session.checkpoint(told), residual
    return session.checkpoint(cells.filter("c IS NOT NULL").join(F.broadcast(told), "r").groupBy("c").agg(*times)), residual


def truncated_svd(cells: DataFrame, row: str, col: str, value: str, dim: int, iterations: int = 100,
                  oversample: int = 4, prefix: str = "svd", tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float], float]:
    """Leading singular triples of a long sparse matrix by block power iteration.

    Where the vectors of the shorter axis are small enough to be sent, every step is one pass over the cells,
    packed by the longer axis; otherwise it is three joins and two grouped sums of ``dim + oversample`` columns
    and only the small Gram matrices reach the driver, so neither axis is bounded. Steps end when the residual of the
    leading subspace (relative to the largest squared singular value) is at most ``tolerance``; where
    ``iterations`` do not reach it, ArithmeticError is raised. Returns row scores (left vectors times
    singular values), column loadings, singular values and the residual; the largest loading of each
    component is positive.
    """
    m = dim + oversample
    names = [f"q{i:02d}" for i in range(m)]
    cells = session.checkpoint(cells.select(F.col(row).alias("r"), F.col(col).alias("c"),
                                            F.col(value).cast("double").alias("x")))
    seed = lambda i: F.pmod(F.xxhash64(F.col("c").cast("string"), F.lit(i)), F.lit(2000003)) / 1000001.5 - 1.0
    basis = cells.select("c").distinct().select("c", *[seed(i).alias(n) for i, n in enumerate(names)])
    basis, _ = _orthonormal(session.checkpoint(basis), names)
    times = lambda by: [F.sum(F.col("x") * F.col(n)).alias(n) for n in names]
    counts = cells.agg(F.count_distinct("r").alias("r"), F.count_distinct("c").alias("c")).first()
    small = "r" if counts["r"] < counts["c"] else "c"
    if 0 < counts[small] * (16 + 8 * (m + 1)) <= session.broadcast_bytes(cells.sparkSession):
        image, residual = _packed_image(cells, basis, names, dim, iterations, tolerance, small, counts[small])
        basis, _ = _orthonormal(image, names)
        iterations = 0
    for _ in range(iterations):
        scores = cells.join(basis, "c").groupBy("r").agg(*times("r"))
        image = cells.join(scores, "r").groupBy("c").agg(*times("c"))
        both = session.checkpoint(image.join(basis.select("c", *[F.col(n).alias(f"o{n}") for n in names]), "c"))
        residual = _residual(both, names, dim)
        basis, _ = _orthonormal(both.select("c", *names), names)
        if residual <= tolerance:
            break
    else:
        if iterations:
            raise ArithmeticError(f"residual {residual} after {iterations} iterations")
    scores = session.checkpoint(cells.join(basis, "c").groupBy("r").agg(*times("r")))
    _, gram = _orthonormal(scores, names)
    values, turn = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:dim]
    turn, sigma = turn[:, order], np.sqrt(np.clip(values[order], 0, None))
    out = [f"{prefix}{i:02d}" for i in range(len(order))]
    right = session.checkpoint(basis.select("c", *[_combine(names, turn[:, i]).alias(n) for i, n in enumerate(out)]))
    lead = right.agg(*[F.max_by(n, F.struct(F.round(F.abs(n), 9), F.col("c"))).alias(n) for n in out]).first()
    sign = {n: (-1.0 if lead[n] is not None and lead[n] < 0 else 1.0) for n in out}
    left = scores.select(F.col("r").alias(row), *[
        (_combine(names, turn[:, i]) * F.lit(sign[n])).alias(n) for i, n in enumerate(out)])
    right = right.select(F.col("c").alias(col), *[(F.col(n) * F.lit(sign[n])).alias(n) for n in out])
    return left, right, [float(s) for s in sigma], residual


def reconstruction(cells: DataFrame, left: DataFrame, right: DataFrame, row: str, col: str, value: str,
                   dims: Sequence[str]) -> DataFrame:
    """One row: the cells' energy (sum of squares) and what is left of it once the components are taken off.

    Cells that are not listed are zero: over them the components' own energy is the product of both sides'
    Gram matrices, so no full matrix is made.
    """
    fit = sum((F.col(f"__l_{d}") * F.col(f"__r_{d}") for d in dims), F.lit(0.0))
    met = (cells.join(left.select(row, *[F.col(d).alias(f"__l_{d}") for d in dims]), row)
           .join(right.select(col, *[F.col(d).alias(f"__r_{d}") for d in dims]), col))
    x = F.col(value).cast("double")
    sums = met.agg(F.sum(x * x).alias("energy"), F.sum(x * fit).alias("shared"))
    every = [(a, b) for a in dims for b in dims]
    gram = lambda df, name: df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{name}_{a}_{b}") for a, b in every])
    both = sums.crossJoin(gram(left, "l")).crossJoin(gram(right, "r"))
    own = sum((F.col(f"l_{a}_{b}") * F.col(f"r_{a}_{b}") for a, b in every), F.lit(0.0))
    return both.select("energy", (F.col("energy") - 2 * F.col("shared") + own).alias("left_over"))


def interaction_cells(df: DataFrame, a: str, b: str, residual: str, strength: float, season: str,
                      cutoff: int, life: float, min_a: float, min_b: float) -> DataFrame:
    """Reliability-weighted residual of every pair of sufficiently seen entities."""
    w = half_life(F.lit(cutoff) - F.col(season), life)
    pair = df.filter(F.col(season) < cutoff).groupBy(a, b).agg(
        F.sum(w * F.col(residual)).alias("wr"), F.sum(w).alias("n"))
    big = lambda k, floor: pair.groupBy(k).agg(F.sum("n").alias("t")).filter(F.col("t") >= floor).select(k)
    kept = pair.join(big(a, min_a), a, "left_semi").join(big(b, min_b), b, "left_semi")
    rel = F.col("n") / (F.col("n") + strength)
    return kept.select(a, b, (F.col("wr") / (F.col("n") + strength) * F.sqrt(rel)).alias("value"))


def pair_scores(rows: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str,
                dims: Sequence[str]) -> DataFrame:
    """Dot product and norms of both sides' vectors, 0 when either side is unknown."""
    l = left.select(a, F.array(*dims).alias("__l"))
    r = right.select(b, F.array(*dims).alias("__r"))
    out = rows.join(sized(l), a, "left").join(sized(r), b, "left")
    known = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    made = {"pair_score": dot("__l", "__r"), "left_norm": F.sqrt(dot("__l", "__l")), "right_norm": F.sqrt(dot("__r", "__r"))}
    return out.withColumns({**{n: F.when(known, c).otherwise(0.0) for n, c in made.items()},
                            "pair_known": known.cast("int")}).drop("__l", "__r")


def embedding(df: DataFrame, columns: Sequence[str], dim: int, prefix: str = "pc") -> tuple[DataFrame, dict]:
    """Impute, robust-scale, bound, drop constant columns, then principal components."""
    scaled, kept = robust_scaled(df, columns)
    names = [f"__{c}" for c in kept]
    work = scaled.withColumnsRenamed(dict(zip(kept, names)))
    out, info = principal_components(work, names, dim, prefix)
    # Fitted transforms are cut here: later steps read entity rows, not the raw log again.
    return session.checkpoint(out.withColumnsRenamed(dict(zip(names, kept)))), info


def two_view_embedding(df: DataFrame, first: Sequence[str], second: Sequence[str], dims: tuple[int, int],
                       weight: float) -> tuple[DataFrame, list[str]]:
    """Components of two column groups, each coordinate standardised, the second weighted."""
    one, a = embedding(df, first, dims[0], "va")
    both, b = embedding(one, second, dims[1], "vb")
    out = standard_scaled(both, [*a["columns"], *b["columns"]], float("inf"))
    out = out.withColumns({c: F.col(c) * F.lit(weight) for c in b["columns"]})
    return out, [*a["columns"], *b["columns"]]
