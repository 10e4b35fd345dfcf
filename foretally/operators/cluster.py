"""Clustering of entity embeddings, stable numbering and quality measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foretally import session
from foretally.functions.rates import entropy, ratio
from foretally.operators import blocks
from foretally.operators.joins import null_safe_join, sized, small_join
from foretally.operators.ranks import exact_quantiles, metric_quantiles
from foretally.roles import Order


#: Numbers of one group's points and centres up to which a task holds the group through all rounds.
LOCAL = 1 << 23


def kmeans(df: DataFrame, dims: Sequence[str], k: int, seed: int, label: str = "cluster",
           weight: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Labels and centres of Spark's k-means on columns."""
    data = VectorAssembler(inputCols=list(dims), outputCol="__f").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol=label, maxIter=50, initSteps=4,
                   **({"weightCol": weight} if weight else {})).fit(data)
    return model.transform(data).drop("__f"), np.array([c for c in model.clusterCenters()])


def squared_distances(dims: Sequence[str], centres: np.ndarray) -> list[Column]:
    out = []
    for c in centres:
        total = F.lit(0.0)
        for d, x in zip(dims, c):
            total = total + (F.col(d) - F.lit(float(x))) * (F.col(d) - F.lit(float(x)))
        out.append(total)
    return out


def soft_membership(df: DataFrame, dims: Sequence[str], centres: np.ndarray, label: str) -> DataFrame:
    """Softmax of negative squared distance over the median smallest one, with its shape."""
    d2 = squared_distances(dims, centres)
    work = df.withColumns({f"__d{i}": e for i, e in enumerate(d2)})
    names = [f"__d{i}" for i in range(len(d2))]
    low = F.least(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    work = work.withColumn("__low", low)
    med = exact_quantiles(work, [], "__low", {"m": 0.5}).scalar()
    scale = F.greatest(med, F.lit(1e-4))
    weights = [F.exp(-(F.col(n) - F.col("__low")) / scale) for n in names]
    total = sum(weights[1:], weights[0])
    work = work.withColumns({f"member_{i}": w / total for i, w in enumerate(weights)})
    member = [F.col(f"member_{i}") for i in range(len(names))]
    ranked = F.sort_array(F.array(*member), asc=False)
    own = F.element_at(F.array(*[F.col(n) for n in names]), F.col(label) + 1)
    return work.withColumns({
        "distance": F.sqrt(own), "membership_entropy": entropy(member),
        "top_gap": F.get(ranked, 0) - F.coalesce(F.get(ranked, 1), F.lit(0.0))}).drop(*names, "__low")


def diagonal_mixture(df: DataFrame, dims: Sequence[str], k: int, seed: int, steps: int = 500,
                     floor: float = 1e-4, label: str = "cluster", tolerance: float = 1e-3) -> tuple[DataFrame, dict]:
    """Gaussian mixture with diagonal covariances: one aggregation of moments per EM step.

    Steps end when the mean log likelihood of a row grows by less than ``tolerance``; ArithmeticError is raised
    where ``steps`` do not do.
    """
    _, mean = kmeans(df, dims, k, seed, "__start")
    row = df.agg(*[F.var_pop(d) for d in dims]).first()
    var = np.tile(np.maximum(np.array(row, dtype=float), floor), (k, 1))
    mix = np.full(k, 1.0 / k)
    data = session.checkpoint(df)

    def logs() -> list[Column]:
        out = []
        for j in range(k):
            e = F.lit(float(np.log(mix[j]) - 0.5 * np.log(2 * np.pi * var[j]).sum()))
            for d, m, v in zip(dims, mean[j], var[j]):
                e = e - (F.col(d) - F.lit(float(m))) * (F.col(d) - F.lit(float(m))) / F.lit(float(2 * v))
            out.append(e)
        return out

    def posterior() -> tuple[list[Column], Column]:
        """Shares of the components and the row's log likelihood."""
        each = logs()
        top = F.greatest(*each) if k > 1 else each[0]
        weights = [F.exp(e - top) for e in each]
        total = sum(weights[1:], weights[0])
        return [w / total for w in weights], top + F.log(total)

    likelihood = -np.inf
    for _ in range(steps):
        shares, said = posterior()
        work = data.withColumns({**{f"__p{j}": p for j, p in enumerate(shares)}, "__said": said})
        aggs = [F.avg("__said")]
        for j in range(k):
            p = F.col(f"__p{j}")
            aggs.append(F.sum(p))
            aggs += [F.sum(p * F.col(d)) for d in dims] + [F.sum(p * F.col(d) * F.col(d)) for d in dims]
        mean_said, *sums = work.agg(*aggs).first()
        got = np.array(sums, dtype=float).reshape(k, 1 + 2 * len(dims))
        n = np.maximum(got[:, :1], 1e-12)
        new = got[:, 1:1 + len(dims)] / n
        var = np.maximum(got[:, 1 + len(dims):] / n - new ** 2, 0.0) + floor
        mean, mix = new, got[:, 0] / got[:, 0].sum()
        if mean_said - likelihood < tolerance:
            break
        likelihood = mean_said
    else:
        raise ArithmeticError(f"the likelihood still grows after {steps} steps")
    out = data.withColumns({f"member_{j}": p for j, p in enumerate(posterior()[0])})
    best = F.array_position(F.array(*[F.col(f"member_{j}") for j in range(k)]),
                            F.greatest(*[F.col(f"member_{j}") for j in range(k)])) - 1
    return out.withColumn(label, best.cast("int")), {"mean": mean, "var": var, "mix": mix}


def stable_numbers(df: DataFrame, label: str, keys: Sequence[str], k: int) -> DataFrame:
    """Renumber clusters by the medians of the key columns; ``k`` is the most labels that may occur.

    One row for each label is collected, so more labels than ``k`` raise ValueError.
    """
    table: dict[int, dict[str, float]] = {}
    for r in metric_quantiles(df, [label], keys, {"m": 0.5}).limit(len(keys) * (k + 1)).collect():
        table.setdefault(r[label], {})[r["metric"]] = r["m"]
    low = float("-inf")
    order = sorted(table, key=lambda v: (*(table[v].get(c, low) for c in keys), v))
    if len(order) > k:
        raise ValueError(f"more than {k} labels")
    new = {int(v): i for i, v in enumerate(order)}
    pick = F.create_map(*[F.lit(x) for pair in new.items() for x in pair])
    return df.withColumn(label, pick[F.col(label)])


def style_medians(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Attach the cluster's median of each style column to its members."""
    q = metric_quantiles(df, [label], columns, {"m": 0.5})
    wide = q.groupBy(label).agg(*[
        F.max(F.when(F.col("metric") == c, F.col("m"))).alias(f"style_{c}") for c in columns])
    return df.join(sized(wide), label, "left")


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Attach the size of the row's cluster."""
    return df.join(sized(df.groupBy(label).agg(F.count(F.lit(1)).alias("cluster_size"))), label)


def silhouette(df: DataFrame, ident: str, dims: Sequence[str], label: str, chunk: int = 16384) -> DataFrame:
    """Mean Euclidean silhouette. Each pair of blocks of points is measured once, for both sides.

    Blocks hold neighbours of one label where they can, so a point meets few labels in a block and leaves one
    sum for each of them.
    """
    pts = session.checkpoint(df.select(F.col(ident).alias("id"), F.array(*[F.col(d).cast("double") for d in dims]).alias("v"), F.col(label).alias("c")))
    # More pairs than tasks, as pairs are dealt by one of their blocks and so not evenly.
    size = blocks.even_size(pts.count(), chunk, 8 * df.sparkSession.sparkContext.defaultParallelism)
    kinds = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    blocked = blocks.numbered(pts, Order(("c", "id")), size)
    sizes = pts.groupBy("c").agg(F.count(F.lit(1)).alias("m"))

    def summed(mine: pa.Array, labels: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        """Distances of each point to the other side's points, added up by their label."""
        k = len(labels)
        again, each = np.repeat(np.arange(len(mine)), k), np.tile(np.arange(k), len(mine))
        return pa.RecordBatch.from_arrays([mine.field("id").take(pa.array(again)), mine.field("c").take(pa.array(again)),
                                           labels.take(pa.array(each)), pa.array(sums.reshape(-1))], names=["id", "c", "oc", "d"])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                left, right = (one.column(name).flatten() for name in ("left", "right"))
                a, b = (blocks.columns(one.column(name), (), "v")["v"] for name in ("left", "right"))
                codes = [side.field("c").dictionary_encode(null_encoding="encode") for side in (left, right)]
                ours, theirs = (np.eye(len(c.dictionary))[c.indices.to_numpy(zero_copy_only=False)] for c in codes)
                to_right, to_left = np.zeros((len(a), theirs.shape[1])), np.zeros((len(b), ours.shape[1]))
                for i, j, gaps in blocks.gap_tiles(a, b):
                    to_right[i] += gaps @ theirs[j]
                    to_left[j] += gaps.T @ ours[i]
                yield summed(left, codes[1].dictionary, to_right)
                if one.column("i")[0] != one.column("j")[0]:
                    yield summed(right, codes[0].dictionary, to_left)

    with session.arrow_rows(df.sparkSession, 1):
        met = session.checkpoint(blocks.facing(blocks.pairs_of_blocks(blocked), blocks.packed(blocked, ["id", "v", "c"])).mapInArrow(
            run, f"id {kinds['id']}, c {kinds['c']}, oc {kinds['c']}, d double").groupBy("id", "c", "oc").agg(F.sum("d").alias("d")))
    sums = met.join(sizes.withColumnRenamed("c", "oc"), "oc")
    own = F.col("c") == F.col("oc")
    per = sums.groupBy("id", "c").agg(
        F.max(F.when(own, F.try_divide(F.col("d"), F.col("m") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("m"))).alias("b"), F.max(F.when(own, F.col("m"))).alias("m"))
    s = F.when(F.col("m") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def davies_bouldin(df: DataFrame, dims: Sequence[str], label: str) -> float:
    """Mean worst ratio of spreads to centre distance (cluster-by-cluster on the driver)."""
    rows = df.groupBy(label).agg(*[F.avg(d).alias(d) for d in dims]).orderBy(label).collect()
    centre = np.array([[r[d] for d in dims] for r in rows])
    labels = [r[label] for r in rows]
    pos = F.create_map(*[F.lit(x) for p in zip(labels, range(len(labels))) for x in p])[F.col(label)]
    dist = F.element_at(F.array(*[F.sqrt(e) for e in squared_distances(dims, centre)]), pos + 1)
    spread = {r[label]: r["s"] for r in df.groupBy(label).agg(F.avg(dist).alias("s")).collect()}
    s = np.array([spread[x] for x in labels])
    far = np.linalg.norm(centre[:, None] - centre[None], axis=2)
    np.fill_diagonal(far, np.inf)
    return float(((s[:, None] + s[None, :]) / far).max(axis=1).mean())


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency counts."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    side = lambda k: n.groupBy(k).agg(F.sum("n").alias("t")).agg(F.sum(pairs("t"))).scalar()
    base = n.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("rows")).withColumns({"sa": side(a), "sb": side(b)})
    expected = F.col("sa") * F.col("sb") / pairs("rows")
    return base.select("rows", F.coalesce(ratio(F.col("both") - expected, (F.col("sa") + F.col("sb")) / 2.0 - expected),
                                          F.lit(1.0)).alias("ari"))


def _nearest(dims: Sequence[str], centres: str = "centres") -> Column:
    """(d2, cluster) of the nearest of a row's centres, the lower number where two are as near."""
    at = F.array(*[F.col(d).cast("double") for d in dims])
    gap = lambda c: F.aggregate(F.zip_with(at, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(centres, lambda c, i: F.struct(gap(c).alias("d2"), i.alias("cluster"))))


def _settled(points: np.ndarray, load: np.ndarray, centres: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Centres of one group after at most ``rounds`` rounds of k-means, and how far the last round moved them."""
    moved = np.inf
    for _ in range(rounds):
        gaps = np.zeros((len(points), len(centres)))
        for j in range(points.shape[1]):
            gaps += (points[:, j, None] - centres[None, :, j]) ** 2
        own = gaps.argmin(axis=1)
        weight = np.bincount(own, load, minlength=len(centres))
        sums = np.stack([np.bincount(own, load * x, minlength=len(centres)) for x in points.T], axis=1)
        used = (np.bincount(own, minlength=len(centres)) > 0)[:, None]
        before, centres = centres, np.where(used, sums / np.where(used, weight[:, None], 1), centres)
        moved = float(np.abs(centres - before).max())
        if moved <= tolerance:
            break
    return centres, moved


def grouped_kmeans(df: DataFrame, keys: Sequence[str], dims: Sequence[str], k: int, seed: int = 0,
                   weight: str | None = None, rounds: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """K-means of every group at once: (rows with ``cluster`` and ``d2``, centres by group).

    Centres are a table keyed by group. First centres are far apart: the row of least digest, then the row
    farthest from those there are. Each round is one join with the centres and one aggregation for all groups. A
    table below an eighth of the broadcast limit is kept on the driver between rounds, a larger one checkpointed.
    Rounds end when no centre moves, and ArithmeticError is raised where ``rounds`` passes over the table do not do. A pass
    is one round, or up to ``rounds`` of them where one task can hold a group's points and the driver keeps the centres. A centre that
    loses all its rows stays where it is. Groups of fewer different rows than ``k`` have equal centres.
    """
    data = session.checkpoint(df)
    point = F.array(*[F.col(d).cast("double") for d in dims])
    digest = F.xxhash64(*dims, F.lit(seed))
    centres = session.checkpoint(data.groupBy(*keys).agg(F.array(F.min_by(point, F.struct(digest, point))).alias("centres")))
    size = centres.count() * k * len(dims) * 8
    small = size <= session.broadcast_bytes(df.sparkSession)
    held = 8 * size <= session.broadcast_bytes(df.sparkSession)
    joined = lambda table: null_safe_join(data, F.broadcast(table) if small else table, keys)
    for _ in range(1, k):
        far = joined(centres).groupBy(*keys, "centres").agg(F.max_by(point, F.struct(_nearest(dims)["d2"], digest, point)).alias("far"))
        centres = session.checkpoint(far.select(*keys, F.concat("centres", F.array("far")).alias("centres")))
    load = F.lit(1.0) if weight is None else F.col(weight).cast("double")

    def means(table: DataFrame) -> DataFrame:
        """Mean of the rows of each cluster in use."""
        told = joined(table).withColumn("cluster", _nearest(dims)["cluster"])
        return told.groupBy(*keys, *([] if held else ["centres"]), "cluster").agg(
            F.array(*[F.try_divide(F.sum(load * F.col(d).cast("double")), F.sum(load)) for d in dims]).alias("mean"))

    # Clusters in use replace their centre; the others keep theirs.
    at = {}
    if held:  # as small as what a broadcast sends, so the driver keeps the table and a round is one aggregation
        schema = T.StructType([*[data.schema[c] for c in keys], T.StructField("centres", T.ArrayType(T.ArrayType(T.DoubleType())))])
        name = lambda r: repr([r[c] for c in keys])
        at = {name(r): tuple(r) for r in centres.collect()}

    def in_tasks() -> float:
        """Move the kept centres by one pass, each group in one task; how far the last round moved any."""
        def run(key, table):
            points = np.stack([table.column(f"__x{i}").to_numpy() for i in range(len(dims))], axis=1)
            first = np.array(table.column("centres")[0].as_py(), dtype=float)
            last, far = _settled(points, table.column("__load").to_numpy(), first, rounds, tolerance)
            return pa.table([*(pa.array([v.as_py()] * k, v.type) for v in key), pa.array(range(len(last)), pa.int32()),
                             *map(pa.array, np.ascontiguousarray(last.T)), pa.array([far] * len(last))], names=[f.name for f in told])

        told = T.StructType([*[data.schema[c] for c in keys], *[T.StructField(c, t) for c, t in (
            ("__nth", T.IntegerType()), *((f"__x{i}", T.DoubleType()) for i in range(len(dims))), ("__far", T.DoubleType()))]])
        rows = joined(centres).select(*keys, "centres", load.alias("__load"), *[F.col(d).cast("double").alias(f"__x{i}") for i, d in enumerate(dims)])
        far = 0.0
        for r in rows.groupBy(*keys).applyInArrow(run, told).collect():
            at[name(r)][-1][r["__nth"]] = [r[f"__x{i}"] for i in range(len(dims))]
            far = max(far, r["__far"])
        return far

    known = [*[F.col(d).cast("double") for d in dims], load]
    odd = F.max(reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in known]) | (load <= 0))
    if held and keys and at:
        most, strange = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), odd.alias("odd")).agg(F.max("n"), F.max("odd")).first()
        local = not strange and most * len(dims) * (k + 1) <= LOCAL
    else:
        local = False
    for _ in range(rounds):
        if local:
            moved = in_tasks()
            centres = df.sparkSession.createDataFrame(list(at.values()), schema)
        elif held:
            moved = 0.0
            for r in means(centres).collect():
                own = at[name(r)][-1]
                gaps = [abs(a - b) for a, b in zip(own[r["cluster"]], r["mean"]) if a is not None and b is not None]
                moved = max([moved, *gaps], key=lambda x: (x != x, x))
                own[r["cluster"]] = r["mean"]
            centres = df.sparkSession.createDataFrame(list(at.values()), schema)
        else:
            by = means(centres).groupBy(*keys, "centres").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))
            new = F.transform("centres", lambda c, i: F.coalesce(F.element_at("means", i), c))
            far = F.array_max(F.zip_with("centres", new, lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))))
            after = session.checkpoint(by.select(*keys, new.alias("centres"), far.alias("__moved")))
            centres = after.drop("__moved")
            moved = after.agg(F.max("__moved")).first()[0] or 0.0
        if moved <= tolerance:
            break
    else:
        raise ArithmeticError(f"centres still move after {rounds} passes")
    out = joined(centres).withColumn("__near", _nearest(dims))
    return out.select(*data.columns, F.col("__near.cluster").alias("cluster"), F.col("__near.d2").alias("d2")), centres


def safe_types(df: DataFrame, n: str, dims: Sequence[str], k: int, min_n: int, seed: int,
               min_share: float = 0.05, label: str = "type", keys: Sequence[str] = (), low: float = 0.01,
               high: float = 0.99) -> DataFrame:
    """Cluster entities with enough rows, lowering k until no cluster is tiny; others get -1.

    Each group of ``keys`` is clustered for itself, on dimensions winsorised at its quantiles ``low`` and ``high``
    and standardised, and on the logarithm of its rows likewise. k starts the same for every group; a group whose
    smallest cluster holds less than ``min_share`` of its rows, or that has fewer clusters in use, tries one less.
    """
    groups, own = list(keys), [f"__{d}" for d in (*dims, "volume")]
    df = session.checkpoint(df)  # read by the quantiles, the spread, the points and the rest
    big = df.filter(F.col(n) >= min_n).withColumns({
        **{f"__{d}": F.col(d).cast("double") for d in dims}, "__volume": F.log1p(F.col(n).cast("double"))})
    quantile = metric_quantiles(big, groups, own, {"lo": low, "hi": high})
    bounds = quantile.groupBy(*groups).agg(*[F.max(F.when(F.col("metric") == c, F.col(e))).alias(f"{c}_{e}") for c in own for e in ("lo", "hi")])
    join = lambda left, right: null_safe_join(left, right, groups) if groups else left.crossJoin(F.broadcast(right))
    capped = join(big, bounds).withColumns({c: F.greatest(F.least(F.col(c), F.col(f"{c}_hi")), F.col(f"{c}_lo")) for c in own})
    spread = capped.groupBy(*groups).agg(*[f(c).alias(f"{c}_{e}") for c in own for e, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = join(capped.drop(*[f"{c}_{e}" for c in own for e in ("lo", "hi")]), spread).withColumns({
        c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")), F.lit(0.0)) for c in own})
    left = session.checkpoint(scaled.drop(*[f"{c}_{e}" for c in own for e in ("m", "s")]).withColumn("__all", F.lit(0)))
    by = groups or ["__all"]
    rest = df.filter(F.coalesce(F.col(n) < min_n, F.lit(True))).withColumn(label, F.lit(-1))
    out = None
    for size in range(k, 0, -1):
        told, _ = grouped_kmeans(left, by, own, size, seed)
        told = session.checkpoint(told)
        cells = told.groupBy(*by, "cluster").agg(F.sum(n).alias("__c"))
        fine = cells.groupBy(*by).agg((F.min("__c") / F.sum("__c")).alias("__share"), F.count(F.lit(1)).alias("__used")).filter(
            (F.col("__used") == size) & (F.col("__share") >= min_share) | F.lit(size == 1)).select(*by)
        good = null_safe_join(told, fine, by, "left_semi").withColumn(label, F.col("cluster")).select(*df.columns, label)
        out = good if out is None else out.unionByName(good)
        left = session.checkpoint(null_safe_join(left, fine, by, "left_anti"))
        if left.isEmpty():
            break
    return out.unionByName(rest)


def cluster_features(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], hand: str,
                     clusters: Mapping[int, int], cohorts: Sequence[str]) -> DataFrame:
    """Availability, id with fallback, hand-by-cluster and cohort indicators per row."""
    out = small_join(rows, lookup, keys)
    known = F.col("cluster").isNotNull()
    made = {"cluster_available": known.cast("int"),
            "cluster_id": F.col(hand) * 100 + F.coalesce(F.col("cluster"), F.lit(99)),
            "cohort": F.coalesce(F.col("cohort"), F.lit("new"))}
    for h, k in clusters.items():
        for c in range(k):
            made[f"h{h}_c{c:02d}"] = F.coalesce((F.col(hand) == h) & (F.col("cluster") == c), F.lit(False)).cast("int")
    for v in cohorts:
        made[f"cohort_{v}"] = (F.coalesce(F.col("cohort"), F.lit("new")) == v).cast("int")
    made["cluster_log_size"] = F.log1p(F.col("cluster_size").cast("double"))
    return out.withColumns(made)


def config_scores(registry: DataFrame, key: str) -> DataFrame:
    """Screening score of cluster configurations over cutoffs, best first."""
    g = registry.groupBy(key).agg(
        F.countDistinct("cutoff").alias("cutoffs"), F.min("min_size").alias("min_size"),
        F.avg("silhouette").alias("silhouette"), F.avg("ari").alias("ari"), F.min("ari").alias("ari_min"))
    score = F.col("silhouette") + 0.25 * F.col("ari") + 0.02 * F.least(F.col("min_size"), F.lit(10))
    return g.withColumn("score", score).orderBy(F.desc("score"), key)


def profile_tokens(df: DataFrame, entity: str, cell: str, cells: int, channels: Mapping[str, Column],
                   strength: float) -> DataFrame:
    """Per entity an array of cells, each the doubly subtracted channel values and reliability.

    Array length is the fixed number of cells, so nothing unbounded is gathered.
    """
    table = None
    for name, y in channels.items():
        part = _double_subtracted(df.withColumn("__y", y), entity, cell, name, strength)
        table = part if table is None else table.join(part, [entity, cell], "full_outer")
    first = next(iter(channels))
    grid = table.select(entity).distinct().withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    full = grid.join(table, [entity, cell], "left")
    values = [F.coalesce(F.col(n), F.lit(0.0)) for n in channels] + [F.coalesce(F.col(f"{first}_rel"), F.lit(0.0))]
    return full.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col(cell).alias("cell"), F.array(*values).alias("v")))), lambda s: s["v"]).alias("tokens"))


def _double_subtracted(df: DataFrame, entity: str, cell: str, name: str, strength: float) -> DataFrame:
    from foretally.operators.eb import interaction
    out = interaction(df, entity, cell, "__y", strength)
    return out.select(entity, cell, F.col("inter").alias(name), F.col("rel").alias(f"{name}_rel"))
