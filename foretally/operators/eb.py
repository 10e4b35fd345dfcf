"""Empirical-Bayes tables: shrunken means of keys, and differences along nested keys.

Every function takes rows already restricted to the fit period. Counts and 0/1 sums are
reduced on the map side, so a hot key costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foretally import session
from foretally.functions.rates import clip, eb, half_life, ratio, reliability
from foretally.operators import blocks
from foretally.operators.joins import small_join
from foretally.operators.ordered import by_value
from foretally.operators.ranks import metric_quantiles


def not_null(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def mean_of(df: DataFrame, y: Column | str) -> Column:
    """Mean as a scalar subquery."""
    return df.agg(F.avg(F.col(y) if isinstance(y, str) else y)).scalar()


def cells(df: DataFrame, keys: Sequence[str], y: str, keep_null: bool = False) -> DataFrame:
    """Sum ``s`` and count ``n`` of known targets per key."""
    rows = df if keep_null else df.filter(not_null(keys))
    return rows.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.sum(y).alias("s"), F.count(y).alias("n"))


def nested_split(df: DataFrame, upper: Sequence[str], lower: Sequence[str], y: str,
                 strength: float, prior: Column | None = None) -> DataFrame:
    """EB(lower) - EB(upper) and reliability per lower key; upper keys nest in lower keys.

    One scan: the upper table is summed from the lower cells.
    """
    mu = mean_of(df, y) if prior is None else prior
    low = cells(df, lower, y)
    up = low.groupBy(*upper).agg(F.sum("s").alias("us"), F.sum("n").alias("un"))
    return (low.join(up, list(upper)).select(
        *lower, (eb("s", "n", strength, mu) - eb("us", "un", strength, mu)).alias("split"),
        reliability("n", strength).alias("rel")))


def component_splits(df: DataFrame, entity: str, context: str, y: str,
                     components: Mapping[str, Column], strength: float) -> DataFrame:
    """Nested split of the target and of each 0/1 component, NULL labels left out."""
    parts = {"y": F.col(y), **components}
    measures = []
    for t, c in parts.items():
        measures += [F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{t}"), F.count(c).alias(f"n_{t}")]
    low = df.filter(not_null([entity, context])).groupBy(entity, context).agg(*measures)
    up = low.groupBy(entity).agg(*[F.sum(f"{m}_{t}").alias(f"u{m}_{t}")
                                  for t in parts for m in ("s", "n")])
    mu = {t: mean_of(df, c) for t, c in parts.items()}
    out = low.join(up, entity)
    made = [entity, context]
    for t in parts:
        gap = eb(f"s_{t}", f"n_{t}", strength, mu[t]) - eb(f"us_{t}", f"un_{t}", strength, mu[t])
        known = F.col(f"n_{t}") > 0
        made.append(F.when(known, gap).alias("split" if t == "y" else f"split_{t}"))
    made.append(reliability("n_y", strength).alias("rel"))
    return out.select(*made)


def interaction(df: DataFrame, a: str, b: str, y: str, strength: float) -> DataFrame:
    """EB(a,b) - EB(a) - EB(b) + mean: the part of a pair not explained by either side."""
    mu = mean_of(df, y)
    pair = cells(df, [a, b], y)
    left = pair.groupBy(a).agg(F.sum("s").alias("sa"), F.sum("n").alias("na"))
    right = pair.groupBy(b).agg(F.sum("s").alias("sb"), F.sum("n").alias("nb"))
    return (pair.join(left, a).join(right, b).select(
        a, b, (eb("s", "n", strength, mu) - eb("sa", "na", strength, mu)
               - eb("sb", "nb", strength, mu) + mu).alias("inter"),
        reliability("n", strength).alias("rel")))


def crossed_deviation(df: DataFrame, lower: Sequence[str], upper: Sequence[str], y: str,
                      strength: float) -> DataFrame:
    """EB(lower) - EB(upper) for keys that need not nest, per pair seen in the rows."""
    mu = mean_of(df, y)
    keys = list(dict.fromkeys([*lower, *upper]))
    base = cells(df, keys, y)
    low = base.groupBy(*lower).agg(F.sum("s").alias("ls"), F.sum("n").alias("ln"))
    up = base.groupBy(*upper).agg(F.sum("s").alias("us"), F.sum("n").alias("un"))
    return (base.select(*keys).join(low, list(lower)).join(up, list(upper)).select(
        *keys, (eb("ls", "ln", strength, mu) - eb("us", "un", strength, mu)).alias("deviation"),
        reliability("ln", strength).alias("rel")))


def axis_splits(df: DataFrame, entity: str, axes: Sequence[str], y: str,
                strength: float) -> DataFrame:
    """Nested splits along several axes in long form, from one unpivoted aggregation."""
    long = df.select(entity, y, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot(
        [entity, y], list(axes), "axis", "level")
    mu = mean_of(df, y)
    low = cells(long, [entity, "axis", "level"], y)
    up = low.groupBy(entity, "axis").agg(F.sum("s").alias("us"), F.sum("n").alias("un"))
    split = eb("s", "n", strength, mu) - eb("us", "un", strength, mu)
    rel = reliability("n", strength)
    return low.join(up, [entity, "axis"]).select(
        entity, "axis", "level", split.alias("split"), rel.alias("rel"),
        (split * rel).alias("split_w"))


def screened_axes(df: DataFrame, splits: DataFrame, entity: str, axes: Sequence[str],
                  floor: float, min_rel: float = 0.5, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Spread and outer percentiles of each axis over rows with reliable splits, and whether it clears the floor."""
    long = df.select(entity, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot(
        [entity], list(axes), "axis", "level")
    weights = long.groupBy(entity, "axis", "level").count()
    rows = session.checkpoint(weights.join(splits, [entity, "axis", "level"]).filter(F.col("rel") > min_rel))
    n, x = F.col("count"), F.col("split")
    out = rows.groupBy("axis").agg(F.sum("count").alias("n_rows"), F.sum(n * x).alias("__s"),
                                   F.sum(n * x * x).alias("__q"))
    sd = F.sqrt(F.greatest(F.col("__q") / F.col("n_rows")
                           - F.pow(F.col("__s") / F.col("n_rows"), 2), F.lit(0.0)))
    # Rows stand as counts of distinct splits; a percentile lies between the two values around its place.
    cells = rows.groupBy("axis", "split").agg(F.sum("count").alias("n"))
    ranked = by_value(cells, ["axis"], "split").running({"below": F.col("n")}, totals={"t": F.col("n")}).df
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("split")))
    picks = []
    for name, p in (("p_low", low), ("p_high", high)):
        spot = F.lit(p) * (F.col("t") - 1)
        picks += [at(F.floor(spot)).alias(f"{name}_a"), at(F.least(F.floor(spot) + 1, F.col("t") - 1)).alias(f"{name}_b"),
                  F.max(spot - F.floor(spot)).alias(f"{name}_f")]
    ends = ranked.groupBy("axis").agg(*picks)
    return out.join(ends, "axis").select(
        "axis", "n_rows", sd.alias("sd"), (sd > floor).cast("int").alias("kept"),
        *[(F.col(f"{e}_a") + F.col(f"{e}_f") * (F.col(f"{e}_b") - F.col(f"{e}_a"))).alias(e) for e in ("p_low", "p_high")])


def shrink_table(df: DataFrame, keys: Sequence[str], residual: str, y: str, strength: float,
                 weight: Column | None = None, keep_null: bool = False) -> DataFrame:
    """Weighted residual sum over (weight + strength), reliability, weighted rate, raw n."""
    w = F.lit(1.0) if weight is None else weight
    rows = df if keep_null else df.filter(not_null(keys))
    out = rows.groupBy(*keys).agg(
        F.sum(w * F.col(residual)).alias("wr"), F.sum(w * F.col(y)).alias("wy"),
        F.sum(w).alias("w"), F.count(F.lit(1)).alias("raw_n"))
    return out.select(*keys, (F.col("wr") / (F.col("w") + strength)).alias("value"),
                      reliability("w", strength).alias("rel"),
                      ratio("wy", "w").alias("rate"), F.col("w").alias("weight_n"), "raw_n")


def context_residual(df: DataFrame, y: str, mode: str, season: str,
                     context: Sequence[str] = (), asof: str | None = None) -> DataFrame:
    """Residual of the target against a reference: season mean, season-context mean, or an
    as-of rate that falls back to the season mean; references bounded to [.01, .99]."""
    season_mean = df.groupBy(season).agg(F.avg(y).alias("__season"))
    out = small_join(df, season_mean, [season])
    if mode == "season":
        ref = F.col("__season")
    elif mode == "context":
        keys = [season, *context]
        out = small_join(out, df.groupBy(*keys).agg(F.avg(y).alias("__ctx")), keys)
        ref = F.coalesce(F.col("__ctx"), F.col("__season"))
    elif mode == "asof":
        ref = F.coalesce(F.col(asof), F.col("__season"))
    else:
        raise ValueError(f"unknown mode {mode}")
    bounded = clip(ref, 0.01, 0.99)
    return out.withColumn("reference", bounded).withColumn(
        "residual", F.col(y) - F.col("reference")).drop("__season", "__ctx")


def leave_one_out(df: DataFrame, keys: Sequence[str], y: str, season: str, m: float,
                  name: str = "loo") -> DataFrame:
    """Mean of the key without the row itself, shrunk to the season mean.

    Key totals are aggregated and joined back instead of a window over raw groups.
    """
    total = cells(df, keys, y, keep_null=True)
    season_mean = df.groupBy(season).agg(F.avg(y).alias("__mu"))
    out = small_join(small_join(df, total, keys), season_mean, [season])
    return out.withColumn(name, (F.col("s") - F.col(y) + F.lit(m) * F.col("__mu"))
                          / (F.col("n") - 1 + m)).drop("s", "n", "__mu")


def group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group aggregates attached to every row through a joined table."""
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return small_join(df, table, keys)


def logit_offset(df: DataFrame, keys: Sequence[str], y: str, p: str, strength: float,
                 min_n: int, scale: float = 1.0, weight: Column | None = None) -> DataFrame:
    """Newton step of a per-key logit offset, shrunk by n and zero below ``min_n`` rows."""
    w = F.lit(1.0) if weight is None else weight
    out = df.filter(not_null(keys)).groupBy(*keys).agg(
        F.sum(w * (F.col(y) - F.col(p))).alias("g"),
        F.sum(w * F.col(p) * (1 - F.col(p))).alias("h"), F.count(F.lit(1)).alias("n"))
    step = ratio("g", "h") * reliability("n", strength) * F.lit(scale)
    return out.select(*keys, "n", F.when(F.col("n") >= min_n, step).otherwise(0.0).alias("offset"))


def entity_logit_shift(df: DataFrame, entity: str, y: str, p: str, strength: float,
                       min_n: int = 30, bound: float = 1.0) -> DataFrame:
    """Mean residual of an entity turned into a bounded logit shift."""
    out = df.groupBy(entity).agg(F.sum(F.col(y) - F.col(p)).alias("r"), F.avg(p).alias("mp"),
                                 F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    shift = reliability("n", strength) * ratio(
        F.col("r") / F.col("n"), F.col("mp") * (1 - F.col("mp")))
    return out.select(entity, "n", clip(shift, -bound, bound).alias("shift"))


#: Share of an entity's own sum that pairs of far blocks, all together, may leave out.
FAR = 1e-12


def _near_pairs(blocked: DataFrame, dims: int, bandwidth: float) -> DataFrame:
    """Pairs of blocks that are not proven to be too far apart to matter.

    The weights between two blocks are at most that of their boxes' distance; those inside a block at least
    that of its box's diagonal. A pair goes if its greatest weight, given to everything there is, is below
    ``FAR`` of the least that every point of either block gets from its own block.
    """
    scale = 2.0 * bandwidth * bandwidth
    ends = [f(F.get("v", i)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    mass = F.greatest(F.col("n"), F.abs("s"))
    boxes = session.checkpoint(blocked.groupBy("block").agg(*ends, (F.sum("n") - F.max("n")).alias("rest"), F.sum(mass).alias("mass")))
    total = boxes.agg(F.sum("mass")).first()[0] or 0.0
    square = lambda terms: sum((t * t for t in terms), F.lit(0.0))
    own = F.exp(-square([F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dims)]) / scale) * F.col("rest")
    boxes = boxes.withColumn("own", own)
    side = lambda name: boxes.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in boxes.columns if c != "block"])
    pairs = blocks.pairs_of_blocks(boxes).join(side("i"), "i").join(side("j"), "j")
    gap = [F.greatest(F.col(f"i_lo{d}") - F.col(f"j_hi{d}"), F.col(f"j_lo{d}") - F.col(f"i_hi{d}"), F.lit(0.0)) for d in range(dims)]
    most = F.exp(-square(gap) / scale) * F.lit(float(total))
    return pairs.filter((F.col("i") == F.col("j")) | (most > FAR * F.least("i_own", "j_own"))).select("i", "j")


def kernel_neighbours(profiles: DataFrame, entity: str, dims: Sequence[str], s: str, n: str,
                      bandwidth: float, strength: float, chunk: int = 2048) -> DataFrame:
    """Shrink each entity to the Gaussian-weighted rate of the other entities.

    Profiles are winsorised at 1/99 % and standardised. Entities stand in blocks of neighbours in space;
    each pair of blocks is worked through once for both sides, and pairs too far apart to change any sum by
    ``FAR`` of it are left out. ``n`` must not be negative; memory is bounded by the block.
    """
    profiles = session.checkpoint(profiles.select(entity, s, n, *dims))
    bounds = {r["metric"]: (r["lo"], r["hi"]) for r in metric_quantiles(
        profiles, [], dims, {"lo": 0.01, "hi": 0.99}).collect()}
    capped = profiles.select(entity, s, n, *[clip(F.col(d), *bounds[d]).alias(d) for d in dims])
    row = capped.agg(*[F.avg(d).alias(f"m_{d}") for d in dims],
                     *[F.stddev_pop(d).alias(f"s_{d}") for d in dims]).first()
    vec = F.array(*[F.coalesce((F.col(d) - F.lit(row[f"m_{d}"])) / F.lit(row[f"s_{d}"] or 1.0), F.lit(0.0))
                    for d in dims])
    points = capped.select(F.col(entity).alias("id"), F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias("s"),
                           F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("n"), vec.alias("v"))
    size = blocks.even_size(profiles.count(), chunk, profiles.sparkSession.sparkContext.defaultParallelism)
    blocked = blocks.in_blocks(points, "id", "v", size)
    scale = 2.0 * bandwidth * bandwidth

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                sides = [one.column(name) for name in ("left", "right")]
                a, b = (blocks.columns(x, ("s", "n"), "v") for x in sides)
                w = np.exp(-blocks.squared_gaps(a["v"], b["v"]) / scale)
                same = one.column("i")[0] == one.column("j")[0]
                if same:
                    np.fill_diagonal(w, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [sides[0].flatten().field("id"), pa.array(w @ b["s"]), pa.array(w @ b["n"])], names=["id", "ws", "wn"])
                if not same:
                    yield pa.RecordBatch.from_arrays(
                        [sides[1].flatten().field("id"), pa.array(a["s"] @ w), pa.array(a["n"] @ w)], names=["id", "ws", "wn"])

    met = blocks.facing(_near_pairs(blocked, len(dims), bandwidth), blocks.packed(blocked, ["id", "s", "n", "v"])).mapInArrow(
        run, f"id {profiles.schema[entity].dataType.simpleString()}, ws double, wn double")
    near = met.groupBy("id").agg(F.sum("ws").alias("ws"), F.sum("wn").alias("wn"))
    mu = near.join(capped.select(F.col(entity).alias("id"), s, n), "id").withColumn("mu", ratio("ws", "wn"))
    return mu.select(F.col("id").alias(entity), "mu", (eb(s, n, strength, F.col("mu")) - F.col("mu")).alias("dev"))


def recency_weight(season: str, target: int | Column, life: float) -> Column:
    t = F.lit(target) if isinstance(target, int) else target
    return half_life(t - F.col(season), life)
