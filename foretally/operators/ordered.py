"""Past-only window work that stays balanced when one group holds most of the rows.

``History`` adds running totals, positions and trailing frames inside groups. Group sizes
are measured first. While every group is small the plan is one window per group. When a
group exceeds the hot threshold, all groups are cut into blocks along their order:
unbounded totals are the total of earlier blocks (a window over one row per group and
block) plus a window inside the block, and bounded frames run over blocks of consecutive
positions that also carry the last rows of the block before. Both ways give the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from foretally import session
from foretally.operators.joins import null_safe_join
from foretally.roles import Order

BLOCK, SLICE, HALO, GROUP = "__cut_block", "__cut_slice", "__cut_halo", "__cut_group"
#: Sampled rows for each block, and blocks for each full one, so that sampling leaves none above the limit.
SAMPLED, FINER = 64, 2
#: Cuts up to which a row's block is found by halving them in one expression.
HALVED = 512

Cut = tuple[str | None, ...]


def hot_cuts(df: DataFrame, keys: Sequence[str], order: Order, limit: int) -> list[Cut] | None:
    """Order tuples (as text) that cut hot groups into blocks, or None when no group is hot.

    The tuples are quantiles of a sample of the hot groups' rows, so they follow every order
    column: equal first columns, long common prefixes and any size of number are cut alike.
    """
    return measured_cuts(df, keys, order, limit)[0]


def measured_cuts(df: DataFrame, keys: Sequence[str], order: Order, limit: int) -> tuple[list[Cut] | None, int]:
    """The cuts of ``hot_cuts``, and how many rows all groups hold."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > limit)
    every, total = sizes.agg(F.sum("__n"), F.sum(F.when(F.col("__n") > limit, F.col("__n")))).first()
    if not total:
        return None, every or 0
    rows = null_safe_join(df, hot, keys, "left_semi") if keys else df
    blocks = math.ceil(FINER * total / limit)
    share = min(1.0, SAMPLED * blocks / total)
    drawn = rows.filter(F.rand(7) < share).select(*order.cols)
    # The sample has a bounded number of rows for each block; its quantiles are one row for each.
    turn = Window.orderBy(*order.columns())
    step = max(1, round(total * share / blocks))
    picked = drawn.withColumn("__at", F.row_number().over(turn)).filter(F.col("__at") % step == 0)
    return [tuple(r) for r in picked.orderBy("__at").select(*[F.col(c).cast("string") for c in order.cols]).collect()], every


def assign_block(df: DataFrame, order: Order, cuts: Sequence[Cut]) -> DataFrame:
    """Number the block of each row: the cuts at or before it, monotone along the order."""
    if not cuts:
        return df.withColumn(BLOCK, F.lit(0))
    row = F.struct(*order.cols)
    wide = math.isqrt(len(cuts)) + 1
    runs = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]

    def tuples(nested: list | dict, depth: int) -> Column:
        """One constant for any number of cuts: read as text, cast to the columns' types."""
        text = T.StructType([T.StructField(c, T.StringType()) for c in order.cols])
        own = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order.cols])
        for _ in range(depth):
            text, own = T.ArrayType(text), T.ArrayType(own)
        return F.from_json(F.lit(json.dumps(nested)), text).cast(own)

    def named(cut: Cut) -> dict[str, str | None]:
        return dict(zip(order.cols, cut))

    if len(cuts) <= HALVED:
        def halved(low: int, high: int) -> Column:
            """How many cuts are at or before the row, where at least ``low`` and at most ``high`` are."""
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(row < tuples(named(cuts[middle]), 0), halved(low, middle)).otherwise(halved(middle + 1, high))

        return df.withColumn(BLOCK, halved(0, len(cuts)))
    # First the run of cuts, then the place in it.
    run = F.size(F.filter(tuples([named(r[0]) for r in runs], 1), lambda e: e <= row))
    mine = F.element_at(tuples([[named(c) for c in r] for r in runs], 2), F.greatest(run, F.lit(1)))
    inside = F.size(F.filter(mine, lambda e: e <= row))
    return df.withColumn(BLOCK, F.greatest(run - 1, F.lit(0)) * wide + inside)


class History:
    """Rows with an order inside groups, to which past-only columns are added.

    Group sizes are measured on the rows the first step started from, so regrouping does not
    run the steps in between again. Without a hot group, rows are dealt by key to as many tasks as
    their number needs (``spark.foretally.taskRows``); finer keys stay on those tasks.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Order,
                 hot_rows: int | None = None, cuts: list[Cut] | None | str = "measure",
                 base: DataFrame | None = None, dealt: Sequence[str] = ()):
        self.df, self.keys, self.order = df, list(keys), order
        self.base = df if base is None else base
        self.limit = hot_rows or session.hot_rows(df.sparkSession)
        self.cuts, self.dealt = cuts, list(dealt)
        if cuts != "measure":
            return
        self.cuts, rows = measured_cuts(self.base, self.keys, order, self.limit)
        tasks = session.tasks_for(df.sparkSession, rows)
        there = self.dealt and set(self.dealt) <= set(self.keys)
        if self.cuts is None and self.keys and tasks > 1 and not there:
            self.df, self.dealt = df.repartition(tasks, *[F.col(k) for k in self.keys]), self.keys

    def replace(self, df: DataFrame) -> "History":
        """The same keys and order over a frame with more columns."""
        return History(df, self.keys, self.order, self.limit, self.cuts, self.base, self.dealt)

    def regroup(self, keys: Sequence[str]) -> "History":
        """The same rows and order under other keys, which the starting rows must have."""
        return History(self.df, keys, self.order, self.limit, base=self.base, dealt=self.dealt)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order.columns())

    def _blocks(self) -> DataFrame:
        """Rows with their block and one group key; struct fields compare NULL equal NULL."""
        key = F.struct(*self.keys) if self.keys else F.struct(F.lit(0).alias("all"))
        return assign_block(self.df, self.order, self.cuts).withColumn(GROUP, key)

    def _scan(self, inside: Mapping[str, Column], cells: Mapping[str, Column],
              carry: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
              last: int) -> DataFrame:
        """Window columns inside blocks joined with what earlier blocks contribute.

        The window and the join share one partitioning by group and block, so rows are
        shuffled once; the carried table holds one row per group and block.
        """
        rows = self._blocks()
        table = rows.groupBy(GROUP, BLOCK).agg(*[e.alias(n) for n, e in cells.items()])
        earlier = (Window.partitionBy(GROUP).orderBy(BLOCK)
                   .rowsBetween(Window.unboundedPreceding, -1))
        whole = Window.partitionBy(GROUP)
        table = table.select(GROUP, BLOCK, *[
            e.alias(n) for n, e in carry(earlier, whole).items()])
        frame = (Window.partitionBy(GROUP, BLOCK).orderBy(*self.order.columns())
                 .rowsBetween(Window.unboundedPreceding, last))
        local = rows.withColumns({n: e.over(frame) for n, e in inside.items()})
        return local.join(table, [GROUP, BLOCK])

    def running(self, sums: Mapping[str, Column | str], inclusive: bool = False,
                totals: Mapping[str, Column] | None = None) -> "History":
        """Add the sum of each measure over strictly earlier rows (0 before the first).

        ``totals`` adds sums over the whole group under the same partitioning.
        """
        sums = {n: (F.col(e) if isinstance(e, str) else e) for n, e in sums.items()}
        totals = dict(totals or {})
        last = 0 if inclusive else -1
        if self.cuts is None:
            frame = self.window.rowsBetween(Window.unboundedPreceding, last)
            whole = Window.partitionBy(*self.keys)
            return self.replace(self.df.withColumns({
                **{n: F.coalesce(F.sum(e).over(frame), F.lit(0)) for n, e in sums.items()},
                **{n: F.sum(e).over(whole) for n, e in totals.items()}}))
        out = self._scan(
            {n: F.sum(e) for n, e in sums.items()},
            {f"__c_{n}": F.sum(e) for n, e in {**sums, **totals}.items()},
            lambda earlier, whole: {
                **{f"__c_{n}": F.sum(f"__c_{n}").over(earlier) for n in sums},
                **{n: F.sum(f"__c_{n}").over(whole) for n in totals}}, last)
        zero = F.lit(0)
        return self.replace(out.withColumns({
            n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"__c_{n}"), zero) for n in sums}
        ).drop(GROUP, BLOCK, *[f"__c_{n}" for n in sums]))

    def position(self, name: str = "seq", size: str | None = None) -> "History":
        """Add the 0-based position of the row in its group, and the group's size where it is named."""
        sizes = {size: F.lit(1).cast("long")} if size else {}
        if self.cuts is None:
            whole = Window.partitionBy(*self.keys)
            return self.replace(self.df.withColumns({
                name: (F.row_number().over(self.window) - 1).cast("long"),
                **{n: F.sum(e).over(whole) for n, e in sizes.items()}}))
        return self.running({name: F.lit(1).cast("long")}, totals=sizes)

    def frames(self, back: int, build: Callable[[WindowSpec], Mapping[str, Column]],
               ahead: int = 0) -> "History":
        """Add columns whose frames reach at most ``back`` rows back and ``ahead`` rows on.

        ``build`` receives the ordered window and returns named columns such as
        ``lag(c, 1).over(w)`` or ``avg(c).over(w.rowsBetween(-20, -1))``.
        """
        if self.cuts is None:
            return self.replace(self.df.withColumns(dict(build(self.window))))
        span = max(self.limit, back, ahead)
        seq = self.position("__cut_seq").df.withColumn(
            SLICE, F.floor(F.col("__cut_seq") / span).cast("long"))
        inside = F.col("__cut_seq") - F.col(SLICE) * span
        copies = F.filter(F.array(
            F.lit(0),
            F.when(inside >= span - back, 1),
            F.when((inside < ahead) & (F.col(SLICE) > 0), -1)), lambda c: c.isNotNull())
        spread = (seq.withColumn("__cut_to", F.explode(copies))
                  .withColumn(SLICE, F.col(SLICE) + F.col("__cut_to"))
                  .withColumn(HALO, F.col("__cut_to") != 0).drop("__cut_to"))
        w = Window.partitionBy(*self.keys, SLICE).orderBy("__cut_seq")
        out = spread.withColumns(dict(build(w))).filter(~F.col(HALO))
        return self.replace(out.drop("__cut_seq", SLICE, HALO))

    def last_known(self, columns: Mapping[str, Column], inclusive: bool = True) -> "History":
        """Add the latest non-null value of each expression up to the row."""
        last = 0 if inclusive else -1
        if self.cuts is None:
            frame = self.window.rowsBetween(Window.unboundedPreceding, last)
            return self.replace(self.df.withColumns(
                {n: F.last(e, ignorenulls=True).over(frame) for n, e in columns.items()}))
        place = F.struct(*self.order.cols)
        out = self._scan(
            {n: F.last(e, ignorenulls=True) for n, e in columns.items()},
            {f"__c_{n}": F.max_by(e, F.when(e.isNotNull(), place)) for n, e in columns.items()},
            lambda earlier, _: {f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(earlier)
                                for n in columns}, last)
        return self.replace(out.withColumns(
            {n: F.coalesce(n, f"__c_{n}") for n in columns}).drop(
                GROUP, BLOCK, *[f"__c_{n}" for n in columns]))

    def running_max(self, name: str, value: Column) -> "History":
        """Add the maximum over strictly earlier rows (NULL before the first)."""
        if self.cuts is None:
            frame = self.window.rowsBetween(Window.unboundedPreceding, -1)
            return self.replace(self.df.withColumn(name, F.max(value).over(frame)))
        out = self._scan({name: F.max(value)}, {"__m": F.max(value)},
                         lambda earlier, _: {"__m": F.max("__m").over(earlier)}, -1)
        return self.replace(out.withColumn(name, F.greatest(F.col(name), F.col("__m"))).drop(
            GROUP, BLOCK, "__m"))


def value_cells(df: DataFrame, keys: Sequence[str], value: str,
                sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value with its count and optional sums."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in (sums or {}).items()])


def by_value(cells: DataFrame, keys: Sequence[str], value: str,
             hot_rows: int | None = None) -> History:
    """Order value cells by the value itself (totals inside a group follow the value)."""
    return History(cells, keys, Order((value,)), hot_rows)
