"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's documents form blocks. Block j of a source of weight w is released at slot floor((j - 1) / w)
and due by slot ceil(j / w); in each slot, the released block with the earliest deadline goes next. No
source is ever a whole block ahead of or behind its weight, whatever the length of the mixture: both
are found from the exact weights. Blocks are planned on the driver, three numbers each, and documents
find their block in the plan. When a source runs out, a new phase begins, in which the others share the
slots by their weights, so no document is left out.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK = 32
#: Blocks of a source that a row of the plan holds.
PERIOD = 1000
#: Blocks of a plan that is sent to every executor; a longer one is shuffled.
SENT = 4_000_000
#: Deadlines beyond the largest long are that one.
LAST = (1 << 63) - 1
#: Sources that one mixture may have: the plan of the phases is held by the driver.
SOURCES = 4096
#: Documents ordered together, on average.
ROWS = 20_000


def rounded(weights: dict, period: int) -> dict:
    """Slots of a period for each source, to read a mixture by: proportional by largest remainder, at least one.

    No plan rests on them: slots are as exact as the period allows, weights are exact.
    """
    period = max(period, 2 * len(weights))
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total * period for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in share.items()}
    while (short := period - sum(slots.values())) != 0:
        step = 1 if short > 0 else -1
        free = [s for s in slots if step > 0 or slots[s] > 1]
        slots[max(free, key=lambda s: (step * (share[s] - slots[s]), str(s)))] += step
    return slots


def exact(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights; where all are zero, all the same."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    if any(r < 0 for r in ratios.values()):
        raise ValueError("negative weight")
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    whole = {s: int(r * scale) for s, r in ratios.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()} if common else dict.fromkeys(whole, 1)


def schedule(blocks: dict, weights: dict) -> dict:
    """(slots, releases, deadlines) of each source's blocks: earliest deadline first among released blocks.

    A phase lasts until a source has run out. Its releases and deadlines count from its first slot and
    are whole numbers found from the exact weights of the sources left, so errors do not add up.
    """
    left, now = {s: n for s, n in blocks.items() if n}, 0
    plan = {s: (array("q"), array("q"), array("q")) for s in blocks}
    while left:
        share = {s: w for s, w in exact({s: weights[s] for s in left}).items() if w}
        whole, start, out = sum(share.values()), now, None
        waiting = [(0, -(-whole // w), str(s), s, 1) for s, w in share.items()]
        heapq.heapify(waiting)
        ready = []
        while out is None:
            while waiting and waiting[0][0] <= now - start:
                release, due, name, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (due, name, s, j, release))
            due, _, s, j, release = heapq.heappop(ready)
            for column, value in zip(plan[s], (now, start + release, min(start + due, LAST))):
                column.append(value)
            now += 1
            if j == left[s]:
                out = s
            else:
                w = share[s]
                heapq.heappush(waiting, (j * whole // w, -(-(j + 1) * whole // w), str(s), s, j + 1))
        # What the others took in this phase is no longer left to them.
        left = {s: blocks[s] - len(plan[s][0]) for s in left if s != out}
    return plan


def _plan_table(spark: SparkSession, plan: dict, size: int) -> DataFrame:
    """(of, run, slots, releases, deadlines): the plan, ``size`` blocks of a source to a row."""
    cuts = [(s, i) for s, columns in plan.items() for i in range(0, len(columns[0]), size)]
    held = [pa.array([np.frombuffer(plan[s][c], np.int64)[i:i + size] for s, i in cuts], pa.list_(pa.int64()))
            for c in range(3)]
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array([s for s, _ in cuts], pa.string()), pa.array([i // size for _, i in cuts], pa.int64()), *held],
        names=["of", "run", "slots", "releases", "deadlines"]))


def _numbered(docs: DataFrame, group: str) -> DataFrame:
    """Add rank: place in a repeatable shuffled order of each group by ``code``, found without gathering a group."""
    total = docs.count()
    parts = max(1, total // ROWS)
    spread = docs.withColumn("part", F.pmod("code", F.lit(parts)))
    sizes = spread.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy(group, "part").orderBy("code")
    return (spread.join(sizes, [group, "part"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("before"))
            .drop("part", "before"))


def mixed_order(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block: int = BLOCK,
                period: int = PERIOD) -> DataFrame:
    """``docs`` with block, slot, release, deadline and position columns: its order in the mixture.

    Needs doc_id, text and source. Sources without a given weight take their number of documents to
    ``power`` (weights tempered towards equality). block is the source's block, slot its place among
    all blocks, release and deadline the slots between which it was due, position the document's order.
    Every document is kept once; a null source is a source of its own; rows of equal doc_id and text follow
    each other; columns of the added names are replaced. Sources of weight zero come after all others. The plan
    is handed out ``period`` blocks of a source at a time. An empty table gives an empty result. More than
    ``SOURCES`` sources, or a negative or infinite weight, raise an error.
    """
    added = ("block", "slot", "release", "deadline", "position")
    kept = [c for c in docs.columns if c not in added]
    # The caller's columns stand in one struct, so none of their names meets one of ours. The code follows
    # all of a row, so rows without doc_id, or of one doc_id, are spread like others.
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
                       F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")).alias("origin"),
                       F.xxhash64("doc_id", "text", F.lit(3)).alias("code"))
    counts = {r["origin"]: r["n"] for r in base.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    given = {("0" if s is None else f"1{s}"): w for s, w in (weights or {}).items()}
    weight = {s: given.get(s, n ** power) for s, n in counts.items()}
    plan = schedule({s: -(-n // block) for s, n in counts.items()}, weight)
    table = _plan_table(docs.sparkSession, plan, period)
    ranked = _numbered(base, "origin").withColumn("block", F.floor(F.col("rank") / block))
    # The plan has each block once; beyond the bound both sides are shuffled, a row's blocks at a time.
    small = sum(len(slots) for slots, _, _ in plan.values()) <= SENT
    found = ranked.join(F.broadcast(table) if small else table,
                        (F.col("origin") == F.col("of")) & (F.floor(F.col("block") / period) == F.col("run")))
    at = (F.col("block") % period + 1).cast("int")
    slot = F.element_at("slots", at)
    return found.select(*(F.col("row").getField(c).alias(c) for c in kept), "block", slot.alias("slot"),
                        F.element_at("releases", at).alias("release"), F.element_at("deadlines", at).alias("deadline"),
                        (slot * block + F.col("rank") % block).alias("position"))
