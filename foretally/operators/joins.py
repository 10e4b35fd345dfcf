"""Equi-joins with pandas-like key semantics and checked cardinality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foretally import session


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; the result keeps the left keys."""
    if not keys:
        raise ValueError("keys must not be empty")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b,
                [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(
        *[f"__r_{k}" for k in keys])


def row_bytes(table: DataFrame) -> Column:
    """About how many bytes a row of ``table`` takes when it is sent."""
    size = F.lit(16)
    for f in table.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        size = size + (F.length(F.coalesce(F.to_json(F.struct(f.name)), F.lit(""))) if text else F.lit(8))
    return size


def sized(table: DataFrame) -> DataFrame:
    """Store a lookup table once and broadcast it only if its measured size is small.

    The table is cut through the checkpoint folder, so measuring it does not compute it
    twice. A larger table is returned without a hint: the join then shuffles both sides and
    adaptive execution splits skewed keys.
    """
    kept = session.checkpoint(table)
    total = kept.agg(F.sum(row_bytes(kept))).first()[0] or 0
    return F.broadcast(kept) if total <= session.broadcast_bytes(table.sparkSession) else kept


def small_join(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe left join of many rows with a table that is usually small."""
    return null_safe_join(rows, sized(table), keys)


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str],
                defaults: Mapping[str, Any] | None = None,
                null_safe: bool = False) -> DataFrame:
    """Left join a keyed table and fill unmatched values; rows are not shuffled when the
    measured table is small."""
    table = sized(table)
    joined = (null_safe_join(rows, table, keys) if null_safe
              else rows.join(table, list(keys), "left"))
    if not defaults:
        return joined
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def salted_lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str],
                       row_id: Sequence[str], salts: int) -> DataFrame:
    """Left join for keys known to be hot: rows spread over ``salts`` copies of the table."""
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "__salt"], "left").drop("__salt")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   validate: str = "many_to_one", how: str = "left") -> DataFrame:
    """Join after proving the declared cardinality; raises on violation."""
    checks = {"many_to_one": [("right", right)],
              "one_to_many": [("left", left)],
              "one_to_one": [("left", left), ("right", right)]}[validate]
    for name, side in checks:
        if not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"{name} side is not unique on {list(keys)} ({validate})")
    return left.join(right, list(keys), how)


def season_version_join(rows: DataFrame, versions: DataFrame, entity: str, season: str,
                        cutoff: str = "cutoff",
                        flag: str = "available") -> DataFrame:
    """As-of join: a row of season S reads the table built with cutoff S."""
    table = sized(versions.withColumnRenamed(cutoff, season).withColumn(f"__{flag}", F.lit(1)))
    return (rows.join(table, [entity, season], "left")
            .withColumn(flag, F.coalesce(f"__{flag}", F.lit(0))).drop(f"__{flag}"))


def spread_to_cutoffs(cells: DataFrame, season: str, cutoffs: Sequence[int]) -> DataFrame:
    """Copy every season cell to each later cutoff (strictly past evidence).

    Meant for tables already aggregated to one row per entity and season, so a row is
    copied at most ``len(cutoffs)`` times and raw events never are.
    """
    later = F.filter(F.array(*[F.lit(int(c)) for c in sorted(cutoffs)]),
                     lambda c: c > F.col(season))
    return cells.withColumn("cutoff", F.explode(later))


def assemble_blocks(base: DataFrame, blocks: Sequence[DataFrame], row_id: str) -> DataFrame:
    """Attach feature blocks by unique row id; names must not collide."""
    seen = set(base.columns)
    out = base
    for block in blocks:
        names = [c for c in block.columns if c != row_id]
        clash = seen.intersection(names)
        if clash:
            raise ValueError(f"duplicate feature names: {sorted(clash)}")
        seen.update(names)
        out = validated_join(out, block, [row_id], "one_to_one")
    return out


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
