"""Bucketing, codes and keys as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def digitize(col: Column, edges: Sequence[float], null_last: bool = True) -> Column:
    """Left-closed bucket number; NULL goes to the last bucket unless told otherwise."""
    out = F.when(col.isNull(), F.lit(len(edges)) if null_last else F.lit(None))
    for i, edge in enumerate(edges):
        out = out.when(col < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def cut(col: Column, edges: Sequence[float], labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Right-closed labelled intervals between consecutive edges; outside is NULL."""
    low = (col >= edges[0]) if include_lowest else (col > edges[0])
    out = None
    for label, edge in zip(labels, edges[1:]):
        hit = low & (col <= edge)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def three_way_count(balls: Column, strikes: Column) -> Column:
    """0 when strikes lead, 1 when level, 2 when balls lead."""
    return F.when(strikes > balls, 0).when(balls > strikes, 2).otherwise(1)


def six_way_count(balls: Column, strikes: Column) -> Column:
    """Count classes; when several rules hold the later one decides."""
    behind = (strikes < balls) & (balls != 3)
    return (F.when(behind, 5)
            .when((balls == 3) & (strikes == 2), 4)
            .when(balls == 3, 3)
            .when(strikes == 2, 2)
            .when(strikes > balls, 1)
            .otherwise(0))


def mixed_radix(parts: Sequence[tuple[Column, int]], first: Column) -> Column:
    """One integer from a leading digit and (digit, base) pairs."""
    code = first.cast("long")
    for digit, base in parts:
        code = code * base + digit.cast("long")
    return code


def group_key(cols: Sequence[str], missing: str = "__MISSING__", sep: str = "\x1f") -> Column:
    """Text key of several columns in which NULL is an ordinary value."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(missing))
                              for c in cols])


def missing_mask(cols: Sequence[str]) -> Column:
    """Bit i is set when column i is NULL."""
    bits = [F.shiftleft(F.col(c).isNull().cast("int"), i) for i, c in enumerate(cols)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def mask_names(mask: Column, cols: Sequence[str]) -> Column:
    """Names of the columns a mask marks, joined by commas."""
    named = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(cols)]
    return F.concat_ws(",", *named)


def mapped(col: Column, table: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label of the first set of codes that holds the value."""
    out = None
    for label, codes in table.items():
        hit = col.isin(list(codes))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def cohort(prior_n: Column, best_season_n: Column, last_season_n: Column,
           established: int = 100) -> Column:
    """Experience class from counts known before the season."""
    return (F.when(F.coalesce(prior_n, F.lit(0)) == 0, "unseen")
            .when(F.coalesce(best_season_n, F.lit(0)) <= established, "rookie")
            .when(F.coalesce(last_season_n, F.lit(0)) == 0, "returning")
            .otherwise("veteran"))


def split_label(season: Column, train: Sequence[int], test: Sequence[int]) -> Column:
    return (F.when(season.isin(list(train)), "train")
            .when(season.isin(list(test)), "test").otherwise("unused"))
