"""Registry of the queries this library runs on the driver's tables.

A query declares its result columns as ``name:type`` words. The same declaration shapes
the Spark result and the SQL text, so both sides agree on types and rounding.
Types: ``i`` integer, ``s`` text, ``d`` double rounded to six places, ``dN`` to N places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    columns: str
    build: Build
    sql: str | None
    note: str

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(word.split(":")) for word in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(self.build(spark, sf_dir), self.fields())

    def oracle(self) -> str | None:
        return None if self.sql is None else shaped_sql(self.sql, self.fields())


CATALOG: dict[str, Query] = {}
#: Results of more columns are rounded by ``rounded``; in narrower ones its longer code was slower than ``F.round``.
WIDE = 100


def _places(kind: str) -> int:
    return int(kind[1:] or 6)


def rounded(x: Column, places: int) -> Column:
    """``F.round`` of a double, by binary arithmetic where that gives the same double.

    ``F.round`` writes every value as a decimal. A quotient of whole numbers is the same double unless the value is
    near the middle of two results, huge, or not finite; only those take that way.
    """
    scale = F.lit(10.0 ** places)
    whole = F.rint(x * scale)
    safe = (F.abs(whole) < 1e12) & (F.abs(x * scale - whole) < 0.499)
    return F.when(safe, whole / scale).otherwise(F.round(x, places))


def shaped(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    out = []
    near = rounded if len(fields) > WIDE else F.round
    for name, kind in fields:
        col = F.col(name)
        if kind == "i":
            col = col.cast("bigint")
        elif kind == "s":
            col = col.cast("string")
        else:
            col = near(col.cast("double"), _places(kind)) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def shaped_sql(sql: str, fields: list[tuple[str, str]]) -> str:
    from foretally.plans.bindings import COMMON_SQL

    out = []
    for name, kind in fields:
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "s":
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        else:
            out.append(f'round(CAST("{name}" AS DOUBLE), {_places(kind)}) + 0.0 AS "{name}"')
    return f"WITH {COMMON_SQL},\nresult AS ({sql})\nSELECT {', '.join(out)} FROM result"


def query(name: str, covers: str, columns: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the operator ids it exercises."""

    def register(build: Build) -> Build:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        note = (build.__doc__ or "").strip().split("\n")[0]
        CATALOG[name] = Query(name, covers, " ".join(columns.split()), build, sql, note)
        return build

    return register
