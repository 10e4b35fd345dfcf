"""Helpers shared by the tests and the comparison tool."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import SparkSession


def local_session(cores: int | None = None) -> SparkSession:
    cores = cores or min(8, os.cpu_count() or 8)
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _key(row: tuple) -> tuple:
    return tuple((v is None, type(v).__name__ if isinstance(v, str) else "", v if v is not None else 0)
                 for v in row)


def compare(cols: Sequence[str], rows: list[tuple], want_cols: Sequence[str],
            want: list[tuple]) -> str:
    """Empty when both results hold the same multiset of rows."""
    if sorted(cols) != sorted(want_cols):
        return f"columns {sorted(set(cols) ^ set(want_cols))}"
    if len(rows) != len(want):
        return f"row count {len(rows)} vs {len(want)}"
    place = [list(want_cols).index(c) for c in cols]
    mine = sorted(rows, key=_key)
    other = sorted((tuple(r[i] for i in place) for r in want), key=_key)
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    if not wrong:
        return ""
    a, b = wrong[0]
    where = [c for c, x, y in zip(cols, a, b) if x != y]
    return f"{len(wrong)} rows differ, first in {where}: {a} vs {b}"
