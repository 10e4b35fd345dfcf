"""Column roles shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Order:
    """Total order of events inside a group.

    ``cols`` must be unique within every group it is used on. NULL comes first.
    """

    cols: tuple[str, ...]

    def columns(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() for c in self.cols]
