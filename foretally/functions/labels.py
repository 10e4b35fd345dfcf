"""Classes and components derived from recovered failure labels; unknown stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def outside_only(y: Column, middle: Column, reverse: Column) -> Column:
    """Failures that are neither middle nor reverse."""
    return F.when(y.isNotNull() & middle.isNotNull() & reverse.isNotNull(),
                  ((y == 0) & (middle == 0) & (reverse == 0)).cast("int"))


def failure_classes(y: Column, middle: Column, reverse: Column) -> dict[str, Column]:
    """Success 0, middle 1, reverse 2, outside 3; the swapped order takes reverse first, and
    the five-class version keeps rows with both labels apart as 4."""
    known = y.isNotNull() & middle.isNotNull() & reverse.isNotNull()

    def order(first: tuple[Column, int], second: tuple[Column, int]) -> Column:
        return F.when(known, F.when(y == 1, 0).when(first[0] == 1, first[1])
                      .when(second[0] == 1, second[1]).otherwise(3))

    m, r = (middle, 1), (reverse, 2)
    return {"class4": order(m, r), "class4_swapped": order(r, m),
            "class5": F.when(known, F.when(y == 1, 0).when((middle == 1) & (reverse == 1), 4)
                             .when(middle == 1, 1).when(reverse == 1, 2).otherwise(3))}


def components(middle: Column, reverse: Column, outside: Column, ball: Column) -> dict[str, Column]:
    """Middle, reverse, both, outside on a ball, outside in the zone."""
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), ((a == 1) & (b == 1)).cast("int"))
    return {"m": middle, "r": reverse, "mr": both(middle, reverse), "ob": both(outside, ball),
            "oz": both(outside, 1 - ball)}
