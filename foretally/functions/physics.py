"""Flight angles from constant-acceleration kinematics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Feet from the plate of the measuring plane, the plate front, the mound,
# and the release plane assumed when nothing is known.
MEASURED_Y = 50.0
PLATE_Y = 17.0 / 12.0
MOUND_Y = 60.5
FALLBACK_Y = 54.5


def _time_to(distance: Column, v: Column, a: Column) -> Column:
    """Earlier root of a*t^2/2 + v*t + distance = 0; linear when acceleration vanishes."""
    half = a / 2.0
    disc = F.greatest(v * v - half * distance * 4.0, F.lit(0.0))
    curved = F.try_divide(-v - F.sqrt(disc), half * 2.0)
    return F.when(F.abs(half) > 1e-9, curved).otherwise(F.try_divide(-distance, v))


def plate_angles(prefix: str = "") -> dict[str, Column]:
    """Vertical and horizontal approach angle in degrees where the path meets the plate."""
    v = {a: F.col(prefix + f"v{a}0") for a in "xyz"}
    a = {x: F.col(prefix + f"a{x}") for x in "xyz"}
    raw = _time_to(F.lit(MEASURED_Y - PLATE_Y), v["y"], a["y"])
    t = F.when(raw > 0, raw)
    speed = {x: v[x] + a[x] * t for x in "xyz"}
    return {"vaa": F.degrees(F.atan2(speed["z"], F.abs(speed["y"]))),
            "haa": F.degrees(F.atan2(speed["x"], F.abs(speed["y"])))}


def release_angles(release_y: Column | None, extension: Column | None,
                   prefix: str = "") -> dict[str, Column]:
    """Angles at release; the plane is measured, else from extension, else assumed."""
    known = [c for c in (release_y, None if extension is None else MOUND_Y - extension)
             if c is not None]
    plane = F.coalesce(*known, F.lit(FALLBACK_Y))
    v = {a: F.col(prefix + f"v{a}0") for a in "xyz"}
    a = {x: F.col(prefix + f"a{x}") for x in "xyz"}
    t = _time_to(F.lit(MEASURED_Y) - plane, v["y"], a["y"])
    speed = {x: v[x] + a[x] * t for x in "xyz"}
    return {"vra": F.degrees(F.atan2(speed["z"], -speed["y"])),
            "hra": F.degrees(F.atan2(speed["x"], -speed["y"]))}


def mirrored(metric: Column, hand: Column, left: str = "Left") -> Column:
    """Flip lateral metrics of left-handers."""
    return metric * F.when(hand == left, -1.0).otherwise(1.0)


def bounded(metric: Column, low: float | None, high: float | None) -> Column:
    """NULL outside physical bounds."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (metric < low)
    if high is not None:
        bad = bad | (metric > high)
    return F.when(~bad, metric)
