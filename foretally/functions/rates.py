"""Column formulas for shrunken rates and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Num = Column | float | int


def _c(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def eb(total: Num | str, n: Num | str, strength: Num, prior: Num) -> Column:
    """Empirical-Bayes mean: (total + strength * prior) / (n + strength)."""
    return (_c(total) + _c(strength) * _c(prior)) / (_c(n) + _c(strength))


def reliability(n: Num | str, strength: Num) -> Column:
    return _c(n) / (_c(n) + _c(strength))


def ratio(num: Num | str, den: Num | str) -> Column:
    """Quotient that is NULL when the denominator is zero."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def clip(x: Num | str, low: Num, high: Num) -> Column:
    """Bound a value; NULL stays NULL."""
    c = _c(x)
    return F.when(c < _c(low), _c(low)).when(c > _c(high), _c(high)).otherwise(c)


def non_negative(x: Num | str) -> Column:
    """Zero for negative rounding residue; NULL stays NULL."""
    c = _c(x)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def logit(p: Num | str, eps: float = 1e-6) -> Column:
    q = clip(_c(p), eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Num | str, bound: float = 30.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(_c(z), -bound, bound)))


def entropy(parts: Sequence[Column]) -> Column:
    """Shannon entropy in nats of shares; zero shares add nothing."""
    terms = [F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)) for p in parts]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def half_life(age: Num | str, life: float) -> Column:
    return F.pow(F.lit(0.5), _c(age) / F.lit(float(life)))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return ratio(total, row_count(cols))


def row_count(cols: Sequence[Column]) -> Column:
    flags = [c.isNotNull().cast("int") for c in cols]
    return sum(flags[1:], flags[0])


def row_std(cols: Sequence[Column], ddof: int) -> Column:
    """Standard deviation of the non-null values of a row."""
    mean, n = row_mean(cols), row_count(cols)
    squares = [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols]
    return F.sqrt(ratio(sum(squares[1:], squares[0]), F.when(n > ddof, n - ddof)))


def wilson(k: Num | str, n: Num | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p, m = ratio(k, n), _c(n).cast("double")
    den = F.lit(1.0) + z * z / m
    mid = (p + z * z / (2 * m)) / den
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / den
    return mid - half, mid + half
