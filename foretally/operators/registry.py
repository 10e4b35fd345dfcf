"""Extension surface: registered transforms, feature specs, intake gates and contracts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foretally import session
from foretally.functions.rates import logit
from foretally.operators.joins import lookup_join, small_join

Apply = Callable[[DataFrame, Column], tuple[DataFrame, list[str], list[str]]]


@dataclass(frozen=True)
class Transform:
    """``apply(frame, fit_predicate)`` returns the frame, new features and dropped features."""

    name: str
    apply: Apply
    targets: tuple[str, ...] = ()
    note: str = ""
    conflicts: frozenset[str] = field(default_factory=frozenset)


class Registry:
    def __init__(self) -> None:
        self._items: dict[str, Transform] = {}

    def add(self, item: Transform) -> None:
        if item.name in self._items:
            raise ValueError(f"duplicate transform {item.name}")
        self._items[item.name] = item

    def names(self) -> list[str]:
        return sorted(self._items)

    def check(self, names: Sequence[str]) -> None:
        """Unknown, repeated or conflicting names raise."""
        unknown = [n for n in names if n not in self._items]
        if unknown:
            raise KeyError(f"unknown transforms {unknown}")
        if len(set(names)) != len(names):
            raise ValueError("a transform is listed twice")
        for n in names:
            for m in names:
                if n != m and m in self._items[n].conflicts:
                    raise ValueError(f"{n} conflicts with {m}")

    def apply(self, df: DataFrame, names: Sequence[str], features: Sequence[str],
              fit: Column) -> tuple[DataFrame, list[str]]:
        """Run transforms in the given order; returns the frame and its feature list."""
        self.check(names)
        current = list(features)
        for n in names:
            df, added, dropped = self._items[n].apply(df, fit)
            current = [c for c in current if c not in dropped] + [c for c in added if c not in current]
        return df, current


def id_frequency(column: str) -> Transform:
    """log1p of the id's rows in the fit period, and an unseen flag."""

    def apply(df: DataFrame, fit: Column) -> tuple[DataFrame, list[str], list[str]]:
        n = df.filter(fit).groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_n"))
        out = lookup_join(df, n, [column], {f"{column}_n": 0})
        names = [f"{column}_logn", f"{column}_unseen"]
        out = out.withColumns({names[0]: F.log1p(F.col(f"{column}_n").cast("double")),
                               names[1]: (F.col(f"{column}_n") == 0).cast("int")}).drop(f"{column}_n")
        return out, names, []

    return Transform(f"id_frequency:{column}", apply, (column,), "fit-period frequency of an id")


def cyclic(column: str, period: float) -> Transform:
    def apply(df: DataFrame, fit: Column) -> tuple[DataFrame, list[str], list[str]]:
        angle = F.col(column) * F.lit(2.0 * 3.141592653589793 / period)
        names = [f"{column}_sin", f"{column}_cos"]
        return df.withColumns({names[0]: F.sin(angle), names[1]: F.cos(angle)}), names, []

    return Transform(f"cyclic:{column}", apply, (column,), "sine and cosine of a cycle")


def shaped(column: str, kind: str) -> Transform:
    """logit, sqrt or log1p of a column."""
    fn = {"logit": lambda c: logit(c), "sqrt": lambda c: F.sqrt(F.greatest(c, F.lit(0.0))),
          "log1p": lambda c: F.log1p(F.greatest(c, F.lit(0.0)))}[kind]

    def apply(df: DataFrame, fit: Column) -> tuple[DataFrame, list[str], list[str]]:
        return df.withColumn(f"{column}_{kind}", fn(F.col(column).cast("double"))), [f"{column}_{kind}"], []

    return Transform(f"{kind}:{column}", apply, (column,), f"{kind} of a column")


def dropped(name: str, columns: Sequence[str], conflicts: Sequence[str] = ()) -> Transform:
    """Leave columns out of the feature list."""
    return Transform(f"drop:{name}", lambda df, fit: (df, [], list(columns)), tuple(columns),
                     "feature selection", frozenset(conflicts))


@dataclass(frozen=True)
class FeatureSpec:
    """Either row-wise ``make(df)`` or a keyed table ``make_table(fit_rows)`` joined on ``keys``."""

    name: str
    columns: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame] | None = None
    make_table: Callable[[DataFrame], DataFrame] | None = None
    keys: tuple[str, ...] = ()

    def attach(self, df: DataFrame, fit: Column) -> DataFrame:
        if (self.make is None) == (self.make_table is None):
            raise ValueError("give either make or make_table")
        out = self.make(df) if self.make else small_join(df, self.make_table(df.filter(fit)), self.keys)
        missing = [c for c in self.columns if c not in out.columns]
        if missing:
            raise ValueError(f"{self.name} lacks {missing}")
        return out


def coverage_gap(df: DataFrame, column: str, fit: Column, valid: Column) -> DataFrame:
    """Known share of a feature in fit and valid rows and the gap between them."""
    known = F.col(column).isNotNull().cast("double")
    return df.agg(F.avg(F.when(fit, known)).alias("fit_share"), F.avg(F.when(valid, known)).alias("valid_share")).withColumn(
        "gap", F.abs(F.col("fit_share") - F.col("valid_share")))


def cell_contribution(df: DataFrame, keys: Sequence[str], strength: float) -> DataFrame:
    """Median weight one row has on its own cell, 1 / (n + strength), over rows."""
    from foretally.operators.ordered import by_value
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    share = cells.withColumn("w", F.lit(1.0) / (F.col("rows") + strength)).groupBy("w").agg(F.sum("rows").alias("n"))
    ranked = by_value(share, [], "w").running({"below": F.col("n")}, totals={"t": F.col("n")}).df
    total = F.col("t")
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("w")))
    return ranked.agg(((at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2.0).alias("median_contribution"))


def intake_gates(spec: FeatureSpec, df: DataFrame, season: str, folds: Sequence[int], strength: float,
                 max_contribution: float = 0.01, max_gap: float = 0.15) -> DataFrame:
    """Pass or fail per gate: columns equal across folds, values change with the fold,
    small own contribution, similar coverage in train and valid rows."""
    tables = [spec.attach(df, F.col(season) < f) for f in folds]
    same = all(sorted(t.columns) == sorted(tables[0].columns) for t in tables)
    rows = [("columns_equal", 1.0 if same else 0.0, bool(same))]
    if spec.make_table is not None:
        a, b = (spec.make_table(df.filter(F.col(season) < f)) for f in (folds[0], folds[-1]))
        changed = not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
        rows.append(("changes_with_fold", float(changed), changed))
        c = cell_contribution(df.filter(F.col(season) < folds[-1]), spec.keys, strength).first()[0]
        rows.append(("own_contribution", float(c), c < max_contribution))
    for name in spec.columns:
        gap = coverage_gap(tables[-1], name, F.col(season) < folds[-1], F.col(season) == folds[-1]).first()["gap"]
        rows.append((f"coverage:{name}", float(gap or 0.0), (gap or 0.0) <= max_gap))
    return df.sparkSession.createDataFrame(rows, "gate string, value double, passed boolean")


def check_block(block: DataFrame, base: DataFrame, row_id: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Contract of a feature block as counted violations, zero everywhere when it holds."""
    wrong = sorted(set(block.columns) ^ {*row_id, *columns})
    types = {f.name: f.dataType for f in block.schema.fields}
    text = [c for c in columns if c in types and not isinstance(types[c], T.NumericType)]
    ids = block.groupBy(*row_id).agg(F.count(F.lit(1)).alias("c"))
    missing = base.select(*row_id).distinct().join(block, list(row_id), "left_anti")
    extra = block.select(*row_id).distinct().join(base, list(row_id), "left_anti")
    infinite = [F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in columns if c not in text]
    inf = sum(infinite[1:], infinite[0]) if infinite else F.lit(0)
    null_id = F.lit(False)
    for c in row_id:
        null_id = null_id | F.col(c).isNull()
    out = block.agg(inf.alias("infinite"), F.count_if(null_id).alias("null_ids")).withColumns({
        "wrong_columns": F.lit(len(wrong)).cast("long"), "non_numeric": F.lit(len(text)).cast("long"),
        "repeated_ids": ids.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).scalar(),
        "missing_ids": missing.agg(F.count(F.lit(1))).scalar(),
        "extra_ids": extra.agg(F.count(F.lit(1))).scalar()})
    names = ["wrong_columns", "non_numeric", "infinite", "null_ids", "repeated_ids", "missing_ids", "extra_ids"]
    return out.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "check", "violations")


def row_independent(build: Callable[[DataFrame], DataFrame], df: DataFrame, row_id: Sequence[str],
                    part: Column) -> DataFrame:
    """Rows whose features differ between the whole input, reordered input and a part of it.

    The three results are counted row by row in one aggregation, in as many tasks as the rows need.
    """
    tasks = session.tasks_for(df.sparkSession, df.count())
    shuffled = df.repartition(max(7, tasks), *[F.col(c) for c in row_id]).sortWithinPartitions(F.desc(row_id[0]))
    whole, *others = [build(d) for d in (df, shuffled, df.filter(part))]
    names = [f"__seen_{i}" for i in range(3)]
    tagged = [d.withColumns({n: F.lit(int(i == j)).cast("long") for j, n in enumerate(names)})
              for i, d in enumerate([whole, *others])]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    ids = [c for c in row_id if c in whole.columns] or whole.columns
    if tasks > 1:
        both = both.repartition(tasks, *ids)
    w, s, h = (F.col(n) for n in names)
    counts = both.groupBy(*whole.columns).agg(*[F.sum(n).alias(n) for n in names])
    more = lambda x, y: F.coalesce(F.sum(F.greatest(x - y, F.lit(0))), F.lit(0))
    return counts.agg(more(w, s).alias("reordered"), more(h, w).alias("part_of_rows")).unpivot(
        [], ["reordered", "part_of_rows"], "check", "violations").select("violations", "check")


def method_audit(df: DataFrame, season: str, fold: int, y: str, m: str, r: str,
                 table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Named facts that must be zero: overlap of fold parts, a table that ignores the fold,
    and failures not covered by inclusion-exclusion of their parts."""
    train, valid = df.filter(F.col(season) < fold), df.filter(F.col(season) == fold)
    # Seasons are grouped, not joined: a join would bring all rows of a season together.
    sides = [d.select(season, F.lit(x).alias("__a"), F.lit(1 - x).alias("__b")) for d, x in ((train, 1), (valid, 0))]
    met = sides[0].unionByName(sides[1]).groupBy(season).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    overlap = met.agg(F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("violations"))
    same = table(train).intersect(table(df.filter(F.col(season) < fold - 1))).agg(
        F.count(F.lit(1)).alias("violations"))
    both, either = F.col(m) * F.col(r), F.greatest(F.col(m), F.col(r))
    bad = df.agg(F.count_if(F.col(m) + F.col(r) - both != either).alias("violations"))
    out = overlap.withColumn("check", F.lit("fold_overlap"))
    out = out.unionByName(same.withColumn("check", F.lit("rows_equal_across_folds")))
    return out.unionByName(bad.withColumn("check", F.lit("inclusion_exclusion")))
