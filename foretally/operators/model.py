"""Folds and forward training with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from foretally import session
from foretally.functions.rates import clip, entropy
from foretally.operators.joins import lookup_join
from foretally.operators.metrics import probability_scores
from foretally.operators.ordered import History
from foretally.roles import Order


def forward_folds(df: DataFrame, season: str, folds: Sequence[int]) -> DataFrame:
    """Rows with the folds they take part in: ``train`` before the fold season, ``valid`` in it."""
    at = F.filter(F.array(*[F.lit(int(f)) for f in folds]), lambda f: f >= F.col(season))
    return df.withColumn("fold", F.explode(at)).withColumn(
        "part", F.when(F.col(season) < F.col("fold"), "train").otherwise("valid"))


def grouped_folds(df: DataFrame, group: str, k: int, hot_rows: int | None = None) -> DataFrame:
    """Whole groups dealt to folds by size, back and forth, so folds stay balanced."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__d", -F.col("__n"))
    order = Order(("__d", group))
    ranked = History(sizes, [], order, hot_rows).position("__r").df
    turn = F.pmod(F.col("__r"), F.lit(2 * k))
    return ranked.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def _features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = df.withColumns({f"__x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__x_{c}" for c in columns], outputCol="__f").transform(filled).drop(
        *[f"__x_{c}" for c in columns])


def _weighted(df: DataFrame, columns: Sequence[str], others: Sequence[str], weight: str | None) -> DataFrame:
    """Rows with equal features and ``others`` as one row with their summed weight ``__w``; a loss over them is the same."""
    known = df.select(*others, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"), *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.lit(0.0)).alias(f"__x_{c}") for c in columns])
    cells = known.groupBy(*[f"__x_{c}" for c in columns], *others).agg(F.sum("__w").alias("__w"))
    return VectorAssembler(inputCols=[f"__x_{c}" for c in columns], outputCol="__f").transform(cells).select("__f", "__w", *others)


@dataclass(frozen=True)
class Boosted:
    """Trees up to the best round, that round, and the validation loss of every round trained."""

    model: GBTClassificationModel
    rounds: int
    losses: tuple[float, ...]


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of least loss before ``patience`` rounds brought none less, and whether they did."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_boosted(rows: DataFrame, columns: Sequence[str], y: str, valid: str, rounds: int = 2000,
                patience: int = 100, depth: int = 6, step: float = 0.1, weight: str | None = None,
                seed: int = 0) -> Boosted:
    """Gradient-boosted trees on the rows where ``valid`` is false, stopped by the loss on those where it is true.

    Training grows by doubling the number of rounds until ``patience`` rounds in a row bring no better loss or
    ``rounds`` are reached; rounds are the same whatever their number, so the best ones are kept by training
    just them again. Rows with equal features and label are one row with their weight. Raises where one of the
    two parts has no rows.
    """
    data = _weighted(rows.filter(F.col(y).isNotNull()).withColumn(valid, F.coalesce(F.col(valid), F.lit(False))), columns, [y, valid], weight)
    # The parts are read once for every round of every training.
    train, held = (session.checkpoint(data.filter(F.col(valid) == part)) for part in (False, True))
    if train.isEmpty() or held.isEmpty():
        raise ValueError("training and validation both need rows")

    def trained(n: int) -> GBTClassificationModel:
        return GBTClassifier(featuresCol="__f", labelCol=y, maxIter=n, maxDepth=depth, stepSize=step, seed=seed, weightCol="__w").fit(train)

    n = min(rounds, max(8, 2 * patience))
    while True:
        model = trained(n)
        losses = tuple(model.evaluateEachIteration(held))
        best, stopped = best_round(losses, patience)
        if stopped or n == rounds:
            return Boosted(model if best == n else trained(best), best, losses)
        n = min(rounds, 2 * n)


def fit_logistic_model(train: DataFrame, columns: Sequence[str], y: str, weight: str | None = None,
                       family: str = "auto", rounds: int = 1000, ridge: float = 0.001):
    """Logistic regression run until it converges; raises where ``rounds`` do not do."""
    extra = {"weightCol": weight} if weight else {}
    # Equal rows may only be one with their weight where no penalty depends on the columns' spread.
    data = _features(train, columns) if ridge or weight else _weighted(train, columns, [y], None)
    if not (ridge or weight):
        extra, data = {"weightCol": "__w"}, session.checkpoint(data)
    model = LogisticRegression(featuresCol="__f", labelCol=y, family=family, maxIter=rounds, regParam=ridge, **extra).fit(data)
    if model.summary.totalIterations >= rounds:
        raise ArithmeticError(f"logistic regression did not converge in {rounds} iterations")
    return model


def fit_forecaster(train: DataFrame, columns: Sequence[str], y: str, kind: str = "logistic",
                   weight: str | None = None, seed: int = 0, valid: str | None = None, **boosting):
    """A converged logistic regression, or boosted trees stopped by the rows marked by ``valid``."""
    if kind == "gbt":
        if valid is None:
            raise ValueError("boosting needs a column that marks its validation rows")
        return fit_boosted(train, columns, y, valid, weight=weight, seed=seed, **boosting).model
    if kind == "logistic":
        return fit_logistic_model(train, columns, y, weight)
    raise ValueError(kind)


def forecast(model, df: DataFrame, columns: Sequence[str], name: str = "forecast") -> DataFrame:
    """Row-independent probability of the positive class."""
    scored = model.transform(_features(df, columns))
    p = F.get(vector_to_array("probability"), 1)
    return scored.withColumn(name, clip(p, 1e-6, 1 - 1e-6)).drop("__f", "rawPrediction", "probability", "prediction")


def forward_oof(df: DataFrame, season: str, folds: Sequence[int], columns: Sequence[str], y: str,
                kind: str = "logistic", weight: str | None = None, seed: int = 0, **boosting) -> DataFrame:
    """Out-of-fold forecasts of every fold season by a model of the seasons before it.

    Boosted trees are stopped by the last season before the fold, which they are not trained on, and add
    ``rounds``, the round they kept; ``boosting`` goes to ``fit_boosted``.
    """
    out = None
    for f in folds:
        past, now = df.filter(F.col(season) < f), df.filter(F.col(season) == f)
        if kind == "gbt":
            last = past.agg(F.max(season)).first()[0]
            fit = fit_boosted(past.withColumn("__valid", F.col(season) == F.lit(last)), columns, y, "__valid",
                              weight=weight, seed=seed, **boosting)
            part = forecast(fit.model, now, columns).withColumn("rounds", F.lit(fit.rounds))
        else:
            part = forecast(fit_forecaster(past, columns, y, kind, weight, seed), now, columns)
        part = part.withColumn("fold", F.lit(int(f)))
        out = part if out is None else out.unionByName(part)
    return out


def stacked_classes(df: DataFrame, group: str, k: int, columns: Sequence[str], label: str,
                    classes: int) -> DataFrame:
    """Out-of-fold class probabilities with their entropy and maximum, folds by group."""
    folded = df.join(grouped_folds(df, group, k), group)
    out = None
    for f in range(k):
        model = fit_logistic_model(folded.filter(F.col("fold") != f), columns, label, family="multinomial", ridge=0.0)
        part = model.transform(_features(folded.filter(F.col("fold") == f), columns))
        probs = vector_to_array("probability")
        part = part.withColumns({f"aux_{i}": F.get(probs, i) for i in range(classes)}).drop(
            "__f", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    cols = [F.col(f"aux_{i}") for i in range(classes)]
    return out.withColumns({"aux_entropy": entropy(cols), "aux_max": F.greatest(*cols)})


def staged_ablation(train: DataFrame, test: DataFrame, stages: Mapping[str, Sequence[str]], y: str) -> DataFrame:
    """Scores after adding each feature group in turn."""
    used: list[str] = []
    out = None
    for i, (name, columns) in enumerate(stages.items(), 1):
        used = [*used, *[c for c in columns if c not in used]]
        model = fit_forecaster(train, used, y)
        part = probability_scores(forecast(model, test, used), [], y, "forecast").select(
            F.lit(i).alias("stage"), F.lit(name).alias("name"), F.lit(len(used)).alias("features"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def segmented_experts(train: DataFrame, test: DataFrame, segment: str, levels: Sequence, columns: Sequence[str],
                      y: str) -> DataFrame:
    """One model per segment, forecasts recombined; every level must have training rows."""
    out = None
    for v in levels:
        rows = train.filter(F.col(segment) == v)
        if rows.isEmpty():
            raise ValueError(f"no training rows for {segment}={v}")
        part = forecast(fit_forecaster(rows, columns, y), test.filter(F.col(segment) == v), columns)
        out = part if out is None else out.unionByName(part)
    return out


def entity_or_global(train: DataFrame, test: DataFrame, entity: str, y: str, strength: float,
                     min_n: int) -> DataFrame:
    """Own shrunken estimate for entities with enough rows, the global rate for others."""
    mean = train.agg(F.avg(y)).scalar()
    own = train.groupBy(entity).agg(
        ((F.sum(y) + strength * mean) / (F.count(y) + strength)).alias("__own"), F.count(y).alias("__n"))
    rows = lookup_join(test, own.filter(F.col("__n") >= min_n).drop("__n"), [entity])
    return rows.withColumns({"forecast": F.coalesce("__own", mean),
                             "source": F.when(F.col("__own").isNotNull(), "own").otherwise("global")}).drop("__own")
