"""Document quality by pairwise ranking.

Preference pairs of a good and a poor document fit a Bradley-Terry model: the chance that one is
preferred is the logistic function of the difference of their scores, which are linear in features of
the whole text. The logistic loss on the feature differences of all pairs of all labelled documents is
minimised by Newton steps. A quantile of the learned scores, the share of poor documents, is the
threshold; the reported score is a logistic function of the distance to it that gives 0.7 there.

The loss of a pair depends on the difference of two scores alone and is smooth in it, so its sum over all
pairs needs no pair: each document is spread by interpolation over nodes near its score, with its
features and their products, and nodes meet nodes on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.sampling import held_out
from foretally.llm.store import stored

#: Labelled documents whose ids are sent to every executor; of more, features are joined.
SENT = 1 << 20
#: Labelled rows whose features are kept on the driver, and rows of a task where there are more.
HELD, TASK = 1 << 16, 1 << 19
#: Nodes of a stretch of scores of length one; with poles of the loss at a distance of pi, interpolation is good to rounding.
NODES = 14
#: Penalty on squared weights beside the mean loss of a pair.
RIDGE = 1e-4
#: Score at the threshold.
GOOD = 0.7
FEATURES = 12


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.slope * (self.utility(x) - self.threshold) + np.log(GOOD / (1 - GOOD))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


_KIND = np.zeros(256, dtype=np.int8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 stop or comma, 5 other sign
_KIND[0x21:0x7F] = 5
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x80:] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x2C, 0x2E]] = 4


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: sorts of signs, word lengths, and how often words and lines repeat."""
    out = []
    for lo, hi, data, offsets in tokens.chunks(column, tokens.SMALL):
        starts, stops, rows = tokens.word_bounds(data, offsets)
        codes = tokens.word_codes(data, starts, stops)
        pairs = tokens.Rolling(codes).every(2)
        kind, length = _KIND[data], stops - starts
        wordy = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2))))
        plain = wordy[stops] > wordy[starts]
        same = np.concatenate(([False], codes[1:] == codes[:-1])) if len(codes) else np.zeros(0, bool)
        for i in range(hi - lo):
            a, b = rows[i], rows[i + 1]
            n, chars = b - a, max(1, offsets[i + 1] - offsets[i])
            if not n:
                out.append([0.0] * FEATURES)
                continue
            part = np.bincount(kind[offsets[i]:offsets[i + 1]], minlength=6) / chars
            some = pairs[a:max(a, b - 1)]
            lines = bytes(data[offsets[i]:offsets[i + 1]]).split(b"\n")
            out.append([
                part[1], part[3], part[4], part[5], 1 - plain[a:b].mean(), same[a + 1:b].sum() / n,
                1 - len(np.unique(codes[a:b])) / n, 1 - len(np.unique(some)) / max(1, len(some)),
                np.log1p(n), length[a:b].mean(), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))])
    return np.array(out, dtype=np.float64).reshape(-1, FEATURES)


def _newton(at: Callable, w: np.ndarray) -> np.ndarray:
    """Weights of least loss, of which ``at`` gives value, slope and curvature; steps go on until they no longer move."""
    loss, grad, hess = at(w)
    while True:
        step, size = np.linalg.solve(hess, grad), 1.0
        new = at(w - step)
        while new[0] > loss + 1e-12 * abs(loss) and size > 1e-6:
            size /= 2
            new = at(w - size * step)
        w, (loss, grad, hess) = w - size * step, new
        if np.abs(size * step).max() < 1e-6:
            return w


class Rows:
    """Features and 0/1 labels of all rows learned from: arrays where they are few, else a stored table for tasks."""

    def __init__(self, table: DataFrame):
        self.table = stored(table)
        self.n, self.held = self.table.count(), None
        if self.n <= HELD:
            raw = np.array([c.to_numpy() for c in self.table.toArrow().columns], dtype=np.float64).T.reshape(-1, FEATURES + 1)
            raw = raw[np.lexsort(raw.T[::-1])]
            self.held = (raw[:, 1:], raw[:, 0])

    def total(self, work: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
        """Sums by number of what ``work`` yields for blocks of features and labels."""
        if self.held is not None:
            return _added(work(*self.held))

        def run(batches):
            blocks = (np.array([c.to_numpy() for c in batch.columns], dtype=np.float64) for batch in batches)
            sums = _added(pair for b in blocks for pair in work(b[1:].T, b[0]))
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.list_(pa.float64()))],
                                             names=["key", "sums"])

        told = self.table.coalesce(-(-self.n // TASK)).mapInArrow(run, "key long, sums array<double>").toArrow()
        return _added((k.as_py(), v.values.to_numpy()) for k, v in zip(told.column("key"), told.column("sums")))


def _added(pairs: Iterator[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    out = {}
    for key, values in pairs:
        out[key] = out[key] + values if key in out else values
    return out


_SPOTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_SHARE = np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES * np.cos(np.arange(NODES)[:, None] * np.arccos(_SPOTS))
_UPPER = np.triu_indices(FEATURES)


def _spread(utility: np.ndarray, z: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Documents spread over the nodes of their stretch of utilities: (twice its start plus label, for each node the sums of 1, features and products)."""
    stretch = np.floor(utility).astype(np.int64)
    near = np.cos(np.arange(NODES) * np.arccos(np.clip(2 * (utility - stretch) - 1, -1, 1))[:, None]) @ _SHARE
    key = 2 * stretch + (y == 1)
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    for k, inside in zip(keys.tolist(), np.split(order, starts[1:])):
        for some in np.split(inside, range(TASK >> 5, len(inside), TASK >> 5)):
            told = np.column_stack([np.ones(len(some)), z[some], z[some][:, _UPPER[0]] * z[some][:, _UPPER[1]]])
            yield k, (near[some].T @ told).ravel()


def _all_pairs(sums: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs of a good and a poor document, with its slope and curvature, from documents spread over nodes."""
    def side(good: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = sorted(k for k in sums if k & 1 == good)
        told = np.concatenate([sums[k].reshape(NODES, -1) for k in keys])
        return (np.concatenate([(k >> 1) + (_SPOTS + 1) / 2 for k in keys]), told[:, 0], told[:, 1:1 + FEATURES], told[:, 1 + FEATURES:])

    (t, m, first, second), (pt, pm, pfirst, psecond) = side(1), side(0)
    loss, grad, square, cross = 0.0, np.zeros(FEATURES), np.zeros(second.shape[1]), np.zeros((FEATURES, FEATURES))
    for at in range(0, len(t), 512):
        some = slice(at, at + 512)
        gap = pt - t[some, None]
        chance = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        bend = chance * (1 - chance)
        loss += m[some] @ (np.logaddexp(0, gap) @ pm)
        grad += m[some] @ chance @ pfirst - (chance @ pm) @ first[some]
        square += m[some] @ bend @ psecond + (bend @ pm) @ second[some]
        cross += first[some].T @ (bend @ pfirst)
    hess = np.zeros((FEATURES, FEATURES))
    hess[_UPPER] = square
    hess = hess + np.triu(hess, 1).T - cross - cross.T
    n = m.sum() * pm.sum()
    return float(loss / n), grad / n, hess / n


def _ordered(rows: Rows, value: Callable[[np.ndarray], np.ndarray], ranks: list[int]) -> list[float]:
    """The values of these ranks, from 0, among those of all rows: 16 bits of them are settled in each round."""
    def bits(x: np.ndarray) -> np.ndarray:
        raw = (value(x) + 0.0).view(np.int64)
        return np.where(raw < 0, raw ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), raw)

    heads, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):
        def count(x, y):
            at = bits(x)
            if shift < 48:
                at = at[np.isin(at >> (shift + 16), heads)]
            for k, n in zip(*np.unique(at >> shift, return_counts=True)):
                yield int(k), np.array([float(n)])

        told = sorted(rows.total(count).items())
        for i in range(len(ranks)):
            for k, n in told:
                if shift < 48 and k >> 16 != heads[i]:
                    continue
                if left[i] < n[0]:
                    found = k
                    break
                left[i] -= int(n[0])
            heads[i] = found
    raw = np.array(heads, dtype=np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), raw).view(np.float64).tolist()


def fit(rows: Rows) -> Model | None:
    """Learn from features and 0/1 labels; None unless both labels occur."""
    def sums(x, y):
        for good in (0, 1):
            yield good, np.array([(y == good).sum(), *x[y == good].sum(axis=0)])

    told = rows.total(sums)
    if not told or not all(told[good][0] for good in (0, 1)):
        return None
    n, poor = int(told[0][0] + told[1][0]), int(told[0][0])
    centre = (told[0] + told[1])[1:] / n
    scale = np.maximum(np.sqrt(rows.total(lambda x, y: iter([(0, ((x - centre) ** 2).sum(axis=0))]))[0] / n), 1e-6)
    shaped = lambda x: np.clip((x - centre) / scale, -8, 8)

    def pairs(w):
        loss, grad, hess = _all_pairs(rows.total(lambda x, y: _spread(shaped(x) @ w, shaped(x), y)))
        return loss + RIDGE / 2 * w @ w, grad + RIDGE * w, hess + RIDGE * np.eye(FEATURES)

    weights = _newton(pairs, np.zeros(FEATURES))
    low, high = _ordered(rows, lambda x: shaped(x) @ weights, [poor - 1, poor])
    threshold = low + (high - low) * (1 - poor / n)  # the linear quantile at the share of poor documents

    def logistic(w):
        def one(x, y):
            side = np.where(y == 1, 1.0, -1.0)
            v = side * (shaped(x) @ weights - threshold)
            p = 1 / (1 + np.exp(np.clip(v * w[0], -40, 40)))
            yield 0, np.array([np.logaddexp(0, -v * w[0]).sum(), -(v * p).sum(), (v * v * p * (1 - p)).sum()])

        loss, grad, hess = rows.total(one)[0]
        return loss + w[0] ** 2 / 2, np.array([grad + w[0]]), np.array([[hess + 1.0]])

    slope = _newton(logistic, np.zeros(1))
    return Model(centre, scale, weights, float(threshold), float(max(slope[0], 1e-3)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all labelled rows that are not held out; a doc_id with several labels takes the commoner one."""
    known = stored(labels.select(F.col("doc_id").cast("long"), "quality").filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(~held_out())
        .groupBy("doc_id").agg(F.avg("quality").alias("mean"))
        .select("doc_id", (F.col("mean") >= 0.5).cast("long").alias("quality")))
    few = known.count() <= SENT
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T)], names=["doc_id", *names])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    # Texts are not sent about: ids travel to them where they are few, else numbers travel in their place.
    texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if few else texts.filter("doc_id IS NOT NULL")
    told = texts.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in names)]))
    return fit(Rows(told.join(F.broadcast(known) if few else known, "doc_id").select("quality", *names)))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with quality_score (0 to 1), in place of a column of that name.

    Needs text; other columns stay as they are. A null text or one without words scores 0; if nothing
    could be learned, other texts score 0.5. Repeated rows get equal scores; an empty table gives an empty
    result.
    """
    rest = [c for c in docs.columns if c != "quality_score"]
    # Names match whatever their case, as Spark's do.
    at = [c.lower() for c in rest].index("text")

    def run(batches):
        for batch in batches:
            x = features(batch.column(at))
            score = model.score(x) if model is not None else np.full(len(x), 0.5)
            score[x[:, 8] == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*rest, "quality_score"])

    fields = [f for f in docs.schema.fields if f.name != "quality_score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "quality_score double"])
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
