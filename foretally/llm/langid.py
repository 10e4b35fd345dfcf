"""Language of a text: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of the lowered text, hashed to a fixed number of buckets. A text is the
mean of its subwords' embeddings; a linear layer and a softmax give the languages' probabilities.
Embeddings and layer are learned together by stochastic gradient descent in numpy. A temperature
fitted on rows left out of the descent calibrates the probabilities, and answers whose probability
falls below a threshold found on the same rows are marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.sampling import held_out, sample

BITS = 14
SIZES = (1, 2, 3, 4)
DIMENSION = 16
#: Labelled rows learned from at most; the rest of the corpus is only predicted.
ROWS = 4000
EPOCHS = 6
BATCH = 32
ROWS_AT_ONCE = 256
RATE = 4.0
#: Errors allowed among accepted answers on the calibration rows.
ERRORS = 0.01


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embedding times layer: a bucket's share of each language's logit
    bias: np.ndarray
    temperature: float
    threshold: float


def counts(column: pa.Array):
    """Relative frequencies of the hashed subwords of each row of a text column, some rows at a time."""
    for lo, hi, data, offsets in tokens.chunks(column):
        rolling = tokens.Rolling(tokens.byte_codes(tokens.lowered(data)))
        buckets = [(rolling.every(size) >> np.uint64(64 - BITS)).astype(np.int32) for size in SIZES]
        for at in range(0, hi - lo, ROWS_AT_ONCE):
            some = range(at, min(at + ROWS_AT_ONCE, hi - lo))
            out = np.zeros((len(some), 1 << BITS), dtype=np.float32)
            for size, bucket in zip(SIZES, buckets):
                for i in some:
                    inside = bucket[offsets[i]:max(offsets[i], offsets[i + 1] - size + 1)]
                    if len(inside):
                        out[i - at] += np.bincount(inside, minlength=1 << BITS)
            out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
            yield out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Sparse:
    """Subword shares of the rows learned from; only the rows in use are spread to all buckets."""

    ends: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for i, row in enumerate(rows):
            inside = slice(self.ends[row], self.ends[row + 1])
            out[i, self.at[inside]] = self.share[inside]
        return out

    def times(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        blocks = [self.dense(rows[i:i + ROWS_AT_ONCE]) @ table for i in range(0, len(rows), ROWS_AT_ONCE)]
        return np.concatenate(blocks) if blocks else np.zeros((0, table.shape[1]), np.float32)


def _descend(x: Sparse, chosen: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    embed = rng.normal(0, 0.1, (1 << BITS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSION, k)).astype(np.float32)
    bias = np.zeros(k, dtype=np.float32)
    steps, done = max(1, EPOCHS * -(-len(y) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            block = x.dense(chosen[rows])
            rate = RATE * (1 - done / steps)
            mean = block @ embed
            slope = softmax(mean @ layer + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ layer.T
            layer -= rate * mean.T @ slope
            bias -= rate * slope.sum(axis=0)
            used = np.flatnonzero(block.any(axis=0))
            embed[used] -= rate * 64 * (block[:, used].T @ back)
            done += 1
    return embed @ layer, bias


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the least score whose accepted answers keep to ``ERRORS``."""
    if not len(y):
        return 1.0, 0.0
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    prob = softmax(logits / heat)
    score, wrong = prob.max(axis=1), prob.argmax(axis=1) != y
    order = np.argsort(-score)
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= ERRORS * np.arange(1, len(y) + 1))
    return heat, float(score[order][fine[-1]]) if len(fine) else 1.0


def learn(docs: DataFrame, most: int = ROWS) -> Model | None:
    """Fit on rows that are not held out and have a lang; None if there is none."""
    known = sample(docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out()), most)

    def run(batches):
        for batch in batches:
            parts, values = [], []
            for block in counts(batch.column(0)):
                for row in block:
                    parts.append(np.flatnonzero(row).astype(np.int32))
                    values.append(row[parts[-1]])
            ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))), pa.int32())
            flat = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((parts, np.int32), (values, np.float32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in flat)],
                names=["lang", "at", "share"])

    rows = (known.select("text", F.col("lang").cast("string"), "doc_id")
            .mapInArrow(run, "lang string, at array<int>, share array<float>").toArrow())
    if not rows.num_rows:
        return None
    langs, y = np.unique(np.array(rows.column("lang").to_pylist()), return_inverse=True)
    at, share = (rows.column(c).combine_chunks() for c in ("at", "share"))
    ends = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))))
    x = Sparse(ends, at.flatten().to_numpy(), share.flatten().to_numpy())
    del rows
    order = np.argsort([hash_of(x.at[a:b], x.share[a:b]) for a, b in zip(ends[:-1], ends[1:])], kind="stable")
    y, left = y[order], len(order) // 5
    table, bias = _descend(x, order[left:], y[left:], len(langs))
    heat, threshold = _calibrated(x.times(order[:left], table) + bias, y[:left])
    return Model(langs.tolist(), table, bias, heat, threshold)


def hash_of(at: np.ndarray, share: np.ndarray) -> int:
    """A repeatable order of rows that does not depend on how they were dealt."""
    return int(tokens.mixed(at.astype(np.uint64) + share.view(np.uint32)).sum() >> np.uint64(1))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of each row's whole text.

    ``docs`` needs doc_id and text. Returns doc_id, lang_pred, score (calibrated probability) and
    rejected (the score is below the calibrated threshold). A null text or one without a letter is
    ``und`` with score 0, rejected; so is every text if nothing could be learned. An empty table gives
    an empty result; repeated rows get equal answers.
    """
    def run(batches):
        for batch in batches:
            pred, score = [], []
            if model is not None:
                for block in counts(batch.column(1)):
                    prob = softmax((block @ model.table + model.bias) / model.temperature)
                    best = prob.argmax(axis=1)
                    pred.extend(model.langs[i] for i in best)
                    score.extend(prob[np.arange(len(best)), best].astype(float))
            else:
                pred, score = ["und"] * len(batch.column(1)), [0.0] * len(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), batch.column(2)],
                names=["doc_id", "lang_pred", "score", "lettered"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    told = docs.select(F.col("doc_id").cast("long"), "text", lettered.alias("lettered")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, lettered boolean")
    least = model.threshold if model is not None else 0.0
    score = F.when(F.col("lettered"), F.col("score")).otherwise(0.0)
    return told.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                       score.alias("score"), (~F.col("lettered") | (score < least)).alias("rejected"))
