"""Quality is learned from all labelled rows and from all pairs of them."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from foretally.llm import quality


def texts(n):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(1, 4 + 3 * good))) for _ in range(rng.integers(2, 12))]
        out.append((i, " ".join(words) + ("." if rng.random() < 0.3 + 0.4 * good else " 12"), int(good)))
    return out


def tables(spark, rows):
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))


def learned_from(rows):
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return quality.features(pa.array([r[1] for r in kept])), np.array([r[2] for r in kept])


def brute(x, y):
    """Centre, scale, weights and threshold by Newton steps over the differences of every pair."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    gaps = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(gaps @ w))
        grad = -(gaps * p[:, None]).mean(axis=0) + quality.RIDGE * w
        hess = (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + quality.RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return centre, scale, w, np.quantile(z @ w, (y == 0).mean())


@pytest.mark.parametrize("held", [quality.HELD, 0])
@pytest.mark.parametrize("sent", [quality.SENT, 0])
def test_all_pairs(spark, monkeypatch, held, sent):
    """Weights and threshold are those of all pairs, on the driver and in tasks, whichever side of the join travels."""
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "SENT", sent)
    monkeypatch.setattr(quality, "TASK", 100)
    rows = texts(400)
    model = quality.learn(*tables(spark, rows))
    centre, scale, weights, threshold = brute(*learned_from(rows))
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale)
    assert np.allclose(model.weights, weights, rtol=1e-6, atol=1e-8) and model.threshold == pytest.approx(threshold, rel=1e-6)


def test_no_row_is_left_out(spark):
    """More labelled rows than were once learned from: the centre is that of all of them."""
    rows = texts(17000)
    x, _ = learned_from(rows)
    assert len(x) > 12500
    assert np.allclose(quality.learn(*tables(spark, rows)).centre, x.mean(axis=0), rtol=1e-12)


def test_ranks_of_values(spark):
    x = np.random.default_rng(2).normal(size=(500, quality.FEATURES + 1)).round(1)
    table = spark.createDataFrame([(1.0, *map(float, r[1:])) for r in x], "quality double, " + ", ".join(f"f{i} double" for i in range(quality.FEATURES)))
    for column in (0, 3):
        order = np.sort(x[:, 1 + column])
        for k in (0, 249, 498):
            assert quality._ordered(quality.Rows(table), lambda v: v[:, column], [k, k + 1]) == order[k:k + 2].tolist()


def test_one_label_only(spark):
    docs, labels = tables(spark, [r for r in texts(40) if r[2]])
    assert quality.learn(docs, labels) is None
