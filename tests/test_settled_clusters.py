"""K-means of a group in one task: the rounds that passes over the table would make, without their number as a bound."""

import numpy as np
import pytest

from foretally.operators import cluster as cl


def plain(points, load, centres, tolerance=1e-9):
    for n in range(5000):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([np.average(points[own == c], axis=0, weights=load[own == c]) if (own == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = np.abs(means - centres).max(), means
        if moved <= tolerance:
            return centres, n + 1


def test_many_rounds_settle(spark):
    """A group that needs more rounds than passes are allowed settles, in the state plain rounds come to."""
    rng = np.random.default_rng(0)
    points = rng.uniform(size=(20000, 4))
    df = spark.createDataFrame([(0, *map(float, p)) for p in points], "g int, a double, b double, c double, d double")
    out, centres = cl.grouped_kmeans(df, ["g"], ["a", "b", "c", "d"], 4, 3, rounds=30)
    got = np.array(centres.first()["centres"])
    assert plain(points, np.ones(len(points)), got)[1] == 1
    own = ((points[:, None] - got[None]) ** 2).sum(axis=2)
    assert out.count() == 20000 and out.agg({"d2": "sum"}).first()[0] == pytest.approx(own.min(axis=1).sum())


def test_rounds_in_a_task():
    rng = np.random.default_rng(1)
    points, load = rng.normal(size=(300, 2)), rng.uniform(1, 3, 300)
    want, needed = plain(points, load, points[:3])
    assert needed > 2 and np.allclose(cl._settled(points, load, points[:3], 200, 1e-9)[0], want, atol=1e-12)
    far = np.array([[1e6, 1e6]])  # a centre without rows stays where it is
    assert (cl._settled(points, load, np.vstack([points[:2], far]), 200, 1e-9)[0][2] == far).all()
    assert cl._settled(points, load, points[:3], 1, 1e-9)[1] > 1e-9


def test_groups_in_tasks_give_what_rounds_over_all_give(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else float("nan") if i % 3 == 1 else 1.0, i, *map(float, rng.normal(size=2)), 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame([*rows, *rows[:30]], "g double, i int, a double, b double, w double")
    told, rounds = [], []
    for local in (cl.LOCAL, 0):
        monkeypatch.setattr(cl, "LOCAL", local)
        collected = []
        keep = type(df).collect
        monkeypatch.setattr(type(df), "collect", lambda d: collected.append(1) or keep(d))
        out, centres = cl.grouped_kmeans(df, ["g"], ["a", "b"], 3, 1, weight="w")
        rounds.append(len(collected))
        monkeypatch.setattr(type(df), "collect", keep)
        told.append((sorted((str(r["g"]), r["i"], r["cluster"], round(r["d2"], 9)) for r in out.collect()),
                     sorted((str(r["g"]), [[round(x, 9) for x in c] for c in r["centres"]]) for r in centres.collect())))
    assert told[0] == told[1] and rounds[0] < rounds[1]
    with pytest.raises(ArithmeticError):
        monkeypatch.setattr(cl, "LOCAL", 1 << 23)
        cl.grouped_kmeans(df, ["g"], ["a", "b"], 3, 1, rounds=1)
