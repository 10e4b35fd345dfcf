"""Matches of blocks held in tasks: those of brute force, whatever the sizes of chunks, blocks and slices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foretally.operators import crosswalk as cw


def table(m, ids, ident):
    cells = [np.flatnonzero(row) for row in m]
    return pa.table({ident: pa.array(ids, pa.int64()), "__states": pa.array([[f"s{j}" for j in c] for c in cells], pa.list_(pa.string())),
                     "__values": pa.array([row[c] for row, c in zip(m, cells)], pa.list_(pa.float64()))})


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def brute(x, z, ids, top):
    sims = x @ z.T
    return [sorted(range(len(ids)), key=lambda j: (-round(s[j], 12), ids[j]))[:top] for s in sims]


def counts(kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "sparse":
        x, z = rng.poisson(0.15, (50, 40)), rng.poisson(0.15, (70, 40))
    elif kind == "alike":  # a few vectors, so that most scores tie
        some = rng.poisson(0.5, (4, 40))
        x, z = some[rng.integers(0, 4, 50)], some[rng.integers(0, 4, 70)] + (rng.random((70, 1)) < 0.02)
    else:
        x, z = rng.poisson(3, (50, 40)), rng.poisson(3, (70, 40))
    x[:, 0] += x.sum(axis=1) == 0
    z[:, 1] += z.sum(axis=1) == 0
    return unit(x.astype(float)), unit(z.astype(float))


@pytest.mark.parametrize("kind", ["sparse", "alike", "dense"])
@pytest.mark.parametrize("limits", [{}, {"DENSE": 0}, {"DENSE": 0, "STATE_SLICE": 7}, {"HELD": 0}, {"MOST": 5}, {"HELD": 0, "MOST": 5, "STATE_SLICE": 7}])
def test_best_of_a_block(monkeypatch, kind, limits):
    for name, value in limits.items():
        monkeypatch.setattr(cw, name, value)
    for seed, (chunk, top) in enumerate([(70, 2), (9, 1), (6, 5), (4, 3), (16, 80)]):
        x, z = counts(kind, seed)
        ids = np.random.default_rng(seed).permutation(1000)[:70]
        block = cw._Block(table(z, ids, "__b"), "__b", chunk)
        block.keep_whole()
        mine = cw._Block(table(x, range(50), "__a"), "__a", 50, block.known)
        a, b, sims = cw._chunk_matches(mine, block, top)
        got = [b[a == i].tolist() for i in range(50)]
        assert got == brute(x, z, ids.tolist(), top)
        assert np.allclose(sims, (x @ z.T)[a, b], rtol=0, atol=1e-14)


def test_near_scores_need_double_precision(monkeypatch):
    """Scores that single precision cannot tell apart are ranked as double precision does."""
    rng = np.random.default_rng(1)
    z = unit(1 + 1e-6 * rng.random((300, 30)))
    block = cw._Block(table(z, range(300), "__b"), "__b", 20)
    block.keep_whole()
    x = unit(1 + rng.random((10, 30)))
    a, b, _ = cw._chunk_matches(cw._Block(table(x, range(10), "__a"), "__a", 10, block.known), block, 3)
    assert [b[a == i].tolist() for i in range(10)] == brute(x, z, list(range(300)), 3)


def test_chunks_that_cannot_win_are_not_met(monkeypatch):
    z = np.kron(np.eye(10), np.ones((8, 3)))
    block = cw._Block(table(unit(z), range(80), "__b"), "__b", 8)
    block.keep_whole()
    met, meet = [], cw._Best.meet
    monkeypatch.setattr(cw._Best, "meet", lambda self, theirs: met.append(theirs) or meet(self, theirs))
    cw._chunk_matches(cw._Block(table(unit(z[16:24]), range(8), "__a"), "__a", 8, block.known), block, 2)
    assert met == [slice(16, 24)]


def test_entities_travel_to_blocks(spark):
    """A task is a block of the right side, which comes first, and a part of the left; null keys are keys; one side alone makes none."""
    cells = spark.range(600).selectExpr("nullif(id % 3, 2) k", "id div 4 e", "concat('s', id % 7) state", "0.5D v")
    left = cw.packed(cells.filter("k IS NULL OR k = 0"), ["k"], "e", "state")
    right = cw.packed(cells.filter("k IS NULL OR k = 1").withColumnRenamed("e", "o"), ["k"], "o", "state")
    rows, tasks = cw._dealt(left, right, ["k"], "e", "o", 5)
    got = rows.groupBy(*cw.TASK, "__side").agg(F.count("*").alias("n"), F.count_distinct("k").alias("k")).collect()
    n = {s: (f"__{'ab'[1 - s]}", rows.filter(F.col("__side") == s)) for s in (0, 1)}
    assert tasks == len({tuple(r[c] for c in cw.TASK) for r in got}) == -(-right.filter("k IS NULL").count() // 5) * -(-left.filter("k IS NULL").count() // (5 * cw.SPAN))
    assert rows.filter("k IS NOT NULL").isEmpty() and not left.filter("k = 0").isEmpty()
    assert rows.filter("__side = 1").count() == left.filter("k IS NULL").count() * -(-right.filter("k IS NULL").count() // 5)


def test_matches_are_packed_once(spark, monkeypatch):
    """Nothing but entities and matches is stored: no table of pairs of chunks."""
    kept, stored, checkpoints = [], cw.session.stored, []
    monkeypatch.setattr(cw.session, "stored", lambda d: kept.append(d.columns) or stored(d))
    keep = cw.session.checkpoint
    monkeypatch.setattr(cw.session, "checkpoint", lambda d: checkpoints.append(d.columns) or keep(d))
    a = spark.range(400).selectExpr("cast(id % 2 as int) season", "id % 3 h", "id % 20 a", "id * id % 11 st")
    b = a.select("season", "h", (F.col("a") + 100).alias("b"), "st")
    out = cw.match_seasons(a, b, "season", "h", "a", "b", "st")
    assert len(kept) == 3 and checkpoints == [["season", "h", "__parts", "__blocks", "__key"]]
    best = out.filter("rank = 1").select("season", "a", "b", "similarity").collect()
    assert len(best) == 60 and all(round(r["similarity"], 9) == 1 for r in best)


def test_level_counts_in_one_pass(spark):
    rows = spark.range(200).selectExpr("nullif(id % 7, 3) e", "cast(id % 3 as int) x", "nullif(concat('l', id % 4), 'l2') y", "cast(id % 5 as double) z")
    got = {(r["e"], r["feature"], r["level"]): r["n"] for r in cw.level_counts(rows, "e", ["x", "y", "z"]).collect()}
    want = {}
    for r in rows.collect():
        for f in ("x", "y", "z"):
            if r[f] is not None:
                key = (r["e"], f, str(r[f]))
                want[key] = want.get(key, 0) + 1
        want[r["e"], None, None] = want.get((r["e"], None, None), 0) + 1
    assert got == want
    shares = cw.share_fingerprint(rows, "e", ["x", "y"]).collect()
    assert {(r["e"], r["state"]): r["share"] for r in shares} == pytest.approx({
        (e, f"{f}={v}"): n / sum(m for (e2, f2, _), m in want.items() if (e2, f2) == (e, f))
        for (e, f, v), n in want.items() if e is not None and f in ("x", "y")})
    assert cw.level_counts(rows, "e", ["x", "y", "z"])._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
