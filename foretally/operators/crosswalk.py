"""Entity resolution between two logs by the cosine of their state counts.

The right side's entities of a key are dealt to blocks. A task holds one block while the left side's entities
stream past in chunks, and returns only the best few matches per entity, so neither a hot state nor a large
group produces rows per pair. Pairs of chunks that cannot hold a better match are not met. Products are taken
in single precision; every match that their rounding cannot rule out is weighed again in double precision, so
the final ranking over blocks is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from foretally import session
from foretally.operators.joins import null_safe_join
from foretally.operators.ordered import History
from foretally.roles import Order

CHUNK = 1024
STATE_SLICE = 4096
#: Chunks of a block and cells that it holds, about at most; blocks' worth of left entities that one task meets.
CHUNKS, CELLS, SPAN = 16, 1 << 20, 12
#: Values of a block's matrix up to which it is kept whole.
DENSE = 1 << 24
#: Similarities that are nothing in twelve digits stay below this.
NOTHING = 4e-13
#: Matches in single precision for each one wanted that an entity may hold after a chunk, and matches that a chunk may hold.
HELD, MOST = 32, 1 << 19
#: What numbers a task: its key, its block of the right side and its part of the left one.
TASK = ["__key", "__blocks", "__parts"]
#: Best matches up to which they are taken one after the other.
ARGMAX = 16


def unit_vectors(df: DataFrame, keys: Sequence[str], entity: str, state: str,
                 weight: str | None = None) -> DataFrame:
    """Long unit vectors: keys, entity, state and value, with the entity's row count."""
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight).cast("double")
    cells = df.groupBy(*keys, entity, state).agg(value.alias("v"))
    own = Window.partitionBy(*keys, entity)
    return cells.withColumns({"__norm": F.sqrt(F.sum(F.col("v") * F.col("v")).over(own)), "rows": F.sum("v").over(own)}).withColumn(
        "v", F.col("v") / F.greatest(F.col("__norm"), F.lit(1e-9))).drop("__norm")


def _ranked(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest of every row; rounding makes equal scores tie, so the smaller column wins on every run."""
    even = np.round(sims, 12)
    if k > ARGMAX:
        return np.lexsort((np.broadcast_to(np.arange(sims.shape[1]), sims.shape), -even), axis=1)[:, :k]
    order, rows = np.empty((len(sims), k), dtype=np.int64), np.arange(len(sims))
    for i in range(k):
        order[:, i] = even.argmax(axis=1)
        even[rows, order[:, i]] = -np.inf
    return order


def _kept(found: list[tuple], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``top`` of every left entity over what several right chunks gave."""
    if len(found) == 1:
        return found[0]
    a, b, sims = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, -np.round(sims, 12), a))
    a, b, sims = a[order], b[order], sims[order]
    first = np.r_[True, a[1:] != a[:-1]]
    nth = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return a[nth < top], b[nth < top], sims[nth < top]


class _Block:
    """Entities in chunks: the cells of each side by side, their states numbered as in ``known``."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, ident: str, chunk: int, known: pa.Array | None = None):
        self.ids, states, v = (_whole(rows.column(c)) for c in (ident, "__states", "__values"))
        self.n, self.chunk = len(self.ids), chunk
        size = states.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), size)
        flat = states.flatten()
        self.known = flat.unique() if known is None else known
        at = pc.fill_null(pc.index_in(flat, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        shared = at >= 0  # a state that the other side lacks adds nothing
        self.at, self.owner, self.v = at[shared], owner[shared], v.flatten().to_numpy(zero_copy_only=False)[shared]
        self.ends = np.searchsorted(self.owner, np.arange(self.n + 1))
        self.chunks = [slice(i, min(i + chunk, self.n)) for i in range(0, self.n, chunk)]
        self.whole: np.ndarray | None = None

    def keep_whole(self) -> None:
        """Keep the matrix in single precision where it is small, and the ids' order, as equal scores are won by the smaller."""
        width = len(self.known)
        if width <= STATE_SLICE and self.n * width <= DENSE:
            self.whole = self.dense(slice(0, self.n), np.arange(width), width, np.float32)
        self.smallest = pc.sort_indices(self.ids).to_numpy().astype(np.int64)
        self.nth = np.empty(self.n, dtype=np.int64)
        self.nth[self.smallest] = np.arange(self.n)

    def dense(self, rows: slice, place: np.ndarray, width: int, kind: type) -> np.ndarray:
        """A matrix of these entities; ``place`` gives the column of each state, or -1."""
        inside = slice(self.ends[rows.start], self.ends[rows.stop])
        column = place[self.at[inside]]
        some = column >= 0
        out = np.zeros((rows.stop - rows.start, width), dtype=kind)
        out[self.owner[inside][some] - rows.start, column[some]] = self.v[inside][some]
        return out

    def peaks(self, start: int, width: int) -> np.ndarray:
        """Greatest weight of each chunk in each of ``width`` states."""
        out = np.zeros(len(self.chunks) * width)
        inside = (self.at >= start) & (self.at < start + width)
        np.maximum.at(out, self.owner[inside] // self.chunk * np.int64(width) + self.at[inside] - start, self.v[inside])
        return out.reshape(-1, width)


class _Best:
    """The best of a chunk's entities while the chunks of a block pass by."""

    def __init__(self, left: _Block, right: _Block, top: int):
        self.left, self.right, self.top, self.rows = left, right, min(top, right.n), slice(0, left.n)
        states = len(right.known)
        self.place, self.width = np.arange(states), states
        if right.whole is None:
            used = np.unique(left.at)
            self.place, self.width = np.full(states, -1, dtype=np.int64), len(used)
            self.place[used] = np.arange(len(used))
        self.slices = [(at, min(STATE_SLICE, self.width - at)) for at in range(0, self.width, STATE_SLICE)]
        self.mine = self._matrices(left, self.rows, np.float32)
        # No sum has more terms than an entity has cells, and none is negative: single precision is off by this share at most.
        self.slack = 2.5 * (np.diff(left.ends).max(initial=0) + 4) * 2.0 ** -24
        self.best = np.zeros((left.n, self.top), dtype=np.float32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # An entity's cells by entity and state.
        cells = left.owner * np.int64(states) + left.at
        order = np.argsort(cells, kind="stable")
        self.cells, self.weights = cells[order], left.v[order]

    def _matrices(self, side: _Block, rows: slice, kind: type) -> list[np.ndarray]:
        if side.whole is not None and kind is np.float32:
            return [side.whole[rows]]
        within = lambda at, w: self.place if w == self.width else np.where((self.place >= at) & (self.place < at + w), self.place - at, -1)
        return [side.dense(rows, within(at, w), w, kind) for at, w in self.slices]

    def _products(self, theirs: slice, kind: type) -> np.ndarray:
        mine = self.mine if kind is np.float32 else self._matrices(self.left, self.rows, kind)
        out = np.zeros((self.left.n, theirs.stop - theirs.start), dtype=kind)
        for i, (x, z) in enumerate(zip(mine, self._matrices(self.right, theirs, kind))):
            out = x @ z.T if i == 0 else out + x @ z.T
        return out

    def least(self) -> np.ndarray:
        """What further matches of each entity must reach in single precision."""
        return (np.maximum(self.best[:, -1].astype(float) * (1 - self.slack) - 1e-12, NOTHING) * (1 - 2.0 ** -22)).astype(np.float32)

    def _raise(self, rows: np.ndarray, sims: np.ndarray) -> None:
        both = np.concatenate([self.best[rows], sims], axis=1)
        self.best[rows] = -np.sort(-np.partition(both, both.shape[1] - self.top, axis=1)[:, -self.top:], axis=1)

    def meet(self, theirs: slice) -> None:
        """Keep what may be among the best of each entity after another chunk."""
        sims, least = self._products(theirs, np.float32), self.least()
        hit = np.flatnonzero(sims.max(axis=1) >= least)
        if not len(hit):
            return
        sims = sims[hit]
        r, c = np.nonzero(sims >= least[hit, None])
        if len(r) > 4 * self.top * len(hit):
            self._raise(hit, sims)
            r, c = np.nonzero(sims >= self.least()[hit, None])
        else:
            order = np.lexsort((-sims[r, c], r))
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            some, nth = order[nth < self.top], nth[nth < self.top]
            new = np.zeros((len(hit), self.top), dtype=np.float32)
            new[r[some], nth] = sims[r[some], c[some]]
            self._raise(hit, new)
        if len(r) > HELD * self.top * len(hit):
            self._weigh(theirs, hit)
        else:
            self.found.append((hit[r], c + theirs.start, sims[r, c]))
        if sum(len(f[0]) for f in self.found) > MOST:
            r, c, sims = self.told()
            self.found = [(r, c, sims.astype(np.float32))]

    def _weigh(self, theirs: slice, hit: np.ndarray) -> None:
        """Of a chunk where many score alike, the best of each entity by double precision and id."""
        by_id = np.argsort(self.right.nth[theirs])
        sims = self._products(theirs, np.float64)[hit][:, by_id]
        order = _ranked(sims, min(self.top, sims.shape[1]))
        r, c = np.repeat(hit, order.shape[1]), by_id[order.ravel()] + theirs.start
        self.found.append((r, c, np.take_along_axis(sims, order, 1).ravel().astype(np.float32)))

    def _exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Similarities of pairs in double precision."""
        right, out = self.right, np.zeros(len(r))
        if not len(self.cells):
            return out
        most = max(1, MOST // int(np.diff(right.ends).max(initial=1)))
        for at in range(0, len(r), most):
            some = slice(at, at + most)
            size = right.ends[c[some] + 1] - right.ends[c[some]]
            pair = np.repeat(np.arange(len(size)), size)
            cell = np.arange(size.sum()) + np.repeat(right.ends[c[some]] - np.cumsum(size) + size, size)
            wanted = r[some][pair] * len(right.known) + right.at[cell]
            place = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
            shared = self.cells[place] == wanted
            out[some] = np.bincount(pair[shared], self.weights[place[shared]] * right.v[cell[shared]], minlength=len(size))
        return out

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entity, other, similarity) of the best, by place in chunk and block."""
        right = self.right
        r, c, sims = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), *self.found))
        some = sims >= self.least()[r]
        # Entities that share no state with enough others find the smallest ids.
        short, spare = np.flatnonzero(self.best[:, -1] < 1e-11), right.smallest[:2 * self.top]
        r, c = np.concatenate([r[some], np.repeat(short, len(spare))]), np.concatenate([c[some], np.tile(spare, len(short))])
        pairs = np.unique(r * right.n + c)
        r, c = pairs // right.n, pairs % right.n
        none = np.zeros(0, dtype=np.int64)
        r, nth, sims = _kept([(r, right.nth[c], self._exact(r, c)), (none, none, np.zeros(0))], self.top)
        return r, right.smallest[nth], sims


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _chunk_matches(left: _Block, right: _Block, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a, place of b, similarity) of the best ``top`` of a right block for every entity of a left chunk.

    The block's chunk of highest bound is met first, the others only while their bound reaches what is still needed.
    """
    best, bound = _Best(left, right, top), np.zeros(len(right.chunks))
    for at in range(0, len(right.known), STATE_SLICE):
        width = min(STATE_SLICE, len(right.known) - at)
        bound += right.peaks(at, width) @ left.peaks(at, width).max(axis=0)
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] * (1 + best.slack) < best.least().min():
            break
        best.meet(right.chunks[i])
    return best.told()


def packed(vectors: DataFrame, keys: Sequence[str], entity: str, state: str) -> DataFrame:
    """A row for each entity of long unit vectors, stored: its states and their values as arrays, its heaviest state, its row count if told."""
    rows = vectors.groupBy(*keys, entity).agg(
        F.collect_list(F.struct(F.col(state).alias("state"), "v")).alias("__cells"), F.max_by(state, F.struct("v", state)).alias("__heavy"),
        *[F.first(c).alias(c) for c in vectors.columns if c == "rows"])
    return session.stored(rows.select("*", F.col("__cells.state").alias("__states"), F.col("__cells.v").alias("__values")).drop("__cells"))


def _dealt(lefts: DataFrame, rights: DataFrame, keys: Sequence[str], a: str, b: str, block: int) -> tuple[DataFrame, int]:
    """(both sides' entities with the number of their task and their side in it, number of tasks).

    A task has one block of the right side, which comes first, and the left entities of its key, in parts of
    ``SPAN`` blocks; so a left entity comes once for each block and a right one once for each part.
    """
    count = lambda side, own, most, cells: side.groupBy(*keys).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(F.size("__states")) / cells)).cast("int").alias(own))
    sizes = null_safe_join(count(lefts, "__parts", block * SPAN, CELLS * SPAN), count(rights, "__blocks", block, CELLS), keys, "inner")
    sizes = session.checkpoint(sizes.withColumn("__key", F.monotonically_increasing_id()))
    tasks = sizes.agg(F.sum(F.col("__parts").cast("long") * F.col("__blocks"))).first()[0] or 0

    def dealt(side: DataFrame, entity: str, own: str, other: str) -> DataFrame:
        rows = null_safe_join(side, sizes, keys, "inner")
        rows = rows.withColumn(own, F.pmod(F.xxhash64(entity, F.lit(9)), F.col(own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        idents = [F.col(e) if side is t else F.lit(None).cast(t.schema[e].dataType) for t, e in ((lefts, a), (rights, b))]
        return rows.select(*keys, *TASK, F.lit(int(side is lefts)).alias("__side"), "__heavy", idents[0].alias("__a"), idents[1].alias("__b"), "__states", "__values")

    return dealt(rights, b, "__blocks", "__parts").unionByName(dealt(lefts, a, "__parts", "__blocks")), tasks


def _runs(batch: pa.RecordBatch):
    """(task, side, rows) of each run of rows of one task and side."""
    at = [batch.column(c).to_numpy() for c in (*TASK, "__side")]
    cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1 if batch.num_rows else []
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield tuple(int(x[a]) for x in at[:-1]), int(at[-1][a]), batch.slice(a, b - a)


def _dealt_pairs(pairs: DataFrame, keys: Sequence[str], left: int, right: int) -> DataFrame:
    """Pairs of chunks ``l`` and ``r`` as one row for each pair of blocks that has any."""
    return pairs.groupBy(*keys, F.floor(F.col("l") / left).alias("mine_block"), F.floor(F.col("r") / right).alias("theirs_block")).agg(
        F.collect_list(F.struct("l", "r")).alias("pairs"))


def best_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str,
                 state: str, top: int, chunk: int = CHUNK) -> DataFrame:
    """Top matches by cosine for every left entity among right entities with equal keys; stored.

    ``left`` and ``right`` are long unit vectors, or what ``packed`` makes of them.
    Right entities of a key are dealt to blocks of about ``CHUNKS`` chunks, fewer where they have many cells, and a left
    entity travels once for each block. In a task an inverted index over the chunks' greatest weights bounds the cosine
    of any two of their members from above; a left chunk meets the block's chunks of highest bound first, and others
    only while their bound reaches what its members still need.
    Weights must not be negative. Entities that share no state with enough others find the smallest ids, at 0.
    """
    names = list(keys)
    types = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    b_type = right.schema[b].dataType.simpleString()
    lefts, rights = (v if "__states" in v.columns else packed(v, names, e, state) for v, e in ((left, a), (right, b)))
    rows, tasks = _dealt(lefts, rights, names, a, b, chunk * CHUNKS)

    def run(batches):
        task, kept, block = None, [], None
        for batch in batches:
            for at, side, rows in _runs(batch):
                if at != task:
                    task, kept, block = at, [], None
                if side == 0:
                    kept.append(rows)
                    continue
                if block is None:
                    block, kept = _Block(pa.Table.from_batches(kept), "__b", chunk), []
                    block.keep_whole()
                mine = _Block(rows, "__a", rows.num_rows, block.known)
                i, j, sims = _chunk_matches(mine, block, top)
                took = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(took) for k in names), mine.ids.take(took), block.ids.take(pa.array(j)), pa.array(sims)],
                                                 names=[*names, "a", "b", "similarity"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in names), f"a {types[a]}", f"b {b_type}", "similarity double"])
    # Few tasks of much work: more partitions than tasks, so that two of them seldom meet in one.
    dealt = rows.repartition(max(1, min(4 * tasks, 4096)), *TASK).sortWithinPartitions(*TASK, "__side", "__heavy", "__a", "__b")
    w = Window.partitionBy(*names, "a").orderBy(F.desc(F.round("similarity", 12)), "b")
    ranked = dealt.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    with session.arrow_rows(left.sparkSession, chunk):
        return session.stored(ranked.withColumnsRenamed({"a": a, "b": b}))


def match_seasons(left: DataFrame, right: DataFrame, season: str, hand: str, a: str, b: str,
                  state: str, top: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Ranked matches per season within the same hand; a lone candidate has second -1.

    Seasons with fewer than two right entities are left out.
    """
    keys = [season, hand]
    # Vectors are smaller than the logs; each log is read once.
    lv, rv = (packed(unit_vectors(d, keys, e, state), keys, e, state) for d, e in ((left, a), (right, b)))
    enough = rv.groupBy(season).agg(F.count_distinct(b).alias("__n")).filter("__n >= 2").select(season)
    rv = rv.join(F.broadcast(enough), season, "left_semi")
    ranked = best_matches(lv, rv, keys, a, b, state, top, chunk)
    sizes_a, sizes_b = (d.select(*keys, e, F.col("rows").cast("long").alias(n)) for d, e, n in ((lv, a, "a_n"), (rv, b, "b_n")))
    runner_up = F.max(F.when(F.col("rank") == 2, F.col("similarity"))).over(
        Window.partitionBy(*keys, a))
    out = ranked.withColumn("second", F.coalesce(runner_up, F.lit(-1.0)))
    return out.join(sizes_a, [*keys, a]).join(sizes_b, [*keys, b])


def hard_crosswalk(matches: DataFrame, season: str, a: str, b: str, min_similarity: float = 0.80,
                   min_margin: float = 0.02) -> DataFrame:
    """One-to-one mapping by votes of confident seasons."""
    top = matches.filter("rank = 1").withColumn("margin", F.col("similarity") - F.col("second"))
    ok = top.filter((F.col("similarity") >= min_similarity) & (F.col("margin") >= min_margin))
    votes = ok.groupBy(a, b).agg(
        F.countDistinct(season).alias("match_seasons"), F.avg("similarity").alias("mean_sim"),
        F.min("margin").alias("min_margin"), F.sum("a_n").alias("total_a_n"),
        F.sum("b_n").alias("total_b_n"), F.max(season).alias("evidence_max_season"))
    rank = [F.desc("match_seasons"), F.desc("mean_sim"), F.desc("total_a_n")]

    def first(df: DataFrame, key: str, tie: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*rank, tie)
        return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")

    return first(first(votes, a, b), b, a)


def soft_crosswalk(matches: DataFrame, season: str, hand: str, a: str, b: str, tau: float = 0.05,
                   floor: float = 0.60, min_weight: float = 1e-4) -> DataFrame:
    """Softmax weights over the top matches, zero below the floor, tiny weights dropped."""
    group = Window.partitionBy(season, hand, a)
    top = F.max("similarity").over(group)
    w = F.when(F.col("similarity") < floor, 0.0).otherwise(F.exp((F.col("similarity") - top) / F.lit(tau)))
    rows = matches.withColumns({"__w": w, "top1_sim": top}).withColumn("__t", F.sum("__w").over(group))
    rows = rows.filter("__t > 0").withColumn("w", F.col("__w") / F.col("__t"))
    ent = F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0)).over(group)
    out = rows.withColumns({"entropy": ent, "margin": F.col("top1_sim") - F.col("second")})
    return out.filter(F.col("w") > min_weight).select(season, a, b, "w", "top1_sim", "margin", "entropy")


def level_counts(df: DataFrame, entity: str, features: Sequence[str]) -> DataFrame:
    """Rows of every known feature level per entity in long form, and of the entity where feature is NULL; one pass over ``df``."""
    names, last = [entity, *features], len(features) - 1
    cells = df.groupingSets([[F.col(c) for c in names if c in (entity, f)] for f in (*features, entity)], *[F.col(c) for c in names]).agg(
        F.count(F.lit(1)).alias("__n"), F.grouping_id(*names).alias("__set"))
    number = {f: sum(1 << (last - i) for i, c in enumerate(features) if c != f) for f in features}
    told = lambda value: F.coalesce(*[F.when(F.col("__set") == number[f], value(f)) for f in features])
    long = cells.select(entity, told(F.lit).alias("feature"), told(lambda f: F.col(f).cast("string")).alias("level"), "__n")
    # Different values may read alike, so their counts are added up.
    return long.filter("level IS NOT NULL OR feature IS NULL").groupBy(entity, "feature", "level").agg(F.sum("__n").alias("n"))


def share_fingerprint(df: DataFrame, entity: str, features: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Share of every feature level per entity in long form; ``counts`` are the table's ``level_counts`` where they are at hand."""
    cells = (level_counts(df, entity, features) if counts is None else counts).filter("feature IS NOT NULL")
    total = F.sum("n").over(Window.partitionBy(entity, "feature"))
    return cells.filter(F.col(entity).isNotNull()).select(
        entity, F.concat_ws("=", "feature", "level").alias("state"), (F.col("n") / total).alias("share"))


def team_candidates(left: DataFrame, right: DataFrame, a: str, b: str, features: Sequence[str],
                    top: int = 3) -> DataFrame:
    """Most similar teams of two logs by level shares both logs know. Each log is read once."""
    ca, cb = (session.stored(level_counts(d, e, features)) for d, e in ((left, a), (right, b)))
    fa, fb = share_fingerprint(left, a, features, ca), share_fingerprint(right, b, features, cb)
    common = fa.select("state").distinct().intersect(fb.select("state").distinct())
    va, vb = (unit_vectors(f.join(common, "state", "left_semi").withColumn("__k", F.lit(0)),
                           ["__k"], e, "state", "share") for f, e in ((fa, a), (fb, b)))
    out = best_matches(va, vb, ["__k"], a, b, "state", top).drop("__k")
    na, nb = (c.filter("feature IS NULL").select(e, F.col("n").alias(n)) for c, e, n in ((ca, a, "a_n"), (cb, b, "b_n")))
    return out.join(na, a).join(nb, b).withColumn("volume_ratio", F.col("b_n") / F.col("a_n"))


def id_overlap(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct ids on both sides and how many are equal as text."""
    la = left.select(F.col(a).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    rb = right.select(F.col(b).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    count = lambda d: d.agg(F.count(F.lit(1))).scalar()
    return la.agg(F.count(F.lit(1)).alias("a_ids")).select(
        "a_ids", count(rb).alias("b_ids"), count(la.intersect(rb)).alias("overlap"))


def asof_embedding(crosswalk: DataFrame, profile: DataFrame, season: str, a: str, b: str,
                   dims: Sequence[str], cutoffs: Sequence[int], life: float = 2.0) -> DataFrame:
    """Profiles carried over soft weights, then recency-weighted over earlier seasons."""
    from foretally.functions.rates import half_life, ratio
    from foretally.operators.joins import spread_to_cutoffs
    m = crosswalk.join(profile, [b, season])
    per = m.groupBy(a, season).agg(*[
        ratio(F.sum(F.col(d) * F.col("w")), F.sum("w")).alias(d) for d in dims])
    past = spread_to_cutoffs(per, season, cutoffs).withColumn(
        "__w", half_life(F.col("cutoff") - F.col(season), life))
    return past.groupBy(a, "cutoff").agg(
        F.count(F.lit(1)).alias("seasons"), F.max(season).alias("last_season"),
        *[ratio(F.sum(F.col(d) * F.col("__w")), F.sum("__w")).alias(d) for d in dims])
