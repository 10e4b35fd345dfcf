"""Near duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, its sketch the ``k`` least hashes of the set. Documents with
equal sets are one class from the start. Inverted lists of retained values bring classes together: two
sets alike enough share so many retained values that the rarest ones of each sketch must meet. A pair
from a list is estimated from the union of its sketches, then confirmed on the full sets. Long lists are
settled by their own links: members meet one representative, and classes already linked are not compared
again. Where members stay apart, their full sets are listed anew, by the hashes that a link must rest on.
What is still apart in those lists meets block by block inside a task, as bit fields of the full sets: bits
that one side alone has bound the overlap from above, and only pairs that the bound lets through leave
the task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.components import connected, extended
from foretally.llm.store import small_batches, stored

K = 64
#: Size bands of the full sets' lists in the range that the threshold leaves to a partner.
BANDS = 8
#: Rounds at most in which lists meet a representative before the rest is paired, and pairs per list entry that end them.
ROUNDS = 4
ENOUGH = 2
#: Share of the work left by a round from which on no further round is worth it.
GAIN = 0.5
#: Members of a list that meet others in one step, about, and bits of a field: at least and at most.
BLOCK = 512
FIELD = (1 << 8, 1 << 16)
#: Rows of an Arrow batch that hold a whole text or a full set, a pair of full sets, and a pair of blocks.
TEXTS, PAIRS, MEETINGS = 1024, 512, 4


def least_common(percent: int, k: int) -> float:
    """Share of the union's k least hashes that two sets at the threshold have in common, less six deviations."""
    p = percent / 100
    return max(0.0, p - 6 * math.sqrt(p * (1 - p) / k))


def _sets(docs: DataFrame, width: int, k: int | None) -> DataFrame:
    """(doc_id, n, d1, d2, hashes): size and digest of each row's set, its k least hashes or all."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in tokens.chunks(batch.column(1), tokens.SMALL):
                data = tokens.lowered(data)
                starts, stops, rows = tokens.word_bounds(data, offsets)
                hashes, ends = tokens.shingles(tokens.word_codes(data, starts, stops), rows, width)
                sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                digest = np.frombuffer(b"".join(
                    hashlib.blake2b(s, digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                kept = [s[:k] for s in sets]
                sizes = np.concatenate(([0], np.cumsum([len(s) for s in kept])))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     tokens.longs(digest[:, 0]), tokens.longs(digest[:, 1]),
                     tokens.lists(np.concatenate(kept), sizes)],
                    names=["doc_id", "n", "d1", "d2", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, hashes array<long>")


def _lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, band, node, n): inverted lists of the rarest retained values of each class, stored.

    A set so small that no partner's sketch is cut keeps just enough values for the threshold to force
    a common one. Larger sketches of alike sets share at least a part of the union's k least values that
    follows from the threshold (half at 80 %; the chance of fewer is below 1e-7), so all but that part of
    the values, rarest first, must meet.
    Sizes of alike sets differ by the threshold at most, which splits lists into overlapping bands.
    """
    values = classes.select("node", "n", F.explode("hashes").alias("value"))
    often = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    whole = F.col("n") * 100 <= F.lit(k * percent)
    need = F.when(whole, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(
        F.least("n", F.lit(k)) - max(1, math.floor(k * least_common(percent, k) + 1e-9)) + 1)
    rare = (values.join(often, "value").groupBy("node", "n")
            .agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("known"))
            .withColumn("first", need - (F.least("n", F.lit(k)) - F.size("known")))
            .filter("first > 0")
            .select("node", "n", F.explode(F.slice("known", F.lit(1), F.col("first").cast("int"))).alias("x"))
            .select("node", "n", F.col("x.value").alias("value")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    banded = rare.select("value", F.explode(F.array(band, band + 1)).alias("band"), "node", "n")
    return stored(banded)


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch holds enough common values to be worth a full comparison."""
    a = sketches.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    b = sketches.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("least", F.slice(F.array_sort(F.array_union("x", "y")), 1, k))
    common = F.size(F.array_intersect(F.array_intersect("least", "x"), F.col("y")))
    return both.filter(common >= F.size("least") * (least_common(percent, k) - 1e-9)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(len(x), dtype=bool)
            for i in range(len(x)):
                p, q = (c[i].values.to_numpy(zero_copy_only=False) for c in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = common * 100 >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _exact_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(value, band, gap, side, place, node, n): lists of full sets, kept as far as a link can need them, stored.

    With a set's hashes in the order rarest first, two sets that share c hashes must meet within the
    first n - c + 1 of each. c follows from both sizes, so a hash is listed once for each band of sizes
    that a partner may have, if it stands early enough for that band. Lists of two bands (gap over 0)
    bring members of the one (side 0) to members of the other (1).
    """
    often = stored(sets.select(F.explode("hashes").alias("value")).groupBy("value")
                   .agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    step = math.log(100 / percent) / BANDS
    n, n_known, other = F.col("n"), F.size("known"), F.col("band") + F.col("off")
    ranked = (sets.select("node", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("value"))
              .join(often, "value").groupBy("node", "n")
              .agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("known"))
              .withColumn("band", F.floor(F.log(n.cast("double")) / step).cast("int"))
              .withColumn("off", F.explode(F.sequence(F.lit(-BANDS), F.lit(BANDS)))))
    least = F.greatest(F.ceil(n * percent / 100), F.floor(F.exp(other * step) - 1e-6).cast("long"))
    common = F.ceil((n + least) * percent / (100 + percent))
    return stored(ranked.withColumn("first", (n_known - common + 1).cast("int")).filter("first > 0")
                  .select(F.posexplode(F.slice("known", F.lit(1), F.col("first"))).alias("at", "x"), n_known.alias("k"),
                          F.least("band", other).alias("band"), F.abs("off").alias("gap"),
                          (F.col("off") < 0).cast("int").alias("side"), "node", "n")
                  .select("x.value", "band", "gap", "side", (n - F.col("k") + F.col("at")).alias("place"), "node", "n"))


def _links(docs: DataFrame, classes: DataFrame, width: int, k: int, percent: int) -> DataFrame | None:
    """(node, label): components of the classes that are linked with others, stored."""
    lists = _lists(classes, k, percent)
    nodes = lists.select("node").distinct()
    sketches = stored(classes.select("node", "hashes").join(nodes, "node"))
    mine = docs.select(F.col("doc_id").cast("long"), "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id")
    with small_batches(docs.sparkSession, TEXTS):
        sets = stored(_sets(mine, width, None).select(F.col("doc_id").alias("node"), "hashes"))

    def linked(pairs: DataFrame, rows: int = PAIRS) -> DataFrame:
        with small_batches(docs.sparkSession, rows):
            return stored(_confirmed(_estimated(pairs, sketches, k, percent), sets, percent))

    key = ["value", "band", "gap"]
    lists = lists.select("value", "band", F.lit(0).alias("gap"), F.lit(0).alias("side"), F.lit(0).alias("place"), "node", "n")
    labels = connected(linked(_to_heads(lists.withColumn("label", F.col("node")), key, 0, percent)))
    # Only members of lists that hold several components still can be linked anew.
    apart = _unsettled(_labelled(lists, labels), key)
    open_nodes = stored(apart.select("node").distinct())
    lists = _exact_lists(sets.join(open_nodes, "node"), percent)
    with small_batches(docs.sparkSession, TEXTS):
        fields = stored(_fields(sets.join(open_nodes, "node")))
    before = math.inf
    for turn in range(1, ROUNDS + 1):
        apart = stored(_unsettled(_labelled(lists, labels), key))
        main = (apart.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("m")).groupBy(*key)
                .agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("total")))
        work, size = main.agg(F.sum((F.col("total") - F.col("main.m")) * F.col("total")), F.sum("total")).first()
        if not size:
            return labels
        # A representative that leaves most of the work has little to settle: the rest is paired.
        last = turn == ROUNDS or work <= ENOUGH * size or work > before * GAIN
        before = work
        labels = extended(labels, linked(_apart(apart, main, fields, key, percent), MEETINGS) if last
                          else linked(_to_heads(apart, key, turn, percent)))
        if last:
            return labels


def _reach(n: str, place: str, m: str, other: str, percent: int) -> Column:
    """Whether two sets can be alike if nothing before these places of their orders is common."""
    most = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other))
    return most * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _unsettled(lists: DataFrame, key: list[str]) -> DataFrame:
    """Entries of the lists whose members are not all in one component yet."""
    several = (lists.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       (F.max("side") - F.min("side") + 1).alias("sides"))
               .filter("low < high and (gap = 0 or sides = 2)"))
    return lists.join(stored(several.select(*key)), key)


def _to_heads(lists: DataFrame, key: list[str], turn: int, percent: int) -> DataFrame:
    """Pairs of each list's members with one of them, another one in each turn."""
    order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    heads = stored(lists.groupBy(*key).agg(F.min(F.struct(order.alias("order"), "node", "n", "label", "side", "place")).alias("head")))
    meet = (F.col("gap") == 0) | (F.col("side") != F.col("head.side"))
    near = _reach("n", "place", "head.n", "head.place", percent)
    return (lists.join(heads, key).filter(near & meet).filter(F.col("label") != F.col("head.label"))
            .select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct())


def _fields(sets: DataFrame) -> DataFrame:
    """(node, bits): a bit for each hash of a set, in a field a few times the set's size."""
    def run(batches):
        for batch in batches:
            out = []
            for hashes in batch.column(1):
                values = hashes.values.to_numpy(zero_copy_only=False)
                size = min(max(FIELD[0], 1 << (4 * len(values)).bit_length()), FIELD[1])
                field = np.zeros(size, dtype=bool)
                field[values & (size - 1)] = True
                out.append(np.packbits(field).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "bits"])

    return sets.select("node", "hashes").mapInArrow(run, "node long, bits binary")


def _folded(fields: list[bytes], size: int) -> np.ndarray:
    """Fields of ``size`` bytes as rows of words; longer ones are laid over themselves."""
    out = np.empty((len(fields), size), dtype=np.uint8)
    for i, field in enumerate(fields):
        out[i] = np.bitwise_or.reduce(np.frombuffer(field, dtype=np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def _survivors(left: dict, right: dict, crossing: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block's odd members with another block's members that the bounds let through."""
    size = min(map(len, [*left["bits"], *right["bits"]]))
    mine, theirs = _folded(left["bits"], size), _folded(right["bits"], size)
    a, b = [], []
    for x in np.flatnonzero(left["few"]):
        n, m = left["n"][x], right["n"]
        most = np.minimum(n - left["place"][x], m - right["place"])
        meet = (left["label"][x] != right["label"]) & (most * (100 + percent) >= (n + m) * percent)
        meet &= ~right["few"] | (left["node"][x] < right["node"])
        if crossing:
            meet &= left["side"][x] != right["side"]
        at = np.flatnonzero(meet)
        if len(at):
            other, m = theirs[at], m[at]
            # A bit that one side alone has stands for a hash, at least, that the other lacks.
            common = np.minimum(n - np.bitwise_count(mine[x] & ~other).sum(axis=1, dtype=np.int64),
                                m - np.bitwise_count(other & ~mine[x]).sum(axis=1, dtype=np.int64))
            at = at[common * (100 + percent) >= (n + m) * percent]
            a.append(np.full(len(at), left["node"][x]))
            b.append(right["node"][at])
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    return np.minimum(a, b), np.maximum(a, b)


def _apart(lists: DataFrame, main: DataFrame, fields: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs that may be alike of a list's members that no link joins yet, seen from those outside its largest component.

    Members are dealt to bounded blocks; each block with odd members meets each block of its list.
    """
    most = stored(main.select(*key, F.col("main.label").alias("most"), F.ceil(F.col("total") / BLOCK).alias("blocks")))
    member = F.struct("node", "n", "label", "side", "place", (F.col("label") != F.col("most")).alias("few"), "bits")
    blocks = stored(lists.join(most, key).join(fields, "node")
                    .groupBy(*key, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
                    .agg(F.max((F.col("label") != F.col("most")).cast("int")).alias("odd"), F.collect_list(member).alias("members")))
    odd = blocks.filter("odd = 1").select(*key, F.col("members").alias("rest"))

    def columns(members: pa.Array) -> dict:
        flat = members.flatten()
        out = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("node", "n", "label", "side", "place", "few")}
        return out | {"bits": flat.field("bits").to_pylist()}

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                a, b = _survivors(columns(one.column("rest")), columns(one.column("members")), one.column("gap")[0].as_py() > 0, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return odd.join(blocks, key).select("gap", "rest", "members").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """Components of documents whose shingle sets are at least ``percent`` alike by Jaccard.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id
    (the least doc_id reached, itself included) and kept (it is that least one), a row for each row.
    Words are runs of anything but blanks, tabs and line ends, with A-Z lowered. A text of fewer than
    ``width`` words is one shingle; null and empty texts have none and are linked with nothing. Rows that
    repeat a doc_id all get the least component that any of them reaches. Rows without doc_id are
    compared with nothing: component_id is null, kept is true. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession, TEXTS):
        sets = stored(_sets(docs, width, k))
    named = sets.filter("doc_id is not null")
    first = stored(named.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    classes = stored(named.join(first.withColumnRenamed("node", "doc_id"), ["d1", "d2", "doc_id"])
                     .dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("node"), "n", "hashes"))
    labels = _links(docs, classes, width, k, percent)
    member = (named.select("doc_id", "d1", "d2").join(first, ["d1", "d2"])
              .join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")))
    twice = member.groupBy("doc_id").agg(F.min("label").alias("label"))
    out = sets.select("doc_id", "n").join(twice, "doc_id", "left")
    mine = F.coalesce("label", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"),
                      (mine.isNull() | (mine == F.col("doc_id"))).alias("kept"))
