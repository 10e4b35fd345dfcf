"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle set, in powers of two. Each keeps the least hashes of
its set as its sketch. A document that contains most of an item contains most of the item's sketch, no
matter how long the document is, so a document is probed with its shingles against the sketches of the
partitions it is large enough for; a large enough share found makes a candidate, which the full sets
confirm. Small item sets are their own sketches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.store import stored

WIDTH = 5
PERCENT = 80
SKETCH = 48
#: Hashes of items (sets and sketches) that are sent to every executor; beyond, both sides are shuffled.
SENT = 4_000_000


def _shingled(docs: DataFrame, key: str, widths: list[int] | None, width: int) -> DataFrame:
    """(key, width, hashes): each text's distinct shingles, at its own width or at each of ``widths``."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tokens.chunks(batch.column(1), tokens.SMALL):
                data = tokens.lowered(data)
                starts, stops, rows = tokens.word_bounds(data, offsets)
                codes, length = tokens.word_codes(data, starts, stops), np.diff(rows)
                for w in widths or [width]:
                    hashes, ends = tokens.shingles(codes, rows, w)
                    use = length > 0 if widths is None else length >= w
                    sets = [np.unique(hashes[ends[i]:ends[i + 1]]) for i in np.flatnonzero(use)]
                    own = np.minimum(length[use], w)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).filter(pa.array(use)), pa.array(own, pa.int32()),
                         tokens.lists(np.concatenate(sets) if sets else np.zeros(0, np.uint64),
                                      np.concatenate(([0], np.cumsum([len(s) for s in sets]))))],
                        names=[key, "width", "hashes"])

    return docs.select(F.col(key).cast("long"), "text").filter(F.col(key).isNotNull()).mapInArrow(
        run, f"{key} long, width int, hashes array<long>")


class Probe:
    """Sketches of all items, by width and size partition, ready to be looked up."""

    def __init__(self, items: pa.Table, percent: int, k: int):
        self.percent, self.k = percent, k
        self.ids = items.column("item_id").to_numpy()
        self.sets = [x.values.to_numpy(zero_copy_only=False) for x in items.column("hashes")]
        self.parts: dict[int, list] = {}
        widths = items.column("width").to_numpy()
        size = np.array([len(s) for s in self.sets], dtype=np.int64)
        power = np.floor(np.log2(np.maximum(size, 1))).astype(int)
        for w, p in sorted(set(zip(widths.tolist(), power.tolist()))):
            inside = np.flatnonzero((widths == w) & (power == p))
            values = np.concatenate([self.sets[i][:k] for i in inside])
            owner = np.repeat(inside, [min(k, size[i]) for i in inside])
            order = np.argsort(values, kind="stable")
            self.parts.setdefault(w, []).append((-(-percent * (1 << p) // 100), values[order], owner[order]))

    def found(self, w: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(item, common shingles) of the items that a set of width ``w`` contains."""
        out = []
        for least, values, owner in self.parts.get(w, ()):
            if len(hashes) < least:
                continue
            # The document's shingles beyond the partition's largest sketch value cannot meet one.
            near = hashes[:np.searchsorted(hashes, values[-1], side="right")]
            low = np.searchsorted(values, near, side="left")
            hit = np.flatnonzero((low < len(values)) & (values[np.minimum(low, len(values) - 1)] == near))
            if not len(hit):
                continue
            many = np.searchsorted(values, near[hit], side="right") - low[hit]
            at = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            items, shared = np.unique(owner[at], return_counts=True)
            for item, some in zip(items, shared):
                mine = self.sets[item]
                if some * 200 < min(self.k, len(mine)) * self.percent:
                    continue
                place = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                common = int((hashes[place] == mine).sum())
                if common * 100 >= self.percent * len(mine):
                    out.append((item, common))
        return out


def _probed(docs: DataFrame, probe: Probe) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc, item, n, shared = [], [], [], []
            for key, w, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, common in probe.found(w, row.values.to_numpy(zero_copy_only=False)):
                    doc.append(key)
                    item.append(int(probe.ids[i]))
                    n.append(len(probe.sets[i]))
                    shared.append(common)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, item, n, shared)],
                                             names=["doc_id", "item_id", "n_item", "n_shared"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")


def _joined(docs: DataFrame, items: DataFrame, percent: int, k: int) -> DataFrame:
    """The same by shuffles, for any number of items: sketches meet shingles, candidates meet full sets."""
    sized = items.withColumn("n_item", F.size("hashes").cast("long"))
    sketch = sized.select("item_id", "width", "n_item", F.explode(F.slice("hashes", 1, k)).alias("hash"))
    shingle = docs.select("doc_id", "width", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    near = (shingle.join(sketch, ["width", "hash"]).filter(F.col("n") * 100 >= F.col("n_item") * percent)
            .groupBy("doc_id", "item_id", "width", "n_item").agg(F.count(F.lit(1)).alias("some"))
            .filter(F.col("some") * 200 >= F.least(F.lit(k), "n_item") * percent))
    full = near.join(sized.select("item_id", "width", "hashes"), ["item_id", "width"]).select(
        "doc_id", "item_id", "width", "n_item", F.explode("hashes").alias("hash"))
    return (full.join(shingle.select("doc_id", "width", "hash"), ["doc_id", "width", "hash"])
            .groupBy("doc_id", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
            .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent))


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                    k: int = SKETCH, sent: int = SENT) -> DataFrame:
    """Items of which a document has at least ``percent`` of the distinct word shingles.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Returns
    doc_id, item_id, n_item (shingles of the item), n_shared and containment. Words are runs of anything
    but blanks, tabs and line ends, with A-Z lowered. An item of fewer than ``width`` words is one shingle,
    looked for among the documents' shingles of as many words. Items without words, null texts and rows
    without an id match nothing. Repeated documents match once; an item_id with several texts is several
    items that answer under one id, of which the best counts. Empty tables give an empty result.
    """
    items = stored(_shingled(benchmark, "item_id", None, width).dropDuplicates(["item_id", "hashes"]))
    seen = items.groupBy("width").agg(F.sum(F.size("hashes")).alias("n")).collect()  # at most ``width`` rows
    texts = _shingled(docs, "doc_id", sorted(r["width"] for r in seen) or [width], width)
    if sum(r["n"] for r in seen) <= sent:
        raw = _probed(texts, Probe(items.orderBy("item_id").toArrow(), percent, k)) if seen else texts.select(
            "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "n_item", "n_shared"))).limit(0)
    else:
        raw = _joined(texts.dropDuplicates(["doc_id", "width", "hashes"]), items, percent, k)
    best = raw.withColumn("containment", F.col("n_shared") / F.col("n_item")).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("containment", "n_item", "n_shared")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")


def contained_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), "
             rf"'[\x20\x09-\x0D]+'), lambda x: x <> '')")
    return f"""
WITH item AS (SELECT item_id, w, least(len(w), {width}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark)
              WHERE len(w) > 0),
doc AS (SELECT doc_id, {words} AS w FROM documents),
mine AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM item)),
theirs AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                 FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
total AS (SELECT item_id, count(*) AS n_item FROM mine GROUP BY ALL)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM mine JOIN theirs USING (k, s) JOIN total USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= {percent} * n_item"""
