"""Repeated spans of words, found as compacted paths of a de Bruijn graph.

Edges are windows of ``window`` consecutive words. Windows that share a minimizer are packed into
segments (paths inside one bucket of the graph), segments with equal hashes are counted by Spark, and
a segment that is always followed by the same next one, as often, is joined to it: a repeated
nonbranching path is one row with its source, the least place where it stands. The join is checked by
the source places: the next segment's source has to begin where this one's ends. Buckets that hold
different segments branch; their windows are compared edge by edge.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foretally.llm import segments as seg, tokens
from foretally.llm.store import stored

WINDOW = 20
KMER = 6


def paths(alike: DataFrame) -> DataFrame:
    """Repeated nonbranching paths: (h1, h2) of the first segment, n, source doc_id and first, windows."""
    often = alike.filter("n > 1")
    ahead = often.filter("after is not null").select(
        F.col("after").alias("h2"), F.col("n"), F.col("doc_id"), (F.col("first") + F.col("windows")).alias("first"))
    joined = often.join(ahead.withColumn("joins", F.lit(1)), ["h2", "n", "doc_id", "first"], "left")
    order = Window.partitionBy("doc_id").orderBy("first")
    # Only a path's first segment is not joined to the one before it.
    numbered = joined.withColumn("path", F.sum(F.when(F.col("joins").isNull(), 1).otherwise(0)).over(order))
    return numbered.groupBy("doc_id", "path").agg(
        F.sum("windows").alias("windows"), F.min(F.struct("first", "h1", "h2", "n")).alias("head")).select(
        "doc_id", "windows", "head.*")


def _edges(docs: DataFrame, alike: DataFrame, window: int) -> DataFrame:
    """(h1, edge, doc_id, first) of every window of the branching classes' sources, stored."""
    places = alike.filter("kin > 1").groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "windows", "h1")).alias("at"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    joined = texts.join(places, "doc_id").select("doc_id", "text", "at.first", "at.windows", "at.h1")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tokens.chunks(batch.column(1)):
                starts, stops, rows = tokens.word_bounds(data, offsets)
                rolling = tokens.Rolling(tokens.word_codes(data, starts, stops))
                columns = [batch.column(i).slice(lo, hi - lo) for i in (2, 3, 4)]
                first, many, kmer = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
                owner = np.repeat(np.arange(hi - lo), columns[0].value_lengths().to_numpy(zero_copy_only=False))
                many = many.astype(np.int64)
                ends = np.cumsum(many)
                at = np.repeat(first - (ends - many), many) + np.arange(ends[-1])
                owner, kmer = np.repeat(owner, many), np.repeat(kmer, many)
                begin = at + rows[owner]
                inside = begin + window <= rows[owner + 1]  # not so where a doc_id has several texts
                owner, kmer, at, begin = owner[inside], kmer[inside], at[inside], begin[inside]
                yield pa.RecordBatch.from_arrays(
                    [tokens.longs(kmer), tokens.longs(rolling.run(begin, begin + window)),
                     batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), tokens.longs(at)],
                    names=["h1", "edge", "doc_id", "first"])

    return stored(joined.mapInArrow(run, "h1 long, edge long, doc_id long, first long"))


def later_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, first, windows): runs of windows whose words also start at a lesser place."""
    found = seg.shared(docs, seg.word_coder, window, kmer)
    alike = seg.classes(found)
    heads = paths(alike).select("h1", "h2", F.col("windows").alias("run"), F.col("doc_id").alias("source_doc"),
                                F.col("first").alias("source_first"))
    whole = (found.join(heads, ["h1", "h2"])
             .filter("doc_id <> source_doc or first <> source_first")
             .select("doc_id", "first", F.col("run").alias("windows")))
    edges = _edges(docs, alike, window)
    sources = stored(edges.groupBy("h1", "edge").agg(F.count(F.lit(1)).alias("n"),
                                                     F.min(F.struct("doc_id", "first")).alias("source"))
                     .filter("n > 1").select("h1", "edge", "source"))
    single = (edges.join(sources, ["h1", "edge"])
              .filter("struct(doc_id, first) <> source")
              .select("doc_id", "first", F.lit(1).cast("long").alias("windows")))
    return whole.unionByName(single)


def dedup_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Remove every word covered by ``window`` consecutive words that also start at a lesser place.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed,
    kept_text (the words left, joined by blanks). Words are runs of anything but blanks, tabs and line
    ends. Windows are judged on the texts as they came. A null or empty text has no words and keeps an
    empty text; texts shorter than a window lose nothing. Rows without doc_id have no place in the
    order: they lose nothing and nothing is removed for their sake. Rows that repeat a doc_id stand at
    the same places, so they do not remove each other's words, and they lose the same words. An empty
    table gives an empty result.
    """
    marked = seg.with_spans(docs, later_spans(docs, window, kmer))

    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            rows = (batch.column(i) for i in range(1, 4))
            for text, starts, sizes in zip(*(c.to_pylist() if i else c for i, c in enumerate(rows))):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if starts:
                    lost = seg.covered(starts, sizes, window, len(words))
                    gone.append(int(lost.sum()))
                    words = compress(words, (~lost).tolist())
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
