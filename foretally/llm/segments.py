"""Windows of whole texts, packed into segments that share a minimizer.

The windows of a text are the runs of a fixed number of tokens. Each window is ruled by its minimizer,
the k-mer of least hash in it (the leftmost of equal ones), so equal windows are ruled by equal k-mers
at equal places. Consecutive windows under one k-mer form a segment: one row stands for all of them.
Segments with equal hashes hold equal windows throughout; windows of different segments can only be
equal when both are ruled by the same k-mer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.store import stored

#: Tokens of one document looked at together; longer ones are cut into blocks whose windows overlap.
BLOCK = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)

#: Gives a chunk's token codes and the rows' offsets in them.
Coder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_coder(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, rows = tokens.word_bounds(data, offsets)
    return tokens.word_codes(data, starts, stops), rows


def byte_coder(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tokens.byte_codes(data), offsets


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def cut(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, k: int):
    """Segments of the blocks codes[begin:end]: block, first window, windows, hash of k-mer, segment and next segment."""
    if len(codes) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, *(none.view(np.uint64),) * 3
    rolling = tokens.Rolling(codes)
    kmers = rolling.every(k)
    ruled = least((kmers & ~_PLACE) | np.arange(len(kmers), dtype=np.uint64), window - k + 1)
    count = np.maximum(end - begin - window + 1, 0)
    ends = np.cumsum(count)
    start = np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    place = (ruled[start] & _PLACE).astype(np.int64)
    turn = np.ones(len(start), dtype=bool)
    turn[1:] = place[1:] != place[:-1]
    turn[(ends - count)[count > 0]] = True
    head = np.flatnonzero(turn)
    first, many = start[head], np.diff(np.append(head, len(start)))
    block = np.searchsorted(ends, head, side="right")
    whole = rolling.run(first, first + many + window - 1)
    after = np.append(whole[1:], np.uint64(0))
    after[np.flatnonzero(np.diff(block))] = 0
    return block, first, many, kmers[place[head]], whole, after


def blocks(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the blocks of each row; their windows are all the row's windows."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-(length - window + 1) // BLOCK))
    row = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[row] + nth * BLOCK
    return row, begin, np.minimum(begin + BLOCK + window - 1, offsets[row + 1])


def parts(codes: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Iterator[tuple]:
    """Arrays (row, first window in the row, windows, the three hashes), some blocks at a time."""
    row, begin, end = blocks(offsets, window)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + 2 * BLOCK, side="right")))
        block, first, *rest = cut(codes[begin[at]:end[to - 1]], begin[at:to] - begin[at],
                                  end[at:to] - begin[at], window, k)
        owner = row[at:to][block]
        yield owner, first + begin[at] - offsets[owner], *rest
        at = to


def segments(docs: DataFrame, coder: Coder, window: int, k: int) -> DataFrame:
    """(h1, h2, after, doc_id, first, windows) of every segment of ``docs`` (doc_id, text).

    h1 is the k-mer's hash, h2 the segment's, after the next segment's in the document (0: none).
    """
    schema = "h1 long, h2 long, after long, doc_id long, first long, windows int"

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in tokens.chunks(batch.column(1)):
                for row, first, many, *hashes in parts(*coder(data, offsets), window, k):
                    yield pa.RecordBatch.from_arrays(
                        [*map(tokens.longs, hashes), ids.slice(lo, hi - lo).take(pa.array(row)),
                         tokens.longs(first), pa.array(many, type=pa.int32())],
                        names=["h1", "h2", "after", "doc_id", "first", "windows"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shared(docs: DataFrame, coder: Coder, window: int, k: int) -> DataFrame:
    """The segments whose k-mer rules another segment too, stored; no other can hold a repeated window."""
    found = segments(docs, coder, window, k)
    # Stored, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    often = stored(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    return stored(found.join(often, "h1"))


def classes(found: DataFrame) -> DataFrame:
    """One row for segments with equal hashes, stored.

    n: their number; doc_id, first: the least of their places; kin: classes under the same k-mer;
    after: the hash of the segment that follows, where the same one follows all of them.
    """
    alike = (found.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first")).alias("source"),
        F.max("windows").alias("windows"), F.min("after").alias("low"), F.max("after").alias("high"))
        .select("h1", "h2", "n", "source.doc_id", "source.first", "windows",
                F.when(F.expr("low = high and low <> 0"), F.col("low")).alias("after")))
    alike = stored(alike)
    return stored(alike.join(alike.groupBy("h1").agg(F.count(F.lit(1)).alias("kin")), "h1"))


def by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): the (first, windows) runs of each document, at most one per window."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, starts, sizes) of every row; rows without spans or without a doc_id have none."""
    listed = stored(by_document(spans))
    return (docs.select(F.col("doc_id").cast("long"), "text").join(listed, "doc_id", "left")
            .select("doc_id", "text", F.col("spans.first").alias("starts"), F.col("spans.windows").alias("sizes")))


def covered(starts, sizes, window: int, length: int) -> np.ndarray:
    """Tokens covered by the windows of the given runs, as booleans."""
    step = np.zeros(length + 1, dtype=np.int64)
    if starts is not None and len(starts):
        begin, many = np.asarray(starts), np.asarray(sizes)
        np.add.at(step, np.minimum(begin, length), 1)
        np.add.at(step, np.minimum(begin + many + window - 1, length), -1)
    return np.cumsum(step[:-1]) > 0
