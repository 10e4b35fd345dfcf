"""Repeated byte strings of a least length, from Burrows-Wheeler transforms of bounded buckets.

Every window of ``length`` bytes is ruled by a minimizer, so equal windows meet under one k-mer. Spark
counts the segments of windows with equal hashes: windows of a segment that stands twice all repeat.
Segments that stand once, but share their k-mer with different ones, may repeat in part. These are
dealt to buckets by k-mer, and each bucket's strings are searched by threshold-bounded interval
expansion (``bwt.long_repeats``). A k-mer with more different segments than a bucket may hold is spread
over the cluster window by window instead, so no bucket grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import segments as seg, tokens
from foretally.llm.bwt import long_repeats
from foretally.llm.store import stored

LENGTH = 200
KMER = 40
#: Different segments of one k-mer that a bucket takes, and segments of a bucket on average.
GROUP = 4096
BUCKET = 768
#: Steps of the window's place around its k-mer at which strings without a partner are left out.
STEPS = 8


def _strings(docs: DataFrame, alike: DataFrame, length: int) -> DataFrame:
    """(h1, kin, n, doc_id, first, part): the bytes of one segment of each class with kin, stored."""
    places = alike.filter("kin > 1").groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "windows", "h1", "kin", "n")).alias("at"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    joined = texts.join(places, "doc_id").select("doc_id", "text", "at")

    def run(batches):
        for batch in batches:
            rows = [[], [], [], [], [], []]
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode()
                for x in at:
                    part = data[x["first"]:x["first"] + x["windows"] + length - 1]
                    for column, value in zip(rows, (x["h1"], x["kin"], x["n"], doc, x["first"], part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in rows[:5]), pa.array(rows[5], pa.binary())],
                names=["h1", "kin", "n", "doc_id", "first", "part"])

    return stored(joined.mapInArrow(run, "h1 long, kin long, n long, doc_id long, first long, part binary"))


def _partnered(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, length: int, kmer: int) -> np.ndarray:
    """Strings that agree with another one almost as far as a window reaches around the common k-mer."""
    rolling = tokens.Rolling(tokens.byte_codes(data))
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)[:max(len(data) - kmer + 1, 0)]
    hits = np.flatnonzero(rolling.every(kmer).view(np.int64) == h1[owner])
    place = np.full(len(size), len(data))
    np.minimum.at(place, owner[hits], hits)
    before, after = place - ends[:-1], ends[1:] - place
    out = np.zeros(len(size), dtype=bool)
    edges = np.linspace(0, length - kmer + 1, STEPS + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:] - 1):
        some = np.flatnonzero((before >= low) & (after >= length - high))
        key = rolling.run(place[some] - low, place[some] + length - high)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[some[count[which] > 1]] = True
    return out


def _bucket_spans(strings: DataFrame, buckets: int, length: int, kmer: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        h1, n, doc, first = (table.column(c).to_numpy() for c in ("h1", "n", "doc_id", "first"))
        parts = table.column("part").to_pylist()
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        keep = _partnered(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, h1, length, kmer)
        chosen = np.flatnonzero(keep)
        codes = np.concatenate([np.zeros(1, dtype=np.int16)] + [
            np.append(np.frombuffer(parts[i], dtype=np.uint8).astype(np.int16) + 1, np.int16(0)) for i in chosen])
        hit = long_repeats(codes, length)
        size = np.array([len(parts[i]) for i in chosen], dtype=np.int64)
        begin = np.cumsum(size + 1) - size  # the first code of each string
        windows = np.maximum(size - length + 1, 0) * (n[chosen] == 1)
        total = np.cumsum(windows)
        offset = np.arange(total[-1] if len(total) else 0) - np.repeat(total - windows, windows)
        which = np.repeat(np.arange(len(chosen)), windows)
        found = hit[begin[which] + offset]
        which, offset = chosen[which[found]], offset[found]
        turn = np.ones(len(which), dtype=bool)
        turn[1:] = (np.diff(which) != 0) | (np.diff(offset) != 1)
        heads = np.flatnonzero(turn)
        return pa.table({"doc_id": tokens.longs(doc[which[heads]]),
                         "first": tokens.longs(first[which[heads]] + offset[heads]),
                         "windows": tokens.longs(np.diff(np.append(heads, len(which))))})

    dealt = strings.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "doc_id long, first long, windows long")


def _window_spans(strings: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = batch.column(4).to_pylist()
            size = np.array([len(p) for p in parts], dtype=np.int64)
            many = np.maximum(size - length + 1, 0)
            rolling = tokens.Rolling(tokens.byte_codes(np.frombuffer(b"".join(parts), dtype=np.uint8)))
            ends = np.cumsum(many)
            owner = np.repeat(np.arange(len(parts)), many)
            offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
            begin = (np.cumsum(size) - size)[owner] + offset
            h1, n, doc, first = (batch.column(i).to_numpy() for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [tokens.longs(h1[owner]), tokens.longs(rolling.run(begin, begin + length)), tokens.longs(n[owner]),
                 tokens.longs(doc[owner]), tokens.longs(first[owner] + offset)],
                names=["h1", "hash", "n", "doc_id", "first"])

    each = strings.select("h1", "n", "doc_id", "first", "part").mapInArrow(
        run, "h1 long, hash long, n long, doc_id long, first long")
    often = stored(each.groupBy("h1", "hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h1", "hash"))
    return each.filter("n = 1").join(often, ["h1", "hash"]).select(
        "doc_id", "first", F.lit(1).cast("long").alias("windows"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """(doc_id, first, windows): runs of starts of ``length``-byte strings that also start elsewhere."""
    found = seg.shared(docs, seg.byte_coder, length, kmer)
    alike = seg.classes(found)
    whole = found.join(alike.filter("n > 1").select("h1", "h2"), ["h1", "h2"]).select(
        "doc_id", "first", F.col("windows").cast("long").alias("windows"))
    strings = _strings(docs, alike, length)
    buckets = max(1, strings.count() // BUCKET)
    return (whole.unionByName(_bucket_spans(strings.filter(F.col("kin") <= GROUP), buckets, length, kmer))
            .unionByName(_window_spans(strings.filter(F.col("kin") > GROUP), length)))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_bytes, n_removed,
    n_spans (longest runs removed) and kept (the bytes left, which may cut a character). Strings lie in
    one document, may overlap and are judged on the texts as they came; all their places are removed. A
    null or empty text has no bytes; texts shorter than ``length`` lose nothing. Rows without doc_id have
    no place: they lose nothing and nothing is removed for their sake. Rows that repeat a doc_id lose the
    same bytes, and equal rows count as two places. An empty table gives an empty result.
    """
    marked = seg.with_spans(docs, repeated_spans(docs, length, kmer))

    def run(batches):
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            rows = zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for text, starts, sizes in rows:
                data = (text.as_py() or "").encode()
                total.append(len(data))
                runs, lost = 0, seg.covered(starts, sizes, length, len(data)) if starts else None
                if lost is not None:
                    runs = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
                    data = np.frombuffer(data, dtype=np.uint8)[~lost].tobytes()
                gone.append(total[-1] - len(data))
                spans.append(runs)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
