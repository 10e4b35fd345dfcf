"""Packing documents into training sequences by lexical retrieval.

Documents are tokenized once; windows that a long document fills alone are cut off at once. What is left
of each goes to the shards of an inverted index: pieces are ordered by the terms that tell most about
them, so pieces on one matter stand in one shard, and shards are cut by tokens, so a shard is bounded
whatever its pieces are. In a shard, each seed asks the index by BM25, with the whole corpus's counts,
and the unused neighbours it returns fill the seed's window from the best on; the one that reaches over
the window's end is cut there and seeds the next window. Terms are token ids, so the corpus's counts
are no longer than the vocabulary.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foretally.llm import tokens
from foretally.llm.alignment import byte_letters
from foretally.llm.store import stored

WINDOW = 2048
#: Tokens of one shard of the index, about.
SHARD = 1 << 18
#: Tokens ordered by one task, about.
PART = 1 << 25
#: BM25: how soon repeats stop to count, and how much lengths count.
K1, B = 1.2, 0.75
#: The id after each document.
END = 1
#: Bytes of distinct units and their ids that a worker keeps.
KEPT = 1 << 24


#: Stands between words that are tokenized together; words that hold it are tokenized alone.
_BETWEEN = "\x01"
#: Kinds of bytes: white space, letters, digits, other printable signs of ASCII, all others.
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x27] = _OTHER  # an apostrophe may begin an ending


class WordTokenizer:
    """Ids of texts from ids of their units, each worked out once.

    The tokenizer's pieces never reach over ASCII white space. Inside a word of plain letters, digits and
    signs, a unit is a run of letters, one digit or a run of signs; any other word is a unit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.inner = Tokenizer.from_file(path)
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.begin = {tuple(t.encode()[:2]) for t in self.special}
        self.between = self._whole(_BETWEEN)
        self.vocabulary = self.inner.get_vocab_size(with_added_tokens=True)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size, self.ids, self.ends = 0, array("q"), array("q", [0])

    def _whole(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[str]) -> list[list[int]]:
        """Ids of each word from one call."""
        if len(self.between) != 1:
            return [self._whole(w) for w in words]
        flat = np.array(self._whole(f" {_BETWEEN} ".join(words)), dtype=np.int64)
        return [part[k > 0:].tolist() for k, part in enumerate(np.split(flat, np.flatnonzero(flat == self.between[0])))]

    def _plain(self, unit: bytes) -> list[int]:
        """Ids of a run of lowered letters or of signs: what the tokenizer's model makes of it."""
        text = unit.decode("ascii") if unit.isascii() else "".join(map(self.letters.__getitem__, unit))
        return [t.id for t in self.inner.model.tokenize(text)]

    def _keep(self, unit: bytes, ids: list[int]) -> None:
        self.at[unit] = len(self.ends) - 1
        self.size += len(unit) + 8 * len(ids)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def _learn(self, units: list[bytes]) -> None:
        other = []
        for unit in units:
            if unit[0] != 0x20:
                self._keep(unit, self._plain(unit))
            elif unit[1:].find(_BETWEEN.encode()) >= 0 or any(t in unit[1:].decode() for t in self.special):
                self._keep(unit, self._whole(unit[1:].decode()))
            else:
                other.append(unit)
        if other:
            for unit, ids in zip(other, self._together([u[1:].decode() for u in other])):
                self._keep(unit, ids)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start and stop of each unit, units before each text); letters of plain words are lowered."""
        starts, stops, rows = tokens.word_bounds(data, offsets)
        kind, lower = _KIND[data], tokens.lowered(data)
        after = np.append(data[1:], np.uint8(0))
        # Letters from a with grave to y with diaeresis: a lead byte and one that is neither times nor division.
        lead = np.flatnonzero((data == 0xC3) & (after != 0x97) & (after != 0xB7) & (after >= 0x80))
        kind[lead] = kind[lead + 1] = _LETTER
        capital = lead[after[lead] < 0x9F] + 1
        lower[capital] += 0x20
        for first, second in self.begin:
            kind[(data == first) & (after == second)] = _OTHER
        odd = np.concatenate(([0], np.cumsum(kind == _OTHER)))
        odd = odd[stops] > odd[starts]
        inner = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1 if len(kind) else np.zeros(0, np.int64)
        inner = inner[(kind[inner] != _BLANK) & (kind[inner - 1] != _BLANK)]
        word = np.searchsorted(starts, inner, side="right") - 1
        inner = inner[(inner > starts[word]) & ~odd[word]] if len(starts) else inner[:0]
        whole = starts[odd]
        at = np.repeat(whole - (np.cumsum(stops[odd] - whole) - (stops[odd] - whole)), stops[odd] - whole)
        at = at + np.arange(len(at))
        lower[at] = data[at]
        begin, end = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([stops, inner]))
        # A unit that is a whole odd word is told from a plain one of the same bytes by a blank in front.
        marked = np.zeros(len(begin), dtype=bool)
        marked[np.searchsorted(begin, whole)] = True
        return lower, begin, end, marked, np.searchsorted(begin, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text (UTF-8 bytes between offsets) and ``END``."""
        if self.size > KEPT:
            self.reset()
        lower, begin, end, marked, rows = self.units(data, offsets)
        sizes = end - begin + marked
        ends = np.concatenate(([0], np.cumsum(sizes)))
        solid = np.full(ends[-1], 0x20, dtype=np.uint8)
        taken = np.ones(ends[-1], dtype=bool)
        taken[ends[:-1][marked]] = False
        solid[taken] = lower[_KIND[data] != _BLANK]
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
        coded = named.dictionary_encode()
        # Slices of the buffer's bytes are made faster than Arrow makes its values one by one.
        cut = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64)[:len(coded.dictionary) + 1].tolist()
        raw = (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        names = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
        at = np.fromiter(map(self.at.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn([names[i] for i in new.tolist()])
            at[new] = [self.at[names[i]] for i in new.tolist()]
        at = at[coded.indices.to_numpy()]
        ids, ends = np.frombuffer(self.ids, dtype=np.int64), np.frombuffer(self.ends, dtype=np.int64)
        count = ends[at + 1] - ends[at]
        before = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(ends[at] - before[:-1], count) + np.arange(before[-1])] if before[-1] else ids[:0]
        cuts = before[rows]
        return [np.append(flat[a:b], END) for a, b in zip(cuts[:-1], cuts[1:])]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def narrow(vocabulary: int) -> str:
    """The shortest whole numbers that hold every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CODED = _PIECES + ", ids binary, terms array<int>, holders array<long>, documents long, total long"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}
    named = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, named)],
                                      names=[name for name, _ in named])


def _coded(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Full windows of each document, the rest of it with its ids, and one row of term counts for each task."""
    def run(batches):
        from pyspark import TaskContext
        tokenizer = _tokenizer(path)
        holders, seen = np.zeros(tokenizer.vocabulary, dtype=np.int64), np.full(tokenizer.vocabulary, -1)
        kind = narrow(tokenizer.vocabulary)
        number, documents, total = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, offsets in tokens.chunks(batch.column(1)):
                rows = []
                for doc_id, ids in zip(names[lo:hi], tokenizer.encode(data, offsets)):
                    holders[ids] += seen[ids] != documents
                    seen[ids] = documents
                    documents, total, size = documents + 1, total + len(ids), len(ids)
                    for start in range(0, size - window + 1, window):
                        rows.append((doc_id, start, window, checksum(ids[start:start + window]), size, 2 * number + 1, 0, None))
                        number += 1
                    start = size - size % window
                    if start < size:
                        rows.append((doc_id, start, size - start, None, size, None, None, ids[start:].astype(kind).tobytes()))
                none = [None] * len(rows)
                yield _batch(_CODED, [*zip(*rows), none, none, none, none])
        some = np.flatnonzero(holders)
        if documents:
            yield _batch(_CODED, [*[[None]] * 8, [some.tolist()], [holders[some].tolist()], [documents], [total]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CODED)


class Statistics:
    """What BM25 needs of the corpus: a weight for each term, the average length."""

    def __init__(self, holders: dict, documents: int, total: int):
        self.mean = total / max(1, documents)
        self.rare = np.zeros(max(holders, default=0) + 1)
        for term, n in holders.items():
            self.rare[term] = math.log(1 + (documents - n + 0.5) / (n + 0.5))

    def weights(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.rare[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))


def _terms(pieces: list[np.ndarray], known: Statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, term, weight) of each piece's distinct terms, by piece."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = np.concatenate([np.sort(p, kind="stable") for p in pieces]) if pieces else np.zeros(0, np.int64)
    head = np.append(True, flat[1:] != flat[:-1])[:len(flat)]
    head[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    at = np.flatnonzero(head)
    piece = np.repeat(np.arange(len(pieces)), sizes)[at]
    term, times = flat[at].astype(np.int64), np.diff(np.append(at, len(flat)))
    return piece, term, known.weights(term, times, sizes[piece])


class Index:
    """Inverted lists of one shard: for each term, the pieces that have it and their weights."""

    def __init__(self, piece: np.ndarray, term: np.ndarray, weight: np.ndarray, pieces: int):
        self.pieces, self.ends = pieces, np.searchsorted(piece, np.arange(pieces + 1))
        order = np.argsort(term, kind="stable")
        self.member, self.weight = piece[order], weight[order]
        self.names, begin = np.unique(term[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.term = np.searchsorted(self.names, term)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the terms of ``seed``."""
        asked = self.term[self.ends[seed]:self.ends[seed + 1]]
        begin, count = self.begin[asked], self.begin[asked + 1] - self.begin[asked]
        place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.member[place], weights=self.weight[place], minlength=self.pieces)


def fill(pieces: list[np.ndarray], known: Statistics, window: int) -> tuple[list, list]:
    """(windows, rest): full windows of (piece, start, stop) and what is left for another shard, in order.

    Seeds are the longest unused piece or, where a window's end has cut one, what is left of that.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begun = np.zeros(len(pieces), dtype=np.int64)
    piece, term, weight = _terms(pieces, known)
    live = np.arange(len(pieces))
    index, place = Index(piece, term, weight, len(pieces)), np.arange(len(pieces))
    unused = np.ones(len(pieces), dtype=bool)
    longest, turn, left = np.argsort(-sizes, kind="stable"), 0, int(sizes.sum())
    windows, cut = [], None
    while left >= window:
        if cut is None:
            while not unused[longest[turn]]:
                turn += 1
            seed = int(longest[turn])
        else:
            seed = cut
        unused[seed], room = False, window - int(sizes[seed] - begun[seed])
        parts, cut = [(seed, int(begun[seed]), int(sizes[seed]))], None
        found = index.scores(place[seed])
        free = unused[live]
        ranked = live[free][np.argsort(-found[free], kind="stable")]
        for other in ranked.tolist():
            if not room:
                break
            take = min(room, int(sizes[other]))
            parts.append((other, 0, take))
            room -= take
            unused[other] = False
            if take < sizes[other]:
                begun[other], cut = take, other
        windows.append(parts)
        left -= window
        if 2 * unused.sum() < len(live) > 64:
            # Lists without the used pieces, which nobody asks for any more (but the next seed asks).
            stay = unused.copy()
            if cut is not None:
                stay[cut] = True
            live = np.flatnonzero(stay)
            place = np.cumsum(stay) - 1
            kept = stay[piece]
            index = Index(place[piece[kept]], term[kept], weight[kept], len(live))
    rest = [] if cut is None else [(cut, int(begun[cut]), int(sizes[cut]))]
    return windows, rest + [(int(i), 0, int(sizes[i])) for i in np.flatnonzero(unused)]


def _powers(parts: list, window: int) -> Iterator[list]:
    """What is less than a window, as sequences of whole powers of two."""
    left = sum(stop - start for _, start, stop in parts)
    parts = list(parts)
    while left:
        room = min(window, 1 << (left.bit_length() - 1))
        left, out = left - room, []
        while room:
            i, start, stop = parts.pop(0)
            take = min(room, stop - start)
            out.append((i, start, start + take))
            room -= take
            if start + take < stop:
                parts.insert(0, (i, start + take, stop))
        yield out


def _packed(rests: DataFrame, known: Statistics, kind: str, window: int, shard: int) -> DataFrame:
    """Pieces of the sequences of each task's rows, a shard of the index at a time."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        pool: list = []  # (doc_id, start in the document, ids, tokens of the document)

        def rows(sequences):
            nonlocal number
            out = []
            for parts in sequences:
                offset = 0
                for i, start, stop in parts:
                    doc_id, base, ids, size = pool[i]
                    out.append((doc_id, base + start, stop - start, checksum(ids[start:stop]), size, 2 * number, offset))
                    offset += stop - start
                number += 1
            return out

        def flushed(last: bool):
            nonlocal pool
            windows, rest = fill([ids for _, _, ids, _ in pool], known, window)
            out = rows(windows + (list(_powers(rest, window)) if last else []))
            pool = [] if last else [(pool[i][0], pool[i][1] + a, pool[i][2][a:b], pool[i][3]) for i, a, b in rest]
            return _batch(_PIECES, [*zip(*out)]) if out else None

        held = 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "start", "ids", "doc_tokens")]
            for doc_id, start, ids, size in zip(*columns):
                pool.append((doc_id, start, np.frombuffer(ids, kind), size))
                held += len(pool[-1][2])
                if held >= shard:
                    if (out := flushed(False)) is not None:
                        yield out
                    held = sum(len(ids) for _, _, ids, _ in pool)
        if pool and (out := flushed(True)) is not None:
            yield out

    return rests.mapInArrow(run, _PIECES)


def _ordered(rests: DataFrame, known: Statistics, kind: str, parts: int) -> DataFrame:
    """Rests of documents by their most telling terms, those on one matter in one task and side by side."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            piece, term, weight = _terms(ids, known)
            order = np.lexsort((term, -weight, piece))
            first = np.searchsorted(piece, np.arange(len(ids)))
            second = np.minimum(first + 1, np.searchsorted(piece, np.arange(len(ids)), side="right") - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("doc_id", "start", "ids", "doc_tokens")),
                 pa.array(term[order][first].astype(np.int32)), pa.array(term[order][second].astype(np.int32)),
                 pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())],
                names=["doc_id", "start", "ids", "doc_tokens", "most", "next", "mark"])

    keyed = rests.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(
        run, "doc_id long, start long, ids binary, doc_tokens long, most int, next int, mark long")
    order = ["most", "next", "mark", "spread", "doc_id"]
    # The spread keeps copies, however many, from being one key of the ranges.
    keyed = keyed.withColumn("spread", F.xxhash64("doc_id", "mark", "start"))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "start", "ids", "doc_tokens")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens, lexical neighbours side by side.

    ``docs`` needs doc_id and text; other columns are ignored. A document is the ids of its text by the
    tokenizer at ``path`` and then ``END``; a null text is empty. Every id is in exactly one piece, so a row of
    ``docs``, whether it repeats another, has no doc_id or no text, has one piece at least. Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset of each piece. Sequences are full; less than a window
    remains in each task at the end, which is cut into sequences of powers of two, so nothing is padded. An
    empty table gives an empty result.
    """
    path = path or default_path()
    coded = stored(_coded(docs, path, window))
    counted = coded.filter("terms is not null")
    # No more rows than the vocabulary has entries.
    holders = {r["term"]: r["n"] for r in counted.select(F.explode(F.arrays_zip("terms", "holders")).alias("x"))
               .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.holders").alias("n")).collect()}
    sums = counted.agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).first()
    kind = narrow(_tokenizer(path).vocabulary)
    known = Statistics(holders, sums["documents"] or 0, sums["total"] or 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sums["total"] or 0) // PART))
    rests = _ordered(coded.filter("ids is not null"), known, kind, parts)
    whole = coded.filter("sequence_id is not null").select(*(part.split()[0] for part in _PIECES.split(", ")))
    return whole.unionByName(_packed(rests, known, kind, window, shard))
