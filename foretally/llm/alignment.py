"""Token alignment of two tokenizers over equal texts.

Copies are brought together by their full text, so each distinct text is tokenized and aligned once and
counts for as many documents as hold it. Inside a text, both tokenizers begin a token wherever a blank or
a line end follows anything else, so texts fall into chunks that are worked out once for each worker, not
once for each place. A block of texts lists its id pairs once; corpus-wide counts are joined to these
lists, not to every occurrence, and the texts' measures go back to the documents by the text's digest.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foretally.llm.store import stored

#: Characters of text in one block; a longer text is a block of its own.
BLOCK = 1 << 21
#: Characters of distinct chunks, and their id pairs, that a worker keeps worked out.
KEPT = 1 << 24
KEPT_PAIRS = 1 << 22
#: Characters of chunks tokenized together.
ROW = 1 << 14

#: A chunk: a blank or line end, more white space, then all up to the next blank or line end after something else.
_CHUNK = re.compile(r"[ \n][\t-\r ]*(?:[^\t-\r ]+(?:[\t\x0b-\r][\t-\r ]*)?)*")
#: White space beyond ASCII, of which runs may not be cut: such texts are one chunk.
_ENDS = " \t\n\x0b\x0c\r"
_RARE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin .. begin + count - 1 of each entry, one entry after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Aligner:
    """Aligned chunks; ``add`` works out the ones not met before, arrays hold the measures of all of them."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        names = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
                        for w in (names.get(i, "") for i in range(max(names) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        # Pieces with a blank after something else, or with a line end, would run over the ends of chunks.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.before = self.b.encode("\n")
        self.sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b)]
        # Each id as it is written inside its group and at the end of its side of it.
        self.written = [np.array([f"{i}{sign}" for sign in signs for i in range(len(side))], dtype=object)
                        for side, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.size, self.texts = 0, []
        self.sums = array("q")
        self.pair_at: dict[int, int] = {}
        self.pair_ends, self.pair_index, self.pair_times = array("q", [0]), array("q"), array("q")

    def chunks(self, text: str) -> list[str]:
        """Pieces of a blank and the text that both tokenizers take one by one."""
        whole = " " + text
        return [whole] if not self.cuts or _RARE.search(text) else _CHUNK.findall(whole)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for one or several chunks in a row; None where a side does not give the text's bytes."""
        a = self.a.encode(text, add_special_tokens=False).ids
        # A line end in front keeps the tokenizer from adding its own blank; its tokens are taken off again.
        b = self.b.encode("\n" + text)[len(self.before):]
        whole = text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else None

    def add(self, chunks: list[str]) -> None:
        """Chunks that may stand in a row are tokenized together, some thousand characters at a time."""
        row, size = [], 0
        for chunk in chunks:
            if chunk[-1] in _ENDS or "▁" in chunk or _RARE.search(chunk):
                self._learn([chunk])
                continue
            row.append(chunk)
            size += len(chunk)
            if size > ROW:
                self._learn(row)
                row, size = [], 0
        if row:
            self._learn(row)

    def _learn(self, chunks: list[str]) -> None:
        ids = self.encode("".join(chunks))
        if ids is None and len(chunks) > 1:
            for chunk in chunks:
                self._learn([chunk])
            return
        for chunk in chunks:
            self.at[chunk] = len(self.at)
            self.size += len(chunk)
        if ids is None:
            self.texts.append("")
            self.sums.extend((0, 0, 0, 0, 0))
            self.pair_ends.append(len(self.pair_index))
            return
        n = len(chunks)
        sides = [np.array(side, dtype=np.int64) for side in ids]
        ends = [np.cumsum(sizes[side]) for sizes, side in zip(self.sizes, sides)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        bounds = np.cumsum([len(c.encode()) for c in chunks])
        group = [np.searchsorted(cuts, e) for e in ends]
        counts = [np.bincount(g, minlength=len(cuts)) for g in group]
        owner = np.searchsorted(bounds, cuts)
        # What is written: each side's ids of a group, A before B, each group after the other.
        written = []
        for texts, side, g in zip(self.written, sides, group):
            last = np.append(g[1:] != g[:-1], True)
            written.append(texts[side + last * (len(texts) // 2)])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        written = np.concatenate(written)[order].tolist()
        tokens = counts[0] + counts[1]
        upto = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=tokens, minlength=n)))).astype(np.int64).tolist()
        self.texts += ["".join(written[a:b]) for a, b in zip(upto[:-1], upto[1:])]
        links = counts[0] * counts[1]
        told = [np.bincount(owner, weights=w, minlength=n).astype(np.int64) for w in (counts[0], counts[1], np.ones(len(cuts)), links)]
        self.sums.extend(np.stack([np.ones(n, dtype=np.int64), *told], axis=1).reshape(-1).tolist())
        # Ids that repeat in a group stand once with their number, so a long group costs its different ids.
        once = []
        for side, g in zip(sides, group):
            pair, times = np.unique(g << 32 | side, return_counts=True)
            once.append((pair >> 32, pair & 0xFFFFFFFF, times))
        (ga, a, ta), (gb, b, tb) = once
        first = np.searchsorted(gb, ga)
        many = np.searchsorted(gb, ga, side="right") - first
        mate = _spread(first, many)
        code = np.repeat(a, many) << 32 | b[mate]
        times = np.repeat(ta, many) * tb[mate]
        chunk = np.repeat(owner[ga], many)
        order = np.lexsort((code, chunk))
        code, times, chunk = code[order], times[order], chunk[order]
        head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))
        known = self.pair_at
        self.pair_index.extend([known.setdefault(p, len(known)) for p in code[head].tolist()])
        self.pair_times.extend(np.add.reduceat(times, head).tolist())
        base = self.pair_ends[-1]
        self.pair_ends.extend((base + np.searchsorted(chunk[head], np.arange(n), side="right")).tolist())

    def block(self, texts: list[str]) -> dict:
        """Measures of each text, its id pairs as places in the block's list of pairs, and that list."""
        if self.size > KEPT or len(self.pair_index) > KEPT_PAIRS:
            self.reset()
        cut = [self.chunks(t) for t in texts]
        self.add(list(set().union(*cut).difference(self.at)))
        index = [np.fromiter(map(self.at.__getitem__, c), dtype=np.int64, count=len(c)) for c in cut]
        sums = np.frombuffer(self.sums, dtype=np.int64).reshape(-1, 5)
        fits = np.array([bool(sums[i, 0].all()) for i in index])
        told = np.array([sums[i, 1:].sum(axis=0) for i in index]).reshape(-1, 4) * fits[:, None]
        digests = [hashlib.sha256("".join(map(self.texts.__getitem__, i.tolist()))[:-1].encode()).hexdigest() if ok else ""
                   for i, ok in zip(index, fits)]
        index = [i if ok else i[:0] for i, ok in zip(index, fits)]
        row = np.repeat(np.arange(len(texts)), [len(i) for i in index])
        used, times = np.unique(row * len(self.texts) + np.concatenate([*index, np.zeros(0, np.int64)]).astype(np.int64),
                                return_counts=True)
        row, chunk = used // max(1, len(self.texts)), used % max(1, len(self.texts))
        ends = np.frombuffer(self.pair_ends, dtype=np.int64)
        count = ends[chunk + 1] - ends[chunk]
        place = _spread(ends[chunk], count)
        pair = np.frombuffer(self.pair_index, dtype=np.int64)[place] if len(place) else place
        many = np.frombuffer(self.pair_times, dtype=np.int64)[place] * np.repeat(times, count) if len(place) else place
        # Pairs by text, added up where several chunks have one.
        key = np.repeat(row, count) * max(1, len(self.pair_at)) + pair
        order = np.argsort(key, kind="stable")
        key, many = key[order], many[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        occurrences = np.add.reduceat(many, head) if len(key) else many
        links = key[head]
        listed, at = np.unique(links % max(1, len(self.pair_at)), return_inverse=True)
        codes = np.fromiter(self.pair_at, dtype=np.int64, count=len(self.pair_at))
        return {"told": told, "digests": digests, "owner": links // max(1, len(self.pair_at)), "at": at, "times": occurrences,
                "pairs": codes[listed] if len(listed) else np.zeros(0, np.int64)}


@functools.lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_BLOCKS = ("block long, keys array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "digests array<string>, ends array<long>, at array<int>, times array<long>, pairs array<long>, held array<long>")


def _aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of texts (text, copies): measures by text, the block's id pairs and how many documents hold each."""
    def of(number: int, texts: list[str], copies: list[int]) -> pa.RecordBatch:
        got = _aligner(path_a, path_b).block(texts)
        keys = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        held = np.zeros(len(got["pairs"]), dtype=np.int64)
        np.add.at(held, got["at"], np.array(copies, dtype=np.int64)[got["owner"]])
        ends = np.searchsorted(got["owner"], np.arange(len(texts)), side="right")
        columns = [keys, *got["told"].T.tolist(), got["digests"], ends.tolist(), got["at"].astype(np.int32), got["times"], got["pairs"], held]
        types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t))
                                               for c, t in zip(columns, types))],
            names=[part.split()[0] for part in _BLOCKS.split(", ")])

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held, copies, size = [], [], 0
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(text) > BLOCK:
                    yield of(number, held, copies)
                    number, held, copies, size = number + 1, [], [], 0
                held.append(text)
                copies.append(n)
                size += len(text)
        if held:
            yield of(number, held, copies)

    return texts.select("text", "copies").mapInArrow(run, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each id pair linked, and whether its A id has no pair in more."""
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count")))
    # An A id has at most as many pairs as there are B ids.
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == most)


def _measured(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    listed = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    # A block's list is as long as its texts have different pairs, whatever the corpus holds.
    found = (listed.join(counts, "pair").groupBy("block")
             .agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("found")))
    both = blocks.drop("pairs", "held").join(found.select("block", "found.count", "found.best"), "block", "left")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                get = lambda name, one=one: one.column(name).flatten()
                at, times, ends = (get(c).to_numpy() for c in ("at", "times", "ends"))
                count = get("count").to_numpy()
                best = get("best").to_numpy(zero_copy_only=False).astype(np.int64)
                sums = []
                for value in (best, count):
                    run_up = np.concatenate(([0], np.cumsum(value[at] * times if len(at) else times)))
                    sums.append(pa.array(np.diff(run_up[np.concatenate(([0], ends))]), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [get("keys"), *(get(c) for c in ("n_a", "n_b", "n_groups", "n_links")), *sums, get("digests")],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(run, "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """How the tokens of two tokenizers align over each document's text, and how common its id pairs are.

    ``docs`` needs doc_id and text; other columns are ignored. A (``path_a``, byte-level) encodes a blank and
    the text, B (``path_b``, sentence pieces) the text, to which it adds the blank; strings of special tokens
    are plain text. Byte offsets where both end a token cut the tokens into groups; every A token of a group is
    linked with every B token of it. Returns a row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair of ids is in as many documents as any pair of its A id), count_sum (documents that hold
    each link's pair, summed) and groups_sha256 (digest of ``a1,a2|b1;...``). Null and empty texts, and texts
    that a tokenizer does not give back byte for byte, have zeros and an empty digest and count for no pair.
    Rows without doc_id and rows that repeat one count as documents. An empty table gives an empty result.
    """
    if path_a is None or path_b is None:
        path_a, path_b = (given or usual for given, usual in zip((path_a, path_b), default_paths()))
    texts = docs.filter("text is not null and text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = stored(_aligned(texts, path_a, path_b))
    counts = stored(pair_counts(blocks))
    measures = _measured(blocks, counts)
    named = docs.select(F.col("doc_id").cast("long"), F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return named.join(measures, "key", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
