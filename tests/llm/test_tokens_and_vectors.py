"""Alignment, packing and whitening against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foretally.llm import alignment, feast, packing, whitening

SCHEMA = "doc_id long, text string, lang string, block long, key string, terms string, ids string"
ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, " two  blanks\n\n and\ttabs \n"), (6, "▁piece mark"), (7, "日本語のテキスト é ß ﬁ"),
       (8, "copy of a text"), (8, "copy of a text"), (9, "copy of a text"), (None, "copy of a text"), (None, None),
       (10, "<|endoftext|> <s> </s> <0x0A> <unk>"), (11, "no-break\xa0 blank 　 x"), (12, "It's NAÏVE " * 3000),
       (13, "x" * 5000), (-4, "\x00\x01 \x7f"), (14, "\n\n"), (15, "a \n b"), (16, "1234567 ''' ...")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", 1, "k", "t", "i") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_alignment(rows):
    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = alignment.byte_letters()
    names = {i: w for w, i in a.get_vocab().items()}
    linked = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx = [bytes(letters[c] for c in names[i]) for i in x]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not text or b"".join(bx) != whole or b"".join(by) != whole:
            linked.append([])
            continue
        cuts_a, cuts_b = (np.cumsum([len(t) for t in side]) for side in (bx, by))
        cuts = sorted(set(cuts_a) & set(cuts_b))
        at_a, at_b = (np.concatenate(([0], np.searchsorted(side, cuts, side="right"))) for side in (cuts_a, cuts_b))
        groups = [(x[at_a[k]:at_a[k + 1]], y[at_b[k]:at_b[k + 1]]) for k in range(len(cuts))]
        linked.append(groups)
    count = Counter(p for groups in linked for p in {(i, j) for u, v in groups for i in u for j in v})
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for (doc_id, _), groups in zip(rows, linked):
        links = [(i, j) for u, v in groups for i in u for j in v]
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((doc_id, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return Counter(out)


def test_alignment(spark, docs, odd, monkeypatch):
    short = docs.filter("length(text) < 3000 or text is null").limit(60)
    for df, size in ((odd, 1 << 21), (short, 4000)):
        monkeypatch.setattr(alignment, "BLOCK", size)
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = Counter(map(tuple, alignment.aligned(df).collect()))
        assert got == brute_alignment(rows)
    assert alignment.aligned(odd.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in alignment.aligned(odd.filter("doc_id < 3")).collect()].count((0,) * 6 + ("",)) == 2


def test_chunks_give_the_tokens_of_whole_texts():
    rng = random.Random(3)
    aligner = alignment.Aligner(*alignment.default_paths())
    signs = [" ", " ", "\n", "\t", "\r", "\x0b", "a", "the", "\xe9", "日", "1", ".", "'s", "'ll", "<|endoftext|>", "<s>", "\x00",
             "\xa0", "　", "́", "İ", "\xbd", "\x1f", "​"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(1500)]
    for text in texts:
        a = [i for c in aligner.chunks(text) for i in aligner.a.encode(c, add_special_tokens=False).ids]
        b = [i for c in aligner.chunks(text) for i in aligner.b.encode("\n" + c)[len(aligner.before):]]
        assert a == aligner.a.encode(" " + text, add_special_tokens=False).ids and b == aligner.b.encode(text), repr(text)


def test_units_give_the_ids_of_whole_texts(docs):
    rng = random.Random(5)
    signs = [" ", " ", "\n", "\t", "a", "The", "É", "ß", "ÿ", "×", "÷", "À", "日", "1", "23", ".", "'s", "'LL", "'", "<|endoftext|>",
             "<|ENDOFTEXT|>", "<|", "<", "|", "\x00", "\x01", "\xa0", "　", "e\u0301", "\u0301", "İ", "K", "ſ", "\xbd", "\x1f", "x_y", "~", "€"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)] + [r.text or "" for r in docs.limit(100).collect()]
    mine, plain = packing.WordTokenizer(packing.default_path()), Tokenizer.from_file(packing.default_path())
    for at in range(0, len(texts), 50):
        raw = [t.encode() for t in texts[at:at + 50]]
        got = mine.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for text, ids in zip(texts[at:at + 50], got):
            assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], repr(text)


def check_packing(rows, out, window):
    plain = Tokenizer.from_file(packing.default_path())
    ids = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    # Pieces of rows of one doc_id and length are told apart by their checksums.
    want, got = Counter(), Counter()
    by_doc = defaultdict(list)
    for i, x in ids:
        by_doc[i, len(x)].append(x)
    cover = defaultdict(Counter)
    for r in out:
        possible = [x for x in by_doc[r.doc_id, r.doc_tokens]
                    if zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert possible
        for at in range(r.start, r.start + r.length):
            cover[r.doc_id, r.doc_tokens][at] += 1
    for (i, n), same in by_doc.items():
        want[i, n] = len(same)
        assert set(cover[i, n]) == set(range(n)) and set(cover[i, n].values()) == {len(same)}
        got[i, n] = len(same)
    assert got == want and set(cover) == set(by_doc)


def test_packing(spark, docs, odd):
    for df, window, shard in ((odd, 2048, 1 << 18), (odd, 64, 500), (docs.limit(80), 256, 20000)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = packing.packed(df, window=window, shard=shard).collect()
        check_packing(rows, out, window)
    assert packing.packed(odd.limit(0)).count() == 0
    pad = packing.packed(docs.limit(80)).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert pad.filter("n < 2048 and n & (n - 1) != 0 or n > 2048").isEmpty()


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(50)]
    holders = {int(t): int(sum(t in p for p in pieces)) for t in np.unique(np.concatenate(pieces))}
    total = sum(map(len, pieces))
    known = packing.Statistics(holders, 50, total)
    index = packing.Index(*packing._terms(pieces, known), 50)
    for seed in (0, 7, 49):
        want = [sum(np.log(1 + (50 - holders[t] + 0.5) / (holders[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(p) / (total / 50)))
                    for t in set(pieces[seed].tolist()) if (f := int((p == t).sum()))) for p in pieces]
        assert np.allclose(index.scores(seed), want)


def test_windows_take_the_best_unused_neighbours():
    rng = np.random.default_rng(6)
    pieces = [np.concatenate([rng.integers(100 * k, 100 * k + 30, 50), [1]]) for k in rng.permutation(np.repeat(range(8), 12))]
    holders = {int(t): int(sum(t in p for p in pieces)) for t in np.unique(np.concatenate(pieces))}
    known = packing.Statistics(holders, len(pieces), sum(map(len, pieces)))
    topic = [int(p[0]) // 100 for p in pieces]
    windows, rest = packing.fill(pieces, known, 255)
    placed = Counter()
    for parts in windows + [rest]:
        for i, start, stop in parts:
            placed.update((i, t) for t in range(start, stop))
    assert set(placed.values()) == {1} and len(placed) == sum(map(len, pieces))
    assert all(sum(b - a for _, a, b in parts) == 255 for parts in windows) and sum(b - a for _, a, b in rest) < 255
    # A brute-force walk over the same seeds: the best by score, ties by place, among those unused.
    used, index = set(), packing.Index(*packing._terms(pieces, known), len(pieces))
    for parts in windows:
        seed = parts[0][0]
        used.add(seed)
        for i, _, _ in parts[1:]:
            scores = index.scores(seed)
            left = [j for j in range(len(pieces)) if j not in used]
            assert np.isclose(scores[i], max(scores[j] for j in left))
            used.add(i)
    assert np.mean([topic[i] == topic[parts[0][0]] for parts in windows for i, _, _ in parts]) > 0.8


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n long, v string")


def test_whitening(spark, sf):
    own = spark.read.parquet(f"{sf}/embeddings.parquet")
    kept = [(r.vec_id, r.embedding) for r in own.collect()]
    d = len(kept[0][1])
    bad = [(None, [0.25] * d), (7000, [0.5] * d), (7000, [0.5] * d), (900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)),
           (903, [float("inf")] * d), (904, []), (905, [1.0, 2.0])]
    rows = [(i, v, 0, "x", 1, "v") for i, v in kept + bad + kept[:40]]
    good = kept + bad[:3] + kept[:40]
    x = np.floor(256.0 * np.array([v for _, v in good], dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) == 4 * len(good)
    deviation = [sum(int(e) ** 2 for e in n * row - s) for row in x]
    want = Counter((i, int(dev)) for (i, _), dev in zip(good, deviation))
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == want
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    told = np.array([values[r.component - 1] / np.trace(cov) for r in got])
    assert np.allclose([r.explained for r in got], told, rtol=1e-9)
    place = {i: (x[j] - s / n) @ axes / np.sqrt(values) for j, (i, _) in enumerate(good) if i is not None}
    for c in range(4):
        ours = np.array([r.whitened for r in got if r.vec_id is not None and r.component == c + 1])
        theirs = np.array([place[r.vec_id][c] for r in got if r.vec_id is not None and r.component == c + 1])
        assert np.allclose(ours, theirs, atol=1e-8) or np.allclose(ours, -theirs, atol=1e-8)


def test_whitening_of_few_and_huge_vectors(spark):
    make = lambda vs: whitening.whitened(vectors(spark, [(i, v, 0, "x", 1, "v") for i, v in enumerate(vs)]))
    assert make([]).count() == 0 and make([None, []]).count() == 0
    assert make([[1.0, 2.0]] * 5).count() == 0
    two = make([[1.0, 2.0], [3.0, 2.0], [3.0, 2.0]]).collect()
    assert [(r.component, r.n, int(r.deviation), round(abs(r.whitened), 9)) for r in two] == [(1, 2, 512 ** 2, 1.0)] * 3
    huge = make([[3e38, 0.0], [-3e38, 1.0], [0.0, 5e9]]).collect()
    assert len(huge) == 3 and all(np.isfinite(r.whitened) and r.identity_error < 1e-9 for r in huge)


def test_contour_integration():
    rng = np.random.default_rng(0)
    for trial in range(60):
        d = int(rng.integers(1, 40))
        some = [rng.random(d), np.concatenate([[1e6] * min(3, d), rng.random(d - min(3, d))]), 10.0 ** rng.integers(-12, 6, d),
                np.concatenate([rng.random(min(2, d)), np.zeros(d - min(2, d))]), np.ones(d)][trial % 5]
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (q * some) @ q.T
        v = (v + v.T) / 2
        values, vectors_ = feast.leading(v, 4)
        want = np.sort(some)[::-1][:len(values)]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-12 * want.max())
        assert np.linalg.norm(v @ vectors_ - vectors_ * values) <= 1e-12 * want.max()
        assert np.allclose(vectors_.T @ vectors_, np.eye(len(values)), atol=1e-9)
        # Inertia: as many eigenvalues above a shift as there are.
        tri, shift = feast.tridiagonal(v), float(some.mean()) * 1.01
        assert feast.above(tri, shift) == (np.linalg.eigvalsh(v) > shift).sum()
