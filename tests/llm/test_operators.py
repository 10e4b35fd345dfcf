"""The training-data operators against brute force, and on nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.llm import (bwt, components, decontaminate, fingerprint, langid, licenses, linededup, mixing, neardup, quality, queries,
                           substrings, suffixes)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label string, hashes string"
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:60])


def rows():
    """Odd rows: null id, null and empty texts, blanks, a long text, copies, a repeated row, near copies."""
    rng = np.random.default_rng(0)
    own = lambda n: " ".join(rng.choice(WORDS, n))
    base = own(80).split()
    near = [*base[:40], "changed", *base[41:]]
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, own(6000)), (6, " ".join(base)), (7, " ".join(near)),
             (8, " ".join(base)), (8, " ".join(base)), (9, PASSAGE + "\n" + own(50)), (10, own(30) + "\n" + PASSAGE),
             (11, "same line " * 60), (None, PASSAGE), (-3, " ".join(base).upper()), (12, "é ß " * 90)]
    return [(i, t, "xx" if i else None, None if i == 4 else "s", 0, 7, "x", "y") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(pairs, width, percent):
    sets = {}
    for i, t in pairs:
        w = words(low(t))
        sets[i] = frozenset(tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates(docs, odd, empty):
    for df, width in ((docs, 4), (odd, 4), (odd, 5)):
        got = neardup.near_duplicates(df, width).collect()
        want = brute_components([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None], width, 80)
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicate_cloud(spark):
    """Variants of one text, linked and not: the lists of full sets settle what sketches leave open."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            w[at] = f"x{rng.integers(1_000_000)}"
        texts.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
    want = brute_components(texts, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert 1 < len({w[1] for w in want.values()}) < 120


def brute_spans(pairs, size):
    seen, out = set(), {}
    for i, text in sorted(pairs):
        w = words(text)
        lost = [False] * len(w)
        for at in range(len(w) - size + 1):
            key = tuple(w[at:at + size])
            if key in seen:
                lost[at:at + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(lost), b" ".join(x for x, gone in zip(w, lost) if not gone).decode())
    return out


def test_components_extended(spark):
    """Further links join known components and new nodes as walking all links does."""
    make = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first, more = [(5, 9), (9, 7), (2, 3), (20, 21)], [(7, 3), (30, 31), (31, 20), (9, 5), (40, 1), (50, 50)]
    got = components.extended(components.connected(make(first)), make(more))
    want = components.connected(make(first + more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    none = components.extended(components.connected(make(first)), make([]))
    assert sorted(map(tuple, none.collect())) == [(2, 2), (3, 2), (5, 5), (7, 5), (9, 5), (20, 20), (21, 20)]


def test_repeated_spans(docs, odd, empty):
    for df in (docs, odd):
        pairs = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}.items()
        want = brute_spans(pairs, 20)
        for r in substrings.dedup_spans(df).collect():
            if r.doc_id is None:
                assert r.n_removed == 0 and r.kept_text == PASSAGE
            else:
                assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
    assert substrings.dedup_spans(empty).count() == 0


def brute_bytes(pairs, size):
    data = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[p:p + size] for _, b in data for p in range(len(b) - size + 1))
    out = {}
    for i, b in data:
        lost = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                lost[p:p + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(lost)))
        out[i] = (len(b), sum(lost), runs, bytes(x for x, gone in zip(b, lost) if not gone))
    return out


@pytest.mark.parametrize("group", [1024, 3])
def test_repeated_bytes(spark, docs, odd, empty, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    some = docs.filter("doc_id < 60")
    for df in (some, odd) if group == 3 else (docs, odd):
        pairs = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
        want = brute_bytes(pairs, 200)
        for r in suffixes.dedup_bytes(df).collect():
            if r.doc_id is None:
                assert r.n_removed == 0
            else:
                assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffixes.dedup_bytes(empty).count() == 0


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for trial in range(120):
        codes = rng.integers(0, 4, rng.integers(1, 90)).astype(np.int16)
        codes, depth = (np.resize(codes[:6], len(codes)) if trial % 3 == 0 else codes), int(rng.integers(1, 9))
        codes[-1] = 0
        runs = [tuple(codes[i:i + depth]) for i in range(len(codes))]
        whole = [len(r) == depth and 0 not in r for r in runs]
        seen = Counter(r for r, ok in zip(runs, whole) if ok)
        got = bwt.long_repeats(codes, depth)
        assert [bool(g) and ok for g, ok in zip(got, whole)] == [ok and seen[r] > 1 for r, ok in zip(runs, whole)]


def pieces(text):
    return {p for line in text.split("\n") for p in re.findall(f".{{1,{fingerprint.PIECE}}}", line, re.S)}


def test_fingerprints(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 30)
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_versions(docs).collect()}
    alike = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1
    for at, (i, text) in enumerate(order):
        after, half = order[(at + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert math.isclose(r.near_edited, alike(pieces(text), pieces(edited)), abs_tol=1e-9)
        assert math.isclose(r.near_next, alike(pieces(text), pieces(after)), abs_tol=1e-9)
    out = fingerprint.edited_versions(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.near_edited <= 1 for r in out)
    assert len({r.fingerprint for r in out if r.doc_id in (6, 8)}) == 1
    assert fingerprint.edited_versions(empty).count() == 0
    one = fingerprint.edited_versions(odd.filter("doc_id = 4")).first()
    assert (one.edited, one.near_next) == ("ono", 1.0)


def test_licenses(spark, empty):
    texts = [(1, "© 2020 Some One\nReleased  under the MIT LICENCE!"), (2, "x\nreleased under the mit license\nx"),
             (3, None), (4, ""), (5, "Copyright (c) 1999 Me"), (6, dict(licenses.KNOWN)["ISC"].replace(" ", "\n  ")),
             (2, "Released under the MIT License."), (7, "Released under the MIT License, almost")]
    got = {(r.doc_id, r.license_id, r.unit, r.n) for r in licenses.license_matches(
        spark.createDataFrame(texts, "doc_id long, text string").withColumn("unit", F.lit(1))).collect()}
    assert got == {(1, "MIT", "line", 1), (1, "MIT", "text", 1), (2, "MIT", "line", 2), (2, "MIT", "text", 1),
                   (6, "ISC", "text", 1)}
    assert licenses.license_matches(empty).count() == 0


def test_language(spark, sf, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(big)
    told = langid.identify(big, model).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.learn(empty) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(big, labels)
    scored = quality.scored(big, model).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.quality_score >= quality.GOOD) == r.quality for r in held) / len(held) > 0.97
    out = quality.scored(odd, model)
    assert out.columns == [*odd.columns, "quality_score"]
    assert {r.quality_score for r in out.filter("doc_id in (1, 2, 3)").collect()} == {0.0}
    assert quality.learn(empty, labels) is None
    assert quality.scored(empty, None).count() == 0


def test_contained_items(spark, sf, odd, empty, docs):
    items = spark.createDataFrame(
        [(1, PASSAGE.upper()), (2, "one"), (3, None), (4, " "), (5, "not there at all, never seen"),
         (6, " ".join([*WORDS[:56], "other"])), (None, PASSAGE)], "item_id long, text string")
    want = {(9, 1), (10, 1), (9, 6), (10, 6), (4, 2)}
    for sent in (1 << 20, 0):  # probed on every executor, and joined by shuffles
        got = decontaminate.contained_items(odd, items, sent=sent).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert {r.containment for r in got if r.item_id == 1} == {1.0}
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(odd, empty.withColumnRenamed("doc_id", "item_id")).count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    both = [{tuple(r) for r in decontaminate.contained_items(docs, bench, sent=s).collect()} for s in (1 << 20, 0)]
    assert both[0] == both[1] and both[0]


def test_boilerplate(spark, empty):
    pages = [(i, "a.b", f"menu\nown {i}\n\n menu ") for i in range(12)] + [
        (20, "a.b", "menu"), (21, None, "menu\nx"), (22, "a.b", None), (23, "c.d", "menu"), (23, "c.d", "menu")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string").withColumn("n_lines", F.lit("z"))
    got = {r.page_id: r for r in linededup.drop_boilerplate(df, "host", "text").collect()}
    assert (got[3].text, got[3].n_lines, got[3].n_removed) == ("own 3\n", 3, 2)
    assert (got[20].text, got[21].text, got[22].text, got[23].text) == ("", "menu\nx", "", "menu")
    spared = {r.page_id: r.text for r in linededup.drop_boilerplate(df, "host", "text", spare=True).collect()}
    assert spared[20] == "menu" and spared[3] == "own 3\n"
    assert linededup.drop_boilerplate(empty, "source", "text").count() == 0
    urls = spark.createDataFrame([("HTTPS://me@A.b:80/x?y",), ("no",), (None,)], "u string")
    assert [r[0] for r in urls.select(linededup.page_host(F.col("u"))).collect()] == ["a.b", None, None]


def test_mixing(spark, odd, empty):
    names = ["a"] * 700 + ["b"] * 150 + [None] * 40 + ["c"] * 3
    df = spark.createDataFrame([(i, "t", s) for i, s in enumerate(names)], "doc_id long, text string, source string")
    weights = {"a": 5.0, "b": 3.0, None: 1.5, "c": 0.5}
    out = mixing.mixed_order(df, weights, block=4, period=100).collect()
    assert len(out) == len(names) and len({r.position for r in out}) == len(names)
    assert all(r.release <= r.slot < r.deadline for r in out)
    slots = sorted({(r.slot, r.source) for r in out}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots)))  # every slot has one block
    share = mixing.rounded(weights, 100)
    done, last = Counter(), 3  # until the first source runs out
    first_end = min(max(s for s, x in slots if x == src) for src in weights)
    for t, (_, src) in enumerate(slots[:first_end], 1):
        done[src] += 1
        assert all(abs(done[s] - t * share[s] / 100) < 1 for s in weights)
    got = mixing.mixed_order(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert mixing.mixed_order(empty).count() == 0
    with pytest.raises(ValueError):
        old, mixing.SOURCES = mixing.SOURCES, 2
        try:
            mixing.mixed_order(df)
        finally:
            mixing.SOURCES = old


def test_numbering_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 10)
    df = spark.range(400).select(F.xxhash64("id").alias("code"), F.lit("a").alias("source"))
    assert sorted(r["rank"] for r in mixing._numbered(df, "source").collect()) == list(range(400))


def test_queries_with_sql(spark, sf):
    import duckdb

    from foretally.testing import compare
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        assert compare(got.columns, [tuple(r) for r in got.collect()], [d[0] for d in cur.description], cur.fetchall()) == ""


def test_pipeline(spark, sf):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(cp.STAGES) == 5
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.stored(stage(spark, docs, sf))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "quality":
            left = {r.doc_id for r in docs.collect()}
            assert sum(labels[i] for i in left if i in labels) >= 0.95 * sum(labels.values())
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and len(out) == docs.count()
    texts = [(r.doc_id, r.text) for r in out]
    assert all(kept for _, _, kept in brute_components(texts, 5, 80).values())
    digest = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in out}
    assert len(set(digest.values())) == len(digest)
