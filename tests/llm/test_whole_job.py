"""Cases in which an operator once did less than its whole job."""

import json
import re
import textwrap
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foretally.llm import licenses, linededup, mixing, neardup


def test_mixing_keeps_to_the_weights_asked_for(spark):
    # A hot source and 19 others, a document to a block: rounded weights drift by whole blocks here.
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 19)).alias("source"))
    out = sorted(mixing.mixed_order(df, block=1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in out] == list(range(6000)) and len({r.doc_id for r in out}) == 6000
    assert all(r.release <= r.slot < r.deadline for r in out)
    counts = Counter(r.source for r in out)
    weights = {s: Fraction(n ** 0.5) for s, n in counts.items()}
    total, done = sum(weights.values()), Counter()
    first_end = min(max(r.slot for r in out if r.source == s) for s in counts)
    assert first_end > 4000
    for t, r in enumerate(out[:first_end], 1):
        done[r.source] += 1
        assert all(abs(done[s] - t * w / total) < 1 for s, w in weights.items())
        assert r.release == (done[r.source] - 1) * total // weights[r.source]


def test_mixing_of_weights_of_any_size(spark, monkeypatch):
    names = ["a"] * 90 + ["b"] * 20 + ["never"] * 5 + ["rare"] * 5
    df = spark.createDataFrame([(i, "t", s) for i, s in enumerate(names)], "doc_id long, text string, source string")
    weights = {"a": 2.0, "b": 1, "never": 0, "rare": 1e-300}
    whole = mixing.mixed_order(df, weights, block=1).orderBy("slot").collect()
    assert [r.slot for r in whole] == list(range(120)) and all(r.release <= r.slot < r.deadline for r in whole)
    assert [r.source for r in whole[-5:]] == ["never"] * 5
    monkeypatch.setattr(mixing, "SENT", 0)
    parts = mixing.mixed_order(df, weights, block=1, period=7).orderBy("slot").collect()
    assert parts == whole
    with pytest.raises(ValueError):
        mixing.mixed_order(df, {"a": -1.0})


def test_whole_licences_match_as_they_are_found(spark):
    known = json.loads((Path(licenses.__file__).parent / "license_texts.json").read_text(encoding="utf-8"))
    assert {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
            "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} <= known.keys()
    found = []
    for name, entry in known.items():
        text = entry["texts"][0]
        found += [(name, text), (name, text.upper()), (name, " ".join(text.split()))]
        own = [x for x in text.split("\n") if not re.match(r"\s*Copyright (\(C\)|©) \d{4}", x)]
        for width in (30, 77):  # lines start in the middle of sentences on copyright
            found.append((name, "\n".join(textwrap.wrap(" ".join(own), width, break_long_words=False))))
        for line in ("Copyright The Authors", "Copyright (c) <year> <holder>", "(c) Someone", "© Someone, all rights reserved",
                     "Copyright © Holders & Sons", "  * Copyright (C) 2001, 2003 X"):
            for title in ["", *entry["titles"]]:
                found.append((name, f"{title}\n\n{line}\n{text}"))
    mit = known["MIT"]["texts"][0]
    other = ["C is a language\n" + mit, "Copyrighted by nobody\n" + mit, mit + "\nand more", mit[:-20], "Copyright Me"]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(found)] + [(-i, t) for i, t in enumerate(other, 1)],
                                 "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.license_id) for r in licenses.license_matches(docs).filter("unit = 'text'").collect()}
    want = {(i, name) for i, (name, _) in enumerate(found)}
    assert got == want, ([(found[i][0], repr(found[i][1][:90])) for i, _ in sorted(want - got)], sorted(got - want))


def test_pipeline_without_a_classifier(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, some in (("none", labels.limit(0)), ("one", labels.withColumn("quality", F.lit(1).cast(labels.schema["quality"].dataType)))):
        some.write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = corpus_pipeline.keep_good(spark, docs, str(tmp_path / name))
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_stages_row_by_row(spark, tmp_path):
    # Null and repeated ids among copies, near copies and leaks, against brute force over rows.
    names = [f"w{i}" for i in range(300)]
    copy, near = names[:80], [*names[:40], "changed", *names[41:80]]
    leak = names[100:130]
    rows = [(5, copy), (None, copy), (None, near), (3, near), (3, near), (None, names[200:260]), (None, names[200:260]),
            (8, names[130:180]), (8, [*names[130:180]]), (8, names[180:200]), (None, leak), (9, [*names[260:300], *leak]),
            (None, []), (None, []), (7, ["one"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, " ".join(t), None, "s", len(" ".join(t))) for i, t in rows], schema).repartition(3)
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def shingles(text):
        words = text.split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def alike(a, b):
        x, y = shingles(a), shingles(b)
        return bool(x) and bool(y) and len(x & y) * 100 >= 80 * len(x | y)

    before = sorted(((i, " ".join(t)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for row in before:  # no chains here: each copy is alike to the first of its group
        if not any(alike(row[1], kept[1]) for kept in want):
            want.append(row)
    copies = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert copies.dtypes == docs.dtypes
    assert Counter((r.doc_id, r.text) for r in copies.collect()) == Counter(want)
    clean = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    part = shingles(" ".join(leak))
    assert clean.dtypes == docs.dtypes
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(
        r for r in before if len(part & shingles(r[1])) * 100 < 80 * len(part))


CLASHING = ["_lines", "_host", "_codes", "_source", "_rank", "_part", "_code", "_of", "_row", "_slots", "_before", "_kept", "_leak", "Slot",
            "row", "key", "site", "lines", "codes", "left", "code", "rank", "origin", "part", "size", "before", "of", "run", "slots", "a.b"]


def test_callers_names_meet_none_of_ours(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}\nline", "s" if i % 3 else None) for i in range(12)],
                                 "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    spark.createDataFrame([(1, "zz yy xx ww vv uu")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines = linededup.drop_boilerplate(docs, "source", "text")
    mixed = mixing.mixed_order(docs)
    copies = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    clean = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    for out, n in ((lines, 12), (mixed, 12), (copies, 6), (clean, 12)):
        rows = out.collect()
        assert len(rows) == n and set(docs.columns) <= set(out.columns)
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert sorted(r.doc_id for r in mixed.collect()) == list(range(12))


def test_mixing_splits_rows_without_or_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 50)
    docs = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("source"))
    base = docs.select(F.xxhash64("doc_id", "text", F.lit(3)).alias("code"))
    assert base.groupBy(F.pmod("code", F.lit(20))).count().agg(F.max("count")).first()[0] < 100
    out = mixing.mixed_order(docs).collect()
    assert sorted(r.position for r in out) == list(range(1000))


def cloud(spark, n):
    """Variants of one text, most of them a little below the threshold from each other."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(150, 3, replace=False):
            w[at] = f"x{rng.integers(1_000_000_000)}"
        rows.append((i, " ".join(w)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_clouds_of_near_texts_leave_few_pairs(spark, monkeypatch):
    """Pairs that leave the lists stay in proportion to the links, and no link is lost."""
    made = []
    real = neardup._confirmed

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(neardup, "_confirmed", counted)
    shingles = lambda text: {tuple(text.split()[j:j + 4]) for j in range(147)}
    for n in (150, 300):
        made.clear()
        rows, df = cloud(spark, n)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 4).collect()}
        sets = [shingles(t) for _, t in rows]
        links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
            if before == label:
                break
        assert got == dict(enumerate(label))
        assert sum(made) < 12 * n + 4 * len(links)


def test_bit_fields_bound_the_overlap_from_above():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 400)) for _ in range(2)]
    for _ in range(40):
        base = sets[0]
        other = np.unique(np.concatenate([rng.choice(base, rng.integers(100, 400), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 120))]))
        common = len(np.intersect1d(base, other))
        alike = 100 * common >= 80 * (len(base) + len(other) - common)

        def side(hashes, name, label, size):
            field = np.zeros(size, dtype=bool)
            field[hashes & (size - 1)] = True
            return {"node": np.array([name]), "n": np.array([len(hashes)]), "label": np.array([label]), "side": np.array([0]),
                    "place": np.array([0]), "few": np.array([True]), "bits": [np.packbits(field).tobytes()]}

        a, _ = neardup._survivors(side(base, 1, 1, 2048), side(other, 2, 2, 1024), False, 80)
        assert len(a) or not alike
        if common * 180 < 0.9 * 80 * (len(base) + len(other)):
            assert not len(a)


def test_percent_decides_what_a_sketch_must_keep():
    assert neardup.least_common(80, 64) == pytest.approx(0.5)
    assert neardup.least_common(60, 64) < 0.24 and neardup.least_common(99, 64) > 0.9
