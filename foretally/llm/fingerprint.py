"""Invertible Bloom fingerprints of whole texts, in DataFrame expressions only.

A text's paragraphs (lines, long ones cut every ``PIECE`` characters) are digested to 48 bits and a
16-bit check. Each digest is added (xor) to one cell in each of three thirds of a fixed table: that
table is the fingerprint. Two versions' tables subtract (xor) cell by cell, which cancels what they
share; peeling then recovers the digests that differ: a cell whose check fits holds a single one, and
taking it out of its other cells lays further ones bare. Where peeling fails, the digests are dealt to
as many tables as their number asks for, then to four times as many, and in the last resort compared
one by one, so the result is always whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foretally.llm.store import stored

PIECE = 192
THIRD = 16
CELLS = 3 * THIRD
ROUNDS = 12
#: Digests dealt to one table on a retry, on average.
LOAD = 20
#: Documents that are ordered together, on average.
ROWS = 4000

_DIGEST = "281474976710655L"
_WHERE = (f"transform(sequence(0, {CELLS - 1}), i -> named_struct('third', i div {THIRD}, 'at', i % {THIRD}))")


def _hits(digest: str, cell: str) -> str:
    """Whether a digest belongs in a cell: each third reads its own bits."""
    low = THIRD - 1
    return (f"(case {cell}.third when 0 then {digest} & {low} when 1 then shiftright({digest}, 16) & {low} "
            f"else shiftright({digest}, 32) & {low} end) = {cell}.at")


def _summed(digests: str, start: str = "0L") -> str:
    return f"aggregate({digests}, {start}, (s, d) -> s ^ d)"


def _checked(value: str) -> str:
    """The digest of a value with its check in the upper bits."""
    return f"(({value} & {_DIGEST}) | shiftleft(xxhash64({value} & {_DIGEST}), 48))"


def digests(text: str) -> str:
    """Distinct paragraph digests of a text; none for null and empty ones."""
    pieces = f"regexp_extract_all(coalesce({text}, ''), '[^\\\\n]{{1,{PIECE}}}', 0)"
    return f"array_distinct(transform(transform({pieces}, x -> xxhash64(x)), h -> {_checked('h')}))"


def cells(values: str) -> str:
    return f"transform(where, c -> {_summed(f'filter({values}, v -> {_hits('v', 'c')})')})"


def peeled(table: str) -> str:
    """Number of digests that peeling a table recovers.

    Null where the table does not come out empty or a digest came out twice (a sum that passed its check).
    """
    alone = (f"array_distinct(filter(zip_with(s.cells, where, (v, c) -> if(v <> 0 and v = {_checked('v')} and "
             f"{_hits('v', 'c')}, v, 0L)), v -> v <> 0))")
    less = f"zip_with(s.cells, where, (v, c) -> {_summed(f'filter(k, d -> {_hits('d', 'c')})', 'v')})"
    step = (f"if(s.done, s, element_at(transform(array({alone}), k -> if(size(k) = 0, "
            f"named_struct('cells', s.cells, 'got', s.got, 'done', true), "
            f"named_struct('cells', {less}, 'got', concat(s.got, k), 'done', false))), 1))")
    whole = "forall(s.cells, v -> v = 0) and size(array_distinct(s.got)) = size(s.got)"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {table}, 'got', filter({table}, v -> false), "
            f"'done', false), (s, r) -> {step}, s -> if({whole}, size(s.got), cast(null as int)))")


def _dealt(values: str, parts: str, seed: int) -> str:
    return f"transform(sequence(1, {parts}), q -> filter({values}, v -> pmod(xxhash64(v, {seed}), {parts}) = q - 1))"


def _total(counts: str) -> str:
    """Sum of counts, null if one is."""
    return f"aggregate({counts}, 0, (s, x) -> s + x)"


def _larger(values: str) -> str:
    """Digests recovered by tables of ``LOAD`` digests each, the failing ones retried as four."""
    four = _total(f"transform({_dealt('part', '4', 3)}, quarter -> {peeled(cells('quarter'))})")
    one = f"coalesce({peeled(cells('part'))}, {four})"
    side = f"cast(ceil(sqrt(size({values}) / {LOAD})) as int)"
    parts = f"flatten(transform({_dealt(values, f'greatest(1, {side})', 1)}, g -> {_dealt('g', f'greatest(1, {side})', 2)}))"
    return _total(f"transform({parts}, part -> {one})")


def differing(df: DataFrame, a: str, b: str, table_a: str, table_b: str, out: str) -> DataFrame:
    """Add ``out``: how many paragraph digests of columns ``a`` and ``b`` are in one of them only."""
    df = df.withColumn("_n", F.expr(peeled(f"zip_with({table_a}, {table_b}, (x, y) -> x ^ y)")))
    # Equal digests cancel in the cells, so both lists go in together.
    df = df.withColumn("_all", F.expr(f"if(_n is null, concat({a}, {b}), array())"))
    df = df.withColumn("_m", F.expr(f"if(_n is null, {_larger('_all')}, _n)"))
    exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    return df.withColumn(out, F.expr(f"coalesce(_m, {exact})")).drop("_n", "_all", "_m")


def likeness(a: str, b: str, differ: str):
    """Share of the two texts' paragraphs that both have; 1 for two texts without any."""
    both = f"(size({a}) + size({b}))"
    return F.expr(f"if({both} = 0, 1.0D, 1.0D - {differ} / cast({both} as double))")


def fingerprint(values: str, table: str):
    """Number of paragraph digests and the cells in hexadecimal."""
    return F.expr(f"concat(size({values}), ':', concat_ws('', transform({table}, v -> lpad(lower(hex(v)), 16, '0'))))")


def _placed(docs: DataFrame) -> DataFrame:
    """Add key (doc_id, null lowest) and bin: bins follow the key and hold about ``ROWS`` documents."""
    least = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.coalesce("doc_id", F.lit(least)))
    ids = keyed.filter("doc_id is not null").select("doc_id")
    n = ids.count()
    coarse = 64 if n > 64 * ROWS else 1
    cuts = ids.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 0.002) if n else []
    if not cuts:
        return keyed.withColumn("bin", F.lit(0).cast("long"))
    fine = max(1, n // (coarse * ROWS))
    edges = sorted({int(c) for c in cuts})
    at = F.lit(0)
    for edge in edges[1:]:
        at = at + (F.col("doc_id") >= edge).cast("int")
    low = F.element_at(F.array(*map(F.lit, edges)), at + 1)
    high = F.element_at(F.array(*map(F.lit, [*edges[1:], edges[-1]])), at + 1)
    share = (F.col("doc_id") - low).cast("double") / F.greatest(high - low, F.lit(1))
    step = F.least(F.greatest(F.floor(share * fine), F.lit(0)), F.lit(fine - 1))
    return keyed.withColumn("bin", F.coalesce(at.cast("long") * fine + step, F.lit(-1)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digests, next_text, next_digests): the next document in descending doc_id.

    After the last comes the first; rows of one doc_id go by their text's hash, rows without one are last.
    """
    placed = _placed(docs)
    tops = placed.groupBy("bin").agg(F.max("key").alias("top"))
    order = Window.orderBy("bin")
    tops = stored(tops.withColumn("to", F.lead("bin").over(order))
                  .withColumn("to", F.coalesce("to", F.min("bin").over(Window.partitionBy()))))
    # A bin's first document also stands, as a guest, after the last one of the bin above.
    seats = F.when(F.col("key") == F.col("top"), F.array(
        F.struct("bin", F.lit(False).alias("guest")), F.struct(F.col("to").alias("bin"), F.lit(True).alias("guest"))
    )).otherwise(F.array(F.struct("bin", F.lit(False).alias("guest"))))
    seated = (placed.join(tops, "bin").withColumn("digests", F.expr(digests("text")))
              .select("doc_id", "text", "key", "digests", F.explode(seats).alias("seat"))
              .select("doc_id", "text", "key", "digests", "seat.*"))
    row = Window.partitionBy("bin").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    return (seated.withColumn("next_text", F.lead("text").over(row)).withColumn("next_digests", F.lead("digests").over(row))
            .filter("not guest").select("doc_id", "text", "digests", "next_text", "next_digests"))


def edited_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited version, and how alike they and the next text's are.

    ``docs`` needs doc_id and text; other columns are ignored. The last half of the code points (rounded
    down) is replaced by as many from the start of the next document in descending doc_id. Returns
    doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next. A null text
    is empty. Two texts without a paragraph are alike (1). Rows of one doc_id follow each other, rows
    without one come last; equal texts have equal fingerprints. An empty table gives an empty result.
    """
    base = with_next(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    df = base.withColumn("edited", F.expr(
        f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(coalesce(next_text, ''), 1, {half}))"))
    df = df.withColumn("edited_digests", F.expr(digests("edited"))).withColumn("where", F.expr(_WHERE))
    for name in ("", "edited_", "next_"):
        df = df.withColumn(f"{name}cells", F.expr(cells(f"{name}digests")))
    df = differing(df, "digests", "edited_digests", "cells", "edited_cells", "d_edited")
    df = differing(df, "digests", "next_digests", "cells", "next_cells", "d_next")
    return df.select(
        "doc_id", "n_chars", "edited", fingerprint("digests", "cells").alias("fingerprint"),
        fingerprint("edited_digests", "edited_cells").alias("edited_fingerprint"),
        likeness("digests", "edited_digests", "d_edited").alias("near_edited"),
        likeness("digests", "next_digests", "d_next").alias("near_next"))
