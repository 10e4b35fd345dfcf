"""Bounded, repeatable samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PARTS = 1 << 30


def held_out() -> Column:
    """Rows kept from learning: crc32 of the doc_id as text leaves 2 when divided by 4 (null: not kept)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, most: int) -> DataFrame:
    """Rows drawn by a digest of doc_id, so that about ``most`` come out, and never more."""
    n = labelled.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_PARTS))
    return labelled.filter(share < int(_PARTS * min(1.0, most / max(1, n)))).limit(most)
