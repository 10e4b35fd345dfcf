"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from foretally.session import scratch


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut and executors may be lost.

    Shuffle files of the finished plan go as soon as the driver collects its garbage, so it is asked to.
    """
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for jobs run inside: where a row holds a whole block, many are too many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
