"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS = "spark.foretally.hotGroupRows"
HOT_ROWS_DEFAULT = 4_000_000
BROADCAST_BYTES = "spark.foretally.broadcastBytes"
BROADCAST_BYTES_DEFAULT = 64 * 1024 * 1024
TASK_ROWS = "spark.foretally.taskRows"
TASK_ROWS_DEFAULT = 500_000


def hot_rows(spark: SparkSession) -> int:
    """Rows one group may hold before window work on it is cut into blocks."""
    return int(spark.conf.get(HOT_ROWS, str(HOT_ROWS_DEFAULT)))


def broadcast_bytes(spark: SparkSession) -> int:
    """Measured size up to which a lookup table is sent to every executor."""
    return int(spark.conf.get(BROADCAST_BYTES, str(BROADCAST_BYTES_DEFAULT)))


def task_rows(spark: SparkSession) -> int:
    """Rows that a task sorts or holds at once."""
    return int(spark.conf.get(TASK_ROWS, str(TASK_ROWS_DEFAULT)))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that ``rows`` rows are dealt to where a task sorts or holds them, so that its memory does not grow with the input."""
    return max(1, -(-rows // task_rows(spark)))


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; one of our own only where none is set, on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder the session names."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path beside the checkpoints, reachable by every executor."""
    return f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder: smaller than a checkpoint, and computed once."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for jobs run inside."""
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
