"""Scans and sinks: typed CSV, tolerant chunk unions, narrowed caches and versioned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from foretally.operators.joins import small_join
from foretally.operators.ordered import History
from foretally.roles import Order


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL so aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, possibly with a byte-order mark, typed by name and projected.

    The header row decides the order; columns of the schema the file lacks become NULL.
    """
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns if c.startswith("﻿")})
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    cast = [(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return nan_to_null(raw.select(*cast))


def read_chunks(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType) -> DataFrame:
    """Union of Parquet chunks whose columns differ; absent columns are typed NULLs."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    return nan_to_null(df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields]))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames with differing columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def build_cache(df: DataFrame, path: str, narrow: Mapping[str, str], force: bool = False) -> DataFrame:
    """Write a narrowed Parquet copy unless one exists, and read it back."""
    cast = df.select(*[(F.col(c).cast(narrow[c]) if c in narrow else F.col(c)).alias(c) for c in df.columns])
    cast.write.mode("overwrite" if force else "ignore").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def top_entities(df: DataFrame, entity: str, n: int) -> DataFrame:
    """The largest entities by rows, ties by id."""
    return (df.groupBy(entity).agg(F.count(F.lit(1)).alias("volume"))
            .orderBy(F.desc("volume"), entity).limit(n))


def load_subset(df: DataFrame, entity: str, fit: str, n: int) -> DataFrame:
    """Rows of the entities with most rows in the fit period."""
    return df.join(top_entities(df.filter(fit), entity, n).select(entity), entity, "left_semi")


def regular_season(df: DataFrame, kind: str = "game_type", result: str = "type") -> DataFrame:
    return df.filter((F.col(kind) == "R") & F.col(result).isNotNull())


def deduplicated(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the first or last by an explicit order.

    Aggregates whole rows, so a key with many copies is reduced on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def month_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar months covering [start, end] per row, clipped at both ends."""
    months = df.withColumn("__m", F.explode(F.sequence(
        F.trunc(F.col(start), "MM"), F.col(end), F.expr("interval 1 month"))))
    return months.select(F.greatest(F.to_date("__m"), F.col(start)).alias("range_start"),
                         F.least(F.last_day("__m"), F.col(end)).alias("range_end"))


def manifest(df: DataFrame, season: str, day: str) -> DataFrame:
    """Rows and date span of every source file, ordered inside its season."""
    files = df.withColumn("file", F.input_file_name()).groupBy("file").agg(
        F.min(season).alias("season"), F.count(F.lit(1)).alias("n"), F.min(day).alias("start"), F.max(day).alias("end"))
    order = Window.partitionBy("season").orderBy("start", "file")
    return files.withColumns({"columns": F.lit(len(df.columns)), "chunk_order": F.row_number().over(order)})


def stamped(df: DataFrame, chunk: Sequence[str], order: Order, hot_rows: int | None = None) -> DataFrame:
    """0-based position of each row inside its chunk."""
    return History(df, list(chunk), order, hot_rows).position("sequence_in_chunk").df


def save_dataset(df: DataFrame, path: str, split: str = "split") -> str:
    """Partitioned zstd Parquet; returns the schema as JSON for the sidecar."""
    (df.write.mode("overwrite").partitionBy(split).option("compression", "zstd").parquet(f"{path}/data"))
    text = df.schema.json()
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    return text


def save_version(df: DataFrame, path: str, cutoff: str = "cutoff") -> None:
    """Replace only the cutoffs present in ``df``; its evidence must be older than its cutoff."""
    if "last_season" in df.columns:
        late = df.filter(F.col("last_season") >= F.col(cutoff))
        if not late.isEmpty():
            raise AssertionError("evidence at or after the cutoff")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(cutoff)
     .option("compression", "zstd").parquet(path))


def unpivoted(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long metrics."""
    doubles = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return doubles.unpivot(list(ids), list(values), "metric", "value")


def capped_sample(df: DataFrame, keys: Sequence[str], ident: Sequence[str], cap: int, seed: int,
                  hot_rows: int | None = None) -> DataFrame:
    """Fixed-seed sample of at most ``cap`` rows per key, by smallest digest of the row id.

    Up to the cap for which Spark limits groups before it shuffles them, one window does: a task sends on no
    more than ``cap`` rows of a key. For larger caps, rows are first counted per leading digest digits; only rows up to the digits where the
    count reaches the cap are ordered, so the full table is never sorted.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident])
    if cap <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        first = Window.partitionBy(*keys).orderBy("__h", *ident)
        return df.withColumn("__h", F.md5(text)).withColumn("__r", F.row_number().over(first)).filter(
            F.col("__r") <= cap).drop("__h", "__r")
    rows = df.withColumn("__h", F.md5(text)).withColumn("__b", F.substring("__h", 1, 4))
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = by_digits(counts, keys)
    last = before.filter(F.col("__below") < cap).groupBy(*keys).agg(F.max("__b").alias("__last"))
    near = small_join(rows, last, keys).filter(F.col("__b") <= F.col("__last"))
    order = Order(("__h", *ident))
    return History(near, list(keys), order, hot_rows).position("__r").df.filter(
        F.col("__r") < cap).drop("__h", "__b", "__last", "__r")


def by_digits(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with smaller leading digits per key (at most 16^4 cells a key)."""
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))


def write_submission(df: DataFrame, path: str, row_id: str, p: str, seq: str) -> None:
    """Two columns in the original row order, one header per part file.

    Rows are dealt by ranges of ``seq``, so part files follow each other as their rows do.
    """
    (df.orderBy(seq).select(row_id, p).write.mode("overwrite").option("header", True).csv(path))


def read_placed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV part files with their place: ``part`` number, ``block`` of the file and ``step`` inside the block.

    Steps grow along a block, which one task reads from its start; they are not consecutive.
    """
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*schema.fieldNames(),
                       F.regexp_extract(F.col("_metadata.file_name"), r"part-0*(\d+)", 1).cast("long").alias("part"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("step"))


def order_breaks(placed: DataFrame, seq: str) -> DataFrame:
    """One row, ``breaks``: how often a row's ``seq`` is not above that of the row written before it.

    Blocks are looked through one by one; between them only their first and last rows are compared, so the
    one unpartitioned window holds a row for each block of the files.
    """
    inside = Window.partitionBy("part", "block").orderBy("step")
    rows = placed.withColumn("__before", F.lag(seq).over(inside))
    blocks = rows.groupBy("part", "block").agg(
        F.count_if(F.col("__before").isNotNull() & (F.col(seq) <= F.col("__before"))).alias("inside"),
        F.min_by(seq, "step").alias("first"), F.max_by(seq, "step").alias("last"))
    turn = Window.orderBy("part", "block")
    edge = F.col("first") <= F.lag("last").over(turn)
    return blocks.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("long")).agg(
        F.coalesce(F.sum(F.col("inside") + F.col("edge")), F.lit(0)).alias("breaks"))
