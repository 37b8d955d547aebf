"""The event store: date-partitioned telemetry tables, retention, ingest health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.functions.clock import Clock, within

DAY = "event_date"


def with_day(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn(DAY, F.to_date(ts))


def append(df: DataFrame, path: str, *, ts: str = "timestamp", fmt: str = "parquet") -> None:
    """Append events below their date partition."""
    with_day(df, ts).write.mode("append").format(fmt).partitionBy(DAY).save(path)


def read_events(spark: SparkSession, path: str, *, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The table with the columns of ``schema``, which spares looking into every file; without one, columns of all files are merged."""
    reader = spark.read.format(fmt)
    if schema is not None:
        return reader.schema(schema).load(path)
    return (reader.option("mergeSchema", "true") if fmt == "parquet" else reader).load(path)


def retained(df: DataFrame, as_of: Column, keep: str = "1 day", *, ts: str = "timestamp") -> DataFrame:
    """Events inside the retention period; whole old partitions are skipped unread."""
    bound = as_of - F.expr(f"INTERVAL {keep}")
    if DAY in df.columns:
        df = df.where(F.col(DAY) >= F.to_date(bound))
    return df.where(F.col(ts) >= bound)


def apply_retention(spark: SparkSession, path: str, as_of: Column, target: str, keep: str = "1 day", *, ts: str = "timestamp") -> None:
    """Write the retained part of a table to ``target``; the old table is left to be swapped out."""
    retained(read_events(spark, path), as_of, keep, ts=ts).write.mode("overwrite").partitionBy(DAY).parquet(target)


def compact_day(
    spark: SparkSession,
    path: str,
    day: str,
    target: str,
    *,
    order: Sequence[str] = ("timestamp",),
    rows_per_file: int = 5_000_000,
    drop: Sequence[str] = ("ingest_batch",),
) -> None:
    """Rewrite one day of a streamed table, thousands of small files, as a few large ones below ``target``.

    Files are cut by range over ``order``: with the asset's key first, a filter on assets or times skips most row
    groups, and a busy asset is split over several files. Other days in ``target`` stay as they are.
    """
    rows = read_events(spark, path).where(F.col(DAY) == F.lit(day).cast("date"))
    rows = rows.drop(*[c for c in drop if c in rows.columns])
    files = max(1, -(-rows.count() // rows_per_file))
    laid_out = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(target)


def ingest_health(events: DataFrame, clock: Clock, *, kind: str = "stream_type", value: str = "power_mw", ts: str = "timestamp", span: str = "2m") -> DataFrame:
    """Rows and rows with a positive reading per stream inside the last moments."""
    recent = within(events, clock, span, ts=ts)
    return recent.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("nonzero"))
