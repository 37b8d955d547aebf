"""Latest state and time buckets over a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meltemi.operators.latest import latest
from meltemi.operators.series import bucketed
from meltemi.streaming.ingest import started


def latest_to_table(
    events: DataFrame,
    keys: str | Sequence[str],
    path: str,
    checkpoint: str,
    *,
    ts: str = "timestamp",
    cols: Sequence[str] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the newest row of every key. State is one row of the chosen columns per key.

    Each micro-batch writes only the keys it changed, under its own id, so a replay overwrites
    the same rows. :func:`current` reads the log; :func:`compacted` shortens it.
    """
    now = latest(events, keys, ts=ts, cols=cols)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return started(now.writeStream.outputMode("update").foreachBatch(sink), checkpoint, available_now=available_now)


def current(spark: SparkSession, path: str, keys: str | Sequence[str], *, ts: str = "timestamp") -> DataFrame:
    """The newest row per key from the log of changes."""
    return latest(spark.read.parquet(path).drop("batch"), keys, ts=ts)


def compacted(spark: SparkSession, path: str, target: str, keys: str | Sequence[str], *, ts: str = "timestamp") -> None:
    """Write the current rows to ``target`` as a log with a single entry."""
    current(spark, path, keys, ts=ts).write.mode("overwrite").parquet(f"{target}/batch=-1")


def buckets_to_table(
    events: DataFrame,
    width: str,
    aggs: Mapping[str, Column],
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    delay: str = "1 minute",
    available_now: bool = False,
) -> StreamingQuery:
    """Append each time bucket once the watermark has passed its end."""
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    grouped = rows.groupBy(F.window(ts, width).alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    out = grouped.select(F.col("_w.start").alias(ts), *keys, *aggs)
    return started(out.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, available_now=available_now)


def bucketed_batch(events: DataFrame, width: str, aggs: Mapping[str, Column], *, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """The batch answer the stream must agree with."""
    return bucketed(events, width, aggs, keys=keys, ts=ts, out=ts)
