"""From a stream of JSON text to the telemetry tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from meltemi.sources.parts import PartTable
from meltemi.sources.schemas import FEEDS, Feed
from meltemi.sources.store import DAY, with_day
from meltemi.sources.wire import quarantine, routes, typed

BATCH = "ingest_batch"


def read_text(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """A folder of newline-delimited JSON files as a stream with column ``value``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic of JSON events as a stream with column ``value``; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for key, val in options.items():
        reader = reader.option(key, val)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def deduplicated(events: DataFrame, entity: str, *, ts: str = "timestamp", delay: str = "1 minute") -> DataFrame:
    """Drop redelivered events; state is kept for the watermark delay only."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([entity, ts])


def started(writer: DataStreamWriter, checkpoint: str, *, available_now: bool, interval: str = "2 seconds") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def write_batch(df: DataFrame, path: str, batch_id: int, *, fmt: str = "parquet") -> None:
    """Write one micro-batch below its date and batch partitions; a replay overwrites just those."""
    out = with_day(df).withColumn(BATCH, F.lit(batch_id).cast("long"))
    out.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).save(path)


def route_to_tables(
    raw: DataFrame,
    store: str,
    checkpoint: str,
    *,
    feeds: Mapping[str, Feed] = FEEDS,
    fmt: str = "parquet",
    available_now: bool = False,
    folded: bool = False,
) -> StreamingQuery:
    """One query reads the source once, parses it once and writes every feed's table plus the quarantine.

    With ``folded`` the feeds become part tables (``sources/parts.py``), whose small files are folded on the way; otherwise a folder a day and batch.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = typed(batch, feeds).persist()
        try:
            for name, rows in routes(parsed, feeds).items():
                if folded:
                    PartTable(f"{store}/{name}", rows.schema).commit(rows, batch_id)
                else:
                    write_batch(rows, f"{store}/{name}", batch_id, fmt=fmt)
            quarantine(parsed, feeds).write.format(fmt).mode("overwrite").save(f"{store}/quarantine/{BATCH}={batch_id}")
        finally:
            parsed.unpersist()

    return started(raw.writeStream.foreachBatch(sink), checkpoint, available_now=available_now)
