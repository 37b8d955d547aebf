"""The live table of a feed: the newest row of every asset, kept by a stream and read by questions about now."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meltemi.operators.latest import latest
from meltemi.sources import files
from meltemi.sources.keyed import KeyedTable, latest_rows
from meltemi.streaming.ingest import started


@dataclass(frozen=True)
class LiveTable:
    """Newest row per ``key`` in a keyed table.

    A micro-batch is reduced to one row per asset, which meets the table's rows in the buckets that it touches; no state is kept beside the table, and history is never read again. Newest is by event
    time, whatever the order of arrival, and a replayed batch changes nothing.
    """

    path: str
    key: str
    schema: T.StructType
    ts: str = "timestamp"
    buckets: int = 64

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.path, (self.key,), self.schema, self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, self.schema.names
        changes = f"{self.path}/changes/batch={batch_id}"
        newest = latest(batch.select(*names), self.key, ts=self.ts, cols=[c for c in names if c not in (self.key, self.ts)])
        newest.select(*names).write.mode("overwrite").parquet(changes)
        self.table.merge(spark.read.schema(self.schema).parquet(changes), batch_id, latest_rows([self.key], self.ts))
        self.table.forget(spark)
        files.remove(spark, changes)

    def start(self, events: DataFrame, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        return started(events.writeStream.foreachBatch(self.process), checkpoint, available_now=available_now)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)
