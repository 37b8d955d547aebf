"""Change alerts over a stream, in event-time order, with the batch operator doing the work.

Rows wait until the watermark passes them; then they are compared, in (time, tiebreak)
order, with the row before them. A row is too late, and counted, only when a later one of its own
object has been released. What a restart needs is written per micro-batch: the last released row of
every object, the rows still waiting, and the watermark. Because the comparison is the batch operator, a hot
object is split by time slice here too, and any split into micro-batches gives the batch answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meltemi.functions.clock import micros
from meltemi.operators.alerts import becomes
from meltemi.operators.latest import as_list, latest
from meltemi.operators.series import width_us
from meltemi.streaming.ingest import started

# Beyond every event time: releases all waiting rows when a bounded source ends.
_END_US = 9_000_000_000_000_000


@dataclass(frozen=True)
class ChangeAlerts:
    """Alert when ``condition`` becomes true for an object identified by ``keys``."""

    store: str
    keys: Sequence[str] | str
    condition: Column
    ts: str = "timestamp"
    tiebreak: Sequence[str] = ()
    delay: str = "1 minute"
    fire_on_first: bool = False
    on_alerts: Callable[[DataFrame, int], None] | None = None
    #: Called with the batch's alerts and all rows that the watermark has passed in it.
    on_released: Callable[[DataFrame, DataFrame, int], None] | None = None

    def _at(self, part: str, batch_id: int) -> str:
        return f"{self.store}/{part}/batch={batch_id}"

    def _watermark(self, spark: SparkSession, batch_id: int) -> int:
        return spark.read.parquet(self._at("watermark", batch_id)).first()["us"]

    def process(self, batch: DataFrame, batch_id: int, *, finish: bool = False) -> None:
        """One micro-batch. Every path carries the batch id, so a replay rewrites the same files."""
        spark = batch.sparkSession
        keys, t = as_list(self.keys), micros(self.ts)
        batch = batch.where(F.col(self.ts).isNotNull())
        columns = batch.columns
        if batch_id > 0:
            passed = self._watermark(spark, batch_id - 1)
            waiting = spark.read.schema(batch.schema).parquet(self._at("waiting", batch_id - 1))
            last = spark.read.schema(batch.schema).parquet(self._at("last", batch_id - 1))
        else:
            passed = -_END_US
            waiting = last = batch.where(F.lit(False))
        # Too late is a row at or before one already released for its own object.
        order = [self.ts, *self.tiebreak]
        seen = last.select(*keys, F.struct(*order).alias("_seen"))
        placed = batch.join(seen, keys, "left").withColumn("_late", F.coalesce(F.struct(*order) <= F.col("_seen"), F.lit(False)))
        placed = placed.select(*columns, "_late").persist()
        pool = waiting.unionByName(placed.where("not _late").select(*columns))
        try:
            fresh = F.max(F.when(F.col("_late"), None).otherwise(t))
            newest = F.lit(_END_US) if finish else F.greatest(F.lit(passed), F.coalesce(fresh - F.lit(width_us(self.delay)), F.lit(passed)))
            mark = placed.agg(newest.alias("us"), F.count_if("_late").alias("dropped"))
            mark.write.mode("overwrite").parquet(self._at("watermark", batch_id))
            now = self._watermark(spark, batch_id)

            ready = pool.where(t <= now)
            pool.where(t > now).write.mode("overwrite").parquet(self._at("waiting", batch_id))
            history = last.withColumn("_old", F.lit(True)).unionByName(ready.withColumn("_old", F.lit(False)))
            fired = becomes(history, keys, self.condition, ts=self.ts, tiebreak=self.tiebreak, fire_on_first=self.fire_on_first)
            alerts = fired.where(~F.col("_old")).select(*columns)
            alerts.write.mode("overwrite").parquet(self._at("alerts", batch_id))
            newest_rows = latest(last.unionByName(ready), keys, ts=self.ts, tiebreak=self.tiebreak)
            newest_rows.select(*columns).write.mode("overwrite").parquet(self._at("last", batch_id))
            fired_now = spark.read.schema(batch.schema).parquet(self._at("alerts", batch_id))
            if self.on_alerts is not None:
                self.on_alerts(fired_now, batch_id)
            if self.on_released is not None:
                self.on_released(fired_now, ready, batch_id)
        finally:
            placed.unpersist()
        self._forget(spark, batch_id - 2)

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove superseded state; the batch before the current one is kept for a replay."""
        jvm = getattr(spark, "_jvm", None)
        if batch_id < 0 or jvm is None:
            return
        for part in ("waiting", "last"):
            path = jvm.org.apache.hadoop.fs.Path(self._at(part, batch_id))
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def start(self, events: DataFrame, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        return started(events.writeStream.foreachBatch(self.process), checkpoint, available_now=available_now)

    def finish(self, spark: SparkSession, query: StreamingQuery) -> None:
        """After a bounded source has ended: release the rows still waiting."""
        done = query.lastProgress["batchId"] if query.lastProgress else -1
        if done < 0:
            return
        schema = spark.read.parquet(self._at("last", done)).schema
        empty = spark.read.schema(schema).parquet(self._at("last", done)).where(F.lit(False))
        self.process(empty, done + 1, finish=True)

    def dropped(self, spark: SparkSession) -> DataFrame:
        """Number of rows that came too late, per micro-batch."""
        return spark.read.parquet(f"{self.store}/watermark").select("batch", "dropped")

    def alerts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store}/alerts")


def dispatch_sink(store: str, make_orders: Callable[[DataFrame, DataFrame | None], DataFrame], asset: str) -> Callable[[DataFrame, int], None]:
    """An ``on_alerts`` step that writes dispatch orders and skips assets that have one already.

    ``make_orders`` gets the alerts and the assets with an open order (None at first). Orders of the
    batch being replayed are not counted as open, so a replay writes the same rows again.
    """

    def sink(alerts: DataFrame, batch_id: int) -> None:
        spark = alerts.sparkSession
        earlier = None
        if batch_id > 0:
            written = spark.read.parquet(f"{store}/orders")
            earlier = written.where((F.col("batch") < batch_id) & (F.col("status") == "Open")).select(F.col("asset_id").alias(asset))
        make_orders(alerts, earlier).write.mode("overwrite").parquet(f"{store}/orders/batch={batch_id}")

    return sink
