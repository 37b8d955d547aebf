"""The order table of a stream: alerts open orders, readings of a healthy asset close them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.operators.orders import merge_orders, open_orders, order_schema, orders, status_events, with_vessel
from meltemi.sources import files
from meltemi.sources.keyed import KeyedTable


@dataclass(frozen=True)
class OrderLedger:
    """Steps of a :class:`ChangeAlerts` job that keep the order table; pass :meth:`process` as its ``on_released``.

    Two keyed tables: all orders, and the open ones alone, which is all that a new batch has to know. A batch adds its status events to the buckets they fall into and writes no
    other. Both tables carry the batch's number, so a replay starts from the batch before and writes the same again, and status events are merged as least and greatest values,
    so a redelivered one changes nothing.
    """

    store: str
    asset: str
    asset_type: T.DataType
    vessels: DataFrame
    closing: Column
    ts: str = "timestamp"
    ts_type: T.DataType = T.TimestampType()
    asset_at: tuple[str, str] = ("latitude", "longitude")
    vessel_at: tuple[str, str] = ("vessel_lat", "vessel_lon")
    vessel_id: str = "vessel_id"
    buckets: int = 64

    @property
    def _cols(self) -> list[str]:
        return [*self.asset_at, self.vessel_id, "distance_nm"]

    def table(self, name: str) -> KeyedTable:
        kinds: list[T.DataType] = [T.DoubleType(), T.DoubleType(), self.vessels.schema[self.vessel_id].dataType, T.DoubleType()]
        return KeyedTable(f"{self.store}/{name}", ("asset_id",), order_schema(self.asset_type, self.ts_type, dict(zip(self._cols, kinds))), self.buckets)

    def process(self, alerts: DataFrame, released: DataFrame, batch_id: int) -> None:
        spark = alerts.sparkSession
        every, still = self.table("orders"), self.table("open")
        busy = open_orders(still.read(spark, upto=batch_id - 1), self.asset)
        concerned = busy.select(self.asset).union(alerts.select(self.asset)).distinct()
        closings = released.where(self.closing).select(self.asset, self.ts).join(concerned, self.asset, "left_semi")
        events = status_events(alerts, closings, asset=self.asset, ts=self.ts, cols=self.asset_at, earlier=busy)
        # Written before the search for vessels, which reads the openings once a ring.
        drafts = f"{self.store}/drafts/batch={batch_id}"
        events.write.mode("overwrite").parquet(drafts)
        events = spark.read.schema(events.schema).parquet(drafts)
        told = with_vessel(events, self.vessels, asset_at=self.asset_at, vessel_at=self.vessel_at, vessel_id=self.vessel_id).withColumnRenamed(self.asset, "asset_id")
        path = f"{self.store}/events/batch={batch_id}"
        told.write.mode("overwrite").parquet(path)
        changes = spark.read.schema(told.schema).parquet(path)
        every.merge(changes, batch_id, lambda old, new: merge_orders(old, new, cols=self._cols))
        still.merge(changes, batch_id, lambda old, new: merge_orders(old, new, cols=self._cols).where(F.col("ended").isNull()))
        every.forget(spark)
        still.forget(spark)
        files.remove(spark, drafts)

    def orders(self, spark: SparkSession) -> DataFrame:
        """The order table as of the last batch."""
        return orders(self.table("orders").read(spark))

    def events(self, spark: SparkSession) -> DataFrame:
        """Every status event, in the batch that brought it about."""
        return spark.read.parquet(f"{self.store}/events")
