"""The life of a dispatch order: opened by an alert, closed when its asset is well again, and opened anew by the next alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.functions.text import fault_label
from meltemi.operators.alerts import order_id
from meltemi.operators.order import previous_row
from meltemi.operators.proximity import nearest
from meltemi.session import settled

#: An order's states in the order they can follow each other; the last two end it.
STATUSES = ("Open", "In Progress", "Completed", "Cancelled")
ENDED = STATUSES[2:]


def well_again(fault: str = "fault_type", vibration: str = "vibration_mm_s", limit: float = 3.5) -> Column:
    """A reading that proves the asset healthy: no fault, and vibration inside the healthy range."""
    return fault_label(fault).isNull() & (F.col(vibration) <= limit)


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def status_events(
    alerts: DataFrame, closings: DataFrame, *, asset: str, ts: str = "timestamp", cols: Sequence[str] = (), earlier: DataFrame | None = None, status: str = "Completed", slices: int | None = None
) -> DataFrame:
    """Rows (``order_id``, asset, ``episode_start``, ``status``, ``at``, ``cols`` of the alert): the openings and endings that alerts and closings bring about.

    An alert opens an order unless one is open for its asset; a closing ends the open order, if there is one. So among an asset's alerts and closings in event-time order only the
    changes from one kind to the other count: repeated alerts, repeated closings and replays of either do nothing. At one instant the closing goes first. ``earlier`` holds orders that are
    open before all of these events (asset, ``episode_start``); they are ended but not opened again. Only each event's predecessor is looked at, by :func:`previous_row`, so an
    asset with most of the events is split by time.
    """
    told = alerts.select(asset, F.col(ts).alias("at"), F.lit(True).alias("opens"), F.lit(False).alias("known"), *cols)
    ends = closings.select(asset, F.col(ts).alias("at"), F.lit(False).alias("opens"), F.lit(False).alias("known"))
    every = told.unionByName(ends, allowMissingColumns=True)
    if earlier is not None:
        was = earlier.select(asset, F.col("episode_start").alias("at"), F.lit(True).alias("opens"), F.lit(True).alias("known"))
        every = every.unionByName(was, allowMissingColumns=True)
    # An order known already goes before anything else of its instant, so a replay of the alert that opened it opens nothing.
    every = every.withColumn("_turn", F.when(F.col("known"), 0).when(~F.col("opens"), 1).otherwise(2))
    linked = previous_row(every, asset, ["at", "_turn"], ["opens"], slices=slices)
    # Several rows of one kind at one instant are one event: they follow each other, and only the first has a predecessor of the other kind.
    changes = linked.where(F.col("opens") != F.coalesce(F.col("prev_opens"), F.lit(False))).select(*every.columns)
    paired = previous_row(changes, asset, ["at", "_turn"], ["opens"], slices=slices)
    start = F.when(F.col("opens"), F.col("at")).otherwise(F.col("prev_at"))
    rows = paired.where("not known").withColumn("episode_start", start)
    return rows.select(order_id(asset, "episode_start").alias("order_id"), asset, "episode_start", F.when(F.col("opens"), F.lit(STATUSES[0])).otherwise(F.lit(status)).alias("status"), "at", *cols)


def with_vessel(opened: DataFrame, vessels: DataFrame, *, asset_at: tuple[str, str], vessel_at: tuple[str, str], vessel_id: str = "vessel_id") -> DataFrame:
    """Opening events with the nearest vessel on standby and its distance, NULL where there is none; other events are passed on."""
    opens = opened.where(F.col("status") == STATUSES[0]).select("order_id", *asset_at)
    pick = nearest(opens, vessels, left_id="order_id", right_id=vessel_id, left_at=asset_at, right_at=vessel_at)
    return opened.join(pick, "order_id", "left")


def merge_orders(old: DataFrame | None, events: DataFrame, *, cols: Sequence[str] = ()) -> DataFrame:
    """One row per order: (``order_id``, ``asset_id``, ``opened_at``, ``ended``, ``last``, ``cols``) of earlier such rows and new status events.

    ``last`` is the newest status with its time, ``ended`` the earliest ending with its time. All are least or greatest values, so events may come in any order, in any number of merges and any
    number of times, and the result is the same. What an order is about comes from its earliest opening.
    """
    is_end = F.col("status").isin(*ENDED)
    new = events.select(
        "order_id",
        "asset_id",
        F.when(F.col("status") == STATUSES[0], F.struct(F.col("at").alias("at"), *cols)).alias("opened"),
        F.when(is_end, F.struct("at", "status")).alias("ended"),
        F.struct("at", _rank(F.col("status")).alias("rank"), "status").alias("last"),
    )
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("order_id").agg(F.min("asset_id").alias("asset_id"), F.min("opened").alias("opened"), F.min("ended").alias("ended"), F.max("last").alias("last"))


def order_schema(asset: T.DataType, ts: T.DataType, cols: dict[str, T.DataType]) -> T.StructType:
    """Columns of the merged rows, as a table keeps them."""
    field = T.StructField
    return T.StructType(
        [
            field("order_id", T.StringType()),
            field("asset_id", asset),
            field("opened", T.StructType([field("at", ts), *[field(c, t) for c, t in cols.items()]])),
            field("ended", T.StructType([field("at", ts), field("status", T.StringType())])),
            field("last", T.StructType([field("at", ts), field("rank", T.LongType()), field("status", T.StringType())])),
        ]
    )


def orders(merged: DataFrame) -> DataFrame:
    """The order table: an order that has ended stays so, whatever comes later."""
    status = F.coalesce(F.col("ended.status"), F.col("last.status"))
    about = [f.name for f in merged.schema["opened"].dataType.fields if f.name != "at"]
    return merged.select(
        "order_id", "asset_id", F.col("opened.at").alias("episode_start"), *[F.col(f"opened.{c}").alias(c) for c in about], status.alias("status"), F.col("ended.at").alias("closed_at")
    )


def open_orders(merged: DataFrame, asset: str) -> DataFrame:
    """Assets with an order that has not ended, and when it was opened."""
    return merged.where(F.col("ended").isNull() & F.col("opened").isNotNull()).select(F.col("asset_id").alias(asset), F.col("opened.at").alias("episode_start"))


def dispatch_history(
    alerts: DataFrame,
    closings: DataFrame,
    vessels: DataFrame,
    *,
    asset: str,
    ts: str = "timestamp",
    asset_at: tuple[str, str] = ("latitude", "longitude"),
    vessel_at: tuple[str, str] = ("vessel_lat", "vessel_lon"),
) -> DataFrame:
    """All orders of a history of alerts and closings, each with its vessel, its status and when it was closed."""
    # Written before the search for vessels, which reads the openings once a ring.
    events = settled(status_events(alerts, closings, asset=asset, ts=ts, cols=asset_at), "order-events")
    told = with_vessel(events, vessels, asset_at=asset_at, vessel_at=vessel_at).withColumnRenamed(asset, "asset_id")
    return orders(merge_orders(None, told, cols=[*asset_at, "vessel_id", "distance_nm"]))
