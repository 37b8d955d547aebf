"""Change and condition alerts per object, and the orders they raise (batch forms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import micros
from meltemi.operators.latest import as_list
from meltemi.operators.order import previous_row


def becomes(
    df: DataFrame,
    keys: str | Sequence[str],
    condition: Column,
    *,
    ts: str = "timestamp",
    tiebreak: str | Sequence[str] = (),
    fire_on_first: bool = False,
) -> DataFrame:
    """Rows at which ``condition`` turns true for their object.

    An absent value counts as false. The first row of an object fires only when asked to:
    a change needs something to change from.
    """
    order = [ts, *as_list(tiebreak)]
    marked = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    linked = previous_row(marked, keys, order, ["_on"])
    was = F.coalesce(F.col("prev__on"), F.lit(not fire_on_first))
    return linked.where(F.col("_on") & ~was).select(*df.columns)


def changes_to(df: DataFrame, keys: str | Sequence[str], attribute: str, value, **kwargs) -> DataFrame:
    """Rows at which an attribute changes to ``value``."""
    return becomes(df, keys, F.col(attribute) == F.lit(value), **kwargs)


def crosses_above(df: DataFrame, keys: str | Sequence[str], value: str, limit: float, **kwargs) -> DataFrame:
    return becomes(df, keys, F.col(value) > limit, **kwargs)


def becomes_zero(df: DataFrame, keys: str | Sequence[str], value: str, **kwargs) -> DataFrame:
    return becomes(df, keys, F.col(value) == 0, **kwargs)


def order_id(asset: str | Column, started: str | Column) -> Column:
    """The same id for the same asset and episode, so a replay writes nothing new."""
    a = F.col(asset) if isinstance(asset, str) else asset
    return F.md5(F.concat_ws("|", a.cast("string"), micros(started).cast("string")))


def open_episodes(alerts: DataFrame, asset: str, *, ts: str = "timestamp", open_orders: DataFrame | None = None, cols: Sequence[str] = ()) -> DataFrame:
    """The earliest alert per asset, without assets that already have an open order."""
    first = alerts.groupBy(asset).agg(F.min(F.struct(ts, *cols)).alias("_a"))
    first = first.select(asset, F.col(f"_a.{ts}").alias("episode_start"), *[F.col(f"_a.{c}").alias(c) for c in cols])
    return first if open_orders is None else first.join(open_orders.select(asset).distinct(), asset, "left_anti")


def maintenance_orders(episodes: DataFrame, asset: str, *, asset_type: str = "WindTurbine", plant: str | None = None, reason: str = "Operations alert") -> DataFrame:
    """Critical corrective orders awaiting dispatch, in the layout of the order table."""
    day = F.to_date("episode_start")
    return episodes.select(
        order_id(asset, "episode_start").alias("order_id"),
        F.lit("Corrective").alias("order_type"),
        F.lit("Critical").alias("priority"),
        F.lit("Open").alias("status"),
        F.col(asset).alias("asset_id"),
        F.lit(asset_type).alias("asset_type"),
        (F.col(plant) if plant else F.lit(None).cast("string")).alias("plant_id"),
        F.lit(reason).alias("description"),
        day.alias("created_date"),
        F.lit(None).cast("date").alias("scheduled_date"),
        F.lit(None).cast("date").alias("completed_date"),
        F.lit("Pending Dispatch").alias("technician"),
        F.lit(0.0).alias("cost_eur"),
    )
