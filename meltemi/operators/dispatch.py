"""Dispatch: alerts without an open order, matched to the nearest standby vessel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.operators.alerts import open_episodes, order_id
from meltemi.operators.proximity import nearest


def dispatch_orders(
    alerts: DataFrame,
    vessels: DataFrame,
    *,
    asset: str,
    ts: str = "timestamp",
    asset_at: tuple[str, str] = ("latitude", "longitude"),
    vessel_at: tuple[str, str] = ("vessel_lat", "vessel_lon"),
    vessel_id: str = "vessel_id",
    open_orders: DataFrame | None = None,
) -> DataFrame:
    """One order per asset in trouble: the target is the asset's position, the vessel the nearest on standby.

    ``alerts`` may come from status changes or from anomaly events. Assets with an open order are skipped, and the
    id depends on asset and start of the episode only, so running it again over the same input changes nothing.
    """
    lat, lon = asset_at
    episodes = open_episodes(alerts, asset, ts=ts, open_orders=open_orders, cols=[lat, lon])
    pick = nearest(episodes, vessels, left_id=asset, right_id=vessel_id, left_at=asset_at, right_at=vessel_at)
    return episodes.join(pick, asset, "left").select(
        order_id(asset, "episode_start").alias("order_id"),
        F.col(asset).alias("asset_id"),
        "episode_start",
        F.col(lat).alias("target_lat"),
        F.col(lon).alias("target_lon"),
        F.col(vessel_id).alias("vessel_id"),
        "distance_nm",
        F.lit("Open").alias("status"),
    )


def alerts_from_anomalies(events: DataFrame, sites: DataFrame, *, asset: str, upward_only: bool = True) -> DataFrame:
    """Anomaly events as alerts: the asset, the time and where it stands, for dispatch before a failure.

    ``sites`` lists assets with their coordinates. A value far below its baseline is no reason to sail unless asked for.
    """
    rows = events.where(F.col("score") > 0) if upward_only else events
    return rows.select(F.col("entity_id").alias(asset), "timestamp", "score").join(sites.select(asset, "latitude", "longitude"), asset)
