"""Vessel tracks: distance, derived speed, dwell, arrivals, and time to the end of the route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.clock import seconds_between
from meltemi.functions.geo import bearing_deg, distance_nm
from meltemi.functions.numbers import share
from meltemi.operators.order import previous_row


def legs_sailed(positions: DataFrame, *, vessel: str = "vessel_id", ts: str = "timestamp", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Consecutive positions of a vessel: distance, hours, derived speed and bearing of each move."""
    rows = positions.select(vessel, ts, *tiebreak, "latitude", "longitude")
    linked = previous_row(rows, vessel, [ts, *tiebreak], ["latitude", "longitude"]).where(F.col(f"prev_{ts}").isNotNull())
    moved = distance_nm("prev_latitude", "prev_longitude", "latitude", "longitude")
    return linked.select(
        vessel,
        F.col(f"prev_{ts}").alias("from_time"),
        F.col(ts).alias("to_time"),
        "latitude",
        "longitude",
        moved.alias("moved_nm"),
        (seconds_between(ts, f"prev_{ts}") / F.lit(3600.0)).alias("hours"),
        bearing_deg("prev_latitude", "prev_longitude", "latitude", "longitude").alias("bearing_deg"),
    ).withColumn("derived_knots", share(F.col("moved_nm"), F.col("hours"), 1.0))


def track_metrics(positions: DataFrame, *, vessel: str = "vessel_id", ts: str = "timestamp", tiebreak: Sequence[str] = (), still_nm: float = 0.05) -> DataFrame:
    """Per vessel: distance made good, mean speed, hours under way and standing by."""
    legs = legs_sailed(positions, vessel=vessel, ts=ts, tiebreak=tiebreak)
    still = F.col("moved_nm") <= still_nm
    grouped = legs.groupBy(vessel).agg(
        F.count("*").alias("moves"),
        F.sum("moved_nm").alias("distance_nm"),
        F.sum(F.when(still, F.lit(0.0)).otherwise(F.col("hours"))).alias("under_way_h"),
        F.sum(F.when(still, F.col("hours")).otherwise(F.lit(0.0))).alias("standby_h"),
    )
    return grouped.withColumn("mean_knots", share(F.col("distance_nm"), F.col("under_way_h"), 1.0))


def arrivals(positions: DataFrame, lat: float | Column, lon: float | Column, radius_nm: float, *, vessel: str = "vessel_id", ts: str = "timestamp", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows at which a vessel enters the circle around its destination."""
    from meltemi.operators.alerts import becomes

    at_lat = lat if isinstance(lat, Column) else F.lit(float(lat))
    at_lon = lon if isinstance(lon, Column) else F.lit(float(lon))
    near = distance_nm("latitude", "longitude", at_lat, at_lon) <= radius_nm
    rows = positions.select(vessel, ts, *tiebreak, "latitude", "longitude")
    return becomes(rows, vessel, near, ts=ts, tiebreak=tiebreak)


def packed_routes(route_legs: DataFrame, *, vessel: str = "vessel_id") -> DataFrame:
    """One row per vessel: its legs in order, each with end points, length and distance left after it.

    ``route_legs`` lists waypoints as (vessel, leg_no, lat, lon). Lengths and what is left are running values over a vessel's sorted
    waypoints, linear in them; the legs are then packed, as a route is a handful of waypoints by nature.
    """
    points = ["leg_no", "lat", "lon"]
    onward = Window.partitionBy(vessel).orderBy(*points)
    back = Window.partitionBy(vessel).orderBy(*[F.desc(c) for c in points])
    there = route_legs.select(vessel, *points).withColumn("_to", F.lead(F.struct("lat", "lon")).over(onward)).where(F.col("_to").isNotNull())
    legs = there.select(vessel, *points, F.col("_to.lat").alias("to_lat"), F.col("_to.lon").alias("to_lon"))
    legs = legs.withColumn("nm", distance_nm("lat", "lon", "to_lat", "to_lon"))
    after = F.coalesce(F.sum("nm").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    leg = F.struct(*points, "to_lat", "to_lon", "nm", after.alias("after_nm"))
    return legs.select(vessel, leg.alias("_leg")).groupBy(vessel).agg(F.array_sort(F.collect_list("_leg")).alias("legs"))


def time_to_go(positions: DataFrame, route_legs: DataFrame, *, vessel: str = "vessel_id", speed: str = "speed_knots") -> DataFrame:
    """Positions with the leg they are on, the distance left along the route and the hours that takes.

    A position is on the leg it lengthens least; equal detours go to the earlier leg. A vessel
    that is not moving has no hours to go; one without a route stays listed with a NULL leg. Routes are joined as one row per vessel, so positions are never multiplied.
    """
    joined = positions.join(packed_routes(route_legs, vessel=vessel), vessel, "left")
    options = F.transform(
        "legs",
        lambda leg: F.struct(
            F.round(
                distance_nm("latitude", "longitude", leg["lat"], leg["lon"])
                + distance_nm("latitude", "longitude", leg["to_lat"], leg["to_lon"])
                - leg["nm"],
                6,
            ).alias("detour"),
            leg["leg_no"].alias("leg_no"),
            (distance_nm("latitude", "longitude", leg["to_lat"], leg["to_lon"]) + leg["after_nm"]).alias("left_nm"),
        ),
    )
    chosen = joined.withColumn("_leg", F.array_min(options)).drop("legs")
    hours = F.when(F.col(speed) > 0, F.col("_leg.left_nm") / F.col(speed)).when(F.col("_leg").isNotNull(), F.lit(0.0))
    return chosen.select(*positions.columns, F.col("_leg.leg_no").alias("leg_no"), F.col("_leg.left_nm").alias("remaining_nm"), hours.alias("eta_h"))
