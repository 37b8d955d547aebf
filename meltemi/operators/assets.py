"""Asset analytics: performance gap, solar ratio, cloud index, grid balance, cadence.

Assets that report but are missing from the reference table stay listed; what depends on it is NULL there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.clock import bucket, seconds_between
from meltemi.functions.physics import clear_sky_wm2, expected_solar_kw, expected_wind_mw
from meltemi.functions.numbers import share
from meltemi.operators.order import previous_row


def wind_performance(telemetry: DataFrame, turbines: DataFrame, width: str, *, ts: str = "timestamp") -> DataFrame:
    """Per turbine and window: mean actual and expected power, the gap, and the capacity factor."""
    dims = turbines.select("turbine_id", "capacity_mw", "cut_in_speed_ms", "rated_speed_ms", "cut_out_speed_ms")
    rows = telemetry.select("turbine_id", ts, "power_mw", "wind_speed_ms").join(dims, "turbine_id", "left")
    due = expected_wind_mw("wind_speed_ms", "cut_in_speed_ms", "rated_speed_ms", "cut_out_speed_ms", "capacity_mw")
    # The capacity is constant per turbine, so it is averaged rather than grouped by.
    grouped = rows.withColumn("_due", due).groupBy("turbine_id", bucket(ts, width).alias(ts)).agg(
        F.avg("power_mw").alias("actual_mw"), F.avg("_due").alias("expected_mw"), F.avg("capacity_mw").alias("_cap")
    )
    return grouped.select(
        "turbine_id",
        ts,
        "actual_mw",
        "expected_mw",
        (F.col("expected_mw") - F.col("actual_mw")).alias("gap_mw"),
        share(F.col("actual_mw"), F.col("_cap"), 1.0).alias("capacity_factor"),
    )


def solar_performance(telemetry: DataFrame, inverters: DataFrame, width: str, *, ts: str = "timestamp", drop_factor: float = 2.0) -> DataFrame:
    """Per inverter and window: produced against expected power; ``soiled`` when output fell by the drop factor or more."""
    dims = inverters.select("inverter_id", "capacity_kw")
    rows = telemetry.select("inverter_id", ts, "power_kw", "irradiance_wm2", "panel_temp_c").join(dims, "inverter_id", "left")
    due = expected_solar_kw("capacity_kw", "irradiance_wm2", "panel_temp_c")
    grouped = rows.withColumn("_due", due).groupBy("inverter_id", bucket(ts, width).alias(ts)).agg(
        F.sum("power_kw").alias("actual_kw"), F.sum("_due").alias("expected_kw")
    )
    ratio = share(F.col("actual_kw"), F.col("expected_kw"), 1.0)
    return grouped.select(
        "inverter_id",
        ts,
        "actual_kw",
        "expected_kw",
        ratio.alias("performance_ratio"),
        F.coalesce(F.col("actual_kw") * drop_factor <= F.col("expected_kw"), F.lit(False)).alias("soiled"),
    )


def cloud_index(telemetry: DataFrame, inverters: DataFrame, *, ts: str = "timestamp", utc_offset_h: float = 3.0) -> DataFrame:
    """Per park and hour: measured irradiance over the clear-sky expectation for the real date and time."""
    dims = inverters.select("inverter_id", F.col("plant_id").alias("park"), F.col("latitude").alias("_lat"))
    rows = telemetry.select("inverter_id", ts, "irradiance_wm2").join(dims, "inverter_id", "left")
    hour = F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.lit(utc_offset_h)
    local = F.pmod(hour, F.lit(24.0))
    clear = clear_sky_wm2("_lat", F.dayofyear(ts), local)
    grouped = rows.withColumn("_clear", clear).groupBy("park", bucket(ts, "1 hour").alias(ts)).agg(
        F.avg("irradiance_wm2").alias("measured_wm2"), F.avg("_clear").alias("clear_wm2")
    )
    return grouped.withColumn("cloud_index", share(F.col("measured_wm2"), F.when(F.col("clear_wm2") > 0, F.col("clear_wm2")), 1.0))


def grid_balance(telemetry: DataFrame, grids: DataFrame, width: str, *, ts: str = "timestamp", tolerance_hz: float = 0.2, cadence_s: float = 2.0) -> DataFrame:
    """Per grid and window: mean balance, worst deviation from nominal, minutes spent out of band."""
    dims = grids.select("grid_id", "nominal_frequency_hz")
    rows = telemetry.select("grid_id", ts, "frequency_hz", "load_mw", "generation_mw").join(dims, "grid_id", "left")
    rows = rows.withColumn("_dev", F.abs(F.col("frequency_hz") - F.col("nominal_frequency_hz")))
    return rows.groupBy("grid_id", bucket(ts, width).alias(ts)).agg(
        F.avg(F.col("generation_mw") - F.col("load_mw")).alias("balance_mw"),
        F.max("_dev").alias("max_deviation_hz"),
        (F.count_if(F.col("_dev") > tolerance_hz) * F.lit(cadence_s) / F.lit(60.0)).alias("out_of_band_min"),
    )


def counted_median(counts: DataFrame, key: str, value: str, weight: str, *, width: int = 3600, name: str = "median") -> DataFrame:
    """key, exact median of whole-number values given with their frequencies.

    Coarse classes of ``width`` values are added up first; only the one or two classes that hold the middle are
    looked into, so no task sees more than a class or the list of classes.
    """
    classed = counts.select(key, value, weight, F.floor(F.col(value) / F.lit(width)).alias("_b"))
    sums = classed.groupBy(key, "_b").agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sums.select(key, "_b", "_w", F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(Window.partitionBy(key)).alias("_n"))
    below = F.col("_upto") - F.col("_w")
    ranked = ranked.select(key, "_b", "_upto", below.alias("_below"), F.floor((F.col("_n") - 1) / 2).alias("_lo"), F.floor(F.col("_n") / 2).alias("_hi"))
    middle = ranked.where((F.col("_hi") >= F.col("_below")) & (F.col("_lo") < F.col("_upto"))).drop("_upto")
    inside = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = classed.join(middle, [key, "_b"]).withColumn("_c", F.col("_below") + F.sum(weight).over(inside))

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("_c") > F.col(rank), F.col(value)))

    return seen.groupBy(key).agg(((at("_lo") + at("_hi")) / F.lit(2.0)).alias(name))


def cadence_report(
    events: DataFrame,
    stream: str,
    entity: str,
    expected_s: Mapping[str, float],
    *,
    ts: str = "timestamp",
    slack: float = 1.5,
) -> DataFrame:
    """Per stream: intervals between consecutive reports of an entity, their median and maximum, and how many are gaps.

    Intervals are counted per whole second first, so everything after that sees one row per distinct interval.
    """
    linked = previous_row(events.select(stream, entity, ts), [stream, entity], ts, [])
    gaps = linked.where(F.col(f"prev_{ts}").isNotNull()).select(stream, F.round(seconds_between(ts, f"prev_{ts}")).cast("bigint").alias("_s"))
    counted = gaps.groupBy(stream, "_s").agg(F.count("*").alias("_n"))
    pairs: list[Column] = [F.lit(x) for k, v in expected_s.items() for x in (k, float(v))]
    due = F.try_element_at(F.create_map(*pairs), F.col(stream))
    late = F.sum(F.when(F.col("_s") > F.col("_due") * slack, F.col("_n")).otherwise(F.lit(0)))
    out = counted.withColumn("_due", due).groupBy(stream).agg(
        F.first("_due", ignorenulls=True).alias("expected_s"),
        F.sum("_n").alias("intervals"),
        F.max("_s").alias("max_s"),
        late.alias("gaps"),
    )
    return out.join(counted_median(counted, stream, "_s", "_n", name="median_s"), stream)
