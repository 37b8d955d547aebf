"""The 26 dashboard tiles and the four map layers, over the telemetry tables.

Every tile takes the tables and a clock. Lookbacks are strict (an event exactly
at the edge is out). Sums over nothing are 0; a share of nothing is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock, within
from meltemi.functions.numbers import above, kw_to_mw, rank_of, rounded, share, total
from meltemi.functions.text import FORCED_FAILURE, by_prefix, differs, is_empty
from meltemi.operators.entities import Tables
from meltemi.operators.latest import distinct_keys, latest, newest
from meltemi.operators.series import bucketed, decompose, make_series, per_entity_bucketed

# Thresholds, labels, prefixes and the mainland grid's key.
CRITICAL, WARNING, ELEVATED = (7.0, "CRITICAL"), (5.0, "WARNING"), (4.0, "Elevated")
SEVERITY_ORDER = ("Elevated", "WARNING", "CRITICAL", "OFFLINE")
WIND_REGIONS = {"WT-THR": "Thrace (mainland)", "WT-TIN": "Tinos (Cyclades)", "WT-NAX": "Naxos (Cyclades)"}
SOLAR_PARKS = {"SI-THE": "Thessaly (80 MW)"}
OTHER_PARK = "Crete (60 MW)"
MAINLAND = "GR-MAIN"


def _now(t: Tables, feed: str, key: str, clock: Clock, span: str, cols: Sequence[str]) -> DataFrame:
    return latest(within(t[feed], clock, span), key, cols=cols)


def generation_snapshot(t: Tables, clock: Clock) -> DataFrame:
    """(Source, mw): the sum of the newest output of each asset, one row per source even when silent."""
    wind = _now(t, "wind", "turbine_id", clock, "30s", ["power_mw"]).agg(total("power_mw").alias("mw"))
    solar = _now(t, "solar", "inverter_id", clock, "30s", ["power_kw"]).agg(kw_to_mw(total("power_kw")).alias("mw"))
    gas = _now(t, "emissions", "plant_id", clock, "60s", ["power_output_mw"]).agg(total("power_output_mw").alias("mw"))
    parts = [p.select(F.lit(n).alias("Source"), "mw") for n, p in (("Wind", wind), ("Solar", solar), ("Gas", gas))]
    return reduce(DataFrame.unionByName, parts)


def e01_total_generation(t: Tables, clock: Clock) -> DataFrame:
    return generation_snapshot(t, clock).agg(rounded(F.sum("mw"), 1).alias("MW"))


def e02_renewable_pct(t: Tables, clock: Clock) -> DataFrame:
    clean = F.sum(F.when(F.col("Source") != "Gas", F.col("mw")).otherwise(F.lit(0.0)))
    return generation_snapshot(t, clock).agg(rounded(share(clean, F.sum("mw")), 1).alias("Renewable_Pct"))


def e03_mainland_frequency(t: Tables, clock: Clock, mainland=MAINLAND) -> DataFrame:
    rows = within(t["grid"], clock, "2m").where(F.col("grid_id") == mainland)
    return newest(rows.select("timestamp", "frequency_hz"), tiebreak="frequency_hz").select(rounded("frequency_hz", 3).alias("Hz"))


def e04_critical_faults(t: Tables, clock: Clock, approximate: bool = False) -> DataFrame:
    rows = within(t["wind"], clock, "2m").where(F.col("vibration_mm_s") > CRITICAL[0])
    return distinct_keys(rows, "turbine_id", name="Faults", approximate=approximate)


def e05_vessels_inbound(t: Tables, clock: Clock) -> DataFrame:
    now = _now(t, "vessel_positions", "vessel_id", clock, "2m", ["eta_hours"])
    return now.where(F.col("eta_hours") > 0).agg(F.count("*").alias("Vessels"))


def e06_ets_used_pct(t: Tables, clock: Clock) -> DataFrame:
    now = _now(t, "emissions", "plant_id", clock, "2m", ["compliance_pct"])
    return now.agg(rounded(F.max("compliance_pct"), 1).alias("ETS_Pct"))


def e07_generation_mix(t: Tables, clock: Clock) -> DataFrame:
    return generation_snapshot(t, clock).select("Source", rounded("mw", 1).alias("MW"))


def e08_total_generation_trend(t: Tables, clock: Clock, per_entity: bool = False) -> DataFrame:
    """MW per bucket and source. The default sums every sample of a bucket, as the chart does;
    ``per_entity`` averages each asset first, which does not depend on the sampling rate."""
    parts = []
    for source, feed, key, col, unit, width in (
        ("Wind", "wind", "turbine_id", "power_mw", 1.0, "bin10s"),
        ("Solar", "solar", "inverter_id", "power_kw", 1000.0, "bin10s"),
        ("Gas", "emissions", "plant_id", "power_output_mw", 1.0, "bin30s"),
    ):
        rows = within(t[feed], clock, "15m")
        if per_entity:
            sums = per_entity_bucketed(rows, clock.width(width), col, key)
        else:
            sums = bucketed(rows, clock.width(width), {col: F.sum(col)})
        parts.append(sums.select("timestamp", (F.col(col) / F.lit(unit)).alias("MW"), F.lit(source).alias("Source")))
    return reduce(DataFrame.unionByName, parts).orderBy("timestamp", "Source")


def top_severity(label: str, lexical: bool) -> Column:
    """The worst label of a group by meaning, or by spelling when ``lexical``.

    Labels are compared as ranks, a fixed-width value, which keeps the aggregate hash-based.
    """
    order = sorted(SEVERITY_ORDER) if lexical else list(SEVERITY_ORDER)
    return F.try_element_at(F.array(*[F.lit(x) for x in order]), F.max(rank_of(label, order)) + F.lit(1))


def e09_active_faults(t: Tables, clock: Clock, lexical: bool = False) -> DataFrame:
    recent = within(t["wind"], clock, "3m").select("turbine_id", "fault_type", "vibration_mm_s", "power_mw")
    offline = recent.where(F.col("fault_type") == FORCED_FAILURE).groupBy(F.col("turbine_id").alias("Asset")).agg(
        F.count("*").alias("Spikes"), F.lit(0.0).alias("Max_Vib"), F.lit(0.0).alias("Min_Power_MW"), F.lit("OFFLINE").alias("Severity")
    )
    shaking = recent.where(differs("fault_type", FORCED_FAILURE) | is_empty("fault_type"))
    shaking = shaking.withColumn("_s", above("vibration_mm_s", [CRITICAL, WARNING])).where(F.col("_s").isNotNull())
    vibration = shaking.groupBy(F.col("turbine_id").alias("Asset")).agg(
        F.count("*").alias("Spikes"),
        rounded(F.max("vibration_mm_s"), 2).alias("Max_Vib"),
        rounded(F.min("power_mw"), 2).alias("Min_Power_MW"),
        top_severity("_s", lexical).alias("Severity"),
    )
    both = offline.unionByName(vibration).withColumn("Type", F.lit("Wind Turbine"))
    return both.select("Asset", "Type", "Spikes", "Max_Vib", "Min_Power_MW", "Severity").orderBy("Severity", "Asset")


def e10_wind_by_region(t: Tables, clock: Clock, regions: Mapping[str, str] = WIND_REGIONS) -> DataFrame:
    rows = within(t["wind"], clock, "15m").withColumn("region", by_prefix("turbine_id", regions, "other"))
    return bucketed(rows, clock.width("bin10s"), {"total_mw": F.sum("power_mw")}, keys=["region"]).orderBy("timestamp", "region")


def asset_lines(t: Tables, clock: Clock, feed: str, key: str, span: str, channels: Mapping[str, str], assets: Sequence | None = None) -> DataFrame:
    """Raw channels over a lookback: of the named assets in time order, or of the whole fleet.

    A chart draws one asset's line, so the fleet's rows are not sorted as a whole.
    """
    rows = within(t[feed], clock, span)
    out = rows if assets is None else rows.where(F.col(key).isin(*assets))
    out = out.select(key, "timestamp", *[F.col(c).alias(n) for c, n in channels.items()])
    return out if assets is None else out.orderBy("timestamp", key)


def e11_bearing_line(t: Tables, clock: Clock, assets: Sequence | None = None) -> DataFrame:
    return asset_lines(t, clock, "wind", "turbine_id", "10m", {"vibration_mm_s": "Vibration_mm_s"}, assets)


def e12_anomaly_leaderboard(t: Tables, clock: Clock, lexical: bool = False) -> DataFrame:
    rows = within(t["wind"], clock, "5m").withColumn("_s", above("vibration_mm_s", [CRITICAL, WARNING, ELEVATED]))
    grouped = rows.where(F.col("_s").isNotNull()).groupBy(F.col("turbine_id").alias("Turbine_ID")).agg(
        F.count("*").alias("Spikes"),
        rounded(F.avg("vibration_mm_s"), 2).alias("Avg_Vib"),
        rounded(F.max("vibration_mm_s"), 2).alias("Max_Vib"),
        top_severity("_s", lexical).alias("Severity"),
    )
    return grouped.orderBy(F.desc("Spikes"), "Turbine_ID")


def e13_power_curve(t: Tables, clock: Clock) -> DataFrame:
    rows = within(t["wind"], clock, "15m").where(F.col("power_mw") > 0)
    speed = F.round("wind_speed_ms", 0).alias("wind_speed_ms")
    return rows.groupBy(speed).agg(F.avg("power_mw").alias("avg_power")).orderBy("wind_speed_ms")


def e14_statistical_anomalies(t: Tables, clock: Clock, assets: Sequence | None = None, threshold: float = 1.0, fill: str = "default", period: int | None = None) -> DataFrame:
    """Vibration as a gap-free series per turbine, with baseline, score and flag."""
    rows = within(t["wind"], clock, "20m")
    if assets is not None:
        rows = rows.where(F.col("turbine_id").isin(*assets))
    step = clock.width("bin5s")
    series = make_series(rows, "turbine_id", step, F.avg("vibration_mm_s"), name="vibration", fill=fill)
    out = decompose(series, "turbine_id", step, threshold=threshold, period=period, value="vibration")
    return out.select("turbine_id", "timestamp", "vibration", F.col("anomaly").alias("anomalies"), "score", "baseline")


def e15_asset_status(t: Tables, clock: Clock, assets: Sequence | None = None) -> DataFrame:
    return asset_lines(t, clock, "wind", "turbine_id", "10m", {"power_mw": "Power_MW", "vibration_mm_s": "Vibration_mm_s"}, assets)


def e16_solar_by_park(t: Tables, clock: Clock, parks: Mapping[str, str] = SOLAR_PARKS, other: str = OTHER_PARK) -> DataFrame:
    rows = within(t["solar"], clock, "15m").withColumn("park", by_prefix("inverter_id", parks, other))
    return bucketed(rows, clock.width("bin10s"), {"MW": kw_to_mw(F.sum("power_kw"))}, keys=["park"]).orderBy("timestamp", "park")


def e17_inverter_efficiency(t: Tables, clock: Clock) -> DataFrame:
    now = _now(t, "solar", "inverter_id", clock, "30s", ["power_kw", "irradiance_wm2", "efficiency_pct", "panel_temp_c"])
    lit_up = now.where(F.col("irradiance_wm2") > 100)
    return lit_up.select(
        F.col("inverter_id").alias("Inverter"),
        rounded("power_kw", 0).alias("Power_kW"),
        rounded("efficiency_pct", 1).alias("Efficiency_Pct"),
        F.col("panel_temp_c").alias("Panel_Temp_C"),
    ).orderBy("Efficiency_Pct", "Inverter")


def e18_co2_rate(t: Tables, clock: Clock) -> DataFrame:
    rows = within(t["emissions"], clock, "15m")
    return bucketed(rows, clock.width("bin30s"), {"CO2_kg_per_hr": F.avg("co2_kg_per_hour")}, keys=["plant_name"]).orderBy("timestamp", "plant_name")


def e19_ets_daily(t: Tables, clock: Clock) -> DataFrame:
    now = _now(t, "emissions", "plant_id", clock, "2m", ["plant_name", "compliance_pct", "cumulative_co2_tonnes_today", "ets_daily_allowance_tonnes"])
    return now.select(
        F.col("plant_name").alias("Plant"),
        rounded("compliance_pct", 1).alias("Used (%)"),
        F.col("cumulative_co2_tonnes_today").alias("Cumulative tCO2"),
        F.col("ets_daily_allowance_tonnes").alias("Daily Cap tCO2"),
    ).orderBy(F.desc("Used (%)"), "Plant")


def e20_island_frequency(t: Tables, clock: Clock, mainland=MAINLAND) -> DataFrame:
    rows = within(t["grid"], clock, "15m").where(F.coalesce(F.col("grid_id") != mainland, F.lit(True)))
    return bucketed(rows, clock.width("bin10s"), {"freq": F.avg("frequency_hz")}, keys=["grid_name"]).orderBy("timestamp", "grid_name")


def e21_mainland_balance(t: Tables, clock: Clock, mainland=MAINLAND) -> DataFrame:
    rows = within(t["grid"], clock, "15m").where(F.col("grid_id") == mainland)
    return rows.select("timestamp", F.col("load_mw").alias("Load_MW"), F.col("generation_mw").alias("Generation_MW")).orderBy("timestamp")


def e22_grid_status(t: Tables, clock: Clock) -> DataFrame:
    now = _now(t, "grid", "grid_id", clock, "30s", ["grid_name", "frequency_hz", "load_mw", "generation_mw", "voltage_kv", "balance_mw"])
    return now.select(
        F.col("grid_name").alias("Grid"),
        rounded("frequency_hz", 3).alias("Frequency_Hz"),
        rounded("load_mw", 1).alias("Load_MW"),
        rounded("generation_mw", 1).alias("Gen_MW"),
        rounded("voltage_kv", 1).alias("Voltage_kV"),
        rounded("balance_mw", 2).alias("Balance_MW"),
    ).orderBy("Grid")


def e23_vessel_positions(t: Tables, clock: Clock) -> DataFrame:
    cols = ["vessel_name", "vessel_type", "latitude", "longitude", "speed_knots", "destination", "eta_hours"]
    return _now(t, "vessel_positions", "vessel_id", clock, "2m", cols).select(*cols, F.lit(30).alias("marker_size"))


def e24_fleet_status(t: Tables, clock: Clock) -> DataFrame:
    cols = ["vessel_name", "vessel_type", "latitude", "longitude", "speed_knots", "heading_deg", "destination", "eta_hours", "cargo_status"]
    now = _now(t, "vessel_positions", "vessel_id", clock, "2m", cols)
    return now.select(
        F.col("vessel_name").alias("Vessel"),
        F.col("vessel_type").alias("Type"),
        rounded("latitude", 4).alias("Lat"),
        rounded("longitude", 4).alias("Lon"),
        F.col("speed_knots").alias("Speed_kn"),
        F.col("heading_deg").alias("Heading"),
        F.col("destination").alias("Destination"),
        F.col("eta_hours").alias("ETA_h"),
        F.col("cargo_status").alias("Cargo"),
    ).orderBy("ETA_h", "Vessel")


def _vessel_trend(t: Tables, clock: Clock, channel: str, name: str) -> DataFrame:
    rows = within(t["vessel_positions"], clock, "15m")
    return bucketed(rows, clock.width("bin30s"), {name: F.avg(channel)}, keys=["vessel_name"]).orderBy("timestamp", "vessel_name")


def e25_vessel_speed(t: Tables, clock: Clock) -> DataFrame:
    return _vessel_trend(t, clock, "speed_knots", "speed")


def e26_eta_countdown(t: Tables, clock: Clock) -> DataFrame:
    return _vessel_trend(t, clock, "eta_hours", "eta")


def e27_vessel_layer(t: Tables, clock: Clock) -> DataFrame:
    cols = ["vessel_name", "vessel_type", "latitude", "longitude"]
    return _now(t, "vessel_positions", "vessel_id", clock, "2m", cols).select("vessel_id", *cols)


def e28_wind_layer(t: Tables, clock: Clock) -> DataFrame:
    return _now(t, "wind", "turbine_id", clock, "2m", ["power_mw", "latitude", "longitude"]).select("turbine_id", "power_mw", "latitude", "longitude")


def e29_solar_layer(t: Tables, clock: Clock) -> DataFrame:
    return _now(t, "solar", "inverter_id", clock, "2m", ["panel_temp_c", "latitude", "longitude"]).select("inverter_id", "panel_temp_c", "latitude", "longitude")


def e30_gas_layer(t: Tables, clock: Clock) -> DataFrame:
    """The emission feed has no coordinates; they come from the plant table. Plants missing there stay listed without."""
    now = _now(t, "emissions", "plant_id", clock, "2m", ["co2_kg_per_hour"])
    return now.join(t["power_plants"].select("plant_id", "plant_name", "latitude", "longitude"), "plant_id", "left").select(
        "plant_id", "plant_name", "co2_kg_per_hour", "latitude", "longitude"
    )


TILES = {f.__name__.split("_")[0].upper(): f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:1] == "e" and f.__name__[1:3].isdigit()}
