"""The test tables dressed as the telemetry and reference tables, so that every query runs on them unchanged.

Events play the five feeds (click and error = wind, view = solar, purchase = gas,
signup = vessels, all of them = grid). The star schema plays the reference tables. Whole tables are bound; channels
the events lack are computed from ``value`` and ``props.k``. Time is sparse, so the clock's spans are longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.functions.clock import Clock
from meltemi.functions.text import FORCED_FAILURE
from meltemi.operators.emissions import compliance_status

SPANS = {
    "30s": "1 day",
    "60s": "2 days",
    "2m": "2 days",
    "3m": "3 days",
    "5m": "5 days",
    "10m": "5 days",
    "15m": "7 days",
    "20m": "14 days",
    "bin5s": "6 hours",
    "bin10s": "1 hour",
    "bin30s": "3 hours",
}
MAINLAND = 3
REGIONS = {"1": "first", "2": "second", "3": "third"}
PARKS = {"1": "north"}


def _lat(k: Column) -> Column:
    return F.lit(35.0) + k % 100 / F.lit(20.0)


def _user_lon() -> Column:
    return F.lit(20.0) + F.col("user_id") % 100 / F.lit(10.0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it is now: a rewritten one is read with its new schema."""
    return spark.read.parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, f"{sf_dir}/events.parquet")
    return raw.select("event_id", F.col("ts").alias("timestamp"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def wind(ev: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    k = F.col("k")
    rows = ev.where(F.col("event_type").isin("click", "error"))
    return rows.select(
        "event_id",
        "timestamp",
        F.lit("WindTurbineTelemetry").alias("stream_type"),
        F.col("user_id").alias("turbine_id"),
        F.when(failed, 0.0).otherwise(F.col("value")).alias("power_mw"),
        (k / F.lit(4.0)).alias("wind_speed_ms"),
        F.when(failed, 0.0).otherwise(k / F.lit(10.0)).alias("vibration_mm_s"),
        F.when(failed, 0.0).otherwise(k / F.lit(8.0)).alias("rotor_rpm"),
        (F.lit(20.0) + k / F.lit(4.0)).alias("nacelle_temp_c"),
        _lat(k).alias("latitude"),
        _user_lon().alias("longitude"),
        F.when(failed, FORCED_FAILURE).when(k >= 90, "bearing_degradation").when(k >= 80, "vibration_spike").otherwise("NONE").alias("fault_type"),
    )


def solar(ev: DataFrame) -> DataFrame:
    k = F.col("k")
    return ev.where(F.col("event_type") == "view").select(
        "event_id",
        "timestamp",
        F.lit("SolarInverterTelemetry").alias("stream_type"),
        F.col("user_id").alias("inverter_id"),
        (F.col("value") * F.lit(1000.0)).alias("power_kw"),
        (k * F.lit(10.0)).alias("irradiance_wm2"),
        (F.lit(15.0) + k / F.lit(2.0)).alias("panel_temp_c"),
        (k * F.lit(1.0)).alias("efficiency_pct"),
        _lat(k).alias("latitude"),
        _user_lon().alias("longitude"),
        F.when(k >= 95, "panel_soiling_or_string_fault").alias("fault_type"),
    )


def emissions(ev: DataFrame) -> DataFrame:
    plant = F.col("user_id") % 25
    k = F.col("k")
    return ev.where(F.col("event_type") == "purchase").select(
        "event_id",
        "timestamp",
        F.lit("EmissionsStream").alias("stream_type"),
        plant.alias("plant_id"),
        F.concat(F.lit("NATION_"), plant.cast("string")).alias("plant_name"),
        F.col("value").alias("power_output_mw"),
        (F.col("value") * F.lit(350.0)).alias("co2_kg_per_hour"),
        (k * F.lit(30.0)).alias("cumulative_co2_tonnes_today"),
        F.lit(1100.0).alias("ets_daily_allowance_tonnes"),
        F.least(k * F.lit(1.6), F.lit(150.0)).alias("compliance_pct"),
        F.lit("Natural Gas").alias("fuel_type"),
        F.when(k >= 97, "combustion_inefficient").alias("fault_type"),
    )


def grid(ev: DataFrame, region: DataFrame) -> DataFrame:
    k = F.col("k")
    made = F.col("value") * (F.lit(1.0) + (k - 50) / F.lit(500.0))
    names = region.select(F.col("r_regionkey").cast("bigint").alias("grid_id"), F.col("r_name").alias("grid_name"))
    rows = ev.withColumn("grid_id", F.col("user_id") % 5).join(names, "grid_id")
    return rows.select(
        "event_id",
        "timestamp",
        F.lit("GridTelemetry").alias("stream_type"),
        "grid_id",
        "grid_name",
        (F.lit(50.0) + (k - 50) / F.lit(200.0)).alias("frequency_hz"),
        F.col("value").alias("load_mw"),
        made.alias("generation_mw"),
        (F.lit(150.0) + k / F.lit(100.0)).alias("voltage_kv"),
        (made - F.col("value")).alias("balance_mw"),
    )


def vessel_positions(ev: DataFrame) -> DataFrame:
    k = F.col("k")
    return ev.where(F.col("event_type") == "signup").select(
        "event_id",
        "timestamp",
        F.lit("VesselPositions").alias("stream_type"),
        F.col("user_id").alias("vessel_id"),
        F.concat(F.lit("Vessel "), F.col("user_id").cast("string")).alias("vessel_name"),
        F.when(F.col("user_id") % 3 == 2, "Crew Transfer Vessel").otherwise("LNG Carrier").alias("vessel_type"),
        _lat(k).alias("latitude"),
        _user_lon().alias("longitude"),
        (k / F.lit(5.0)).alias("speed_knots"),
        (k * F.lit(3.6)).alias("heading_deg"),
        F.concat(F.lit("Port "), (k % 7).cast("string")).alias("destination"),
        F.greatest(F.col("value") - F.lit(10.0), F.lit(0.0)).alias("eta_hours"),
        F.when(k < 50, "Loaded").otherwise("On station").alias("cargo_status"),
    )


def power_plants(nation: DataFrame, region: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        n.cast("bigint").alias("plant_id"),
        F.col("n_name").alias("plant_name"),
        F.when(n % 3 == 0, "Wind Farm").when(n % 3 == 1, "Solar Park").otherwise("Gas Power Plant").alias("plant_type"),
        F.when(n % 3 == 0, "Wind").when(n % 3 == 1, "Solar").otherwise("Natural Gas").alias("fuel_type"),
        (F.lit(100.0) + n).alias("capacity_mw"),
        (n + 2000).alias("commissioning_year"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Prefecture "), (n % 6).cast("string")).alias("prefecture"),
        (F.lit(35.0) + n / F.lit(10.0)).alias("latitude"),
        (F.lit(20.0) + n / F.lit(5.0)).alias("longitude"),
        F.lit("Active").alias("status"),
        F.col("n_regionkey").cast("bigint").alias("grid_zone"),
    )


def _asset_lat(k: str) -> Column:
    return F.lit(35.0) + F.col(k) % 100 / F.lit(20.0)


def wind_turbines(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("turbine_id"),
        F.col("c_name").alias("turbine_name"),
        F.col("c_nationkey").cast("bigint").alias("plant_id"),
        F.col("c_mktsegment").alias("manufacturer"),
        F.concat(F.lit("M-"), F.col("c_nationkey").cast("string")).alias("model"),
        (F.col("c_acctbal") / F.lit(1000.0)).alias("capacity_mw"),
        F.lit(3.0).alias("cut_in_speed_ms"),
        F.lit(12.0).alias("rated_speed_ms"),
        F.lit(25.0).alias("cut_out_speed_ms"),
        _asset_lat("c_custkey").alias("latitude"),
        (F.lit(20.0) + F.col("c_custkey") % 100 / F.lit(10.0)).alias("longitude"),
        F.lit("Active").alias("status"),
    )


def solar_inverters(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("inverter_id"),
        F.col("c_name").alias("inverter_name"),
        F.col("c_nationkey").cast("bigint").alias("plant_id"),
        F.col("c_mktsegment").alias("manufacturer"),
        F.col("c_acctbal").alias("capacity_kw"),
        F.when(F.col("c_custkey") % 2 == 0, "Monocrystalline").otherwise("Bifacial").alias("panel_type"),
        _asset_lat("c_custkey").alias("latitude"),
        (F.lit(20.0) + F.col("c_custkey") % 100 / F.lit(10.0)).alias("longitude"),
        F.lit("Active").alias("status"),
    )


def substations(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.alias("substation_id"),
        F.col("s_name").alias("substation_name"),
        F.when(s % 3 == 0, 20.0).when(s % 3 == 1, 150.0).otherwise(400.0).alias("voltage_kv"),
        _asset_lat("s_suppkey").alias("latitude"),
        (F.lit(20.0) + s % 50 / F.lit(5.0)).alias("longitude"),
        (s % 5).alias("connected_grid_id"),
        F.when(s % 10 != 9, F.col("s_nationkey").cast("bigint")).alias("fed_by_plant_id"),
        F.lit("Active").alias("status"),
    )


def island_grids(region: DataFrame) -> DataFrame:
    r = F.col("r_regionkey")
    return region.select(
        r.cast("bigint").alias("grid_id"),
        F.col("r_name").alias("grid_name"),
        F.concat(F.lit("Island "), r.cast("string")).alias("island"),
        F.col("r_name").alias("region"),
        (F.lit(850.0) + r * 10).alias("peak_demand_mw"),
        (F.lit(1000.0) + r * 100).alias("installed_capacity_mw"),
        F.lit(50.0).alias("nominal_frequency_hz"),
    )


def vessels(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.alias("vessel_id"),
        F.col("s_name").alias("vessel_name"),
        F.when(s % 3 == 2, "Crew Transfer Vessel").otherwise("LNG Carrier").alias("vessel_type"),
        F.when(s % 2 == 0, "Greece").otherwise("Malta").alias("flag"),
        (F.col("s_acctbal") * F.lit(10.0)).alias("capacity_m3"),
        F.col("s_nationkey").cast("bigint").alias("supply_plant_id"),
    )


def service_vessels(supplier: DataFrame) -> DataFrame:
    """Vessels on standby with their position."""
    s = F.col("s_suppkey")
    return supplier.where(F.col("s_acctbal") > 0).select(
        s.alias("vessel_id"), _asset_lat("s_suppkey").alias("vessel_lat"), (F.lit(20.0) + s % 50 / F.lit(5.0)).alias("vessel_lon")
    )


def route_legs(supplier: DataFrame) -> DataFrame:
    """Five waypoints per vessel, heading north-east."""
    s = F.col("s_suppkey")
    rows = supplier.select(s.alias("vessel_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("leg_no"))
    return rows.select(
        "vessel_id",
        "leg_no",
        (F.lit(35.0) + F.col("leg_no") * (F.col("vessel_id") % 7 + 3) / F.lit(10.0)).alias("lat"),
        (F.lit(20.0) + F.col("leg_no") * (F.col("vessel_id") % 5 + 2) / F.lit(5.0)).alias("lon"),
    )


def maintenance_orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    day = F.to_date("o_orderdate")
    return orders.select(
        key.alias("order_id"),
        F.when(key % 3 == 0, "Corrective").when(key % 3 == 1, "Preventive").otherwise("Inspection").alias("order_type"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(done, "Completed").otherwise("In Progress").alias("status"),
        F.col("o_custkey").alias("asset_id"),
        F.lit("WindTurbine").alias("asset_type"),
        (F.col("o_custkey") % 25).alias("plant_id"),
        day.alias("created_date"),
        F.when(done, F.date_add(day, 5)).alias("completed_date"),
        F.concat(F.lit("Technician "), (key % 5).cast("string")).alias("technician"),
        F.col("o_totalprice").alias("cost_eur"),
    )


def emissions_ledger(lineitem: DataFrame) -> DataFrame:
    plant = F.col("l_suppkey") % 25
    allowance = F.col("l_extendedprice") / F.lit(1000.0)
    pct = F.when(allowance != 0, F.lit(100.0) * F.col("l_quantity") / allowance)
    return lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        plant.alias("plant_id"),
        F.concat(F.lit("NATION_"), plant.cast("string")).alias("plant_name"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        F.col("l_quantity").alias("co2_tonnes"),
        allowance.alias("ets_allowance_tonnes"),
        pct.alias("compliance_pct"),
        compliance_status(pct).alias("compliance_status"),
    )


class SfTables(Mapping[str, DataFrame]):
    """Telemetry and reference tables by name; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        raw = self.raw
        self._makers = {
            "events": lambda: events(spark, sf_dir),
            "wind": lambda: wind(self["events"]),
            "solar": lambda: solar(self["events"]),
            "emissions": lambda: emissions(self["events"]),
            "grid": lambda: grid(self["events"], raw("region")),
            "vessel_positions": lambda: vessel_positions(self["events"]),
            "power_plants": lambda: power_plants(raw("nation"), raw("region")),
            "wind_turbines": lambda: wind_turbines(raw("customer")),
            "solar_inverters": lambda: solar_inverters(raw("customer")),
            "substations": lambda: substations(raw("supplier")),
            "island_grids": lambda: island_grids(raw("region")),
            "vessels": lambda: vessels(raw("supplier")),
            "service_vessels": lambda: service_vessels(raw("supplier")),
            "route_legs": lambda: route_legs(raw("supplier")),
            "maintenance_orders": lambda: maintenance_orders(raw("orders")),
            "emissions_ledger": lambda: emissions_ledger(raw("lineitem")),
        }
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    def clock(self) -> Clock:
        return Clock.at_newest(self["events"], spans=SPANS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
