"""The 27 entity questions as fixed queries over the ontology.

"Current" means the newest live value without a lookback. Given a clock, those questions look
at the last day first and read older events only for assets that were silent since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock
from meltemi.functions.terms import apply_term
from meltemi.operators.entities import Tables, entity_view, follow
from meltemi.plans.ontology import ENTITIES, ONTOLOGY

RECENT = "1 day"


def _hop(df: DataFrame, t: Tables, rel: str, how: str = "left", **kwargs) -> DataFrame:
    return follow(df, t, ONTOLOGY, rel, how=how, **kwargs)


def _live(t: Tables, entity: str, clock: Clock | None, *props: str) -> DataFrame:
    """The entity with its newest values; with a clock the last day is read first and older events only where needed."""
    return entity_view(t, ENTITIES[entity], clock=clock, recent=RECENT if clock else None, props=props)


def g01_plants(t: Tables) -> DataFrame:
    return t["power_plants"].select("plant_name", "plant_type", "fuel_type", "capacity_mw", "region", "prefecture")


def g02_turbines_by_plant(t: Tables) -> DataFrame:
    rows = _hop(t["wind_turbines"], t, "belongs_to_plant", cols={"plant_name": "plant_name"})
    return rows.select("plant_name", "turbine_id", "turbine_name", "manufacturer", "model", "capacity_mw").orderBy("plant_name", "turbine_id")


def g03_inverters_at(t: Tables, plant: str = "Crete Solar Park") -> DataFrame:
    rows = _hop(t["solar_inverters"], t, "installed_at_plant", cols={"plant_name": "plant_name"})
    return rows.where(F.col("plant_name") == plant).select("inverter_id", "inverter_name", "manufacturer", "panel_type", "capacity_kw")


def g04_grids(t: Tables) -> DataFrame:
    return t["island_grids"].select("grid_id", "grid_name", "island", "region", "installed_capacity_mw", "peak_demand_mw")


def g05_substations(t: Tables) -> DataFrame:
    rows = _hop(t["substations"], t, "feeds_grid", "left", cols={"grid_name": "grid_name"})
    rows = _hop(rows, t, "fed_by_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("substation_id", "substation_name", "voltage_kv", "grid_name", "plant_name")


def g06_vessels(t: Tables) -> DataFrame:
    rows = _hop(t["vessels"], t, "supplies_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("vessel_id", "vessel_name", "vessel_type", "flag", "capacity_m3", "plant_name")


def g07_orders(t: Tables) -> DataFrame:
    return t["maintenance_orders"].select("order_id", "priority", "status", "asset_id", "plant_id", "technician", "created_date")


def g08_emission_records(t: Tables) -> DataFrame:
    return t["emissions_ledger"].select("record_id", "plant_name", "period", "co2_tonnes", "ets_allowance_tonnes", "compliance_status")


def g09_wind_farm_capacity(t: Tables) -> DataFrame:
    """Turbines of each wind farm with two totals that need not agree: the stated capacity and the sum of the turbines."""
    farms = apply_term(t["power_plants"], "wind farm").select("plant_id", "plant_name", F.col("capacity_mw").alias("plant_mw"))
    sums = t["wind_turbines"].groupBy("plant_id").agg(F.sum("capacity_mw").alias("turbines_mw"), F.count("*").alias("turbines"))
    rows = farms.join(sums, "plant_id", "left").join(
        t["wind_turbines"].select("plant_id", "turbine_id", "manufacturer", "capacity_mw"), "plant_id", "left"
    )
    return rows.select("plant_name", "turbine_id", "manufacturer", "capacity_mw", "plant_mw", "turbines_mw", "turbines")


def g10_plant_connections(t: Tables) -> DataFrame:
    rows = _hop(t["power_plants"], t, "fed_by_plant", "left", reverse=True, on="plant_id", cols={"substation_name": "substation_name"})
    rows = _hop(rows, t, "feeds_grid", "left", on="grid_zone", cols={"grid_name": "grid_name"})
    return rows.select("plant_name", "substation_name", "grid_name")


def g11_turbine_sites(t: Tables) -> DataFrame:
    rows = _hop(t["wind_turbines"], t, "belongs_to_plant", cols={"plant_name": "plant_name", "region": "region", "prefecture": "prefecture"})
    return rows.select("turbine_id", "turbine_name", "plant_name", "region", "prefecture")


def g12_inverter_grids(t: Tables) -> DataFrame:
    rows = _hop(t["solar_inverters"], t, "installed_at_plant", cols={"plant_name": "plant_name", "grid_zone": "grid_zone"})
    rows = _hop(rows, t, "feeds_grid", "left", on="grid_zone", cols={"grid_name": "grid_name"})
    return rows.select("inverter_id", "inverter_name", "plant_name", "grid_name")


def g13_vessel_positions(t: Tables, clock: Clock | None = None) -> DataFrame:
    rows = _live(t, "Vessel", clock, "latitude", "longitude", "speed_knots", "destination")
    rows = _hop(rows, t, "supplies_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("vessel_id", "vessel_name", "vessel_type", "plant_name", "live_latitude", "live_longitude", "live_speed_knots", "live_destination")


def g14_turbine_power(t: Tables, clock: Clock | None = None) -> DataFrame:
    rows = _hop(_live(t, "WindTurbine", clock, "power_mw"), t, "belongs_to_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("turbine_id", "plant_name", "manufacturer", "capacity_mw", "live_power_mw")


def g15_inverter_power(t: Tables, clock: Clock | None = None) -> DataFrame:
    rows = _hop(_live(t, "SolarInverter", clock, "power_kw"), t, "installed_at_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("inverter_id", "plant_name", "manufacturer", "capacity_kw", "live_power_kw")


def g16_vessel_courses(t: Tables, clock: Clock | None = None) -> DataFrame:
    rows = _hop(_live(t, "Vessel", clock, "speed_knots", "heading_deg"), t, "supplies_plant", "left", cols={"plant_name": "plant_name"})
    return rows.select("vessel_id", "vessel_name", "plant_name", "live_speed_knots", "live_heading_deg")


def g17_turbine_wind(t: Tables, clock: Clock | None = None) -> DataFrame:
    return _live(t, "WindTurbine", clock, "wind_speed_ms", "power_mw").select("turbine_id", "turbine_name", "capacity_mw", "live_wind_speed_ms", "live_power_mw")


def g18_inverter_irradiance(t: Tables, clock: Clock | None = None) -> DataFrame:
    return _live(t, "SolarInverter", clock, "irradiance_wm2", "power_kw").select("inverter_id", "inverter_name", "capacity_kw", "live_irradiance_wm2", "live_power_kw")


def g19_grid_state(t: Tables, clock: Clock | None = None) -> DataFrame:
    rows = _live(t, "Grid", clock, "frequency_hz", "load_mw", "generation_mw")
    return rows.select("grid_id", "grid_name", "installed_capacity_mw", "live_frequency_hz", "live_load_mw", "live_generation_mw")


def g20_plants_in_prefecture(t: Tables, prefecture: str = "Cyclades") -> DataFrame:
    return t["power_plants"].where(F.col("prefecture") == prefecture).select("plant_id", "plant_name", "plant_type", "fuel_type", "capacity_mw")


def g21_plants_in_region(t: Tables, region: str = "South Aegean") -> DataFrame:
    return t["power_plants"].where(F.col("region") == region).select("plant_id", "plant_name", "plant_type", "fuel_type", "grid_zone")


def g22_active_orders(t: Tables) -> DataFrame:
    """Exactly the two named states; the synonym 'open work order' would add scheduled ones."""
    rows = t["maintenance_orders"].where(F.col("status").isin("Open", "In Progress"))
    return rows.select("order_id", "asset_id", "plant_id", "priority", "technician", "status")


def g23_critical_orders(t: Tables, priority: str = "Critical") -> DataFrame:
    return t["maintenance_orders"].where(F.col("priority") == priority).select("order_id", "priority", "status", "asset_id", "plant_id", "technician")


def g24_orders_completed(t: Tables, year: int = 2026) -> DataFrame:
    rows = t["maintenance_orders"].where((F.col("status") == "Completed") & (F.year("completed_date") == year))
    return rows.select("order_id", "technician", "asset_id", "plant_id", "cost_eur", "completed_date")


def g25_farm_network(t: Tables, plant: str = "Naxos Wind Farm") -> DataFrame:
    """The turbines of one plant, its grid and the substations feeding it.

    The plant is chosen first, so every hop joins from its few rows. Turbines and substations are
    listed one below the other by ``role``; side by side they would multiply.
    """
    seed = t["power_plants"].where(F.col("plant_name") == plant).select("plant_id", "plant_name", "grid_zone")
    seed = _hop(seed, t, "feeds_grid", "left", on="grid_zone", cols={"grid_name": "grid_name"})
    turbines = _hop(seed, t, "belongs_to_plant", reverse=True, on="plant_id", cols={"turbine_name": "name", "manufacturer": "manufacturer", "capacity_mw": "capacity_mw"})
    stations = _hop(seed, t, "fed_by_plant", reverse=True, on="plant_id", cols={"substation_name": "name"})
    both = turbines.withColumn("role", F.lit("turbine")).unionByName(stations.withColumn("role", F.lit("substation")), allowMissingColumns=True)
    return both.select("plant_name", "grid_name", "role", "name", "manufacturer", "capacity_mw")


def g26_plant_supply(t: Tables, plant: str = "Lavrio Gas CCGT") -> DataFrame:
    """One plant with the substations feeding it and the vessels supplying it, a row for each."""
    seed = t["power_plants"].where(F.col("plant_name") == plant).select("plant_id", "plant_name", "capacity_mw", "region")
    stations = _hop(seed, t, "fed_by_plant", "left", reverse=True, on="plant_id", cols={"substation_name": "name"})
    supply = _hop(seed, t, "supplies_plant", "left", reverse=True, on="plant_id", cols={"vessel_name": "name"})
    both = stations.withColumn("role", F.lit("substation")).unionByName(supply.withColumn("role", F.lit("vessel")))
    return both.select("plant_name", "capacity_mw", "region", "role", "name")


def g27_wind_farm_power(t: Tables, clock: Clock | None = None) -> DataFrame:
    farms = apply_term(t["power_plants"], "wind farm").select(F.col("plant_id"), "plant_name")
    rows = _live(t, "WindTurbine", clock, "power_mw").join(farms, "plant_id")
    return rows.select("plant_name", "turbine_id", "manufacturer", "capacity_mw", "live_power_mw")


QUESTIONS = {f.__name__.split("_")[0].upper(): f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:1] == "g" and f.__name__[1:3].isdigit()}
