"""Column layouts of the five telemetry tables and eight reference tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from 'name TYPE, ...'; unlike a DDL parse it needs no session."""
    out: list[T.StructField] = []
    for part in columns.split(","):
        name, kind = part.split()
        out.append(T.StructField(name, _TYPES[kind]))
    return T.StructType(out)


@dataclass(frozen=True)
class Feed:
    """One telemetry stream: its discriminator value, key, expected cadence and columns."""

    stream_type: str
    key: str
    cadence_s: float
    schema: T.StructType


# Stream discriminators, keys, cadences and column names of the wire format.
FEEDS: dict[str, Feed] = {
    "wind": Feed(
        "WindTurbineTelemetry",
        "turbine_id",
        2.0,
        _struct(
            "timestamp TIMESTAMP, stream_type STRING, turbine_id STRING, plant_id STRING, power_mw DOUBLE, "
            "wind_speed_ms DOUBLE, vibration_mm_s DOUBLE, rotor_rpm DOUBLE, nacelle_temp_c DOUBLE, "
            "latitude DOUBLE, longitude DOUBLE, fault_type STRING"
        ),
    ),
    "solar": Feed(
        "SolarInverterTelemetry",
        "inverter_id",
        6.0,
        _struct(
            "timestamp TIMESTAMP, stream_type STRING, inverter_id STRING, plant_id STRING, power_kw DOUBLE, "
            "irradiance_wm2 DOUBLE, panel_temp_c DOUBLE, efficiency_pct DOUBLE, latitude DOUBLE, "
            "longitude DOUBLE, fault_type STRING"
        ),
    ),
    "grid": Feed(
        "GridTelemetry",
        "grid_id",
        2.0,
        _struct(
            "timestamp TIMESTAMP, stream_type STRING, grid_id STRING, grid_name STRING, frequency_hz DOUBLE, "
            "load_mw DOUBLE, generation_mw DOUBLE, voltage_kv DOUBLE, balance_mw DOUBLE"
        ),
    ),
    "vessel_positions": Feed(
        "VesselPositions",
        "vessel_id",
        2.0,
        _struct(
            "timestamp TIMESTAMP, stream_type STRING, vessel_id STRING, vessel_name STRING, vessel_type STRING, "
            "latitude DOUBLE, longitude DOUBLE, speed_knots DOUBLE, heading_deg DOUBLE, destination STRING, "
            "eta_hours DOUBLE, cargo_status STRING"
        ),
    ),
    "emissions": Feed(
        "EmissionsStream",
        "plant_id",
        30.0,
        _struct(
            "timestamp TIMESTAMP, stream_type STRING, plant_id STRING, plant_name STRING, power_output_mw DOUBLE, "
            "co2_kg_per_hour DOUBLE, cumulative_co2_tonnes_today DOUBLE, ets_daily_allowance_tonnes DOUBLE, "
            "compliance_pct DOUBLE, fuel_type STRING, fault_type STRING"
        ),
    ),
}

# Reference table columns. ``period`` stays text; inference would read it as a timestamp.
REFERENCE: dict[str, T.StructType] = {
    "power_plants": _struct(
        "plant_id STRING, plant_name STRING, plant_type STRING, fuel_type STRING, capacity_mw DOUBLE, "
        "commissioning_year INT, region STRING, prefecture STRING, latitude DOUBLE, longitude DOUBLE, "
        "operator STRING, status STRING, grid_zone STRING"
    ),
    "wind_turbines": _struct(
        "turbine_id STRING, turbine_name STRING, plant_id STRING, manufacturer STRING, model STRING, "
        "capacity_mw DOUBLE, hub_height_m DOUBLE, rotor_diameter_m DOUBLE, cut_in_speed_ms DOUBLE, "
        "rated_speed_ms DOUBLE, cut_out_speed_ms DOUBLE, latitude DOUBLE, longitude DOUBLE, "
        "commissioning_date DATE, status STRING"
    ),
    "solar_inverters": _struct(
        "inverter_id STRING, inverter_name STRING, plant_id STRING, manufacturer STRING, model STRING, "
        "capacity_kw DOUBLE, panel_type STRING, panel_tilt_deg DOUBLE, panel_azimuth_deg DOUBLE, "
        "latitude DOUBLE, longitude DOUBLE, commissioning_date DATE, status STRING"
    ),
    "substations": _struct(
        "substation_id STRING, substation_name STRING, voltage_kv DOUBLE, substation_type STRING, region STRING, "
        "latitude DOUBLE, longitude DOUBLE, connected_grid_id STRING, fed_by_plant_id STRING, status STRING"
    ),
    "island_grids": _struct(
        "grid_id STRING, grid_name STRING, island STRING, region STRING, population INT, peak_demand_mw DOUBLE, "
        "installed_capacity_mw DOUBLE, interconnected BOOLEAN, interconnection_cable STRING, "
        "nominal_frequency_hz DOUBLE, latitude DOUBLE, longitude DOUBLE"
    ),
    "vessels": _struct(
        "vessel_id STRING, vessel_name STRING, vessel_type STRING, flag STRING, imo_number BIGINT, "
        "capacity_m3 DOUBLE, current_cargo_m3 DOUBLE, origin_port STRING, origin_country STRING, "
        "destination STRING, speed_knots DOUBLE, status STRING, supply_plant_id STRING"
    ),
    "maintenance_orders": _struct(
        "order_id STRING, order_type STRING, priority STRING, status STRING, asset_id STRING, asset_type STRING, "
        "plant_id STRING, description STRING, created_date DATE, scheduled_date DATE, completed_date DATE, "
        "technician STRING, cost_eur DOUBLE"
    ),
    "emissions_ledger": _struct(
        "record_id STRING, plant_id STRING, plant_name STRING, period STRING, co2_tonnes DOUBLE, "
        "ets_allowance_tonnes DOUBLE, fuel_consumed_mwh DOUBLE, emission_factor_tco2_per_mwh DOUBLE, "
        "compliance_pct DOUBLE, compliance_status STRING"
    ),
}

FEED_OF_STREAM = {feed.stream_type: name for name, feed in FEEDS.items()}
