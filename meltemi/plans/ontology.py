"""The business ontology: eight entities, four of them with live properties, and seven relationships."""

from __future__ import annotations

from meltemi.operators.entities import Entity, LiveBinding, Ontology, Relationship


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# Entity names, keys, live properties and relationship names of the data model.
ENTITIES = {
    e.name: e
    for e in (
        Entity("PowerPlant", "power_plants", "plant_id"),
        Entity(
            "WindTurbine",
            "wind_turbines",
            "turbine_id",
            LiveBinding("wind", "turbine_id", _same("power_mw", "wind_speed_ms", "vibration_mm_s", "rotor_rpm", "nacelle_temp_c")),
        ),
        Entity(
            "SolarInverter",
            "solar_inverters",
            "inverter_id",
            LiveBinding("solar", "inverter_id", _same("power_kw", "irradiance_wm2", "panel_temp_c", "efficiency_pct")),
        ),
        Entity(
            "Grid",
            "island_grids",
            "grid_id",
            LiveBinding("grid", "grid_id", _same("frequency_hz", "load_mw", "generation_mw", "voltage_kv", "balance_mw")),
        ),
        Entity(
            "Vessel",
            "vessels",
            "vessel_id",
            LiveBinding(
                "vessel_positions",
                "vessel_id",
                {**_same("latitude", "longitude", "heading_deg", "eta_hours", "destination", "speed_knots"), "cargo_status": "status"},
            ),
        ),
        Entity("Substation", "substations", "substation_id"),
        Entity("MaintenanceOrder", "maintenance_orders", "order_id"),
        Entity("EmissionsRecord", "emissions_ledger", "record_id"),
    )
}

RELATIONSHIPS = {
    r.name: r
    for r in (
        Relationship("belongs_to_plant", "WindTurbine", "PowerPlant", "plant_id"),
        Relationship("installed_at_plant", "SolarInverter", "PowerPlant", "plant_id"),
        Relationship("supplies_plant", "Vessel", "PowerPlant", "supply_plant_id"),
        Relationship("fed_by_plant", "Substation", "PowerPlant", "fed_by_plant_id"),
        Relationship("feeds_grid", "Substation", "Grid", "connected_grid_id"),
        Relationship("servicing_asset", "MaintenanceOrder", "PowerPlant", "plant_id"),
        Relationship("emitted_by_plant", "EmissionsRecord", "PowerPlant", "plant_id"),
    )
}

ONTOLOGY = Ontology(ENTITIES, RELATIONSHIPS)
