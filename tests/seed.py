"""Hand-written tables in the real schemas: a small fleet, its ledger and orders."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from meltemi.sources.schemas import FEEDS, REFERENCE

NOW = datetime(2026, 4, 14, 10, 0, 0, tzinfo=timezone.utc)

# Plants, substations, grids, vessels, orders and ledger rows whose answers are known.
PLANTS = """
PP-THR-01|Thrace Wind Complex|Wind Farm|Wind|120.0|Eastern Macedonia and Thrace|Evros|GR-MAIN
PP-TIN-01|Tinos Wind Farm|Wind Farm|Wind|17.0|South Aegean|Cyclades|GR-TIN
PP-NAX-01|Naxos Wind Farm|Wind Farm|Wind|29.4|South Aegean|Cyclades|GR-NAX
PP-THE-01|Thessaly Solar Park|Solar Park|Solar|80.0|Thessaly|Larissa|GR-MAIN
PP-CRE-01|Crete Solar Park|Solar Park|Solar|60.0|Crete|Heraklion|GR-CRE
PP-LAV-01|Lavrio Gas CCGT|Gas Power Plant|Natural Gas|400.0|Attica|East Attica|GR-MAIN
PP-MEG-01|Megalopoli Gas Unit|Gas Power Plant|Natural Gas|200.0|Peloponnese|Arcadia|GR-MAIN
"""
GRIDS = """
GR-MAIN|Mainland Grid|Mainland|Attica
GR-CRE|Crete Grid|Crete|Crete
GR-NAX|Naxos Grid|Naxos|South Aegean
GR-TIN|Tinos Grid|Tinos|South Aegean
GR-MYK|Mykonos Grid|Mykonos|South Aegean
GR-CYC|Cyclades Hub|Syros|South Aegean
"""
SUBSTATIONS = """
SUB-ALE-01|Alexandroupoli Substation|150|GR-MAIN|PP-THR-01
SUB-TIN-01|Tinos Substation|20|GR-TIN|PP-TIN-01
SUB-NAX-01|Naxos Substation|20|GR-NAX|PP-NAX-01
SUB-LAR-01|Larissa Substation|150|GR-MAIN|PP-THE-01
SUB-HER-01|Heraklion Substation|150|GR-CRE|PP-CRE-01
SUB-LAV-01|Lavrio Substation|400|GR-MAIN|PP-LAV-01
SUB-MEG-01|Megalopoli Substation|400|GR-MAIN|PP-MEG-01
SUB-SYR-01|Syros Hub Substation|150|GR-CYC|
"""
VESSELS = """
VE-LNG-01|Hellas Spirit|LNG Carrier|Greece|PP-LAV-01
VE-LNG-02|Second Carrier|LNG Carrier|Malta|PP-MEG-01
VE-SVC-01|Crew Boat|Crew Transfer Vessel|Greece|PP-NAX-01
"""
ORDERS = """
MO-2026-001|High|Completed|WT-THR-03|2026-01-19|12500
MO-2026-002|Medium|Completed|WT-TIN-02|2026-02-02|4200
MO-2026-003|High|Completed|SI-CRE-04|2026-02-04|8900
MO-2026-004|Low|Completed|WT-NAX-01|2026-02-15|1800
MO-2026-005|Medium|Completed|WT-THR-06|2026-02-23|6700
MO-2026-006|Medium|Completed|SI-THE-03|2026-03-05|2100
MO-2026-007|High|Completed|WT-NAX-05|2026-03-10|22000
MO-2026-008|Low|Completed|WT-TIN-04|2026-03-15|950
MO-2026-009|Medium|Completed|SI-CRE-01|2026-03-18|1500
MO-2026-010|High|Completed|WT-THR-01|2026-03-25|35000
MO-2026-011|Medium|Completed|WT-NAX-03|2026-04-01|4200
MO-2026-012|Medium|In Progress|SI-THE-07||3500
MO-2026-013|Low|Scheduled|WT-TIN-01||1200
MO-2026-014|Medium|Scheduled|SI-CRE-06||2800
MO-2026-015|Critical|Open|WT-NAX-07||0
"""
LEDGER = """
EM-2026-01-LAV|PP-LAV-01|2026-01|18500|20000|92.5
EM-2026-01-MEG|PP-MEG-01|2026-01|9800|11000|89.1
EM-2026-02-LAV|PP-LAV-01|2026-02|17200|20000|86.0
EM-2026-02-MEG|PP-MEG-01|2026-02|10100|11000|91.8
EM-2026-03-LAV|PP-LAV-01|2026-03|19800|20000|99.0
EM-2026-03-MEG|PP-MEG-01|2026-03|10500|11000|95.5
EM-2026-04-LAV|PP-LAV-01|2026-04|8900|20000|44.5
EM-2026-04-MEG|PP-MEG-01|2026-04|4200|11000|38.2
"""


def _rows(text: str) -> list[list[str | None]]:
    return [[c or None for c in line.split("|")] for line in text.strip().splitlines()]


def _frame(spark, schema, dicts):
    return spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in dicts], schema)


def _plant_of(asset: str) -> str:
    return f"PP-{asset.split('-')[1]}-01"


def turbines():
    for site, n, cap, maker in (("THR", 8, 4.2, "Vestas"), ("TIN", 5, 3.4, "Siemens Gamesa"), ("NAX", 7, 4.2, "Enercon")):
        for i in range(1, n + 1):
            yield {
                "turbine_id": f"WT-{site}-{i:02d}", "turbine_name": f"{site} {i}", "plant_id": f"PP-{site}-01", "manufacturer": maker, "capacity_mw": cap,
                "cut_in_speed_ms": 3.0, "rated_speed_ms": 12.0, "cut_out_speed_ms": 25.0, "latitude": 37.07, "longitude": 25.47, "status": "Active",
            }


def inverters():
    for site, n, kw in (("THE", 8, 10000.0), ("CRE", 7, 8570.0)):
        for i in range(1, n + 1):
            yield {
                "inverter_id": f"SI-{site}-{i:02d}", "inverter_name": f"{site} {i}", "plant_id": f"PP-{site}-01", "manufacturer": "SMA", "capacity_kw": kw,
                "panel_type": "Bifacial", "latitude": 35.33, "longitude": 25.14, "status": "Active",
            }


def reference_tables(spark) -> dict:
    plants = [
        dict(zip(("plant_id", "plant_name", "plant_type", "fuel_type", "capacity_mw", "region", "prefecture", "grid_zone"), r)) | {"capacity_mw": float(r[4]), "status": "Active", "latitude": 37.5, "longitude": 24.0}
        for r in _rows(PLANTS)
    ]
    grids = [dict(zip(("grid_id", "grid_name", "island", "region"), r)) | {"nominal_frequency_hz": 50.0, "installed_capacity_mw": 100.0} for r in _rows(GRIDS)]
    stations = [
        {"substation_id": r[0], "substation_name": r[1], "voltage_kv": float(r[2]), "connected_grid_id": r[3], "fed_by_plant_id": r[4], "status": "Active"}
        for r in _rows(SUBSTATIONS)
    ]
    ships = [dict(zip(("vessel_id", "vessel_name", "vessel_type", "flag", "supply_plant_id"), r)) for r in _rows(VESSELS)]
    orders = [
        {
            "order_id": r[0], "priority": r[1], "status": r[2], "asset_id": r[3], "plant_id": _plant_of(r[3]),
            "completed_date": date.fromisoformat(r[4]) if r[4] else None, "cost_eur": float(r[5]), "created_date": date(2026, 1, 1),
        }
        for r in _rows(ORDERS)
    ]
    ledger = [
        {
            "record_id": r[0], "plant_id": r[1], "period": r[2], "co2_tonnes": float(r[3]), "ets_allowance_tonnes": float(r[4]),
            "compliance_pct": float(r[5]), "emission_factor_tco2_per_mwh": 0.35,
        }
        for r in _rows(LEDGER)
    ]
    content = {
        "power_plants": plants, "wind_turbines": list(turbines()), "solar_inverters": list(inverters()), "substations": stations, "island_grids": grids,
        "vessels": ships, "maintenance_orders": orders, "emissions_ledger": ledger,
    }
    return {name: _frame(spark, REFERENCE[name], rows) for name, rows in content.items()}


def feed(spark, name: str, *rows: dict):
    """Telemetry rows of one feed; ``ago`` is seconds before NOW."""
    f = FEEDS[name]
    full = [{"stream_type": f.stream_type, **({"timestamp": NOW - timedelta(seconds=r["ago"])} if r.get("ago") is not None else {}), **r} for r in rows]
    return _frame(spark, f.schema, full)


def tables(spark, **feeds) -> dict:
    out = reference_tables(spark)
    for name in FEEDS:
        out[name] = feed(spark, name, *feeds.get(name, ()))
    return out
