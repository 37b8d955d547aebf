"""Business terms: the words operators use, as predicates over entity columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exact, case-sensitive enumerations per entity property.
_REGIONS = ("Attica", "Crete", "Eastern Macedonia and Thrace", "Peloponnese", "South Aegean", "Thessaly")
ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "PowerPlant": {
        "plant_type": ("Wind Farm", "Solar Park", "Gas Power Plant"),
        "fuel_type": ("Wind", "Solar", "Natural Gas"),
        "region": _REGIONS,
        "prefecture": ("Arcadia", "Cyclades", "East Attica", "Evros", "Heraklion", "Larissa"),
        "status": ("Active",),
    },
    "WindTurbine": {
        "manufacturer": ("Enercon", "Siemens Gamesa", "Vestas"),
        "model": ("E-138 EP3", "SG 3.4-132", "V150-4.2"),
        "status": ("Active",),
    },
    "SolarInverter": {
        "manufacturer": ("Huawei", "SMA"),
        "model": ("SUN2000-330KTL", "Sunny Central 2750-EV"),
        "panel_type": ("Bifacial", "Monocrystalline"),
        "status": ("Active",),
    },
    "Grid": {
        "island": ("Crete", "Mainland", "Mykonos", "Naxos", "Syros", "Tinos"),
        "region": ("Attica", "Crete", "South Aegean"),
    },
    "Vessel": {
        "vessel_type": ("Crew Transfer Vessel", "LNG Carrier"),
        "flag": ("Greece", "Malta"),
        "origin_country": ("Algeria", "Egypt", "Greece"),
        "live_status": ("Dispatched", "En Route", "Sailing", "Loading", "Docked"),
    },
    "Substation": {
        "substation_type": ("High Voltage Transmission", "Island Distribution", "Island Hub", "Onshore Transmission"),
        "region": _REGIONS,
        "status": ("Active",),
    },
    "MaintenanceOrder": {
        "order_type": ("Corrective", "Inspection", "Preventive"),
        "priority": ("Critical", "High", "Medium", "Low"),
        "status": ("Open", "Scheduled", "In Progress", "Completed"),
        "asset_type": ("SolarInverter", "WindTurbine"),
    },
    "EmissionsRecord": {"compliance_status": ("Compliant", "Near Limit")},
}

_OPERATING = ("status", ("Active",))
_RENEWABLE = ("plant_type", ("Wind Farm", "Solar Park"))
_FOSSIL = ("plant_type", ("Gas Power Plant",))
_OPEN_ORDER = ("status", ("Open", "Scheduled", "In Progress"))
_SAILING = ("status", ("Dispatched", "En Route", "Sailing", "Loading"))

# Synonym -> (property, admissible values).
TERMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "operating": _OPERATING,
    "running": _OPERATING,
    "in service": _OPERATING,
    "renewables": _RENEWABLE,
    "clean": _RENEWABLE,
    "green": _RENEWABLE,
    "fossil": _FOSSIL,
    "conventional": _FOSSIL,
    "thermal": _FOSSIL,
    "wind farm": ("plant_type", ("Wind Farm",)),
    "solar park": ("plant_type", ("Solar Park",)),
    "pv plant": ("plant_type", ("Solar Park",)),
    "open mo": _OPEN_ORDER,
    "open work order": _OPEN_ORDER,
    "dispatched": _SAILING,
    "en route": _SAILING,
    "in transit": _SAILING,
    "sailing": _SAILING,
}


def term(name: str, terms: Mapping[str, tuple[str, Sequence[str]]] = TERMS) -> Column:
    """Predicate for a business term; the values are matched exactly."""
    prop, values = terms[name.lower()]
    return F.col(prop).isin(*values)


def apply_term(df: DataFrame, name: str, terms: Mapping[str, tuple[str, Sequence[str]]] = TERMS) -> DataFrame:
    return df.where(term(name, terms))


def unknown_values(df: DataFrame, entity: str, enums: Mapping[str, Mapping[str, Sequence[str]]] = ENUMS) -> DataFrame:
    """(property, value, n): values outside the enumerations of an entity, found in one pass over its rows."""
    props = {p: values for p, values in enums[entity].items() if p in df.columns}
    cells = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in props])
    rows = df.select(F.inline(cells))
    known = F.lit(False)
    for p, values in props.items():
        known = known | ((F.col("property") == p) & F.col("value").isin(*values))
    return rows.where(F.col("value").isNotNull() & ~known).groupBy("property", "value").agg(F.count("*").alias("n"))


def under_way(speed: str = "speed_knots", eta: str = "eta_hours") -> Column:
    """En route by live channels, for feeds whose status text describes the cargo instead."""
    return (F.col(speed) > 0) & (F.col(eta) > 0)
