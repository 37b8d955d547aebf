"""String predicates and label rules with the query language's null behaviour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fault labels the telemetry carries.
NO_FAULT = "NONE"
FORCED_FAILURE = "DEMO_FORCED_FAILURE"
FAULT_TAXONOMY = {
    "bearing_degradation": ("mechanical", "CRITICAL"),
    "vibration_spike": ("mechanical", "WARNING"),
    "panel_soiling_or_string_fault": ("electrical", "WARNING"),
    "combustion_inefficient": ("thermal", "WARNING"),
    "DEMO_FORCED_FAILURE": ("outage", "OFFLINE"),
}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_empty(col: str | Column) -> Column:
    c = _c(col)
    return c.isNull() | (c == "")


def differs(col: str | Column, value: str) -> Column:
    """Inequality where an absent string counts as the empty string."""
    return F.coalesce(_c(col), F.lit("")) != value


def starts_with(col: str | Column, prefix: str) -> Column:
    """Prefix test that ignores case."""
    return F.lower(_c(col).cast("string")).startswith(prefix.lower())


def by_prefix(col: str | Column, labels: Mapping[str, str], otherwise: str) -> Column:
    """First label whose prefix matches, else ``otherwise``."""
    out: Column | None = None
    for prefix, label in labels.items():
        hit = starts_with(col, prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def fault_label(col: str | Column) -> Column:
    """Fault label with 'no fault' in one form: NULL."""
    return F.nullif(F.nullif(_c(col), F.lit(NO_FAULT)), F.lit(""))


def _taxonomy(col: str | Column, taxonomy: Mapping[str, Sequence[str]], part: int) -> Column:
    pairs = [F.lit(x) for k, v in taxonomy.items() for x in (k, v[part])]
    return F.try_element_at(F.create_map(*pairs), fault_label(col))


def fault_category(col: str | Column, taxonomy: Mapping[str, Sequence[str]] = FAULT_TAXONOMY) -> Column:
    return _taxonomy(col, taxonomy, 0)


def fault_severity(col: str | Column, taxonomy: Mapping[str, Sequence[str]] = FAULT_TAXONOMY) -> Column:
    return _taxonomy(col, taxonomy, 1)
