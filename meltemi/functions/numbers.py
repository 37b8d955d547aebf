"""Rounding, empty-safe totals and threshold buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded(col: str | Column, digits: int) -> Column:
    """Half-up rounding that is not swayed by the last bits of a floating-point sum."""
    return F.round(F.round(_c(col), 9), digits)


def total(col: str | Column) -> Column:
    """Sum that is 0 on empty input."""
    return F.coalesce(F.sum(_c(col)), F.lit(0.0))


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``scale * part / whole``; NULL when there is nothing to divide by."""
    return F.when(whole != 0, F.lit(scale) * part / whole)


def kw_to_mw(col: str | Column) -> Column:
    return _c(col) / F.lit(1000.0)


def above(col: str | Column, steps: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """Label of the first threshold strictly exceeded; ``steps`` run from high to low."""
    out: Column | None = None
    for limit, label in steps:
        hit = _c(col) > limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    assert out is not None
    return out if otherwise is None else out.otherwise(otherwise)


def rank_of(label: str | Column, order: Sequence[str]) -> Column:
    """Position of a label in ``order`` (lowest first), for comparing severities by meaning."""
    pairs = [F.lit(x) for i, name in enumerate(order) for x in (name, i)]
    return F.try_element_at(F.create_map(*pairs), _c(label))


def snapped(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns rounded and dates as midnight timestamps, so that results of two engines can be compared."""

    def cell(f: T.StructField) -> Column:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return rounded(col, digits).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return col.cast("timestamp_ntz").alias(f.name)
        return col

    return df.select(*[cell(f) for f in df.schema.fields])
