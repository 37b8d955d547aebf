"""Event-time lookback and time buckets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lookbacks and bucket widths the dashboard uses, by label.
LIVE_SPANS = {
    "30s": "30 seconds",
    "60s": "60 seconds",
    "2m": "2 minutes",
    "3m": "3 minutes",
    "5m": "5 minutes",
    "10m": "10 minutes",
    "15m": "15 minutes",
    "20m": "20 minutes",
    "bin5s": "5 seconds",
    "bin10s": "10 seconds",
    "bin30s": "30 seconds",
}


class Clock:
    """The instant a query is evaluated at, and the width of each named span."""

    def __init__(self, as_of: Column | Callable[[], Column], spans: Mapping[str, str] | None = None):
        self._as_of = as_of
        self.spans = dict(spans or LIVE_SPANS)

    @cached_property
    def as_of(self) -> Column:
        return self._as_of if isinstance(self._as_of, Column) else self._as_of()

    @classmethod
    def live(cls) -> "Clock":
        return cls(F.lit(datetime.now(timezone.utc)))

    @classmethod
    def at_newest(
        cls,
        df: DataFrame,
        ts: str = "timestamp",
        spans: Mapping[str, str] | None = None,
        *,
        day: str = "event_date",
        pinned: bool = True,
    ) -> "Clock":
        """Evaluate at the newest event time of ``df``, read when first needed.

        ``pinned`` looks the one value up and makes it a literal, as a live clock's is: row groups are skipped by
        it, and the branches of a query that read the same events share one shuffle. Otherwise it stays a
        scalar subquery of the query, which also reaches the scan but keeps Spark from sharing those shuffles.
        A table partitioned by date is read in its newest partition only.
        """
        if day in df.columns:
            df = df.where(F.col(day) == df.agg(F.max(day)).scalar())
        if not pinned:
            return cls(df.agg(F.max(ts)).scalar(), spans)
        kind = df.schema[ts].dataType

        def look_up() -> Column:
            newest = df.agg(F.max(ts).cast("string").alias("t")).first()
            return F.lit(newest["t"]).cast(kind)

        return cls(look_up, spans)

    def back(self, span: str) -> Column:
        return self.as_of - F.expr(f"INTERVAL {self.spans[span]}")

    def width(self, span: str) -> str:
        return self.spans[span]


def within(df: DataFrame, clock: Clock, span: str, *, ts: str = "timestamp", day: str = "event_date") -> DataFrame:
    """Rows strictly newer than ``as_of - span``; prunes date partitions where the table has them."""
    bound = clock.back(span)
    if day in df.columns:
        df = df.where(F.col(day) >= F.to_date(bound))
    return df.where(F.col(ts) > bound)


def bucket(ts: str | Column, width: str) -> Column:
    """Start of the epoch-aligned bucket holding ``ts``."""
    return F.window(F.col(ts) if isinstance(ts, str) else ts, width).getField("start")


def micros(ts: str | Column) -> Column:
    """Event time as integer microseconds, for arithmetic between two instants."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)
