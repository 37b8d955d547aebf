"""Emission roll-ups: the ledger by plant and month, and live rates integrated over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import seconds_between
from meltemi.functions.numbers import share
from meltemi.operators.order import previous_row

NEAR_LIMIT_PCT = 95.0
DAILY_PCT_CAP = 150.0


def compliance_status(pct: str | Column) -> Column:
    c = F.col(pct) if isinstance(pct, str) else pct
    return F.when(c >= NEAR_LIMIT_PCT, "Near Limit").when(c.isNotNull(), "Compliant")


def ledger_rollup(ledger: DataFrame, *, factor: float = 0.35) -> DataFrame:
    """Per plant and month: CO2, allowance, compliance and the fuel the CO2 implies."""
    grouped = ledger.groupBy("plant_id", "period").agg(F.sum("co2_tonnes").alias("co2_tonnes"), F.sum("ets_allowance_tonnes").alias("allowance_tonnes"))
    pct = share(F.col("co2_tonnes"), F.col("allowance_tonnes"))
    return grouped.select(
        "plant_id",
        "period",
        "co2_tonnes",
        "allowance_tonnes",
        pct.alias("compliance_pct"),
        compliance_status(pct).alias("compliance_status"),
        (F.col("co2_tonnes") / F.lit(factor)).alias("fuel_mwh"),
    )


def integrated_emissions(stream: DataFrame, *, ts: str = "timestamp", tiebreak: Sequence[str] = (), rate: str = "co2_kg_per_hour") -> DataFrame:
    """Tonnes per plant and month: every reported rate holds until the plant's next report."""
    linked = previous_row(stream.select("plant_id", ts, *tiebreak, rate), "plant_id", [ts, *tiebreak], [rate])
    held = linked.where(F.col(f"prev_{ts}").isNotNull())
    hours = seconds_between(ts, f"prev_{ts}") / F.lit(3600.0)
    return held.groupBy("plant_id", F.date_format(f"prev_{ts}", "yyyy-MM").alias("period")).agg(
        (F.sum(F.col(f"prev_{rate}") * hours) / F.lit(1000.0)).alias("co2_tonnes"), F.sum(hours).alias("hours")
    )


def daily_compliance(stream: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """Per plant and day: share of the daily allowance used by the day's highest running total, capped."""
    grouped = stream.groupBy("plant_id", F.to_date(ts).alias("day")).agg(
        F.max("cumulative_co2_tonnes_today").alias("co2_tonnes"), F.max("ets_daily_allowance_tonnes").alias("allowance_tonnes")
    )
    pct = share(F.col("co2_tonnes"), F.col("allowance_tonnes"))
    return grouped.withColumn("compliance_pct", F.least(pct, F.lit(DAILY_PCT_CAP)))
