"""Time buckets, gap-free series, and decomposition into baseline and anomalies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.clock import bucket, micros
from meltemi.operators.latest import as_list
from meltemi.operators.order import previous_row
from meltemi.operators.quantiles import exact_quantiles

_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: Steps of a gap that one row holds before they become rows.
_STEPS_PER_BLOCK = 10_000


def width_us(width: str) -> int:
    """Microseconds of a width such as '5 seconds' or '6 hours'."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", width.lower()).groups()
    return int(number) * _UNIT_US[unit]


def bucketed(df: DataFrame, width: str, aggs: Mapping[str, Column], *, keys: Sequence[str] = (), ts: str = "timestamp", out: str = "timestamp") -> DataFrame:
    """Aggregates per epoch-aligned time bucket and key; partial sums leave each task, not rows."""
    rows = df.where(F.col(ts).isNotNull())
    return rows.groupBy(bucket(ts, width).alias(out), *keys).agg(*[c.alias(n) for n, c in aggs.items()])


def per_entity_bucketed(df: DataFrame, width: str, value: str, entity: str, *, keys: Sequence[str] = (), ts: str = "timestamp", out: str = "timestamp") -> DataFrame:
    """Sum over entities of each entity's mean in the bucket: the power of a fleet whatever its sampling rate."""
    each = bucketed(df, width, {"_mean": F.avg(value)}, keys=[*keys, entity], ts=ts, out=out)
    return each.groupBy(out, *keys).agg(F.sum("_mean").alias(value))


def make_series(
    df: DataFrame,
    keys: str | Sequence[str],
    step: str,
    value: Column,
    *,
    ts: str = "timestamp",
    name: str = "value",
    fill: str = "default",
    default: float = 0.0,
    slices: int | None = None,
) -> DataFrame:
    """A row for every step from a key's first bucket to its last: keys, ``ts``, ``name``, ``filled``.

    Empty steps get ``default`` (0, the query language's rule), or with ``fill`` 'null',
    'ffill' (last value carried on) or 'linear'. Each bucket emits the gap before it, so
    filling needs the preceding bucket only and no second pass over a calendar. A long gap is cut in blocks
    that are dealt over the tasks before their steps become rows. ``slices``: see :func:`previous_row`.
    """
    keys = as_list(keys)
    step_us = width_us(step)
    bins = bucketed(df, step, {name: value}, keys=keys, ts=ts, out=ts)
    linked = previous_row(bins, keys, ts, [name], unique_ts=True, slices=slices, times=df)
    start = F.coalesce(F.col(f"prev_{ts}") + F.expr(f"INTERVAL {step}"), F.col(ts))
    many = F.floor((micros(ts) - micros("_start")) / F.lit(step_us * _STEPS_PER_BLOCK)).cast("int")
    blocks = linked.withColumn("_start", start).withColumn("_block", F.explode(F.sequence(F.lit(0), many)))
    dealt = blocks.repartition(*[F.col(k) for k in keys], F.col(ts), F.col("_block"))
    wide = width_us(step) * _STEPS_PER_BLOCK
    first = F.col("_start") + F.make_dt_interval(secs=F.col("_block") * F.lit(wide / 1e6))
    last = F.least(F.col(ts), first + F.expr(f"INTERVAL {(wide - step_us) // 1_000_000} SECOND"))
    slots = dealt.withColumn("_slot", F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}"))))
    filled = F.col("_slot") != F.col(ts)
    before, after = F.col(f"prev_{name}"), F.col(name)
    along = (micros("_slot") - micros(f"prev_{ts}")) / (micros(ts) - micros(f"prev_{ts}"))
    gap = {
        "default": F.lit(default),
        "null": F.lit(None).cast("double"),
        "ffill": before,
        "linear": before + (after - before) * along,
    }[fill]
    return slots.select(*keys, F.col("_slot").alias(ts), F.when(filled, gap).otherwise(after).alias(name), filled.alias("filled"))


def step_index(ts: str, step: str) -> Column:
    """Number of the step a bucket starts, counted from the epoch: neighbours differ by one, and no series start is needed."""
    return F.floor(micros(ts) / F.lit(width_us(step))).cast("bigint")


def detect_period(series: DataFrame, keys: str | Sequence[str], step: str, lags: Sequence[int], *, ts: str = "timestamp", value: str = "value", minimum: float = 0.6) -> DataFrame:
    """keys, ``period``, ``strength``: the lag with the highest autocorrelation above ``minimum``, else NULL.

    Each step is paired with one other step per lag, by equality on (key, index).
    """
    keys = as_list(keys)
    mean = series.groupBy(*keys).agg(F.avg(value).alias("_m"))
    dev = series.join(mean, keys).select(*keys, step_index(ts, step).alias("idx"), (F.col(value) - F.col("_m")).alias("_d"))
    power = dev.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_p"))
    shifted = dev.select(*keys, F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("lag"), "idx", F.col("_d").alias("_e"))
    shifted = shifted.withColumn("idx", F.col("idx") + F.col("lag"))
    pairs = shifted.join(dev, [*keys, "idx"]).groupBy(*keys, "lag").agg(F.sum(F.col("_d") * F.col("_e")).alias("_c"))
    scored = pairs.join(power, keys).withColumn("_r", F.when(F.col("_p") > 0, F.col("_c") / F.col("_p")))
    good = F.when(F.col("_r") > minimum, F.col("_r"))
    return scored.groupBy(*keys).agg(
        F.max_by("lag", F.struct(good, -F.col("lag"))).alias("_lag"), F.max(good).alias("strength")
    ).select(*keys, F.when(F.col("strength").isNotNull(), F.col("_lag")).alias("period"), "strength")


def decompose(
    series: DataFrame,
    keys: str | Sequence[str],
    step: str,
    *,
    threshold: float = 1.5,
    period: int | DataFrame | None = None,
    ts: str = "timestamp",
    value: str = "value",
    accuracy: int | None = None,
) -> DataFrame:
    """The series with ``baseline``, ``score`` and ``anomaly`` (-1, 0, 1).

    baseline = mean of the series + mean deviation of the step's phase when a period is given
    (a number, or one per key as from :func:`detect_period`). The score measures how far the residual lies
    outside its 10th to 90th percentile, in units of that range; ``|score| > threshold`` flags it.
    The percentiles are exact and hold no key's residuals together (:func:`exact_quantiles`); ``accuracy`` takes them from a sketch instead.
    """
    keys = as_list(keys)
    base = series.join(series.groupBy(*keys).agg(F.avg(value).alias("_mean")), keys)
    if period is None:
        base = base.withColumn("baseline", F.col("_mean"))
    else:
        if isinstance(period, DataFrame):
            base = base.join(period.select(*keys, F.col("period").alias("_period")), keys, "left")
        else:
            base = base.withColumn("_period", F.lit(int(period)))
        phase = F.pmod(step_index(ts, step), F.col("_period"))
        base = base.withColumn("_phase", F.when(F.col("_period").isNotNull(), phase).otherwise(F.lit(-1)))
        season = base.groupBy(*keys, "_phase").agg(F.avg(value).alias("_season"))
        base = base.join(season, [*keys, "_phase"]).withColumn("baseline", F.when(F.col("_phase") >= 0, F.col("_season")).otherwise(F.col("_mean")))
    base = base.withColumn("_r", F.col(value) - F.col("baseline"))
    # Of the residuals themselves: shifting percentiles of the values would differ in the last bits, and so flag ties otherwise.
    if accuracy is None:
        limits = exact_quantiles(base, keys, "_r", [0.1, 0.9], out=["_lo", "_hi"])
    else:
        sketched = base.groupBy(*keys).agg(F.percentile_approx("_r", [0.1, 0.9], accuracy).alias("_q"))
        limits = sketched.select(*keys, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    base = base.join(limits, keys)
    r, lo, hi = F.col("_r"), F.col("_lo"), F.col("_hi")
    score = F.when(hi == lo, F.lit(0.0)).when(r > hi, (r - hi) / (hi - lo)).when(r < lo, (r - lo) / (hi - lo)).otherwise(F.lit(0.0))
    scored = base.withColumn("score", score)
    # A score equal to the threshold but for rounding in the mean does not exceed it.
    flag = F.when(F.round(F.abs("score"), 9) > threshold, F.signum("score").cast("int")).otherwise(F.lit(0))
    return scored.select(*series.columns, "baseline", "score", flag.alias("anomaly"))
