"""The preceding row of the same key in event-time order, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.clock import micros
from meltemi.operators.latest import as_list, fixed_width


def with_time_slice(rows: DataFrame, ts: str, slices: int, *, times: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_slice``: the number of the time slice, of ``slices`` that hold about the same number of rows.

    Borders are approximate quantiles of the time column (of ``times``, if given), so neither a burst nor a single wrong time changes how evenly rows are dealt. They
    are a scalar subquery of the same plan: nothing is looked up beforehand. Two short searches find a row's place among them.
    """
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return rows.withColumn("_slice", F.lit(0))
    quantiles = F.percentile_approx(micros(ts), shares, max(10_000, 20 * slices))
    source = rows if times is None else times
    step, at = isqrt(len(shares)), F.col("_at")
    # The last border of each run of ``step`` tells the run, the borders inside it the place.
    ends = F.array(*[F.get("_borders", F.lit(i)) for i in range(step - 1, len(shares), step)])
    below = lambda borders: F.size(F.filter(borders, lambda b: b <= at))
    placed = rows.withColumn("_at", micros(ts)).withColumn("_borders", source.agg(quantiles.alias("borders")).scalar())
    placed = placed.withColumn("_run", below(ends) * step)
    return placed.withColumn("_slice", F.col("_run") + below(F.slice("_borders", F.col("_run") + 1, F.lit(step)))).drop("_at", "_borders", "_run")


def previous_row(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    cols: Sequence[str],
    *,
    prefix: str = "prev_",
    slices: int | None = None,
    unique_ts: bool = False,
    times: DataFrame | None = None,
) -> DataFrame:
    """Every row with ``cols`` and the order columns of the row before it, as ``prev_*`` (NULL at the first).

    ``order`` starts with the event time; further columns settle ties. Rows are split by (key, time slice): the last row of each slice, found by
    partial aggregation, is handed to the key's next slice as a carried row, and the window that links slices sees one row per slice only. A key that has a
    third of all rows, or all of them, is so many tasks. The way is the same for every size.

    ``slices`` is their number, by default that of the shuffle partitions. ``times`` may name another table whose time column has the same
    spread and is cheaper to read. ``unique_ts`` says that a key has one row per instant, which lets fixed-width columns be carried by a hash aggregate. Rows
    of one instant stay in one slice.
    """
    keys, order = as_list(keys), as_list(order)
    ts = order[0]
    kept = list(dict.fromkeys([*order, *cols]))
    rows = df.where(F.col(ts).isNotNull())
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_time_slice(rows, ts, n, times=times)
    types = {f.name: f.dataType for f in df.schema.fields}
    if kept == [ts] or (unique_ts and all(fixed_width(types[c]) for c in kept)):
        carry = [F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in kept[1:]]]
        last = rows.groupBy(*keys, "_slice").agg(*carry).select(*keys, "_slice", F.struct(*kept).alias("_last"))
    else:
        last = rows.groupBy(*keys, "_slice").agg(F.max(F.struct(*kept)).alias("_last"))
    links = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(*keys, "_slice", F.lag("_last").over(links).alias("_last")).where(F.col("_last").isNotNull())
    carried = carried.select(*keys, "_slice", *[F.col(f"_last.{c}").alias(c) for c in kept if c not in keys], F.lit(0).alias("_own"))

    both = rows.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_slice").orderBy("_own", *kept)
    out = both.select("*", *[F.lag(c).over(within).alias(f"{prefix}{c}") for c in kept]).where(F.col("_own") == 1)
    return out.select(*df.columns, *[f"{prefix}{c}" for c in kept])
