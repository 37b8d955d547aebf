"""Exact quantiles per key without gathering a key's values anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.operators.latest import as_list

#: Accuracy of the sketch that says where to look: ranks are right to within one part in so many.
ACCURACY = 2_000


def exact_quantiles(df: DataFrame, keys: str | Sequence[str], value: str, shares: Sequence[float], *, accuracy: int = ACCURACY, out: Sequence[str] | None = None) -> DataFrame:
    """keys and one column per share: the quantiles of ``value`` with linear interpolation, exact whatever the number of rows. NULLs do not count; a key without values has no row.

    A sketch of bounded size brackets each quantile. The borders cut a key's values into a few classes; how many rows each class has tells in which one a wanted rank lies. Only
    the rows of those classes, some hundredths of a percent of a long series, are brought into order, equal values as one row with a count. Where a sketch errs, a rank lies in a wider
    class and more rows are ordered: the answer is the same. No aggregate holds more than the sketch or a number, and a key with a third of all rows stays spread over
    the tasks until its classes have been picked.
    """
    keys = as_list(keys)
    names = list(out or [f"q{k}" for k in range(len(shares))])
    near = 2.0 / accuracy
    borders = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-near, near)})
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", borders, accuracy).alias("_b"), F.count("*").alias("_n"))
    # The class of a value: how many borders lie below it. Equal values share a class.
    placed = rows.join(sketch, keys).select(*keys, "_v", "_n", F.size(F.filter("_b", lambda b: b < F.col("_v"))).alias("_class"))
    counts = placed.groupBy(*keys, "_n", "_class").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    classes = counts.withColumn("_before", before)
    inside = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")))
    picked = classes.withColumn("_ranks", inside).where(F.size("_ranks") > 0).select(*keys, "_class", "_before", "_ranks")
    values = placed.select(*keys, "_class", "_v").join(picked, [*keys, "_class"]).groupBy(*keys, "_class", "_before", "_ranks", "_v").agg(F.count("*").alias("_times"))
    upto = F.col("_before") + F.sum("_times").over(Window.partitionBy(*keys, "_class").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumn("_upto", upto)
    hit = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_times")) & (r < F.col("_upto")))
    found = ranked.select(*keys, "_v", F.explode(hit).alias("_rank")).join(sketch.select(*keys, "_n"), keys)

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    ends = found.groupBy(*keys, "_n").agg(*[c for k, p in enumerate(places) for c in (at(F.floor(p)).alias(f"_lo{k}"), at(F.ceil(p)).alias(f"_hi{k}"))])
    between = [p - F.floor(p) for p in places]
    return ends.select(*keys, *[(F.col(f"_lo{k}") + w * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).alias(n) for k, (w, n) in enumerate(zip(between, names))])
