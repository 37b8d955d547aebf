"""Latest row per key, newest row overall, distinct keys, conditional counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def fixed_width(kind: T.DataType) -> bool:
    """Whether a hash aggregate can hold a value of this type in place."""
    return isinstance(kind, _FIXED_WIDTH)


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def latest(
    df: DataFrame,
    keys: str | Sequence[str],
    *,
    ts: str = "timestamp",
    cols: Sequence[str] | None = None,
    tiebreak: str | Sequence[str] = (),
    unique_ts: bool = False,
) -> DataFrame:
    """One row per key: the one with the greatest ``ts``. Rows without a time never win.

    Only ``cols`` are carried, so the scan reads no more. Equal times are settled by
    ``tiebreak`` and then by the carried values, which makes the answer repeatable.

    ``unique_ts`` says that a key has at most one distinct row per instant (an asset reports
    once a tick; a redelivered copy is the same row). Columns of fixed width then aggregate
    in a hash table rather than by sorting, about three times faster; others keep the sort.
    Either way a partial result per key and task is all that is shuffled.
    """
    keys = as_list(keys)
    carried = [c for c in (cols if cols is not None else df.columns) if c not in keys and c != ts]
    rows = df.where(F.col(ts).isNotNull())
    types = {f.name: f.dataType for f in df.schema.fields}
    if unique_ts and all(fixed_width(types[c]) for c in carried):
        return rows.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in carried])
    lead = [ts, *[c for c in as_list(tiebreak) if c not in keys]]
    rest = [c for c in carried if c not in lead]
    won = rows.groupBy(*keys).agg(F.max(F.struct(*lead, *rest)).alias("_w"))
    return won.select(*keys, F.col(f"_w.{ts}").alias(ts), *[F.col(f"_w.{c}").alias(c) for c in carried])


def newest(df: DataFrame, *, ts: str = "timestamp", tiebreak: str | Sequence[str] = (), n: int = 1) -> DataFrame:
    """The ``n`` newest rows; each task keeps its own top ``n``, nothing is fully sorted."""
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in as_list(tiebreak)]).limit(n)


def distinct_keys(df: DataFrame, key: str, *, name: str = "n", approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct keys: exact, or a bounded sketch when asked for."""
    counted = F.approx_count_distinct(key, rsd) if approximate else F.count_distinct(key)
    return df.agg(counted.alias(name))
