"""Shared plumbing of the operators: batches of Arrow columns, checked broadcasts, memory of a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meltemi.session import settled

__all__ = ["REGISTRY_BYTES", "bounded_broadcast", "crc_bucket", "first_by_hash", "map_columns", "sliced", "settled"]

#: Most bytes of model or query data that an operator hands to every executor.
REGISTRY_BYTES = 64 << 20


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key's text form modulo ``modulus``: the fold of a row. A null key is in no fold (null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the ``n`` keys that come first by a hash: a bounded sample. Only keys are sorted, and at most n of them are broadcast."""
    keys = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(n).distinct()
    return df.join(F.broadcast(keys), key, "left_semi")


def sliced(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``max_bytes`` of the given text column; a longer single row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_columns(
    df: DataFrame, schema: str, work: Callable[..., Sequence[Any]], *, text: str | None = None, max_bytes: int = 4 << 20
) -> DataFrame:
    """``work(columns as Arrow arrays...)`` over bounded slices of every partition; it returns the columns of ``schema``."""
    types = pa.schema([(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text, max_bytes) if text else [batch]:
                if part.num_rows:
                    out = work(*part.columns)
                    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(out, types.types)]
                    yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types.types)], schema=types)

    return df.mapInArrow(run, schema)


def _arrow(kind: Any) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bounded_broadcast(spark: Any, value: Any, n_bytes: int, what: str) -> Any:
    """Broadcasts a value whose size was counted; refuses one beyond the bound instead of flooding the executors."""
    if n_bytes > REGISTRY_BYTES:
        raise ValueError(f"{what} takes {n_bytes} bytes; at most {REGISTRY_BYTES} are handed to every executor")
    return spark.sparkContext.broadcast(value)
