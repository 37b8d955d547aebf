"""Change alerts over a stream in Spark's keyed state: a micro-batch touches the objects that it has rows or due times for, and the rows that wait beside theirs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from meltemi.functions.clock import micros
from meltemi.operators.latest import as_list
from meltemi.streaming.ingest import started

#: The state store that keyed state needs; set it on the session before the query starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows wait in blocks, each one value of the state: (object, time, tiebreak, verdict, and where that is true the row).
_HELD = pa.schema([("object", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("on_", pa.bool_()), ("row", pa.string())])


class _Changes(StatefulProcessor):
    """Per bucket of objects: the blocks of rows that the watermark has not passed, and by object the verdict of its last released row."""

    def __init__(self, fire_on_first: bool) -> None:
        self.fire_on_first = fire_on_first

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "object string", "on_ boolean")
        self.held = handle.getListState("held", "rows binary")

    def _hold(self, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as stream:
            stream.write_table(rows)
        self.held.appendValue((sink.getvalue().to_pybytes(),))

    def _wake(self, at: int) -> None:
        """One timer for the earliest of the rows; when it goes off, the next one is set for what still waits."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            if len(batch):
                self._hold(pa.Table.from_pandas(batch[_HELD.names], schema=_HELD, preserve_index=False))
                least = int(batch["at"].min())
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake(earliest)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [pa.ipc.open_stream(bytes(b[0])).read_all() for b in self.held.get()]
        rows = pa.concat_tables([_HELD.empty_table(), *blocks])
        due = rows["at"].to_numpy() <= upto
        if not due.any():
            return iter([])
        ready = rows.filter(pa.array(due))
        names = ready["object"].combine_chunks().dictionary_encode()
        of, on = names.indices.to_numpy(), ready["on_"].to_numpy(zero_copy_only=False)
        order = np.lexsort((ready["tie"].to_numpy(), ready["at"].to_numpy(), of))
        of, on = of[order], on[order]
        first = np.append(True, of[1:] != of[:-1])
        was, known = np.append(False, on[:-1]), []
        for name in names.dictionary.to_pylist():
            seen = self.last.getValue((name,))
            known.append(None if seen is None else bool(seen[0]))
        was[first] = [not self.fire_on_first if k is None else k for k in known]
        for name, before, now in zip(names.dictionary.to_pylist(), known, on[np.append(first[1:], True)].tolist()):
            if now is not before:
                self.last.updateValue((name,), (now,))
        fired = ready["row"].take(pa.array(order[on & ~was]))
        self.held.clear()
        if not due.all():
            waiting = rows.filter(pa.array(~due))
            self._hold(waiting)
            self._wake(int(waiting["at"].to_numpy().min()))
        return iter([pd.DataFrame({"row": fired.to_pylist()})]) if len(fired) else iter([])

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class KeyedAlerts:
    """Alert when ``condition`` becomes true for an object identified by ``keys``: the stream form of :func:`meltemi.operators.alerts.becomes`.

    Rows wait in their bucket's state until the watermark passes them; a timer at the earliest one's time then releases them, object by object, in (time, ``tiebreak``) order, so any split into micro-batches and any order within
    the delay gives the batch answer. What comes behind the watermark is dropped and counted by Spark. State is a boolean per object and the waiting rows; only objects with new rows or due timers
    are read or written, so silent ones cost a batch nothing. Objects share ``buckets`` timers and lists of waiting rows by a hash, so a batch costs calls by the bucket and array work by the row; the number stays as it is
    for the life of a checkpoint. A bucket's rows of one batch meet in one task: more buckets make them fewer, and where one object has so many that this hurts, :class:`meltemi.streaming.alerts.ChangeAlerts` splits it by time instead.
    """

    keys: Sequence[str] | str
    condition: Column
    ts: str = "timestamp"
    tiebreak: str | None = None
    delay: str = "1 minute"
    fire_on_first: bool = False
    buckets: int = 1_024

    def alerts(self, events: DataFrame) -> DataFrame:
        """The rows of ``events`` at which the condition turns true, as a stream in append mode."""
        keys = as_list(self.keys)
        spark = events.sparkSession
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
        rows = events.where(F.col(self.ts).isNotNull()).withWatermark(self.ts, self.delay)
        tie = F.col(self.tiebreak).cast("bigint") if self.tiebreak else F.lit(0).cast("bigint")
        # Objects go by one text that is never null: a null among whole-number keys would turn its whole batch into other keys.
        named, on = F.to_json(F.struct(*keys)), F.coalesce(self.condition, F.lit(False))
        told = rows.select(
            F.pmod(F.xxhash64(named), F.lit(self.buckets)).alias("bucket"),
            named.alias("object"),
            self.ts,
            micros(self.ts).alias("at"),
            F.coalesce(tie, F.lit(0)).alias("tie"),
            on.alias("on_"),
            F.when(on, F.to_json(F.struct(*[F.col(c) for c in events.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})).alias("row"),
        )
        fired = told.groupBy("bucket").transformWithStateInPandas(_Changes(self.fire_on_first), "row string", "Append", "EventTime")
        back = F.from_json("row", events.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        return fired.select(back.alias("r")).select("r.*")

    def start(self, events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        """Append alerts below ``path``."""
        return started(self.alerts(events).writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, available_now=available_now)


def with_end(events: DataFrame, folder: str, *, ts: str = "timestamp", at: str = "2200-01-01") -> DataFrame:
    """A bounded stream followed by one row of a far time and no object, which moves the watermark past all others, so that nothing stays waiting."""
    spark: SparkSession = events.sparkSession
    spark.createDataFrame([(at,)], "t string").select(*[(F.to_timestamp("t") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.parquet(folder)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields])
    return events.unionByName(spark.readStream.schema(schema).parquet(folder))
