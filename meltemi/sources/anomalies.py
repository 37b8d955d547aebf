"""The table of anomaly events: one copy of every detector run, published when someone says so."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.sources import files

_COLUMNS = [
    T.StructField("entity_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
]
_PLACES = [T.StructField("detector", T.StringType()), T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("event_date", T.DateType())]


@dataclass(frozen=True)
class AnomalyTable:
    """Events by detector, run and date below ``path``, and a manifest that names each run's live attempt and whether it is published.

    A run is written whole under an attempt of its own and takes effect when the manifest is swapped, so a rerun, with more, fewer or other dates, replaces what the run wrote before, and a run that dies
    leaves nothing behind that readers see. Publishing changes the manifest and no rows; a rerun of a published run stays published. One writer at a time.
    """

    path: str

    def _at(self, detector: str, run: str, attempt: str) -> str:
        return f"{self.path}/data/detector={detector}/run={run}/attempt={attempt}"

    def _state(self, spark: SparkSession) -> dict[str, dict[str, Any]]:
        return json.loads(files.read(spark, f"{self.path}/runs.json")) if "runs.json" in files.names(spark, self.path) else {}

    def _swap(self, spark: SparkSession, state: dict[str, dict[str, Any]]) -> None:
        files.write(spark, f"{self.path}/runs.json", json.dumps(state, sort_keys=True))

    def write(self, events: DataFrame, detector: str, run: str, *, publish: bool = False) -> None:
        """Put a run's events in place of what the same run wrote before."""
        spark, attempt = events.sparkSession, uuid.uuid4().hex[:12]
        rows = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _COLUMNS], "event_date")
        rows.write.partitionBy("event_date").parquet(self._at(detector, run, attempt))
        state = self._state(spark)
        before = state.get(f"{detector}/{run}")
        state[f"{detector}/{run}"] = {"detector": detector, "run": run, "attempt": attempt, "published": publish or bool(before and before["published"])}
        self._swap(spark, state)
        if before:
            files.remove(spark, self._at(detector, run, before["attempt"]))

    def publish(self, spark: SparkSession, detector: str, run: str) -> None:
        state = self._state(spark)
        state[f"{detector}/{run}"]["published"] = True
        self._swap(spark, state)

    def read(self, spark: SparkSession, *, published: bool | None = None) -> DataFrame:
        """entity, time, value, score, baseline, ``detector``, ``run``, ``published``, ``event_date`` of all runs, or of those that are published (or not). A filter on dates, detectors or runs skips the other folders."""
        runs = [r for r in self._state(spark).values() if published is None or r["published"] == published]
        # A run without events has no dates below it.
        paths = [p for r in runs for p in [self._at(r["detector"], r["run"], r["attempt"])] if any(n.startswith("event_date=") for n in files.names(spark, p))]
        schema = T.StructType([*_COLUMNS, *_PLACES])
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths) if paths else spark.createDataFrame([], schema)
        flags = spark.createDataFrame([(r["detector"], r["run"], r["published"]) for r in runs], "detector string, run string, published boolean")
        return rows.join(flags, ["detector", "run"]).select(*[f.name for f in _COLUMNS], "detector", "run", "published", "event_date")
