"""A streamed table as a few parts: micro-batches are published by a manifest and folded into larger parts while readers go on."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.sources import files
from meltemi.sources.store import DAY, with_day

PART = "part"


@dataclass(frozen=True)
class Part:
    """Rows of the micro-batches ``first`` to ``last``, written once and never changed. ``level`` says how often they were folded."""

    name: str
    level: int
    first: int
    last: int
    size: int


def due(parts: Sequence[Part], fan: int, levels: int) -> list[Part]:
    """The ``fan`` oldest parts of the lowest level that has so many; nothing if no level has, or only the highest."""
    for level in range(levels):
        there = sorted((p for p in parts if p.level == level), key=lambda p: p.first)
        if len(there) >= fan:
            return there[:fan]
    return []


@dataclass(frozen=True)
class PartTable:
    """An append-only table below ``path``, partitioned by day inside each part.

    A commit writes one part and a manifest that names all live parts; manifests appear by a rename, so a reader sees the whole batch or nothing of it. As soon as a level has
    ``fan`` parts they are folded into one of the next level, sorted by ``order`` and cut into files of some ``file_bytes``: a row is rewritten at most ``levels`` times, and a day has
    (fan - 1) * levels parts of recent batches beside one for every ``fan ** levels`` batches. Folded parts stay for readers of the last ``keep`` manifests. One writer at a time, as a
    stream's sink is; batch numbers ascend. A batch that is there already is not written again.
    """

    path: str
    schema: T.StructType
    order: tuple[str, ...] = ("timestamp",)
    ts: str = "timestamp"
    fan: int = 10
    levels: int = 4
    file_bytes: int = 256 << 20
    keep: int = 2_000

    def _manifest(self, generation: int) -> str:
        return f"{self.path}/manifest/{generation:012d}.json"

    def generations(self, spark: SparkSession) -> list[int]:
        """Numbers of the manifests, oldest first."""
        return sorted(int(n[:12]) for n in files.names(spark, f"{self.path}/manifest") if n.endswith(".json") and n[:12].isdigit())

    def live(self, spark: SparkSession, generation: int | None = None) -> list[Part]:
        """The parts that a manifest names: the newest one, or the one of a number."""
        if generation is None:
            there = self.generations(spark)
            if not there:
                return []
            generation = there[-1]
        return [Part(**p) for p in json.loads(files.read(spark, self._manifest(generation)))]

    def _rows(self, spark: SparkSession, parts: Sequence[Part]) -> DataFrame:
        stored = T.StructType([f for f in self.schema.fields if f.name != DAY])
        if not parts:
            return with_day(spark.createDataFrame([], stored), self.ts)
        whole = T.StructType([*stored.fields, T.StructField(DAY, T.DateType()), T.StructField(PART, T.StringType())])
        paths = [f"{self.path}/data/{PART}={p.name}" for p in parts]
        return spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths).drop(PART)

    def read(self, spark: SparkSession) -> DataFrame:
        """All published rows, with their day: a filter on it leaves other days unread."""
        return self._rows(spark, self.live(spark))

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Part:
        name = f"{level}-{first}-{last}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/data/{PART}={name}"
        rows.write.partitionBy(DAY).parquet(target)
        return Part(name, level, first, last, files.size(rows.sparkSession, target))

    def _publish(self, spark: SparkSession, parts: Sequence[Part]) -> None:
        there = self.generations(spark)
        text = json.dumps([asdict(p) for p in sorted(parts, key=lambda p: p.first)])
        files.write(spark, self._manifest(there[-1] + 1 if there else 0), text)

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Publish a micro-batch, then fold what is due."""
        spark = rows.sparkSession
        parts = self.live(spark)
        if any(p.first <= batch <= p.last for p in parts):
            return
        parts.append(self._write(with_day(rows.select(*[f.name for f in self.schema.fields if f.name != DAY]), self.ts).hint("rebalance"), 0, batch, batch))
        self._publish(spark, parts)
        while self.fold(spark):
            pass

    def fold(self, spark: SparkSession) -> bool:
        """Fold the parts that are due, if any, and drop what no kept manifest names."""
        parts = self.live(spark)
        old = due(parts, self.fan, self.levels)
        if not old:
            return False
        n = max(1, -(-sum(p.size for p in old) // self.file_bytes))
        rows = self._rows(spark, old).repartitionByRange(n, DAY, *self.order).sortWithinPartitions(DAY, *self.order)
        new = self._write(rows, old[0].level + 1, old[0].first, old[-1].last)
        self._publish(spark, [p for p in parts if p not in old] + [new])
        self.forget(spark)
        return True

    def forget(self, spark: SparkSession) -> None:
        """Drop all but the newest ``keep`` manifests and the parts that only older ones name."""
        there = self.generations(spark)
        gone, kept = there[: -self.keep], there[-self.keep :]
        if not gone:
            return
        # Whatever a manifest takes out never comes back, so parts that the oldest kept one lacks are needed by none.
        needed = {p.name for p in self.live(spark, kept[0])}
        dropped = {p.name for g in gone for p in self.live(spark, g)} - needed
        for name in sorted(dropped):
            files.remove(spark, f"{self.path}/data/{PART}={name}")
        for g in gone:
            files.remove(spark, self._manifest(g))
