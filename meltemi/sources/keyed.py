"""A table of current rows by key: hash buckets, generations, and a pointer that is swapped in one step."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.sources import files

BUCKET = "bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Rows found by ``keys``, which also name the bucket of a row.

    A commit is a generation, numbered by its micro-batch. It reads and rewrites only the buckets that its changes touch; a manifest names, for every bucket, the generation whose
    files are live. Manifests appear by a rename, so a reader sees the table before a commit or after it and never between. A replayed batch starts from the generation
    before it and writes the same files again. Nothing is looked up on the driver but bucket numbers, at most ``buckets`` of them.
    """

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _manifest(self, generation: int) -> str:
        return f"{self.path}/manifest/{generation:012d}.json"

    def generations(self, spark: SparkSession) -> list[int]:
        """Numbers of the manifests that are there, oldest first."""
        return sorted(int(name[:12]) for name in files.names(spark, f"{self.path}/manifest") if name.endswith(".json") and name[:12].isdigit())

    def live(self, spark: SparkSession, upto: int | None = None) -> dict[int, int]:
        """Generation of every bucket that has rows, as of the newest manifest (not above ``upto``)."""
        there = [g for g in self.generations(spark) if upto is None or g <= upto]
        if not there:
            return {}
        return {int(b): g for b, g in json.loads(files.read(spark, self._manifest(there[-1]))).items()}

    def _rows(self, spark: SparkSession, live: dict[int, int]) -> DataFrame:
        if not live:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/generation={g}/{BUCKET}={b}" for b, g in sorted(live.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def read(self, spark: SparkSession, *, upto: int | None = None) -> DataFrame:
        """The current rows, or those of an earlier generation."""
        return self._rows(spark, self.live(spark, upto))

    def touched(self, changes: DataFrame) -> list[int]:
        """Numbers of the buckets that the rows fall into: one small set, whatever the rows."""
        return changes.agg(F.collect_set(self._bucket()).alias(BUCKET)).first()[BUCKET]

    def merge(self, changes: DataFrame, generation: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Commit ``merged(old rows of the touched buckets, changes)`` as their new content. ``changes`` are read three times: pass written or kept rows."""
        spark = changes.sparkSession
        before, hit = self.live(spark, generation - 1), self.touched(changes)
        now = dict(before)
        if hit:
            old = self._rows(spark, {b: before[b] for b in hit if b in before})
            rows = merged(old, changes).select(*self.schema.names).withColumn(BUCKET, self._bucket())
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/generation={generation}")
            written = {int(n.split("=")[1]) for n in files.names(spark, f"{self.path}/data/generation={generation}") if n.startswith(f"{BUCKET}=")}
            now = {b: g for b, g in before.items() if b not in hit} | dict.fromkeys(written, generation)
        files.write(spark, self._manifest(generation), json.dumps({str(b): g for b, g in sorted(now.items())}))

    def forget(self, spark: SparkSession, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` manifests and the bucket files that none of those names."""
        there = self.generations(spark)
        kept = there[-keep:]
        named = {(g, b) for k in kept for b, g in self.live(spark, k).items()}
        for g in there[:-keep]:
            files.remove(spark, self._manifest(g))
        newest = kept[-1] if kept else -1
        for folder in files.names(spark, f"{self.path}/data"):
            g = int(folder.split("=")[1])
            if g > newest:
                continue  # a commit that is not finished
            buckets = [n for n in files.names(spark, f"{self.path}/data/{folder}") if n.startswith(f"{BUCKET}=")]
            if not any((g, int(n.split("=")[1])) in named for n in buckets):
                files.remove(spark, f"{self.path}/data/{folder}")
                continue
            for n in buckets:
                if (g, int(n.split("=")[1])) not in named:
                    files.remove(spark, f"{self.path}/data/{folder}/{n}")


def latest_rows(keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the newest row of every key."""
    from meltemi.operators.latest import latest

    def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
        return latest(old.unionByName(changes.select(*old.columns)), list(keys), ts=ts, tiebreak=tiebreak)

    return merged
