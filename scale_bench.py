"""Scaling: the same operators on the events table times 1, 10 and 100, one key holding a third of all rows.

python scale_bench.py [factors ...]; prints one JSON line per factor. The copies shift keys and times, so that
cardinality grows with size. They are written below the shared folder (see meltemi.session.shared_dir).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.functions.text import FORCED_FAILURE
from meltemi.operators.alerts import changes_to
from meltemi.operators.latest import latest
from meltemi.operators.series import bucketed, decompose, make_series
from meltemi.plans import questions, tiles
from meltemi.plans.sf import SfTables, wind
from meltemi.session import build_session, shared_dir

BASE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HOT = 7


def multiplied(spark: SparkSession, factor: int) -> str:
    """A table folder whose events are ``factor`` times the base's, a third of them of one user."""
    target = shared_dir(spark, f"scale-{factor}")
    ev = spark.read.parquet(f"{BASE}/events.parquet")
    n = F.col("n")
    many = ev.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    users = ev.agg((F.max("user_id") + 1).alias("u")).scalar()
    many.select(
        (F.col("event_id") * factor + n).cast("bigint").alias("event_id"),
        (F.col("ts") + F.make_dt_interval(secs=n * 0.23)).alias("ts"),
        F.when((F.col("event_id") + n) % 3 == 0, F.lit(HOT)).otherwise(F.col("user_id") + users * n).cast("bigint").alias("user_id"),
        "event_type",
        "value",
        "props",
    ).repartitionByRange(32, "ts").write.parquet(f"{target}/events.parquet")
    return target


class Scaled(SfTables):
    """Events from the multiplied folder, everything else from the base."""

    def __init__(self, spark: SparkSession, events_dir: str):
        super().__init__(spark, BASE)
        self.events_dir = events_dir
        big = SfTables(spark, events_dir)
        self._made["events"] = big["events"]


def jobs(t: SfTables) -> dict[str, DataFrame]:
    ev = t["events"]
    series = make_series(ev, "user_id", "1 day", F.avg("value"))
    return {
        "latest_row": latest(ev, "user_id", tiebreak="event_id"),
        "latest_row_hashed": latest(ev, "user_id", cols=["value"], unique_ts=True),
        "time_buckets": bucketed(ev, "1 hour", {"n": F.count("*"), "v": F.avg("value")}, keys=["event_type"]),
        "series": series,
        "series_decomposed": decompose(series, "user_id", "1 day"),
        "change_alerts": changes_to(wind(ev), "turbine_id", "fault_type", FORCED_FAILURE, tiebreak="event_id"),
        "generation_mix": tiles.e07_generation_mix(t, t.clock()),
        "entity_view": questions.g14_turbine_power(t),
    }


def main() -> None:
    factors = [int(x) for x in sys.argv[1:]] or [1, 10, 100]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("scale", f"local[{cpus}]", spark__sql__shuffle__partitions="32", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    for factor in factors:
        t = Scaled(spark, multiplied(spark, factor))
        rows = t["events"].count()
        out = {}
        for name, df in jobs(t).items():
            took = []
            for _ in range(2):
                start = time.perf_counter()
                df.write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            out[name] = round(min(took), 2)
        print(json.dumps({"factor": factor, "rows": rows, "seconds": out, "rows_per_sec": {k: round(rows / v) for k, v in out.items()}}), flush=True)


if __name__ == "__main__":
    main()
