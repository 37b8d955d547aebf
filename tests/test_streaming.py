import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meltemi.operators.alerts import changes_to
from meltemi.operators.dispatch import dispatch_orders
from meltemi.operators.latest import latest
from meltemi.operators.series import bucketed
from meltemi.sources.wire import routes, typed
from meltemi.streaming import ingest, state
from meltemi.streaming.alerts import ChangeAlerts, dispatch_sink

T0 = datetime(2026, 4, 14, 10, 0, 0, tzinfo=timezone.utc)


def wind(tid, second, fault="NONE", **kw):
    return {
        "timestamp": (T0 + timedelta(seconds=second)).isoformat(), "stream_type": "WindTurbineTelemetry", "turbine_id": tid, "fault_type": fault,
        "power_mw": 1.0, "vibration_mm_s": 2.0, "latitude": 37.07, "longitude": 25.48, **kw,
    }


class Source:
    """A folder of JSON files, added in order, one per trigger."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir(parents=True)

    def add(self, *events):
        file = self.path / f"part-{self.n:03d}.json"
        file.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")
        # The file source goes by age; files written within a millisecond need distinct ones.
        os.utime(file, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def text(self):
        return ingest.read_text(self.spark, str(self.path), max_files=1)

    def wind(self):
        return routes(typed(self.text()))["wind"]

    def batch(self):
        return routes(typed(self.spark.read.text(str(self.path))))["wind"]


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


FILES = [
    [wind("a", 0), wind("b", 1), wind("a", 4, "F")],
    [wind("a", 2), wind("b", 3, "F"), wind("a", 6, "F")],
    [wind("b", 7), wind("a", 30)],
    [wind("b", 31, "F"), wind("a", 33, "F"), wind("a", 35), wind("a", 34, "F")],
    [wind("a", 90), wind("c", 91, "F"), wind("b", 92)],
]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_routing_equals_batch_and_replay_is_idempotent(spark, source, tmp_path):
    for f in FILES:
        source.add(*f)
    source.add("garbage", {"stream_type": "Nope"}, {**wind("z", 1), "stream_type": "GridTelemetry", "grid_id": "G", "grid_name": "Grid"})
    store = str(tmp_path / "store")
    for _ in range(2):
        ingest.route_to_tables(source.text(), store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = spark.read.parquet(f"{store}/wind")
    assert rows(got, "turbine_id", "timestamp", "fault_type") == rows(source.batch(), "turbine_id", "timestamp", "fault_type")
    assert spark.read.parquet(f"{store}/grid").count() == 1
    assert sorted(r.reason for r in spark.read.parquet(f"{store}/quarantine").collect()) == ["malformed", "unknown stream_type"]
    # A batch written again under its own id replaces itself.
    ingest.write_batch(source.batch(), f"{store}/wind2", 0)
    ingest.write_batch(source.batch(), f"{store}/wind2", 0)
    assert spark.read.parquet(f"{store}/wind2").count() == source.batch().count()


def test_duplicates_are_dropped(spark, source, tmp_path):
    source.add(wind("a", 0), wind("a", 0), wind("a", 1))
    source.add(wind("a", 1), wind("b", 1))
    out = str(tmp_path / "out")
    once = ingest.deduplicated(source.wind(), "turbine_id")
    ingest.started(once.writeStream.format("parquet").option("path", out), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert len(rows(spark.read.parquet(out), "turbine_id", "timestamp")) == 3


def test_latest_stream_equals_batch(spark, source, tmp_path):
    path = str(tmp_path / "latest")
    for f in FILES:
        source.add(*f)
        state.latest_to_table(source.wind(), "turbine_id", path, str(tmp_path / "cp"), cols=["fault_type"], available_now=True).awaitTermination()
    want = rows(latest(source.batch(), "turbine_id", cols=["fault_type"]), "turbine_id", "timestamp", "fault_type")
    assert rows(state.current(spark, path, "turbine_id"), "turbine_id", "timestamp", "fault_type") == want
    state.compacted(spark, path, path + "-short", "turbine_id")
    assert rows(spark.read.parquet(path + "-short"), "turbine_id", "timestamp", "fault_type") == want


def test_bucket_stream_equals_batch_once_final(spark, source, tmp_path):
    for f in FILES:
        source.add(*f)
    source.add(wind("z", 1000))
    out = str(tmp_path / "out")
    aggs = {"n": F.count("*")}
    state.buckets_to_table(source.wind(), "10 seconds", aggs, out, str(tmp_path / "cp"), keys=["turbine_id"], delay="1 minute", available_now=True).awaitTermination()
    want = rows(bucketed(source.batch().where("turbine_id <> 'z'"), "10 seconds", aggs, keys=["turbine_id"]), "turbine_id", "timestamp", "n")
    assert rows(spark.read.parquet(out), "turbine_id", "timestamp", "n") == want


@pytest.mark.parametrize("one_run", [True, False])
def test_alert_stream_equals_batch(spark, source, tmp_path, one_run):
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", delay="10 seconds")
    cp = str(tmp_path / "cp")
    query = None
    if one_run:
        for f in FILES:
            source.add(*f)
        query = job.start(source.wind(), cp, available_now=True)
        query.awaitTermination()
    else:
        # Stopped and started again from the checkpoint after every file.
        for f in FILES:
            source.add(*f)
            query = job.start(source.wind(), cp, available_now=True)
            query.awaitTermination()
    job.finish(spark, query)
    want = rows(changes_to(source.batch(), "turbine_id", "fault_type", "F"), "turbine_id", "timestamp")
    assert len(want) == 4
    assert rows(job.alerts(spark), "turbine_id", "timestamp") == want


def test_too_late_rows_are_counted_and_left_out(spark, source, tmp_path):
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", delay="5 seconds")
    source.add(wind("a", 0), wind("a", 10), wind("b", 100), wind("c", 1))
    # a at 5 precedes a released row of a; c at 50 is behind the watermark but precedes nothing of c.
    source.add(wind("a", 5, "F"), wind("b", 101, "F"), wind("c", 50, "F"))
    query = job.start(source.wind(), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    job.finish(spark, query)
    fired = rows(job.alerts(spark), "turbine_id", F.col("timestamp").cast("string"))
    assert fired == [("b", "2026-04-14 10:01:41"), ("c", "2026-04-14 10:00:50")]
    assert job.dropped(spark).agg(F.sum("dropped")).first()[0] == 1


@pytest.mark.parametrize("delay", ["0 seconds", "1 hour"])
def test_any_delay_agrees_on_ordered_input(spark, source, tmp_path, delay):
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", delay=delay)
    source.add(wind("a", 0), wind("b", 0))
    source.add(wind("b", 1, "F"), wind("a", 2, "F"))
    source.add(wind("b", 3), wind("a", 3, "F"), wind("b", 4, "F"))
    query = job.start(source.wind(), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    job.finish(spark, query)
    want = rows(changes_to(source.batch(), "turbine_id", "fault_type", "F"), "turbine_id", "timestamp")
    assert len(want) == 3 and rows(job.alerts(spark), "turbine_id", "timestamp") == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_into_batches_gives_the_batch_answer(spark, tmp_path, seed):
    """Rows up to 20 s out of order, cut at random places, with a delay that covers the disorder."""
    rng = random.Random(seed)
    events = [(rng.choice("aab"), i + rng.randint(0, 20), rng.choice(["NONE", "F"]), i) for i in range(60)]
    schema = "k string, timestamp timestamp, label string, seq int"
    frame = spark.createDataFrame([(k, T0 + timedelta(seconds=s), lab, i) for k, s, lab, i in events], schema)
    cuts = sorted(rng.sample(range(1, 60), 3))
    job = ChangeAlerts(str(tmp_path / "state"), "k", F.col("label") == "F", tiebreak=["seq"], delay="21 seconds")
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        job.process(frame.where(F.col("seq").between(a, b - 1)), n)
    job.process(frame.where("false"), len(cuts) + 1, finish=True)
    assert job.dropped(spark).agg(F.sum("dropped")).first()[0] == 0
    assert rows(job.alerts(spark), "seq") == rows(changes_to(frame, "k", "label", "F", tiebreak="seq"), "seq")


def test_replayed_batch_writes_the_same(spark, source, tmp_path):
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", delay="1 second")
    for i, f in enumerate(FILES[:3]):
        source.add(*f)
        one = routes(typed(spark.read.text(str(source.path / f"part-{i:03d}.json"))))["wind"]
        job.process(one, i)
        before = rows(job.alerts(spark), "turbine_id", "timestamp")
        job.process(one, i)
        assert rows(job.alerts(spark), "turbine_id", "timestamp") == before


def test_dispatch_over_batches(spark, source, tmp_path):
    vessels = spark.createDataFrame([("V", 37.1, 25.4)], "vessel_id string, vessel_lat double, vessel_lon double")
    store = str(tmp_path / "orders")
    sink = dispatch_sink(store, lambda alerts, taken: dispatch_orders(alerts, vessels, asset="turbine_id", open_orders=taken), "turbine_id")
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", delay="10 seconds", on_alerts=sink)
    for f in FILES:
        source.add(*f)
    query = job.start(source.wind(), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    job.finish(spark, query)
    want = dispatch_orders(changes_to(source.batch(), "turbine_id", "fault_type", "F"), vessels, asset="turbine_id")
    assert rows(spark.read.parquet(f"{store}/orders"), "asset_id", "order_id") == rows(want, "asset_id", "order_id")
