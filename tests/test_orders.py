"""Order lifecycle: opened, closed, opened again; replays; the order table of a stream; keyed tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.operators.alerts import changes_to
from meltemi.operators.latest import latest
from meltemi.operators.orders import dispatch_history, merge_orders, orders, status_events, well_again
from meltemi.sources import files
from meltemi.sources.keyed import KeyedTable, latest_rows
from meltemi.streaming.alerts import ChangeAlerts
from meltemi.streaming.orders import OrderLedger

T0 = datetime(2026, 4, 14, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def seconds(value):
    return None if value is None else int((value - T0).total_seconds())


def moments(spark, rows):
    return spark.createDataFrame([(a, at(s), 37.0, 25.0) for a, s in rows], "turbine_id string, timestamp timestamp, latitude double, longitude double")


@pytest.fixture(scope="module")
def vessels(spark):
    return spark.createDataFrame([("near", 37.1, 25.1), ("far", 40.0, 20.0)], "vessel_id string, vessel_lat double, vessel_lon double")


def lives(df):
    return sorted((r.asset_id, seconds(r.episode_start), r.status, seconds(r.closed_at), r.vessel_id) for r in df.collect())


def test_an_order_closes_and_the_next_alert_opens_another(spark, vessels):
    alerts = moments(spark, [("a", 10), ("a", 12), ("a", 40), ("b", 5), ("c", 7), ("a", 10)])
    closings = moments(spark, [("a", 1), ("a", 20), ("a", 25), ("b", 5), ("c", 9), ("d", 3)])
    got = dispatch_history(alerts, closings, vessels, asset="turbine_id")
    # b's closing at the very instant of its alert goes first, so the order stays open.
    assert lives(got) == [("a", 10, "Completed", 20, "near"), ("a", 40, "Open", None, "near"), ("b", 5, "Open", None, "near"), ("c", 7, "Completed", 9, "near")]
    assert dispatch_history(alerts, closings, vessels.limit(0), asset="turbine_id").where("vessel_id is null").count() == 4
    assert dispatch_history(alerts.limit(0), closings, vessels, asset="turbine_id").count() == 0


def test_known_open_orders_are_ended_but_not_opened_again(spark):
    busy = spark.createDataFrame([("a", at(0)), ("b", at(10))], "turbine_id string, episode_start timestamp")
    events = status_events(moments(spark, [("a", 3), ("b", 10), ("a", 30)]), moments(spark, [("a", 20)]), asset="turbine_id", earlier=busy)
    assert sorted((r.turbine_id, seconds(r.episode_start), r.status, seconds(r["at"])) for r in events.collect()) == [("a", 0, "Completed", 20), ("a", 30, "Open", 30)]


def plain_history(rows):
    """[(asset, start, end)] by walking through an asset's alerts (True) and closings."""
    out = []
    for asset in {a for a, _, _ in rows}:
        start = None
        for s, opens in sorted({(s, o) for a, s, o in rows if a == asset}):
            if opens and start is None:
                start = s
            elif not opens and start is not None:
                out.append((asset, start, s))
                start = None
        if start is not None:
            out.append((asset, start, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_a_walk(spark, vessels, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aaaab"), rng.randrange(120), rng.random() < 0.5) for _ in range(150)]
    got = dispatch_history(moments(spark, [(a, s) for a, s, o in rows if o]), moments(spark, [(a, s) for a, s, o in rows if not o]), vessels, asset="turbine_id")
    assert sorted(((r.asset_id, seconds(r.episode_start), seconds(r.closed_at)) for r in got.collect()), key=str) == plain_history(rows)


def test_status_events_merge_in_any_order_and_any_number_of_times(spark):
    told = [("o1", "a", "Open", 0, 1.0), ("o1", "a", "In Progress", 5, None), ("o1", "a", "Completed", 9, None), ("o1", "a", "Cancelled", 11, None), ("o1", "a", "Open", 20, 2.0)]
    told += [("o2", "b", "Open", 3, 3.0), ("o2", "b", "In Progress", 3, None), ("o3", "c", "Completed", 4, None)]
    events = spark.createDataFrame([(o, a, s, at(t), x) for o, a, s, t, x in told], "order_id string, asset_id string, status string, at timestamp, x double")
    want = {("o1", "a", 0, 1.0, "Completed", 9), ("o2", "b", 3, 3.0, "In Progress", None), ("o3", "c", None, None, "Completed", 4)}

    def state(merged):
        return {(r.order_id, r.asset_id, None if r.episode_start is None else seconds(r.episode_start), r.x, r.status, seconds(r.closed_at)) for r in orders(merged).collect()}

    assert state(merge_orders(None, events, cols=["x"])) == want
    merged = None
    rng = random.Random(4)
    for k in rng.sample(range(len(told)), len(told)) + [0, 2, 4]:
        o, a, s, t, x = told[k]
        one = spark.createDataFrame([(o, a, s, at(t), x)], events.schema)
        merged = spark.createDataFrame(merge_orders(merged, one, cols=["x"]).collect(), merge_orders(None, events, cols=["x"]).schema)
    assert state(merged) == want


def readings(spark, rows):
    kind = "turbine_id string, timestamp timestamp, fault_type string, vibration_mm_s double, latitude double, longitude double, seq int"
    return spark.createDataFrame([(a, at(s), f, v, 37.0, 25.0, i) for i, (a, s, f, v) in enumerate(rows)], kind)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_orders_equals_history_for_any_split(spark, vessels, tmp_path, seed):
    """Rows out of order, cut at random, every batch delivered twice."""
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i + rng.randrange(8), rng.choice(["NONE", "NONE", "F"]), rng.choice([2.0, 5.0])) for i in range(70)]
    frame = readings(spark, rows)
    ledger = OrderLedger(str(tmp_path / "ledger"), "turbine_id", T.StringType(), vessels, well_again(), buckets=4)
    job = ChangeAlerts(str(tmp_path / "state"), "turbine_id", F.col("fault_type") == "F", tiebreak=["seq"], delay="9 seconds", on_released=ledger.process)
    cuts = [0, *sorted(rng.sample(range(1, 70), 2)), 70]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = frame.where(F.col("seq").between(a, b - 1))
        job.process(batch, n)
        before = lives(ledger.orders(spark))
        if n == 1:
            job.process(batch, n)
            assert lives(ledger.orders(spark)) == before
    job.process(frame.where("false"), len(cuts) - 1, finish=True)
    alerts = changes_to(frame, "turbine_id", "fault_type", "F", tiebreak="seq")
    want = lives(dispatch_history(alerts, frame.where(well_again()), vessels, asset="turbine_id"))
    assert lives(ledger.orders(spark)) == want
    assert any(x[2] == "Completed" for x in want) and len(want) > len({x[0] for x in want})


# ---- keyed tables ----


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("v", T.DoubleType())])


def test_keyed_table_keeps_the_newest_and_rewrites_touched_buckets_only(spark, folder):
    table = KeyedTable(folder, ("k",), SCHEMA, buckets=16)
    assert table.read(spark).count() == 0
    every = [spark.createDataFrame([(f"k{i}", 0, float(i)) for i in range(200)], SCHEMA)]
    table.merge(every[0], 0, latest_rows(["k"], "ts"))
    one = spark.createDataFrame([("k7", 5, 1.5), ("k7", 3, 9.0)], SCHEMA)
    table.merge(one, 1, latest_rows(["k"], "ts"))
    assert len(files.names(spark, f"{folder}/data/generation=1")) <= 2  # one bucket and the success mark
    assert sum(g == 1 for g in table.live(spark).values()) == 1
    want = latest(every[0].union(one), "k", ts="ts")
    assert sorted(map(tuple, table.read(spark).select("k", "ts", "v").collect())) == sorted(map(tuple, want.select("k", "ts", "v").collect()))
    # An earlier generation is still readable, and a replay changes nothing.
    assert table.read(spark, upto=0).where("k = 'k7'").first().v == 7.0
    table.merge(one, 1, latest_rows(["k"], "ts"))
    assert table.read(spark).count() == 200 and table.read(spark).where("k = 'k7'").first().v == 1.5


def test_keyed_table_bytes_do_not_grow_with_silent_keys(spark, tmp_path):
    def written(n):
        path = str(tmp_path / f"t{n}")
        table = KeyedTable(path, ("k",), SCHEMA, buckets=n // 10)
        table.merge(spark.createDataFrame([(f"k{i}", 0, float(i)) for i in range(n)], SCHEMA), 0, latest_rows(["k"], "ts"))
        table.merge(spark.createDataFrame([("k1", 1, 0.0)], SCHEMA), 1, latest_rows(["k"], "ts"))
        return files.size(spark, f"{path}/data/generation=1")

    few, many = written(100), written(1000)
    assert 0 < many < 1.5 * few


def test_unfinished_commits_are_not_seen_and_old_files_go(spark, folder):
    table = KeyedTable(folder, ("k",), SCHEMA, buckets=4)
    for g in range(4):
        table.merge(spark.createDataFrame([("a", g, float(g)), ("b", 0, 0.0)] if g == 0 else [("a", g, float(g))], SCHEMA), g, latest_rows(["k"], "ts"))
    # A commit that wrote its data and died before its manifest.
    spark.createDataFrame([("z", 9, 9.0)], SCHEMA).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{folder}/data/generation=4")
    assert sorted(r.k for r in table.read(spark).collect()) == ["a", "b"]
    table.forget(spark, keep=2)
    assert table.generations(spark) == [2, 3]
    assert sorted(map(tuple, table.read(spark).select("k", "v").collect())) == [("a", 3.0), ("b", 0.0)]
    assert table.read(spark, upto=2).where("k = 'a'").first().v == 2.0
    kept = {n for n in files.names(spark, f"{folder}/data")}
    assert "generation=1" not in kept and {"generation=0", "generation=2", "generation=3", "generation=4"} <= kept
