import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from meltemi.operators.alerts import becomes_zero, changes_to, crosses_above
from meltemi.operators.latest import distinct_keys, latest, newest
from meltemi.operators.order import previous_row, with_time_slice

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, timestamp timestamp, seq int, v double, label string"

rows_strategy = st.lists(
    st.tuples(st.sampled_from("aaab"), st.integers(0, 40), st.sampled_from([1.0, 2.0, 9.0]), st.sampled_from(["NONE", "F", "G"])), min_size=1, max_size=60
)


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), i, v, lab) for i, (k, s, v, lab) in enumerate(rows)], SCHEMA)


@settings(max_examples=6, deadline=None)
@given(rows_strategy, st.sampled_from([1, 3, 50]))
def test_previous_row_equals_a_plain_window(spark, rows, slices):
    df = frame(spark, rows)
    plain = df.withColumn("p", F.lag("seq").over(Window.partitionBy("k").orderBy("timestamp", "seq")))
    got = previous_row(df, "k", ["timestamp", "seq"], ["v"], slices=slices)
    assert {(r.seq, r.prev_seq) for r in got.collect()} == {(r.seq, r.p) for r in plain.collect()}


def shape(df):
    """The analysed plan without what differs from run to run."""
    return re.sub(r"#?\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_the_plan_does_not_depend_on_the_size(spark):
    def linked(n):
        rows = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("v"))
        return previous_row(rows, "k", "timestamp", ["v"], slices=8)

    assert shape(linked(10)) == shape(linked(10_000_000))


def test_one_wrong_time_does_not_undo_the_slices(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"))
    rows = rows.unionByName(spark.range(1).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(0)).alias("timestamp")))
    sizes = [r["count"] for r in with_time_slice(rows, "timestamp", 20).groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) <= 2 * 20_001 / 20
    got = previous_row(rows, "k", "timestamp", [], slices=20)
    assert got.where("prev_timestamp is null").count() == 1
    assert previous_row(rows.limit(0), "k", "timestamp", [], slices=20).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = previous_row(df, "k", "timestamp", ["v"], slices=80).withColumn("task", F.spark_partition_id())
        shares = [r["count"] / 40_000 for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(shares) == 4 and max(shares) < 0.5


def test_previous_row_ignores_rows_without_time(spark):
    df = spark.createDataFrame([("a", None, 0, 1.0, ""), ("a", T0, 1, 1.0, "")], SCHEMA)
    assert previous_row(df, "k", "timestamp", ["v"]).count() == 1


@settings(max_examples=5, deadline=None)
@given(rows_strategy)
def test_latest_is_the_greatest_time(spark, rows):
    df = frame(spark, rows)
    got = {r.k: (r.timestamp, r.seq) for r in latest(df, "k", tiebreak="seq").collect()}
    want = {}
    for i, (k, s, _, _) in enumerate(rows):
        want[k] = max(want.get(k, (T0, -1)), (T0 + timedelta(seconds=s), i))
    assert got == want


def test_latest_null_time_and_hash_form(spark):
    df = spark.createDataFrame([("a", None, 9, 9.0, "x"), ("a", T0, 1, None, "y"), ("a", T0 - timedelta(1), 0, 5.0, "z"), ("b", None, 0, 0.0, "n")], SCHEMA)
    for hashed in (True, False):
        got = latest(df, "k", cols=["v", "seq"], unique_ts=hashed).collect()
        assert [(r.k, r.v, r.seq) for r in got] == [("a", None, 1)]
    plan = latest(df, "k", cols=["v"], unique_ts=True)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_newest_and_distinct(spark):
    df = frame(spark, [("a", 5, 1.0, "x"), ("b", 9, 2.0, "y"), ("b", 9, 3.0, "y")])
    assert newest(df, tiebreak="seq").first().seq == 2
    assert "TakeOrderedAndProject" in newest(df)._jdf.queryExecution().executedPlan().toString()
    assert distinct_keys(df, "k").first().n == 2 == distinct_keys(df, "k", approximate=True).first().n


def changes(spark, labels, **kwargs):
    df = frame(spark, [("a", i, 1.0, lab) for i, lab in enumerate(labels)])
    return [r.seq for r in changes_to(df, "k", "label", "F", tiebreak="seq", **kwargs).orderBy("seq").collect()]


def test_change_alerts(spark):
    assert changes(spark, ["NONE", "F", "F", "NONE", "F"]) == [1, 4]
    assert changes(spark, ["F", "F"]) == []
    assert changes(spark, ["F", "F"], fire_on_first=True) == [0]
    assert changes(spark, [None, "F", None, "F"]) == [1, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["NONE", "F", None]), min_size=1, max_size=30))
def test_alerts_count_transitions(spark, labels):
    want = [i for i in range(1, len(labels)) if labels[i] == "F" and labels[i - 1] != "F"]
    assert changes(spark, labels) == want


def test_condition_alerts(spark):
    df = frame(spark, [("a", i, v, "") for i, v in enumerate([7.0, 7.1, 8.0, 0.0, 0.0, 9.0])])
    assert [r.seq for r in crosses_above(df, "k", "v", 7.0).orderBy("seq").collect()] == [1, 5]
    assert [r.seq for r in becomes_zero(df, "k", "v").collect()] == [3]


@pytest.mark.parametrize("ntz", [True, False])
def test_both_time_types(spark, ntz):
    df = frame(spark, [("a", 0, 1.0, "NONE"), ("a", 1, 1.0, "F")])
    if ntz:
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert changes_to(df, "k", "label", "F").count() == 1
