import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meltemi.functions import geo, numbers, physics, terms, text
from meltemi.functions.clock import Clock, bucket, within


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_lookback_is_strict_and_prunes_dates(spark):
    df = spark.sql(
        "select timestamp'2024-01-02 00:00:30' as timestamp, date'2024-01-02' as event_date union all select timestamp'2024-01-02 00:00:00', date'2024-01-02'"
    )
    clock = Clock(F.lit("2024-01-02 00:00:30").cast("timestamp"))
    assert within(df, clock, "30s").count() == 1
    plan = within(df, clock, "30s")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan


@pytest.mark.parametrize("pinned", [True, False])
def test_clock_at_newest(spark, pinned):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, s),) for s in (0, 10, 40)], "timestamp timestamp_ntz")
    assert within(df, Clock.at_newest(df, pinned=pinned), "30s").count() == 1 + 0 + 0
    empty = df.where("false")
    assert within(df, Clock.at_newest(empty, pinned=pinned), "30s").count() == 0


def test_bucket_is_epoch_aligned(spark):
    got = one(spark, bucket(F.lit("2024-01-01 10:00:19").cast("timestamp"), "10 seconds").cast("string").alias("b"))
    assert got.b == "2024-01-01 10:00:10"


def test_strings(spark):
    df = spark.createDataFrame([(None,), ("",), ("NONE",), ("X",)], "s string")
    got = [(r.s, r.d, r.e, r.f) for r in df.select("s", text.differs("s", "X").alias("d"), text.is_empty("s").alias("e"), text.fault_label("s").alias("f")).collect()]
    assert got == [(None, True, True, None), ("", True, True, None), ("NONE", True, False, None), ("X", False, False, "X")]


def test_prefix_ignores_case_and_falls_through(spark):
    df = spark.createDataFrame([("wt-nax-04",), ("WT-THR-01",), ("zz",)], "id string")
    got = [r.r for r in df.select(text.by_prefix("id", {"WT-THR": "t", "WT-NAX": "n"}, "other").alias("r")).collect()]
    assert got == ["n", "t", "other"]


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(7.0,), (7.1,), (5.0,), (None,)], "v double")
    got = [r.s for r in df.select(numbers.above("v", [(7.0, "C"), (5.0, "W")], "").alias("s")).collect()]
    assert got == ["W", "C", "", ""]


def test_rounding_and_shares(spark):
    got = one(spark, numbers.rounded(F.lit(123.44999999999999), 1).alias("a"), numbers.share(F.lit(1.0), F.lit(0.0)).alias("b"), numbers.share(F.lit(1.0), F.lit(4.0)).alias("c"))
    assert (got.a, got.b, got.c) == (123.5, None, 25.0)


def test_terms_are_exact(spark):
    df = spark.createDataFrame([("Open",), ("Scheduled",), ("In Progress",), ("open",), ("Completed",)], "status string")
    assert terms.apply_term(df, "open work order").count() == 3


coord = st.tuples(st.floats(-89, 89), st.floats(-180, 180))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(coord, coord), min_size=20, max_size=40))
def test_distance_properties(spark, pairs):
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1]) for a, b in pairs], "a double, b double, c double, d double")
    rows = df.select("*", geo.distance_nm("a", "b", "c", "d").alias("x"), geo.distance_nm("c", "d", "a", "b").alias("y"), geo.distance_nm("a", "b", "a", "b").alias("z")).collect()
    for r in rows:
        assert r.x == pytest.approx(r.y, abs=1e-6) and r.z == 0 and 0 <= r.x <= math.pi * geo.EARTH_RADIUS_NM + 1e-6


def test_distance_and_bearing_known(spark):
    got = one(spark, geo.distance_nm(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))
    assert got.d == pytest.approx(60.04, abs=0.01) and got.b == pytest.approx(90.0)


def test_wind_curve(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(0, 120)], "v double")
    rows = df.select("v", physics.expected_wind_mw("v", F.lit(3.0), F.lit(12.0), F.lit(25.0), F.lit(4.2)).alias("p")).orderBy("v").collect()
    power = {r.v: r.p for r in rows}
    assert power[2.75] == 0 and power[12.0] == 4.2 and power[25.0] == 4.2 and power[25.25] == 0
    assert power[7.5] == pytest.approx(4.2 * 0.5**3)
    ramp = [power[x / 4] for x in range(12, 49)]
    assert ramp == sorted(ramp)


def test_solar_expectations(spark):
    got = one(
        spark,
        physics.solar_derate(F.lit(25.0)).alias("a"),
        physics.solar_derate(F.lit(200.0)).alias("b"),
        physics.expected_solar_kw(F.lit(1000.0), F.lit(500.0), F.lit(35.0)).alias("c"),
        physics.clear_sky_wm2(F.lit(39.65), F.lit(105), F.lit(13.0)).alias("noon"),
        physics.clear_sky_wm2(F.lit(39.65), F.lit(105), F.lit(1.0)).alias("night"),
    )
    assert (got.a, got.b, got.night) == (1.0, 0.7, 0.0)
    assert got.c == pytest.approx(480.0)
    # Day 105 at 39.65 N, half an hour past noon: elevation 59.03 degrees, air mass 1.1655.
    assert got.noon == pytest.approx(785.645, abs=0.01)
