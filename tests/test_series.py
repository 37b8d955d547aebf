from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meltemi.operators.assets import counted_median
from meltemi.sources.anomalies import AnomalyTable
from meltemi.operators.detect import SpectralResidual, anomaly_events, best_detector, evaluate, spectral_residual
from meltemi.operators.series import bucketed, decompose, detect_period, make_series, per_entity_bucketed, width_us

T0 = datetime(2026, 1, 1)


def readings(spark, points, key="a"):
    return spark.createDataFrame([(key, T0 + timedelta(seconds=s), float(v)) for s, v in points], "k string, timestamp timestamp, v double")


def series(spark, values, step=5, key="a"):
    return make_series(readings(spark, [(i * step, v) for i, v in enumerate(values)], key), "k", f"{step} seconds", F.avg("v"))


def test_widths():
    assert width_us("5 seconds") == 5_000_000 and width_us("1 day") == 86_400_000_000


@pytest.mark.parametrize(
    "fill,want",
    [("default", [1, 0, 0, 0, 9]), ("null", [1, None, None, None, 9]), ("ffill", [1, 1, 1, 1, 9]), ("linear", [1, 3, 5, 7, 9])],
)
def test_gap_of_three_steps(spark, fill, want):
    got = make_series(readings(spark, [(0, 0), (1, 2), (20, 9)]), "k", "5 seconds", F.avg("v"), fill=fill).orderBy("timestamp").collect()
    assert [r.value for r in got] == want
    assert [r.filled for r in got] == [False, True, True, True, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40))
def test_no_gaps_and_counts_kept(spark, seconds):
    got = make_series(readings(spark, [(s, 1) for s in seconds]), "k", "5 seconds", F.count("*"), default=0).orderBy("timestamp").collect()
    stamps = [r.timestamp for r in got]
    assert all(b - a == timedelta(seconds=5) for a, b in zip(stamps, stamps[1:]))
    assert sum(r.value for r in got) == len(seconds)


def test_series_crosses_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr("meltemi.operators.series._STEPS_PER_BLOCK", 3)
    got = make_series(readings(spark, [(0, 1), (50, 2), (55, 3), (120, 4)]), "k", "5 seconds", F.avg("v"), fill="ffill", slices=3).orderBy("timestamp").collect()
    assert len(got) == 25 and [r.value for r in got][9:12] == [1, 2, 3] and got[-2].value == 3


def test_slices_give_the_same_series(spark):
    df = readings(spark, [(0, 1), (50, 2), (55, 3), (120, 4)]).unionByName(readings(spark, [(7, 1), (33, 2)], "b"))
    for fill in ("default", "linear"):
        a, b = (make_series(df, "k", "5 seconds", F.avg("v"), fill=fill, slices=s) for s in (1, 7))
        assert sorted(a.collect()) == sorted(b.collect())


def test_a_long_gap_is_dealt_over_tasks(spark):
    df = readings(spark, [(0, 1), (2_000_000, 2)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = make_series(df, "k", "5 seconds", F.avg("v")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in got) == 400_001 and max(r["count"] for r in got) < 300_000


def test_buckets_drop_rows_without_time(spark):
    df = readings(spark, [(0, 1), (9, 2), (10, 4)]).unionByName(spark.sql("select 'a' as k, cast(null as timestamp) as timestamp, 1.0D as v"))
    got = {r.timestamp.second: (r.n, r.s) for r in bucketed(df, "10 seconds", {"n": F.count("*"), "s": F.sum("v")}).collect()}
    assert got == {0: (2, 3.0), 10: (1, 4.0)}


def test_per_entity_mean_is_free_of_the_sampling_rate(spark):
    df = readings(spark, [(0, 4), (2, 4), (4, 4)]).unionByName(readings(spark, [(0, 2)], "b"))
    assert per_entity_bucketed(df, "10 seconds", "v", "k").first().v == 6.0
    assert bucketed(df, "10 seconds", {"v": F.sum("v")}).first().v == 14.0


def test_constant_series_has_no_anomalies(spark):
    got = decompose(series(spark, [3.0] * 20), "k", "5 seconds", threshold=1.0).collect()
    assert {(r.score, r.anomaly, r.baseline) for r in got} == {(0.0, 0, 3.0)}


def test_planted_spikes_and_threshold(spark):
    values = [2.0 + (i % 5) * 0.1 for i in range(100)]
    values[40], values[70] = 25.0, -20.0
    s = series(spark, values)
    flags = {(r.timestamp - T0).seconds // 5: r.anomaly for r in decompose(s, "k", "5 seconds", threshold=1.0).where("anomaly <> 0").collect()}
    assert flags == {40: 1, 70: -1}
    assert decompose(s, "k", "5 seconds", threshold=10_000.0).where("anomaly <> 0").count() == 0


def test_season_explains_a_regular_pattern(spark):
    values = [10.0 if i % 6 == 0 else 1.0 for i in range(60)]
    values[31] = 12.0
    s = series(spark, values)
    period = detect_period(s, "k", "5 seconds", [2, 3, 5, 6, 7])
    assert period.first().period == 6
    for p in (6, period):
        got = decompose(s, "k", "5 seconds", threshold=1.0, period=p).where("anomaly = 1").collect()
        assert [(r.timestamp - T0).seconds // 5 for r in got] == [31]
    # The season follows the regular peaks; without one the baseline is flat.
    seasonal = decompose(s, "k", "5 seconds", period=6).where("value = 10").agg(F.min("baseline")).first()[0]
    flat = decompose(s, "k", "5 seconds").agg(F.count_distinct("baseline")).first()[0]
    assert seasonal == 10.0 and flat == 1


def test_no_period_in_noise(spark):
    rng = np.random.default_rng(1)
    assert detect_period(series(spark, rng.normal(size=200)), "k", "5 seconds", [2, 3, 4]).first().period is None


def test_sketched_percentiles_agree(spark):
    s = series(spark, [float(i % 17) for i in range(170)])
    a = decompose(s, "k", "5 seconds").agg(F.max("score")).first()[0]
    b = decompose(s, "k", "5 seconds", accuracy=10_000).agg(F.max("score")).first()[0]
    assert a == pytest.approx(b, abs=0.1)


def _spiky(n, spikes, seed=0):
    rng = np.random.default_rng(seed)
    values = 2.5 + 0.8 * np.sin(np.arange(n) * 2 * np.pi / 22) + rng.normal(0, 0.05, n)
    values[list(spikes)] += 25
    return values


def test_spectral_residual_finds_planted_spikes(spark):
    s = series(spark, _spiky(600, (150, 400)))
    got = spectral_residual(s, "k", "5 seconds", core=1440)
    assert got.count() == 600
    flagged = {(r.timestamp - T0).seconds // 5 for r in got.where("anomaly = 1").collect()}
    assert {150, 400} <= flagged and len(flagged) < 6
    quiet = spectral_residual(series(spark, [1.0] * 50), "k", "5 seconds")
    assert quiet.where("anomaly = 1 or score <> 0").count() == 0


def test_spectral_residual_in_stretches_keeps_every_row_once(spark):
    s = series(spark, _spiky(600, (100, 199, 200, 450))).unionByName(series(spark, _spiky(77, (30,), 2), key="b"))
    got = spectral_residual(s, "k", "5 seconds", core=200)
    assert got.groupBy("k", "timestamp").count().where("count <> 1").count() == 0
    assert got.count() == 677
    flagged = {(r.k, (r.timestamp - T0).seconds // 5) for r in got.where("anomaly = 1").collect()}
    assert {("a", 100), ("a", 450), ("b", 30)} <= flagged


def test_results_do_not_depend_on_the_cut(spark):
    s = series(spark, _spiky(1445, (100, 199, 200, 450, 1440)))
    runs = [sorted((r.timestamp, round(r.baseline, 9), round(r.score, 6), r.anomaly) for r in spectral_residual(s, "k", "5 seconds", core=core).collect()) for core in (90, 200, 1440, 2000)]
    assert len(runs[0]) == 1445 and all(run == runs[0] for run in runs[1:])
    # Also where the last stretch has only a few points: the season is known from the ones before.
    assert max(b for _, b, _, _ in runs[0][-5:]) - min(b for _, b, _, _ in runs[0][-5:]) > 0.3


def test_detector_settings(spark):
    assert SpectralResidual(confidence=75).min_score == 3.0
    assert SpectralResidual(threshold=1.5).min_score == 1.5
    assert SpectralResidual(sensitivity=45).margin == 5.5
    s = series(spark, _spiky(400, (150,)))
    few, many = (spectral_residual(s, "k", "5 seconds", SpectralResidual(sensitivity=x)).where("anomaly = 1").count() for x in (10, 99))
    assert few < many
    capped = spectral_residual(s, "k", "5 seconds", SpectralResidual(sensitivity=99, threshold=0.0, max_anomaly_ratio=0.02))
    assert capped.where("anomaly = 1").count() == 8


def test_events_table_and_publish_flag(spark, folder):
    values = [2.0 + (i % 5) * 0.1 for i in range(50)]
    values[20] = 30.0
    ev = anomaly_events(decompose(series(spark, values), "k", "5 seconds", threshold=1.0), "k", "decompose")
    table = AnomalyTable(folder)
    assert table.read(spark).count() == 0
    table.write(ev, "decompose", "monday")
    table.write(ev, "decompose", "monday")
    table.write(ev.where("false"), "change", "monday")
    row = table.read(spark).collect()
    assert [(r.entity_id, r.value, r.detector, r.run, r.published) for r in row] == [("a", 30.0, "decompose", "monday", False)]
    table.publish(spark, "decompose", "monday")
    assert table.read(spark, published=True).count() == 1 and table.read(spark, published=False).count() == 0
    # A rerun that finds other dates, or nothing, replaces the run and keeps its flag; a run that died is not seen.
    table.write(ev.where("false"), "decompose", "monday")
    assert table.read(spark).count() == 0
    table.write(ev, "decompose", "monday")
    ev.drop("detector", "published").write.partitionBy("event_date").parquet(f"{folder}/data/detector=decompose/run=tuesday/attempt=dead")
    assert [(r.run, r.published) for r in table.read(spark).collect()] == [("monday", True)]


def test_evaluation_by_hand(spark):
    flags = spark.createDataFrame(
        [("x", "a", 1, True), ("x", "a", 2, True), ("x", "a", 3, False), ("y", "a", 1, True), ("y", "a", 2, False), ("y", "a", 3, False), ("x", "b", 1, False), ("y", "b", 1, False)],
        "detector string, k string, timestamp int, flagged boolean",
    )
    labels = spark.createDataFrame([("a", 1, True), ("a", 3, True)], "k string, timestamp int, faulty boolean")
    got = {(r.detector, r.k): r for r in evaluate(flags, labels, "k").collect()}
    x = got["x", "a"]
    assert (x.tp, x.fp, x.fn, x.tn, x.precision, x.recall, x.f1) == (1, 1, 1, 0, 0.5, 0.5, 0.5)
    assert got["y", "a"].precision == 1.0 and got["x", "b"].f1 is None
    best = {r.k: r.detector for r in best_detector(evaluate(flags, labels, "k"), "k").collect()}
    assert best == {"a": "y"}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 5), min_size=1, max_size=25), st.sampled_from([1, 7, 1000]))
def test_counted_median(spark, counts, width):
    df = spark.createDataFrame([("a", v, n) for v, n in counts.items()], "k string, v bigint, n bigint")
    got = counted_median(df, "k", "v", "n", width=width).first().median
    assert got == float(np.median([v for v, n in counts.items() for _ in range(n)]))
