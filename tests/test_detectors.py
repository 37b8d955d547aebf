"""Exact quantiles, change points, and the spectral detector against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltemi.operators.detect import SpectralResidual, _judged, cusum, spectral_residual
from meltemi.operators.quantiles import exact_quantiles
from meltemi.operators.series import decompose

T0 = datetime(2026, 4, 1)


@pytest.mark.parametrize("accuracy", [2, 10, 2000])
def test_quantiles_are_exact_whatever_the_sketch(spark, accuracy):
    rng = random.Random(accuracy)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.randrange(3)) for _ in range(500)], "one": [5.0], "two": [1.0, -1.0], "same": [2.0] * 40, "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), "k", "v", [0.0, 0.1, 0.5, 0.9], accuracy=accuracy, out=list("abcd"))
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(groups) - {"none"}
    for k, r in found.items():
        assert np.allclose([r.a, r.b, r.c, r.d], np.percentile(groups[k], [0, 10, 50, 90]), rtol=1e-12, atol=1e-12), k


def test_few_rows_are_ordered(spark):
    """Of a long series only the classes around the wanted ranks reach the window."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    got = exact_quantiles(df, "k", "v", [0.1, 0.9]).first()
    values = np.array([r.v for r in df.select("v").collect()])
    assert np.allclose([got.q0, got.q1], np.percentile(values, [10, 90]))
    borders = df.agg(F.percentile_approx("v", [0.099, 0.101, 0.899, 0.901], 2000)).first()[0]
    near = sum(((values > a) & (values <= b)).sum() for a, b in (borders[:2], borders[2:]))
    assert near < 0.01 * len(values)


def walked(values, drift):
    """(score, side) per point, one after the other."""
    known = [v for v in values if v is not None]
    mean, std = np.mean(known), np.std(known)
    up = down = 0.0
    out = []
    for v in values:
        z = 0.0 if v is None or std <= 1e-9 * max(1, abs(mean)) else (v - mean) / std
        up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
        out.append((max(up, down), 1 if up >= down else -1))
    return out


@pytest.mark.parametrize("slices", [1, 7])
def test_change_points_equal_a_walk_however_time_is_sliced(spark, slices):
    rng = np.random.default_rng(3)
    groups = {"step": [*rng.normal(0, 1, 120), *rng.normal(2.5, 1, 60)], "flat": [3.0] * 50, "drop": [*rng.normal(5, 1, 80), *rng.normal(1, 1, 40)], "gaps": [1.0, None, 2.0, None, 9.0], "one": [4.0]}
    rows = [(k, T0 + timedelta(hours=i), None if v is None else float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    series = spark.createDataFrame(rows, "k string, timestamp timestamp, value double").repartition(5)
    got = cusum(series, "k", drift=0.5, threshold=4.0, slices=slices)
    assert got.columns == ["k", "timestamp", "value", "baseline", "score", "anomaly"]
    found = {(r.k, r.timestamp): r for r in got.collect()}
    for k, values in groups.items():
        for i, (score, side) in enumerate(walked(values, 0.5)):
            r = found[k, T0 + timedelta(hours=i)]
            assert abs(r.score - score) < 1e-9 and r.anomaly == (side if round(score, 9) > 4.0 else 0)
    assert any(r.anomaly == 1 for r in found.values() if r.k == "step") and any(r.anomaly == -1 for r in found.values() if r.k == "drop")


def test_change_points_and_spikes_are_different_things(spark):
    """A lasting small shift is found by the sums and not by distance; a single spike the other way round."""
    rng = np.random.default_rng(1)
    shift = [*rng.normal(0, 1, 100), *rng.normal(1.2, 1, 100)]
    spike = list(rng.normal(0, 1, 200))
    spike[150] = 7.0
    rows = [(k, T0 + timedelta(hours=i), float(v)) for k, vs in (("shift", shift), ("spike", spike)) for i, v in enumerate(vs)]
    series = spark.createDataFrame(rows, "k string, timestamp timestamp, value double")
    sums = {r.k for r in cusum(series, "k", drift=0.25, threshold=15.0).where("anomaly <> 0").select("k").distinct().collect()}
    far = {r.k for r in decompose(series, "k", "1 hour", threshold=1.5).where("anomaly <> 0").select("k").distinct().collect()}
    assert sums == {"shift"} and far == {"spike"}


def plain_spectral(x, cfg):
    """Baseline and score of each point by sums over frequencies, medians by sorting."""
    n, reach, p = len(x), cfg.reach, cfg.periodicity
    base = []
    for i in range(n):
        near = [j for j in range(i - reach, i + reach + 1) if 0 <= j < n]
        same = [x[j] for j in near if (j - i) % p == 0]
        base.append(float(np.median(same)) if len(near) >= 2 * p else float(np.mean([x[j] for j in near])))
    rest = [a - b for a, b in zip(x, base)]
    size, at = cfg.window + cfg.ahead, cfg.window - 1
    scores = []
    for i in range(n):
        row = [rest[j] if 0 <= j < n else 0.0 for j in range(i - at, i + cfg.ahead + 1)]
        if max(row) - min(row) < 1e-9:
            scores.append(0.0)
            continue
        turns = [[np.exp(-2j * np.pi * j * k / size) for j in range(size)] for k in range(size)]
        spectrum = [sum(v * t for v, t in zip(row, turn)) for turn in turns]
        logs = [float(np.log(abs(f))) if abs(f) >= 1e-12 else 0.0 for f in spectrum]
        mean = [(logs[max(0, k - 1)] + logs[k] + logs[min(size - 1, k + 1)]) / 3 for k in range(size)]
        kept = [np.exp(a - m) * (f / abs(f) if abs(f) >= 1e-12 else 0) for a, m, f in zip(logs, mean, spectrum)]
        sal = [abs(sum(g * t.conjugate() for g, t in zip(kept, turn))) / size for turn in turns]
        local = float(np.mean(sal[at - cfg.history : at]))
        scores.append(max(0.0, (sal[at] - local) / max(local, 1e-9, 0.05 * float(np.mean(sal)))))
    return base, scores


def test_spectral_scores_equal_the_sums_written_out():
    rng = np.random.default_rng(5)
    cfg = SpectralResidual()
    x = np.sin(np.arange(120) * 2 * np.pi / 22) + rng.normal(0, 0.1, 120)
    x[70] += 6
    base, score, flag = _judged(x, cfg)
    want_base, want_score = plain_spectral(list(x), cfg)
    assert np.allclose(base, want_base) and np.allclose(score, want_score, atol=1e-8)
    assert flag[70] and flag.sum() <= 3
    assert _judged(np.full(60, 2.0), cfg)[2].sum() == 0


def test_stretches_side_by_side_equal_each_alone():
    rng = np.random.default_rng(4)
    for cfg in (SpectralResidual(), SpectralResidual(sensitivity=85, threshold=1.0), SpectralResidual(periodicity=1)):
        parts = [rng.normal(size=n) for n in (1, 30, 120, 300, 2_500)] + [np.full(60, np.nan), np.zeros(90)]
        parts[3][rng.random(300) < 0.2] = np.nan
        wanted = rng.random(sum(map(len, parts))) < 0.5
        starts = np.cumsum([0, *map(len, parts[:-1])])
        got = _judged(np.concatenate(parts), cfg, starts, wanted)
        for one, each in zip(got, zip(*[_judged(x, cfg) for x in parts])):
            assert np.allclose(one.astype(float), np.concatenate(each)[wanted].astype(float), rtol=0, atol=1e-12, equal_nan=True)


def test_points_are_judged_once(spark):
    rows = spark.range(200).selectExpr("id % 2 as k", "timestamp_seconds(3600 * (id div 2)) as timestamp", "double(id % 7) as value")
    out = spectral_residual(rows, "k", "1 hour")
    # The limit on flags counts, ranks and joins what was judged: none of these judges again.
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
    assert out.count() == 200
