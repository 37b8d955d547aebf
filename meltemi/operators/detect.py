"""Spectral-residual detection per entity, anomaly events, and detector evaluation."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.operators.latest import as_list
from meltemi.operators.order import with_time_slice
from meltemi.operators.series import step_index
from meltemi.session import settled


@dataclass(frozen=True)
class SpectralResidual:
    """Detector settings.

    A score is how far the saliency of a point exceeds the mean saliency before it. ``confidence`` in percent sets
    the least score (75 % gives 3, the published default) unless ``threshold`` names it. ``sensitivity`` 0 to 99 sets how many
    robust standard deviations a value must also lie off its baseline: 45 asks for 5.5, 99 for 0.1.
    """

    sensitivity: int = 45
    confidence: float = 75.0
    periodicity: int = 22
    max_anomaly_ratio: float = 0.9
    threshold: float | None = None
    smooth: int = 3
    history: int = 21
    ahead: int = 5

    @property
    def min_score(self) -> float:
        if self.threshold is not None:
            return self.threshold
        return self.confidence / max(100.0 - self.confidence, 1e-9)

    @property
    def margin(self) -> float:
        return (100 - self.sensitivity) / 10.0

    @property
    def reach(self) -> int:
        """Points on each side that a point's baseline comes from: two whole periods."""
        return max(self.history + self.ahead, 2 * self.periodicity)

    @property
    def window(self) -> int:
        """Points, up to and with the judged one, that the transform sees; ``ahead`` more lie behind it."""
        return max(self.history + 1, 2 * self.periodicity)

    @property
    def overlap(self) -> int:
        """Points beyond its own ones that a stretch needs, so that where it is cut changes nothing."""
        return 2 * self.reach + self.window


#: Points whose windows lie in memory at once.
_BLOCK = 2_048


class _Stretches:
    """Values of many stretches side by side, with room between them, so that one array operation serves all: no window reaches into a neighbour."""

    def __init__(self, starts: np.ndarray, n: int, reach: int) -> None:
        self.reach, self.size = reach, n + reach * (len(starts) + 1)
        self.place = np.arange(n) + reach * np.searchsorted(starts, np.arange(n), side="right")

    def spread(self, x: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(self.size, fill)
        out[self.place] = x
        return out

    def near(self, mark: np.ndarray) -> np.ndarray:
        """How many marked points lie within reach of each point."""
        upto = np.concatenate([[0], np.cumsum(self.spread(mark, 0.0))])
        return upto[self.place + self.reach + 1] - upto[self.place - self.reach]

    def around(self, spread: np.ndarray, points: np.ndarray, before: int, after: int) -> np.ndarray:
        """Row i: the values from ``before`` places before the i-th of ``points`` to ``after`` places behind it."""
        return np.lib.stride_tricks.sliding_window_view(spread, before + after + 1)[self.place[points] - before]


def _saliency(rows: np.ndarray, cfg: SpectralResidual) -> np.ndarray:
    """Saliency map of each row: the inverse transform of what the log spectrum has beyond its local mean."""
    spectrum = np.fft.fft(rows, axis=1)
    amplitude = np.abs(spectrum)
    quiet = amplitude < 1e-12
    safe = np.where(quiet, 1.0, amplitude)
    log_amp = np.log(safe)
    before = cfg.smooth // 2
    padded = np.pad(log_amp, ((0, 0), (before, cfg.smooth - 1 - before)), mode="edge")
    total = np.pad(np.cumsum(padded, axis=1), ((0, 0), (1, 0)))
    local = (total[:, cfg.smooth :] - total[:, : -cfg.smooth]) / cfg.smooth
    unit = np.where(quiet, 0.0, spectrum / safe)
    return np.abs(np.fft.ifft(np.exp(log_amp - local) * unit, axis=1))


def _median(rows: np.ndarray) -> np.ndarray:
    """Median of each row's known values, unknown without any. Sorting puts unknown ones last."""
    known = rows.shape[1] - np.isnan(rows).sum(axis=1)
    ordered, row = np.sort(rows, axis=1), np.arange(len(rows))
    low, high = ordered[row, np.maximum(known - 1, 0) // 2], ordered[row, np.minimum(known // 2, rows.shape[1] - 1)]
    return np.where(low == high, low, (low + high) / 2)


def _baseline(around: np.ndarray, seen: np.ndarray, cfg: SpectralResidual) -> np.ndarray:
    """Median of the same phase in the two periods on each side; the mean of what is near where a series is shorter than two periods."""
    out = np.full(len(around), np.nan)
    if cfg.periodicity > 1:
        far = seen >= 2 * cfg.periodicity
        out[far] = _median(around[far, cfg.reach % cfg.periodicity :: cfg.periodicity])
    plain = np.isnan(out)
    if plain.any():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # rows without a value
            out[plain] = np.nan_to_num(np.nanmean(around[plain], axis=1))
    return out


def _judged(
    values: np.ndarray, cfg: SpectralResidual, starts: np.ndarray | None = None, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(baseline, score, flag) of every point, each from the points around it alone. Missing values count as lying on the baseline.

    Stretches begin at ``starts`` (one stretch, if not given); only the ``wanted`` points are judged and returned.
    """
    starts = np.zeros(1, np.int64) if starts is None else starts
    wanted = np.ones(len(values), bool) if wanted is None else wanted
    all_ = _Stretches(starts, len(values), cfg.reach)
    needed, seen = np.flatnonzero(all_.near(wanted) > 0), all_.near(np.ones(len(values)))
    spread, baseline = all_.spread(values, np.nan), np.zeros(len(values))
    for k in range(0, len(needed), _BLOCK):
        part = needed[k : k + _BLOCK]
        baseline[part] = _baseline(all_.around(spread, part, cfg.reach, cfg.reach), seen[part], cfg)
    rest = np.nan_to_num(values - baseline)
    # A few points behind the judged one keep the transform from treating it as an edge; past the end they lie on the baseline.
    edged, open_ = all_.spread(rest, 0.0), all_.spread(rest, np.nan)
    at, mine = cfg.window - 1, np.flatnonzero(wanted)
    score, flag = np.zeros(len(mine)), np.zeros(len(mine), dtype=bool)
    for k in range(0, len(mine), _BLOCK):
        part, out = mine[k : k + _BLOCK], slice(k, k + _BLOCK)
        rows = all_.around(edged, part, at, cfg.ahead)
        sal = _saliency(rows, cfg)
        local = sal[:, at - cfg.history : at].mean(axis=1)
        floor = np.maximum(1e-9, 0.05 * sal.mean(axis=1))
        score[out] = np.maximum((sal[:, at] - local) / np.maximum(local, floor), 0.0)
        score[out][rows.max(axis=1) - rows.min(axis=1) < 1e-9] = 0.0
        near = all_.around(open_, part, cfg.reach, cfg.reach)
        middle = _median(near)
        margin = cfg.margin * (1.4826 * _median(np.abs(near - middle[:, None])))
        flag[out] = (score[out] >= cfg.min_score) & (np.abs(rest[part] - middle) > np.maximum(margin, 1e-9)) & ~np.isnan(values[part])
    return baseline[mine], score, flag


def spectral_residual(
    series: DataFrame,
    keys: str | Sequence[str],
    step: str,
    cfg: SpectralResidual = SpectralResidual(),
    *,
    ts: str = "timestamp",
    value: str = "value",
    core: int = 1440,
) -> DataFrame:
    """A gap-free series with ``baseline``, ``score`` and ``anomaly`` (0 or 1).

    Baseline, score and flag of a point come from a fixed number of points around it, so where the series is cut makes no difference.
    An entity's series is cut into stretches of ``core`` steps, each given with an overlap on both
    sides, so a stretch holds at most ``core + 2 * overlap`` rows whatever the entity's history, and
    a long history is spread over many tasks. Stretches arrive sorted, many to an Arrow batch; only
    core rows are returned, and only they are judged. The judged rows are written to the shared folder, as the limit on flags reads them more than once.
    """
    keys = as_list(keys)
    overlap = cfg.overlap
    core = max(core, 4 * overlap)  # a point then lies in its own stretch and at most one neighbour, and most points in no neighbour
    placed = series.select(*keys, ts, F.col(value).cast("double").alias(value), step_index(ts, step).alias("idx"))
    pos = F.col("idx") % core
    home = F.floor(F.col("idx") / core)
    stretches = F.array_compact(
        F.array(
            home,
            F.when(pos >= core - overlap, home + 1),
            F.when(pos < overlap, home - 1),
        )
    )
    spread = placed.withColumn("_home", home).withColumn("_stretch", F.explode(stretches))
    spread = spread.repartition(*[F.col(k) for k in keys], F.col("_stretch")).sortWithinPartitions(*keys, "_stretch", "idx")
    spread = spread.select(*keys, ts, value, "idx", "_home", "_stretch")
    kept = series.select(*keys, ts).schema
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{value}` double, baseline double, score double, anomaly int"
    parts = [*keys, "_stretch"]

    def judge(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        mine = (pdf["_home"] == pdf["_stretch"]).to_numpy()
        baseline, score, flag = _judged(pdf[value].to_numpy(dtype=float), cfg, starts, mine)
        return pdf.loc[mine, [*keys, ts, value]].assign(baseline=baseline, score=score, anomaly=flag.astype("int32"))

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (rows[parts] != rows[parts].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            # The last stretch of a batch may go on in the next one.
            last = starts[-1]
            held = rows.iloc[last:].reset_index(drop=True)
            if last > 0:
                yield judge(rows.iloc[:last].reset_index(drop=True), starts[:-1])
        if held is not None:
            yield judge(held, np.array([0]))

    return _strongest(settled(spread.mapInPandas(detect, out_schema), "judged"), keys, ts, cfg.max_anomaly_ratio)


def cusum(
    series: DataFrame,
    keys: str | Sequence[str],
    *,
    drift: float = 0.5,
    threshold: float = 5.0,
    ts: str = "timestamp",
    value: str = "value",
    slices: int | None = None,
) -> DataFrame:
    """A gap-free series with ``baseline`` (its mean), ``score`` and ``anomaly`` (-1, 0, 1): where a series has left its level for long rather than far.

    Two sums run along each key's series, in standard deviations: one gathers what lies more than ``drift`` above the mean and one what lies below, and neither falls below zero. The
    score is the greater one; beyond ``threshold`` it flags its side. A constant series scores 0, and a missing value moves nothing.

    A step is s -> max(0, s + d), and steps compose to s -> max(a, s + b), so a stretch of any length is two numbers: the sum of its d and the least of their running sums. Rows are
    split by (key, time slice); a window over one row per slice turns these numbers into what each slice starts from. A key with a third of all rows is so many tasks.
    """
    keys = as_list(keys)
    n = slices or int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = series.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    rows = with_time_slice(series.where(F.col(ts).isNotNull()), ts, n).join(level, keys)
    known = F.col(value).isNotNull() & (F.col("_std") > 1e-9 * F.greatest(F.lit(1.0), F.abs("_mean")))
    z = F.when(known, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    order = Window.partitionBy(*keys, "_slice").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = {"_up": z - drift, "_down": -z - drift}
    summed = rows.select("*", *[F.sum(d).over(order).alias(f"{s}_sum") for s, d in sides.items()])
    local = summed.select("*", *[F.min(f"{s}_sum").over(order).alias(f"{s}_low") for s in sides])
    whole = local.groupBy(*keys, "_slice").agg(
        *[F.max_by(f"{s}_sum", ts).alias(f"{s}_all") for s in sides], *[F.min(f"{s}_sum").alias(f"{s}_least") for s in sides]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    started = whole.select("*", *[F.coalesce(F.sum(f"{s}_all").over(earlier), F.lit(0.0)).alias(f"{s}_at") for s in sides])
    floors = [F.least(F.lit(0.0), F.min(F.col(f"{s}_at") + F.col(f"{s}_least")).over(earlier)).alias(f"{s}_floor") for s in sides]
    carried = started.select(*keys, "_slice", *[f"{s}_at" for s in sides], *floors)
    met = local.join(carried, [*keys, "_slice"])
    up, down = (F.col(f"{s}_at") + F.col(f"{s}_sum") - F.least(F.col(f"{s}_floor"), F.col(f"{s}_at") + F.col(f"{s}_low")) for s in sides)
    scored = met.select("*", F.greatest(up, down).alias("score"), F.when(up >= down, 1).otherwise(-1).alias("_side"))
    flag = F.when(F.round("score", 9) > threshold, F.col("_side")).otherwise(F.lit(0))
    return scored.select(*series.columns, F.col("_mean").alias("baseline"), "score", flag.alias("anomaly"))


def _strongest(flagged: DataFrame, keys: list[str], ts: str, ratio: float) -> DataFrame:
    """At most ``ratio`` of a key's points stay flagged: the ones that score highest, the earlier of equals. Keys below the ratio, by their counts, are left as they are and ranked nowhere."""
    counts = flagged.groupBy(*keys).agg(F.floor(F.count("*") * ratio).alias("_room"), F.count_if(F.col("anomaly") == 1).alias("_on"))
    above = counts.where("_on > _room").select(*keys, "_room")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), ts)
    weak = flagged.where("anomaly = 1").join(above, keys).withColumn("_rank", F.row_number().over(order)).where("_rank > _room")
    joined = flagged.join(weak.select(*keys, ts, F.lit(True).alias("_weak")), [*keys, ts], "left")
    return joined.withColumn("anomaly", F.when(F.col("_weak"), F.lit(0)).otherwise(F.col("anomaly"))).select(*flagged.columns)


def anomaly_events(flagged: DataFrame, entity: str, detector: str, *, ts: str = "timestamp", value: str = "value", publish: bool = False) -> DataFrame:
    """Flagged points in the layout of the anomaly table."""
    return flagged.where(F.col("anomaly") != 0).select(
        F.col(entity).alias("entity_id"),
        F.col(ts).alias("timestamp"),
        F.col(value).alias("value"),
        "score",
        "baseline",
        F.lit(detector).alias("detector"),
        F.lit(publish).alias("published"),
        F.to_date(ts).alias("event_date"),
    )


def evaluate(flags: DataFrame, labels: DataFrame, entity: str, *, ts: str = "timestamp") -> DataFrame:
    """Per detector and entity: confusion counts, precision, recall, F1.

    ``flags`` holds (detector, entity, ts, flagged), ``labels`` one row per (entity, ts) with ``faulty``;
    bins without a label count as healthy.
    """
    truth = labels.select(entity, ts, F.col("faulty").alias("_faulty"))
    rows = flags.join(truth, [entity, ts], "left").withColumn("_faulty", F.coalesce("_faulty", F.lit(False)))
    hit, bad = F.col("flagged"), F.col("_faulty")
    counts = rows.groupBy("detector", entity).agg(
        F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)))
        .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)))
        .withColumn("f1", F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)))
    )


def best_detector(scores: DataFrame, entity: str) -> DataFrame:
    """The detector with the highest F1 per entity; ties go to the first by name, none without labels or flags."""
    rank = F.struct(F.round("f1", 9).alias("f1"), F.col("detector"))
    # Smallest of (-f1, name): highest score first, then alphabetical.
    pick = F.min(F.struct((-rank["f1"]).alias("nf1"), F.col("detector").alias("detector")))
    return scores.where(F.col("f1").isNotNull()).groupBy(entity).agg(pick.alias("_b")).select(entity, F.col("_b.detector").alias("detector"), (-F.col("_b.nf1")).alias("f1"))
