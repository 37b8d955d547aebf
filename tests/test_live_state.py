"""Live tables and alerts from keyed state: any split and any order of arrival gives the batch answer."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meltemi.operators.alerts import becomes
from meltemi.operators.latest import latest
from meltemi.plans.registry import REGISTRY
from meltemi.streaming.keyed_alerts import PROVIDER, KeyedAlerts, _Changes
from meltemi.streaming.live import LiveTable

T0 = datetime(2026, 4, 14, 10)
KIND = "k string, timestamp timestamp, label string, seq long"


def made(spark, seed, n=80, spread=15):
    rng = random.Random(seed)
    return [(rng.choice("aaab"), T0 + timedelta(seconds=i + rng.randrange(spread)), rng.choice(["F", "NONE", None]), i) for i in range(n)]


def test_live_table_is_the_newest_row_whatever_comes_when(spark, folder):
    rows = made(spark, 1)
    frame = spark.createDataFrame(rows, KIND)
    live = LiveTable(folder, "k", frame.schema, buckets=4)
    for n, (a, b) in enumerate([(40, 80), (0, 20), (20, 40)]):
        live.process(frame.where(F.col("seq").between(a, b - 1)), n)
    live.process(frame.where(F.col("seq").between(20, 39)), 2)
    want = latest(frame, "k", cols=["label", "seq"])
    assert sorted(map(tuple, live.read(spark).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_live_questions_do_not_read_the_history(spark):
    df = REGISTRY["G19_live_grid_state"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and not [f for f in df.inputFiles() if "events" in f]


@pytest.fixture
def keyed(spark):
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, PROVIDER)
    yield spark
    spark.conf.unset(setting)


def test_keyed_alerts_equal_batch(keyed, tmp_path):
    """Four files, one a trigger, rows up to 15 s out of order, an object without a key, stopped and started again; the delay covers the disorder."""
    rows = made(keyed, 3)
    frame = keyed.createDataFrame(rows + [(None, t, x, 1000 + i) for _, t, x, i in rows[:10]], KIND).withColumn("seq", F.col("seq") % 1000)
    for n in range(4):
        frame.where(F.col("seq").between(20 * n, 20 * n + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = keyed.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = KeyedAlerts("k", F.col("label") == "F", tiebreak="seq", delay="100 seconds")
    job.start(events, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    # The end comes in a later run, from the checkpoint.
    end = frame.limit(0).unionByName(keyed.createDataFrame([("end", datetime(2200, 1, 1), None, None)], KIND))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job.start(events, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = sorted(map(tuple, keyed.read.schema(frame.schema).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, becomes(frame, "k", F.col("label") == "F", tiebreak="seq").collect()), key=str)


def test_keyed_alerts_ask_for_their_state_store(spark):
    with pytest.raises(ValueError, match="providerClass"):
        KeyedAlerts("k", F.col("label") == "F").alerts(spark.createDataFrame([], KIND))


class _Handle:
    """State of one bucket in plain lists, with a count of the calls made for it."""

    def __init__(self):
        self.calls, self.rows, self.last, self.timers = 0, [], {}, []

    def _called(self, done=None):
        self.calls += 1
        return done

    def getMapState(self, *_):
        return SimpleNamespace(getValue=lambda k: self._called(self.last.get(k)), updateValue=lambda k, v: self._called(self.last.__setitem__(k, v)))

    def getListState(self, *_):
        return SimpleNamespace(get=lambda: self._called(iter(list(self.rows))), appendValue=lambda v: self._called(self.rows.append(v)), clear=lambda: self._called(self.rows.clear()))

    def registerTimer(self, at):
        self._called(self.timers.append(at))


def test_keyed_alerts_call_the_state_by_the_object_not_by_the_row():
    rng, handle = random.Random(8), _Handle()
    one = _Changes(False)
    one.init(handle)
    rows = [(f"o{i % 5}", 1_000 * rng.randrange(400), i, rng.random() < 0.5) for i in range(1_000)]
    batches = (pd.DataFrame([(*r, f"r{r[2]}" if r[3] else None) for r in part], columns=["object", "at", "tie", "on_", "row"]) for part in (rows[:500], rows[500:]))
    assert list(one.handleInputRows((0,), batches, None)) == [] and handle.calls == 3 and handle.timers == [min(r[1] for r in rows) // 1000]
    fired = []
    for upto in (150, 400, 500):
        out = one.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda upto=upto: upto), None)
        fired += [r for frame in out for r in frame["row"]]
    expected = []
    for name in {r[0] for r in rows}:
        was = True
        for _, _, i, on in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3]):
            expected += [f"r{i}"] if on and not was else []
            was = on
    assert sorted(fired) == sorted(expected) and not handle.rows and handle.calls < 50
