"""Registry of the streaming forms: the events table read as a bounded stream, the result read back from the sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock
from meltemi.functions.text import FORCED_FAILURE
from meltemi.operators.dispatch import dispatch_orders
from meltemi.plans import sf
from meltemi.plans.sf import SfTables
from meltemi.plans.sf_operators import CHANGES_SQL, F07_SQL, F07_VIEWS, HISTORY_SQL, busy_turbines, wire_of
from meltemi.plans import questions as g
from meltemi.plans.sf_queries import REGISTRY, Query, add
from meltemi.session import shared_dir
from meltemi.sources.parts import PartTable
from meltemi.streaming import ingest, state
from meltemi.streaming.keyed_alerts import PROVIDER, KeyedAlerts, with_end
from meltemi.streaming.live import LiveTable
from meltemi.operators.orders import well_again
from meltemi.streaming.alerts import ChangeAlerts, dispatch_sink
from meltemi.streaming.orders import OrderLedger


def stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, bound like the batch table; event time gets a zone so that watermarks accept it.

    The pattern matches this one name, whether it is a file or a folder of files.
    """
    schema = sf.read_table(spark, f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def _plain(df: DataFrame, *cols: str) -> DataFrame:
    """Times back without a zone, as the batch tables have them."""

    def one(c: str) -> Column:
        return F.col(c).cast("timestamp_ntz").alias(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c)

    return df.select(*[one(c) for c in (cols or df.columns)])


def _routed(t: SfTables, c: Clock) -> DataFrame:
    base = shared_dir(t.spark, "ingest")
    ev = stream_of_events(t.spark, t.sf_dir)
    feeds = {"wind": sf.wind(ev), "solar": sf.solar(ev), "emissions": sf.emissions(ev), "vessel_positions": sf.vessel_positions(ev), "grid": sf.grid(ev, t.raw("region"))}
    raw = wire_of(feeds)
    ingest.route_to_tables(raw, f"{base}/tables", f"{base}/checkpoint", available_now=True).awaitTermination()
    parts = [
        t.spark.read.parquet(f"{base}/tables/{name}").groupBy("stream_type", F.col("event_date").cast("date").alias("event_date")).agg(F.count("*").alias("n"))
        for name in feeds
    ]
    return reduce(DataFrame.unionByName, parts)


add(
    "A04_stream_to_tables",
    _routed,
    "wind solar gas pos grid",
    " union all ".join(
        f"select stream_type, date_trunc('day', timestamp)::timestamp as event_date, count(*) as n from {v} group by 1, 2" for v in ("wind", "solar", "gas", "pos", "grid")
    ),
)


def _folded(t: SfTables, c: Clock) -> DataFrame:
    """Wind telemetry in six micro-batches, folded three at a time into parts."""
    base = shared_dir(t.spark, "folded")
    rows = t["wind"]
    rows.repartition(6).write.parquet(f"{base}/arrivals")
    table = PartTable(f"{base}/table", rows.schema, order=("turbine_id", "timestamp"), fan=3, levels=2)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrivals")
    ingest.started(stream.writeStream.foreachBatch(table.commit), f"{base}/checkpoint", available_now=True).awaitTermination()
    return table.read(t.spark).groupBy("turbine_id", F.col("event_date").cast("timestamp_ntz").alias("event_date")).agg(F.count("*").alias("n"))


add(
    "A04_stream_folded_table",
    _folded,
    "wind",
    "select turbine_id, date_trunc('day', timestamp)::timestamp as event_date, count(*) as n from wind group by 1, 2",
)


def _deduplicated(t: SfTables, c: Clock) -> DataFrame:
    """Every event delivered twice, counted once."""
    base = shared_dir(t.spark, "dedup")
    ev = stream_of_events(t.spark, t.sf_dir)
    twice = ev.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = ingest.deduplicated(twice, "user_id", delay="1 hour")
    ingest.started(once.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint", available_now=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


add("A10_stream_deduplicated", _deduplicated, "ev", "select user_id, event_type, count(*) as n from ev group by 1, 2")


def _latest(t: SfTables, c: Clock) -> DataFrame:
    base = shared_dir(t.spark, "latest")
    ev = stream_of_events(t.spark, t.sf_dir)
    state.latest_to_table(ev, "user_id", f"{base}/out", f"{base}/checkpoint", cols=["event_type", "value"], available_now=True).awaitTermination()
    return _plain(state.current(t.spark, f"{base}/out", "user_id"), "user_id", "timestamp", "event_type", "value")


add(
    "C01_stream_latest",
    _latest,
    "ev",
    "select user_id, max(timestamp) as timestamp, arg_max(event_type, timestamp) as event_type, arg_max(value, timestamp) as value from ev group by 1",
)


def _buckets(t: SfTables, c: Clock) -> DataFrame:
    base = shared_dir(t.spark, "buckets")
    ev = stream_of_events(t.spark, t.sf_dir)
    aggs = {"n": F.count("*"), "mean": F.avg("value")}
    state.buckets_to_table(ev, "1 hour", aggs, f"{base}/out", f"{base}/checkpoint", keys=["event_type"], delay="1 hour", available_now=True).awaitTermination()
    return _plain(t.spark.read.parquet(f"{base}/out"))


add(
    "C05_stream_buckets",
    _buckets,
    "ev",
    # A bucket is final once the newest event is a watermark delay past its end.
    """select time_bucket(interval 1 hour, timestamp) as timestamp, event_type, count(*) as n, avg(value) as mean from ev group by 1, 2
       having time_bucket(interval 1 hour, timestamp) + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
    "mean",
)


def _alerts(t: SfTables, c: Clock) -> DataFrame:
    base = shared_dir(t.spark, "alerts")
    job = ChangeAlerts(f"{base}/state", "user_id", F.col("event_type") == "error", tiebreak=["event_id"], delay="1 hour")
    query = job.start(stream_of_events(t.spark, t.sf_dir), f"{base}/checkpoint", available_now=True)
    query.awaitTermination()
    job.finish(t.spark, query)
    return _plain(job.alerts(t.spark).drop("batch"))


add("F05_stream_alerts", _alerts, "ev", CHANGES_SQL)


def _condition_alerts(t: SfTables, condition: Column) -> DataFrame:
    """Events at which a condition on a turbine's reading turns true, over the stream."""
    base = shared_dir(t.spark, "conditions")
    job = ChangeAlerts(f"{base}/state", "turbine_id", condition, tiebreak=["event_id"], delay="1 hour")
    wind = sf.wind(stream_of_events(t.spark, t.sf_dir)).select("event_id", "timestamp", "turbine_id", "vibration_mm_s", "power_mw")
    query = job.start(wind, f"{base}/checkpoint", available_now=True)
    query.awaitTermination()
    job.finish(t.spark, query)
    return job.alerts(t.spark)


add(
    "F06_stream_threshold",
    lambda t, c: _condition_alerts(t, F.col("vibration_mm_s") > 7.0).select("event_id", "turbine_id", "vibration_mm_s"),
    "wind",
    """select event_id, turbine_id, vibration_mm_s from (select *, lag(vibration_mm_s) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
       where vibration_mm_s > 7 and prev <= 7""",
)
add(
    "F06_stream_becomes_zero",
    lambda t, c: _condition_alerts(t, F.col("power_mw") == 0).select("event_id", "turbine_id"),
    "wind",
    """select event_id, turbine_id from (select *, lag(power_mw) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
       where power_mw = 0 and prev <> 0""",
)


def _dispatch(t: SfTables, c: Clock) -> DataFrame:
    base = shared_dir(t.spark, "dispatch")

    def orders(alerts: DataFrame, earlier: DataFrame | None) -> DataFrame:
        taken = busy_turbines(t) if earlier is None else busy_turbines(t).unionByName(earlier)
        return dispatch_orders(alerts, t["service_vessels"], asset="turbine_id", open_orders=taken)

    job = ChangeAlerts(
        f"{base}/state",
        "turbine_id",
        F.col("fault_type") == FORCED_FAILURE,
        tiebreak=["event_id"],
        delay="1 hour",
        on_alerts=dispatch_sink(base, orders, "turbine_id"),
    )
    wind = sf.wind(stream_of_events(t.spark, t.sf_dir)).select("event_id", "timestamp", "turbine_id", "fault_type", "latitude", "longitude")
    query = job.start(wind, f"{base}/checkpoint", available_now=True)
    query.awaitTermination()
    job.finish(t.spark, query)
    return _plain(t.spark.read.parquet(f"{base}/orders").drop("batch"))


add("F07_stream_dispatch", _dispatch, F07_VIEWS, F07_SQL, "target_lat,target_lon,distance_nm")


def _closed_orders(t: SfTables, c: Clock) -> DataFrame:
    """The order table of a stream of readings: alerts open orders, healthy readings close them."""
    base = shared_dir(t.spark, "ledger")
    wind = sf.wind(stream_of_events(t.spark, t.sf_dir)).select("event_id", "timestamp", "turbine_id", "fault_type", "vibration_mm_s", "latitude", "longitude")
    ledger = OrderLedger(base, "turbine_id", t["wind_turbines"].schema["turbine_id"].dataType, t["service_vessels"], well_again())
    job = ChangeAlerts(
        f"{base}/state", "turbine_id", F.col("fault_type") == FORCED_FAILURE, tiebreak=["event_id"], delay="1 hour", on_released=ledger.process
    )
    query = job.start(wind, f"{base}/checkpoint", available_now=True)
    query.awaitTermination()
    job.finish(t.spark, query)
    return _plain(ledger.orders(t.spark).withColumnsRenamed({"latitude": "target_lat", "longitude": "target_lon"}))


add("F07_stream_closed_orders", _closed_orders, F07_VIEWS, HISTORY_SQL, "target_lat,target_lon,distance_nm")


#: Feeds that questions about now read, with their keys.
_LIVE_KEYS = {"wind": "turbine_id", "solar": "inverter_id", "vessel_positions": "vessel_id", "grid": "grid_id"}


def with_live(t: SfTables, feed: str) -> dict[str, DataFrame]:
    """The tables, with a live table in place of one feed's history: a stream reduces the events, as they come, to a row per asset."""
    base = shared_dir(t.spark, "live")
    ev = stream_of_events(t.spark, t.sf_dir)
    rows = sf.grid(ev, t.raw("region")) if feed == "grid" else {"wind": sf.wind, "solar": sf.solar, "vessel_positions": sf.vessel_positions}[feed](ev)
    live = LiveTable(base, _LIVE_KEYS[feed], rows.schema)
    live.start(rows, f"{base}/checkpoint", available_now=True).awaitTermination()
    return {**{name: t[name] for name in ("power_plants", "wind_turbines", "solar_inverters", "island_grids", "vessels", "substations")}, feed: _plain(live.read(t.spark))}


def _ask_live(name: str, build: Callable[[Mapping[str, DataFrame]], DataFrame], feed: str) -> None:
    """A question asked of the live table; the answer is that of the whole history."""
    twin = next(q for n, q in REGISTRY.items() if n.startswith(name[:4]))
    REGISTRY[name] = Query(lambda t, c: build(with_live(t, feed)), twin.sql)


_ask_live("G13_live_vessel_positions", g.g13_vessel_positions, "vessel_positions")
_ask_live("G14_live_turbine_power", g.g14_turbine_power, "wind")
_ask_live("G15_live_inverter_power", g.g15_inverter_power, "solar")
_ask_live("G16_live_vessel_courses", g.g16_vessel_courses, "vessel_positions")
_ask_live("G17_live_turbine_wind", g.g17_turbine_wind, "wind")
_ask_live("G18_live_inverter_irradiance", g.g18_inverter_irradiance, "solar")
_ask_live("G27_live_wind_farm_power", g.g27_wind_farm_power, "wind")
_ask_live("G19_live_grid_state", g.g19_grid_state, "grid")


def _keyed_alerts(t: SfTables, events: DataFrame, key: str, condition: Column) -> DataFrame:
    """Change alerts from keyed state; the state store is set for this query alone."""
    base = shared_dir(t.spark, "keyed-alerts")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(setting, None)
    t.spark.conf.set(setting, PROVIDER)
    try:
        job = KeyedAlerts(key, condition, tiebreak="event_id", delay="1 hour")
        job.start(with_end(events, f"{base}/end"), f"{base}/alerts", f"{base}/checkpoint", available_now=True).awaitTermination()
    finally:
        t.spark.conf.unset(setting) if before is None else t.spark.conf.set(setting, before)
    return _plain(t.spark.read.schema(events.schema).parquet(f"{base}/alerts"))


add("F05_keyed_alerts", lambda t, c: _keyed_alerts(t, stream_of_events(t.spark, t.sf_dir), "user_id", F.col("event_type") == "error"), "ev", CHANGES_SQL)
add(
    "F06_keyed_threshold",
    lambda t, c: _keyed_alerts(
        t, sf.wind(stream_of_events(t.spark, t.sf_dir)).select("event_id", "timestamp", "turbine_id", "vibration_mm_s"), "turbine_id", F.col("vibration_mm_s") > 7.0
    ).select("event_id", "turbine_id", "vibration_mm_s"),
    "wind",
    """select event_id, turbine_id, vibration_mm_s from (select *, lag(vibration_mm_s) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
       where vibration_mm_s > 7 and prev <= 7""",
)
