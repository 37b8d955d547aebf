import json
import os

from pyspark.sql import functions as F

from meltemi.sources import geojson, reference, store, wire
from meltemi.sources.schemas import FEEDS, REFERENCE
from meltemi.streaming import ingest

WIND = {"timestamp": "2026-04-14T10:00:00.123456+00:00", "stream_type": "WindTurbineTelemetry", "turbine_id": "WT-1", "power_mw": 1.5, "fault_type": "NONE"}


def lines(spark, *objs):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objs], "value string")


def test_routes_and_quarantine(spark):
    raw = lines(
        spark,
        WIND,
        {**WIND, "timestamp": "2026-04-14T12:00:00+02:00", "surprise": 1},
        {"timestamp": "2026-04-14T10:00:00+00:00", "stream_type": "GridTelemetry", "grid_id": "GR-MAIN", "frequency_hz": 50},
        {"stream_type": "Unknown", "timestamp": "2026-04-14T10:00:00+00:00"},
        "not json",
        {**WIND, "power_mw": "broken"},
        {**WIND, "timestamp": "yesterday"},
    )
    rows = wire.typed(raw)
    fed = wire.routes(rows)
    wind = fed["wind"].orderBy("timestamp").collect()
    assert [r.turbine_id for r in wind] == ["WT-1", "WT-1"]
    assert fed["wind"].columns == FEEDS["wind"].schema.names
    # An absent path is NULL; the offset is honoured, with and without a fraction.
    assert wind[0].vibration_mm_s is None
    stamps = [r[0] for r in fed["wind"].select(F.col("timestamp").cast("string")).orderBy("timestamp").collect()]
    assert stamps == ["2026-04-14 10:00:00", "2026-04-14 10:00:00.123456"]
    assert fed["grid"].first().frequency_hz == 50.0
    assert fed["solar"].count() == 0
    reasons = {r.raw: r.reason for r in wire.quarantine(rows).collect()}
    assert len(reasons) == 4
    assert reasons["not json"] == "malformed"
    assert sorted(reasons.values()) == ["does not fit the schema", "does not fit the schema", "malformed", "unknown stream_type"]


def test_wire_round_trip_keeps_microseconds(spark):
    df = spark.sql("select timestamp'2026-04-14 10:00:00.123456' as timestamp, 'WindTurbineTelemetry' as stream_type, 'WT-1' as turbine_id, 2.5D as power_mw")
    back = wire.parsed_feed(wire.as_wire(df), FEEDS["wind"])
    assert back.select("timestamp", "power_mw").collect() == df.select("timestamp", "power_mw").collect()


def test_the_text_is_parsed_once(spark):
    plan = wire.routes(wire.typed(lines(spark, WIND)))["wind"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_reference_csv(spark, folder):
    os.makedirs(folder)
    header = ",".join(REFERENCE["emissions_ledger"].names)
    with open(f"{folder}/emissions_ledger.csv", "w") as f:
        f.write(header + "\nr1,plant-x,Invented Plant,2026-01,1234,2000,3500,0.3,61.7,Compliant\nr2,plant-x,x,2026-02,bad,,,0.3,,\n")
    schemas = {"emissions_ledger": REFERENCE["emissions_ledger"]}
    for _ in range(2):
        reference.load_reference(spark, folder, f"{folder}/out", schemas=schemas)
    rows = spark.read.parquet(f"{folder}/out/emissions_ledger").orderBy("record_id").collect()
    assert [r.period for r in rows] == ["2026-01", "2026-02"]
    assert rows[0].co2_tonnes == 1234.0 and rows[1].co2_tonnes is None


def test_append_merge_retention(spark, folder):
    day1 = spark.sql("select timestamp'2026-04-13 09:00:00' as timestamp, 'a' as k, 1.0D as x")
    day2 = spark.sql("select timestamp'2026-04-14 10:00:00' as timestamp, 'b' as k, 2.0D as y")
    store.append(day1, folder)
    store.append(day2, folder)
    events = store.read_events(spark, folder)
    assert set(events.columns) == {"timestamp", "k", "x", "y", "event_date"}
    as_of = F.lit("2026-04-14 10:00:00").cast("timestamp")
    kept = store.retained(events, as_of, "1 day")
    assert [r.k for r in kept.collect()] == ["b"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    store.apply_retention(spark, folder, as_of, folder + "-kept")
    assert spark.read.parquet(folder + "-kept").count() == 1


def test_union_by_name_fills_missing(spark):
    got = wire.merged(spark.sql("select 1 as a"), spark.sql("select 2 as b")).collect()
    assert [(r.a, r.b) for r in got] == [(1, None), (None, 2)]


def test_geojson(spark):
    df = spark.sql("select 'S1' as id, 37.5D as latitude, 24.0D as longitude union all select 'S2', null, 1.0D")
    got = [json.loads(r.value) for r in geojson.features(df).collect()]
    assert got == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [24.0, 37.5]}, "properties": {"id": "S1"}}]


def test_skipping_lines_of_other_feeds_is_safe(spark):
    escaped = json.dumps(WIND).replace("WindTurbine", "\\u0057indTurbine")
    got = wire.parsed_feed(lines(spark, WIND, escaped, {"stream_type": "GridTelemetry", "note": "WindTurbineTelemetry", "timestamp": WIND["timestamp"]}), FEEDS["wind"])
    assert got.count() == 2


def test_absent_text_is_malformed(spark):
    raw = spark.createDataFrame([(None,), ("",), ("[]",), ("{}",)], "value string")
    rows = wire.typed(raw)
    assert {r.reason for r in wire.quarantine(rows).collect()} == {"malformed"}
    assert wire.quarantine(rows).count() == 4
    assert all(df.count() == 0 for df in wire.routes(rows).values())


def test_csv_columns_are_matched_by_name(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/g.csv", "w") as f:
        f.write("grid_name,grid_id,population,interconnected,extra\nNaxos Grid,GR-NAX,20000,true,x\n")
    row = reference.read_reference_csv(spark, f"{folder}/g.csv", "island_grids").first()
    assert (row.grid_id, row.grid_name, row.population, row.interconnected, row.region) == ("GR-NAX", "Naxos Grid", 20000, True, None)


def test_compaction_keeps_rows_and_other_days(spark, folder):
    events = spark.range(600).selectExpr("timestamp_seconds(1776000000 + id * 300) as timestamp", "cast(id % 3 = 0 as string) as turbine_id", "id")
    for n in range(3):
        ingest.write_batch(events.where(F.col("id") % 3 == n), f"{folder}/in", n)
    table = store.read_events(spark, f"{folder}/in")
    days = sorted(str(r[0]) for r in table.select("event_date").distinct().collect())
    assert len(days) >= 2
    for day in days:
        store.compact_day(spark, f"{folder}/in", day, f"{folder}/out", order=("turbine_id", "timestamp"), rows_per_file=100)
    out = store.read_events(spark, f"{folder}/out")
    assert sorted(out.select(*table.drop("ingest_batch").columns).collect()) == sorted(table.drop("ingest_batch").collect())
    files = len([f for f in os.listdir(f"{folder}/out/event_date={days[1]}") if f.endswith(".parquet")])
    assert files == 3


def test_written_layers_come_back(spark, folder):
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "id string, latitude double, longitude double")
    for _ in range(2):
        geojson.write_layers({"one": points, "two": points.limit(0)}, folder)
    rows = geojson.read_layers(spark, folder).collect()
    assert [(r.layer, json.loads(r.value)["geometry"]["coordinates"]) for r in rows] == [("one", [2.0, 1.0])]
