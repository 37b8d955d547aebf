"""Registry of the operators themselves on the test tables: sources, primitives, entities, detection and analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock, within
from meltemi.functions.numbers import above, kw_to_mw, rounded, share, total
from meltemi.functions.terms import ENUMS, apply_term, under_way, unknown_values
from meltemi.functions.text import FORCED_FAILURE, by_prefix, differs, fault_category, fault_label, fault_severity, is_empty
from meltemi.operators import alerts, assets, detect, dispatch, emissions, graph, orders, proximity, tracks
from meltemi.operators.entities import entity_view, follow, live_values
from meltemi.operators.latest import distinct_keys, latest, newest
from meltemi.operators.series import bucketed, decompose, detect_period, make_series
from meltemi.plans import tiles
from meltemi.plans.ontology import ENTITIES, ONTOLOGY
from meltemi.plans.sf import SfTables
from meltemi.plans.sf_queries import add, cusum_sql, decompose_sql, linear_sql, series_sql, spectral_sql
from meltemi.plans.sf_views import distance, r, since
from meltemi.session import settled, shared_dir
from meltemi.sources import anomalies, geojson, reference, store, wire
from meltemi.sources.schemas import FEEDS, REFERENCE

# ---- A: sources and sinks (batch forms; the streams are registered in sf_streams) ----


def wire_of(feeds: dict[str, DataFrame]) -> DataFrame:
    """Events of several feeds as one column of JSON text, keys as text as on the wire."""
    out: DataFrame | None = None
    for name, rows in feeds.items():
        key = FEEDS[name].key
        part = wire.as_wire(rows.withColumn(key, F.col(key).cast("string")).drop("event_id"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def wire_text(t: SfTables) -> DataFrame:
    return wire_of({name: t[name] for name in FEEDS})


def _routed_totals(t: SfTables, c: Clock) -> DataFrame:
    """Events, a channel's sum and the first time per route; the text is parsed once for all routes."""
    rows = wire.typed(wire_text(t))
    channel = {"wind": "vibration_mm_s", "solar": "irradiance_wm2", "vessel_positions": "speed_knots", "emissions": "cumulative_co2_tonnes_today", "grid": "voltage_kv"}
    reading: Column | None = None
    for name, col in channel.items():
        hit = F.col("stream_type") == FEEDS[name].stream_type
        reading = F.when(hit, F.col(col)) if reading is None else reading.when(hit, F.col(col))
    return rows.where(F.col("stream_type").isin(*[f.stream_type for f in FEEDS.values()])).groupBy("stream_type").agg(
        F.count("*").alias("n"), F.sum(reading).alias("total"), F.min(F.col("timestamp").cast("timestamp_ntz")).alias("first")
    )


_TOTALS = " union all ".join(
    f"select stream_type, count(*) as n, sum({col}) as total, min(timestamp) as first from {view} group by 1"
    for view, col in (("wind", "vibration_mm_s"), ("solar", "irradiance_wm2"), ("pos", "speed_knots"), ("gas", "cumulative_co2_tonnes_today"), ("grid", "voltage_kv"))
)
add("A02_route_by_discriminator", _routed_totals, "wind solar pos gas grid", _TOTALS, "total")
_CHANNELS = {"wind": ("wind", "vibration_mm_s"), "solar": ("solar", "irradiance_wm2"), "vessel_positions": ("pos", "speed_knots"), "emissions": ("gas", "cumulative_co2_tonnes_today"), "grid": ("grid", "voltage_kv")}
add(
    "A01_json_events",
    # All five feeds, each through its own JSON text and schema.
    lambda t, c: reduce(
        DataFrame.unionByName,
        [
            wire.parsed_feed(wire_of({name: t[name]}), FEEDS[name]).select(
                "stream_type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col(FEEDS[name].key).alias("asset"), F.col(channel).cast("double").alias("reading")
            )
            for name, (_, channel) in _CHANNELS.items()
        ],
    ),
    "wind solar pos gas grid",
    " union all ".join(f"select stream_type, timestamp, {FEEDS[n].key}::varchar as asset, {col}::double as reading from {view}" for n, (view, col) in _CHANNELS.items()),
    "reading",
)
add(
    "A03_schema_on_write",
    # Text with an offset, a column the feed does not know, and a column left out.
    lambda t, c: wire.parsed_feed(
        t["solar"].select(
            F.to_json(
                F.struct(
                    F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
                    "stream_type",
                    F.col("inverter_id").cast("string").alias("inverter_id"),
                    "power_kw",
                    F.lit("extra").alias("unknown_field"),
                )
            ).alias("value")
        ),
        FEEDS["solar"],
    ).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "inverter_id", "power_kw", "irradiance_wm2"),
    "solar",
    "select timestamp, inverter_id::varchar as inverter_id, power_kw, null::double as irradiance_wm2 from solar",
    "power_kw",
)


def _csv_round_trip(t: SfTables, tables: list[str]) -> dict[str, DataFrame]:
    """Tables written as CSV, then loaded through the typed reader and its overwriting table write."""
    spark = t.spark
    base = shared_dir(spark, "reference")
    schemas = {name: REFERENCE[name] for name in tables}
    for name, schema in schemas.items():
        rows = t[name]
        filled = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in schema])
        filled.write.csv(f"{base}/csv/{name}.csv", header=True)
    reference.load_reference(spark, f"{base}/csv", f"{base}/tables", schemas=schemas)
    return {name: spark.read.schema(schema).parquet(f"{base}/tables/{name}") for name, schema in schemas.items()}


add(
    "A05_reference_csv",
    lambda t, c: _csv_round_trip(t, ["maintenance_orders"])["maintenance_orders"].select(
        "order_id", "priority", "status", "asset_id", "plant_id", "created_date", "completed_date", "cost_eur"
    ),
    "maintenance_orders",
    """select order_id::varchar as order_id, priority, status, asset_id::varchar as asset_id, plant_id::varchar as plant_id,
       created_date::timestamp as created_date, completed_date::timestamp as completed_date, cost_eur from maintenance_orders""",
)
add(
    "A05_all_reference_tables",
    # Every row of all eight tables by its key, which is each table's first column.
    lambda t, c: reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("reference"), F.col(REFERENCE[name][0].name).alias("key")) for name, df in _csv_round_trip(t, list(REFERENCE)).items()],
    ),
    " ".join(REFERENCE),
    " union all ".join(f"select '{name}' as reference, {schema[0].name}::varchar as key from {name}" for name, schema in REFERENCE.items()),
)
add(
    "A06_schema_merge",
    lambda t, c: wire.merged(
        t["wind"].select("event_id", "timestamp", "stream_type", "vibration_mm_s", "fault_type"),
        t["solar"].select("event_id", "timestamp", "stream_type", "irradiance_wm2", "fault_type"),
    ),
    "wind solar",
    """select event_id, timestamp, stream_type, vibration_mm_s, fault_type, null::double as irradiance_wm2 from wind
       union all select event_id, timestamp, stream_type, null, fault_type, irradiance_wm2 from solar""",
)
add(
    "A07_retention",
    lambda t, c: store.retained(t["events"], c.as_of, "1 day").select("event_id", "timestamp", "event_type"),
    "ev",
    "select event_id, timestamp, event_type from ev where timestamp >= (select max(ts) from events) - interval 1 day",
)
add(
    "A08_geojson_layer",
    lambda t, c: geojson.features(t["substations"], properties=["substation_id", "substation_name"]),
    "substations",
    """select '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']},"properties":{"substation_id":'
       || substation_id || ',"substation_name":"' || substation_name || '"}}' as value from substations""",
)
def _map_layers(t: SfTables) -> DataFrame:
    """Both point layers written as files and read back. The given tables place no grids; here their number does."""
    base = shared_dir(t.spark, "map")
    grids = t["island_grids"].withColumn("latitude", F.lit(35.0) + F.col("grid_id")).withColumn("longitude", F.lit(20.0) + F.col("grid_id"))
    layers = {"substations": (t["substations"], "substation"), "island_grids": (grids, "grid")}
    geojson.write_layers({n: df.select("latitude", "longitude", F.col(f"{k}_id").alias("id"), F.col(f"{k}_name").alias("name")) for n, (df, k) in layers.items()}, base)
    kind = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<id: bigint, name: string>"
    feature = geojson.read_layers(t.spark, base).withColumn("f", F.from_json("value", kind))
    place = F.col("f.geometry.coordinates")
    return feature.select("layer", F.col("f.properties.id").alias("id"), F.col("f.properties.name").alias("name"), place[0].alias("longitude"), place[1].alias("latitude"))


add(
    "A08_map_layers",
    lambda t, c: _map_layers(t),
    "substations island_grids",
    """select 'substations' as layer, substation_id as id, substation_name as name, longitude, latitude from substations
       union all select 'island_grids', grid_id, grid_name, 20.0 + grid_id, 35.0 + grid_id from island_grids""",
)
add(
    "A09_ingest_health",
    lambda t, c: store.ingest_health(t["events"].withColumnRenamed("event_type", "stream_type").withColumnRenamed("value", "power_mw"), c),
    "ev",
    f"select event_type as stream_type, count(*) as n, count(*) filter (where value > 0) as nonzero from ev where {since('2m')} group by 1",
)

# ---- B: filters, projections, scalar functions ----

add(
    "B01_lookback",
    lambda t, c: within(t["events"], c, "30s").select("event_id", "timestamp"),
    "ev",
    f"select event_id, timestamp from ev where {since('30s')}",
)
add(
    "B02_string_equality",
    lambda t, c: t["solar"].where(differs("fault_type", "panel_soiling_or_string_fault")).groupBy("fault_type").agg(F.count("*").alias("n")),
    "solar",
    "select fault_type, count(*) as n from solar where coalesce(fault_type, '') <> 'panel_soiling_or_string_fault' group by 1",
)
add(
    "B03_is_empty",
    lambda t, c: t["emissions"].groupBy(is_empty("fault_type").alias("healthy")).agg(F.count("*").alias("n")),
    "gas",
    "select fault_type is null or fault_type = '' as healthy, count(*) as n from gas group by 1",
)
add(
    "B04_prefix_classes",
    lambda t, c: t["wind_turbines"].groupBy(by_prefix("turbine_name", {"CUSTOMER#00000000": "first ten", "customer#0000000": "first hundred"}, "other").alias("class")).agg(F.count("*").alias("n")),
    "wind_turbines",
    """select case when lower(turbine_name) like 'customer#00000000%' then 'first ten' when lower(turbine_name) like 'customer#0000000%' then 'first hundred'
       else 'other' end as class, count(*) as n from wind_turbines group by 1""",
)
add(
    "B05_threshold_buckets",
    lambda t, c: t["wind"].groupBy(above("vibration_mm_s", [(7.0, "CRITICAL"), (5.0, "WARNING"), (4.0, "Elevated")], "").alias("severity")).agg(F.count("*").alias("n")),
    "wind",
    """select case when vibration_mm_s > 7 then 'CRITICAL' when vibration_mm_s > 5 then 'WARNING' when vibration_mm_s > 4 then 'Elevated' else '' end as severity,
       count(*) as n from wind group by 1""",
)
add(
    "B06_round",
    lambda t, c: t["events"].select("event_id", rounded(F.col("value") / 3, 3).alias("third"), rounded("value", 0).alias("whole")),
    "ev",
    f"select event_id, {r('value / 3', 3)} as third, {r('value', 0)} as whole from ev",
)
add(
    "B07_project_extend",
    lambda t, c: t["grid"].select(F.col("grid_name").alias("Grid name"), "event_id", (F.col("generation_mw") - F.col("load_mw")).alias("Surplus (MW)")),
    "grid",
    'select grid_name as "Grid name", event_id, generation_mw - load_mw as "Surplus (MW)" from grid',
    "Surplus (MW)",
)
add(
    "B08_scalar_composition",
    lambda t, c: tiles.generation_snapshot(t, c).agg(
        F.sum("mw").alias("total_mw"),
        F.sum(F.when(F.col("Source") == "Wind", F.col("mw"))).alias("wind_mw"),
        F.sum(F.when(F.col("Source") == "Gas", F.col("mw"))).alias("gas_mw"),
    ),
    "wind solar gas",
    f"""with w as (select coalesce(sum(v), 0.0) as v from (select arg_max(power_mw, timestamp) as v from wind where {since('30s')} group by turbine_id)),
    s as (select coalesce(sum(v), 0.0) / 1000 as v from (select arg_max(power_kw, timestamp) as v from solar where {since('30s')} group by inverter_id)),
    g as (select coalesce(sum(v), 0.0) as v from (select arg_max(power_output_mw, timestamp) as v from gas where {since('60s')} group by plant_id))
--
select w.v + s.v + g.v as total_mw, w.v as wind_mw, g.v as gas_mw from w, s, g""",
    "total_mw,wind_mw,gas_mw",
)
add(
    "B09_kw_to_mw",
    lambda t, c: t["solar"].groupBy("inverter_id").agg(kw_to_mw(F.sum("power_kw")).alias("mw")),
    "solar",
    "select inverter_id, sum(power_kw) / 1000 as mw from solar group by 1",
    "mw",
)


def _terms(t: SfTables, c: Clock) -> DataFrame:
    plants = [apply_term(t["power_plants"], n).select(F.lit(n).alias("term")) for n in ("operating", "renewables", "fossil", "wind farm", "solar park")]
    rows = reduce(DataFrame.unionByName, plants)
    rows = rows.unionByName(apply_term(t["maintenance_orders"], "open work order").select(F.lit("open work order").alias("term")))
    rows = rows.unionByName(t["vessel_positions"].where(under_way()).select(F.lit("under way").alias("term")))
    return rows.groupBy("term").agg(F.count("*").alias("n"))


add(
    "B10_business_terms",
    _terms,
    "power_plants maintenance_orders pos",
    """select 'operating' as term, count(*) as n from power_plants where status = 'Active'
       union all select 'renewables', count(*) from power_plants where plant_type in ('Wind Farm', 'Solar Park')
       union all select 'fossil', count(*) from power_plants where plant_type = 'Gas Power Plant'
       union all select 'wind farm', count(*) from power_plants where plant_type = 'Wind Farm'
       union all select 'solar park', count(*) from power_plants where plant_type = 'Solar Park'
       union all select 'open work order', count(*) from maintenance_orders where status in ('Open', 'Scheduled', 'In Progress')
       union all select 'under way', count(*) from pos where speed_knots > 0 and eta_hours > 0""",
)
add(
    "B10_unknown_enum_values",
    lambda t, c: unknown_values(t["maintenance_orders"], "MaintenanceOrder"),
    "maintenance_orders",
    """with v as (select 'order_type' as property, order_type as value from maintenance_orders union all select 'priority', priority from maintenance_orders
       union all select 'status', status from maintenance_orders union all select 'asset_type', asset_type from maintenance_orders)
--
select property, value, count(*) as n from v where value not in ('Corrective', 'Inspection', 'Preventive', 'Critical', 'High', 'Medium', 'Low',
       'Open', 'Scheduled', 'In Progress', 'Completed', 'SolarInverter', 'WindTurbine') group by 1, 2""",
)
#: Per entity its table here and those enumerated properties that the table has.
_ENUMERATED = {
    "PowerPlant": ("power_plants", ("plant_type", "fuel_type", "region", "prefecture", "status")),
    "WindTurbine": ("wind_turbines", ("manufacturer", "model", "status")),
    "SolarInverter": ("solar_inverters", ("manufacturer", "panel_type", "status")),
    "Grid": ("island_grids", ("island", "region")),
    "Vessel": ("vessels", ("vessel_type", "flag")),
    "Substation": ("substations", ("status",)),
    "MaintenanceOrder": ("maintenance_orders", ("order_type", "priority", "status", "asset_type")),
    "EmissionsRecord": ("emissions_ledger", ("compliance_status",)),
}


def _unknown_sql(entity: str) -> str:
    table, props = _ENUMERATED[entity]
    listed = lambda p: ", ".join(f"'{v}'" for v in ENUMS[entity][p])
    return " union all ".join(
        f"select '{entity}' as entity, '{p}' as property, {p}::varchar as value, count(*) as n from {table} where {p}::varchar not in ({listed(p)}) group by 3" for p in props
    )


add(
    "B10_unknown_values_of_all_types",
    lambda t, c: reduce(DataFrame.unionByName, [unknown_values(t[ENTITIES[e].table], e).withColumn("entity", F.lit(e)) for e in _ENUMERATED]),
    " ".join(table for table, _ in _ENUMERATED.values()),
    " union all ".join(_unknown_sql(e) for e in _ENUMERATED),
)
add(
    "B11_list_and_period_filters",
    lambda t, c: t["emissions_ledger"].where(F.col("period").isin("1998-03", "1998-04") | F.col("period").startswith("2000-")).groupBy("period").agg(F.count("*").alias("n")),
    "emissions_ledger",
    "select period, count(*) as n from emissions_ledger where period in ('1998-03', '1998-04') or period like '2000-%' group by 1",
)
add(
    "B12_fault_taxonomy",
    lambda t, c: wire.merged(t["wind"].select("fault_type"), t["solar"].select("fault_type"), t["emissions"].select("fault_type"))
    .groupBy(fault_label("fault_type").alias("fault"), fault_category("fault_type").alias("category"), fault_severity("fault_type").alias("severity"))
    .agg(F.count("*").alias("n")),
    "wind solar gas",
    """with f as (select nullif(nullif(fault_type, 'NONE'), '') as fault from (select fault_type from wind union all select fault_type from solar union all select fault_type from gas))
--
select fault, case when fault in ('bearing_degradation', 'vibration_spike') then 'mechanical' when fault = 'panel_soiling_or_string_fault' then 'electrical'
       when fault = 'combustion_inefficient' then 'thermal' when fault = 'DEMO_FORCED_FAILURE' then 'outage' end as category,
       case when fault = 'bearing_degradation' then 'CRITICAL' when fault = 'DEMO_FORCED_FAILURE' then 'OFFLINE' when fault is not null then 'WARNING' end as severity,
       count(*) as n from f group by 1, 2, 3""",
)

# ---- C: aggregation, latest state, time series ----

add(
    "C01_latest_row",
    lambda t, c: latest(t["events"], "user_id", tiebreak="event_id"),
    "ev",
    """select user_id, max(timestamp) as timestamp, arg_max(event_id, timestamp) as event_id, arg_max(event_type, timestamp) as event_type,
       arg_max(value, timestamp) as value, arg_max(k, timestamp) as k from ev group by 1""",
)
add(
    "C01_latest_row_hashed",
    lambda t, c: latest(t["events"], ["user_id", "event_type"], cols=["value", "k"], unique_ts=True),
    "ev",
    "select user_id, event_type, max(timestamp) as timestamp, arg_max(value, timestamp) as value, arg_max(k, timestamp) as k from ev group by 1, 2",
)
add(
    "C02_grouped_aggregates",
    lambda t, c: t["events"].groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    ),
    "ev",
    "select event_type, count(*) as n, sum(value) as total, avg(value) as mean, min(value) as low, max(value) as high from ev group by 1",
    "total,mean",
)
add(
    "C03_empty_aggregates",
    lambda t, c: t["wind"].where(F.col("vibration_mm_s") > 100).agg(
        F.count("*").alias("n"), total("power_mw").alias("total"), F.max("power_mw").alias("high"), share(total("power_mw"), F.count("*")).alias("ratio")
    ),
    "wind",
    """select count(*) as n, coalesce(sum(power_mw), 0.0) as total, max(power_mw) as high, 100.0 * sum(power_mw) / nullif(count(*), 0) as ratio
       from wind where vibration_mm_s > 100""",
    "total",
)
add("C04_distinct_count", lambda t, c: distinct_keys(t["events"], "user_id"), "ev", "select count(distinct user_id) as n from ev")
add(
    "C05_time_buckets",
    lambda t, c: bucketed(t["events"], "1 hour", {"n": F.count("*"), "mean": F.avg("value")}, keys=["event_type"]),
    "ev",
    "select time_bucket(interval 1 hour, timestamp) as timestamp, event_type, count(*) as n, avg(value) as mean from ev group by 1, 2",
    "mean",
)
add(
    "C06_regular_series",
    lambda t, c: make_series(t["events"], "user_id", "1 day", F.avg("value")),
    "ev",
    "with " + series_sql("ev", "user_id", "avg(value)", "1 day") + "\n--\nselect user_id, timestamp, value, filled from s",
    "value",
)


def _filled(kind: str, expr: str) -> None:
    body = "with " + series_sql("ev", "user_id", "avg(value)", "6 hour") + f""",
    o as (select user_id, timestamp, case when not filled then value end as v from s),
    n as (select *, last_value(v ignore nulls) over w as prev_v, last_value(case when v is not null then timestamp end ignore nulls) over w as prev_t,
          first_value(v ignore nulls) over f as next_v, first_value(case when v is not null then timestamp end ignore nulls) over f as next_t
          from o window w as (partition by user_id order by timestamp rows between unbounded preceding and current row),
          f as (partition by user_id order by timestamp rows between current row and unbounded following))
--
select user_id, timestamp, coalesce(v, {expr}) as value, v is null as filled from n"""
    add(f"C06_series_{kind}", lambda t, c: make_series(t["events"], "user_id", "6 hours", F.avg("value"), fill=kind), "ev", body, "value")


_filled("ffill", "prev_v")
_filled("linear", "prev_v + (next_v - prev_v) * (epoch_us(timestamp) - epoch_us(prev_t)) / (epoch_us(next_t) - epoch_us(prev_t))")
add(
    "C07_decompose_anomalies",
    lambda t, c: decompose(make_series(t["events"], "user_id", "1 day", F.avg("value")), "user_id", "1 day", threshold=0.4),
    "ev",
    "with " + series_sql("ev", "user_id", "avg(value)", "1 day") + ", " + decompose_sql("user_id", 0.4) + "\n--\nselect * from d",
    "value,baseline,score",
)
add(
    "C08_newest_row",
    lambda t, c: newest(t["events"].select("event_id", "timestamp", "value"), tiebreak="event_id"),
    "ev",
    "select event_id, timestamp, value from ev order by timestamp desc, event_id desc limit 1",
)
add(
    "C09_sorted_listing",
    lambda t, c: t["events"].groupBy("event_type", "k").agg(F.count("*").alias("n")).orderBy(F.asc("event_type"), F.desc("n"), "k"),
    "ev",
    "select event_type, k, count(*) as n from ev group by 1, 2 order by 1, 3 desc, 2",
)
add(
    "C10_union_of_buckets",
    lambda t, c: wire.merged(
        bucketed(t["wind"], "1 hour", {"mw": F.sum("power_mw")}).withColumn("source", F.lit("Wind")),
        bucketed(t["emissions"], "3 hours", {"mw": F.sum("power_output_mw"), "co2": F.sum("co2_kg_per_hour")}).withColumn("source", F.lit("Gas")),
    ),
    "wind gas",
    """select time_bucket(interval 1 hour, timestamp) as timestamp, sum(power_mw) as mw, 'Wind' as source, null::double as co2 from wind group by 1
       union all select time_bucket(interval 3 hour, timestamp), sum(power_output_mw), 'Gas', sum(co2_kg_per_hour) from gas group by 1""",
    "mw,co2",
)
add(
    "C11_rounded_buckets",
    lambda t, c: t["events"].groupBy(F.round(F.col("value") / 10, 0).alias("tens")).agg(F.count("*").alias("n")),
    "ev",
    f"select {r('value / 10', 0)} as tens, count(*) as n from ev group by 1",
)
add(
    "C12_channels_long",
    lambda t, c: t["wind"].select("event_id", F.expr("stack(3, 'power', power_mw, 'wind', wind_speed_ms, 'vibration', vibration_mm_s) as (channel, reading)")),
    "wind",
    """select event_id, 'power' as channel, power_mw as reading from wind union all select event_id, 'wind', wind_speed_ms from wind
       union all select event_id, 'vibration', vibration_mm_s from wind""",
)
add(
    "C13_conditional_count",
    lambda t, c: t["wind"].groupBy("turbine_id").agg(F.count("*").alias("n"), F.count_if(F.col("power_mw") > 0).alias("producing")),
    "wind",
    "select turbine_id, count(*) as n, count(*) filter (where power_mw > 0) as producing from wind group by 1",
)
add(
    "C14_group_by_traversal",
    lambda t, c: follow(t["wind_turbines"], t, ONTOLOGY, "belongs_to_plant", cols={"region": "region", "plant_type": "plant_type"})
    .groupBy("region", "plant_type")
    .agg(F.count("*").alias("turbines"), F.sum("capacity_mw").alias("mw")),
    "wind_turbines power_plants",
    """select region, plant_type, count(*) as turbines, sum(w.capacity_mw) as mw from wind_turbines w join power_plants p using (plant_id) group by 1, 2""",
    "mw",
)

# ---- D: entity views, traversal, graph ----

add(
    "D01_entity_view",
    lambda t, c: entity_view(t, ENTITIES["WindTurbine"], clock=c, span="2m").select("turbine_id", "turbine_name", "live_time", "live_power_mw", "live_vibration_mm_s"),
    "wind_turbines wind",
    f"""select turbine_id, turbine_name, live_time, live_power_mw, live_vibration_mm_s from wind_turbines left join (
        select turbine_id, max(timestamp) as live_time, arg_max(power_mw, timestamp) as live_power_mw, arg_max(vibration_mm_s, timestamp) as live_vibration_mm_s
        from wind where {since('2m')} group by 1) using (turbine_id)""",
)
_EDGES = {
    "belongs_to_plant": ("WindTurbine", "wind_turbines", "turbine_id", "plant_id", "PowerPlant"),
    "installed_at_plant": ("SolarInverter", "solar_inverters", "inverter_id", "plant_id", "PowerPlant"),
    "supplies_plant": ("Vessel", "vessels", "vessel_id", "supply_plant_id", "PowerPlant"),
    "fed_by_plant": ("Substation", "substations", "substation_id", "fed_by_plant_id", "PowerPlant"),
    "feeds_grid": ("Substation", "substations", "substation_id", "connected_grid_id", "Grid"),
    "servicing_asset": ("MaintenanceOrder", "maintenance_orders", "order_id", "plant_id", "PowerPlant"),
    "emitted_by_plant": ("EmissionsRecord", "emissions_ledger", "record_id", "plant_id", "PowerPlant"),
}
_EDGE_VIEWS = "wind_turbines solar_inverters vessels substations maintenance_orders emissions_ledger power_plants island_grids"


def _edge_sql(*names: str) -> str:
    return " union all ".join(
        f"select '{s}' as src_type, {k}::varchar as src_id, '{n}' as rel, '{d}' as dst_type, {fk}::varchar as dst_id from {tab} where {fk} is not null"
        for n, (s, tab, k, fk, d) in _EDGES.items()
        if not names or n in names
    )


_NODE_TABLES = [("PowerPlant", "power_plants", "plant_id"), ("Grid", "island_grids", "grid_id")] + sorted({(s, tab, k) for s, tab, k, _, _ in _EDGES.values()})
_NODE_SQL = " union all ".join(f"select '{n}' as type, {k}::varchar as id from {tab}" for n, tab, k in _NODE_TABLES)
add("D02_edge_table", lambda t, c: graph.edges(t, ONTOLOGY), _EDGE_VIEWS, _edge_sql())
add(
    "D03_three_hops",
    # Order -> plant -> grid, and the order's turbine, all many-to-one.
    lambda t, c: follow(
        follow(t["maintenance_orders"], t, ONTOLOGY, "servicing_asset", cols={"plant_name": "plant_name", "grid_zone": "grid_zone"}, how="left"),
        t,
        ONTOLOGY,
        "feeds_grid",
        on="grid_zone",
        cols={"grid_name": "grid_name"},
        how="left",
    )
    .join(t["wind_turbines"].select(F.col("turbine_id").alias("asset_id"), "turbine_name"), "asset_id", "left")
    .select("order_id", "turbine_name", "plant_name", "grid_name"),
    "maintenance_orders power_plants island_grids wind_turbines",
    """select order_id, turbine_name, plant_name, grid_name from maintenance_orders left join power_plants using (plant_id)
       left join island_grids on grid_id = grid_zone left join wind_turbines on turbine_id = asset_id""",
)
add(
    "D04_subgraph_nodes",
    lambda t, c: graph.subgraph(t, ONTOLOGY, ["supplies_plant", "fed_by_plant", "feeds_grid"])[0],
    _EDGE_VIEWS,
    f"""with e as ({_edge_sql('supplies_plant', 'fed_by_plant', 'feeds_grid')})
--
select src_type as type, src_id as id from e union select dst_type, dst_id from e""",
)
add(
    "D04_subgraph_edges_of_seed",
    lambda t, c: graph.subgraph(
        t,
        ONTOLOGY,
        ["belongs_to_plant", "supplies_plant", "fed_by_plant", "feeds_grid"],
        seeds=t["power_plants"].where(F.col("region") == "ASIA").select(F.lit("PowerPlant").alias("type"), F.col("plant_id").alias("id")),
    )[1],
    _EDGE_VIEWS,
    f"""with e as ({_edge_sql('belongs_to_plant', 'supplies_plant', 'fed_by_plant', 'feeds_grid')})
--
select * from e where dst_type = 'PowerPlant' and dst_id in (select plant_id::varchar from power_plants where region = 'ASIA')""",
)
def _hops_sql(hops: int) -> str:
    """Nodes within so many hops of the seed grids."""
    touched = "exists (select 1 from {n} where type = src_type and id = src_id) or exists (select 1 from {n} where type = dst_type and id = dst_id)"
    parts = [f"with e as ({_edge_sql('supplies_plant', 'fed_by_plant', 'feeds_grid')})", "n0 as (select 'Grid' as type, grid_id::varchar as id from island_grids where grid_name = 'ASIA')"]
    for k in range(1, hops + 1):
        parts.append(f"e{k} as (select * from e where {touched.format(n=f'n{k - 1}')})")
        parts.append(f"n{k} as (select src_type as type, src_id as id from e{k} union select dst_type, dst_id from e{k})")
    return ",\n".join(parts) + f"\n--\nselect * from n{hops}"


for _hops, _name in ((2, "two"), (3, "three")):
    add(
        f"D04_subgraph_{_name}_hops",
        lambda t, c, n=_hops: graph.subgraph(
            t,
            ONTOLOGY,
            ["supplies_plant", "fed_by_plant", "feeds_grid"],
            seeds=t["island_grids"].where(F.col("grid_name") == "ASIA").select(F.lit("Grid").alias("type"), F.col("grid_id").alias("id")),
            hops=n,
        )[0],
        _EDGE_VIEWS,
        _hops_sql(_hops),
    )
add(
    "D05_dangling_edges",
    lambda t, c: graph.dangling(t, ONTOLOGY),
    _EDGE_VIEWS,
    f"""with e as ({_edge_sql()}), n as ({_NODE_SQL})
--
select * from e where not exists (select 1 from n where n.type = e.dst_type and n.id = e.dst_id)""",
)
add(
    "D05_isolated_nodes",
    # Substations that feed no plant are isolated in the slice of that one relationship.
    lambda t, c: graph.isolated(t, ONTOLOGY, relationships=["fed_by_plant"]),
    _EDGE_VIEWS,
    f"""with e as ({_edge_sql('fed_by_plant')}), n as ({_NODE_SQL})
--
select type, id from n where type in ('Substation', 'PowerPlant') and not exists (select 1 from e where e.src_type = type and e.src_id = id)
    and not exists (select 1 from e where e.dst_type = type and e.dst_id = id)""",
)
add(
    "D05_isolated_nodes_of_all_types",
    lambda t, c: graph.isolated(t, ONTOLOGY),
    _EDGE_VIEWS,
    f"""with e as ({_edge_sql()}), n as ({_NODE_SQL})
--
select type, id from n where not exists (select 1 from e where e.src_type = type and e.src_id = id) and not exists (select 1 from e where e.dst_type = type and e.dst_id = id)""",
)
_REPORTERS = {"WindTurbine": ("wind", "wind_turbines", "turbine_id"), "SolarInverter": ("solar", "solar_inverters", "inverter_id"), "Grid": ("grid", "island_grids", "grid_id"), "Vessel": ("pos", "vessels", "vessel_id")}
add(
    "D05_unknown_reporters_of_all_types",
    lambda t, c: reduce(
        DataFrame.unionByName,
        [graph.unknown_reporters(t, ENTITIES[e]).select(F.lit(e).alias("type"), F.col(k).cast("string").alias("id"), "events") for e, (_, _, k) in _REPORTERS.items()],
    ),
    " ".join(f"{live} {table}" for live, table, _ in _REPORTERS.values()),
    " union all ".join(
        f"select '{e}' as type, {k}::varchar as id, count(*) as events from {live} where not exists (select 1 from {table} s where s.{k} = {live}.{k}) group by 2"
        for e, (live, table, k) in _REPORTERS.items()
    ),
)
add(
    "D05_unknown_reporters",
    lambda t, c: graph.unknown_reporters(t, ENTITIES["Vessel"]),
    "pos vessels",
    "select vessel_id, count(*) as events from pos where vessel_id not in (select vessel_id from vessels) group by 1",
)
add(
    "D05_grid_disagreement",
    lambda t, c: graph.grid_disagreement(t),
    "power_plants substations",
    """select plant_id, grid_zone, connected_grid_id as substation_grid, substation_id from power_plants join substations on fed_by_plant_id = plant_id
       where grid_zone <> connected_grid_id""",
)
add(
    "D05_capacity_mismatch",
    lambda t, c: graph.capacity_mismatch(t),
    "power_plants wind_turbines",
    """select plant_id, p.capacity_mw as stated_mw, turbines_mw, turbines from power_plants p
       left join (select plant_id, sum(capacity_mw) as turbines_mw, count(*) as turbines from wind_turbines group by 1) using (plant_id)
       where plant_type = 'Wind Farm' and abs(p.capacity_mw - coalesce(turbines_mw, 0)) > 0.05""",
    "turbines_mw",
)
add(
    "D06_renamed_live_property",
    lambda t, c: live_values(t, ENTITIES["Vessel"].live, props=["status", "destination"]),
    "pos",
    """select vessel_id, max(timestamp) as live_time, arg_max(destination, timestamp) as live_destination, arg_max(cargo_status, timestamp) as live_status from pos group by 1""",
)
add(
    "D07_children_per_parent",
    lambda t, c: t["power_plants"].select("plant_id", "plant_name").join(
        t["solar_inverters"].groupBy("plant_id").agg(F.count("*").alias("inverters"), F.sum("capacity_kw").alias("kw"), F.max("capacity_kw").alias("largest_kw")),
        "plant_id",
        "left",
    ),
    "power_plants solar_inverters",
    """select plant_id, p.plant_name, inverters, kw, largest_kw from power_plants p
       left join (select plant_id, count(*) as inverters, sum(capacity_kw) as kw, max(capacity_kw) as largest_kw from solar_inverters group by 1) using (plant_id)""",
    "kw",
)

# ---- F: detection, alerting, asset analytics ----

_KIND_STEP = "6 hours"


def _kind_series(t: SfTables) -> DataFrame:
    return make_series(t["events"], "event_type", _KIND_STEP, F.avg("value"))


_KIND_SQL = "with " + series_sql("ev", "event_type", "avg(value)", "6 hour")
_PHASE = ("((epoch_us(timestamp) - epoch_us(first)) // (6 * 3600 * 1000000::bigint)) % 4", "true")
_F1_SQL = _KIND_SQL + ", " + decompose_sql("event_type", 0.4, *_PHASE)
add(
    "F01_seasonal_decompose",
    lambda t, c: decompose(_kind_series(t), "event_type", _KIND_STEP, threshold=0.4, period=4),
    "ev",
    _F1_SQL + "\n--\nselect * from d",
    "value,baseline,score",
)
add(
    "F01_detect_period",
    lambda t, c: detect_period(_kind_series(t), "event_type", _KIND_STEP, [2, 4, 8, 12], minimum=0.01),
    "ev",
    _KIND_SQL + """,
    i as (select event_type, (epoch_us(timestamp) - epoch_us(min(timestamp) over (partition by event_type))) // (6 * 3600 * 1000000::bigint) as idx,
          value - avg(value) over (partition by event_type) as d from s),
    a as (select x.event_type, l.lag, sum(x.d * y.d) / (select sum(z.d * z.d) from i z where z.event_type = x.event_type) as rho
          from i x, (values (2), (4), (8), (12)) as l(lag), i y where y.event_type = x.event_type and y.idx = x.idx + l.lag group by 1, 2)
--
select event_type, arg_max(lag, rho) filter (where rho > 0.01) as period, max(rho) filter (where rho > 0.01) as strength from a group by 1""",
    "strength",
)
add(
    "F02_spectral_residual",
    lambda t, c: detect.spectral_residual(
        make_series(t["wind"], "turbine_id", "6 hours", F.avg("vibration_mm_s"), fill="linear"), "turbine_id", "6 hours", detect.SpectralResidual(), core=96
    ),
    "wind",
    "with " + linear_sql("wind", "turbine_id", "avg(vibration_mm_s)", "6 hour") + ", " + spectral_sql("turbine_id", 6 * 3600 * 1_000_000)
    + "\n--\nselect turbine_id, timestamp, value, baseline, score, anomaly from sr",
    "value,baseline,score",
)
add(
    "F02_change_points",
    lambda t, c: detect.cusum(make_series(t["wind"], "turbine_id", "6 hours", F.avg("vibration_mm_s"), fill="linear"), "turbine_id", threshold=4.0),
    "wind",
    "with " + linear_sql("wind", "turbine_id", "avg(vibration_mm_s)", "6 hour") + ", " + cusum_sql("turbine_id", 4.0) + "\n--\nselect * from cu",
    "value,baseline,score",
)
add(
    "F03_anomaly_events",
    lambda t, c: detect.anomaly_events(decompose(_kind_series(t), "event_type", _KIND_STEP, threshold=0.4, period=4), "event_type", "decompose"),
    "ev",
    _F1_SQL + """
--
select event_type as entity_id, timestamp, value, score, baseline, 'decompose' as detector, false as published, date_trunc('day', timestamp)::timestamp as event_date
from d where anomaly <> 0""",
    "value,score,baseline",
)


def _persisted(t: SfTables) -> DataFrame:
    """The events of two detectors in their table: both runs are written twice, as a rerun does, and one is published."""
    table = anomalies.AnomalyTable(shared_dir(t.spark, "anomalies"))
    series = settled(_kind_series(t), "kind-series")
    found = {"decompose": decompose(series, "event_type", _KIND_STEP, threshold=0.4, period=4), "change": detect.cusum(series, "event_type", threshold=3.0)}
    for name, flagged in found.items():
        events = settled(detect.anomaly_events(flagged, "event_type", name), "events")
        for _ in range(2):
            table.write(events, name, "2024-01-30")
    table.publish(t.spark, "decompose", "2024-01-30")
    return table.read(t.spark)


add(
    "F03_persisted_events",
    lambda t, c: _persisted(t),
    "ev",
    _F1_SQL + ", " + cusum_sql("event_type", 3.0) + """
--
select event_type as entity_id, timestamp, value, score, baseline, 'decompose' as detector, '2024-01-30' as run, true as published, date_trunc('day', timestamp)::timestamp as event_date
from d where anomaly <> 0
union all
select event_type, timestamp, value, score, baseline, 'change', '2024-01-30', false, date_trunc('day', timestamp)::timestamp from cu where anomaly <> 0""",
    "value,score,baseline",
)


#: The detectors that compete, each with what it asks of a point; a lower margin than the default lets the sparse test series be told apart at all.
_KEEN = detect.SpectralResidual(sensitivity=85, threshold=1.0)


def _flags(t: SfTables) -> DataFrame:
    """Per turbine and half day: three detectors' verdicts on vibration. The series is filled once, written, and read by each of them."""
    step = "12 hours"
    series = settled(make_series(t["wind"], "turbine_id", step, F.avg("vibration_mm_s"), fill="linear"), "detector-series")
    judged = {
        "seasonal": decompose(series, "turbine_id", step, threshold=0.3, period=2),
        "spectral": detect.spectral_residual(series, "turbine_id", step, _KEEN),
        "change": detect.cusum(series, "turbine_id", threshold=2.5),
    }
    parts = [d.select(F.lit(n).alias("detector"), "turbine_id", "timestamp", (F.col("anomaly") != 0).alias("flagged")) for n, d in judged.items()]
    return reduce(DataFrame.unionByName, parts)


def _labels(t: SfTables) -> DataFrame:
    faulty = fault_label("fault_type").isNotNull()
    return bucketed(t["wind"], "12 hours", {"faulty": F.bool_or(faulty)}, keys=["turbine_id"])


def _eval_sql(final: str) -> str:
    half_day = 12 * 3600 * 1_000_000
    base = "with " + linear_sql("wind", "turbine_id", "avg(vibration_mm_s)", "12 hour")
    seasonal = decompose_sql("turbine_id", 0.3, f"(epoch_us(timestamp) // {half_day}::bigint) % 2", "true")
    spectral = spectral_sql("turbine_id", half_day, margin=_KEEN.margin, confidence=_KEEN.min_score)
    change = cusum_sql("turbine_id", 2.5)
    labels = """l as (select turbine_id, time_bucket(interval 12 hour, timestamp) as timestamp, bool_or(fault_type <> 'NONE') as faulty from wind group by 1, 2),
    v as (select 'seasonal' as detector, turbine_id, timestamp, anomaly <> 0 as flagged from d
          union all select 'spectral', turbine_id, timestamp, anomaly <> 0 from sr union all select 'change', turbine_id, timestamp, anomaly <> 0 from cu),
    c as (select detector, turbine_id, count(*) filter (where flagged and f) as tp, count(*) filter (where flagged and not f) as fp, count(*) filter (where not flagged and f) as fn, count(*) filter (where not flagged and not f) as tn
          from (select v.*, coalesce(faulty, false) as f from v left join l using (turbine_id, timestamp)) group by 1, 2),
    x as (select *, tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0)::double as f1 from c)"""
    return f"{base}, {seasonal}, {spectral}, {change}, {labels}\n--\n{final}"


add("F04_detector_scores", lambda t, c: detect.evaluate(_flags(t), _labels(t), "turbine_id"), "wind", _eval_sql("select * from x"), "precision,recall,f1")
add(
    "F04_best_detector",
    lambda t, c: detect.best_detector(detect.evaluate(_flags(t), _labels(t), "turbine_id"), "turbine_id"),
    "wind",
    _eval_sql(
        """select turbine_id, detector, f1 from (select *, row_number() over (partition by turbine_id order by round(f1, 9) desc, detector) as rn from x where f1 is not null) where rn = 1"""
    ),
    "f1",
)
CHANGES_SQL = """select event_id, timestamp, user_id, event_type, value, k from
    (select *, lag(event_type) over (partition by user_id order by timestamp, event_id) as prev from ev) where event_type = 'error' and prev <> 'error'"""
add("F05_change_alerts", lambda t, c: alerts.changes_to(t["events"], "user_id", "event_type", "error", tiebreak="event_id"), "ev", CHANGES_SQL)
add(
    "F05_change_alerts_first",
    lambda t, c: alerts.changes_to(t["events"], "user_id", "event_type", "error", tiebreak="event_id", fire_on_first=True).select("event_id", "user_id"),
    "ev",
    """select event_id, user_id from (select *, lag(event_type) over (partition by user_id order by timestamp, event_id) as prev from ev)
       where event_type = 'error' and coalesce(prev, '') <> 'error'""",
)
add(
    "F06_threshold_crossing",
    lambda t, c: alerts.crosses_above(t["wind"], "turbine_id", "vibration_mm_s", 7.0, tiebreak="event_id").select("event_id", "turbine_id", "vibration_mm_s"),
    "wind",
    """select event_id, turbine_id, vibration_mm_s from (select *, lag(vibration_mm_s) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
       where vibration_mm_s > 7 and prev <= 7""",
)
add(
    "F06_becomes_zero",
    lambda t, c: alerts.becomes_zero(t["wind"], "turbine_id", "power_mw", tiebreak="event_id").select("event_id", "turbine_id"),
    "wind",
    """select event_id, turbine_id from (select *, lag(power_mw) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
       where power_mw = 0 and prev <> 0""",
)


def _forced(t: SfTables) -> DataFrame:
    rows = t["wind"].select("event_id", "timestamp", "turbine_id", "fault_type", "latitude", "longitude")
    return alerts.changes_to(rows, "turbine_id", "fault_type", FORCED_FAILURE, tiebreak="event_id")


def busy_turbines(t: SfTables) -> DataFrame:
    """Turbines with an urgent order still open."""
    return t["maintenance_orders"].where((F.col("status") == "Open") & (F.col("priority") == "1-URGENT")).select(F.col("asset_id").alias("turbine_id"))


_EPISODES = """a as (select * from (select *, lag(fault_type) over (partition by turbine_id order by timestamp, event_id) as prev from wind)
        where fault_type = 'DEMO_FORCED_FAILURE' and prev <> 'DEMO_FORCED_FAILURE'),
    ep as (select turbine_id, min(timestamp) as episode_start, arg_min(latitude, timestamp) as lat, arg_min(longitude, timestamp) as lon from a
        where turbine_id not in (select asset_id from maintenance_orders where status = 'Open' and priority = '1-URGENT') group by 1)"""
_ORDER_ID = "md5(turbine_id || '|' || epoch_us(episode_start))"
F07_VIEWS = "wind maintenance_orders service_vessels"
F07_SQL = f"""with {_EPISODES},
    d as (select ep.*, vessel_id, {distance('lat', 'lon', 'vessel_lat', 'vessel_lon')} as nm from ep, service_vessels),
    n as (select *, row_number() over (partition by turbine_id order by round(nm, 9), vessel_id) as rn from d)
--
select {_ORDER_ID} as order_id, turbine_id as asset_id, episode_start, lat as target_lat, lon as target_lon, vessel_id, nm as distance_nm, 'Open' as status from n where rn = 1"""
add(
    "F07_dispatch_orders",
    # The alerts are written first, as the stream does, since dispatch reads them several times.
    lambda t, c: dispatch.dispatch_orders(settled(_forced(t), "alerts"), t["service_vessels"], asset="turbine_id", open_orders=busy_turbines(t)),
    F07_VIEWS,
    F07_SQL,
    "target_lat,target_lon,distance_nm",
)


#: Orders opened by a failure and closed by the next healthy reading of the same turbine; a repeated alert inside an order opens nothing.
HISTORY_SQL = f"""with a as (select turbine_id, timestamp, true as opens, latitude as lat, longitude as lon from
        (select *, lag(fault_type) over (partition by turbine_id order by timestamp, event_id) as prev from wind) where fault_type = 'DEMO_FORCED_FAILURE' and prev <> 'DEMO_FORCED_FAILURE'),
    e as (select * from a union all select turbine_id, timestamp, false, null, null from wind where fault_type = 'NONE' and vibration_mm_s <= 3.5),
    s as (select *, lag(opens) over (partition by turbine_id order by timestamp, opens) as was from e),
    x as (select *, lead(timestamp) over (partition by turbine_id order by timestamp, opens) as closed_at from s where opens <> coalesce(was, false)),
    o as (select * from x where opens),
    d as (select o.*, vessel_id, {distance('lat', 'lon', 'vessel_lat', 'vessel_lon')} as nm from o, service_vessels),
    n as (select *, row_number() over (partition by turbine_id, timestamp order by round(nm, 9), vessel_id) as rn from d)
--
select md5(turbine_id || '|' || epoch_us(timestamp)) as order_id, turbine_id as asset_id, timestamp as episode_start, lat as target_lat, lon as target_lon, vessel_id, nm as distance_nm,
       case when closed_at is null then 'Open' else 'Completed' end as status, closed_at from n where rn = 1"""


def _order_history(t: SfTables) -> DataFrame:
    healthy = t["wind"].where(orders.well_again()).select("turbine_id", "timestamp")
    out = orders.dispatch_history(settled(_forced(t), "alerts"), healthy, t["service_vessels"], asset="turbine_id")
    return out.withColumnsRenamed({"latitude": "target_lat", "longitude": "target_lon"})


add("F07_order_history", lambda t, c: _order_history(t), F07_VIEWS, HISTORY_SQL, "target_lat,target_lon,distance_nm")


def _predicted(t: SfTables) -> DataFrame:
    """Alerts from unusually high daily vibration."""
    series = make_series(t["wind"], "turbine_id", "1 day", F.avg("vibration_mm_s"))
    events = detect.anomaly_events(decompose(series, "turbine_id", "1 day", threshold=0.5), "turbine_id", "decompose")
    return dispatch.alerts_from_anomalies(events, t["wind_turbines"], asset="turbine_id")


add(
    "F07_predictive_dispatch",
    lambda t, c: dispatch.dispatch_orders(settled(_predicted(t), "predicted"), t["service_vessels"], asset="turbine_id", open_orders=busy_turbines(t)),
    F07_VIEWS + " wind_turbines",
    "with " + series_sql("wind", "turbine_id", "avg(vibration_mm_s)", "1 day") + ", " + decompose_sql("turbine_id", 0.5) + f""",
    ep as (select turbine_id, min(d.timestamp) as episode_start, any_value(latitude) as lat, any_value(longitude) as lon from d join wind_turbines w using (turbine_id)
        where anomaly > 0 and turbine_id not in (select asset_id from maintenance_orders where status = 'Open' and priority = '1-URGENT') group by 1),
    ds as (select ep.*, vessel_id, {distance('lat', 'lon', 'vessel_lat', 'vessel_lon')} as nm from ep, service_vessels),
    n as (select *, row_number() over (partition by turbine_id order by round(nm, 9), vessel_id) as rn from ds)
--
select {_ORDER_ID} as order_id, turbine_id as asset_id, episode_start, lat as target_lat, lon as target_lon, vessel_id, nm as distance_nm, 'Open' as status from n where rn = 1""",
    "target_lat,target_lon,distance_nm",
)
add(
    "F08_maintenance_orders",
    lambda t, c: alerts.maintenance_orders(alerts.open_episodes(_forced(t), "turbine_id", open_orders=busy_turbines(t)), "turbine_id", reason="Forced failure").select(
        "order_id", "order_type", "priority", "status", "asset_id", "asset_type", "description", "created_date", "technician", "cost_eur"
    ),
    "wind maintenance_orders",
    f"""with {_EPISODES}
--
select {_ORDER_ID} as order_id, 'Corrective' as order_type, 'Critical' as priority, 'Open' as status, turbine_id as asset_id, 'WindTurbine' as asset_type,
       'Forced failure' as description, date_trunc('day', episode_start)::timestamp as created_date, 'Pending Dispatch' as technician, 0.0::double as cost_eur from ep""",
)


def _turbine_spots(t: SfTables) -> DataFrame:
    return latest(t["wind"], "turbine_id", cols=["latitude", "longitude"])


_SPOTS = "sp as (select turbine_id, arg_max(latitude, timestamp) as lat, arg_max(longitude, timestamp) as lon from wind group by 1)"
add(
    "F09_vessels_within_radius",
    lambda t, c: proximity.count_within(
        _turbine_spots(t), t["service_vessels"], 60.0, left_id="turbine_id", left_at=("latitude", "longitude"), right_at=("vessel_lat", "vessel_lon")
    ),
    "wind service_vessels",
    f"""with {_SPOTS}, d as (select turbine_id, {distance('lat', 'lon', 'vessel_lat', 'vessel_lon')} as nm from sp, service_vessels)
--
select turbine_id, count(*) filter (where nm <= 60) as n, min(nm) filter (where nm <= 60) as nearest_nm from d group by 1""",
    "nearest_nm",
)
add(
    "F09_nearest_vessel",
    lambda t, c: proximity.nearest(
        _turbine_spots(t), t["service_vessels"], left_id="turbine_id", right_id="vessel_id", left_at=("latitude", "longitude"), right_at=("vessel_lat", "vessel_lon")
    ),
    "wind service_vessels",
    f"""with {_SPOTS}, d as (select turbine_id, vessel_id, {distance('lat', 'lon', 'vessel_lat', 'vessel_lon')} as nm from sp, service_vessels),
    n as (select *, row_number() over (partition by turbine_id order by round(nm, 9), vessel_id) as rn from d)
--
select turbine_id, vessel_id, nm as distance_nm from n where rn = 1""",
    "distance_nm",
)
_MOVES = f"""mv as (select vessel_id, timestamp, latitude, longitude, hours, nm from (select vessel_id, timestamp, latitude, longitude,
        (epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1000000.0::double / 3600.0::double as hours,
        {distance('lag(latitude) over w', 'lag(longitude) over w', 'latitude', 'longitude')} as nm
        from pos window w as (partition by vessel_id order by timestamp, event_id)) where hours is not null)"""
add(
    "F10_track_metrics",
    lambda t, c: tracks.track_metrics(t["vessel_positions"], tiebreak=["event_id"]),
    "pos",
    f"""with {_MOVES}
--
select vessel_id, count(*) as moves, sum(nm) as distance_nm, coalesce(sum(hours) filter (where nm > 0.05), 0.0) as under_way_h,
       coalesce(sum(hours) filter (where nm <= 0.05), 0.0) as standby_h, sum(nm) / nullif(sum(hours) filter (where nm > 0.05), 0) as mean_knots from mv group by 1""",
    "distance_nm,under_way_h,standby_h,mean_knots",
)
add(
    "F10_arrivals",
    lambda t, c: tracks.arrivals(t["vessel_positions"], 37.0, 25.0, 90.0, tiebreak=["event_id"]).select("vessel_id", "event_id", "timestamp"),
    "pos",
    f"""with n as (select *, {distance('latitude', 'longitude', '37.0', '25.0')} <= 90 as near from pos)
--
select vessel_id, event_id, timestamp from (select *, lag(near) over (partition by vessel_id order by timestamp, event_id) as prev from n) where near and not prev""",
)
add(
    "F11_time_to_go",
    lambda t, c: tracks.time_to_go(t["vessel_positions"].select("event_id", "vessel_id", "latitude", "longitude", "speed_knots"), t["route_legs"]).select(
        "event_id", "vessel_id", F.col("leg_no").cast("double").alias("leg_no"), "remaining_nm", "eta_h"
    ),
    "pos route_legs",
    f"""with lg as (select vessel_id, leg_no, lat, lon, lead(lat) over w as to_lat, lead(lon) over w as to_lon from route_legs window w as (partition by vessel_id order by leg_no)),
    ln as (select *, {distance('lat', 'lon', 'to_lat', 'to_lon')} as nm from lg where to_lat is not null),
    sf as (select *, coalesce(sum(nm) over (partition by vessel_id order by leg_no desc rows between unbounded preceding and 1 preceding), 0.0) as after_nm from ln),
    o as (select event_id, pos.vessel_id, leg_no, speed_knots,
          round({distance('latitude', 'longitude', 'lat', 'lon')} + {distance('latitude', 'longitude', 'to_lat', 'to_lon')} - nm, 6) as detour,
          {distance('latitude', 'longitude', 'to_lat', 'to_lon')} + after_nm as left_nm from pos left join sf using (vessel_id)),
    f as (select *, row_number() over (partition by event_id order by detour, leg_no) as rn from o)
--
select event_id, vessel_id, leg_no::double as leg_no, left_nm as remaining_nm, case when speed_knots > 0 then left_nm / speed_knots when left_nm is not null then 0.0 end as eta_h from f where rn = 1""",
    "remaining_nm,eta_h",
)


def _rated(t: SfTables) -> tuple[DataFrame, DataFrame]:
    """Wind telemetry and turbines with output scaled to one turbine size."""
    rows = t["wind"].withColumn("power_mw", F.least(F.lit(4.2), F.col("power_mw") / F.lit(20.0)))
    return rows, t["wind_turbines"].withColumn("capacity_mw", F.lit(4.2))


add(
    "F12_wind_performance",
    lambda t, c: assets.wind_performance(*_rated(t), "1 day"),
    "wind",
    """with p as (select turbine_id, time_bucket(interval 1 day, timestamp) as timestamp, least(4.2, power_mw / 20) as a,
          case when wind_speed_ms < 3 or wind_speed_ms > 25 then 0.0 when wind_speed_ms >= 12 then 4.2 else 4.2 * pow((wind_speed_ms - 3) / 9, 3) end as e from wind)
--
select turbine_id, timestamp, avg(a) as actual_mw, avg(e) as expected_mw, avg(e) - avg(a) as gap_mw, avg(a) / 4.2 as capacity_factor from p group by 1, 2""",
    "actual_mw,expected_mw,gap_mw,capacity_factor",
)
add(
    "F13_solar_performance",
    lambda t, c: assets.solar_performance(t["solar"], t["solar_inverters"].withColumn("capacity_kw", F.lit(100000.0)), "1 day"),
    "solar",
    """with p as (select inverter_id, time_bucket(interval 1 day, timestamp) as timestamp, power_kw as a,
          100000.0 * (irradiance_wm2 / 1000.0) * greatest(0.70, 1.0 - 0.004 * greatest(0.0, panel_temp_c - 25.0)) as e from solar),
    s as (select inverter_id, timestamp, sum(a) as actual_kw, sum(e) as expected_kw from p group by 1, 2)
--
select *, actual_kw / nullif(expected_kw, 0) as performance_ratio, actual_kw * 2 <= expected_kw as soiled from s""",
    "actual_kw,expected_kw,performance_ratio",
)
add(
    "F14_cloud_index",
    lambda t, c: assets.cloud_index(t["solar"], t["solar_inverters"]),
    "solar solar_inverters",
    """with a as (select plant_id as park, timestamp, irradiance_wm2, i.latitude as lat, dayofyear(timestamp) as doy,
          (hour(timestamp) + minute(timestamp) / 60.0::double + 3.0) % 24.0 as h from solar s left join solar_inverters i using (inverter_id)),
    b as (select *, radians(23.45::double * sin(radians(360.0::double / 365.0 * (doy - 81)))) as decl, radians(15.0::double * (h - 12.5)) as ha, radians(lat) as phi from a),
    u as (select *, sin(decl) * sin(phi) + cos(decl) * cos(phi) * cos(ha) as up from b),
    w as (select *, case when up <= 0.02 then 0.0 else 1361.0::double * pow(0.7::double, pow(1.0 / (up + 0.50572::double * pow(degrees(asin(least(up, 1.0::double))) + 6.07995, -1.6364)), 0.678)) * up end as clear from u),
    g as (select park, time_bucket(interval 1 hour, timestamp) as timestamp, avg(irradiance_wm2) as measured_wm2, avg(clear) as clear_wm2 from w group by 1, 2)
--
select *, case when clear_wm2 > 0 then measured_wm2 / clear_wm2 end as cloud_index from g""",
    "measured_wm2,clear_wm2,cloud_index",
)
add(
    "F15_grid_balance",
    lambda t, c: assets.grid_balance(t["grid"], t["island_grids"], "1 day"),
    "grid island_grids",
    """select grid_id, time_bucket(interval 1 day, timestamp) as timestamp, avg(generation_mw - load_mw) as balance_mw, max(abs(frequency_hz - nominal_frequency_hz)) as max_deviation_hz,
       count(*) filter (where abs(frequency_hz - nominal_frequency_hz) > 0.2) * 2.0 / 60.0 as out_of_band_min from grid left join island_grids using (grid_id) group by 1, 2""",
    "balance_mw,max_deviation_hz,out_of_band_min",
)
add(
    "F16_ledger_rollup",
    lambda t, c: emissions.ledger_rollup(t["emissions_ledger"]),
    "emissions_ledger",
    """with s as (select plant_id, period, sum(co2_tonnes) as co2_tonnes, sum(ets_allowance_tonnes) as allowance_tonnes from emissions_ledger group by 1, 2)
--
select *, 100.0 * co2_tonnes / allowance_tonnes as compliance_pct, case when 100.0 * co2_tonnes / allowance_tonnes >= 95 then 'Near Limit' else 'Compliant' end as compliance_status,
       co2_tonnes / 0.35::double as fuel_mwh from s""",
    "co2_tonnes,allowance_tonnes,compliance_pct,fuel_mwh",
)
add(
    "F16_integrated_emissions",
    lambda t, c: emissions.integrated_emissions(t["emissions"], tiebreak=["event_id"]),
    "gas",
    """with h as (select plant_id, strftime(timestamp, '%Y-%m') as period, co2_kg_per_hour as rate,
          (epoch_us(lead(timestamp) over (partition by plant_id order by timestamp, event_id)) - epoch_us(timestamp)) / 1000000.0::double / 3600.0 as hours from gas)
--
select plant_id, period, sum(rate * hours) / 1000.0 as co2_tonnes, sum(hours) as hours from h where hours is not null group by 1, 2""",
    "co2_tonnes,hours",
)
add(
    "F16_daily_compliance",
    lambda t, c: emissions.daily_compliance(t["emissions"]),
    "gas",
    """select plant_id, date_trunc('day', timestamp)::timestamp as day, max(cumulative_co2_tonnes_today) as co2_tonnes, max(ets_daily_allowance_tonnes) as allowance_tonnes,
       least(100.0 * max(cumulative_co2_tonnes_today) / max(ets_daily_allowance_tonnes), 150.0::double) as compliance_pct from gas group by 1, 2""",
    "compliance_pct",
)
_CADENCE = {"click": 3600.0, "view": 7200.0, "purchase": 14400.0, "signup": 28800.0, "error": 57600.0}
add(
    "F17_cadence_report",
    lambda t, c: assets.cadence_report(t["events"], "event_type", "user_id", _CADENCE),
    "ev",
    f"""with g as (select event_type, cast(round((epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by event_type, user_id order by timestamp, event_id))) / 1000000.0::double) as bigint) as s from ev),
    e(event_type, expected_s) as (values {', '.join(f"('{k}', {v}::double)" for k, v in _CADENCE.items())})
--
select event_type, any_value(expected_s) as expected_s, count(*) as intervals, quantile_cont(s, 0.5) as median_s, max(s) as max_s, count(*) filter (where s > 1.5 * expected_s) as gaps
from g join e using (event_type) where s is not null group by 1""",
)
