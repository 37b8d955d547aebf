"""Registry of the queries on the test tables: dashboard tiles, map layers and entity questions.

Each entry pairs the Spark query with the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meltemi.functions.clock import Clock
from meltemi.functions.numbers import snapped
from meltemi.plans import questions as g
from meltemi.plans import tiles as e
from meltemi.plans.sf import MAINLAND, PARKS, REGIONS, SfTables
from meltemi.plans.sf_views import bin_of, r, since, sql


@dataclass(frozen=True)
class Query:
    build: Callable[[SfTables, Clock], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = SfTables(spark, sf_dir)
        return snapped(self.build(tables, tables.clock()))


REGISTRY: dict[str, Query] = {}


def add(name: str, build: Callable[[SfTables, Clock], DataFrame], views: str = "", body: str | None = None, doubles: str = "") -> None:
    assert name not in REGISTRY, name
    REGISTRY[name] = Query(build, sql(views, body, doubles) if body is not None else None)


def _now(view: str, key: str, span: str, cols: str) -> str:
    """Latest row per key inside a lookback."""
    picked = ", ".join(f"arg_max({c.strip()}, timestamp) as {c.strip()}" for c in cols.split(","))
    return f"(select {key}, {picked} from {view} where {since(span)} group by {key})"


_MIX = f"""with mix as (
    select 'Wind' as "Source", coalesce(sum(power_mw), 0.0) as mw from {_now('wind', 'turbine_id', '30s', 'power_mw')}
    union all select 'Solar', coalesce(sum(power_kw), 0.0) / 1000 from {_now('solar', 'inverter_id', '30s', 'power_kw')}
    union all select 'Gas', coalesce(sum(power_output_mw), 0.0) from {_now('gas', 'plant_id', '60s', 'power_output_mw')})
--
"""
_FEEDS = "wind solar gas"

add("E01_total_generation", e.e01_total_generation, _FEEDS, _MIX + f'select {r("sum(mw)", 1)} as "MW" from mix')
add(
    "E02_renewable_pct",
    e.e02_renewable_pct,
    _FEEDS,
    _MIX + f"""select {r("100.0 * sum(mw) filter (where \"Source\" <> 'Gas') / nullif(sum(mw), 0)", 1)} as "Renewable_Pct" from mix""",
)
add(
    "E03_mainland_frequency",
    lambda t, c: e.e03_mainland_frequency(t, c, MAINLAND),
    "grid",
    f"select {r('frequency_hz', 3)} as \"Hz\" from grid where grid_id = {MAINLAND} and {since('2m')} order by timestamp desc limit 1",
)
add("E04_critical_faults", e.e04_critical_faults, "wind", f'select count(distinct turbine_id) as "Faults" from wind where {since("2m")} and vibration_mm_s > 7.0')
add("E05_vessels_inbound", e.e05_vessels_inbound, "pos", f'select count(*) as "Vessels" from {_now("pos", "vessel_id", "2m", "eta_hours")} where eta_hours > 0')
add("E06_ets_used_pct", e.e06_ets_used_pct, "gas", f'select {r("max(compliance_pct)", 1)} as "ETS_Pct" from {_now("gas", "plant_id", "2m", "compliance_pct")}')
add("E07_generation_mix", e.e07_generation_mix, _FEEDS, _MIX + f'select "Source", {r("mw", 1)} as "MW" from mix')


def _trend(view: str, value: str, source: str, width: str) -> str:
    return f"select {bin_of(width)} as timestamp, {value} as \"MW\", '{source}' as \"Source\" from {view} where {since('15m')} group by 1"


add(
    "E08_total_generation_trend",
    e.e08_total_generation_trend,
    _FEEDS,
    " union all ".join(
        [_trend("wind", "sum(power_mw)", "Wind", "bin10s"), _trend("solar", "sum(power_kw) / 1000", "Solar", "bin10s"), _trend("gas", "sum(power_output_mw)", "Gas", "bin30s")]
    ),
    "MW",
)


def _trend_each(view: str, key: str, value: str, unit: str, source: str, width: str) -> str:
    return (
        f"select timestamp, sum(m) / {unit} as \"MW\", '{source}' as \"Source\" from (select {bin_of(width)} as timestamp, {key}, avg({value}) as m "
        f"from {view} where {since('15m')} group by 1, 2) group by 1"
    )


add(
    "E08_total_generation_per_asset",
    lambda t, c: e.e08_total_generation_trend(t, c, per_entity=True),
    _FEEDS,
    " union all ".join(
        [
            _trend_each("wind", "turbine_id", "power_mw", "1.0", "Wind", "bin10s"),
            _trend_each("solar", "inverter_id", "power_kw", "1000.0", "Solar", "bin10s"),
            _trend_each("gas", "plant_id", "power_output_mw", "1.0", "Gas", "bin30s"),
        ]
    ),
    "MW",
)


def _faults(severity: str) -> str:
    return f"""select turbine_id as "Asset", 'Wind Turbine' as "Type", count(*) as "Spikes", 0.0::double as "Max_Vib", 0.0::double as "Min_Power_MW", 'OFFLINE' as "Severity"
        from wind where {since('3m')} and fault_type = 'DEMO_FORCED_FAILURE' group by 1
        union all
        select turbine_id, 'Wind Turbine', count(*), {r('max(vibration_mm_s)', 2)}, {r('min(power_mw)', 2)}, {severity}
        from wind where {since('3m')} and (fault_type <> 'DEMO_FORCED_FAILURE' or fault_type is null or fault_type = '') and vibration_mm_s > 5.0 group by 1"""


add("E09_active_faults", e.e09_active_faults, "wind", _faults("case when max(vibration_mm_s) > 7.0 then 'CRITICAL' else 'WARNING' end"))
add(
    "E09_active_faults_lexical",
    lambda t, c: e.e09_active_faults(t, c, lexical=True),
    "wind",
    _faults("max(case when vibration_mm_s > 7.0 then 'CRITICAL' else 'WARNING' end)"),
)
add(
    "E10_wind_by_region",
    lambda t, c: e.e10_wind_by_region(t, c, REGIONS),
    "wind",
    f"""select {bin_of('bin10s')} as timestamp, case left(turbine_id::varchar, 1) when '1' then 'first' when '2' then 'second' when '3' then 'third' else 'other' end as region,
        sum(power_mw) as total_mw from wind where {since('15m')} group by 1, 2""",
    "total_mw",
)
add("E11_bearing_line", e.e11_bearing_line, "wind", f'select turbine_id, timestamp, vibration_mm_s as "Vibration_mm_s" from wind where {since("10m")}')


def _leaders(severity: str) -> str:
    return f"""select turbine_id as "Turbine_ID", count(*) as "Spikes", {r('avg(vibration_mm_s)', 2)} as "Avg_Vib", {r('max(vibration_mm_s)', 2)} as "Max_Vib", {severity} as "Severity"
        from wind where {since('5m')} and vibration_mm_s > 4.0 group by 1"""


add(
    "E12_anomaly_leaderboard",
    e.e12_anomaly_leaderboard,
    "wind",
    _leaders("case when max(vibration_mm_s) > 7.0 then 'CRITICAL' when max(vibration_mm_s) > 5.0 then 'WARNING' else 'Elevated' end"),
)
add(
    "E12_anomaly_leaderboard_lexical",
    lambda t, c: e.e12_anomaly_leaderboard(t, c, lexical=True),
    "wind",
    _leaders("max(case when vibration_mm_s > 7.0 then 'CRITICAL' when vibration_mm_s > 5.0 then 'WARNING' else 'Elevated' end)"),
)
add(
    "E13_power_curve",
    e.e13_power_curve,
    "wind",
    f"select round(wind_speed_ms, 0) as wind_speed_ms, avg(power_mw) as avg_power from wind where {since('15m')} and power_mw > 0 group by 1",
    "avg_power",
)


def series_sql(source: str, key: str, value: str, step: str, where: str = "true") -> str:
    """CTEs ``bins`` and ``s`` (key, timestamp, value, filled): zero-filled buckets from first to last."""
    return f"""bins as (select {key}, time_bucket(interval {step}, timestamp) as timestamp, {value} as value from {source} where {where} group by 1, 2),
    slots as (select {key}, unnest(generate_series(min(timestamp), max(timestamp), interval {step})) as timestamp from bins group by 1),
    s as (select slots.{key}, slots.timestamp, coalesce(bins.value, 0.0) as value, bins.timestamp is null as filled
          from slots left join bins on bins.{key} = slots.{key} and bins.timestamp = slots.timestamp)"""


def decompose_sql(key: str, threshold: float, phase: str = "-1", season: str = "false") -> str:
    """CTE ``d``: the series with baseline, score and anomaly flag."""
    return f"""m as (select {key}, avg(value) as mean, min(timestamp) as first from s group by 1),
    p as (select s.*, m.mean, {phase} as phase from s join m using ({key})),
    q as (select {key}, phase, avg(value) as season from p group by 1, 2),
    b as (select p.*, case when {season} then q.season else p.mean end as baseline from p join q using ({key}, phase)),
    t as (select {key}, quantile_cont(value - baseline, 0.1) as lo, quantile_cont(value - baseline, 0.9) as hi from b group by 1),
    z as (select b.*, case when hi = lo then 0.0 when value - baseline > hi then (value - baseline - hi) / (hi - lo)
              when value - baseline < lo then (value - baseline - lo) / (hi - lo) else 0.0 end as score from b join t using ({key})),
    d as (select {key}, timestamp, value, filled, baseline, score, case when round(abs(score), 9) > {threshold} then cast(sign(score) as int) else 0 end as anomaly from z)"""


def linear_sql(source: str, key: str, value: str, step: str) -> str:
    """CTEs ``bins`` and ``s``: buckets from first to last, gaps filled along a line."""
    return f"""bins as (select {key}, time_bucket(interval {step}, timestamp) as timestamp, {value} as value from {source} group by 1, 2),
    near as (select *, lead(timestamp) over (partition by {key} order by timestamp) as next_t, lead(value) over (partition by {key} order by timestamp) as next_v from bins),
    slots as (select *, unnest(case when next_t is null then [timestamp] else generate_series(timestamp, next_t - interval {step}, interval {step}) end) as slot from near),
    s as (select {key}, slot as timestamp, case when slot = timestamp then value
            else value + (next_v - value) * ((epoch_us(slot) - epoch_us(timestamp)) / (epoch_us(next_t) - epoch_us(timestamp))) end as value, slot <> timestamp as filled from slots)"""


def spectral_sql(key: str, step_us: int, *, margin: float = 5.5, confidence: float = 3.0, ratio: float = 0.9) -> str:
    """CTE ``sr``: spectral residual of ``s`` with the default window, written out as sums over (point, frequency).

    A point sees 43 values before it and 5 behind it, 49 in all; values that are not there lie on the baseline. Its spectrum is the sum of the values times the turns of each frequency, its
    saliency map the sum of the residual spectrum times the turns back. Baselines are medians of the same phase within two periods of 22 on each side.
    """
    turn = "2 * pi() * ((a.m * b.m) % 49) / 49"
    same = f"y.{key} = x.{key}"
    return f"""pt as materialized (select {key}, timestamp, value, filled, epoch_us(timestamp) // {step_us}::bigint as i from s),
    bl as (select x.{key}, x.i, count(*) as seen, avg(y.value) as plain, median(y.value) filter (where (y.i - x.i) % 22 = 0) as seasonal
           from pt x join pt y on {same} and y.i between x.i - 44 and x.i + 44 group by 1, 2),
    rs as materialized (select pt.*, case when seen >= 44 then seasonal else plain end as baseline, value - case when seen >= 44 then seasonal else plain end as rest from pt join bl using ({key}, i)),
    wi as (select x.{key}, x.i, y.i - x.i + 43 as m, y.rest as v from rs x join rs y on {same} and y.i between x.i - 43 and x.i + 5),
    ok as (select {key}, i from wi group by 1, 2 having greatest(max(v), case when count(*) < 49 then 0 else max(v) end) - least(min(v), case when count(*) < 49 then 0 else min(v) end) >= 1e-9),
    fr as (select unnest(range(49)) as m),
    sp as (select {key}, i, b.m, sum(v * cos({turn})) as re, -sum(v * sin({turn})) as im from wi a join ok using ({key}, i), fr b group by 1, 2, 3),
    am as (select *, sqrt(re * re + im * im) as amp, case when sqrt(re * re + im * im) < 1e-12 then 0.0 else ln(sqrt(re * re + im * im)) end as lg from sp),
    rd as (select {key}, i, m, case when amp < 1e-12 then 0.0 else re / amp end as ur, case when amp < 1e-12 then 0.0 else im / amp end as ui,
            exp(lg - (coalesce(lag(lg) over w, lg) + lg + coalesce(lead(lg) over w, lg)) / 3) as size from am window w as (partition by {key}, i order by m)),
    sa as (select {key}, i, b.m, sqrt(pow(sum(size * (ur * cos({turn}) - ui * sin({turn}))), 2) + pow(sum(size * (ur * sin({turn}) + ui * cos({turn}))), 2)) / 49 as sal
           from rd a, fr b group by 1, 2, 3),
    jd as (select {key}, i, max(sal) filter (where m = 43) as own, avg(sal) filter (where m between 22 and 42) as local, greatest(1e-9, 0.05 * avg(sal)) as least_local from sa group by 1, 2),
    md as (select x.{key}, x.i, median(y.rest) as mid from rs x join rs y on {same} and y.i between x.i - 44 and x.i + 44 group by 1, 2),
    ad as (select x.{key}, x.i, any_value(md.mid) as mid, 1.4826 * median(abs(y.rest - md.mid)) as spread
           from rs x join md on md.{key} = x.{key} and md.i = x.i join rs y on {same} and y.i between x.i - 44 and x.i + 44 group by 1, 2),
    fl as (select rs.*, coalesce(greatest((own - local) / greatest(local, least_local), 0), 0.0) as score, abs(rest - mid) > greatest({margin} * spread, 1e-9) as off
           from rs join ad using ({key}, i) left join jd using ({key}, i)),
    rk as (select *, score >= {confidence} and off as hit, row_number() over (partition by {key} order by (score >= {confidence} and off) desc, score desc, timestamp) as place,
            floor({ratio} * count(*) over (partition by {key})) as room from fl),
    sr as (select {key}, timestamp, value, filled, baseline, score, case when hit and place <= room then 1 else 0 end as anomaly from rk)"""


def cusum_sql(key: str, threshold: float, drift: float = 0.5) -> str:
    """CTE ``cu``: two-sided cumulative sums of ``s``: the running sum less its least value so far."""
    return f"""lv as (select {key}, avg(value) as mean, stddev_pop(value) as sd from s group by 1),
    zs as (select s.*, mean, case when sd > 1e-9 * greatest(1.0, abs(mean)) then (value - mean) / sd else 0.0 end as z from s join lv using ({key})),
    ps as (select *, sum(z - {drift}) over w as p, sum(-z - {drift}) over w as q from zs window w as (partition by {key} order by timestamp)),
    us as (select *, p - least(0.0, min(p) over w) as up, q - least(0.0, min(q) over w) as down from ps window w as (partition by {key} order by timestamp)),
    cu as (select {key}, timestamp, value, filled, mean as baseline, greatest(up, down) as score,
            case when round(greatest(up, down), 9) > {threshold} then case when up >= down then 1 else -1 end else 0 end as anomaly from us)"""


add(
    "E14_statistical_anomalies",
    e.e14_statistical_anomalies,
    "wind",
    "with " + series_sql("wind", "turbine_id", "avg(vibration_mm_s)", "6 hour", since("20m")) + ", " + decompose_sql("turbine_id", 1.0)
    + "\n--\nselect turbine_id, timestamp, value as vibration, anomaly as anomalies, score, baseline from d",
    "vibration,score,baseline",
)
add(
    "E15_asset_status",
    e.e15_asset_status,
    "wind",
    f'select turbine_id, timestamp, power_mw as "Power_MW", vibration_mm_s as "Vibration_mm_s" from wind where {since("10m")}',
)
add(
    "E16_solar_by_park",
    lambda t, c: e.e16_solar_by_park(t, c, PARKS, "south"),
    "solar",
    f"""select {bin_of('bin10s')} as timestamp, case left(inverter_id::varchar, 1) when '1' then 'north' else 'south' end as park,
        sum(power_kw) / 1000 as "MW" from solar where {since('15m')} group by 1, 2""",
    "MW",
)
add(
    "E17_inverter_efficiency",
    e.e17_inverter_efficiency,
    "solar",
    f"""select inverter_id as "Inverter", {r('power_kw', 0)} as "Power_kW", {r('efficiency_pct', 1)} as "Efficiency_Pct", panel_temp_c as "Panel_Temp_C"
        from {_now('solar', 'inverter_id', '30s', 'power_kw, irradiance_wm2, efficiency_pct, panel_temp_c')} where irradiance_wm2 > 100""",
)
add(
    "E18_co2_rate",
    e.e18_co2_rate,
    "gas",
    f'select {bin_of("bin30s")} as timestamp, plant_name, avg(co2_kg_per_hour) as "CO2_kg_per_hr" from gas where {since("15m")} group by 1, 2',
    "CO2_kg_per_hr",
)
add(
    "E19_ets_daily",
    e.e19_ets_daily,
    "gas",
    f"""select plant_name as "Plant", {r('compliance_pct', 1)} as "Used (%)", cumulative_co2_tonnes_today as "Cumulative tCO2", ets_daily_allowance_tonnes as "Daily Cap tCO2"
        from {_now('gas', 'plant_id', '2m', 'plant_name, compliance_pct, cumulative_co2_tonnes_today, ets_daily_allowance_tonnes')}""",
)
add(
    "E20_island_frequency",
    lambda t, c: e.e20_island_frequency(t, c, MAINLAND),
    "grid",
    f"select {bin_of('bin10s')} as timestamp, grid_name, avg(frequency_hz) as freq from grid where {since('15m')} and grid_id <> {MAINLAND} group by 1, 2",
    "freq",
)
add(
    "E21_mainland_balance",
    lambda t, c: e.e21_mainland_balance(t, c, MAINLAND),
    "grid",
    f'select timestamp, load_mw as "Load_MW", generation_mw as "Generation_MW" from grid where {since("15m")} and grid_id = {MAINLAND}',
    "Generation_MW",
)
add(
    "E22_grid_status",
    e.e22_grid_status,
    "grid",
    f"""select grid_name as "Grid", {r('frequency_hz', 3)} as "Frequency_Hz", {r('load_mw', 1)} as "Load_MW", {r('generation_mw', 1)} as "Gen_MW",
        {r('voltage_kv', 1)} as "Voltage_kV", {r('balance_mw', 2)} as "Balance_MW"
        from {_now('grid', 'grid_id', '30s', 'grid_name, frequency_hz, load_mw, generation_mw, voltage_kv, balance_mw')}""",
)
add(
    "E23_vessel_positions",
    e.e23_vessel_positions,
    "pos",
    f"""select vessel_name, vessel_type, latitude, longitude, speed_knots, destination, eta_hours, 30 as marker_size
        from {_now('pos', 'vessel_id', '2m', 'vessel_name, vessel_type, latitude, longitude, speed_knots, destination, eta_hours')}""",
    "latitude,longitude,speed_knots,eta_hours",
)
add(
    "E24_fleet_status",
    e.e24_fleet_status,
    "pos",
    f"""select vessel_name as "Vessel", vessel_type as "Type", {r('latitude', 4)} as "Lat", {r('longitude', 4)} as "Lon", speed_knots as "Speed_kn",
        heading_deg as "Heading", destination as "Destination", eta_hours as "ETA_h", cargo_status as "Cargo"
        from {_now('pos', 'vessel_id', '2m', 'vessel_name, vessel_type, latitude, longitude, speed_knots, heading_deg, destination, eta_hours, cargo_status')}""",
    "Heading,ETA_h,Speed_kn",
)
for _name, _build, _col, _out in (("E25_vessel_speed", e.e25_vessel_speed, "speed_knots", "speed"), ("E26_eta_countdown", e.e26_eta_countdown, "eta_hours", "eta")):
    add(_name, _build, "pos", f"select {bin_of('bin30s')} as timestamp, vessel_name, avg({_col}) as {_out} from pos where {since('15m')} group by 1, 2", _out)
add("E27_vessel_layer", e.e27_vessel_layer, "pos", f"select * from {_now('pos', 'vessel_id', '2m', 'vessel_name, vessel_type, latitude, longitude')}", "latitude,longitude")
add("E28_wind_layer", e.e28_wind_layer, "wind", f"select * from {_now('wind', 'turbine_id', '2m', 'power_mw, latitude, longitude')}", "latitude,longitude")
add("E29_solar_layer", e.e29_solar_layer, "solar", f"select * from {_now('solar', 'inverter_id', '2m', 'panel_temp_c, latitude, longitude')}", "latitude,longitude")
add(
    "E30_gas_layer",
    e.e30_gas_layer,
    "gas power_plants",
    f"""select plant_id, p.plant_name, co2_kg_per_hour, p.latitude, p.longitude
        from {_now('gas', 'plant_id', '2m', 'co2_kg_per_hour')} left join power_plants p using (plant_id)""",
    "co2_kg_per_hour,latitude,longitude",
)


def _live(view: str, key: str, cols: str) -> str:
    """Latest value of each channel per key, over all time."""
    picked = ", ".join(f"arg_max({c.strip()}, timestamp) as live_{c.strip()}" for c in cols.split(","))
    return f"(select {key}, {picked} from {view} group by {key})"


def _ask(name: str, build: Callable[[SfTables], DataFrame], views: str, body: str, doubles: str = "") -> None:
    add(name, lambda t, c: build(t), views, body, doubles)


_ask("G01_plants", g.g01_plants, "power_plants", "select plant_name, plant_type, fuel_type, capacity_mw, region, prefecture from power_plants")
_ask(
    "G02_turbines_by_plant",
    g.g02_turbines_by_plant,
    "wind_turbines power_plants",
    "select p.plant_name, turbine_id, turbine_name, manufacturer, model, w.capacity_mw from wind_turbines w left join power_plants p using (plant_id)",
    "capacity_mw",
)
_ask(
    "G03_inverters_at",
    lambda t: g.g03_inverters_at(t, "NATION_4"),
    "solar_inverters power_plants",
    "select inverter_id, inverter_name, manufacturer, panel_type, capacity_kw from solar_inverters join power_plants using (plant_id) where plant_name = 'NATION_4'",
)
_ask("G04_grids", g.g04_grids, "island_grids", "select grid_id, grid_name, island, region, installed_capacity_mw, peak_demand_mw from island_grids")
_ask(
    "G05_substations",
    g.g05_substations,
    "substations island_grids power_plants",
    """select substation_id, substation_name, voltage_kv, grid_name, plant_name from substations
       left join island_grids on grid_id = connected_grid_id left join power_plants on plant_id = fed_by_plant_id""",
)
_ask(
    "G06_vessels",
    g.g06_vessels,
    "vessels power_plants",
    "select vessel_id, vessel_name, vessel_type, flag, capacity_m3, plant_name from vessels left join power_plants on plant_id = supply_plant_id",
    "capacity_m3",
)
_ask("G07_orders", g.g07_orders, "maintenance_orders", "select order_id, priority, status, asset_id, plant_id, technician, created_date::timestamp as created_date from maintenance_orders")
_ask(
    "G08_emission_records",
    g.g08_emission_records,
    "emissions_ledger",
    "select record_id, plant_name, period, co2_tonnes, ets_allowance_tonnes, compliance_status from emissions_ledger",
    "ets_allowance_tonnes",
)
_ask(
    "G09_wind_farm_capacity",
    g.g09_wind_farm_capacity,
    "power_plants wind_turbines",
    """select plant_name, turbine_id, manufacturer, w.capacity_mw, p.capacity_mw as plant_mw, turbines_mw, turbines from power_plants p
       left join (select plant_id, sum(capacity_mw) as turbines_mw, count(*) as turbines from wind_turbines group by 1) s using (plant_id)
       left join wind_turbines w using (plant_id) where plant_type = 'Wind Farm'""",
    "capacity_mw,turbines_mw",
)
_ask(
    "G10_plant_connections",
    g.g10_plant_connections,
    "power_plants substations island_grids",
    """select plant_name, substation_name, grid_name from power_plants left join substations on fed_by_plant_id = plant_id
       left join island_grids on grid_id = grid_zone""",
)
_ask(
    "G11_turbine_sites",
    g.g11_turbine_sites,
    "wind_turbines power_plants",
    "select turbine_id, turbine_name, plant_name, region, prefecture from wind_turbines left join power_plants using (plant_id)",
)
_ask(
    "G12_inverter_grids",
    g.g12_inverter_grids,
    "solar_inverters power_plants island_grids",
    "select inverter_id, inverter_name, plant_name, grid_name from solar_inverters left join power_plants using (plant_id) left join island_grids on grid_id = grid_zone",
)
_ask(
    "G13_vessel_positions",
    g.g13_vessel_positions,
    "vessels pos power_plants",
    f"""select v.vessel_id, vessel_name, vessel_type, plant_name, live_latitude, live_longitude, live_speed_knots, live_destination from vessels v
        left join {_live('pos', 'vessel_id', 'latitude, longitude, speed_knots, destination')} l using (vessel_id) left join power_plants on plant_id = supply_plant_id""",
    "live_latitude,live_longitude,live_speed_knots",
)
_ask(
    "G14_turbine_power",
    g.g14_turbine_power,
    "wind_turbines wind power_plants",
    f"""select turbine_id, plant_name, manufacturer, w.capacity_mw, live_power_mw from wind_turbines w
        left join {_live('wind', 'turbine_id', 'power_mw')} l using (turbine_id) left join power_plants using (plant_id)""",
    "capacity_mw",
)
_ask(
    "G15_inverter_power",
    g.g15_inverter_power,
    "solar_inverters solar power_plants",
    f"""select inverter_id, plant_name, manufacturer, capacity_kw, live_power_kw from solar_inverters
        left join {_live('solar', 'inverter_id', 'power_kw')} l using (inverter_id) left join power_plants using (plant_id)""",
    "live_power_kw",
)
_ask(
    "G16_vessel_courses",
    g.g16_vessel_courses,
    "vessels pos power_plants",
    f"""select vessel_id, vessel_name, plant_name, live_speed_knots, live_heading_deg from vessels
        left join {_live('pos', 'vessel_id', 'speed_knots, heading_deg')} l using (vessel_id) left join power_plants on plant_id = supply_plant_id""",
    "live_speed_knots,live_heading_deg",
)
_ask(
    "G17_turbine_wind",
    g.g17_turbine_wind,
    "wind_turbines wind",
    f"""select turbine_id, turbine_name, capacity_mw, live_wind_speed_ms, live_power_mw from wind_turbines
        left join {_live('wind', 'turbine_id', 'wind_speed_ms, power_mw')} l using (turbine_id)""",
    "capacity_mw",
)
_ask(
    "G18_inverter_irradiance",
    g.g18_inverter_irradiance,
    "solar_inverters solar",
    f"""select inverter_id, inverter_name, capacity_kw, live_irradiance_wm2, live_power_kw from solar_inverters
        left join {_live('solar', 'inverter_id', 'irradiance_wm2, power_kw')} l using (inverter_id)""",
    "live_power_kw",
)
_ask(
    "G19_grid_state",
    g.g19_grid_state,
    "island_grids grid",
    f"""select grid_id, grid_name, installed_capacity_mw, live_frequency_hz, live_load_mw, live_generation_mw from island_grids
        left join {_live('grid', 'grid_id', 'frequency_hz, load_mw, generation_mw')} l using (grid_id)""",
    "live_frequency_hz,live_generation_mw",
)
_ask(
    "G20_plants_in_prefecture",
    lambda t: g.g20_plants_in_prefecture(t, "Prefecture 2"),
    "power_plants",
    "select plant_id, plant_name, plant_type, fuel_type, capacity_mw from power_plants where prefecture = 'Prefecture 2'",
)
_ask(
    "G21_plants_in_region",
    lambda t: g.g21_plants_in_region(t, "ASIA"),
    "power_plants",
    "select plant_id, plant_name, plant_type, fuel_type, grid_zone from power_plants where region = 'ASIA'",
)
_ask(
    "G22_active_orders",
    g.g22_active_orders,
    "maintenance_orders",
    "select order_id, asset_id, plant_id, priority, technician, status from maintenance_orders where status in ('Open', 'In Progress')",
)
_ask(
    "G23_critical_orders",
    lambda t: g.g23_critical_orders(t, "1-URGENT"),
    "maintenance_orders",
    "select order_id, priority, status, asset_id, plant_id, technician from maintenance_orders where priority = '1-URGENT'",
)
_ask(
    "G24_orders_completed",
    lambda t: g.g24_orders_completed(t, 1998),
    "maintenance_orders",
    """select order_id, technician, asset_id, plant_id, cost_eur, completed_date::timestamp as completed_date from maintenance_orders
       where status = 'Completed' and year(completed_date) = 1998""",
)
_ask(
    "G25_farm_network",
    lambda t: g.g25_farm_network(t, "NATION_3"),
    "power_plants wind_turbines substations island_grids",
    """with p as (select plant_id, plant_name, grid_name from power_plants left join island_grids on grid_id = grid_zone where plant_name = 'NATION_3')
--
select plant_name, grid_name, 'turbine' as role, turbine_name as name, manufacturer, capacity_mw from p join wind_turbines using (plant_id)
union all select plant_name, grid_name, 'substation', substation_name, null, null from p join substations on fed_by_plant_id = plant_id""",
    "capacity_mw",
)
_ask(
    "G26_plant_supply",
    lambda t: g.g26_plant_supply(t, "NATION_5"),
    "power_plants substations vessels",
    """with p as (select plant_id, plant_name, capacity_mw, region from power_plants where plant_name = 'NATION_5')
--
select plant_name, capacity_mw, region, 'substation' as role, substation_name as name from p left join substations on fed_by_plant_id = plant_id
union all select plant_name, capacity_mw, region, 'vessel', vessel_name from p left join vessels on supply_plant_id = plant_id""",
)
_ask(
    "G27_wind_farm_power",
    g.g27_wind_farm_power,
    "wind_turbines wind power_plants",
    f"""select p.plant_name, turbine_id, manufacturer, w.capacity_mw, live_power_mw from wind_turbines w
        left join {_live('wind', 'turbine_id', 'power_mw')} l using (turbine_id) join power_plants p using (plant_id) where plant_type = 'Wind Farm'""",
    "capacity_mw",
)
