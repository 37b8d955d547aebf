import pytest
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock
from meltemi.operators import assets, emissions, graph
from meltemi.operators.entities import entity_view
from meltemi.plans import questions as g
from meltemi.plans import tiles as e
from meltemi.session import shared_dir
from meltemi.plans.ontology import ENTITIES, ONTOLOGY
from tests.seed import NOW, feed, tables


@pytest.fixture(scope="module")
def clock():
    return Clock(F.lit(NOW))


@pytest.fixture(scope="module")
def static(spark):
    return tables(spark)


def wind(tid, ago, **kw):
    return {"turbine_id": tid, "ago": ago, "fault_type": "NONE", **kw}


def test_generation_with_silent_sources(spark, clock):
    t = tables(spark, wind=[wind("WT-1", 5, power_mw=2.0), wind("WT-1", 9, power_mw=4.0), wind("WT-2", 30, power_mw=4.0)], solar=[{"inverter_id": "SI-1", "ago": 3, "power_kw": 500.0}])
    # A report exactly 30 s old is outside; no gas plant reported.
    assert e.e01_total_generation(t, clock).first().MW == 2.5
    assert e.e02_renewable_pct(t, clock).first().Renewable_Pct == 100.0
    assert {r.Source: r.MW for r in e.e07_generation_mix(t, clock).collect()} == {"Wind": 2.0, "Solar": 0.5, "Gas": 0.0}


def test_generation_when_all_are_silent(spark, clock, static):
    assert e.e01_total_generation(static, clock).first().MW == 0.0
    assert e.e02_renewable_pct(static, clock).first().Renewable_Pct is None
    assert e.e06_ets_used_pct(static, clock).first().ETS_Pct is None
    assert e.e05_vessels_inbound(static, clock).first().Vessels == 0
    assert e.e03_mainland_frequency(static, clock).count() == 0


def test_faults_by_meaning_and_by_spelling(spark, clock):
    t = tables(
        spark,
        wind=[
            wind("WT-1", 5, vibration_mm_s=5.5, power_mw=1.234), wind("WT-1", 7, vibration_mm_s=8.0, power_mw=1.0),
            wind("WT-2", 5, vibration_mm_s=7.0, power_mw=1.0), wind("WT-3", 5, vibration_mm_s=5.0, power_mw=1.0),
            wind("WT-4", 5, vibration_mm_s=0.0, power_mw=0.0, fault_type="DEMO_FORCED_FAILURE"),
            wind("WT-5", 5, vibration_mm_s=9.0, power_mw=1.0, fault_type=None), wind("WT-6", 5, vibration_mm_s=9.0, power_mw=1.0, fault_type=""),
            wind("WT-7", 500, vibration_mm_s=9.0, power_mw=1.0),
        ],
    )
    got = {r.Asset: (r.Spikes, r.Max_Vib, r.Min_Power_MW, r.Severity) for r in e.e09_active_faults(t, clock).collect()}
    assert got == {
        "WT-1": (2, 8.0, 1.0, "CRITICAL"), "WT-2": (1, 7.0, 1.0, "WARNING"), "WT-4": (1, 0.0, 0.0, "OFFLINE"),
        "WT-5": (1, 9.0, 1.0, "CRITICAL"), "WT-6": (1, 9.0, 1.0, "CRITICAL"),
    }
    spelled = {r.Asset: r.Severity for r in e.e09_active_faults(t, clock, lexical=True).collect()}
    assert spelled["WT-1"] == "WARNING"
    board = {r.Turbine_ID: r for r in e.e12_anomaly_leaderboard(t, clock).collect()}
    assert board["WT-1"].Avg_Vib == 6.75 and board["WT-3"].Severity == "Elevated"
    assert {r.Turbine_ID: r.Severity for r in e.e12_anomaly_leaderboard(t, clock, lexical=True).collect()}["WT-1"] == "WARNING"
    assert e.e04_critical_faults(t, clock).first().Faults == 3


def test_regions_and_over_counting(spark, clock):
    t = tables(spark, wind=[wind("wt-nax-04", 1, power_mw=1.0), wind("WT-NAX-04", 3, power_mw=1.0), wind("WT-XX-1", 3, power_mw=1.0)])
    got = {r.region: r.total_mw for r in e.e10_wind_by_region(t, clock).collect()}
    assert got == {"Naxos (Cyclades)": 2.0, "other": 1.0}
    assert sum(r.MW for r in e.e08_total_generation_trend(t, clock).collect()) == 3.0
    t["wind"] = feed(spark, "wind", wind("A", 1, power_mw=4.0), wind("A", 3, power_mw=2.0))
    assert [r.MW for r in e.e08_total_generation_trend(t, clock, per_entity=True).collect()] == [3.0]


def test_one_asset_lines(spark, clock):
    t = tables(spark, wind=[wind("WT-NAX-07", 2, vibration_mm_s=3.0, power_mw=1.0), wind("WT-NAX-04", 2, vibration_mm_s=4.0, power_mw=1.0)])
    assert [r.Vibration_mm_s for r in e.e11_bearing_line(t, clock, ["WT-NAX-07"]).collect()] == [3.0]
    assert e.e15_asset_status(t, clock).count() == 2


def test_statistical_anomaly_tile(spark, clock):
    rows = [wind("WT-NAX-07", 5 * i + 1, vibration_mm_s=2.0 + (i % 4) * 0.2) for i in range(200)]
    rows[50]["vibration_mm_s"] = 28.0
    t = tables(spark, wind=rows)
    got = e.e14_statistical_anomalies(t, clock, ["WT-NAX-07"]).where("anomalies <> 0").collect()
    assert [(r.vibration, r.anomalies) for r in got] == [(28.0, 1)]


def test_grid_and_vessel_tiles(spark, clock):
    t = tables(
        spark,
        grid=[
            {"grid_id": "GR-MAIN", "grid_name": "Mainland Grid", "ago": 2, "frequency_hz": 49.98765, "load_mw": 10.0, "generation_mw": 11.0},
            {"grid_id": "GR-NAX", "grid_name": "Naxos Grid", "ago": 1, "frequency_hz": 50.1, "load_mw": 1.0, "generation_mw": 1.0},
        ],
        vessel_positions=[
            {"vessel_id": "VE-1", "vessel_name": "One", "ago": 3, "eta_hours": 5.0, "speed_knots": 18.0}, {"vessel_id": "VE-1", "vessel_name": "One", "ago": 1, "eta_hours": 0.0, "speed_knots": 0.0},
            {"vessel_id": "VE-2", "vessel_name": "Two", "ago": 1, "eta_hours": 2.0, "speed_knots": 17.0, "latitude": 37.123456, "longitude": 25.0},
        ],
    )
    assert e.e03_mainland_frequency(t, clock).first().Hz == 49.988
    assert [r.grid_name for r in e.e20_island_frequency(t, clock).collect()] == ["Naxos Grid"]
    assert e.e21_mainland_balance(t, clock).count() == 1
    assert e.e05_vessels_inbound(t, clock).first().Vessels == 1
    fleet = e.e24_fleet_status(t, clock).collect()
    assert [r.Vessel for r in fleet] == ["One", "Two"] and fleet[1].Lat == 37.1235
    assert e.e23_vessel_positions(t, clock).first().marker_size == 30


@pytest.mark.parametrize("name", sorted(e.TILES))
def test_every_tile_runs_on_the_real_schemas(static, clock, name):
    e.TILES[name](static, clock).collect()


def test_tile_inventory():
    assert sorted(e.TILES) == [f"E{i:02d}" for i in range(1, 31)]
    assert sorted(g.QUESTIONS) == [f"G{i:02d}" for i in range(1, 28)]


@pytest.mark.parametrize("name", sorted(g.QUESTIONS))
def test_every_question_runs_on_the_real_schemas(static, name):
    g.QUESTIONS[name](static).collect()


@pytest.mark.parametrize("name", ["G13", "G14", "G15", "G16", "G17", "G18", "G19", "G27"])
def test_live_questions_agree_with_and_without_a_clock(spark, clock, name):
    t = tables(
        spark,
        wind=[wind("WT-NAX-01", 5, power_mw=1.0, wind_speed_ms=7.0), wind("WT-THR-01", 200_000, power_mw=3.0)],
        solar=[{"inverter_id": "SI-CRE-01", "ago": 4, "power_kw": 10.0}],
        grid=[{"grid_id": "GR-NAX", "ago": 100_000, "frequency_hz": 50.0}],
        vessel_positions=[{"vessel_id": "VE-SVC-01", "ago": 1, "speed_knots": 3.0}],
    )
    ask = g.QUESTIONS[name]
    assert sorted(map(str, ask(t).collect())) == sorted(map(str, ask(t, clock).collect()))


def test_known_answers(static):
    assert {r.plant_id for r in g.g20_plants_in_prefecture(static).collect()} == {"PP-TIN-01", "PP-NAX-01"}
    assert {(r.plant_id, r.grid_zone) for r in g.g21_plants_in_region(static).collect()} == {("PP-TIN-01", "GR-TIN"), ("PP-NAX-01", "GR-NAX")}
    assert {r.order_id for r in g.g22_active_orders(static).collect()} == {"MO-2026-012", "MO-2026-015"}
    assert [r.order_id for r in g.g23_critical_orders(static).collect()] == ["MO-2026-015"]
    done = g.g24_orders_completed(static).collect()
    assert len(done) == 11 and sum(r.cost_eur for r in done) == 99_850
    totals = {r.plant_name: (r.plant_mw, round(r.turbines_mw, 1)) for r in g.g09_wind_farm_capacity(static).collect()}
    assert totals == {"Thrace Wind Complex": (120.0, 33.6), "Tinos Wind Farm": (17.0, 17.0), "Naxos Wind Farm": (29.4, 29.4)}
    naxos = g.g25_farm_network(static).collect()
    assert sum(r.role == "turbine" for r in naxos) == 7 and {r.grid_name for r in naxos} == {"Naxos Grid"}
    assert [r.name for r in naxos if r.role == "substation"] == ["Naxos Substation"]
    lavrio = g.g26_plant_supply(static).collect()
    assert {(r.role, r.name) for r in lavrio} == {("substation", "Lavrio Substation"), ("vessel", "Hellas Spirit")}
    assert {(r.capacity_mw, r.region) for r in lavrio} == {(400.0, "Attica")}
    assert g.g03_inverters_at(static).count() == 7
    stations = {r.substation_id: r.plant_name for r in g.g05_substations(static).collect()}
    assert len(stations) == 8 and stations["SUB-SYR-01"] is None


def test_seed_values_are_enumerated(static):
    from meltemi.functions.terms import ENUMS, unknown_values

    for entity in ENUMS:
        if entity != "Vessel":
            assert unknown_values(static[ENTITIES[entity].table], entity).count() == 0, entity
    odd = static["maintenance_orders"].withColumn("priority", F.when(F.col("priority") == "Critical", "critical").otherwise(F.col("priority")))
    assert [tuple(r) for r in unknown_values(odd, "MaintenanceOrder").collect()] == [("priority", "critical", 1)]


def test_edges_and_quality(static):
    counts = {r.rel: r["count"] for r in graph.edges(static, ONTOLOGY).groupBy("rel").count().collect()}
    assert counts == {
        "belongs_to_plant": 20, "installed_at_plant": 15, "supplies_plant": 3, "fed_by_plant": 7, "feeds_grid": 8, "servicing_asset": 15, "emitted_by_plant": 8,
    }
    assert graph.dangling(static, ONTOLOGY).count() == 0
    assert {(r.type, r.id) for r in graph.isolated(static, ONTOLOGY).collect()} == {("Grid", "GR-MYK")}
    assert graph.grid_disagreement(static).count() == 0
    assert [r.plant_id for r in graph.capacity_mismatch(static).collect()] == ["PP-THR-01"]
    broken = dict(static)
    broken["wind_turbines"] = static["wind_turbines"].withColumn("plant_id", F.when(F.col("turbine_id") == "WT-THR-01", "PP-GONE").otherwise(F.col("plant_id")))
    assert [(r.src_id, r.dst_id) for r in graph.dangling(broken, ONTOLOGY).collect()] == [("WT-THR-01", "PP-GONE")]


def test_subgraph_of_a_seed(spark, static):
    seed = spark.createDataFrame([("PowerPlant", "PP-NAX-01")], "type string, id string")
    nodes, edges = graph.subgraph(static, ONTOLOGY, ["belongs_to_plant", "fed_by_plant", "supplies_plant"], seeds=seed)
    assert edges.count() == 9 and nodes.count() == 10
    all_nodes, _ = graph.subgraph(static, ONTOLOGY, ["feeds_grid"])
    assert all_nodes.where("type = 'Grid'").count() == 5


def test_hops_add_a_constant_to_the_plan(spark, static):
    seed = spark.createDataFrame([("PowerPlant", "PP-NAX-01")], "type string, id string")
    sizes = []
    for hops in range(1, 6):
        nodes, _ = graph.subgraph(static, ONTOLOGY, ["belongs_to_plant", "fed_by_plant", "supplies_plant"], seeds=seed, hops=hops)
        sizes.append(len(nodes._jdf.queryExecution().executedPlan().toString().splitlines()))
    assert len(set(sizes)) == 1


def test_entity_view_keeps_silent_assets_and_renames(spark, clock):
    t = tables(spark, vessel_positions=[{"vessel_id": "VE-SVC-01", "ago": 3, "cargo_status": "On station"}, {"vessel_id": "VE-SVC-01", "ago": 300, "cargo_status": "Loaded"}, {"vessel_id": "VE-LNG-01", "ago": 4000, "cargo_status": "Loaded"}])
    now = {r.vessel_id: r.live_status for r in entity_view(t, ENTITIES["Vessel"], clock=clock, span="2m").collect()}
    assert now == {"VE-SVC-01": "On station", "VE-LNG-01": None, "VE-LNG-02": None}
    ever = {r.vessel_id: r.live_status for r in entity_view(t, ENTITIES["Vessel"]).collect()}
    assert ever["VE-LNG-01"] == "Loaded"


def test_recent_events_first_gives_the_same_view(spark, clock):
    rows = [wind("WT-NAX-01", 5, power_mw=1.0), wind("WT-NAX-01", 5000, power_mw=2.0), wind("WT-NAX-02", 7200, power_mw=3.0), wind("WT-NAX-02", 9000, power_mw=4.0), wind("WT-UNKNOWN", 9000, power_mw=9.0)]
    t = tables(spark, wind=rows)
    cols = ["turbine_id", "live_power_mw"]
    whole = {tuple(r) for r in entity_view(t, ENTITIES["WindTurbine"]).select(*cols).collect()}
    parts = {tuple(r) for r in entity_view(t, ENTITIES["WindTurbine"], clock=clock, recent="1 hour").select(*cols).collect()}
    assert whole == parts and ("WT-NAX-02", 3.0) in parts and len(parts) == 20


def test_older_events_are_read_for_missing_keys_only(spark, clock):
    t = tables(spark, vessel_positions=[{"vessel_id": v, "ago": 3, "cargo_status": "Loaded"} for v in ("VE-LNG-01", "VE-LNG-02", "VE-SVC-01")])
    view = entity_view(t, ENTITIES["Vessel"], clock=clock, recent="1 hour")
    assert "LeftSemi" in view._jdf.queryExecution().optimizedPlan().toString()
    assert {r.live_status for r in view.where("live_status is not null").collect()} == {"Loaded"}


def test_ledger_rollup_matches_the_seed(static):
    rows = {(r.plant_id, r.period): r for r in emissions.ledger_rollup(static["emissions_ledger"]).collect()}
    seed = {(r.plant_id, r.period): r for r in static["emissions_ledger"].collect()}
    assert len(rows) == 8
    for key, row in rows.items():
        assert row.compliance_pct == pytest.approx(seed[key].compliance_pct, abs=0.06)
    assert {k for k, r in rows.items() if r.compliance_status == "Near Limit"} == {("PP-LAV-01", "2026-03"), ("PP-MEG-01", "2026-03")}
    assert rows["PP-LAV-01", "2026-01"].fuel_mwh == pytest.approx(52857, abs=1)


def test_emission_integral_and_daily_cap(spark):
    df = feed(
        spark, "emissions",
        *[{"plant_id": "P", "ago": s, "co2_kg_per_hour": 1000.0, "cumulative_co2_tonnes_today": 5000.0, "ets_daily_allowance_tonnes": 2100.0} for s in (7200, 3600, 0)],
    )
    row = emissions.integrated_emissions(df).first()
    assert (row.co2_tonnes, row.hours, row.period) == (2.0, 2.0, "2026-04")
    assert emissions.daily_compliance(df).first().compliance_pct == 150.0


def test_wind_and_solar_performance(spark, static):
    t = feed(spark, "wind", wind("WT-NAX-01", 5, power_mw=2.1, wind_speed_ms=12.0), wind("WT-NAX-01", 7, power_mw=2.1, wind_speed_ms=2.0))
    row = assets.wind_performance(t, static["wind_turbines"], "1 day").first()
    assert row.expected_mw == pytest.approx(2.1) and row.gap_mw == pytest.approx(0.0) and row.capacity_factor == pytest.approx(0.5)
    s = feed(spark, "solar", {"inverter_id": "SI-THE-01", "ago": 5, "power_kw": 4000.0, "irradiance_wm2": 900.0, "panel_temp_c": 20.0})
    row = assets.solar_performance(s, static["solar_inverters"], "1 day").first()
    assert row.performance_ratio == pytest.approx(4 / 9) and row.soiled


def test_grid_balance_and_cadence(spark, static):
    t = feed(spark, "grid", *[{"grid_id": "GR-NAX", "ago": s, "frequency_hz": f, "load_mw": 10.0, "generation_mw": 12.0} for s, f in ((2, 50.0), (4, 50.3), (6, 49.7))])
    row = assets.grid_balance(t, static["island_grids"], "1 day").first()
    assert row.balance_mw == 2.0 and row.max_deviation_hz == pytest.approx(0.3) and row.out_of_band_min == pytest.approx(4 / 60)
    w = feed(spark, "wind", *[wind("WT-1", s) for s in (0, 2, 4, 6, 20)])
    row = assets.cadence_report(w, "stream_type", "turbine_id", {"WindTurbineTelemetry": 2.0}).first()
    assert (row.intervals, row.median_s, row.max_s, row.gaps) == (4, 2.0, 14, 1)


def test_hops_look_up_new_nodes_only(spark, static, monkeypatch):
    """The frontiers of all hops are disjoint, and together the nodes reached before the last hop."""
    folders = []
    monkeypatch.setattr(graph, "shared_dir", lambda s, purpose: folders.append(shared_dir(s, purpose)) or folders[-1])
    seed = spark.createDataFrame([("PowerPlant", "PP-NAX-01"), ("PowerPlant", "PP-NAX-01")], "type string, id string")
    rels = ["belongs_to_plant", "fed_by_plant", "supplies_plant", "feeds_grid"]
    nodes, edges = graph.subgraph(static, ONTOLOGY, rels, seeds=seed, hops=4)
    fronts = [(r.type, r.id) for r in spark.read.parquet(f"{folders[0]}/nodes").collect()]
    assert len(fronts) == len(set(fronts))
    assert set(fronts) == {tuple(r) for r in graph.subgraph(static, ONTOLOGY, rels, seeds=seed, hops=3)[0].collect()}
    every = graph.edges(static, ONTOLOGY, rels).collect()
    known, want = {("PowerPlant", "PP-NAX-01")}, set()
    for _ in range(4):
        want = {e for e in every if (e.src_type, e.src_id) in known or (e.dst_type, e.dst_id) in known}
        known |= {(e.src_type, e.src_id) for e in want} | {(e.dst_type, e.dst_id) for e in want}
    assert set(edges.collect()) == want and edges.count() == len(want)
    assert {tuple(r) for r in nodes.collect()} == known
