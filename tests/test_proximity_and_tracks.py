import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from meltemi.functions.geo import EARTH_RADIUS_NM
from meltemi.operators import proximity
from meltemi.operators.alerts import maintenance_orders, open_episodes
from meltemi.operators.dispatch import dispatch_orders
from meltemi.operators.proximity import count_within, nearest, within_radius
from meltemi.operators.tracks import arrivals, legs_sailed, packed_routes, time_to_go, track_metrics

T0 = datetime(2026, 1, 1)


def unit(p):
    la, lo = math.radians(p[0]), math.radians(p[1])
    return np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])


def nm(a, b):
    """Arc between two points from their unit vectors."""
    u, v = unit(a), unit(b)
    return EARTH_RADIUS_NM * math.atan2(np.linalg.norm(np.cross(u, v)), float(u @ v))


def points(spark, spots, prefix):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], f"{prefix}id int, {prefix}lat double, {prefix}lon double")


def cloud(seed, n):
    rng = random.Random(seed)
    near = [(rng.uniform(36, 39), rng.uniform(23, 27)) for _ in range(n)]
    wide = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    edge = [(rng.uniform(-5, 5), rng.choice([-180.0, 180.0, rng.uniform(-180, -170), rng.uniform(170, 180)])) for _ in range(n)] + [(89.9, rng.uniform(-180, 180)) for _ in range(n // 2)]
    return near + wide + edge


@pytest.mark.parametrize("radius", [5.0, 60.0, 103.7, 411.0, 900.0, 6000.0])
def test_within_radius_equals_brute_force(spark, radius):
    a, b = cloud(1, 12), cloud(2, 12)
    got = within_radius(points(spark, a, "a"), points(spark, b, "b"), radius, left_at=("alat", "alon"), right_at=("blat", "blon"))
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if nm(p, q) <= radius}
    rows = [(r.aid, r.bid) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    counted = count_within(points(spark, a, "a"), points(spark, b, "b"), radius, left_id="aid", left_at=("alat", "alon"), right_at=("blat", "blon"))
    assert {r.aid: r.n for r in counted.collect()} == {i: sum(k == i for k, _ in want) for i in range(len(a))}


def test_nearest_equals_brute_force(spark):
    a, b = cloud(3, 10), cloud(4, 6)
    b += b[:3]
    got = nearest(points(spark, a, "a"), points(spark, b, "b"), left_id="aid", right_id="bid", left_at=("alat", "alon"), right_at=("blat", "blon"))
    rows = {r.aid: (r.bid, r.distance_nm) for r in got.collect()}
    for i, p in enumerate(a):
        best = min(nm(p, q) for q in b)
        assert rows[i][1] == pytest.approx(best, abs=1e-6)
        assert nm(p, b[rows[i][0]]) == pytest.approx(best, abs=1e-6)
    # Twins at one spot: the lowest id.
    assert all(bid < 21 for bid, _ in rows.values())


def test_nearest_without_candidates(spark):
    got = nearest(points(spark, [(1.0, 1.0)], "a"), points(spark, [(0.0, 0.0)], "b").where("false"), left_id="aid", right_id="bid", left_at=("alat", "alon"), right_at=("blat", "blon"))
    assert [tuple(r) for r in got.collect()] == [(0, None, None)]


def test_left_rows_without_a_position_stay(spark):
    a = spark.createDataFrame([(1, 37.0, 25.0), (2, None, 25.0), (3, 37.0, None)], "aid int, alat double, alon double")
    got = nearest(a, points(spark, [(37.0, 25.1), (None, 25.0)], "b"), left_id="aid", right_id="bid", left_at=("alat", "alon"), right_at=("blat", "blon"))
    assert sorted((r.aid, r.bid) for r in got.collect()) == [(1, 0), (2, None), (3, None)]


def crowd(rng, n, lat, lon, wide):
    return [(lat + rng.uniform(0, wide), lon + rng.uniform(0, wide)) for _ in range(n)]


def brute_nearest(a, b):
    u, v = np.array([unit(p) for p in a]), np.array([unit(q) for q in b])
    return 2 * EARTH_RADIUS_NM * np.arcsin(np.minimum(1, np.sqrt(((u[:, None] - v[None]) ** 2).sum(2).min(1)) / 2))


@pytest.mark.parametrize("kind", ["one place", "apart", "world", "poles"])
def test_nearest_in_crowds(spark, kind):
    rng = random.Random(kind)
    a, b = {
        "one place": (crowd(rng, 150, 37, 25, 0.4), crowd(rng, 300, 37, 25, 0.4)),
        "apart": (crowd(rng, 80, 37, 25, 0.01), crowd(rng, 300, 37.5, 26, 0.01) + [(37.0, 24.0)]),
        "world": (cloud(7, 40), cloud(8, 80)),
        "poles": (crowd(rng, 60, 89.5, 0, 0.5), [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(200)] + crowd(rng, 60, -90, 10, 1)),
    }[kind]
    got = nearest(points(spark, a, "a"), points(spark, b, "b"), left_id="aid", right_id="bid", left_at=("alat", "alon"), right_at=("blat", "blon"))
    rows = {r.aid: r for r in got.collect()}
    for i, best in enumerate(brute_nearest(a, b)):
        assert rows[i].distance_nm == pytest.approx(best, abs=1e-6)
        assert nm(a[i], b[rows[i].bid]) == pytest.approx(best, abs=1e-5)


def met(spark, a, b):
    """Rows that all steps of the search form, before any is left out."""
    at = ("alat", "alon")
    tree = proximity.target_tree(points(spark, b, "b"), "bid", ("blat", "blon")).persist()
    nothing = F.lit(None).cast("int")
    frontier = points(spark, a, "a").select(*at, F.lit(0).cast("bigint").alias("cell"), nothing.alias("id"), F.lit(0.0).alias("low"), F.lit(1e9).alias("high"))
    total = tree.count()
    for level in range(0, tree.agg(F.max("level")).first()[0] + 1, proximity.STEP):
        step = proximity._step(frontier, tree, level, at).persist()
        total += step.count()
        frontier = proximity._pruned(step, at)
    return total


def test_ten_times_the_crowd_adds_levels_and_no_pairs(spark):
    """Ten times as many on both sides: a position goes down some levels more and meets some cells more, but never the crowd."""
    rng = random.Random(9)
    few = met(spark, crowd(rng, 400, 37, 25, 0.4), crowd(rng, 400, 37, 25, 0.4)) / 400
    many = met(spark, crowd(rng, 4000, 37, 25, 0.4), crowd(rng, 4000, 37, 25, 0.4)) / 4000
    assert many < 4 * few and many < 256


def alerts(spark, *rows):
    return spark.createDataFrame([(a, T0 + timedelta(minutes=m), 37.065, 25.478) for a, m in rows], "asset string, timestamp timestamp, latitude double, longitude double")


def test_dispatch_once_per_asset_and_replay(spark):
    vessels = spark.createDataFrame([("V1", 37.94, 23.62), ("V2", 37.1, 25.37)], "vessel_id string, vessel_lat double, vessel_lon double")
    df = alerts(spark, ("T1", 0), ("T1", 5), ("T2", 3))
    orders = dispatch_orders(df, vessels, asset="asset")
    rows = {r.asset_id: r for r in orders.collect()}
    assert rows["T1"].episode_start == T0 and rows["T1"].vessel_id == "V2" and rows["T1"].distance_nm < 10
    assert len(rows) == 2 and len({r.order_id for r in rows.values()}) == 2
    again = {r.asset_id: r.order_id for r in dispatch_orders(df, vessels, asset="asset").collect()}
    assert again == {k: r.order_id for k, r in rows.items()}
    replay = dispatch_orders(df, vessels, asset="asset", open_orders=orders.selectExpr("asset_id as asset"))
    assert replay.count() == 0


def test_no_vessel_still_opens_an_order(spark):
    none = spark.createDataFrame([], "vessel_id string, vessel_lat double, vessel_lon double")
    row = dispatch_orders(alerts(spark, ("T1", 0)), none, asset="asset").first()
    assert row.vessel_id is None and row.status == "Open"


def test_maintenance_order_from_alert(spark):
    row = maintenance_orders(open_episodes(alerts(spark, ("T1", 0)), "asset"), "asset").first()
    assert (row.priority, row.status, row.technician, row.cost_eur, row.order_type) == ("Critical", "Open", "Pending Dispatch", 0.0, "Corrective")


def track(spark, *fixes):
    return spark.createDataFrame([("V", T0 + timedelta(hours=h), la, lo, 10.0) for h, la, lo in fixes], "vessel_id string, timestamp timestamp, latitude double, longitude double, speed_knots double")


def test_track_metrics(spark):
    df = track(spark, (0, 37.0, 25.0), (1, 37.0, 25.0), (2, 37.5, 25.0), (3, 38.0, 25.0))
    legs = legs_sailed(df).orderBy("to_time").collect()
    assert [round(r.moved_nm, 2) for r in legs] == [0.0, 30.02, 30.02] and legs[1].bearing_deg == pytest.approx(0.0)
    m = track_metrics(df).first()
    assert (m.moves, m.standby_h, m.under_way_h) == (3, 1.0, 2.0) and m.mean_knots == pytest.approx(30.02, abs=0.01)


def test_arrival(spark):
    df = track(spark, (0, 37.0, 25.0), (1, 37.9, 25.0), (2, 38.0, 25.0), (3, 37.0, 25.0))
    got = arrivals(df, 38.0, 25.0, 10.0).collect()
    assert [r.timestamp for r in got] == [T0 + timedelta(hours=1)]


def test_time_to_go(spark):
    route = spark.createDataFrame([("V", 0, 37.0, 25.0), ("V", 1, 38.0, 25.0), ("V", 2, 39.0, 25.0)], "vessel_id string, leg_no int, lat double, lon double")
    df = track(spark, (0, 37.5, 25.0), (1, 38.5, 25.0), (2, 39.0, 25.0))
    got = time_to_go(df, route).orderBy("timestamp").collect()
    assert [r.leg_no for r in got] == [0, 1, 1]
    assert [round(r.remaining_nm, 1) for r in got] == [90.1, 30.0, 0.0]
    assert got[0].eta_h == pytest.approx(9.006, abs=0.01)
    stopped = time_to_go(df.selectExpr("vessel_id", "timestamp", "latitude", "longitude", "0.0D as speed_knots"), route)
    assert {r.eta_h for r in stopped.collect()} == {0.0}


def test_left_on_a_long_route_is_the_sum_of_its_legs(spark):
    n = 400
    route = spark.range(n).selectExpr("'V' as vessel_id", "cast(id as int) as leg_no", "36.0 + id * 0.001D as lat", "25.0D as lon")
    legs = packed_routes(route).first().legs
    assert [leg.leg_no for leg in legs] == list(range(n - 1))
    left = 0.0
    for leg in reversed(legs):
        assert leg.after_nm == pytest.approx(left)
        left += leg.nm
    assert packed_routes(route.where("leg_no = 0")).count() == 0
