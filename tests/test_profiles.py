"""Zones, learned routes and updates of profiles against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import places, predict, profile, zones
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import profiles as queries

D = "/root/testdata/sf0.001"
ZONES = "user_id long, route_id string, start_lat double, start_lon double, start_radius double, end_lat double, end_lon double, end_radius double"
TRIPS = "trip_id long, user_id long, start_lat double, start_lon double, end_lat double, end_lon double"


def metres(a, b, c, d):
    a, c, gap = math.radians(a), math.radians(c), math.radians(d - b)
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin(gap / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("where", [(0.0, 0.0), (48.0, 11.0), (-33.0, 179.999), (-70.0, -180.0), (89.95, 20.0), (-90.0, 0.0)])
def test_zones_equal_brute_force(spark, where):
    """Circles of a metre to half the globe, also across the antimeridian and around the poles."""
    rng = random.Random(str(where))
    spread = lambda r: (max(-90.0, min(90.0, where[0] + rng.gauss(0, r))), (where[1] + rng.gauss(0, 3 * r) + 180) % 360 - 180)
    circle = lambda r: (*spread(r), rng.choice([1.0, 63.9, 64.0, 64.1, 200.0, 1500.0, 40_000.0, 9e6]))
    rows = [(u, f"r{u}-{i}", *circle(0.01), *circle(0.1)) for u in (1, 2) for i in range(25)] + [(1, "none", None, 1.0, 5.0, 1.0, 1.0, 5.0), (None, "r", *circle(1), *circle(1))]
    trips = [(i, i % 3, *spread(0.02), *spread(0.1)) for i in range(200)] + [(900, 1, None, 0.0, 0.0, 0.0), (901, None, 0.0, 0.0, 0.0, 0.0)]
    got = zones.met(spark.createDataFrame(trips, TRIPS), spark.createDataFrame(rows, ZONES))
    got = Counter((r["trip"]["trip_id"], r["zone"]["route_id"]) for r in got.collect())
    want = {(t[0], z[1]) for t in trips for z in rows if t[1] == z[0] and None not in (*t, *z) and metres(t[2], t[3], z[2], z[3]) <= z[4] and metres(t[4], t[5], z[5], z[6]) <= z[7]}
    assert got == Counter(want) and want


def test_cells_are_few(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-75, 75), rng.uniform(-180, 180), 10 ** rng.uniform(0, 4.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "lat double, lon double, r double")
    n = df.select(F.size(zones.cells_around(F.col("lat"), F.col("lon"), F.col("r"), zones.level(F.col("r")))).alias("n"))
    assert 1 <= n.agg(F.min("n")).first()[0] and n.agg(F.max("n")).first()[0] <= 16


def test_learned_routes_and_stops_are_average_linkage(spark):
    """The registered queries' clusters, from each user's points in one matrix."""
    points = scored_tracks(spark, D)
    for rows, columns, cut, least, got in (
        (profile.trip_signatures(points), ["start_lat", "start_lon", "end_lat", "end_lon"], 200.0, 2, queries.pro_02_03(spark, D)),
        (profile.stop_episodes(points), ["lat", "lon"], 100.0, 3, queries.pro_06(spark, D)),
    ):
        by_user, want = {}, Counter()
        for r in rows.collect():
            by_user.setdefault(r["user_id"], []).append([r[c] for c in columns])
        for user, x in by_user.items():
            x = np.array(x)
            label = places.by_matrix(x, cut / places.DEGREE, np.ones(len(x)))
            want.update((user, n, *(round(v, 5) for v in x[label == c].mean(axis=0))) for c, n in Counter(label.tolist()).items() if n >= least)
        assert Counter((r["user_id"], r["frequency"], *(round(r[c], 5) for c in columns)) for r in got.collect()) == want


def trip(i, lat, lon, hour=8, duration=600.0):
    return (1, i, lat, lon, lat + 0.1, lon + 0.1, duration, 9000.0, 10.0, hour)


SIGNATURES = "user_id long, trip_id long, start_lat double, start_lon double, end_lat double, end_lon double, duration double, distance double, mean_speed double, start_hour int"


def test_update_adds_to_known_routes(spark):
    signatures = lambda rows: spark.createDataFrame(rows, SIGNATURES)
    old = profile.routes(signatures([trip(i, 50.0 + i * 1e-4, 10.0) for i in range(4)] + [trip(9, 20.0, 5.0)]))
    new = [trip(20 + i, 50.0 + i * 1e-4, 10.0, 17, 900.0) for i in range(3)] + [trip(30 + i, 60.0, 11.0) for i in range(2)] + [trip(40, 20.0, 5.0)]
    got = {r["route_id"]: r for r in profile.update_routes(old, signatures(new)).collect()}
    known = old.first()
    r = got.pop(known["route_id"])
    assert (r["frequency"], r["first_hour"], r["last_hour"], r["duration"]) == (7, 8, 17, pytest.approx((4 * 600 + 3 * 900) / 7))
    assert all(r[c] == known[c] for c in ("start_lat", "start_lon", "end_lat", "end_lon", "start_radius", "end_radius"))
    assert [(x["frequency"], round(x["start_lat"])) for x in got.values()] == [(2, 60)]  # a trip alone is no route, now as before
    assert sorted(map(tuple, profile.update_routes(old, signatures([])).collect())) == sorted(map(tuple, old.collect()))


def test_update_agrees_with_learning_anew(spark):
    """Where known zones hold all trips of their places, frequencies and means of an update are those of all trips at once."""
    rng = random.Random(4)
    spots = [(40.0 + i, 8.0 + i) for i in range(6)]
    rows = [trip(100 * n + i, lat + rng.uniform(-3e-4, 3e-4), lon + rng.uniform(-3e-4, 3e-4), rng.randint(0, 23), rng.uniform(300, 900)) for n, (lat, lon) in enumerate(spots) for i in range(20)]
    half = spark.createDataFrame([r for r in rows if r[1] % 2 == 0 and r[1] < 500], SIGNATURES)
    rest = spark.createDataFrame([r for r in rows if not (r[1] % 2 == 0 and r[1] < 500)], SIGNATURES)
    shape = lambda df: sorted((round(r["start_lat"]), r["frequency"], r["first_hour"], r["last_hour"], round(r["duration"], 6), round(r["mean_speed"], 6)) for r in df.collect())
    assert shape(profile.update_routes(profile.routes(half), rest)) == shape(profile.routes(spark.createDataFrame(rows, SIGNATURES)))


def test_best_of_several_routes(spark):
    """Of overlapping zones the one with more trips and nearer centres, by brute force."""
    rng = random.Random(7)
    route = lambda u, i: (u, f"r{i}", rng.uniform(0, 0.01), rng.uniform(0, 0.01), rng.uniform(0, 0.01), rng.uniform(0, 0.01), 900.0, 700.0, rng.randint(2, 15), 60.0 * i, 1000.0)
    rows = [route(u, i) for u in (1, 2) for i in range(12)]
    asked = [(i, i % 3, *(rng.uniform(0, 0.01) for _ in range(4))) for i in range(150)]
    r = spark.createDataFrame(rows, "user_id long, route_id string, start_lat double, start_lon double, end_lat double, end_lon double, start_radius double, end_radius double, frequency long, duration double, distance double")
    q = spark.createDataFrame(asked, "request_id long, user_id long, o_lat double, o_lon double, d_lat double, d_lon double")
    for got in predict.match_routes(q, r).collect():
        found = []
        for u, name, a, b, c, d, s, e, n, duration, _ in rows:
            x, y = metres(got["o_lat"], got["o_lon"], a, b), metres(got["d_lat"], got["d_lon"], c, d)
            if u == got["user_id"] and x <= s and y <= e:
                found.append((0.6 * min(1, n / 10) + 0.4 * (1 - (x + y) / (s + e + 1)), name, duration))
        best = max(found, default=(0.0, None, None))
        assert (got["route_id"], got["route_duration"]) == best[1:] and got["route_confidence"] == pytest.approx(best[0])


def test_learned_routes_reach_adherence_and_delays(spark):
    """Queries over learned routes, by brute force over the routes."""
    points = scored_tracks(spark, D)
    sig = profile.trip_signatures(points)
    known, trips = profile.routes(sig).collect(), sig.collect()
    on = lambda t, r: r["user_id"] == t["user_id"] and metres(t["start_lat"], t["start_lon"], r["start_lat"], r["start_lon"]) <= r["start_radius"] and metres(t["end_lat"], t["end_lon"], r["end_lat"], r["end_lon"]) <= r["end_radius"]
    hits = {t["trip_id"]: [r for r in known if on(t, r)] for t in trips}
    n = Counter(r["user_id"] for r in points.select("user_id", "trip_id").distinct().collect())
    got = {r["user_id"]: r["route_adherence"] for r in queries.pro_09_learned(spark, D).collect()}
    assert got == {u: round(sum(bool(hits[t["trip_id"]]) for t in trips if t["user_id"] == u) / n[u], 6) for u in n}
    late = queries.dly_01_learned(spark, D).collect()
    assert len(late) == len(trips) and {r["request_id"] for r in late if r["route_id"]} == {t for t, own in hits.items() if own}
    assert all(r["route_id"] in {x["route_id"] for x in hits[r["request_id"]]} for r in late if r["route_id"])


def test_profiles_brought_up_to_date(spark):
    from wayfold.operators import baseline

    p = scored_tracks(spark, D).cache()
    first, since = p.filter("trip_id % 2 = 0 and user_id % 4 <> 1"), p.filter("trip_id % 2 = 1 and user_id % 4 <> 2")
    old = profile.learn(first, baseline.wide(first))
    before = {r["user_id"]: r for r in old.collect()}
    got = {r["user_id"]: r for r in profile.update(old, since, baseline.wide(p)).collect()}
    assert set(got) == {r["user_id"] for r in p.select("user_id").distinct().collect()}
    for u, r in got.items():
        if u % 4 == 2:
            assert r == before[u]  # nothing new
        else:
            assert r["trips"] == p.filter(F.col("user_id") == u).select("trip_id").distinct().count()
            assert {x["route_id"] for x in (before[u]["routes"] or [])} <= {x["route_id"] for x in (r["routes"] or [])} if u in before else True
            assert sum(h["n"] for h in r["hours"]) == since.filter((F.col("user_id") == u) & (F.col("confidence") >= 0.5)).count()
    p.unpersist()


def test_outlook_by_drift(spark):
    rows = {r["user_id"]: r for r in queries.p3_01_learned(spark, D).collect()}
    assert rows and all(0 <= r["threat"] <= 1 for r in rows.values())
