"""Boundaries of the rules, odd inputs, and relations between batch and stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, groups, stats, time
from wayfold.operators import confidence, iforest, learning, ops, places, profile, risk, safety, simplify, spoofing, viz
from wayfold.plans import tracking
from wayfold.sources import tables, tracks
from wayfold.streaming import points as stream


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("double").alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first()["x"]


def test_haversine_and_bearing(spark):
    lit = [F.lit(float(x)) for x in (0, 0, 0, 1)]
    assert one(spark, geo.haversine(*lit)) == pytest.approx(111195.08, abs=0.1)
    assert one(spark, geo.bearing(*lit)) == pytest.approx(90)
    assert one(spark, geo.bearing(*[F.lit(1.0)] * 4)) == 0
    for a, b, turn in ((10.0, 350.0, -20), (350.0, 10.0, 20), (0.0, 180.0, 180), (180.0, 0.0, -180)):
        assert one(spark, geo.bearing_change(F.lit(a), F.lit(b))) == turn
    assert one(spark, geo.speed(F.lit(5.0), F.lit(0.0))) is None


@pytest.mark.parametrize(("acc", "score"), [(None, 0.3), (5.0, 1), (5.01, 0.9), (10.0, 0.9), (25.0, 0.7), (50.0, 0.5), (100.0, 0.3), (100.01, 0.1)])
def test_gps_score(spark, acc, score):
    assert one(spark, confidence.gps_score(F.col("a")), a=acc) == score


@pytest.mark.parametrize(("dt", "score"), [(None, 0.8), (0.4, 0.6), (0.5, 1), (5.0, 1), (5.1, 0.9), (15.1, 0.8), (30.0, 0.8), (30.1, 0.6), (60.1, 0.4), (300.0, 0.4), (300.1, 0.2)])
def test_temporal_score(spark, dt, score):
    assert one(spark, confidence.temporal_score(F.col("a")), a=dt) == score


@pytest.mark.parametrize(("r", "level"), [(0.05, "minimal"), (0.1, "low"), (0.25, "moderate"), (0.45, "elevated"), (0.65, "high"), (0.85, "critical")])
def test_risk_level(spark, r, level):
    assert one(spark, risk.level(F.lit(r))) == level


def test_health_status(spark):
    assert [one(spark, viz.health_status(F.lit(x))) for x in (0.1, 0.25, 0.4, 0.6, 0.9)] == ["excellent", "good", "fair", "poor", "critical"]


def test_parse_timestamp(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05.250000", "2024-01-02T03:04:05Z", "2024/01/02 03:04:05", "no time", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(time.unix(time.parse_timestamp(F.col("t"))).alias("u")).collect()
    assert [r["u"] for r in rows] == [1704164645.0, 1704164645.0, 1704164645.25, 1704164645.0, 1704164645.0, None, None]
    assert [one(spark, time.format_duration(F.lit(x))) for x in (0.0, 61.0, 3600.0, -7325.9)] == ["0s", "1m 1s", "1h 0m 0s", "-2h 2m 5s"]


def test_rolling_and_ema(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(6)], "g int, i int, x double")
    got = [r["m"] for r in df.select("i", stats.rolling_mean(F.col("x"), 3, ["g"], ["i"]).alias("m")).orderBy("i").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([5 / 3, 14 / 3, 29 / 3, 50 / 3])
    e = df.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("v")).select(stats.ema(F.col("v")).alias("e")).first()["e"]
    want = [0.0]
    for x in [1.0, 4.0, 9.0, 16.0, 25.0]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert e == pytest.approx(want)


def test_p_values():
    assert stats.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    rng = np.random.default_rng(0)
    assert stats.shapiro_p(rng.normal(size=200)) > 0.01 and stats.shapiro_p(rng.exponential(size=200)) < 1e-6
    assert stats.shapiro_p(np.arange(1.0, 11.0)) == pytest.approx(0.8924, abs=2e-3)
    assert all(stats.shapiro_p(np.array([*[0.0] * (n - 1), 1.0])) < 1e-3 for n in range(8, 12))


def test_long_averages(spark):
    rng = np.random.default_rng(1)
    for alpha, n in ((0.3, 700), (0.05, 2000), (1.0, 5), (0.3, 1), (0.3, 0)):
        v = rng.normal(size=n).tolist()
        want = v[:1]
        for x in v[1:]:
            want.append(alpha * x + (1 - alpha) * want[-1])
        df = spark.createDataFrame([(v,)], "v array<double>")
        assert df.select(stats.ema(F.col("v"), alpha).alias("e")).first()["e"] == pytest.approx(want, abs=1e-12)


def test_normality_of_small_and_large_groups(spark):
    x = F.when(F.col("g") == 3, F.exp(F.randn(2))).otherwise(F.randn(2))
    t = spark.createDataFrame([(1, 200), (2, 6000), (3, 6000), (4, 5), (5, 5000)], "g long, size int").select("g", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i")).withColumn("x", x)
    found = {r["g"]: r for r in stats.normality(t, "x", "g").collect()}
    assert {g: r["n"] for g, r in found.items()} == {1: 200, 2: 6000, 3: 6000, 5: 5000}
    assert all(found[g]["p"] > 1e-4 for g in (1, 2, 5)) and found[3]["p"] < 1e-6


def test_normality_query_reads_all_rows(spark):
    from wayfold.queries import library

    d = "/root/testdata/sf0.001"
    assert library.sta_09_normality(spark, d).agg(F.sum("n")).first()[0] == library.line(spark, d).filter("x is not null").count()


def test_average_linkage():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [50, 50]])
    labels = places.average_linkage(x, 2.0)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    assert len(set(places.average_linkage(x, 1000.0))) == 1
    assert len(set(places.average_linkage(np.array([[0.0, 0], [0, 1]]), 1.0))) == 1


@pytest.mark.parametrize("seed", range(12))
def test_chains_find_the_same_clusters(seed, monkeypatch):
    monkeypatch.setattr(places, "BLOCK", (1, 50, 1 << 20)[seed % 3])
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(3, 160)), (2, 4)[seed % 2]
    x = rng.normal(size=(n, width)) * (1, 3, 10)[seed % 3] + rng.integers(0, 3, size=(n, 1)) * 5
    weight = rng.integers(1, 6, size=n).astype(float)
    for cut in (0.3, 1.0, 2.5, 100.0):
        a, b = places.by_matrix(x, cut, weight), places.by_chain(x, cut, weight)
        assert (a == b).all()


def test_components_of_cells():
    rng = np.random.default_rng(3)
    for width, side in ((1, 40), (2, 8), (4, 3)):
        group = np.sort(rng.integers(0, 4, size=60))
        cells, at = np.unique(np.column_stack((group, rng.integers(-side, side, size=(60, width)))), axis=0, return_index=True)
        group, cells = cells[:, 0], cells[:, 1:]
        want = {(i, j) for i in range(len(cells)) for j in range(i) if group[i] == group[j] and (abs(cells[i] - cells[j]) <= 1).all()}
        links = places.touching(cells, group)
        assert {(max(p), min(p)) for p in links.tolist()} == want and len(links) == len(want)
        label, step = np.arange(len(cells)), True
        while step:  # by hand, link by link
            step = False
            for i, j in want:
                if label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    step = True
        assert (places.linked(len(cells), links) == label).all()


def test_groups_across_batches(spark):
    """Groups, also of nulls, reach the function whole wherever batches end."""
    rows = [(None if u == 3 else u, v, i) for i, (u, v) in enumerate((u, v) for u in range(7) for v in ("a", "b", None) for _ in range(u * u + 1))]
    df = spark.createDataFrame(rows, "u long, v string, i int").repartition(3)

    def run(found, starts):
        ends = [*starts[1:], len(found)]
        return pd.DataFrame({"u": found["u"].iloc[starts].to_numpy(), "v": found["v"].iloc[starts].to_numpy(), "n": [int(b - a) for a, b in zip(starts, ends, strict=True)]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("1", "7", "10000"):
        spark.conf.set(key, size)
        got = [tuple(r) for r in groups.map_groups(df, ["u", "v"], run, "u long, v string, n int").collect()]
        assert sorted(got, key=str) == sorted(((None if u == 3 else u, v, u * u + 1) for u in range(7) for v in ("a", "b", None)), key=str)
    spark.conf.unset(key)


def test_clusters_have_no_borders(spark):
    rng, cut = np.random.default_rng(5), 100 / places.DEGREE
    spots = [(u, lat, lon) for u in (1, 2) for lat in (0.5, 50.0, -0.5 * u, places.REGION * cut * 1.001 * u) for lon in (0.0, 10.5)]
    rows = [(u, float(lat + a), float(lon + b)) for u, lat, lon in spots for a, b in rng.normal(0, cut, size=(12, 2))]
    rows += rows[::3]  # equal points
    got = places.clustered(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, user_id long, lat double, lon double"), ["lat", "lon"], 100.0).collect()
    assert len(got) == len(rows)
    found, want = {}, {}
    for r in got:
        found.setdefault((r["user_id"], r["place"], r["cluster"]), set()).add(r["i"])
    for u in (1, 2):
        mine = [i for i, r in enumerate(rows) if r[0] == u]
        for i, c in zip(mine, places.average_linkage(np.array([rows[i][1:] for i in mine]), cut), strict=True):
            want.setdefault((u, c), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_routes_and_stops_on_a_border(spark):
    trips = [(1, t, lat, 10.0, 50.2, 10.2, 60.0, 900.0, 5.0, 8) for t, lat in enumerate((49.9999, 50.0001))]
    s = spark.createDataFrame(trips, "user_id long, trip_id long, start_lat double, start_lon double, end_lat double, end_lon double, duration double, distance double, mean_speed double, start_hour int")
    assert [r["frequency"] for r in profile.routes(s).collect()] == [2]
    e = spark.createDataFrame([(1, float(i), lat, 10.0, 60.0, 8, 8) for i, lat in enumerate((49.9999, 50.0001, 50.0001))], "user_id long, arrival double, lat double, lon double, duration double, arrival_hour int, departure_hour int")
    assert [r["frequency"] for r in profile.stops(e).collect()] == [3]


def test_simplify():
    line = np.column_stack((np.linspace(0, 0.01, 50), np.zeros(50)))
    assert simplify.kept(line).sum() == 2
    line[25, 1] = 0.01
    assert simplify.kept(line)[25] and simplify.kept(line[:2]).all()


def test_isolation_forest_ranks_an_outlier():
    rng = np.random.default_rng(1)
    x = np.vstack((rng.normal(size=(200, 3)), [[9, 9, 9]]))
    forest = [iforest.grow(x, np.random.default_rng(i), 8) for i in range(40)]
    assert np.mean([iforest.depths(t, x) for t in forest], axis=0).argmin() == 200


@pytest.mark.parametrize("trees", [20, 4])  # trees draw by themselves, or by hash before
def test_isolation_forest_covers_all_points(spark, trees):
    speed = F.when(F.col("event_id") % 97 == 0, 500.0).otherwise(F.abs(F.randn(7)) * 3)
    p = spark.range(3000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id")).withColumn("speed", speed)
    p = p.withColumns({c: F.randn(i) for i, c in enumerate(("calc_speed", "acceleration", "time_delta", "distance", "coords_accuracy", "confidence"))}).cache()
    x = np.array([r["x"] for r in iforest.scaled(p, 10).collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)
    found = [r["iso_score"] for r in iforest.score(p, trees=trees).collect()]
    assert len(found) == 3000 and sum(s > 0.5 for s in found) == pytest.approx(150, abs=5)


def test_crash_fall_battery(spark):
    def batch(i, gs, speed, age):
        return [(i, s, 0.0, 0.0, g * 9.81, s * 0.1, speed, age) for s, g in enumerate(gs)]

    rows = batch(1, [1, 1, 9, 1, 1, 1], 60.0, 30) + batch(2, [1, 5, 1, 1, 1], 5.0, 30) + batch(3, [1, 0.2, 0.2, 6, 1, 1, 1], None, 70) + batch(4, [1] * 5, 0.0, 30)
    r = spark.createDataFrame(rows, "detection_id int, seq int, x double, y double, z double, at double, speed_kmh double, user_age int")
    crash = {x["detection_id"]: x for x in safety.crashes(r).collect()}
    assert crash[1]["is_crash"] and crash[1]["severity"] == "moderate" and crash[1]["alert"] and not crash[2]["is_crash"] and crash[4]["severity"] == "none"
    fall = {x["detection_id"]: x for x in safety.falls(r).collect()}
    assert fall[3]["is_fall"] and fall[3]["severity"] == "severe" and fall[3]["stationary_after"] and not fall[1]["is_fall"]
    b = spark.createDataFrame([(5, True, 1.0, 50.0), (5, False, 2.0, 20.0), (21, False, 0.0, None)], "battery_level int, is_charging boolean, drain_rate_per_hour double, battery_temperature double")
    assert [(x["status"], x["hours_left"], x["hot"]) for x in safety.batteries(b).collect()] == [("charging", None, True), ("critical", 2.5, False), ("healthy", None, False)]


def test_confidence_falls_with_flags_and_rows_may_come_in_any_order(spark):
    t = tracks.tracks(spark, "/root/testdata/sf0.001")
    a = {r["event_id"]: r["confidence"] for r in tracking.scored(t).collect()}
    b = {r["event_id"]: r["confidence"] for r in tracking.scored(t.orderBy(F.rand(3)).repartition(7)).collect()}
    assert a == b and all(0 <= c <= 1 for c in a.values())
    bare = {r["event_id"]: r["confidence"] for r in confidence.score(tracking.scored(t).drop("confidence").withColumn("quality_flags", F.array().cast("array<string>"))).collect()}
    assert all(bare[k] >= c - 1e-9 for k, c in a.items())


def test_tables(spark, tmp_path):
    table = tables.Table(spark, f"file://{tmp_path}/t", "k int, v string", ["k"])
    assert table.count() == 0
    table.create(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    table.delete(spark.createDataFrame([(1,)], "k int"))
    assert [r["k"] for r in table.page(1, 1).collect()] == [3] and table.get(k=2).first()["v"] == "c"
    table.clear()
    assert table.count() == 0


def test_fresh_records(spark):
    q = spark.createDataFrame([("a", 1000.0), ("a", 5000.0), ("b", 10.0)], "cell string, at double")
    r = spark.createDataFrame([("a", 200.0, 1.0), ("a", 900.0, 2.0)], "cell string, at double, impact double")
    assert sorted((x["cell"], x["at"], x["impact"]) for x in tables.fresh(q, r, 900, value=["impact"]).collect() if x["impact"]) == [("a", 1000.0, 2.0)]


def test_fresh_records_against_brute_force(spark):
    rng = np.random.default_rng(3)
    asked = [(i, rng.choice(["a", "b", None], p=[0.7, 0.2, 0.1]), None if i % 17 == 0 else float(rng.integers(-40, 400))) for i in range(300)]
    asked += asked[:5]
    kept = [(rng.choice(["a", "b", "c", None]), None if i % 13 == 0 else float(rng.integers(-40, 400)), None if i % 7 == 0 else int(rng.integers(9))) for i in range(60)]
    q = spark.createDataFrame([(i, None if c is None else str(c), t) for i, c, t in asked], "id long, cell string, at double").withColumn("record", F.lit("mine"))
    r = spark.createDataFrame([(None if c is None else str(c), t, v) for c, t, v in kept], "cell string, at double, impact long")

    def best(cell, at):
        found = [(t, -1 if v is None else v) for c, t, v in kept if cell is not None and c == cell and None not in (t, at) and 0 <= at - t <= 25]
        return None if not found or max(found)[1] < 0 else max(found)[1]

    out = tables.fresh(q, r, 25, value=["impact"])
    assert out.columns == ["id", "cell", "at", "record", "impact"]
    assert sorted((x["id"], str(x["impact"])) for x in out.collect()) == sorted((i, str(best(c, t))) for i, c, t in asked)
    assert tables.fresh(q, r.limit(0), 25, value=["impact"]).filter("impact is null").count() == len(asked)


def test_summary_of_users_equals_the_long_forms(spark):
    from wayfold.operators import anomaly, baseline, profile, summary
    from wayfold.plans.tracking import scored_tracks

    low = F.when(F.col("user_id") == 3, 0.1).when(F.col("event_id") % 5 == 0, 0.4).otherwise(F.col("confidence"))  # one user without any point of enough confidence
    p = scored_tracks(spark, "/root/testdata/sf0.001").withColumn("confidence", low).cache()
    t = summary.with_trips(p)
    users = summary.users(t, mature_trips=2, mature_points=9).cache()
    flat = lambda df: {r["user_id"]: tuple(None if v is None else round(v, 9) for m in (*baseline.METRICS,) for v in r[m]) + tuple(r[c] for c in ("trips", "points", "is_mature")) for r in df.collect()}
    known, want = flat(users.filter("points > 0")), flat(baseline.wide(p, mature_trips=2, mature_points=9))
    assert 3 not in known and known == want and users.filter("user_id = 3").first()["speed"] is None
    shares = {(r["user_id"], r["activity"]): r["share"] for r in users.select("user_id", F.inline("shares")).collect()}
    assert shares == pytest.approx({(r["user_id"], r["activity"]): r["share"] for r in baseline.activities(p).collect()})
    hours = {(r["user_id"], r["pos"]): r["col"] for r in users.select("user_id", F.posexplode("hours")).collect()}
    assert hours == pytest.approx({(r["user_id"], r["hour"]): r["probability"] for r in profile.hour_probabilities(p).collect()})
    fits = [sorted(map(str, f.collect())) for f in (anomaly.fit_hbos_arrays(p), anomaly.fit_hbos_arrays(t, users.select("user_id", "ends.*")))]
    assert fits[0] == fits[1] and fits[0]
    p.unpersist()


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("user_id,trip_index_for_user,trip_global_index,point_index\n1,0,10,0\n1,0,10,x\n")
    raw = tracks.read_csv(spark, str(tmp_path / "x.csv")).cache()
    assert raw.count() == 2 and raw.filter("_corrupt_record is not null").count() >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tracks.read_csv(spark, str(tmp_path / "none.csv"))


def test_stream_features_equal_batch(spark, tmp_path):
    t = tracks.normalize(tracks.tracks(spark, "/root/testdata/sf0.001")).filter("user_id < 4")
    cols = [c.split()[0] for c in stream.EVENTS.split(", ")]
    early, late = t.filter("point_index < 5").select(cols), t.filter("point_index >= 5").select(cols)
    for i, part in enumerate((early, late)):
        part.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in stream.EVENTS.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows: list[pd.DataFrame] = []
    source = stream.read(spark, f"{tmp_path}/in/*", files_per_trigger=1)
    q = stream.features(source).writeStream.foreachBatch(lambda df, _: rows.append(df.toPandas())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = pd.concat(rows).set_index("event_id")
    from wayfold.operators.features import features

    want = features(t).toPandas().set_index("event_id")
    assert sorted(got.index) == sorted(want.index)
    got = got.loc[want.index]
    if not got["late"].any():
        for c in ("time_delta", "distance", "calc_speed", "acceleration", "stop_duration"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-6, equal_nan=True), c
    assert len(got)


def test_tables_append_and_refuse_a_second_writer(spark, tmp_path):
    table = tables.Table(spark, f"file://{tmp_path}/t", "k int, v string", ["k"])
    one, two = (spark.createDataFrame([(i, "a")], "k int, v string") for i in (1, 2))
    assert table.create(one, mark="7") == 1 and table.create(two) == 1
    version = table._current()
    assert len(version["folders"]) == 2 and table.mark() == "7"
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(version | {"number": version["number"] - 1}, [], None)
    assert table.count() == 2


class State:
    """What a stream gives to the function of a group."""

    def __init__(self, row=None, timed_out=False):
        self.row, self.hasTimedOut, self.removed, self.until = row, timed_out, False, None

    exists = property(lambda self: self.row is not None)
    get = property(lambda self: self.row)

    def update(self, row):
        self.row = row

    def remove(self):
        self.removed = True

    def setTimeoutTimestamp(self, ms):
        self.until = ms

    def getCurrentWatermarkMs(self):
        return 0


def test_stream_state_expires_and_late_events_are_marked():
    columns = [c.split()[0] for c in stream.EVENTS.split(", ")]
    rows = pd.DataFrame([(1, 2, 0, 10, 100.0, 0.0, 0.0, None, 1, "walking"), (1, 2, 1, 11, 104.0, 0.0, 0.001, -1.0, 0, "still"), (1, 2, 2, 12, 110.0, 0.0, 0.001, 0.2, 0, "still")], columns=columns)
    state = State()
    first = pd.concat(stream.follow((1, 2), iter([rows]), state, ttl_ms=5000))
    assert list(first["time_delta"])[1:] == [4.0, 6.0] and list(first["stop_duration"])[1:] == [0.0, 6.0] and state.until == 115_000 and state.row[4] == 3
    more = pd.DataFrame([(1, 2, 3, 13, 105.0, 0.0, 0.0, 1.0, 1, "walking"), (1, 2, 4, 14, 112.0, 0.0, 0.001, 0.2, 0, "still")], columns=columns)
    second = pd.concat(stream.follow((1, 2), iter([more]), state, ttl_ms=5000)).set_index("event_id")
    assert second.loc[13, "late"] and second.loc[13, "time_delta"] == -5.0 and second.loc[14, "stop_duration"] == 8.0 and second.loc[14, "acceleration"] == 0.0
    gone = State(state.row, timed_out=True)
    assert list(stream.follow((1, 2), iter([]), gone, ttl_ms=5000)) == [] and gone.removed


def test_threat_classifier_learns_a_planted_relation(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x), int(x[0] + 0.1 * rng.normal() > 0.5)) for i, x in enumerate(rng.random((400, 5)))]
    found = learning.evaluate_threat(spark.createDataFrame(rows, "user_id bigint, avg_risk double, max_risk double, min_risk double, std_risk double, high_share double, label int")).first()
    assert found["n"] > 40 and found["log_loss"] < 0.6 * found["log_loss_of_share"]


def test_signals_of_sessions_in_one_pass_equal_the_long_form(spark):
    p = tracking.scored(tracks.tracks(spark, "/root/testdata/sf0.001")).filter("user_id < 8")
    one = {(r["user_id"], r["trip_id"]): (round(r["spoofing"], 9), round(r["tampering"], 9), round(r["integrity"], 9), r["n_signals"]) for r in spoofing.sessions(p).collect() if r["n_signals"]}
    long = {(r["user_id"], r["trip_id"]): (round(r["spoofing"], 9), round(r["tampering"], 9), round(r["integrity"], 9), r["n_signals"]) for r in spoofing.session_scores(spoofing.session_signals(p)).collect()}
    assert one == long and len(one) > 10


def test_retraining_is_due_by_schedule(spark):
    rows = [("a", "daily", 0.0), ("b", "weekly", 0.0), ("c", "never", 0.0)]
    assert {r["model"]: r["due"] for r in ops.retraining_due(spark.createDataFrame(rows, "model string, schedule string, trained_at double"), 90_000.0).collect()} == {"a": True, "b": False, "c": False}
