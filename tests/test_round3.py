"""What the third round's findings were about."""

import math
import time
from datetime import timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import stats
from wayfold.llm import jaccard
from wayfold.operators import iforest, safety, simplify
from wayfold.queries import profiles, registry, streams
from wayfold.sources import tracks
from wayfold.streaming import points, state


def test_battery_halves_go_up(spark):
    """A quotient a bit below 156.25 is told like in the query's SQL, upward."""
    b = spark.createDataFrame([(1, 84, False, math.nextafter(84 / 156.25, 1.0), 20.0)], "user_id long, battery_level int, is_charging boolean, drain_rate_per_hour double, battery_temperature double")
    assert safety.batteries(b).first()["hours_left"] == 156.3


def test_any_number_of_rows_is_checked(spark):
    """More rows than one request may have: each is accepted or quarantined, and a request is still refused."""
    rows = spark.range(12_000).selectExpr("id user_id", "id trip_id", "0 point_index", "if(id % 4 = 0, 95e0, 10e0) lat", "20e0 lon", "50L activity_confidence")
    good, bad = tracks.checked(rows)
    assert (good.count(), bad.filter("errors[0] = 'invalid_coordinates'").count()) == (9_000, 3_000)
    with pytest.raises(ValueError):
        tracks.split_valid(rows)


def test_words_without_structure_in_their_hashes(spark):
    """Thue-Morse words of 1,024 letters, which collide under every polynomial of 64 bits, are different words."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, f"p q {a} r s"), (2, f"p q {b} r s"), (3, f"p q {a} r s {b} q {a} r s"), (4, f"P q {a} r s")]
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1), (2, 1, 2), (3, 6, 3), (4, 1, 1)]


def test_small_forests_grow_together():
    """Trees of many users grow at once and alone alike, and a thousand users' forests take seconds."""
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(1000 * 30, 7)), 30
    x[5], users, hashes = 9.0, np.arange(1000), np.arange(len(x))
    begun = time.process_time()
    found = iforest.mean_depths(x, users * n, users, hashes, trees=100, sample=256, seed=1)
    assert time.process_time() - begun < 40
    alone = iforest.mean_depths(x[:n], np.array([0]), users[:1], hashes[:n], trees=100, sample=256, seed=1)
    assert np.allclose(found[:n], alone) and alone.argmin() == 5
    drawn = iforest.mean_depths(x[:n], np.array([0]), users[:1], hashes[:n], trees=100, sample=16, seed=1)
    assert drawn.argmin() == 5


def test_trips_are_simplified_together():
    """Many trips at once keep what each keeps by the recursion's definition, in a fraction of a call for each."""

    def alone(p, lo, hi, keep):
        if hi - lo >= 2:
            d = simplify.distances(p[lo + 1 : hi], p[lo], p[hi])
            if d.max() > 10:
                k = lo + 1 + int(d.argmax())
                keep.add(k)
                alone(p, lo, k, keep)
                alone(p, k, hi, keep)
        return keep

    rng = np.random.default_rng(2)
    n = rng.integers(1, 30, 2000)
    starts = np.cumsum(n) - n
    p = np.column_stack((34 + rng.integers(0, 9, n.sum()) * 1e-4, -118 + rng.integers(0, 9, n.sum()) * 1e-4))
    want = set().union(*({a, a + k - 1} | alone(p, a, a + k - 1, set()) for a, k in zip(starts.tolist(), n.tolist(), strict=True)))
    assert set(np.flatnonzero(simplify.kept_all(p, starts)).tolist()) == want


def test_parts_arrive_in_files_of_bounded_size(spark, monkeypatch):
    """A part of a stream is a micro-batch of several files, so that no task writes or reads the whole; batches still hold their parts."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    rows = spark.range(1000).selectExpr("id user_id", "id trip_id", "0 point_index", "id event_id", "1.7e9 + id timestamp_unix", "1e0 lat", "1e0 lon", "1e0 speed", "1 is_moving", "'still' activity")
    found, place = streams.arriving(spark, rows, "event_id % 3 = 0", "event_id < 3", "event_id % 3 > 0", folder_too=True)
    sizes = spark.read.parquet(place).groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    seen = []
    streams.stream.start(found, streams.folder(spark, "checkpoint"), lambda b, n: seen.append(b.count())).awaitTermination()
    assert seen == [334, 3, 666]


def test_rounded_like_the_sql(spark):
    """Halves are those of the product with a power of ten, as SQL's round takes them, not those of the shortest decimal form."""
    values = [0.746445, 1.000005, 0.123455, 0.300025, 2.5e-6, -0.746445, None, 0.125]
    values += [k / 1e5 + 5e-6 for k in range(100_000)]
    found = registry.rounded(spark.createDataFrame([(x,) for x in values], "x double"), 5)
    want = duckdb.sql("select round(unnest(?), 5) x", params=[values]).fetchall()
    assert [tuple(r) for r in found.collect()] == [(None if x is None else x + 0.0,) for (x,) in want]


def test_pairs_within_a_component_need_no_verification(spark, monkeypatch):
    """A large group of near copies shares very many signatures: its members are compared some times each, and the components are those of all links."""
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)
    seen, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: seen.append(pairs.count()) or plain(pairs, sets))
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, 300, 3):
            words[k] = f"x{rng.integers(10_000)}"
        rows.append((i, " ".join(words)))
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(seen) < 8 * len(rows)


def test_components_go_on_from_earlier_ones(spark, monkeypatch):
    """Later edges join the components of earlier ones only, whatever the order: what lies within one is dropped, and edges shrink round by round."""
    left, plain = [], jaccard.materialize

    def counted(df, tag, **options):
        out = plain(df, tag, **options)
        if tag == "edges":
            left.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rng = np.random.default_rng(8)
    names = rng.permutation(600) * 7 - 2000
    edges = [(i, i + 1) for i in range(199)] + [(200, k) for k in range(201, 400)] + [(int(a), int(b)) for a, b in rng.integers(400, 600, (150, 2)) if a != b]
    edges = [(int(names[a]), int(names[b])) for a, b in edges]
    low = {x: x for e in edges for x in e}
    for _ in low:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    rng.shuffle(edges)
    table = lambda rows: spark.createDataFrame([tuple(map(int, e)) for e in rows], "a long, b long")
    found = jaccard.components(table(edges)).collect()
    assert sorted(map(tuple, found)) == sorted(low.items()) and sum(left) < 2.5 * len(edges)
    known = jaccard.components(table(edges[:300]))
    more = jaccard.components(table(edges[250:]), known).collect()
    assert sorted(map(tuple, more)) == sorted(low.items())
    assert sorted(map(tuple, jaccard.components(table(edges[:9]), known).collect())) == sorted(map(tuple, known.collect()))
    assert jaccard.components(table([])).count() == 0


def test_map_of_keys_lets_all_of_them_through(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") * 7)
    found = jaccard.listed(df, F.xxhash64("id"), spark.range(0, 20_000, 10), F.xxhash64("id")).filter("_listed")
    assert found.columns == ["id", "x", "_listed"] and found.filter("id % 10 = 0").count() == 2000 and found.count() < 2200
    assert jaccard.listed(df, F.xxhash64("id"), spark.range(0), F.xxhash64("id")).filter("_listed").count() == 0


class Kept:
    """A list state or the handle of one key that counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.reads = [], [], 0

    getListState = getValueState = lambda self, *_: Kept()
    exists = lambda self: bool(self.rows)
    listTimers = lambda self: iter(self.timers)
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)
    appendList = lambda self, rows: self.rows.extend(rows)
    clear = lambda self: self.rows.clear()
    getCurrentWatermarkInMs = lambda self: 0

    def get(self):
        self.reads += 1
        return iter(self.rows)


def test_state_of_many_rows_is_few_entries():
    """A key's ten thousand requests and records are a few entries of state, not one call each."""
    p = state.Freshest(5000, "bigint")
    p.init(Kept())
    n = np.arange(1, 10_001)
    rows = pd.DataFrame({"at": n.astype(float), "id": np.where(n % 2 == 0, n, np.nan), "value": np.where(n % 2 == 0, np.nan, n)})
    assert list(p.handleInputRows(("c",), iter([rows]), Kept())) == [] and len(p.records.rows) == len(p.waiting.rows) == 1
    assert len(state.held(p.waiting, state.ASKED)) == 5000 and p.handle.timers == [2000]


def test_waiting_events_are_not_read_again_by_each_batch():
    """Nothing can be told before the watermark: a batch only adds its events and sets the timer to the first."""
    p = state.TripFeatures(1000)
    p.init(Kept())
    for first, due in ((50.0, 50_000), (90.0, 50_000), (20.0, 20_000)):
        rows = pd.DataFrame([(0, 1, first, 1.0, 1.0, 1.0, 1, "still")], columns=state.COLUMNS)
        assert list(p.handleInputRows((1, 1), iter([rows]), Kept())) == [] and p.handle.timers == [due]
    assert len(p.waiting.rows) == 3 and p.waiting.reads == 0


@pytest.mark.parametrize(("sketch", "small"), [(10_000, 40_000), (10_000, 0), (3, 0)])
def test_percentiles_of_large_groups_are_exact(spark, monkeypatch, sketch, small):
    """Ties, null keys and values, groups of one and of none, outliers: as numpy has them, also where a sketch is too coarse; and no aggregate holds a group's values."""
    monkeypatch.setattr(stats, "SKETCH", sketch)
    monkeypatch.setattr(stats, "SMALL_GROUP", small)
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=3000), "b": rng.integers(0, 5, 2000).astype(float), None: np.append(rng.exponential(size=1500), 1e300), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    df, at = spark.createDataFrame(rows, "g string, x double").repartition(5), [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    found = {r["g"]: r[1:] for r in stats.large_percentiles(df, "x", ["g"], at).collect()}
    assert set(found) == set(values) and all(np.allclose(found[k], np.quantile(v, at), rtol=1e-12) for k, v in values.items())
    whole = stats.described(df, "x", ["g"])
    got, want = ({r["g"]: tuple(r) for r in d.collect()} for d in (whole, df.groupBy("g").agg(*stats.describe(F.col("x"))).select(whole.columns)))
    assert got.keys() == want.keys() and all(np.allclose(got[k][1:], want[k][1:], rtol=1e-9) for k in got)
    plan = stats.outlier_mad(df, "x", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_many_trips_are_followed_together():
    """Batches of many trips give what each gives alone, late events and stops that go on included, in a fraction of a call for each."""
    rng = np.random.default_rng(6)
    n, trips = 6000, 1500
    events = pd.DataFrame({"user_id": rng.integers(1, 40, n) * 2**54 + 1, "trip_id": rng.integers(0, trips // 40, n), "point_index": rng.integers(0, 9, n), "event_id": np.arange(n), "timestamp_unix": rng.integers(0, 500, n) + 0.25})
    events = events.assign(lat=50 + rng.integers(0, 3, n) * 1e-5, lon=10.0, speed=rng.choice([np.nan, -1.0, 0.2, 5.0], n), is_moving=rng.integers(0, 2, n), activity=rng.choice(["still", "walking"], n))
    state, alone, got, want = np.empty(0, dtype=points.LAST), {}, [], []
    for part in (events[:3000], events[3000:3500], events[3500:]):
        found, state = points.advance_all(part, state)
        got += found
        for key, rows in part.groupby(["user_id", "trip_id"]):
            found, alone[key] = points.advance(key, rows, alone.get(key))
            want += found
    got, want = (pd.concat(x).sort_values("event_id") for x in (got, want))
    assert len(got) == n and got["late"].sum() == want["late"].sum() > 100
    for c in want.columns:
        assert np.array_equal(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    assert {(int(r["user_id"]), int(r["trip_id"])): (r["t"], r["n"], r["stopped"], r["run"]) for r in state} == {k: (v[0], v[4], v[5], v[6]) for k, v in alone.items()}


def test_streamed_trips_share_states(spark, tmp_path):
    """A stream keeps its trips in few states, trips without a user too, and forgets each by itself."""
    event = lambda user, i, t: (user, 1, i, i, float(t), 50.0, 10.0, 0.0, 0, "still")
    for i, part in enumerate(([event(u, k, 1000 + 10 * k) for u in (1, 2, None) for k in range(3)], [event(9, 0, 5000)], [event(9, 1, 5001)], [event(1, 9, 4990), event(9, 2, 5002)], [event(1, 10, 5000)])):
        spark.createDataFrame(part, points.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema(points.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")))
    told = []
    run = points.start(points.features(rows, late="1 minute", ttl=timedelta(seconds=60), buckets=2), f"{tmp_path}/checkpoint", lambda b, _: told.extend(b.collect()))
    run.awaitTermination()
    found = {(r["user_id"], r["event_id"]): (r["time_delta"], r["stop_duration"], r["acceleration"]) for r in told}
    assert found[None, 2] == (10.0, 20.0, 0.0) and found[1, 9] == (None, None, None) and found[1, 10] == (10.0, 10.0, 0.0) and len(found) == 14
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) <= 4


@pytest.mark.parametrize("name", ["dly_01_05", "dly_01_learned"])
def test_points_are_summed_up_by_trip_once(spark, monkeypatch, name):
    """Requests, zones and routes all come from one table of trips."""
    calls, plain = [], profiles.profile.trip_signatures
    monkeypatch.setattr(profiles.profile, "trip_signatures", lambda p: calls.append(1) or plain(p))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
