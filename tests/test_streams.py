"""Streams with state: order of arrival, going on from a batch, and state that shrinks."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wayfold.streaming import points, state

EVENT = points.EVENTS


def run(rows, folder, mode="append"):
    """All that a stream tells, and the rows of state after each micro-batch."""
    told, sizes = [], []

    query = points.start(rows, f"{folder}/checkpoint", lambda b, _: told.extend(b.collect()), mode=mode)
    query.awaitTermination()
    for p in query.recentProgress:
        sizes += [op["numRowsTotal"] for op in p["stateOperators"]]
    return told, sizes


def files(spark, rows, schema, folder, name):
    """Each list of rows as a file of its own, in this order."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")


def event(user, i, t, speed=5.0):
    return (user, 1, i, i, float(t), 50.0 + i * 1e-4, 10.0, speed, 1, "in_vehicle")


def test_disorder_within_lateness_changes_nothing(spark, tmp_path):
    """Whatever the order and the batches of a trip's events, the features are those of their order in time."""
    rng = random.Random(1)
    events = [event(u, i, 1000 + 10 * i, rng.choice([0.1, 3.0, None])) for u in (1, 2) for i in range(30)]
    end = [event(9, 0, 1e6)]
    shape = lambda told: sorted((r["user_id"], r["event_id"], r["time_delta"], r["distance"], r["acceleration"], r["is_stop"], r["stop_duration"], r["late"]) for r in told)
    results = []
    for n in (1, 4):
        if n > 1:
            rng.shuffle(events)
        stream = files(spark, [events[k::n] for k in range(n)] + [end], EVENT, f"{tmp_path}/{n}", "in").withColumn("event_time", F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")))
        told, sizes = run(state.features(stream, late="1 hour", ttl=timedelta(seconds=60)), f"{tmp_path}/{n}")
        results.append(shape([r for r in told if r["user_id"] != 9]))
        assert len(results[-1]) == 60 and not any(r[-1] for r in results[-1])
        assert sizes[-1] < max(sizes)  # trips are forgotten
    assert str(results[0]) == str(results[1])


def test_a_stream_goes_on_from_a_batch(spark, tmp_path):
    start = spark.createDataFrame([(1, 1, 1000.0, 50.0, 10.0, None, 7, True, 42.0)], "user_id bigint, trip_id bigint, t double, lat double, lon double, speed double, n bigint, stopped boolean, run double")
    rows = [[(1, 1, 8, 8, 1010.0, 50.0, 10.0, 0.0, 0, "still"), (1, 1, 7, 7, 990.0, 50.0, 10.0, 0.0, 0, "still"), (2, 1, 0, 0, 1010.0, 50.0, 10.0, 0.0, 0, "still")], [event(9, 0, 1e6)]]
    stream = files(spark, rows, EVENT, tmp_path, "in").withColumn("event_time", F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")))
    told = {(r["user_id"], r["event_id"]): r for r in run(state.features(stream, start=start, late="1 hour"), tmp_path)[0]}
    went_on, late, fresh = told[1, 8], told[1, 7], told[2, 0]
    assert (went_on["time_delta"], went_on["distance"], went_on["stop_duration"], went_on["acceleration"]) == (10.0, 0.0, 52.0, None)
    assert late["late"] and late["time_delta"] == -10.0 and fresh["time_delta"] is None and not fresh["late"]


@pytest.mark.parametrize("ttl", [5, 100])
def test_freshest_record_and_shrinking_state(spark, tmp_path, ttl):
    rng = random.Random(ttl)
    asked = [(i, rng.choice("ab"), float(rng.randint(1, 300))) for i in range(80)] + [(900, "c", 100.0)]
    known = [(rng.choice("ab"), float(rng.randint(1, 300)), float(v)) for v in range(60)]
    far = 1e6
    rng.shuffle(asked)
    r = files(spark, [asked[:30], asked[30:], [(-1, "none", far)], [(-2, "none", 2 * far)]], "id bigint, cell string, at double", tmp_path, "requests")
    k = files(spark, [known[:40], known[40:], [("none", far, 0.0)], [("none", 2 * far, 0.0)]], "cell string, at double, value double", tmp_path, "records")
    told, sizes = run(state.fresh(r, k, ttl, late="1 hour"), tmp_path)
    want = {i: max(((t, v) for c, t, v in known if c == cell and 0 <= at - t <= ttl), default=(0, None))[1] for i, cell, at in asked}
    assert {x["id"]: x["value"] for x in told if x["id"] >= 0} == want and None in want.values()
    assert sizes[-1] < max(sizes)  # what no request can want is gone
