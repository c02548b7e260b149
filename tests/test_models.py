"""Fitted models: kept versions, batches outside Spark ML, observed delays, plugged-in detectors, counted writes."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import anomaly, learning, models, ops
from wayfold.queries import profiles as queries

D = "/root/testdata/sf0.001"
THREAT = "user_id bigint, avg_risk double, max_risk double, min_risk double, std_risk double, high_share double, label int"


@pytest.fixture(scope="module")
def threats(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        r = rng.random()
        rows.append((i, r, min(1.0, r + 0.2), r / 2, rng.random() / 5, r * r, int(r + rng.gauss(0, 0.2) > 0.5)))
    return spark.createDataFrame(rows, THREAT)


def test_versions_are_kept_by_number(spark, threats, tmp_path):
    fitted, place = learning.fit_threat(threats), f"file://{tmp_path}/models"
    assert models.versions(spark, place, "t") == []
    with pytest.raises(LookupError):
        models.load(spark, place, "t")
    assert [models.save(fitted, spark, place, "t", kept=3) for _ in range(11)] == list(range(1, 12))
    assert models.versions(spark, place, "t") == [9, 10, 11]  # by number, not by name
    (tmp_path / "models/t/10/_complete").unlink()  # as if the writer had been lost
    assert models.versions(spark, place, "t") == [9, 11]
    with pytest.raises(LookupError):
        models.load(spark, place, "t", version=10)
    with pytest.raises(ValueError, match="reads"):
        models.load(spark, place, "t", columns=["avg_risk"])
    loaded = models.load(spark, place, "t", columns=learning.THREAT_FEATURES)
    p = lambda m: [r["p"] for r in learning.predict_threat(m, threats).orderBy("user_id").collect()]
    assert p(loaded) == p(fitted)


def test_batches_equal_the_fitted_model(threats):
    fitted = learning.fit_threat(threats)
    want = {r["user_id"]: r["p"] for r in learning.predict_threat(fitted, threats).collect()}
    odd = threats.unionByName(threats.limit(1).withColumns({"user_id": F.lit(-1).cast("bigint"), "avg_risk": F.lit(None).cast("double")}))
    got = {r["user_id"]: r["p"] for r in learning.batched_threat(fitted, odd).collect()}
    assert set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    assert learning.batched_threat(fitted, threats.limit(0)).count() == 0


def test_observed_delays_are_learned(spark):
    """Held-out errors, after five-fold cross validation, are below those of the heuristic and of the mean where delays follow from the hour and the weather."""
    rng = random.Random(5)
    requests, trips = [], []
    for i in range(600):
        hour, weather = rng.randint(0, 23), rng.random()
        late = (25 if hour in (7, 8, 17) else 4) + 10 * weather + rng.gauss(0, 1)
        requests.append((i, 1000.0, 600.0, weather, 1.0, hour, 2, hour in (7, 8, 17), 0.5, 0.5, 3 * weather))
        trips.append((i, 600.0 + 60 * late))
    schema = "request_id bigint, distance_m double, hist_duration double, weather_impact double, traffic_factor double, hour int, weekday int, is_rush boolean, route_confidence double, context_confidence double, delay_minutes double"
    rows = learning.observed_delays(spark.createDataFrame(requests, schema), spark.createDataFrame(trips, "trip_id bigint, duration double"))
    found = learning.evaluate_observed(rows, folds=5).first()
    assert found["n"] > 60 and found["mae"] < 3 and found["mae"] < found["mae_of_mean"] / 2 and found["mae"] < found["mae_of_heuristic"] / 2 and found["depth"] in (2, 3)


def test_detectors_are_weighed(spark):
    """A detector that is plugged in changes the ensemble by its weight, and by nothing else."""
    rows = {r["event_id"]: r for r in queries.ano_10_detectors(spark, D).collect()}
    assert any(r["zigzag_score"] for r in rows.values())
    for r in rows.values():
        if r["zigzag_score"] is None:
            assert r["score"] == r["score_without"]
        else:
            assert r["score"] == pytest.approx(min(1.0, r["score_without"] + 0.3 * r["zigzag_score"]), abs=2e-6)
    known = anomaly.Detectors()
    for name in ("iso", "a b"):
        with pytest.raises(ValueError, match="named"):
            known.register(name, anomaly.zigzags, 0.1)
    with pytest.raises(ValueError, match="weights"):
        known.register("x", anomaly.zigzags, 2.0)


def test_zigzags_by_trip(spark):
    turns = [(1, 1, 170.0), (1, 2, -150.0), (1, 3, 130.0), (1, 4, 140.0), (1, 5, None), (1, 6, -170.0), (2, 7, 160.0), (2, 8, 10.0), (2, 9, -160.0)]
    rows = [(1, trip, float(i), i, i, turn) for trip, i, turn in turns]
    df = spark.createDataFrame(rows, "user_id bigint, trip_id bigint, timestamp_unix double, point_index int, event_id bigint, bearing_change double").repartition(3)
    assert sorted((r["event_id"], round(r["score"], 3)) for r in anomaly.zigzags(df).collect()) == [(2, 0.833), (3, 0.722)]


def test_streams_are_counted_as_they_run(spark, threats, tmp_path):
    for i in range(2):
        spark.range(50 * i, 50 * i + 50).coalesce(1).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id"))).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id bigint, x bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ops.observed(rows, "seen", error=F.col("x").isNull() | (F.col("x") > 94)).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    found = ops.counted(q, "seen")
    assert sorted((r["job"], r["records"], r["errors"]) for r in found.collect()) == [("seen", 50, 5), ("seen", 50, 10)]
    assert ops.processing_rate(found).first()["error_rate"] == 0.15
    assert learning.predict_threat(learning.fit_threat(threats), threats).count() == 400  # fitted models still work in the session
