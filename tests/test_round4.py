"""What the fourth round's findings were about."""

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayfold.streaming import points, state


def test_resumed_trips_share_states(spark, tmp_path):
    """A stream that goes on from a batch keeps many trips in few states, tells of each what it would tell alone, forgets it, and large ids stay exact beside events without one."""
    rng = np.random.default_rng(9)
    start = [(u, 1, 1000.0, 50.0, 10.0, None if u % 3 else 1.0, 3, bool(u % 2), 5.0) for u in range(1, 31)]
    rows = [(None if u > 50 else u, 1, i, 2**60 + 100 * u + i, 990.0 + 7 * i + u % 4, 50.0 + int(rng.integers(0, 3)) * 1e-4, 10.0, [None, 0.2, 5.0][i % 3], i % 2, ["still", "walking"][i % 5 > 2]) for u in range(1, 52) for i in range(8)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    far = [(-1, -1, None, None, t, None, None, None, None, None) for t in (1e6, 2e6)]
    for i, part in enumerate((rows[::2], rows[1::2], far[:1], far[1:])):
        spark.createDataFrame(part, points.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(points.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")))
    begun, told = spark.createDataFrame(start, "user_id bigint, trip_id bigint, t double, lat double, lon double, speed double, n bigint, stopped boolean, run double"), []
    run = points.start(state.features(stream, start=begun, late="1 hour", ttl=timedelta(seconds=60), buckets=2), f"{tmp_path}/checkpoint", lambda b, _: told.extend(b.collect()))
    run.awaitTermination()
    sizes = [op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]]
    assert max(sizes) <= 8 and sizes[-1] <= 2
    want, frame = [], pd.DataFrame(rows, columns=[c.split()[0] for c in points.EVENTS.split(", ")])
    for u in range(1, 52):
        own = frame[frame["event_id"].between(2**60 + 100 * u, 2**60 + 100 * u + 7)]
        want += points.advance((None if u > 50 else u, 1), own, start[u - 1][2:] if u <= 30 else None)[0]
    shape = lambda x: ([x["user_id"], x["event_id"]], [np.nan if x[c] is None else float(x[c]) for c in ("time_delta", "distance", "calc_speed", "acceleration", "is_stop", "stop_duration", "late")])
    got, want = (sorted(map(shape, x), key=lambda r: r[0][1]) for x in ([r for r in told if r["user_id"] != -1], pd.concat([w.astype(object) for w in want]).to_dict("records")))
    assert len(got) == len(rows) and [r[0] for r in got] == [r[0] for r in want] and any(r[1][-1] for r in got)
    assert np.allclose([r[1] for r in got], [r[1] for r in want], equal_nan=True)
