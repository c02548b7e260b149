"""Structured Streaming over tracking events.

None of this has a batch counterpart that it would change: features of a stream
equal the batch features of the same events in order; late rows are marked and
history isn't rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from wayfold.operators import baseline
from wayfold.sources.tables import Table

EVENTS = "user_id bigint, trip_id bigint, point_index int, event_id bigint, timestamp_unix double, lat double, lon double, speed double, is_moving int, activity string"
RADIUS = 6371008.8


def read(spark: SparkSession, path: str, *, files_per_trigger: int = 100, schema: str | StructType = EVENTS) -> DataFrame:
    """A stream of Parquet files, so many in a micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("event_time", F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")))


def without_repeats(stream: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["user_id", "trip_id", "event_id"])


def sessions(stream: DataFrame, *, gap: str = "29.999999 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a gap of 30 s; a gap of exactly 30 s separates."""
    s = stream.withWatermark("event_time", late).groupBy("user_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"), F.min("timestamp_unix").alias("start"), F.max("timestamp_unix").alias("end"))
    return s.select("user_id", "start", "end", "n")


def calls_per_minute(stream: DataFrame, *, late: str = "2 minutes") -> DataFrame:
    """Sliding minutes, every 10 seconds."""
    s = stream.withWatermark("event_time", late).groupBy("user_id", F.window("event_time", "1 minute", "10 seconds").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


STATE = "t double, lat double, lon double, speed double, n bigint, stopped boolean, run double"
FEATURES = "user_id bigint, trip_id bigint, event_id bigint, time_delta double, distance double, calc_speed double, acceleration double, is_stop boolean, stop_duration double, late boolean"


def _distance(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    p, q = np.radians(a), np.radians(c)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def advance(key: tuple, rows: pd.DataFrame, last: tuple | None) -> tuple[list[pd.DataFrame], tuple | None]:
    """Features of one trip's events against the last one seen (a row of STATE), and the last one now."""
    rows, out = rows.sort_values(["timestamp_unix", "point_index", "event_id"]), []
    late = rows[rows["timestamp_unix"] < last[0]] if last else rows[:0]
    rows = rows[len(late) :]  # in order of time, the late ones come first
    if len(late):
        nothing = dict.fromkeys(("distance", "calc_speed", "acceleration", "is_stop", "stop_duration"))
        out.append(pd.DataFrame({"user_id": key[0], "trip_id": key[1], "event_id": late["event_id"], "time_delta": late["timestamp_unix"] - last[0], **nothing, "late": True}, index=late.index))
    if len(rows):
        # the last event seen stands before the new ones
        t, lat, lon = (np.concatenate(([last[i]] if last else [np.nan], rows[c].to_numpy(float))) for i, c in enumerate(("timestamp_unix", "lat", "lon")))
        v = rows["speed"].to_numpy(float)
        v = np.concatenate(([np.nan if last is None or last[3] is None else last[3]], np.where(v >= 0, v, np.nan)))
        dt, d = np.diff(t), _distance(lat[:-1], lon[:-1], lat[1:], lon[1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            calc, acc = np.where(dt > 0, d / dt, np.nan), np.where(dt > 0, np.diff(v) / dt, np.nan)
        stop = rows["is_moving"].to_numpy() != 1
        after = ~np.isnan(dt)
        stop = stop | (after & ((rows["activity"] == "still").to_numpy() | (v[1:] < 0.5) | (calc < 0.5)))
        before = np.concatenate(([bool(last and last[5])], stop[:-1]))
        stayed = np.cumsum(np.where(stop & before & after, dt, 0.0))
        start = np.maximum.accumulate(np.where(stop & before, -np.inf, stayed))  # where the run of stops began
        run = np.where(stop, stayed - np.where(np.isfinite(start), start, 0.0) + np.where(np.isfinite(start), 0.0, last[6] if last else 0.0), 0.0)
        last = (float(t[-1]), float(lat[-1]), float(lon[-1]), None if np.isnan(v[-1]) else float(v[-1]), (last[4] if last else 0) + len(rows), bool(stop[-1]), float(run[-1]))
        number = lambda x: pd.Series(x, index=rows.index).astype(object).where(~np.isnan(x), None)
        out.append(pd.DataFrame({
            "user_id": key[0], "trip_id": key[1], "event_id": rows["event_id"], "time_delta": number(dt), "distance": number(d), "calc_speed": number(calc), "acceleration": number(acc),
            "is_stop": stop, "stop_duration": number(np.where(stop & after, run, np.nan)), "late": False,
        }))
    return out, last


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, *, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """Features as events come; the state is one row, and goes when no event has come for ttl_ms."""
    if state.hasTimedOut:
        state.remove()
        return
    out, last = advance(key, pd.concat(list(batches)), state.get if state.exists else None)
    if last:
        state.update(last)
    yield from out
    seen = last[0] if last else 0.0
    state.setTimeoutTimestamp(max(int(seen * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))


#: Where a trip stands, many in a bucket's state; a missing speed is NaN.
LAST = np.dtype([("user_id", "i8"), ("trip_id", "i8"), ("t", "f8"), ("lat", "f8"), ("lon", "f8"), ("speed", "f8"), ("n", "i8"), ("stopped", "?"), ("run", "f8")])
BUCKETS = 1024


def advance_all(rows: pd.DataFrame, last: np.ndarray) -> tuple[list[pd.DataFrame], np.ndarray]:
    """The features that `advance` gives trip by trip, of many trips at once; last: where trips stand (LAST), and do now. Ids are null in all rows or in none."""
    rows = rows.sort_values(["user_id", "trip_id", "timestamp_unix", "point_index", "event_id"])
    ids = np.column_stack([rows[c].fillna(0).to_numpy(np.int64) for c in ("user_id", "trip_id")])
    keys, code = np.unique(np.concatenate((np.column_stack((last["user_id"], last["trip_id"])), ids)), axis=0, return_inverse=True)
    had, code = code.ravel()[: len(last)], code.ravel()[len(last) :]
    since = np.full(len(keys), np.nan)
    since[had] = last["t"]
    gap, out = rows["timestamp_unix"].to_numpy(float) - since[code], []
    ids = {c: rows[c] if rows[c].notna().all() else None for c in ("user_id", "trip_id")}
    if (late := gap < 0).any():
        nothing = dict.fromkeys(("distance", "calc_speed", "acceleration", "is_stop", "stop_duration"))
        out.append(pd.DataFrame({**{c: x if x is None else x[late] for c, x in ids.items()}, "event_id": rows["event_id"][late], "time_delta": gap[late], **nothing, "late": True}))
        rows, code = rows[~late], code[~late]
        ids = {c: x if x is None else x[~late] for c, x in ids.items()}
    if not len(rows):
        return out, last
    # the last event seen of a trip stands before its new ones
    seen = np.isin(had, code)
    order = np.argsort(np.concatenate((had[seen], code)), kind="stable")
    trip, new = np.concatenate((had[seen], code))[order], (np.arange(seen.sum() + len(rows)) >= seen.sum())[order]
    column = lambda kept, now: np.concatenate((last[kept][seen], now))[order]
    t, lat, lon = (column(k, rows[c].to_numpy(float)) for k, c in (("t", "timestamp_unix"), ("lat", "lat"), ("lon", "lon")))
    v = rows["speed"].to_numpy(float)
    v = column("speed", np.where(v >= 0, v, np.nan))
    head = np.concatenate(([True], trip[1:] != trip[:-1]))
    prior = lambda x: np.where(head, np.nan, np.concatenate(([np.nan], x[:-1])))
    dt, d = t - prior(t), _distance(prior(lat), prior(lon), lat, lon)
    with np.errstate(divide="ignore", invalid="ignore"):
        calc, acc = np.where(dt > 0, d / dt, np.nan), np.where(dt > 0, (v - prior(v)) / dt, np.nan)
    after, none = ~np.isnan(dt), np.zeros(seen.sum(), dtype=bool)
    still = np.concatenate((none, (rows["activity"] == "still").to_numpy(bool)))[order]
    stop = column("stopped", rows["is_moving"].to_numpy() != 1) | (new & after & (still | (v < 0.5) | (calc < 0.5)))
    goes_on = stop & ~head & np.concatenate(([False], stop[:-1]))
    spent = np.where(new, np.where(goes_on & after, dt, 0.0), column("run", np.zeros(len(rows))))
    run = np.where(stop, pd.Series(spent).groupby(np.cumsum(~goes_on)).cumsum().to_numpy(), 0.0)
    out.append(pd.DataFrame({
        **ids, "event_id": rows["event_id"], "time_delta": dt[new], "distance": d[new], "calc_speed": calc[new], "acceleration": acc[new],
        "is_stop": stop[new], "stop_duration": np.where(stop & after, run, np.nan)[new], "late": False,
    }))
    end = np.flatnonzero(np.append(head[1:], True))
    now = np.empty(len(end), dtype=LAST)
    counts = np.bincount(code, minlength=len(keys))
    counts[had] += last["n"]
    now["user_id"], now["trip_id"] = keys[trip[end]].T
    for c, x in (("t", t), ("lat", lat), ("lon", lon), ("speed", v), ("n", counts[trip]), ("stopped", stop), ("run", run)):
        now[c] = x[end]
    return out, np.concatenate((last[~seen], now))


def named(last: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Which of the trips (LAST) have events among rows."""
    ids = [rows[c].fillna(0).astype("int64") for c in ("user_id", "trip_id")]
    return pd.MultiIndex.from_arrays([last["user_id"], last["trip_id"]]).isin(pd.MultiIndex.from_arrays(ids))


def follow_all(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, *, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """Features of a bucket's trips as events come; a trip without events is forgotten when the watermark is ttl_ms beyond its last."""
    last = np.frombuffer(bytes(state.get[0]), dtype=LAST) if state.exists else np.empty(0, dtype=LAST)
    rows, now = [] if state.hasTimedOut else list(batches), state.getCurrentWatermarkMs()
    kept = last["t"] * 1000 + ttl_ms >= now
    if rows:
        rows = pd.concat(rows)
        if not kept.all():
            kept |= named(last, rows)
        out, last = advance_all(rows, last[kept])
        yield from out
    else:
        last = last[kept]
    if not len(last):
        state.remove()
        return
    state.update((last.tobytes(),))
    state.setTimeoutTimestamp(max(int(last["t"].min() * 1000) + ttl_ms, now + 1))


def bucketed(rows: DataFrame, buckets: int) -> GroupedData:
    """rows by the bucket that their trip is dealt to, those without a user or a trip apart."""
    keys = {"bucket": F.pmod(F.xxhash64("user_id", "trip_id"), F.lit(buckets)), "no_user": F.col("user_id").isNull(), "no_trip": F.col("trip_id").isNull()}
    return rows.withColumns(keys).groupBy(*keys)


def features(stream: DataFrame, *, late: str = "1 day", ttl: timedelta = timedelta(days=1), buckets: int = BUCKETS) -> DataFrame:
    """Features as they come.

    Events that come after later ones of their trip are marked as late; those
    older than the watermark, `late` behind the newest event, are left out. A
    trip is forgotten once the watermark is `ttl` beyond its last event. Trips
    are dealt to buckets, each with one state and one call a micro-batch.
    """
    grouped = bucketed(stream.withWatermark("event_time", late), buckets)
    return grouped.applyInPandasWithState(partial(follow_all, ttl_ms=int(ttl.total_seconds() * 1000)), FEATURES, "trips binary", "append", GroupStateTimeout.EventTimeTimeout)


def baseline_updater(table: Table) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over scored points: blends a batch's metrics into a table of metrics by user, each batch once however often it is sent."""

    def update(batch: DataFrame, number: int) -> None:
        done = table.mark()
        if (done is None or number > int(done)) and not batch.isEmpty():
            table.upsert(baseline.blend(table.read(), baseline.metrics(batch)), mark=str(number))

    return update


def start(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], *, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run a stream's batches through `each`: every so often (`10 seconds`), or all there is now and then end."""
    writer = rows.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
