"""Streams that wait for the watermark: what they tell doesn't depend on the order of arrival.

Both processors keep what can't be told yet in a list state, tell it in order of
time once the watermark has passed, and have one timer a key: for the next
waiting row, or for the end of what is kept. They need Spark's RocksDB state
store, which `with_rocksdb` sets for the session's streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfold.streaming.points import FEATURES, LAST, advance_all, bucketed, named

#: Events that wait. They are kept as bytes of Arrow tables, many to an entry, like the trips of a bucket, since each entry costs a call.
WAITING = pa.schema({
    "user_id": pa.int64(), "trip_id": pa.int64(), "point_index": pa.int32(), "event_id": pa.int64(), "timestamp_unix": pa.float64(), "lat": pa.float64(), "lon": pa.float64(), "speed": pa.float64(), "is_moving": pa.int32(), "activity": pa.string(),
})
COLUMNS = WAITING.names[2:]


def with_rocksdb(spark: SparkSession) -> None:
    """Batches write what changed of the state; whole copies are written beside them now and then."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class OneTimer(StatefulProcessor):
    """A key's timer stands at one time only."""

    handle: StatefulProcessorHandle

    def wake(self, at_ms: int | None, now_ms: int) -> None:
        self.stand(list(self.handle.listTimers()), at_ms, now_ms)

    def stand(self, timers: list[int], at_ms: int | None, now_ms: int) -> None:
        for old in timers:
            self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(max(at_ms, now_ms + 1))


class TripFeatures(OneTimer):
    """Features of a bucket's trips, each in order of time, from where an initial state left off; a trip is forgotten ttl after its last event, unless more of it wait."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last, self.waiting = handle, handle.getValueState("last", "trips binary"), handle.getListState("waiting", "block binary")

    def trips(self) -> np.ndarray:
        return np.frombuffer(bytes(self.last.get()[0]), dtype=LAST) if self.last.exists() else np.empty(0, dtype=LAST)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """A part of the bucket's trips: there may be several calls."""
        more = np.empty(len(initialState), dtype=LAST)
        for c in LAST.names:
            more[c] = initialState[c] if LAST[c].kind == "f" else initialState[c].fillna(0)
        last = np.concatenate((self.trips(), more))
        last = last[~pd.DataFrame({c: last[c] for c in ("user_id", "trip_id")}).duplicated(keep="last").to_numpy()]
        self.last.update((last.tobytes(),))
        self.wake(int(last["t"].min() * 1000) + self.ttl_ms, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).reindex(columns=[*WAITING.names, "no_event"])
        rows["event_id"] = rows["event_id"].astype("Int64").mask(rows["no_event"].eq(True))
        append(self.waiting, packed(rows))
        first, now = float(rows["timestamp_unix"].min()) * 1000, timerValues.getCurrentWatermarkInMs()
        if first <= now:
            yield from self.told(key, timerValues)
        else:  # nothing to tell: what is kept needn't be read
            timers = list(self.handle.listTimers())
            if not timers or min(timers) > first:
                self.stand(timers, int(np.ceil(first)), now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.told(key, timerValues)

    def told(self, key: tuple, timer) -> Iterator[pd.DataFrame]:
        now = timer.getCurrentWatermarkInMs()
        rows, last = unpacked(self.waiting), self.trips()
        is_ready = (rows["timestamp_unix"] * 1000 <= now).to_numpy()
        rest, before = rows[~is_ready], len(last)
        if is_ready.any():
            found, last = advance_all(rows[is_ready], last)
            yield from found
            self.waiting.put(packed(rest)) if len(rest) else self.waiting.clear()
        waits = named(last, rest)
        kept = waits | (last["t"] * 1000 + self.ttl_ms > now)
        due = [int(np.ceil(rest["timestamp_unix"].min() * 1000))] if len(rest) else []
        due += [int(t * 1000) + self.ttl_ms for t in [last["t"][kept & ~waits].min(initial=np.inf)] if t < np.inf]
        if not kept.any():
            self.last.clear()
        elif is_ready.any() or kept.sum() < before:
            self.last.update((last[kept].tobytes(),))
        self.wake(min(due, default=None), now)


def last_seen(features: DataFrame) -> DataFrame:
    """Where a batch of features leaves each trip: the state from which a stream goes on."""
    run = F.when(F.col("is_stop"), F.coalesce("stop_duration", F.lit(0.0))).otherwise(0.0)
    now = F.struct(F.col("timestamp_unix").alias("t"), "lat", "lon", F.when(F.col("speed") >= 0, F.col("speed")).alias("speed"), F.col("is_stop").alias("stopped"), run.alias("run"))
    last = features.groupBy("user_id", "trip_id").agg(F.max_by(now, F.struct("timestamp_unix", "point_index", "event_id")).alias("l"), F.count("*").alias("n"))
    return last.select("user_id", "trip_id", "l.t", "l.lat", "l.lon", "l.speed", "n", "l.stopped", "l.run")


def features(stream: DataFrame, *, start: DataFrame | None = None, late: str = "1 day", ttl: timedelta = timedelta(days=1), buckets: int = 256) -> DataFrame:
    """Features of every event, told when the watermark (`late` behind the newest event) has passed it: those of the batch, in whatever order events come.

    start: where trips stand already (last_seen of a batch). Events older than
    the watermark are left out; ones older than their trip's start are marked late.
    Trips are dealt to buckets, each with one state and one timer.
    """
    with_rocksdb(stream.sparkSession)
    # an id that is null would make the others of its batch inexact doubles in pandas
    events = stream.withWatermark("event_time", late).withColumns({"no_event": F.col("event_id").isNull(), "event_id": F.coalesce("event_id", F.lit(0))})
    grouped = bucketed(events, buckets)
    begun = None if start is None else bucketed(start, buckets)
    return grouped.transformWithStateInPandas(TripFeatures(int(ttl.total_seconds() * 1000)), FEATURES, "append", "EventTime", begun)


class Freshest(OneTimer):
    """Answers requests by the newest record of their key that isn't older than ttl; records go when no request can want them."""

    def __init__(self, ttl_ms: int, kind: str):
        self.ttl_ms, self.kind = ttl_ms, kind
        self.record = np.dtype([("at", "f8"), ("value", "i8" if kind in ("int", "bigint") else "f8")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "block binary")
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            asked = b["id"].notna().to_numpy()
            append(self.records, blocks(b[~asked], self.record))
            append(self.waiting, blocks(b[asked], ASKED))
        yield from self.told(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.told(key, timerValues)

    def told(self, key: tuple, timer) -> Iterator[pd.DataFrame]:
        now = timer.getCurrentWatermarkInMs()
        rows, known = held(self.waiting, ASKED), np.sort(held(self.records, self.record), order=["at", "value"])  # of equal times the greatest is last
        is_ready = rows["at"] * 1000 <= now
        ready, rest = rows[is_ready], rows[~is_ready]
        if len(ready):
            nth = np.searchsorted(known["at"], ready["at"], side="right") - 1
            fit = nth >= 0
            fit[fit] = ready["at"][fit] - known["at"][nth[fit]] <= self.ttl_ms / 1000
            value = np.full(len(ready), None, dtype=object)
            value[fit] = known["value"][nth[fit]].tolist()
            yield pd.DataFrame({"id": ready["id"], "cell": key[0], "value": value})
            put(self.waiting, rest)
        kept = known[known["at"] * 1000 + self.ttl_ms >= now]
        if len(kept) < len(known):
            put(self.records, kept)
        due = ([int(np.ceil(rest["at"].min() * 1000))] if len(rest) else []) + [int(t * 1000) + self.ttl_ms + 1 for t in kept["at"][:1]]
        self.wake(min(due, default=None), now)


#: Rows of a state's block, at most: rows are kept as bytes of arrays, many to an entry, since each entry costs a call.
BLOCK = 65_536
ASKED = np.dtype([("id", "i8"), ("at", "f8")])


def blocks(rows: pd.DataFrame | np.ndarray, kind: np.dtype) -> list[tuple[bytes]]:
    out = np.empty(len(rows), dtype=kind)
    for c in kind.names:
        out[c] = rows[c]
    return [(out[i : i + BLOCK].tobytes(),) for i in range(0, len(out), BLOCK)]


def packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    table = pa.Table.from_pandas(rows, schema=WAITING, preserve_index=False).replace_schema_metadata()
    out = []
    for i in range(0, len(rows), BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(i, BLOCK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(state) -> pd.DataFrame:
    found = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in state.get()] if state.exists() else []
    return pa.concat_tables([WAITING.empty_table(), *found]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def append(state, entries: list[tuple[bytes]]) -> None:
    if entries:
        state.appendList(entries)


def held(state, kind: np.dtype) -> np.ndarray:
    found = [np.frombuffer(bytes(r[0]), dtype=kind) for r in state.get()] if state.exists() else []
    return np.concatenate(found) if found else np.empty(0, dtype=kind)


def put(state, rows: np.ndarray) -> None:
    state.put(blocks(rows, rows.dtype)) if len(rows) else state.clear()


def fresh(requests: DataFrame, records: DataFrame, seconds: float, *, kind: str = "double", late: str = "10 minutes") -> DataFrame:
    """Of each request (stream of id, cell, at) the newest record (stream of cell, at, value) of its cell that is at most `seconds` old, null without one.

    A request is answered when the watermark of both streams has passed it, so
    that a record that comes later but was made before still counts.
    """
    with_rocksdb(requests.sparkSession)
    time = F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")).alias("event_time")
    asked = requests.select("cell", "at", F.col("id").cast("bigint").alias("id"), F.lit(None).cast(kind).alias("value"), time)
    known = records.select("cell", "at", F.lit(None).cast("bigint").alias("id"), F.col("value").cast(kind).alias("value"), time)
    both = asked.withWatermark("event_time", late).union(known.withWatermark("event_time", late))
    return both.groupBy("cell").transformWithStateInPandas(Freshest(int(seconds * 1000), kind), f"id bigint, cell string, value {kind}", "append", "EventTime")
