"""Queries over streams that are run to their end, over files, and of stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import baseline, ops
from wayfold.operators import features as batch_features
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import analysis, sql
from wayfold.queries.registry import query, rounded
from wayfold.schema import RAW_EVENT
from wayfold.sources import sinks, tables
from wayfold.sources import tracks as source
from wayfold.sources.staging import shared_dir, staged
from wayfold.streaming import points as stream
from wayfold.streaming import state

K, KEY = analysis.K, analysis.KEY
LATE = "365 days"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file that arrives, some; a micro-batch takes as many files as its part has.
FILE_ROWS = 250_000


def arrive(rows: DataFrame, place: str, files: int) -> None:
    """rows as so many files, all written after those there are: empty files fill up what a small part doesn't need."""
    (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(place)
    written = len(rows.sparkSession.read.schema(rows.schema).parquet(place).inputFiles())
    for _ in range(-written % files):
        rows.limit(0).coalesce(1).write.mode("append").parquet(place)


def arriving(spark: SparkSession, events: DataFrame, *parts: str, folder_too: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """A stream of events that come in so many parts, one in a micro-batch, each of as many files as the rows need; folder_too: with the folder, for more to come."""
    place, names = folder(spark, "events"), [c.split() for c in stream.EVENTS.split(", ")]
    rows = staged(events.select(*[F.col(n).cast(k).alias(n) for n, k in names]), "arriving")
    files = max(1, -(-rows.count() // FILE_ROWS))
    for part in parts:
        arrive(rows.filter(part), place, files)
    found = stream.read(spark, place, files_per_trigger=files)
    return (found, place) if folder_too else found


def to_end(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when all its input is read; `complete`: the last state of an aggregate."""
    place, made = folder(spark, "stream"), []

    def each(batch: DataFrame, number: int) -> None:
        path = f"{place}/{number}"
        batch.write.mode("overwrite").parquet(path)
        made.append(path)

    stream.start(rows, f"{place}/checkpoint", each, mode=mode).awaitTermination()
    paths = sorted(set(made), key=made.index)
    return spark.read.schema(rows.schema).parquet(*(paths if mode == "append" else paths[-1:])) if paths else spark.createDataFrame([], rows.schema)


FEATURES = ["time_delta", "distance", "calc_speed", "acceleration", "stop_duration"]


@query("str_02", sql.query("norm", "select event_id%3 batch,count(*) n from norm group by 1"))
def str_02(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of a bounded number of files, started by the clock."""
    events = arriving(spark, source.normalize(source.tracks(spark, d)), *[f"event_id % 3 = {i}" for i in range(3)])
    place = folder(spark, "batches")

    def each(batch: DataFrame, number: int) -> None:
        batch.agg(F.lit(number).cast("bigint").alias("batch"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/{number}")

    run = stream.start(events, folder(spark, "checkpoint"), each, every="1 second")
    run.processAllAvailable()
    run.stop()
    return spark.read.schema("batch bigint, n bigint").parquet(f"{place}/*")


@query("str_03", sql.query("feat", f"select user_id,trip_id,event_id,{','.join(f'round({c}+1e-9,4) {c}' for c in FEATURES)},is_stop from feat"))
def str_03(spark: SparkSession, d: str) -> DataFrame:
    """Features of a stream in two micro-batches, against the batch's."""
    events = arriving(spark, source.normalize(source.tracks(spark, d)), "point_index < 5", "point_index >= 5")
    out = to_end(spark, stream.features(events, late=LATE))
    return rounded(out.select("user_id", "trip_id", "event_id", *FEATURES, "is_stop"), 4, nudge=1e-9)


def pushed(spark: SparkSession, place: str) -> None:
    """One more event far beyond all others, of no user: the watermark passes these."""
    rows = spark.read.parquet(place)
    far = rows.agg(F.max("timestamp_unix").alias("t")).select(*[(F.col("t") + 3 * 365 * 86400.0 if f.name == "timestamp_unix" else F.lit(-1 if f.name in ("user_id", "trip_id") else None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    far.coalesce(1).write.mode("append").parquet(place)


@query("str_03_resumed", sql.query("feat", f"select user_id,trip_id,event_id,{','.join(f'round({c}+1e-9,4) {c}' for c in FEATURES)},is_stop from feat"))
def str_03_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Features of the first half of each trip by the batch, of the rest by a stream that goes on from there and gets its events in disorder."""
    rows = source.normalize(source.tracks(spark, d))
    nth = F.row_number().over(Window.partitionBy("user_id", "trip_id").orderBy("timestamp_unix", "point_index", "event_id"))
    half = staged(rows.withColumn("_later", nth > 5), "halves")
    known = staged(batch_features.features(half.filter("not _later").drop("_later")), "features")
    events, place = arriving(spark, half.filter("_later"), "event_id % 2 = 0", "event_id % 2 = 1", "false", folder_too=True)
    pushed(spark, place)
    out = to_end(spark, state.features(events, start=state.last_seen(known), late=LATE))
    both = known.select("user_id", "trip_id", "event_id", *FEATURES, "is_stop").unionByName(out.select("user_id", "trip_id", "event_id", *FEATURES, "is_stop"))
    return rounded(both, 4, nudge=1e-9)


@query("str_04", sql.query("metrics", "select user_id,metric,sample_size from metrics where sample_size>0 and metric<>'trip_duration'"))
def str_04(spark: SparkSession, d: str) -> DataFrame:
    """Metrics blended batch by batch, each of which a stream sends twice: numbers of values are those of all points."""
    points, place = scored_tracks(spark, d), folder(spark, "points")
    empty = baseline.metrics(points.limit(0))
    kept = tables.Table(spark, folder(spark, "metrics"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema), ["user_id", "metric"])
    points = staged(points, "points")
    files = max(1, -(-points.count() // FILE_ROWS))
    for part in ("trip_id % 2 = 0", "trip_id % 2 = 1"):
        arrive(points.filter(part), place, files)
    update = stream.baseline_updater(kept)

    def twice(batch: DataFrame, number: int) -> None:
        update(batch, number)
        update(batch, number)

    arriving_points = stream.read(spark, place, files_per_trigger=files, schema=points.schema)
    stream.start(arriving_points, folder(spark, "checkpoint"), twice).awaitTermination()
    return kept.read().filter("sample_size > 0 and metric <> 'trip_duration'").select("user_id", "metric", F.col("sample_size").cast("bigint").alias("sample_size"))


@query("str_05", sql.query("norm", """with g as (select *, case when timestamp_unix-lag(timestamp_unix) over w<30 then 0 else 1 end fresh from norm window w as (partition by user_id order by timestamp_unix,event_id)),
 s as (select *, sum(fresh) over (partition by user_id order by timestamp_unix,event_id rows unbounded preceding) nth from g)
select user_id,round(min(timestamp_unix),3) "start",round(max(timestamp_unix),3) "end",count(*) n from s group by user_id,nth"""))  # fmt: skip
def str_05(spark: SparkSession, d: str) -> DataFrame:
    events = arriving(spark, source.normalize(source.tracks(spark, d)), "event_id % 2 = 0", "event_id % 2 = 1")
    return rounded(to_end(spark, stream.sessions(events, late=LATE), "complete"), 3)


@query("str_07", sql.query("dirty", "select distinct user_id,trip_id,event_id from dirty"))
def str_07(spark: SparkSession, d: str) -> DataFrame:
    """Repeated events, some of which come in another micro-batch, are told once."""
    events = arriving(spark, source.normalize(source.dirty_tracks(spark, d)), "lat < 35", "not lat < 35", "event_id % 61 = 0")
    return to_end(spark, stream.without_repeats(events, late=LATE)).select("user_id", "trip_id", "event_id")


@query("str_08", sql.query("norm", """with m as (select user_id,cast(floor(floor(timestamp_unix*1e6)/1e7) as bigint)-i tens from norm cross join range(0,6) r(i)) select user_id,tens*10 "start",count(*) n from m group by 1,2"""))
def str_08(spark: SparkSession, d: str) -> DataFrame:
    events = arriving(spark, source.normalize(source.tracks(spark, d)), "true")
    return to_end(spark, stream.calls_per_minute(events, late=LATE), "complete").withColumn("start", F.unix_timestamp("start"))


BAD = "lat not between -90 and 90 or lon not between -180 and 180"


@query("ops_04_observed", sql.query("dirty", f"select 'tracks' job,count(*) records,count(*) filter (where {BAD}) errors from dirty"))
def ops_04_observed(spark: SparkSession, d: str) -> DataFrame:
    """Records and bad coordinates that a stream counted while it was written."""
    rows = source.dirty_tracks(spark, d)
    place, out = folder(spark, "dirty"), folder(spark, "written")
    rows.write.parquet(place)
    events = ops.observed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place), "tracks", error=F.expr(BAD))
    ran = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    ran.awaitTermination()
    return ops.counted(ran, "tracks").groupBy("job").agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))


@query("src_01", sql.query("tracks", f"select {K},is_moving,activity_type from tracks"))
def src_01(spark: SparkSession, d: str) -> DataFrame:
    """Events of a CSV file, some lines of which can't be read."""
    place, t = folder(spark, "csv"), source.tracks(spark, d)
    known = {"trip_index_for_user": F.lit(0), "trip_global_index": F.col("trip_id"), "timestamp": F.timestamp_micros((F.col("timestamp_unix") * 1_000_000).cast("bigint")), "odometer": F.col("event_id")}
    names = [c.split()[0] for c in RAW_EVENT.split(",")]
    raw = t.select(*[known.get(n, F.col(n) if n in t.columns else F.lit(None)).cast("string").alias(n) for n in names])
    broken = raw.filter("cast(odometer as bigint) % 97 = 0").withColumn("user_id", F.lit("nobody"))
    raw.unionByName(broken).write.option("header", True).csv(place)
    found = source.read_csv(spark, place).filter("_corrupt_record is null")
    return found.select("user_id", F.col("trip_global_index").alias("trip_id"), "point_index", F.col("odometer").cast("bigint").alias("event_id"), "is_moving", "activity_type")


@query("src_10", sql.query("dirty", f"with r as (select * from dirty where user_id=11 or event_id%223=0) select case when {BAD} then 'invalid_coordinates' else '' end errors,count(*) n from r group by 1"))
def src_10(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and quarantined rows, by their errors, of however many: the bound of one request is for requests."""
    good, bad = source.checked(source.dirty_tracks(spark, d).filter("user_id = 11 or event_id % 223 = 0"))
    both = good.withColumn("errors", F.array().cast("array<string>")).unionByName(bad)
    return both.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


AGES = "with q as (select o_orderkey id,'c'||(o_custkey%20) cell,(cast(o_orderdate as date)-date '1992-01-01')*60e0 as at_q from orders), r as (select 'c'||(c_custkey%20) cell,c_custkey*97.0e0 as at_r,c_custkey impact from customer)"


def requests_and_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    cell = lambda c: F.concat(F.lit("c"), F.col(c) % 20).alias("cell")
    requests = read("orders").select(F.col("o_orderkey").alias("id"), cell("o_custkey"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 60.0).alias("at"))
    records = read("customer").select(cell("c_custkey"), (F.col("c_custkey") * 97.0).alias("at"), F.col("c_custkey").alias("impact"))
    return requests, records


def aged(spark: SparkSession, d: str, seconds: float) -> DataFrame:
    return tables.fresh(*requests_and_records(spark, d), seconds, value=["impact"]).select("id", "impact")


def aged_stream(spark: SparkSession, d: str, seconds: float) -> DataFrame:
    """The same by two streams, requests and records in several files, not in order of time."""
    places = {}
    # a day later, both: a stream takes what is as old as the epoch for late from the start
    requests, records = (df.withColumn("at", F.col("at") + 86400) for df in requests_and_records(spark, d))
    for name, df, key in (("requests", requests, "id"), ("records", records.withColumnRenamed("impact", "value"), "value")):
        places[name] = folder(spark, name)
        for i in range(2):
            df.filter(F.pmod(F.xxhash64(key), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(places[name])
        far = df.agg(F.max("at").alias("t")).select(*[(F.col("t") + 1e9 if f.name == "at" else F.lit("none" if f.name == "cell" else -1)).cast(f.dataType).alias(f.name) for f in df.schema])
        far.coalesce(1).write.mode("append").parquet(places[name])
    read = lambda name: spark.readStream.schema(spark.read.parquet(places[name]).schema).option("maxFilesPerTrigger", 1).parquet(places[name])
    out = to_end(spark, state.fresh(read("requests"), read("records"), seconds, kind="bigint", late="3000 days"))
    return out.filter("cell <> 'none'").select("id", F.col("value").alias("impact"))


def aged_sql(seconds: int) -> str:
    return f"{AGES} select id,(select arg_max(impact,at_r) from r where r.cell=q.cell and at_r<=at_q and at_r>=at_q-{seconds}) impact from q"


@query("src_11", aged_sql(900))
def src_11(spark: SparkSession, d: str) -> DataFrame:
    """Weather records, fit for 15 minutes."""
    return aged(spark, d, 900)


@query("src_12", aged_sql(300))
def src_12(spark: SparkSession, d: str) -> DataFrame:
    """Traffic records, fit for 5 minutes."""
    return aged(spark, d, 300)


@query("str_06_weather", aged_sql(900))
def str_06_weather(spark: SparkSession, d: str) -> DataFrame:
    """Weather records, fit for 15 minutes, as the state of a stream."""
    return aged_stream(spark, d, 900)


@query("str_06_traffic", aged_sql(300))
def str_06_traffic(spark: SparkSession, d: str) -> DataFrame:
    """Traffic records, fit for 5 minutes, as the state of a stream."""
    return aged_stream(spark, d, 300)


@query("src_13", sql.query("tracks", "with t as (select user_id,trip_id,count(*) n from tracks group by 1,2) select user_id,trip_id,case when trip_id%3=0 then -n else n end n from t where user_id%5<>0"))
def src_13(spark: SparkSession, d: str) -> DataFrame:
    """A table made in two appends, some rows replaced, some deleted."""
    t = source.tracks(spark, d).groupBy("user_id", "trip_id").agg(F.count("*").alias("n"))
    kept = tables.Table(spark, folder(spark, "trips"), "user_id bigint, trip_id bigint, n bigint", ["user_id", "trip_id"])
    for part in ("trip_id % 2 = 0", "trip_id % 2 = 1"):
        kept.create(t.filter(part))
    kept.upsert(t.filter("trip_id % 3 = 0").withColumn("n", -F.col("n")))
    kept.delete(t.filter("user_id % 5 = 0"))
    return kept.read()


@query("snk_01", sql.query("conf", "select user_id,trip_id,point_index,event_id,'{\"user_id\":'||user_id||',\"trip_id\":'||trip_id||',\"point_index\":'||point_index||',\"event_id\":'||event_id||',\"activity\":\"'||activity||'\",\"confidence_level\":\"'||confidence_level||'\",\"has_issues\":'||cast(has_issues as varchar)||'}' body from conf"))
def snk_01(spark: SparkSession, d: str) -> DataFrame:
    return sinks.as_json(scored_tracks(spark, d), [*KEY, "activity", "confidence_level", "has_issues"], keys=KEY)


@query("bas_08", sql.query("head metrics", "select user_id,trips,points,round(\"days\",2) \"days\",trips>=5 and points>=50 is_mature,round(m.mean+1e-9,2) mean_speed,round(m.std+1e-9,2) std_speed from head left join metrics m using (user_id) where m.metric='speed'"))
def bas_08(spark: SparkSession, d: str) -> DataFrame:
    """The list of baselines in brief."""
    p = scored_tracks(spark, d)
    return rounded(baseline.brief(baseline.wide(p, mature_trips=5, mature_points=50)), 2, nudge=1e-9).withColumn("days", F.round("days", 2))
