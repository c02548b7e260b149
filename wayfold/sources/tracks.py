"""Sources of tracking events: CSV files, Parquet tables, and the events table mapped to tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfold.schema import ACTIVITIES, RAW_EVENT

TRIP = ["user_id", "trip_id"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw events of a CSV file with a header; unreadable rows keep their text in _corrupt_record. A missing file raises."""
    schema = T.StructType([*T._parse_datatype_string(RAW_EVENT).fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def from_raw(raw: DataFrame) -> DataFrame:
    """Raw events in the form of `tracks`; the address is dropped at the source."""
    return raw.select(
        "user_id", F.col("trip_global_index").alias("trip_id"), "point_index", F.expr("cast(null as bigint)").alias("event_id"), (F.unix_micros("timestamp") / 1e6).alias("timestamp_unix"),
        "lat", "lon", "speed", "is_moving", "activity_type", "activity_confidence", F.col("coords_accuracy"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as trips of moving points, by plain arithmetic."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts").cast("timestamp_ntz"))
    e = e.select("event_id", "user_id", "value", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), us.alias("us"))
    e = e.withColumn("tu0", (F.col("us") - F.lit(1704067200000000)) / F.lit(1e9))
    e = e.withColumn("trip_id", F.col("user_id") * 100 + F.floor(F.col("tu0") / 432.0).cast("bigint"))
    order = Window.partitionBy(*TRIP).orderBy("us", "event_id")
    e = e.withColumns({
        "rn": (F.row_number().over(order) - 1).cast("int"),
        "tu": F.when(F.col("user_id") % 7 == 0, F.col("tu0") * 10.0).otherwise(F.col("tu0")),
        "mv": F.when(F.col("user_id") % 13 == 0, 0.0).otherwise(1.0),
    })
    return e.filter("event_id % 31 <> 0").selectExpr(
        "user_id", "trip_id", "rn point_index", "event_id", "1704067200e0 + tu timestamp_unix",
        "34e0+0.01e0*(user_id%50)+mv*(1e-5*tu*(1+user_id%20)+1e-6*value)+case when event_id%97=0 or (user_id%11=0 and event_id%5=0) then 2e0 else 0e0 end lat",
        "-118e0+0.01e0*(user_id%40)+mv*(1e-5*tu*(1+user_id%15)-1e-6*value) lon",
        "case when event_id%19=0 then -1e0 when event_id%101=0 then value*4e0 when user_id%13=0 then 0e0 else value/5e0 end speed",
        "case when event_type='view' and k%2=0 then 0 else 1 end is_moving",
        "case event_type when 'click' then 'walking' when 'view' then 'still' when 'purchase' then 'in_vehicle' when 'signup' then 'running' else 'other' end activity_type",
        "k activity_confidence", "case when event_id%23=0 then null else 3e0+(event_id%40)*3e0 end coords_accuracy",
    )


def dirty_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracks with what cleaning has to find: repeated indexes, clocks set back, null island, impossible latitudes, copies."""
    c = tracks(spark, sf_dir)
    same = "lon, speed, is_moving"
    first = c.selectExpr(
        "user_id", "trip_id", "case when event_id%53=0 and point_index>0 then point_index-1 else point_index end point_index", "event_id", "point_index arrival_seq",
        "case when event_id%59=0 then timestamp_unix-120e0 else timestamp_unix end timestamp_unix",
        "case when event_id%211=0 then 0e0 when event_id%223=0 then 95e0 else lat end lat", "case when event_id%211=0 then 0e0 else lon end lon",
        *same.split(", ")[1:], "upper(activity_type) activity_type", "activity_confidence", "coords_accuracy", "0 copy_no",
    )
    copies = c.filter("event_id % 61 = 0").selectExpr(
        "user_id", "trip_id", "point_index", "event_id", "point_index arrival_seq", "timestamp_unix", "lat", *same.split(", "), "activity_type", "activity_confidence", "coords_accuracy", "1 copy_no"
    )
    return first.unionByName(copies)


def normalize(events: DataFrame) -> DataFrame:
    """Speeds below zero become null, activities one of the known names; adds event key and hash."""
    activity = F.lower("activity_type")
    return events.withColumns({
        "speed": F.when(F.col("speed") >= 0, F.col("speed")),
        "activity": F.when(activity.isin(*ACTIVITIES), activity).otherwise("unknown"),
        "event_key": event_key(),
        "event_hash": event_hash(),
    })


def event_key():
    return F.concat(F.lit("u"), F.col("user_id"), F.lit("_t"), F.col("trip_id"), F.lit("_p"), F.col("point_index"))


def event_hash():
    """16 hexadecimal digits of what identifies an event."""
    return F.substring(F.md5(F.concat_ws("~", F.col("user_id").cast("string"), F.col("trip_id").cast("string"), F.col("point_index").cast("string"), F.col("event_id").cast("string"))), 1, 16)


def by_user(events: DataFrame, user_id: int, limit: int | None = None) -> DataFrame:
    """A user's events; a limit takes the first by trip and time."""
    out = events.filter(F.col("user_id") == user_id)
    return out if limit is None else out.orderBy("trip_id", "timestamp_unix", "point_index", "event_id").limit(limit)


def by_trip(events: DataFrame, trip_id: int) -> DataFrame:
    return events.filter(F.col("trip_id") == trip_id)


def dataset_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_rows"), F.countDistinct("user_id").alias("unique_users"), F.countDistinct("trip_id").alias("unique_trips"))


def file_size_mb(spark: SparkSession, path: str) -> float:
    """Size of a file or folder on whatever file system its path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop).getLength() / 1e6


def users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


def trips(events: DataFrame, user_id: int | None = None, shown: int = 100) -> DataFrame:
    """The first `shown` trip ids, with the number of all and whether some aren't shown."""
    found = (events if user_id is None else events.filter(F.col("user_id") == user_id)).select("trip_id").distinct()
    total = found.agg(F.count("*").alias("total_trips"))
    return found.orderBy("trip_id").limit(shown).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_trips") > shown)  # total: one row


def checked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows of however many, the latter with their errors."""
    from wayfold.functions.core import names_where

    lat, lon = F.col("lat"), F.col("lon")
    errors = names_where(
        missing_key=F.col("user_id").isNull() | F.col("trip_id").isNull() | F.col("point_index").isNull(), negative_index=F.col("point_index") < 0,
        invalid_coordinates=F.coalesce(~(lat.between(-90, 90) & lon.between(-180, 180)), F.lit(True)), invalid_activity_confidence=~F.col("activity_confidence").between(0, 100),
    )
    told = events.withColumn("errors", errors)
    return told.filter(F.size("errors") == 0).drop("errors"), told.filter(F.size("errors") > 0)


def split_valid(events: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The same of one ingest request; a request of 0 or more than `most` rows is refused."""
    n = events.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a request has 1 to {most} events")
    return checked(events)


def time_range(events: DataFrame, user_id: int, start: float, end: float, limit: int = 1000) -> DataFrame:
    """A user's events from start to end, both included, in order of time."""
    found = events.filter((F.col("user_id") == user_id) & F.col("timestamp_unix").between(start, end))
    return found.orderBy("timestamp_unix", "trip_id", "point_index", "event_id").limit(limit)
