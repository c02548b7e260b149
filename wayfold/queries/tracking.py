"""Queries: sources, cleaning, features, confidence, trips, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import clean, confidence, quality, trips
from wayfold.operators.features import features
from wayfold.plans import tracking as plan
from wayfold.queries import sql
from wayfold.queries.registry import query, rounded
from wayfold.sources import tables
from wayfold.sources import tracks as source

KEY = ["user_id", "trip_id", "point_index", "event_id"]
K = "user_id,trip_id,point_index,event_id"


def seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp_unix", F.round("timestamp_unix", 3))


@query("src_tracks", sql.query("tracks", f"select {K}, round(timestamp_unix,3) timestamp_unix, round(lat,6) lat, round(lon,6) lon, round(speed,6) speed, is_moving, activity_type, activity_confidence, coords_accuracy from tracks"))
def src_tracks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seconds(source.tracks(spark, d)))


@query("src_dirty_tracks", sql.query("dirty", f"select {K}, arrival_seq, copy_no, round(timestamp_unix,3) timestamp_unix, round(lat,6) lat, round(lon,6) lon, activity_type from dirty"))
def src_dirty_tracks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seconds(source.dirty_tracks(spark, d)).select(*KEY, "arrival_seq", "copy_no", "timestamp_unix", "lat", "lon", "activity_type"))


@query("src_02", sql.query("tracks", f"select {K} from tracks where user_id=3 order by trip_id,timestamp_unix,point_index,event_id limit 40"))
def src_02(spark: SparkSession, d: str) -> DataFrame:
    return source.by_user(source.tracks(spark, d), 3, 40).select(*KEY)


@query("src_03", sql.query("tracks", f"select {K} from tracks where trip_id=302"))
def src_03(spark: SparkSession, d: str) -> DataFrame:
    return source.by_trip(source.tracks(spark, d), 302).select(*KEY)


@query("src_04", sql.query("tracks", "select count(*) total_rows, count(distinct user_id) unique_users, count(distinct trip_id) unique_trips from tracks"))
def src_04(spark: SparkSession, d: str) -> DataFrame:
    return source.dataset_stats(source.tracks(spark, d))


@query("src_04_file")
def src_04_file(spark: SparkSession, d: str) -> DataFrame:
    """The same with the size and place of the file."""
    path = f"{d}/events.parquet"
    return src_04(spark, d).withColumns({"file_size_mb": F.lit(source.file_size_mb(spark, path)), "path": F.lit(path)})


@query("src_05", sql.query("tracks", "select distinct user_id from tracks"))
def src_05(spark: SparkSession, d: str) -> DataFrame:
    return source.users(source.tracks(spark, d))


@query("src_06", sql.query("tracks", "with t as (select distinct trip_id from tracks) select trip_id, (select count(*) from t) total_trips, (select count(*)>100 from t) truncated from t order by trip_id limit 100"))
def src_06(spark: SparkSession, d: str) -> DataFrame:
    return source.trips(source.tracks(spark, d))


@query("src_07", sql.query("dirty", "select count(*) total_rows, count(*) filter (where lat between -90 and 90 and lon between -180 and 180) successful_rows, count(*) filter (where not(lat between -90 and 90 and lon between -180 and 180)) failed_rows from dirty"))
def src_07(spark: SparkSession, d: str) -> DataFrame:
    return quality.ingestion_counters(source.dirty_tracks(spark, d))


@query("src_08_09", sql.query("norm", f"select {K}, event_key, event_hash from norm"))
def src_08_09(spark: SparkSession, d: str) -> DataFrame:
    return source.normalize(source.tracks(spark, d)).select(*KEY, "event_key", "event_hash")


@query("src_14", sql.query("tracks", f"select {K} from tracks where user_id=5 and timestamp_unix between 1704067300 and 1704068800 order by timestamp_unix,trip_id,point_index,event_id limit 1000"))
def src_14(spark: SparkSession, d: str) -> DataFrame:
    return source.time_range(source.tracks(spark, d), 5, 1704067300, 1704068800).select(*KEY)


@query("src_15", sql.query("tracks", f"select {K} from tracks where trip_id=501 union all select {K} from tracks where trip_id=502"))
def src_15(spark: SparkSession, d: str) -> DataFrame:
    t = source.tracks(spark, d)
    return source.by_trip(t, 501).unionByName(source.by_trip(t, 502)).select(*KEY)


@query("src_16", sql.query("tracks", "with o as (select user_id, count(*) n from tracks where trip_id%2=0 group by 1), n as (select user_id, -count(*) n from tracks where user_id%3=0 group by 1) select * from n union all select * from o where user_id not in (select user_id from n)"))
def src_16(spark: SparkSession, d: str) -> DataFrame:
    t = source.tracks(spark, d)
    old = t.filter("trip_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("n"))
    return tables.upsert(old, t.filter("user_id % 3 = 0").groupBy("user_id").agg((-F.count("*")).alias("n")), ["user_id"])


@query("prj_01_02", sql.query("norm", f"select {K}, round(speed,6) speed, activity, lat between -90 and 90 and lon between -180 and 180 valid_coordinates, coalesce(speed>=0,false) valid_speed from norm"))
def prj_01_02(spark: SparkSession, d: str) -> DataFrame:
    n = source.normalize(source.tracks(spark, d))
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return rounded(n.select(*KEY, "speed", "activity", valid.alias("valid_coordinates"), F.coalesce(F.col("speed") >= 0, F.lit(False)).alias("valid_speed")))


@query("prj_03_04", sql.query("conf", f"select {K}, round(timestamp_unix,3) timestamp_unix, round(lat,6) lat, round(lon,6) lon, round(speed,6) speed_ms, activity, confidence, confidence_level, has_issues has_quality_issues, cast(len(quality_flags) as integer) quality_issue_count from conf"))
def prj_03_04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seconds(plan.intelligence(plan.scored_tracks(spark, d))))


@query("flt_01", sql.query("conf", f"with u as (select *, count(*) over () total, cast(row_number() over (order by trip_id,timestamp_unix,point_index,event_id) as integer) nth from conf where user_id=7 and confidence>=0.5e0) select {K}, confidence, total, nth from u where nth between 6 and 25"))
def flt_01(spark: SparkSession, d: str) -> DataFrame:
    user = plan.scored(source.tracks(spark, d).filter("user_id = 7"))
    return plan.page(user, min_confidence=0.5, limit=20, offset=5).select(*KEY, "confidence", "total", "nth")


@query("cln_01", sql.query("dirty", f"select {K}, copy_no from (select *, row_number() over (partition by user_id,trip_id,timestamp_unix,lat,lon order by arrival_seq,copy_no,event_id) nth from dirty) where nth=1"))
def cln_01(spark: SparkSession, d: str) -> DataFrame:
    return clean.without_copies(source.dirty_tracks(spark, d)).select(*KEY, "copy_no")


@query("cln_01_arrival", sql.query("dirty", f"""with g as (select *, timestamp_unix-lag(timestamp_unix) over (partition by user_id,trip_id order by arrival_seq,copy_no,event_id) gap from dirty)
select {K}, copy_no, coalesce(gap<0,false) out_of_order, coalesce(abs(gap)<=0.001e0,false) same_time from g"""))  # fmt: skip
def cln_01_arrival(spark: SparkSession, d: str) -> DataFrame:
    return clean.arrival_flags(source.dirty_tracks(spark, d)).select(*KEY, "copy_no", "out_of_order", "same_time")


@query("cln_02_06", sql.query("flag", f"select {K}, array_to_string(quality_flags,',') quality_flags, is_valid from flag"))
def cln_02_06(spark: SparkSession, d: str) -> DataFrame:
    f = clean.quality_flags(features(source.normalize(source.tracks(spark, d))))
    return f.select(*KEY, F.array_join("quality_flags", ",").alias("quality_flags"), "is_valid")


FEATURES = ["time_delta", "update_rate", "distance", "bearing", "bearing_change", "calc_speed", "speed_diff", "acceleration", "stop_duration", "gap_duration"]


@query("fea_01_08", sql.query("feat", f"select {K}, {', '.join(f'round({c},5)+0e0 {c}' for c in FEATURES)}, has_gap, is_stop from feat"))
def fea_01_08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features(source.normalize(source.tracks(spark, d))).select(*KEY, *FEATURES, "has_gap", "is_stop"), 5)


SCORES = ["s_gps", "s_speed", "s_acceleration", "s_temporal", "s_activity", "s_continuity", "penalty"]


@query("con_01_09", sql.query("conf", f"select {K}, {', '.join(f'round({c},6) {c}' for c in SCORES)}, confidence, confidence_level from conf"))
def con_01_09(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plan.scored_tracks(spark, d).select(*KEY, *SCORES, "confidence", "confidence_level"))


CON_PARTS = [
    "case when coords_accuracy is null then 'no_gps_accuracy' when coords_accuracy>100 then 'very_poor_gps_accuracy' when coords_accuracy>50 then 'poor_gps_accuracy' when coords_accuracy>25 then 'moderate_gps_accuracy' end",
    "case when speed>100 then 'impossible_speed' when speed>80 then 'very_high_speed' end",
    f"case when speed>1.5e0*({sql.ACT_MAX}) then 'speed_activity_mismatch' end",
    "case when calc_speed>1 and abs(speed_diff)/calc_speed>0.5e0 then 'large_speed_discrepancy' end",
    "case when abs(acceleration)>15 then 'impossible_acceleration' when abs(acceleration)>10 then 'emergency_acceleration' end",
    "case when time_delta>30 then 'time_gap_'||cast(cast(floor(time_delta) as bigint) as varchar)||'s' when time_delta<0.5e0 then 'rapid_update' end",
    "case when activity='still' and is_moving=1 and coalesce(speed,0e0)>1 then 'still_but_moving' when activity='still' and coalesce(calc_speed,0e0)>2 then 'still_but_displaced' when activity in ('running','walking','in_vehicle') and is_moving<>1 and coalesce(speed,0e0)<0.5e0 and coalesce(calc_speed,0e0)<0.5e0 then 'active_but_stationary' end",
    "case when list_contains(quality_flags,'teleportation') then 'teleportation_detected' when list_contains(quality_flags,'gps_drift') then 'gps_drift_detected' end",
    "case when not list_contains(quality_flags,'teleportation') and abs(bearing_change)>150 and calc_speed>5 then 'sharp_direction_change' end",
]


@query("con_08", sql.query("conf", f"select {K},array_to_string(list_filter([{','.join(CON_PARTS)}], lambda x: x is not null),',') confidence_flags from conf"))
def con_08(spark: SparkSession, d: str) -> DataFrame:
    return plan.scored_tracks(spark, d).select(*KEY, F.array_join("confidence_flags", ",").alias("confidence_flags"))


@query("con_10", sql.query("conf", "select user_id,trip_id,round(avg(confidence),6) mean,round(median(confidence),6) median,min(confidence) \"min\",max(confidence) \"max\",round(stddev_pop(confidence),6) std,round(avg(case when confidence>=0.75e0 then 1e0 else 0e0 end),6) high_share,round(avg(case when confidence<0.5e0 then 1e0 else 0e0 end),6) low_share,count(*) n from conf group by 1,2"))
def con_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(confidence.trip_statistics(plan.scored_tracks(spark, d), ["user_id", "trip_id"]))


@query("trp_01", sql.query("conf", """
with a as (select user_id,trip_id,activity,count(*) n,min(rn) f from conf group by 1,2,3)
select c.user_id,c.trip_id,round(max(timestamp_unix)-min(timestamp_unix),6) duration,round(avg(update_rate),6) mean_update_rate,round(coalesce(sum(distance),0e0),3) total_distance,round(avg(speed),6) mean_speed,max(round(speed,6)) max_speed,
 count(*) filter (where is_stop) num_stops,round(coalesce(sum(stop_duration),0e0),6) total_stop_duration,round(coalesce(sum(case when is_stop and prev_stop then time_delta end),0e0),6) stop_time_seconds,
 count(*) filter (where has_gap) num_gaps,round(coalesce(sum(gap_duration),0e0),6) total_gap,max(p.primary_activity) primary_activity,count(*) n
from (select *, lag(is_stop) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id) prev_stop from conf) c
join (select user_id,trip_id,arg_max(activity,struct_pack(n:=n,f:=-f)) primary_activity from a group by 1,2) p using (user_id,trip_id) group by 1,2"""))  # fmt: skip
def trp_01(spark: SparkSession, d: str) -> DataFrame:
    t = trips.trip_features(plan.scored_tracks(spark, d))
    return rounded(t.withColumn("total_distance", F.round("total_distance", 3)))


@query("trp_01_activities", sql.query("conf", "select user_id,trip_id,activity,round(count(*)*1e0/sum(count(*)) over (partition by user_id,trip_id),6) share from conf group by 1,2,3"))
def trp_01_activities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trips.activity_shares(plan.scored_tracks(spark, d), ["user_id", "trip_id"]))


@query("trp_02", sql.query("conf", """
with a as (select user_id,trip_id,activity,count(*) n,min(rn) f from conf group by 1,2,3), p as (select user_id,trip_id,arg_max(activity,struct_pack(n:=n,f:=-f)) primary_activity from a group by 1,2)
select c.user_id,c.trip_id,round(min(timestamp_unix),3) start_time,round(max(timestamp_unix),3) end_time,round(max(timestamp_unix)-min(timestamp_unix),6) duration,round(coalesce(sum(distance),0e0),3) distance,
 round(arg_min(lat,rn),6) start_lat,round(arg_min(lon,rn),6) start_lon,round(arg_max(lat,rn),6) end_lat,round(arg_max(lon,rn),6) end_lon,count(*) points,count(*) filter (where is_valid) valid_points,round(avg(confidence),6) mean_confidence,max(primary_activity) primary_activity
from conf c join p using (user_id,trip_id) group by 1,2"""))  # fmt: skip
def trp_02(spark: SparkSession, d: str) -> DataFrame:
    t = trips.trip_summary(plan.scored_tracks(spark, d))
    return rounded(t.withColumns({c: F.round(c, 3) for c in ("distance", "start_time", "end_time")}))


REPORT = """count(*) total_points, count(*) filter (where is_valid) valid_points, count(*) filter (where has_issues) flagged_points, round(avg(confidence),9) mean_confidence, round(stddev_pop(confidence),9) std_confidence,
 min(confidence) min_confidence, max(confidence) max_confidence, count(*) filter (where confidence>=0.75e0) high_confidence, count(*) filter (where confidence>=0.5e0 and confidence<0.75e0) medium_confidence, count(*) filter (where confidence<0.5e0) low_confidence,
 round(count(*) filter (where is_valid)*1e0/count(*),9) validity_rate"""


@query("agg_01", sql.query("conf", f"select user_id,trip_id,{REPORT} from conf group by rollup(user_id,trip_id) having user_id is not null"))
def agg_01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.report(plan.scored_tracks(spark, d)), 9)


@query("agg_02", sql.query("conf", "select user_id, flag, count(*) n from (select user_id, unnest(quality_flags) flag from conf) group by 1,2"))
def agg_02(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_breakdown(plan.scored_tracks(spark, d))


@query("agg_03", sql.query("conf", "select user_id, count(*) filter (where confidence>=0.75e0) high_count, count(*) filter (where confidence>=0.5e0 and confidence<0.75e0) medium_count, count(*) filter (where confidence<0.5e0) low_count, round(count(*) filter (where confidence>=0.75e0)*1e0/count(*),4) high_share, round(count(*) filter (where confidence>=0.5e0 and confidence<0.75e0)*1e0/count(*),4) medium_share, round(count(*) filter (where confidence<0.5e0)*1e0/count(*),4) low_share from conf group by 1"))
def agg_03(spark: SparkSession, d: str) -> DataFrame:
    return quality.confidence_distribution(plan.scored_tracks(spark, d))


@query("agg_04", sql.query("conf", "select user_id, count(distinct trip_id) trips, count(*) events, floor((200*sum(cast(round(confidence*10000) as bigint))+count(*))/(2e0*count(*)))/1e6 mean_confidence, count(distinct trip_id) filter (where confidence>=0.5e0)>=5 and count(*) filter (where confidence>=0.5e0)>=50 is_mature from conf group by 1"))
def agg_04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.user_summary(plan.scored_tracks(spark, d), mature_trips=5, mature_points=50))
