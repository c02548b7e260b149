"""Queries: profiles, predictions, safety, operations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import anomaly, baseline, learning, models, ops, predict, profile, risk, safety, spoofing
from wayfold.plans import sessions
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import analysis, risks, sql
from wayfold.queries.registry import query, rounded
from wayfold.sources.staging import shared_dir, staged

READ = "select * from {0}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- profiles

sql.define("hours24", ["conf"], """with k as (select *, cast(floor(timestamp_unix/3600)%24 as integer) hr from conf where confidence>=0.5e0), n as (select user_id,hr,count(*) n,avg(speed) ms from k group by 1,2),
 a as (select user_id,hr,activity,count(*) c,min(struct_pack(t:=timestamp_unix,e:=event_id)) f from k group by 1,2,3), t as (select user_id,hr,arg_min(activity,struct_pack(c:=-c,f:=f)) activity from a group by 1,2),
 g as (select user_id,total,cast(i as integer) hr from (select user_id,count(*) total from k group by 1) cross join range(0,24) r(i))
select user_id,hr "hour",coalesce(n,0)*1e0/total probability,coalesce(activity,'unknown') activity,coalesce(ms,0e0) mean_speed,coalesce(n,0) n from g left join n using (user_id,hr) left join t using (user_id,hr)""")  # fmt: skip


@query("pro_04", sql.query("hours24", 'select user_id,"hour",round(probability,6) probability,activity,round(mean_speed+1e-9,5) mean_speed,n from hours24'))
def pro_04(spark: SparkSession, d: str) -> DataFrame:
    h = profile.hours(scored_tracks(spark, d))
    return h.withColumns({"probability": F.round("probability", 6), "mean_speed": F.round(F.col("mean_speed") + 1e-9, 5)})


W = "partition by user_id order by trip_id,timestamp_unix,point_index,event_id"
sql.define("stops0", ["conf"], f"""with b as (select *, case when is_stop is distinct from lag(is_stop) over ({W}) then 1 else 0 end chg from conf), r as (select *, sum(chg) over ({W} rows unbounded preceding) run from b), l as (select *, max(run) over (partition by user_id) last from r)
select user_id,min(timestamp_unix) arrival,max(timestamp_unix) departure,avg(lat) lat,avg(lon) lon,count(*) points from l where run<last and is_stop group by user_id,run having max(timestamp_unix)-min(timestamp_unix)>=60""")  # fmt: skip


@query("pro_05", sql.query("stops0", "select user_id,round(arrival,3) arrival,round(departure-arrival,3) duration,round(lat,6) lat,round(lon,6) lon,points,cast(floor(arrival/3600)%24 as integer) arrival_hour,cast(floor(departure/3600)%24 as integer) departure_hour from stops0"))
def pro_05(spark: SparkSession, d: str) -> DataFrame:
    s = profile.stop_episodes(scored_tracks(spark, d))
    return s.select("user_id", F.round("arrival", 3).alias("arrival"), F.round("duration", 3).alias("duration"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "points", "arrival_hour", "departure_hour")


@query("pro_01", sql.query("conf", "select user_id,trip_id,round(max(timestamp_unix)-min(timestamp_unix),3) duration,round(coalesce(sum(distance),0e0),3) distance,round(avg(speed)+1e-9,5) mean_speed,round(arg_min(lat,rn),6) start_lat,round(arg_max(lon,rn),6) end_lon,cast(floor(min(timestamp_unix)/3600)%24 as integer) start_hour from conf group by 1,2 having count(*)>=2"))
def pro_01(spark: SparkSession, d: str) -> DataFrame:
    s = profile.trip_signatures(scored_tracks(spark, d))
    return s.select("user_id", "trip_id", *[F.round(c, 3).alias(c) for c in ("duration", "distance")], F.round(F.col("mean_speed") + 1e-9, 5).alias("mean_speed"), *[F.round(c, 6).alias(c) for c in ("start_lat", "end_lon")], "start_hour")


@query("pro_02_03")
def pro_02_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.routes(profile.trip_signatures(scored_tracks(spark, d))))


@query("pro_06")
def pro_06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.stops(profile.stop_episodes(scored_tracks(spark, d))))


@query("pro_07_08", sql.query("metrics", """with s as (select user_id,avg(speed) m,stddev_pop(speed) sd,count(speed) n,avg(case when time_delta<>0 then time_delta end) tm,stddev_pop(case when time_delta<>0 then time_delta end) ts,count(case when time_delta<>0 then 1 end) tn from conf group by 1),
 j as (select s.*, b.mean bm,b.std bs,coalesce(b.sample_size,0) bn,case when s.m>0 then s.sd/s.m end cv,case when b.mean>0 then b.std/b.mean else 1e0 end bcv from s left join metrics b on b.user_id=s.user_id and b.metric='speed')
select user_id,round(case when bn=0 or n=0 then 0.5e0 when bs=0 then case when sd<1 then 1e0 else 0.5e0 end when m=0 then 0.5e0 when greatest(cv,bcv)=0 then 1e0 else least(cv,bcv)/greatest(cv,bcv) end,5) speed_consistency,
 round(case when tn<2 or tm=0 then 0.5e0 else least(1e0,1/(1+ts/tm)) end,5) update_regularity from j"""))  # fmt: skip
def pro_07_08(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(profile.speed_consistency(p, baseline.wide(p)).join(profile.update_regularity(p), "user_id"), 5)


def tour_zones(s: DataFrame) -> DataFrame:
    """A zone around the ends of each user's first trip of signatures, for queries that need routes both engines know."""
    first = s.groupBy("user_id").agg(F.min_by(F.struct(*[c for c in s.columns if c != "user_id"]), "trip_id").alias("t")).select("user_id", "t.*")
    return first.withColumns({"start_radius": F.lit(1500.0), "end_radius": F.lit(1500.0), "frequency": F.lit(4), "route_id": F.concat(F.lit("r"), F.col("user_id"))})


sql.define("tsig", ["conf"], "select user_id,trip_id,max(timestamp_unix)-min(timestamp_unix) duration,arg_min(lat,rn) start_lat,arg_min(lon,rn) start_lon,arg_max(lat,rn) end_lat,arg_max(lon,rn) end_lon from conf group by 1,2 having count(*)>=2")
sql.define("tz", ["tsig"], "select user_id,min(trip_id) z_trip,arg_min(start_lat,trip_id) zslat,arg_min(start_lon,trip_id) zslon,arg_min(end_lat,trip_id) zelat,arg_min(end_lon,trip_id) zelon,arg_min(duration,trip_id) zdur from tsig group by 1")


@query("pro_09", sql.query("tz", f"""with h as (select t.user_id,count(*) hits from tsig t join tz z using (user_id) where {sql.hav("start_lat", "start_lon", "zslat", "zslon")}<=1500 and {sql.hav("end_lat", "end_lon", "zelat", "zelon")}<=1500 group by 1),
 n as (select user_id,count(distinct trip_id) trips from conf group by 1) select user_id,round(coalesce(hits,0)*1e0/trips,6) route_adherence from n left join h using (user_id)"""))  # fmt: skip
def pro_09(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    sig = profile.trip_signatures(p)
    return rounded(profile.route_adherence(sig, p, tour_zones(sig)))


@query("pro_10", sql.query("head", "select user_id,round(0.3e0*least(1e0,trips/20e0)+0.3e0*least(1e0,points/1000e0)+0.4e0*(case when trips>=5 and points>=50 then 1e0 else 0.5e0 end),6) profile_confidence from head"))
def pro_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.profile_confidence(baseline.header(scored_tracks(spark, d), mature_trips=5, mature_points=50)))


@query("pro_09_learned")
def pro_09_learned(spark: SparkSession, d: str) -> DataFrame:
    """Adherence to the routes that the trips themselves make up."""
    p = staged(scored_tracks(spark, d), "points")
    sig = staged(profile.trip_signatures(p), "signatures")
    return rounded(profile.route_adherence(sig, p, profile.routes(sig)))


@query("pro_11_update")
def pro_11_update(spark: SparkSession, d: str) -> DataFrame:
    """Routes of one half of the trips, brought up to date with the other half."""
    sig = staged(profile.trip_signatures(scored_tracks(spark, d)), "signatures")
    known, since = (sig.filter(f"pmod(trip_id, 2) = {i}") for i in (0, 1))
    return rounded(profile.update_routes(staged(profile.routes(known), "routes"), since))


@query("pro_11_12")
def pro_11_12(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    old, new = (profile.routes(profile.trip_signatures(p.filter(f"pmod(trip_id, 2) = {i}"))) for i in (0, 1))
    return rounded(profile.merge(old, new, "route_id"))


# --- delay


def requests(s: DataFrame) -> DataFrame:
    return s.select(F.col("trip_id").alias("request_id"), "user_id", F.col("start_lat").alias("o_lat"), F.col("start_lon").alias("o_lon"), F.col("end_lat").alias("d_lat"), F.col("end_lon").alias("d_lon"), F.col("start").alias("departure"),
                    (F.pmod("trip_id", F.lit(10)) / 10.0).alias("weather_impact"), F.when(F.col("trip_id") % 4 > 0, 1 + F.pmod("trip_id", F.lit(7)) / 10.0).alias("traffic_factor"))


sql.define("dly", ["tz"], f"""with q as (select t.*, (trip_id%10)/10e0 w, case when trip_id%4>0 then 1+(trip_id%7)/10e0 end tf, s0.start from tsig t join (select user_id,trip_id,min(timestamp_unix) start from conf group by 1,2) s0 using (user_id,trip_id)),
 m as (select q.*, {sql.hav("start_lat", "start_lon", "zslat", "zslon")} d1, {sql.hav("end_lat", "end_lon", "zelat", "zelon")} d2, {sql.hav("start_lat", "start_lon", "end_lat", "end_lon")} dist, zdur from q left join tz using (user_id)),
 r as (select *, case when d1<=1500 and d2<=1500 then 0.6e0*0.4e0+0.4e0*(1-(d1+d2)/3001) else 0e0 end rc, case when d1<=1500 and d2<=1500 then zdur else 0e0 end hist, cast(floor(start/3600)%24 as integer) hr, cast((floor(start/86400)+3)%7 as integer) wd,
  greatest(1e0,coalesce(tf,1e0)*(1+0.3e0*w)) f, 0.5e0+case when tf is not null then 0.5e0 else 0e0 end cc from m),
 b as (select *, case when hist>0 then hist else dist/(50e0/3.6e0) end base from r)
select trip_id request_id,user_id,rc route_confidence,dist distance_m,hist hist_duration,hr,wd weekday,hr in (7,8,9,17,18,19) is_rush,f delay_factor,greatest(0e0,base*(f-1)/60)*(1+0.3e0*w) delay_minutes,0.8e0*cc delay_confidence,base*w*0.3e0/60 weather_minutes,base*(coalesce(tf,1e0)-1)/60 traffic_minutes,
 base/60+greatest(0e0,base*(f-1)/60)*(1+0.3e0*w) expected_minutes from b""")  # fmt: skip
DLY = ["route_confidence", "distance_m", "hist_duration", "delay_factor", "delay_minutes", "delay_confidence", "weather_minutes", "traffic_minutes", "expected_minutes"]


@query("dly_01_05", sql.query("dly", f'select request_id,user_id,hr "hour",weekday,is_rush,{",".join(f"round({c},4)+0e0 {c}" for c in DLY)} from dly'))
def dly_01_05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(delays(signatures(scored_tracks(spark, d))).select("request_id", "user_id", "hour", "weekday", "is_rush", *DLY), 4)


def signatures(p: DataFrame) -> DataFrame:
    """A row per trip, computed once: requests, zones and learned routes all come from there, not from the points again."""
    return staged(profile.trip_signatures(p), "signatures")


def delays(sig: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    r = predict.delay_features(predict.match_routes(requests(sig), tour_zones(sig) if routes is None else routes))
    return predict.heuristic_delay(r.withColumns(predict.fuse(F.col("weather_impact"), F.col("traffic_factor"))))


@query("dly_01_learned")
def dly_01_learned(spark: SparkSession, d: str) -> DataFrame:
    """Delays by the best of the learned routes that a request lies on."""
    sig = signatures(scored_tracks(spark, d))
    late = delays(sig, staged(profile.routes(sig), "routes"))
    return rounded(late.select("request_id", "user_id", "route_id", "hour", "weekday", "is_rush", *DLY), 4)


@query("dly_04_mlt_01")
def dly_04_mlt_01(spark: SparkSession, d: str) -> DataFrame:
    return learning.evaluate_delay(delays(signatures(scored_tracks(spark, d))))


# --- threat, from orders as risk history


def order_risks(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    o = table(spark, d, "orders")
    user = F.col(by) if by else F.col("o_custkey") % 50
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return o.select(user.cast("bigint").alias("user_id"), (days * 86400.0 + F.col("o_orderkey") % 86400).alias("at"), F.least(F.lit(1.0), F.col("o_totalprice").cast("double") / 400000).alias("risk"))


sql.define("orisk", [], "select cast(o_custkey%50 as bigint) user_id, (cast(o_orderdate as date)-date '1970-01-01')*86400e0+o_orderkey%86400 as taken_at, least(1e0,cast(o_totalprice as double)/400000) risk from orders")
NOW = 870000000.0


@query("thr_01", sql.query("orisk", f"""select user_id,round(coalesce(avg(r),0e0),6) avg_risk,round(coalesce(max(r),0e0),6) max_risk,round(coalesce(min(r),0e0),6) min_risk,round(coalesce(stddev_pop(r),0e0),6) std_risk,round(coalesce(avg(case when r>0.7e0 then 1e0 when r is not null then 0e0 end),0e0),6) high_share,count(r) n_risks
 from (select *, case when taken_at>{NOW}-3024000 and taken_at<={NOW} then risk end r from orisk) group by 1"""))  # fmt: skip
def thr_01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.risk_history(order_risks(spark, d), NOW, days=35))


@query("thr_02", sql.query("ano asig", "select user_id,round(avg(case when is_anomalous then 1e0 else 0e0 end),6) anomaly_rate,round(avg(anomaly_score),5) mean_anomaly,count(*) n_points,max(coalesce(k,0)) kinds from ano left join (select user_id,count(distinct kind) k from asig group by 1) using (user_id) group by 1"))
def thr_02(spark: SparkSession, d: str) -> DataFrame:
    a = analysis.detected(spark, d)
    h = predict.anomaly_history(a, anomaly.signals(a))
    return h.withColumns({"anomaly_rate": F.round("anomaly_rate", 6), "mean_anomaly": F.round("mean_anomaly", 5)})


@query("thr_03", sql.query("ses", "select user_id,round(avg(spoofing),5) mean_spoof,round(max(spoofing),5) max_spoof,cast(sum(n_signals) as bigint) signals,round(avg(tampering),5) mean_tamper from ses group by 1"))
def thr_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.spoof_history(spoofing.sessions(scored_tracks(spark, d))), 5)


sql.define("trend", ["orisk"], """with p as (select *, row_number() over (partition by user_id order by taken_at,risk)-1 x from orisk), s as (select user_id,case when count(*)>=3 then coalesce(regr_slope(risk,x),0e0) else 0e0 end slope,count(*) n from p group by 1)
select user_id,slope,least(1e0,abs(slope)*n) strength,case when slope>0.02e0 then 'rising' when slope<-0.02e0 then 'falling' else 'stable' end trend from s""")  # fmt: skip


@query("thr_04", sql.query("trend", "select user_id,round(slope,8)+0e0 slope,round(strength,6) strength,trend from trend"))
def thr_04(spark: SparkSession, d: str) -> DataFrame:
    t = predict.trend(order_risks(spark, d))
    return t.select("user_id", (F.round("slope", 8) + F.lit(0.0)).alias("slope"), F.round("strength", 6).alias("strength"), "trend")


def threats(spark: SparkSession, d: str, p: DataFrame | None = None, drifting: DataFrame | None = None) -> DataFrame:
    """Threats from the points' anomalies and spoofing, the orders' risks, and users' drift (has_drift; a stand-in without)."""
    p = sessions.prepared(analysis.given_isolation(scored_tracks(spark, d))) if p is None else p
    a = staged(sessions.detected(p), "anomalies")
    h = predict.risk_history(order_risks(spark, d), NOW, days=35).join(predict.trend(order_risks(spark, d)), "user_id")
    h = h.join(predict.anomaly_history(a, anomaly.signals(a)), "user_id").join(predict.spoof_history(spoofing.sessions(p)), "user_id")
    if drifting is None:
        return predict.threat(h.withColumn("has_drift", F.col("user_id") % 3 == 0))
    return predict.threat(h.join(drifting, "user_id", "left").fillna({"has_drift": False}))


sql.define("thr", ["ano", "ses", "trend"], f"""with h as (select user_id,coalesce(avg(r),0e0) a,coalesce(max(r),0e0) m,coalesce(avg(case when r>0.7e0 then 1e0 when r is not null then 0e0 end),0e0) hs,count(r) n from (select *, case when taken_at>{NOW}-3024000 and taken_at<={NOW} then risk end r from orisk) group by 1),
 an as (select user_id,avg(case when is_anomalous then 1e0 else 0e0 end) ar,avg(anomaly_score) am from ano group by 1), sp as (select user_id,max(spoofing) ms from ses group by 1)
select user_id,n,least(1e0,greatest(0e0,0.35e0*(0.5e0*a+0.3e0*m+0.2e0*hs)+0.25e0*(0.6e0*ar+0.4e0*am)+0.2e0*ms+0.1e0*(case when user_id%3=0 then 0.5e0 else 0e0 end)+0.1e0*(case trend when 'rising' then 0.3e0+0.4e0*strength when 'falling' then -0.1e0 else 0e0 end))) threat from h join an using (user_id) join sp using (user_id) join trend using (user_id)""")  # fmt: skip


LEVEL = "case when threat<0.1e0 then 'minimal' when threat<0.25e0 then 'low' when threat<0.45e0 then 'moderate' when threat<0.65e0 then 'elevated' when threat<0.85e0 then 'high' else 'critical' end"
ADVICE = "case when threat<0.4e0 then 'none' when threat<0.7e0 then 'watch' else 'act' end"


@query("thr_05_06", sql.query("thr", f"select user_id,round(threat,5) threat,round(least(0.9e0,0.3e0+0.6e0*n/100),6) threat_confidence,{LEVEL} threat_level,case when threat<0.2e0 then 'calm' when threat<0.5e0 then 'watchful' else 'tense' end outlook,{ADVICE} advice from thr"))
def thr_05_06(spark: SparkSession, d: str) -> DataFrame:
    t = threats(spark, d)
    return t.select("user_id", F.round("threat", 5).alias("threat"), F.round("threat_confidence", 6).alias("threat_confidence"), "threat_level", "outlook", "advice")


def outlook(spark: SparkSession, d: str, p: DataFrame, sig: DataFrame, routes: DataFrame | None = None, drifting: DataFrame | None = None) -> DataFrame:
    """A user's threat, worst delay and what follows from both; sig: signatures of the points."""
    late = delays(sig, routes).groupBy("user_id").agg(F.max("delay_minutes").alias("delay_minutes"))
    out = threats(spark, d, p, drifting).join(late, "user_id", "left")
    return rounded(out.select("user_id", "threat", "threat_level", "delay_minutes", F.when(F.col("delay_minutes") > 15, "expect_delay").otherwise(F.col("advice")).alias("recommendation")), 5)


@query("p3_01", sql.query("thr dly", f"with l as (select user_id,max(delay_minutes) delay_minutes from dly group by 1) select user_id,round(threat,5) threat,{LEVEL} threat_level,round(delay_minutes,5)+0e0 delay_minutes,case when delay_minutes>15 then 'expect_delay' else {ADVICE} end recommendation from thr left join l using (user_id)"))
def p3_01(spark: SparkSession, d: str) -> DataFrame:
    p = sessions.prepared(analysis.given_isolation(scored_tracks(spark, d)))
    return outlook(spark, d, p, signatures(p))


@query("p3_01_learned")
def p3_01_learned(spark: SparkSession, d: str) -> DataFrame:
    """The same from learned routes and from the drift of the users' snapshots."""
    p = sessions.prepared(analysis.given_isolation(scored_tracks(spark, d)))
    pairs = drift_pairs(spark, d)
    signals = predict.drift_signals(pairs)
    concern = predict.drift_concern(predict.drift_scores(signals, pairs), signals)
    sig = signatures(p)
    return outlook(spark, d, p, sig, staged(profile.routes(sig), "routes"), concern.select("user_id", (F.col("concern") != "none").alias("has_drift")))


# --- drift, from snapshots of orders per customer and quarter

SNAP = """select cast(o_custkey%50 as bigint) user_id, cast(extract(year from cast(o_orderdate as date))*4+extract(quarter from cast(o_orderdate as date)) as integer) q, count(*) n, avg(cast(o_totalprice as double))/10000 m, stddev_pop(cast(o_totalprice as double))/10000 s from orders group by 1,2"""
sql.define("snap", [], f"""with b as ({SNAP}) select user_id, q*91.25e0*86400 as taken_at, m speed_mean, s speed_std, 1/(1+s) update_regularity, (n%7)/7e0 route_adherence, n stop_count, list_transform(range(0,24), lambda i: case when (i*n)%24<n then 1e0 else 0e0 end) as hrs from b""")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("bigint").alias("user_id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice").cast("double")).alias("v"))
    b = o.groupBy("user_id", (F.year("day") * 4 + F.quarter("day")).alias("q")).agg(F.count("*").alias("n"), (F.avg("v") / 10000).alias("m"), (F.stddev_pop("v") / 10000).alias("s"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(F.pmod(i * F.col("n"), F.lit(24)) < F.col("n"), 1.0).otherwise(0.0))
    return b.select("user_id", (F.col("q") * 91.25 * 86400).alias("at"), F.col("m").alias("speed_mean"), F.col("s").alias("speed_std"), (1 / (1 + F.col("s"))).alias("update_regularity"), ((F.col("n") % 7) / 7.0).alias("route_adherence"), F.col("n").alias("stop_count"), hours.alias("hours"))


def drift_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = predict.recent_snapshots(snapshots(spark, d))
    new = s.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in s.columns if c != "user_id"]), "at").alias("new"))
    times = new.select("user_id", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("window"), F.col("new.at").alias("last")).withColumn("t", F.col("last") - F.col("window") * 86400 * 4.0)
    return predict.as_of(s, times).filter("snapshot is not null").select("user_id", "window", F.col("snapshot").alias("old")).join(new, "user_id")


@query("jol_04_as_of", sql.query("snap", """with n as (select user_id,max(taken_at) last from snap group by 1), t as (select user_id,w as win,last-w*86400*4e0 t from n cross join (values (7),(30),(90)) v(w))
select t.user_id,t.win "window",s.taken_at,s.stop_count from t asof join snap s on t.user_id=s.user_id and t.t>=s.taken_at"""))  # fmt: skip
def jol_04_as_of(spark: SparkSession, d: str) -> DataFrame:
    return drift_pairs(spark, d).select("user_id", "window", F.col("old.at").alias("taken_at"), "old.stop_count")


BOUNDED = "case when greatest(abs({0}),abs({1}))=0 then 0e0 else least(1e0,abs({1}-{0})/greatest(abs({0}),abs({1}))) end"
KL = "list_sum(list_transform(range(1,25), lambda i: ({0}[i]+1e-10)*ln(({0}[i]+1e-10)/(({0}[i]+{1}[i])/2+1e-10))))"
SHARES = "list_transform({0}, lambda v: (v+1e-10)/list_sum(list_transform({0}, lambda u: u+1e-10)))"


@query("drf_01_07", sql.query("snap", f"""with n as (select user_id,max(taken_at) last from snap group by 1), t as (select user_id,last,w,last-w*86400*4e0 t from n cross join (values (7),(30),(90)) v(w)), o as (select t.user_id,t.w,t.last,s.* exclude (user_id) from t asof join snap s on t.user_id=s.user_id and t.t>=s.taken_at),
 h as (select o.*,c.speed_mean c_mean,c.speed_std c_std,c.update_regularity c_reg,c.route_adherence c_adh,c.stop_count c_stop,{SHARES.format("o.hrs")} p,{SHARES.format("c.hrs")} q from o join snap c on c.user_id=o.user_id and c.taken_at=o.last),
 x as (select user_id,w,0.7e0*{BOUNDED.format("speed_mean", "c_mean")}+0.3e0*{BOUNDED.format("speed_std", "c_std")} speed,abs(c_adh-route_adherence) adh,abs(c_reg-update_regularity) reg,sqrt(greatest(0e0,({KL.format("p", "q")}+{KL.format("q", "p")})/2)) tim,
  case when stop_count=0 then case when c_stop=0 then 0e0 else 1e0 end else abs(c_stop-stop_count)*1e0/abs(stop_count) end stops from h),
 s as (select user_id,w,'speed' kind,least(1e0,speed) severity from x where speed>=0.15e0 union all select user_id,w,'route',least(1e0,2*adh) from x where adh>=0.15e0 union all select user_id,w,'timing',least(1e0,2*tim) from x where tim>=0.15e0
  union all select user_id,w,'stops',least(1e0,stops) from x where stops>=0.3e0 union all select user_id,w,'regularity',least(1e0,2*reg) from x where reg>=0.15e0),
 g as (select u.user_id,v.w,coalesce(sum(severity),0e0) s,count(severity) n from (select distinct user_id from x) u cross join (values (7),(30),(90)) v(w) left join s on s.user_id=u.user_id and s.w=v.w group by 1,2),
 c as (select user_id,w,case when sum(n) over k>0 then sum(s) over k/sum(n) over k else 0e0 end score from g window k as (partition by user_id order by w rows unbounded preceding)),
 m as (select user_id,max(score) filter (where w=7) w7,max(score) filter (where w=30) w30,max(score) filter (where w=90) w90 from c group by 1), d as (select *,0.5e0*w7+0.3e0*w30+0.2e0*w90 drift from m),
 b as (select user_id,max(severity) filter (where kind in ('route','timing')) place from s group by 1)
select user_id,round(w7,5) w7,round(w30,5) w30,round(w90,5) w90,round(drift,5) drift,case when drift<0.15e0 then 'none' when drift<0.3e0 then 'low' when drift<0.5e0 then case when coalesce(place,0e0)>0.4e0 or w7>2*w90 then 'moderate' else 'low' end
 when drift<0.7e0 then case when coalesce(place,0e0)>0.4e0 or w7>2*w90 then 'high' else 'moderate' end else 'critical' end concern from d left join b using (user_id)"""))  # fmt: skip
def drf_01_07(spark: SparkSession, d: str) -> DataFrame:
    pairs = drift_pairs(spark, d)
    s = predict.drift_signals(pairs)
    return rounded(predict.drift_concern(predict.drift_scores(s, pairs), s), 5)


@query("drf_02", sql.query("snap", """with p as (select *, lag(speed_mean) over w pm, lag(stop_count) over w pc from snap window w as (partition by user_id order by taken_at))
select user_id,taken_at,round(case when greatest(abs(pm),abs(speed_mean))=0 then 0e0 else least(1e0,abs(speed_mean-pm)/greatest(abs(pm),abs(speed_mean))) end,6) bounded,round(case when pc=0 then case when stop_count=0 then 0e0 else 1e0 end else abs(stop_count-pc)*1e0/abs(pc) end,6) relative from p where pm is not null"""))  # fmt: skip
def drf_02(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("at")
    p = snapshots(spark, d).withColumns({"pm": F.lag("speed_mean").over(w), "pc": F.lag("stop_count").over(w)}).filter("pm is not null")
    return rounded(p.select("user_id", F.col("at").alias("taken_at"), predict.bounded_change(F.col("pm"), F.col("speed_mean")).alias("bounded"), predict.relative_change(F.col("pc").cast("double"), F.col("stop_count").cast("double")).alias("relative")))


@query("drf_03", sql.query("snap", """with v as (select user_id,taken_at,speed_mean x,row_number() over (partition by user_id order by taken_at)-1 i,count(*) over (partition by user_id) n from snap), t as (select *, avg(case when i<floor(n/2) then x end) over (partition by user_id) tg from v),
 s as (select *, sum(case when i>0 then x-tg-0.5e0 else 0e0 end) over w su,sum(case when i>0 then tg-x-0.5e0 else 0e0 end) over w sd from t window w as (partition by user_id order by taken_at rows unbounded preceding)),
 c as (select *, su-least(0e0,min(su) over w) cu,sd-least(0e0,min(sd) over w) cd from s window w as (partition by user_id order by taken_at rows unbounded preceding)),
 m as (select user_id,max(cu) u,max(cd) d,arg_min(i,struct_pack(c:=-round(cu,9),i:=i)) iu,arg_min(i,struct_pack(c:=-round(cd,9),i:=i)) id from c group by 1)
select user_id,cast(case when u>=d then iu else id end as integer) change_at,round(greatest(u,d),6) largest,greatest(u,d)>5 detected from m"""))  # fmt: skip
def drf_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.cusum(snapshots(spark, d), "user_id", "at", "speed_mean"))


# --- safety, from lineitem as accelerometer batches and customer as battery reports


def readings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("detection_id"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_quantity").cast("double").alias("q"), F.col("l_partkey").cast("bigint").alias("p"))
    from pyspark.sql.window import Window

    q = F.col("q")
    li = li.withColumn("seq", F.row_number().over(Window.partitionBy("detection_id").orderBy("seq", "p", "q")))
    z = F.when(F.col("p") % 11 == 0, q * 3).when(F.col("p") % 5 == 0, 0.5).otherwise(9.81)
    return li.select("detection_id", "seq", (F.col("p") % 3 / 10.0).alias("x"), (F.col("p") % 7 / 10.0).alias("y"), z.alias("z"), (F.col("seq") * 0.1).alias("at"), (F.col("detection_id") % 60).cast("double").alias("speed_kmh"), (F.col("detection_id") % 90).cast("int").alias("user_age"))


sql.define("acc0", [], """select cast(l_orderkey as bigint) detection_id,seq,seq*0.1e0 as taken_at,cast(l_orderkey%60 as double) speed_kmh,cast(l_orderkey%90 as integer) user_age,
 sqrt(pow((l_partkey%3)/10e0,2)+pow((l_partkey%7)/10e0,2)+pow(case when l_partkey%11=0 then cast(l_quantity as double)*3 when l_partkey%5=0 then 0.5e0 else 9.81e0 end,2))/9.81e0 g from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,cast(l_quantity as double)) as integer) seq from lineitem)""")


@query("saf_01", sql.query("acc0", """with r as (select *, abs(g-lag(g) over (partition by detection_id order by seq)) dg from acc0), p as (select detection_id,max(g) peak,arg_min(seq,struct_pack(g:=-g,s:=seq)) ps,max(dg) mc,max(speed_kmh) sp,min(case when g>=4 then taken_at end) a,max(case when g>=4 then taken_at end) b,count(*) filter (where g>=4) hits from r group by 1),
 f as (select r.detection_id,avg(g) af from r join p using (detection_id) where seq>ps group by 1), j as (select p.*, coalesce(abs(af-1)>0.3e0,true) mv, peak>=4 and not coalesce(sp<10 and peak<8,false) crash from p left join f using (detection_id)),
 s as (select *, case when not crash then 'none' when peak<8 then 'minor' when peak<15 then 'moderate' when peak<25 then 'severe' else 'critical' end severity from j)
select detection_id,round(peak,6) peak,crash is_crash,severity,mv moving_after,round(case when hits>=2 then (b-a)*1000 else 0e0 end,4) impact_ms,round(case when crash then least(1e0,0.5e0+(peak-4)/20+case when sp>30 then 0.15e0 else 0e0 end+case when mc>5 then 0.1e0 else 0e0 end+case when not mv then 0.1e0 else 0e0 end) else 0e0 end,6) crash_confidence,severity in ('moderate','severe','critical') alert from s"""))  # fmt: skip
def saf_01(spark: SparkSession, d: str) -> DataFrame:
    c = safety.crashes(readings(spark, d))
    return rounded(c.withColumn("impact_ms", F.round("impact_ms", 4)))


@query("saf_02", sql.query("acc0", """with h as (select a.detection_id,a.seq,min(b.seq) hs from acc0 a join acc0 b on b.detection_id=a.detection_id and b.seq>a.seq and b.seq<=a.seq+4 and b.g>=3 where a.g<0.4e0 group by 1,2),
 i as (select h.detection_id,arg_min(h.hs,struct_pack(g:=-b.g,s:=h.seq)) hit_seq,max(b.g) impact from h join acc0 b on b.detection_id=h.detection_id and b.seq=h.hs group by 1),
 f as (select detection_id,min(case when g<0.4e0 then taken_at end) a,max(case when g<0.4e0 then taken_at end) b,max(user_age) age from acc0 group by 1),
 l as (select i.detection_id,avg(g) af,max(taken_at) e,min(taken_at) s from i join acc0 using (detection_id) where seq>hit_seq group by 1),
 j as (select f.*, impact,coalesce(abs(af-1)<0.3e0,false) still,case when coalesce(abs(af-1)<0.3e0,false) then e-s else 0e0 end secs,coalesce(age>65,false) old from f left join i using (detection_id) left join l using (detection_id)),
 k as (select *, case when impact is null then 'none' when impact>=10 and still then 'critical' when impact>=8 or secs>10 then 'severe' when impact>=5 then 'moderate' else 'minor' end base from j)
select detection_id,impact is not null is_fall,round(coalesce(impact,0e0),6) impact,round(coalesce(b-a,0e0),6) free_fall_seconds,still stationary_after,case when old and base='minor' then 'moderate' when old and base='moderate' then 'severe' else base end severity,
 round(case when impact is not null then least(1e0,0.5e0+case when impact>=5 then 0.2e0 else 0e0 end+case when still then 0.2e0 else 0e0 end+case when old then 0.1e0 else 0e0 end) else 0e0 end,6) fall_confidence from k"""))  # fmt: skip
def saf_02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(safety.falls(readings(spark, d)))


@query("saf_03", """with b as (select cast(c_custkey as bigint) user_id,cast((c_custkey*7)%101 as integer) battery_level,c_custkey%5=0 is_charging,abs(cast(c_acctbal as double))/500 drain,20e0+c_custkey%30 temp from customer)
select user_id,battery_level,case when is_charging then 'charging' when battery_level<=10 then 'critical' when battery_level<=20 then 'low' else 'healthy' end status,case when drain>0 and not is_charging then round(battery_level/drain+1e-9,1) end hours_left,not is_charging and battery_level<=20 alert,temp>45 hot from b""")  # fmt: skip
def saf_03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    b = table(spark, d, "customer").select(k.cast("bigint").alias("user_id"), ((k * 7) % 101).cast("int").alias("battery_level"), (k % 5 == 0).alias("is_charging"), (F.abs(F.col("c_acctbal").cast("double")) / 500).alias("drain_rate_per_hour"), (20.0 + k % 30).alias("battery_temperature"))
    return safety.batteries(b).select("user_id", "battery_level", "status", "hours_left", "alert", "hot")


# --- operations


def call_log(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return o.select(F.col("o_orderkey").cast("bigint").alias("call_id"), F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("model"), F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("api"), (days * 86400 + F.col("o_orderkey") % 86400).cast("bigint").alias("at"), (F.col("o_totalprice").cast("double") / 1000).alias("time_ms"), (F.col("o_totalprice").cast("double") / 1000).alias("latency_ms"), (F.col("o_orderkey") % 13 != 0).alias("success"))


sql.define("calls", [], "select cast(o_orderkey as bigint) call_id,'m'||(o_custkey%4) model,cast((cast(o_orderdate as date)-date '1970-01-01')*86400+o_orderkey%86400 as bigint) as taken_at,cast(o_totalprice as double)/1000 ms,o_orderkey%13<>0 success from orders")


@query("ops_01", sql.query("calls", """with r as (select *, row_number() over (partition by model order by taken_at desc,call_id desc) n from calls)
select model,count(*) calls,round(avg(ms)+1e-9,6) mean_ms,round(quantile_cont(ms,0.5)+1e-9,6) p50_ms,round(quantile_cont(ms,0.95)+1e-9,6) p95_ms,round(quantile_cont(ms,0.99)+1e-9,6) p99_ms,round(count(*)/greatest(1e0,sum(ms)/1000)+1e-9,6) throughput,round(avg(case when success then 0e0 else 1e0 end)+1e-9,6) error_rate from r where n<=1000 group by 1"""))  # fmt: skip
def ops_01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.inference_stats(call_log(spark, d)), nudge=1e-9)


GPU = """with u as (select cast(cast(o_orderdate as date) as timestamp) s,(o_orderkey%9+1)*1e0 h,0.5e0+(o_custkey%3) c from orders), m as (select coalesce(sum(h),0e0) as hours,coalesce(sum(h*c),0e0) spend from u where s>=timestamp '1997-03-01' and s<=timestamp '1997-03-20') """


def gpu_cost(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.col("o_orderdate").cast("date").cast("timestamp")
    usage = o.select(start.alias("start"), (start + F.make_interval(hours=(F.col("o_orderkey") % 9 + 1).cast("int"))).alias("end"), F.lit("g").alias("instance_type"), (0.5 + F.col("o_custkey") % 3).cast("double").alias("hourly_cost"))
    return ops.gpu_cost(usage, "1997-03-20", 400.0)


@query("ops_02", GPU + """select round(hours,6) as hours,round(spend,6) spend,round(spend/20*31,6) projected,round(spend/400,6) used,case when spend/400>=1 then 'over_budget' when spend/400>=0.8e0 then 'critical' when spend/400>=0.6e0 then 'warning' else 'ok' end alert from m""")
def ops_02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gpu_cost(spark, d))


@query("ops_02_advice", GPU + """select round(spend,6) spend,round(case when spend/20*31<9e6 then (9e6-spend)/2.5e0 end,4) missing_hours,round(case when spend/20*31<9e6 then (9e6-spend)/2.5e0/11 end,4) missing_hours_a_day,
 array_to_string(list_filter([case when spend/20*31<9e6 then 'use_more' end,case when spend>=400 then 'stop_what_can_wait' end,case when spend/20*31>440 then 'expect_overspend' end], lambda x: x is not null),',') advice from m""")  # fmt: skip
def ops_02_advice(spark: SparkSession, d: str) -> DataFrame:
    out = ops.gpu_advice(gpu_cost(spark, d), "1997-03-20", 400.0, least=9e6, hourly=2.5)
    return out.select(F.round("spend", 6).alias("spend"), F.round("missing_hours", 4).alias("missing_hours"), F.round("missing_hours_a_day", 4).alias("missing_hours_a_day"), "advice")


@query("ops_05_due", """with m as (select 's'||s_suppkey model,case s_suppkey%5 when 0 then 'hourly' when 1 then 'daily' when 2 then 'weekly' when 3 then 'monthly' else 'never' end schedule,1e6-s_suppkey*40000e0 trained_at from supplier),
 n as (select *, trained_at+case schedule when 'hourly' then 3600 when 'daily' then 86400 when 'weekly' then 604800 when 'monthly' then 2592000 end next_at from m) select model,schedule,next_at,coalesce(next_at<=1e6,false) due from n""")  # fmt: skip
def ops_05_due(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    schedule = F.get(F.array(*map(F.lit, (*ops.INTERVALS, "never"))), (k % 5).cast("int"))
    models = table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("model"), schedule.alias("schedule"), (1e6 - k * 40000.0).alias("trained_at"))
    return ops.retraining_due(models, 1e6).drop("trained_at")


@query("ops_03", sql.query("calls", f"""with r as (select *, {int(NOW)}-taken_at ago, row_number() over (partition by model order by taken_at desc,call_id desc) n from calls where taken_at<={int(NOW)})
select model api,count(*) filter (where ago<86400) today,count(*) filter (where ago<2592000) "month",count(*) filter (where ago<60) last_minute,count(*) filter (where not success) errors,round(avg(case when n<=100 then ms end),6) mean_latency_ms,round(count(*) filter (where ago<86400)/5e0,6) used,
 case when count(*) filter (where ago<86400)/5e0>=1 then 'exceeded' when count(*) filter (where ago<86400)/5e0>=0.9e0 then 'critical' when count(*) filter (where ago<86400)/5e0>=0.75e0 then 'warning' else 'ok' end status from r group by 1"""))  # fmt: skip
def ops_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.api_quotas(call_log(spark, d), NOW, 5))


@query("ops_03_minutes", sql.query("calls", 'select model api,cast(floor(taken_at/60)*60 as bigint) "minute",count(*) n from calls group by 1,2'))
def ops_03_minutes(spark: SparkSession, d: str) -> DataFrame:
    return ops.calls_per_minute(call_log(spark, d))


@query("ops_05", """select model,version,cast(nth as integer) nth from (select 's'||s_nationkey model,cast(s_suppkey as bigint) version,row_number() over (partition by s_nationkey order by s_suppkey desc) nth from supplier) where nth<=5""")
def ops_05(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return ops.newest_versions(s.select(F.concat(F.lit("s"), F.col("s_nationkey")).alias("model"), F.col("s_suppkey").cast("bigint").alias("version")))


@query("ops_04", """select 'p'||(o_custkey%5) job,round(count(*)/(sum(o_orderkey%7+1)*1e0),6) records_per_second,round(count(*) filter (where o_orderkey%11=0)*1e0/count(*),6) error_rate from orders group by 1""")
def ops_04(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    log = o.select(F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("job"), F.lit(1).alias("records"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("errors"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("seconds"))
    return rounded(ops.processing_rate(log))


@query("rsk_09", sql.query("srk", "select user_id,trip_id,round(session_risk,6) session_risk,round(trust_rate,6) trust_rate,is_valid,recommendations from srk"))
def rsk_09(spark: SparkSession, d: str) -> DataFrame:
    s = risk.session_risk(risks.located(spark, d))
    return rounded(s.select("user_id", "trip_id", "session_risk", "trust_rate", "is_valid", F.array_join("recommendations", ",").alias("recommendations")))


def threat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers' risks up to NOW, and whether their first order after it is a risk above 0.5."""
    o = order_risks(spark, d, by="o_custkey")
    later = o.filter(F.col("at") > NOW).groupBy("user_id").agg((F.min_by("risk", F.struct("at", "risk")) > 0.5).cast("int").alias("label"))
    return predict.risk_history(o, NOW, days=3650).join(later, "user_id")


@query("mlt_01_threat")
def mlt_01_threat(spark: SparkSession, d: str) -> DataFrame:
    return learning.evaluate_threat(threat_rows(spark, d))


@query("mlt_02")
def mlt_02(spark: SparkSession, d: str) -> DataFrame:
    """Chances of a threat from a fitted model that is run outside Spark ML, in batches."""
    rows = staged(threat_rows(spark, d), "threats")
    return learning.batched_threat(learning.fit_threat(rows), rows)


@query("snk_02", """with o as (select o_custkey user_id, (cast(o_orderdate as date)-date '1970-01-01')*86400e0+o_orderkey%86400 as taken_at from orders), n as (select count(*) n from (select user_id from o group by 1 having count(*) filter (where taken_at>870000000e0)>0))
select 'threat' model, cast(v as bigint) "version", v=7 newest, n scored, cast(0 as bigint) differing from range(3,8) r(v), n""")  # fmt: skip
def snk_02(spark: SparkSession, d: str) -> DataFrame:
    """A model saved seven times: the five newest versions stay, and each predicts what the fitted one does."""
    rows = staged(threat_rows(spark, d), "threats")
    fitted, place = learning.fit_threat(rows), f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    for _ in range(7):
        models.save(fitted, spark, place, "threat")
    want, parts = staged(learning.predict_threat(fitted, rows).select("user_id", F.col("p").alias("want")), "predicted"), []
    for v in models.versions(spark, place, "threat"):
        loaded = models.load(spark, place, "threat", version=v, columns=learning.THREAT_FEATURES)
        parts.append(staged(learning.predict_threat(loaded, rows).select("user_id", "p", F.lit(v).cast("bigint").alias("version")), "predicted"))
    counts = reduce(DataFrame.union, parts).join(want, "user_id").groupBy("version").agg(F.count("*").alias("scored"), F.count_if(F.abs(F.col("p") - F.col("want")) > 1e-12).alias("differing"))
    return models.listed(spark, place, "threat").join(counts, "version").select("model", "version", "newest", "scored", "differing")


@query("dly_04_observed")
def dly_04_observed(spark: SparkSession, d: str) -> DataFrame:
    """Delays of trips as they ran, predicted with the depth that five-fold cross validation chose."""
    sig = signatures(scored_tracks(spark, d))
    return learning.evaluate_observed(learning.observed_delays(delays(sig, staged(profile.routes(sig), "routes")), sig))


@query("ano_10_detectors")
def ano_10_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an ensemble with a detector of its own, beside those without."""
    p = sessions.prepared(analysis.given_isolation(scored_tracks(spark, d)))
    more = anomaly.Detectors()
    more.register("zigzag", anomaly.zigzags, 0.3)
    users = sessions.known(p)
    with_it, without = sessions.detected(p, users, detectors=more), sessions.detected(p, users).select("event_id", F.col("anomaly_score").alias("score_without"))
    return rounded(with_it.select("event_id", "zigzag_score", F.col("anomaly_score").alias("score")).join(without, "event_id"))
