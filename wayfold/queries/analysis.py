"""Queries: baselines and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import anomaly, baseline, iforest, trips
from wayfold.plans import sessions as plan
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import sql
from wayfold.queries.registry import query, rounded

K = "user_id,trip_id,point_index,event_id"
KEY = K.split(",")
STATS = "coalesce(avg(value),0e0) mean, coalesce(median(value),0e0) median, coalesce(stddev_pop(value),0e0) std, coalesce(min(value),0e0) \"min\", coalesce(max(value),0e0) \"max\", coalesce(quantile_cont(value,0.05),0e0) p5, coalesce(quantile_cont(value,0.25),0e0) p25, coalesce(quantile_cont(value,0.75),0e0) p75, coalesce(quantile_cont(value,0.95),0e0) p95, count(value) sample_size"
STAT_NAMES = ["mean", "median", "std", "min", "max", "p5", "p25", "p75", "p95"]
ROUND_STATS = ", ".join(f'round("{c}"+1e-9,6) "{c}"' for c in STAT_NAMES)


def metric_sql(source: str) -> str:
    return f"""with kept as (select * from {source} where confidence>=0.5e0), v as (
 select user_id,'speed' metric,speed as value from kept union all select user_id,'update_rate',update_rate from kept
 union all select user_id,'stop_duration',case when is_stop and stop_duration>0 then stop_duration end from kept
 union all select user_id,'trip_duration',null from kept
 union all select user_id,'trip_duration',max(timestamp_unix)-min(timestamp_unix) from kept group by user_id,trip_id having count(*)>=2)
select user_id,metric,{STATS} from v group by 1,2"""


sql.define("metrics", ["conf"], metric_sql("conf"))
sql.define("head", ["conf"], "select user_id, count(distinct trip_id) trips, count(*) points, (max(timestamp_unix)-min(timestamp_unix))/86400 \"days\", median(confidence) typical_confidence from conf where confidence>=0.5e0 group by 1")
sql.define("shares", ["conf"], "select user_id, activity, count(*)*1e0/sum(count(*)) over (partition by user_id) share from conf where confidence>=0.5e0 group by 1,2")


def pct(v: str, m: str) -> str:
    knots = [(0, "min"), (5, "p5"), (25, "p25"), (50, "median"), (75, "p75"), (95, "p95"), (100, "max")]
    arms = ""
    for (p, a), (q, b) in zip(knots, knots[1:], strict=False):
        x, y = f'{m}."{a}"', f'{m}."{b}"'
        arms += f" when {v}>={x} and {v}<={y} then case when {y}>{x} then {p}e0+({v}-{x})/({y}-{x})*({q}-{p}) else ({p}+{q})/2e0 end"
    return f'case when {v} is null or {m}.sample_size=0 then null when {v}<{m}."min" then 0e0{arms} else 100e0 end'


@query("bas_01", sql.query("metrics", f"select user_id,metric,{ROUND_STATS},sample_size from metrics"))
def bas_01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baseline.metrics(scored_tracks(spark, d)), nudge=1e-9)


@query("bas_01_header", sql.query("head", "select user_id,trips,points,round(\"days\",9) \"days\",round(typical_confidence,6) typical_confidence,trips>=5 and points>=50 is_mature from head"))
def bas_01_header(spark: SparkSession, d: str) -> DataFrame:
    h = baseline.header(scored_tracks(spark, d), mature_trips=5, mature_points=50)
    return h.withColumns({"days": F.round("days", 9), "typical_confidence": F.round("typical_confidence", 6)})


@query("bas_01_activities", sql.query("shares", "select user_id,activity,round(share,6) share from shares"))
def bas_01_activities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baseline.activities(scored_tracks(spark, d)))


@query("bas_02", sql.query("conf", "select user_id,trip_id,round(max(timestamp_unix)-min(timestamp_unix),6) trip_duration from conf where confidence>=0.5e0 group by 1,2 having count(*)>=2"))
def bas_02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baseline.trip_durations(scored_tracks(spark, d)))


sql.define("m_old", ["conf"], metric_sql("(select * from conf where trip_id%2=0)"))
sql.define("m_new", ["conf"], metric_sql("(select * from conf where trip_id%2=1)"))
LINE = ", ".join(f'round(case when coalesce(n.sample_size,0)=0 then o."{c}" when coalesce(o.sample_size,0)=0 then n."{c}" else (o.sample_size*o."{c}"+n.sample_size*n."{c}")/(o.sample_size+n.sample_size) end+1e-9,6) "{c}"' for c in ("mean", "median", "p5", "p25", "p75", "p95"))


@query("bas_03", sql.query("m_old m_new", f"""select coalesce(o.user_id,n.user_id) user_id, coalesce(o.metric,n.metric) metric, {LINE},
 round(case when coalesce(n.sample_size,0)=0 then o.std when coalesce(o.sample_size,0)=0 then n.std else sqrt((o.sample_size*o.std*o.std+n.sample_size*n.std*n.std)/(o.sample_size+n.sample_size)) end+1e-9,6) std,
 round(case when coalesce(n.sample_size,0)=0 then o."min" when coalesce(o.sample_size,0)=0 then n."min" else least(o."min",n."min") end+1e-9,6) "min", round(case when coalesce(n.sample_size,0)=0 then o."max" when coalesce(o.sample_size,0)=0 then n."max" else greatest(o."max",n."max") end+1e-9,6) "max",
 coalesce(o.sample_size,0)+coalesce(n.sample_size,0) sample_size from m_old o full join m_new n on o.user_id=n.user_id and o.metric=n.metric"""))  # fmt: skip
def bas_03(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(baseline.blend(baseline.metrics(p.filter("trip_id % 2 = 0")), baseline.metrics(p.filter("trip_id % 2 = 1"))), nudge=1e-9)


@query("bas_04", sql.query("conf", """with o as (select user_id,activity,count(*)*1e0/sum(count(*)) over (partition by user_id) share from conf where confidence>=0.5e0 and trip_id%2=0 group by 1,2),
 n as (select user_id,activity,count(*)*1e0/sum(count(*)) over (partition by user_id) share from conf where confidence>=0.5e0 and trip_id%2=1 group by 1,2)
select coalesce(o.user_id,n.user_id) user_id,coalesce(o.activity,n.activity) activity,round(0.7e0*coalesce(o.share,0)+0.3e0*coalesce(n.share,0),6) share from o full join n on o.user_id=n.user_id and o.activity=n.activity"""))  # fmt: skip
def bas_04(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(baseline.blend_shares(baseline.activities(p.filter("trip_id % 2 = 0")), baseline.activities(p.filter("trip_id % 2 = 1")), 0.7))


@query("bas_05_06", sql.query("metrics shares", f"""select c.user_id,c.trip_id,c.point_index,c.event_id, round({pct("c.speed", "s")},5) speed_percentile, round(case when s.mean>0 then c.speed/s.mean end,5) speed_ratio, round({pct("c.update_rate", "r")},5) rate_percentile, round(coalesce(a.share,0e0),5) activity_share
from conf c join metrics s on s.user_id=c.user_id and s.metric='speed' join metrics r on r.user_id=c.user_id and r.metric='update_rate' left join shares a on a.user_id=c.user_id and a.activity=c.activity"""))  # fmt: skip
def bas_05_06(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    out = baseline.analyse_points(p, baseline.wide(p), baseline.activities(p))
    return rounded(out.select(*KEY, "speed_percentile", "speed_ratio", "rate_percentile", "activity_share"), 5)


@query("bas_07", sql.query("metrics", f"""with t as (select user_id,trip_id,max(timestamp_unix)-min(timestamp_unix) duration,avg(speed) mean_speed from conf group by 1,2)
select t.user_id,t.trip_id,round({pct("t.duration", "m")},5) duration_percentile,round({pct("t.mean_speed", "s")},5) speed_percentile from t join metrics m on m.user_id=t.user_id and m.metric='trip_duration' join metrics s on s.user_id=t.user_id and s.metric='speed'"""))  # fmt: skip
def bas_07(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(baseline.analyse_trips(trips.trip_features(p), baseline.wide(p)), 5)


@query("bas_07_activities", sql.query("shares", """with o as (select user_id,trip_id,activity,count(*)*1e0/sum(count(*)) over (partition by user_id,trip_id) share from conf group by 1,2,3),
 u as (select distinct c.user_id,c.trip_id,s.activity,s.share from (select distinct user_id,trip_id from conf) c join shares s using (user_id))
select coalesce(o.user_id,u.user_id) user_id,coalesce(o.trip_id,u.trip_id) trip_id,coalesce(o.activity,u.activity) activity,round(coalesce(o.share,0)-coalesce(u.share,0),6)+0e0 deviation from o full join u on o.user_id=u.user_id and o.trip_id=u.trip_id and o.activity=u.activity"""))  # fmt: skip
def bas_07_activities(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(baseline.activity_deviation(p, baseline.activities(p)))


FIT = "select user_id,'{0}' feature,{1} as value from conf"
Z_ROWS = " union all ".join(FIT.format(c, c if c == "speed" else f"case when {c}<>0 then {c} end") for c in anomaly.Z_COLUMNS)
H_ROWS = " union all ".join(FIT.format(c, c if c == "speed" else f"case when {c}<>0 then {c} end") for c in anomaly.HBOS_COLUMNS)


@query("ano_04", sql.query("conf", f"select user_id,feature,round(case when count(*)>=30 then avg(value) end+1e-9,5) mean,round(case when count(*)>=30 then stddev_pop(value) end+1e-9,5) std from ({Z_ROWS}) group by 1,2"))
def ano_04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.fit_z(scored_tracks(spark, d)), 5, nudge=1e-9)


def zed(v: str, m: str, s: str) -> str:
    return f"case when {v} is not null and {m} is not null then case when {s}>0 then ({v}-{m})/{s} when {v}={m} then 0e0 else 5e0 end end"


sql.define("zsc", ["metrics"], f"""with j as (select c.*, s.mean m, s.std sd, case when r.mean>0 then 1/r.mean else 5e0 end tm, case when r.std>0 then 1/r.std else 2e0 end ts
 from conf c left join metrics s on s.user_id=c.user_id and s.metric='speed' left join metrics r on r.user_id=c.user_id and r.metric='update_rate'),
 z as (select *, {zed("speed", "m", "sd")} z_speed, {zed("time_delta", "tm", "ts")} z_time from j),
 g as (select *, greatest(case when abs(z_speed)>3 then abs(z_speed) else 0e0 end, case when z_time>3 then z_time else 0e0 end) z_max from z)
select *, case when z_max<=3 then z_max/6 else least(1e0,0.5e0+(z_max-3)/6) end stat_score,
 coalesce(speed>300,false) or coalesce(abs(acceleration)>30,false) or coalesce(calc_speed>450,false) violates_physics from g""")  # fmt: skip


@query("ano_05_06", sql.query("zsc", f"select {K},round(z_speed,5) z_speed,round(z_time,5) z_time,round(z_max,5) z_max,round(stat_score,5) stat_score from zsc"))
def ano_05_06(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    out = anomaly.z_score(anomaly.z_from_baseline(p, baseline.wide(p)))
    return rounded(out.select(*KEY, "z_speed", "z_time", "z_max", "stat_score"), 5)


sql.define("hfit", ["conf"], f"""with r as ({H_ROWS}), e as (select user_id,feature,min(value) a,max(value) b,count(value) n from r group by 1,2 having count(*)>=50 and count(value)>=10),
 w as (select user_id,feature,n,case when a<b then a else a-0.5e0 end low,(case when a<b then b-a else 1e0 end)/20 width from e),
 c as (select user_id,feature,least(cast(floor((value-low)/width) as integer)+1,20) bin,count(*) c from r join w using (user_id,feature) where value is not null group by 1,2,3),
 g as (select w.*, cast(i as integer) bin, coalesce(c.c,0)/(n*width)+0.1e0 raw from w cross join range(1,21) t(i) left join c on c.user_id=w.user_id and c.feature=w.feature and c.bin=t.i),
 s as (select *, raw/sum(raw) over (partition by user_id,feature) density from g)
select user_id,feature,low,width,bin,density,max(density) over (partition by user_id,feature) top from s""")  # fmt: skip


@query("ano_07", sql.query("hfit", "select user_id,feature,bin,round(low,5) low,round(width,5) width,round(density,6) density,round(top,6) top from hfit"))
def ano_07(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.fit_hbos(scored_tracks(spark, d))
    return out.select("user_id", "feature", "bin", *[F.round(c, 5).alias(c) for c in ("low", "width")], *[F.round(c, 6).alias(c) for c in ("density", "top")])


P_ROWS = " union all ".join(f"select user_id,event_id,'{c}' feature,{c} as value from conf" for c in anomaly.HBOS_COLUMNS)
sql.define("hbos", ["hfit"], f"""with p as ({P_ROWS}), f as (select distinct user_id,feature,low,width from hfit),
 b as (select p.*, greatest(1,least(20,cast(ceil((value-low)/width) as integer))) bin from p join f using (user_id,feature)),
 s as (select event_id, case when b.value is null then 0.5e0 else 1-h.density/h.top end score from b left join hfit h on h.user_id=b.user_id and h.feature=b.feature and h.bin=b.bin)
select event_id, coalesce(avg(case when score>0 then score end),0e0) hbos_score from s group by 1""")  # fmt: skip


@query("ano_08", sql.query("hbos", "select event_id,round(hbos_score,5) hbos_score from hbos"))
def ano_08(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(anomaly.hbos_score(p, anomaly.fit_hbos_arrays(p)), 5)


@query("ano_09", sql.query("zsc", f"select {K},violates_physics from zsc"))
def ano_09(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.physical(scored_tracks(spark, d)).select(*KEY, "violates_physics")


def given_isolation(points: DataFrame) -> DataFrame:
    """points with iso_score by arithmetic: forests are beyond SQL, so that both engines get the same scores; ano_10_forest learns them."""
    return points.withColumn("iso_score", F.pmod(F.col("event_id") * 37, F.lit(101)) / 100)


def detected(spark: SparkSession, d: str) -> DataFrame:
    return plan.detected(plan.prepared(given_isolation(scored_tracks(spark, d))))


sql.define("ano", ["zsc", "hbos"], """with i as (select z.*, h.hbos_score, (event_id*37%101)/1e2 iso_score from zsc z left join hbos h using (event_id)),
 e as (select *, case when violates_physics then 1e0 else least(1e0,0.3e0*iso_score+0.4e0*coalesce(stat_score,0)+0.2e0*coalesce(hbos_score,0)) end s0 from i),
 l as (select *, case when count(*) over w=5 and avg(confidence) over w<0.5e0-1e-9 then 1 else 0 end low from e window w as (partition by user_id,trip_id order by timestamp_unix,point_index,event_id rows between current row and 4 following)),
 r as (select *, sum(low) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id rows between 4 preceding and current row) low_runs from l)
select *, least(1e0,s0+0.1e0*low_runs) anomaly_score, s0>=0.5e0 or (low_runs>0 and least(1e0,s0+0.1e0*low_runs)>=0.5e0) is_anomalous from r""")  # fmt: skip


@query("ano_10_11", sql.query("ano", f"select {K},round(anomaly_score,5) anomaly_score,is_anomalous,cast(low_runs as bigint) low_runs from ano"))
def ano_10_11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detected(spark, d).select(*KEY, "anomaly_score", "is_anomalous", "low_runs"), 5)


@query("ano_12", sql.query("ano", "select user_id,count(*) points,count(*) filter (where is_anomalous) anomalies,round(avg(case when is_anomalous then 1e0 else 0e0 end),6) rate from ano group by 1"))
def ano_12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.query(detected(spark, d)))


KINDS = [
    ("impossible_speed", "speed>300", "1e0"), ("impossible_acceleration", "abs(acceleration)>30", "1e0"), ("teleportation", "calc_speed>450", "1e0"),
    ("unusual_speed", "not violates_physics and abs(z_speed)>3", "least(1e0,abs(z_speed)/6)"), ("unusual_gap", "not violates_physics and z_time>3", "least(1e0,z_time/6)"),
    ("unusual_pattern", "not violates_physics and coalesce(hbos_score,0)>0.7e0", "hbos_score"), ("isolated", "not violates_physics and iso_score>0.5e0", "iso_score"), ("low_confidence_sequence", "low_runs>0", "least(1e0,0.1e0*low_runs)"),
]
sql.define("asig", ["ano"], " union all ".join(f"select {K},'{k}' kind,{s} severity from ano where {c}" for k, c, s in KINDS))


@query("ano_12_signals", sql.query("asig", "select user_id,kind,count(*) n,round(max(severity),5) worst from asig group by 1,2"))
def ano_12_signals(spark: SparkSession, d: str) -> DataFrame:
    s = anomaly.signals(detected(spark, d))
    return rounded(s.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.max("severity").alias("worst")), 5)


@query("ano_10_forest")
def ano_10_forest(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble with learned isolation forests."""
    p = plan.prepared(scored_tracks(spark, d))
    out = plan.detected(p, iso=iforest.score(p))
    return rounded(out.select(*KEY, "violates_physics", "iso_score", "stat_score", "hbos_score", "low_runs", "anomaly_score", "is_anomalous"))


@query("ano_01_03")
def ano_01_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(iforest.score(scored_tracks(spark, d)))
