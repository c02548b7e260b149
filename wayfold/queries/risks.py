"""Queries: spoofing, risk, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import baseline, explain, profile, risk, spoofing, viz
from wayfold.plans import sessions as plan
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import analysis, sql
from wayfold.queries.registry import query, rounded
from wayfold.sources.tracks import dirty_tracks

K, KEY = analysis.K, analysis.KEY
W = "partition by user_id,trip_id order by idx"
SIG = "user_id,trip_id,source,kind,idx,likelihood"
sql.define("pts", ["conf"], "select *, cast(rn-1 as integer) idx from conf")
sql.define("s_phys", ["pts"], """select user_id,trip_id,'physical' source,'impossible_speed' kind,idx,least(1e0,speed/600) likelihood from pts where speed>300
 union all select user_id,trip_id,'physical','teleportation',idx,least(1e0,(calc_speed/300-1)/2) from pts where calc_speed>360
 union all select user_id,trip_id,'physical','impossible_acceleration',idx,least(1e0,abs(acceleration)/15-1) from pts where abs(acceleration)>15""")  # fmt: skip
sql.define("s_rep", ["pts"], """with t as (select user_id,trip_id,idx from pts where calc_speed>360),
 m as (select a.user_id,a.trip_id,a.idx start,b.idx,row_number() over (partition by a.user_id,a.trip_id,a.idx order by b.idx) nth from t a join t b on a.user_id=b.user_id and a.trip_id=b.trip_id and b.idx between a.idx and a.idx+10),
 k as (select *, count(*) over (partition by user_id,trip_id,start) c from m where nth<=10)
select user_id,trip_id,'physical' source,'repeated_teleportation' kind,idx,least(1e0,c/10e0) likelihood from k where c>=3""")  # fmt: skip


def clock_sql(events: str) -> str:
    return f"""with e as (select *, cast(row_number() over w-1 as integer) idx, timestamp_unix-lag(timestamp_unix) over w gap from {events} window w as (partition by user_id,trip_id order by arrival_seq,copy_no,event_id))
select user_id,trip_id,'timestamp' source,'clock_set_back' kind,idx,least(1e0,abs(gap)/60) likelihood from e where gap<-1 union all select user_id,trip_id,'timestamp','long_silence',idx,0.3e0 from e where gap>3000"""


def integrity_sql(events: str) -> str:
    return f"""with i as (select user_id,trip_id,point_index,count(*) c from {events} group by 1,2,3),
 s as (select user_id,trip_id,sum(c) n,max(point_index)-min(point_index)+1 expected,count(*) seen,count(*) filter (where c>1) repeated from i group by 1,2 having sum(c)>=2)
select user_id,trip_id,'integrity' source,'missing_points' kind,0 idx,least(1e0,2e0*(expected-seen)/expected) likelihood from s where expected>seen union all select user_id,trip_id,'integrity','repeated_points',0,least(1e0,repeated*1e0/n) from s where repeated>0"""


sql.define("s_time", ["dirty"], clock_sql("dirty"))
sql.define("s_int", ["dirty"], integrity_sql("dirty"))
OWN = "(select *, point_index arrival_seq, 0 copy_no from pts)"
sql.define("s_time0", ["pts"], clock_sql(OWN.replace("select *", "select user_id,trip_id,event_id,timestamp_unix")))
sql.define("s_int0", ["pts"], integrity_sql("pts"))
sql.define("s_acc", ["pts"], f"""with a as (select *, coalesce(coords_accuracy,50e0) acc from pts), b as (select *, lag(acc) over ({W}) pa, count(*) over ({W} rows between current row and 4 following) n5, min(acc) over ({W} rows between current row and 4 following) m5 from a)
select user_id,trip_id,'accuracy' source,'accuracy_drop' kind,idx,least(1e0,(acc/pa-1)/10) likelihood from b where pa>0 and acc/pa>=5 union all select user_id,trip_id,'accuracy','accuracy_lost',idx,0.4e0 from b where n5=5 and m5>=100""")  # fmt: skip
sql.define("s_same", ["pts"], """with p as (select user_id,trip_id,idx,round(lat,6) la,round(lon,6) lo from pts), g as (select user_id,trip_id,la,lo,count(*) n from p group by 1,2,3,4 having count(*)>=3 and max(idx)-min(idx)+1<>count(*))
select user_id,trip_id,'synthetic' source,'identical_coordinates' kind,idx,least(1e0,n/10e0) likelihood from p join g using (user_id,trip_id,la,lo)""")  # fmt: skip
LEADS = ",".join(f"lead({c},{i}) over ({W}) {c}{i}" for c in ("lat", "lon") for i in range(5))
RES = ",".join(f"abs({c}{i}-({c}0+{c}1+{c}2+{c}3+{c}4)/5-({i}-2)*(-2*{c}0-{c}1+{c}3+2*{c}4)/10)" for c in ("lat", "lon") for i in range(5))
sql.define("s_line", ["pts"], f"""with l as (select user_id,trip_id,idx,{LEADS} from pts), r as (select *, greatest({RES}) worst from l where lat4 is not null and len(list_distinct([lat0,lat1,lat2,lat3,lat4]))>2 and len(list_distinct([lon0,lon1,lon2,lon3,lon4]))>2)
select user_id,trip_id,'synthetic' source,'perfect_line' kind,idx+2 idx,1-worst/0.001e0 likelihood from r where worst<0.001e0""")  # fmt: skip
sql.define("s_reg", ["pts"], """with s as (select user_id,trip_id,count(*) n,avg(case when time_delta>0 then time_delta end) m,stddev_pop(case when time_delta>0 then time_delta end) sd from pts group by 1,2 having count(*)>=10 and count(case when time_delta>0 then 1 end)>=5)
select user_id,trip_id,'synthetic' source,'regular_timing' kind,cast(floor(n/2) as integer) idx,1-(sd/m)/0.05e0 likelihood from s where m>0 and sd/m<0.05e0""")  # fmt: skip
PARTS = ["s_phys", "s_rep", "s_acc", "s_same", "s_line", "s_reg"]
sql.define("sig", [*PARTS, "s_time0", "s_int0"], " union all ".join(f"select {SIG} from {p}" for p in [*PARTS, "s_time0", "s_int0"]))
sql.define("ses", ["sig", "pts"], """with g as (select user_id,trip_id,case when source='integrity' then 'pattern' else source end grp,max(likelihood) top,count(*) n from sig group by 1,2,3),
 w as (select *, case grp when 'physical' then 0.3e0 when 'timestamp' then 0.2e0 when 'accuracy' then 0.1e0 when 'synthetic' then 0.15e0 else 0.25e0 end w from g),
 s as (select user_id,trip_id,sum(w*top)/sum(w) spoofing,coalesce(max(case when grp in ('timestamp','pattern') then top end),0e0) tampering,min(1-top) integrity,cast(sum(n) as bigint) n_signals from w group by 1,2)
select k.user_id,k.trip_id,coalesce(spoofing,0e0) spoofing,coalesce(tampering,0e0) tampering,coalesce(integrity,1e0) integrity,coalesce(n_signals,0) n_signals,coalesce(spoofing>=0.5e0 or tampering>=0.5e0,false) requires_attention
from (select distinct user_id,trip_id from pts) k left join s using (user_id,trip_id)""")  # fmt: skip
ROUND_SIG = "select user_id,trip_id,kind,cast(idx as integer) idx,round(likelihood,5) likelihood from {0}"


def signal_query(name: str, table: str, build):
    @query(name, sql.query(table, ROUND_SIG.format(table)))
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = build(spark, d)
        return rounded(out.select("user_id", "trip_id", "kind", F.col("idx").cast("int").alias("idx"), "likelihood"), 5)

    return run


def points(spark: SparkSession, d: str) -> DataFrame:
    return spoofing.indexed(scored_tracks(spark, d))


signal_query("spf_01", "s_phys", lambda s, d: spoofing.physical(points(s, d)))
signal_query("spf_02", "s_rep", lambda s, d: spoofing.repeated_teleports(points(s, d)))
signal_query("spf_03", "s_time", lambda s, d: spoofing.timestamps(dirty_tracks(s, d)))
signal_query("spf_04", "s_acc", lambda s, d: spoofing.accuracy(points(s, d)))
signal_query("spf_05", "s_same", lambda s, d: spoofing.identical_coordinates(points(s, d)))
signal_query("spf_06", "s_line", lambda s, d: spoofing.perfect_lines(points(s, d)))
signal_query("spf_07", "s_reg", lambda s, d: spoofing.regular_timing(points(s, d)))
signal_query("spf_08", "s_int", lambda s, d: spoofing.integrity(dirty_tracks(s, d)))


@query("spf_09", sql.query("conf", f"select {K},round(least(1e0,greatest(case when speed>300 then speed/600 else 0e0 end,case when calc_speed>360 then (calc_speed/300-1)/2 else 0e0 end,case when abs(acceleration)>15 then abs(acceleration)/15-1 else 0e0 end)),5) spoof_likelihood from conf"))
def spf_09(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spoofing.point_scores(scored_tracks(spark, d)).select(*KEY, "spoof_likelihood"), 5)


SES = "round(spoofing,5) spoofing,round(tampering,5) tampering,round(integrity,5) integrity"


@query("spf_10", sql.query("ses", f"select user_id,trip_id,{SES},n_signals,requires_attention from ses"))
def spf_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spoofing.sessions(scored_tracks(spark, d)), 5)


@query("spf_11", sql.query("s_time s_int pts", """with m as (select user_id,trip_id,count(coords_accuracy) a,count(speed) v from pts group by 1,2),
 x as (select user_id,trip_id,likelihood from s_time union all select user_id,trip_id,likelihood from s_int union all select user_id,trip_id,0.5e0 from m where a=0 union all select user_id,trip_id,0.4e0 from m where v=0)
select m.user_id,m.trip_id,round(coalesce(max(likelihood),0e0),5) tampering,round(0.5e0*coalesce(max(likelihood),0e0),5) spoofing from m left join x using (user_id,trip_id) group by 1,2"""))  # fmt: skip
def spf_11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spoofing.tampering(scored_tracks(spark, d), dirty_tracks(spark, d)), 5)


@query("spf_12", sql.query("ses", "select user_id,round(max(spoofing),5) spoofing,round(max(tampering),5) tampering,round(min(integrity),5) integrity,count(*) filter (where requires_attention) to_review from ses group by 1"))
def spf_12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spoofing.query(spoofing.sessions(scored_tracks(spark, d))), 5)


sql.define("hrs", ["conf"], "select user_id,cast(floor(timestamp_unix/3600)%24 as integer) hr,count(*)*1e0/sum(count(*)) over (partition by user_id) p from conf where confidence>=0.5e0 group by 1,2")
sql.define("loc", ["ano", "ses", "head", "shares", "hrs", "metrics"], """with j as (select a.*, h.trips>=5 and h.points>=50 mature, m.mean bm, m.std bs, s.share, coalesce(r.p,0e0) hp, e.spoofing,e.tampering,e.integrity,e.requires_attention
 from ano a left join head h using (user_id) left join metrics m on m.user_id=a.user_id and m.metric='speed' left join shares s on s.user_id=a.user_id and s.activity=a.activity left join hrs r on r.user_id=a.user_id and r.hr=cast(floor(a.timestamp_unix/3600)%24 as integer)
 left join ses e on e.user_id=a.user_id and e.trip_id=a.trip_id),
 v as (select *, list_filter([case when bs>0 and speed is not null then least(1e0,abs(speed-bm)/bs/3) end,case when share<0.1e0 then 0.5e0 end,case when hp<0.05e0 then 0.3e0 end], lambda x: x is not null) parts from j),
 d as (select *, case when mature and len(parts)>0 then list_sum(parts)/len(parts) else 0e0 end deviation from v),
 r as (select *, least(1e0,greatest(0e0,0.3e0*(1-confidence)+0.3e0*anomaly_score+0.25e0*greatest(spoofing,tampering)+0.15e0*deviation)) risk from d)
select *, risk<0.5e0 and confidence>=0.5e0 and not is_anomalous and not requires_attention is_trusted,
 case when risk<0.1e0 then 'minimal' when risk<0.25e0 then 'low' when risk<0.45e0 then 'moderate' when risk<0.65e0 then 'elevated' when risk<0.85e0 then 'high' else 'critical' end risk_level,
 list_sort(list_filter([case when is_anomalous then 'anomalous' end,case when deviation>0.5e0 then 'deviation_from_baseline' end,case when requires_attention then 'spoofing_suspected' end,case when confidence<0.5e0 then 'low_confidence_'||confidence_level end], lambda x: x is not null)) reasons from r""")  # fmt: skip


def located(spark: SparkSession, d: str) -> DataFrame:
    return plan.located(analysis.given_isolation(scored_tracks(spark, d)), mature_trips=5, mature_points=50)


@query("rsk_01_04", sql.query("loc", f"select {K},round(deviation,5) deviation,round(risk,5) risk,risk_level,is_trusted,array_to_string(reasons,',') reasons from loc"))
def rsk_01_04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(located(spark, d).select(*KEY, "deviation", "risk", "risk_level", "is_trusted", F.array_join("reasons", ",").alias("reasons")), 5)


sql.define("srk", ["loc"], """with s as (select user_id,trip_id,avg(case when risk>=0.7e0 then 1e0 else 0e0 end) high_share,max(risk) max_risk,avg(risk) avg_risk,max(spoofing) spoofing,max(tampering) tampering,min(integrity) integrity,count(*) points,
 count(*) filter (where is_anomalous) anomalies,avg(case when is_trusted then 1e0 else 0e0 end) trust_rate,avg(confidence) mean_confidence from loc group by 1,2),
 r as (select *, least(1e0,greatest(0e0,0.25e0*least(1e0,2*high_share)+0.2e0*max_risk+0.2e0*avg_risk+0.2e0*spoofing+0.15e0*(1-integrity))) session_risk from s)
select *, case when session_risk<0.1e0 then 'minimal' when session_risk<0.25e0 then 'low' when session_risk<0.45e0 then 'moderate' when session_risk<0.65e0 then 'elevated' when session_risk<0.85e0 then 'high' else 'critical' end session_level,
 array_to_string(list_filter([case when high_share>0.1e0 then 'high_risk_points' end,case when max_risk>=0.8e0 then 'extreme_point_risk' end,case when avg_risk>0.5e0 then 'elevated_average_risk' end,case when spoofing>=0.5e0 or tampering>=0.5e0 then 'spoofing_suspected' end,case when integrity<0.8e0 then 'poor_integrity' end], lambda x: x is not null),',') session_reasons,
 coalesce(nullif(array_to_string(list_filter([case when session_risk>=0.7e0 then 'review_session' end,case when spoofing>=0.5e0 then 'verify_location' end,case when tampering>=0.5e0 then 'check_device' end,case when anomalies*1e0/points>0.2e0 then 'look_into_anomalies' end], lambda x: x is not null),','),''),'no_action') recommendations,
 session_risk<0.7e0 and spoofing<0.5e0 and trust_rate>=0.5e0 is_valid from r""")  # fmt: skip
S_NUM = ["high_share", "max_risk", "avg_risk", "trust_rate", "session_risk"]


@query("rsk_05_10", sql.query("srk", f"select user_id,trip_id,{','.join(f'round({c},5) {c}' for c in S_NUM)},points,anomalies,session_level,session_reasons,recommendations,is_valid from srk"))
def rsk_05_10(spark: SparkSession, d: str) -> DataFrame:
    s = risk.session_risk(located(spark, d))
    return rounded(s.select("user_id", "trip_id", *S_NUM, "points", "anomalies", "session_level", F.array_join("session_reasons", ",").alias("session_reasons"), F.array_join("recommendations", ",").alias("recommendations"), "is_valid"), 5)


@query("rsk_06", sql.query("loc", f"select {K},round(risk,5) risk,cast(nth as integer) nth from (select *, row_number() over (partition by user_id,trip_id order by round(risk,9) desc,timestamp_unix,point_index,event_id) nth from loc) where nth<=10 and risk>=0.5e0"))
def rsk_06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.flagged_points(located(spark, d)).select(*KEY, "risk", "nth"), 5)


@query("rsk_11", sql.query("srk", "select user_id,count(*) sessions,count(*) filter (where session_risk>=0.7e0) high_risk_sessions,round(avg(session_risk),5) mean_risk from srk group by 1"))
def rsk_11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.user_risk(risk.session_risk(located(spark, d))), 5)


@query("rsk_12", sql.query("srk", "select user_id,count(*) sessions,cast(sum(points) as bigint) points,count(*) filter (where anomalies>0) sessions_with_anomalies,count(*) filter (where session_level in ('high','critical')) high_risk_sessions,count(*) filter (where is_valid) valid_sessions from srk group by 1"))
def rsk_12(spark: SparkSession, d: str) -> DataFrame:
    return risk.process_summary(risk.session_risk(located(spark, d)))


@query("rsk_12_page", sql.query("srk", "select user_id,trip_id,round(session_risk,5) session_risk,cast(nth as integer) nth from (select *, row_number() over (partition by user_id order by trip_id) nth from srk where user_id=9 and trust_rate>=0.2e0) where nth between 2 and 5"))
def rsk_12_page(spark: SparkSession, d: str) -> DataFrame:
    s = risk.session_page(risk.session_risk(located(spark, d)), 9, min_trust=0.2, limit=4, offset=1)
    return rounded(s.select("user_id", "trip_id", "session_risk", "nth"), 5)


FAST = f"select {K},round(timestamp_unix,3) timestamp_unix,round(1-confidence,6) risk,confidence<0.5e0 anomalous,confidence<0.25e0 spoofed,round(case when confidence<0.5e0 then (0.5e0-confidence)*2 else 0e0 end,6) spoof_likelihood,confidence>=0.5e0 and len(quality_flags)=0 trusted,case when confidence>=0.75e0 then 'reliable' when confidence>=0.5e0 then 'acceptable' when confidence>=0.25e0 then 'doubtful' else 'unreliable' end explanation from conf"
sql.define("fast", ["conf"], FAST)


@query("viz_01", sql.query("fast", "select * from fast"))
def viz_01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(viz.fast_timeline(scored_tracks(spark, d)).withColumn("timestamp_unix", F.round("timestamp_unix", 3)))


@query("viz_02", sql.query("srk", f"with x as (select c.*, least(1e0,greatest(0e0,session_risk*(1+0.2e0*(1-confidence)))) r, spoofing>=0.5e0 sp from conf c join (select user_id,trip_id,session_risk,spoofing from srk) using (user_id,trip_id)) select {K},round(r,5) risk,sp spoofed,confidence>=0.5e0 and r<0.5e0 and not sp trusted,confidence<0.7e0 shows_anomalies from x"))
def viz_02(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return rounded(viz.full_timeline(p, risk.session_risk(located(spark, d))).drop("timestamp_unix"), 5)


@query("viz_03", sql.query("fast", f"select {K},risk from fast where user_id=4 and trusted order by timestamp_unix,trip_id,point_index,event_id limit 15"))
def viz_03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(viz.timeline(viz.fast_timeline(scored_tracks(spark, d)), 4, trusted_only=True, limit=15).select(*KEY, "risk"))


def share(c: str) -> str:
    return f"round(avg(case when {c} then 1e0 else 0e0 end),6)"


VIZ = f"count(*) points,round(avg(risk),9) mean_risk,round(max(risk),5) max_risk,{share('trusted')} trust_rate,{share('anomalous')} anomaly_rate,{share('spoofed')} spoof_rate"


@query("viz_04", sql.query("fast", f"select user_id,{VIZ} from fast where timestamp_unix>=1704068000 group by 1"))
def viz_04(spark: SparkSession, d: str) -> DataFrame:
    m = viz.metrics(viz.fast_timeline(scored_tracks(spark, d)), since=1704068000)
    return m.select("user_id", "points", F.round("mean_risk", 9).alias("mean_risk"), F.round("max_risk", 5).alias("max_risk"), *[F.round(c, 6).alias(c) for c in ("trust_rate", "anomaly_rate", "spoof_rate")])


@query("viz_05", sql.query("conf", f"with w as (select *, case when confidence<0.5e0 then (0.5e0-confidence)*2 else 0e0 end x from conf) select {K},round(lat,6) lat,round(lon,6) lon,round(x,6) weight,case when x>=0.7e0 then 'high' when x>=0.4e0 then 'medium' else 'low' end category from w"))
def viz_05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(viz.heat(scored_tracks(spark, d), "spoofing"))


@query("viz_05_bounds", sql.query("conf", "select user_id,round(min(lat),6) min_lat,round(max(lat),6) max_lat,round(min(lon),6) min_lon,round(max(lon),6) max_lon from conf group by 1"))
def viz_05_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(viz.bounds(scored_tracks(spark, d)))


@query("viz_06", sql.query("fast", f"""with m as (select user_id,avg(1e0*risk) r,{share("trusted")} t,{share("anomalous")} a,{share("spoofed")} s from fast group by 1)
select user_id,round((1-r)*100,8) health,case when r<0.15e0 then 'excellent' when r<0.3e0 then 'good' when r<0.5e0 then 'fair' when r<0.7e0 then 'poor' else 'critical' end status,
 array_to_string(list_filter([case when r>=0.5e0 then 'high_risk' end,case when a>0.2e0 then 'many_anomalies' end,case when s>0.05e0 then 'spoofing' end,case when t<0.5e0 then 'low_trust' end], lambda x: x is not null),',') concerns from m"""))  # fmt: skip
def viz_06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(viz.dashboard(viz.fast_timeline(scored_tracks(spark, d))), 8)


SAID = ["case when risk>=0.5e0 then 'risk is '||risk_level end", "case when confidence<0.5e0 then 'position is uncertain' end", "case when is_anomalous then 'behaviour is unusual' end", "case when requires_attention then 'position may be forged' end", "case when deviation>0.5e0 then 'differs from habits' end"]


@query("viz_07", sql.query("loc", f"with s as (select *, list_filter([{','.join(SAID)}], lambda x: x is not null) said from loc) select {K},case when len(said)>0 then array_to_string(said[1:3],'. ') else 'nothing unusual' end explanation from s"))
def viz_07(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d).select(*KEY, viz.explain_point().alias("explanation"))


def told_sql(risk_: str, level: str, reasons: str) -> str:
    """The sentence without its percentage, whose last digit hangs on how halves are printed."""
    title = "array_to_string(list_transform(string_split(x,'_'), lambda w: upper(w[1])||w[2:]),' ')"
    return f"'Risk is '||{level}||case when len({reasons})>0 then ': '||array_to_string(list_transform({reasons}[1:5], lambda x: {title}),', ')||'.' else ': nothing stands out.' end"


def plain(out: DataFrame, keys: list[str]) -> DataFrame:
    """Explanations with the percentage checked apart, and the factors' names in order with their contributions, rounded."""
    factor = "array<struct<factor:string,contribution:double>>"
    parts = F.from_json("factors", factor)
    shares = F.array_sort(F.transform(parts, lambda p: F.concat(p["factor"], F.lit("="), F.round(p["contribution"] * 10000).cast("bigint").cast("string"))))
    return out.select(*keys, F.regexp_replace("explanation", r" \([0-9.,]+%\)", "").alias("explanation"), F.array_join(shares, ",").alias("factors"))


def shares_sql(parts: dict[str, str]) -> str:
    return "array_to_string(list_sort([" + ",".join(f"'{n}='||cast(cast(round(({c})*10000) as bigint) as varchar)" for n, c in parts.items()) + "]),',')"


OF_SESSION = {"high_risk_share": "0.25e0*least(1e0,2*high_share)", "largest_risk": "0.2e0*max_risk", "average_risk": "0.2e0*avg_risk", "spoofing": "0.2e0*spoofing", "integrity": "0.15e0*(1-integrity)"}
OF_POINT = {"uncertain_position": "0.3e0*(1-confidence)", "anomaly": "0.3e0*anomaly_score", "spoofing": "0.25e0*greatest(spoofing,tampering)", "unlike_baseline": "0.15e0*deviation"}


@query("exp_01", sql.query("srk", f"with s as (select *, list_filter(string_split(session_reasons,','), lambda x: x<>'') why from srk) select user_id,trip_id,{told_sql('session_risk', 'session_level', 'why')} explanation,{shares_sql(OF_SESSION)} factors from s"))
def exp_01(spark: SparkSession, d: str) -> DataFrame:
    return plain(explain.sessions(risk.session_risk(located(spark, d))), ["user_id", "trip_id"])


@query("exp_02", sql.query("loc", f"select {K},{told_sql('risk', 'risk_level', 'reasons')} explanation,{shares_sql(OF_POINT)} factors from loc"))
def exp_02(spark: SparkSession, d: str) -> DataFrame:
    return plain(explain.points(located(spark, d)), KEY)


@query("rsk_profile")
def rsk_profile(spark: SparkSession, d: str) -> DataFrame:
    p = scored_tracks(spark, d)
    return profile.summary(profile.learn(p, baseline.wide(p, mature_trips=5, mature_points=50), mature_trips=6, mature_points=50))
