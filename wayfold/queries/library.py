"""Queries: the time, geometry and statistics libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, stats, time
from wayfold.operators import simplify
from wayfold.plans.tracking import scored_tracks
from wayfold.queries import sql
from wayfold.queries.registry import query, rounded
from wayfold.sources.tracks import dirty_tracks, tracks

BY, TIE = ["user_id", "trip_id"], ["point_index", "event_id"]
W = "(partition by user_id,trip_id order by timestamp_unix,point_index,event_id)"
sql.define("dts", ["tracks"], f"select *, row_number() over {W}-1 i, timestamp_unix-lag(timestamp_unix) over {W} dt from tracks")


def line(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("q"))


sql.define("li", [], "select l_returnflag,cast(l_orderkey as bigint) k,cast(l_linenumber as bigint) n,cast(l_extendedprice as double) x,cast(l_quantity as double) q from lineitem")


@query("tim_01", "select event_id, epoch_us(case when event_id%3=2 then date_trunc('second',ts) else ts end) us from events")
def tim_01(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    return e.select("event_id", F.unix_micros(time.parse_timestamp(text)).alias("us"))


@query("tim_02_03_11", "select event_id,round(epoch_us(ts)/1e6,6) unix,round((epoch_us(ts)-epoch_us(timestamp '2024-01-01'))/1e6,6) delta,epoch_us(ts)-450000000 window_start,epoch_us(ts)+450000000 window_end from events")
def tim_02_03_11(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    w = time.time_window(F.col("ts"), 15)
    return rounded(e.select("event_id", time.unix(F.col("ts")).alias("unix"), time.delta(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts")).alias("delta"), *[F.unix_micros(c).alias(n) for n, c in w.items()]))


@query("tim_04_12", sql.query("dts", "select event_id,round(dt,5)+0e0 dt,dt between 0.5e0 and 300 valid from dts"))
def tim_04_12(spark: SparkSession, d: str) -> DataFrame:
    t = time.with_deltas(tracks(spark, d), "timestamp_unix", BY, TIE)
    return rounded(t.select("event_id", "dt", time.is_valid_delta(F.col("dt")).alias("valid")), 5)


@query("tim_05", sql.query("dts", 'select user_id,trip_id,cast(i-1 as integer) "before",cast(i as integer) "after",round(dt,5) "seconds" from dts where dt>=30'))
def tim_05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(time.gaps(tracks(spark, d), "timestamp_unix", BY, TIE), 5)


@query("tim_06", sql.query("dirty", "with g as (select user_id,trip_id,timestamp_unix-lag(timestamp_unix) over (partition by user_id,trip_id order by arrival_seq,copy_no,event_id) dt from dirty) select user_id,trip_id,coalesce(bool_and(dt>=0),true) monotonic,coalesce(bool_and(dt>0),true) strict from g group by 1,2"))
def tim_06(spark: SparkSession, d: str) -> DataFrame:
    return time.monotonic(dirty_tracks(spark, d), "timestamp_unix", BY, ["arrival_seq", "copy_no", "event_id"])


@query("tim_07", sql.query("dirty", """with g as (select *, row_number() over w-1 i, timestamp_unix-lag(timestamp_unix) over w dt from dirty window w as (partition by user_id,trip_id order by timestamp_unix,point_index,event_id,copy_no)),
 r as (select *, sum(case when coalesce(abs(dt)<=0.001e0,false) then 0 else 1 end) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id,copy_no rows unbounded preceding) run from g)
select user_id,trip_id,cast(min(i) as integer) "first",count(*) n from r group by user_id,trip_id,run having count(*)>1"""))  # fmt: skip
def tim_07(spark: SparkSession, d: str) -> DataFrame:
    return time.same_time_runs(dirty_tracks(spark, d), "timestamp_unix", BY, [*TIE, "copy_no"])


@query("tim_08", sql.query("tracks", "select user_id,trip_id,round(case when count(*)>1 and max(timestamp_unix)>min(timestamp_unix) then (count(*)-1)/(max(timestamp_unix)-min(timestamp_unix)) end,8) frequency from tracks group by 1,2"))
def tim_08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(time.update_frequency(tracks(spark, d), "timestamp_unix", BY), 8)


@query("tim_09", sql.query("dts", f"with s as (select *, sum(case when dt>=30 then 1 else 0 end) over (partition by user_id,trip_id order by i rows unbounded preceding) seg from dts) select user_id,trip_id,cast(min(i) as integer) \"start\",cast(max(i)+1 as integer) \"stop\" from s group by user_id,trip_id,seg"))
def tim_09(spark: SparkSession, d: str) -> DataFrame:
    return time.segments(tracks(spark, d), "timestamp_unix", BY, TIE)


@query("tim_10", "with s as (select event_id, (event_id*37)%9000-4500+0.5e0 s from events), a as (select *, cast(floor(abs(s)) as bigint) v from s) select event_id, (case when s<0 then '-' else '' end)||concat_ws(' ',case when v//3600>0 then (v//3600)||'h' end,case when v%3600//60>0 or v//3600>0 then (v%3600//60)||'m' end,(v%60)||'s') text from a")
def tim_10(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", time.format_duration((F.col("event_id") * 37) % 9000 - 4500 + F.lit(0.5)).alias("text"))


@query("geo_01_09", sql.query("conf", f"""with p as (select event_id,user_id,trip_id,lat,lon,speed,calc_speed,time_delta,rn,lag(lat) over {W} la,lag(lon) over {W} lo from conf)
select event_id,round({sql.hav("la", "lo", "lat", "lon")},3)+0e0 metres,round({sql.brg("la", "lo", "lat", "lon")},5)+0e0 bearing,lat between -90 and 90 and lon between -180 and 180 valid,abs(lat)<1e-4 and abs(lon)<1e-4 null_island,round(abs(speed-calc_speed)*time_delta,3)+0e0 gps_error from p"""))  # fmt: skip
def geo_01_09(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*BY).orderBy("timestamp_unix", *TIE)
    p = scored_tracks(spark, d).withColumns({"la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)})
    a = [F.col(c) for c in ("la", "lo", "lat", "lon")]
    return p.select("event_id", (F.round(geo.haversine(*a), 3) + 0.0).alias("metres"), (F.round(geo.bearing(*a), 5) + 0.0).alias("bearing"), geo.is_valid_coordinate(a[2], a[3]).alias("valid"), geo.is_null_island(a[2], a[3]).alias("null_island"), (F.round(geo.gps_error(F.col("speed"), F.col("calc_speed"), F.col("time_delta")), 3) + 0.0).alias("gps_error"))


@query("geo_10", sql.query("tracks", "select event_id,round(lat-500e0/(111132.92e0-559.82e0*cos(2*radians(lat))),6) min_lat,round(lat+500e0/(111132.92e0-559.82e0*cos(2*radians(lat))),6) max_lat,round(lon-500e0/(111412.84e0*cos(radians(lat))),6) min_lon,round(lon+500e0/(111412.84e0*cos(radians(lat))),6) max_lon from tracks"))
def geo_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks(spark, d).select("event_id", *[c.alias(n) for n, c in geo.bounding_box(F.col("lat"), F.col("lon"), F.lit(500.0)).items()]))


@query("geo_11")
def geo_11(spark: SparkSession, d: str) -> DataFrame:
    return simplify.simplify(tracks(spark, d)).select("user_id", "trip_id", "point_index", "event_id")


@query("geo_12", sql.query("tracks", f"""with p as (select event_id,lat y0,lon x0,lag(lat) over {W} y1,lag(lon) over {W} x1,lead(lat) over {W} y2,lead(lon) over {W} x2 from tracks), s as (select *, 111412.84e0*cos(radians((x0+x1+x2)/3)) k from p where y1 is not null and y2 is not null),
 m as (select event_id,(y2-y1)*k dx,(x2-x1)*111132.92e0 dy,(y0-y1)*k px,(x0-x1)*111132.92e0 py from s)
select event_id,round(case when sqrt(dx*dx+dy*dy)>0 then abs(dy*px-dx*py)/sqrt(dx*dx+dy*dy) else sqrt(px*px+py*py) end,3)+0e0 metres from m"""))  # fmt: skip
def geo_12(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*BY).orderBy("timestamp_unix", *TIE)
    p = tracks(spark, d).withColumns({f"{c}{i}": f(c).over(w) for c in ("lat", "lon") for i, f in ((1, F.lag), (2, F.lead))}).filter("lat1 is not null and lat2 is not null")
    c = F.col
    return p.select("event_id", (F.round(geo.line_distance((c("lat"), c("lon")), (c("lat1"), c("lon1")), (c("lat2"), c("lon2"))), 3) + 0.0).alias("metres"))


@query("sta_01_02", sql.query("li", "select l_returnflag,round(avg(x),4) mean,round(median(x),4) median,round(stddev_pop(x),4) std,min(x) \"min\",max(x) \"max\",round(quantile_cont(x,0.05),4) p5,round(quantile_cont(x,0.25),4) p25,round(quantile_cont(x,0.75),4) p75,round(quantile_cont(x,0.95),4) p95,count(x) sample_size from li group by 1"))
def sta_01_02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.described(line(spark, d), "x", ["l_returnflag"]), 4)


R = "over (partition by k order by n,x rows 2 preceding)"


@query("sta_03_04", sql.query("li", f"select k,n,x,round(case when row_number() over (partition by k order by n,x)>=3 then avg(x) {R} end,4) mean3,round(case when row_number() over (partition by k order by n,x)>=3 then stddev_pop(x) {R} end,3)+0e0 std3 from li"))
def sta_03_04(spark: SparkSession, d: str) -> DataFrame:
    t = line(spark, d)
    return t.select("k", "n", "x", F.round(stats.rolling_mean(F.col("x"), 3, ["k"], ["n", "x"]), 4).alias("mean3"), (F.round(stats.rolling_std(F.col("x"), 3, ["k"], ["n", "x"]), 3) + 0.0).alias("std3"))


@query("sta_05_07", sql.query("li", """with b as (select l_returnflag,quantile_cont(x,0.25) a,quantile_cont(x,0.75) b,avg(x) m,stddev_pop(x) s,median(x) md from li group by 1), d as (select l_returnflag,median(abs(x-md)) mad from li join b using (l_returnflag) group by 1)
select l_returnflag,count(*) filter (where x<a-1.5e0*(b-a) or x>b+1.5e0*(b-a)) iqr,count(*) filter (where s>0 and abs((x-m)/s)>1.5e0) z,count(*) filter (where mad>0 and abs(0.6745e0*(x-md)/mad)>1.2e0) mad from li join b using (l_returnflag) join d using (l_returnflag) group by 1"""))  # fmt: skip
def sta_05_07(spark: SparkSession, d: str) -> DataFrame:
    t, by = line(spark, d), ["l_returnflag"]
    parts = [f(t, "x", by, *a).groupBy(*by).agg(F.count_if("outlier").alias(n)) for n, f, a in (("iqr", stats.outlier_iqr, ()), ("z", stats.outlier_z, (1.5,)), ("mad", stats.outlier_mad, (1.2,)))]
    return parts[0].join(parts[1], by).join(parts[2], by)


@query("sta_08", sql.query("li", """with e as (select l_returnflag,min(x) a,max(x) b from li group by 1), c as (select l_returnflag,least(cast(floor((x-a)/(b-a)*20) as integer)+1,20) bin,count(*) n from li join e using (l_returnflag) group by 1,2)
select e.l_returnflag,cast(i as integer) bin,round(a+(i-1)*((b-a)/20),4) low,round(a+i*((b-a)/20),4) high,coalesce(n,0) n from e cross join range(1,21) t(i) left join c on c.l_returnflag=e.l_returnflag and c.bin=t.i"""))  # fmt: skip
def sta_08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(line(spark, d), "x", ["l_returnflag"]), 4)


@query("sta_09", sql.query("li", "with m as (select l_returnflag,avg(x) m from li group by 1) select l_returnflag,round(avg(pow(x-m,3))/pow(avg(pow(x-m,2)),1.5e0),6) skewness,round(avg(pow(x-m,4))/pow(avg(pow(x-m,2)),2)-3,6) kurtosis,count(*) n from li join m using (l_returnflag) group by 1"))
def sta_09(spark: SparkSession, d: str) -> DataFrame:
    return rounded(line(spark, d).groupBy("l_returnflag").agg(*stats.shape(F.col("x"))))


@query("sta_09_normality")
def sta_09_normality(spark: SparkSession, d: str) -> DataFrame:
    t = line(spark, d).withColumn("g", F.pmod("k", F.lit(40)))
    return rounded(stats.normality(t, "x", "g"))


@query("sta_10", sql.query("li", "select l_returnflag,round(corr(x,q),6) r,count(*) n from li group by 1"))
def sta_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation(line(spark, d), "x", "q", ["l_returnflag"]))


@query("sta_10_p")
def sta_10_p(spark: SparkSession, d: str) -> DataFrame:
    t = line(spark, d).withColumn("g", F.pmod("k", F.lit(200)))
    return rounded(stats.correlation(t, "x", "q", ["g"]).withColumn("p", stats.correlation_p(F.col("r"), F.col("n"))))


@query("sta_11", sql.query("li", """with r as (select k,x,row_number() over (partition by k order by n,x)-1 i,count(*) over (partition by k) c from li)
select k,round(sum(x*case when i=0 then pow(0.7e0,c-1) else 0.3e0*pow(0.7e0,c-1-i) end),9) ema from r group by 1"""))  # fmt: skip
def sta_11(spark: SparkSession, d: str) -> DataFrame:
    t = line(spark, d).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda r: r["x"]).alias("v"))
    return rounded(t.select("k", F.element_at(stats.ema(F.col("v")), -1).alias("ema")), 9)


@query("sta_12", sql.query("tracks", "select activity_type,round(count(*)*1e0/sum(count(*)) over (),6) share from tracks group by 1"))
def sta_12(spark: SparkSession, d: str) -> DataFrame:
    c = tracks(spark, d).groupBy("activity_type").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return rounded(c.crossJoin(F.broadcast(total)).select("activity_type", (F.col("n") / F.col("total")).alias("share")))  # total: one row


@query("sta_13", sql.query("conf", """with g as (select user_id,b.bucket from (select distinct user_id from conf) cross join (values ('0.00-0.25'),('0.25-0.50'),('0.50-0.75'),('0.75-0.90'),('0.90-1.00')) b(bucket)),
 c as (select user_id,case when confidence<0.25e0 then '0.00-0.25' when confidence<0.5e0 then '0.25-0.50' when confidence<0.75e0 then '0.50-0.75' when confidence<0.9e0 then '0.75-0.90' else '0.90-1.00' end bucket,count(*) n from conf group by 1,2)
select g.user_id,g.bucket,coalesce(n,0) n from g left join c using (user_id,bucket)"""))  # fmt: skip
def sta_13(spark: SparkSession, d: str) -> DataFrame:
    return stats.confidence_buckets(scored_tracks(spark, d), ["user_id"])
