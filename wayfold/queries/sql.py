"""SQL for the oracle: the same tables written independently, as common table expressions."""

from __future__ import annotations

R = "6371008.8e0"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(2*{R}*atan2(sqrt({h}),sqrt(1-{h})))"


def brg(a: str, b: str, c: str, d: str) -> str:
    x = f"sin(radians({d}-{b}))*cos(radians({c}))"
    y = f"(cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-{b})))"
    return f"fmod(fmod(degrees(atan2({x},{y}))+360e0,360e0)+360e0,360e0)"


ACT_MAX = "case activity when 'still' then 0.5e0 when 'walking' then 2.5e0 when 'on_foot' then 2.5e0 when 'running' then 12e0 when 'on_bicycle' then 25e0 when 'shaking' then 1e0 else 50e0 end"

TABLES = {
    "tracks": """
with b as (select event_id,user_id,value,event_type,cast(json_extract_string(props,'$.k') as bigint) k,
  epoch_us(ts) us, (epoch_us(ts)-1704067200000000)/1e9 tu0 from events),
 n as (select *, user_id*100+cast(floor(tu0/432e0) as bigint) trip_id from b),
 m as (select *, cast(row_number() over (partition by user_id,trip_id order by us,event_id)-1 as int) rn,
   case when user_id%7=0 then tu0*10e0 else tu0 end tu, case when user_id%13=0 then 0e0 else 1e0 end mv from n)
select user_id,trip_id,rn point_index,event_id,1704067200e0+tu timestamp_unix,
 34e0+0.01e0*(user_id%50)+mv*(1e-5*tu*(1+user_id%20)+1e-6*value)+case when event_id%97=0 or (user_id%11=0 and event_id%5=0) then 2e0 else 0e0 end lat,
 -118e0+0.01e0*(user_id%40)+mv*(1e-5*tu*(1+user_id%15)-1e-6*value) lon,
 case when event_id%19=0 then -1e0 when event_id%101=0 then value*4e0 when user_id%13=0 then 0e0 else value/5e0 end speed,
 case when event_type='view' and k%2=0 then 0 else 1 end is_moving,
 case event_type when 'click' then 'walking' when 'view' then 'still' when 'purchase' then 'in_vehicle' when 'signup' then 'running' else 'other' end activity_type,
 k activity_confidence, case when event_id%23=0 then null else 3e0+(event_id%40)*3e0 end coords_accuracy from m where event_id%31<>0""",
    "dirty": """
select user_id,trip_id,
 case when event_id%53=0 and point_index>0 then point_index-1 else point_index end point_index,event_id,point_index arrival_seq,
 case when event_id%59=0 then timestamp_unix-120e0 else timestamp_unix end timestamp_unix,
 case when event_id%211=0 then 0e0 when event_id%223=0 then 95e0 else lat end lat,
 case when event_id%211=0 then 0e0 else lon end lon,speed,is_moving,upper(activity_type) activity_type,activity_confidence,coords_accuracy, 0 copy_no from tracks
 union all select user_id,trip_id,point_index,event_id,point_index,timestamp_unix,lat,lon,speed,is_moving,activity_type,activity_confidence,coords_accuracy,1 from tracks where event_id%61=0""",
    "norm": """
select * exclude (speed), case when speed>=0 then speed end speed,
 case when lower(activity_type) in ('still','walking','on_foot','running','on_bicycle','in_vehicle','shaking','unknown') then lower(activity_type) else 'unknown' end activity,
 'u'||user_id||'_t'||trip_id||'_p'||point_index event_key,
 substring(md5(concat_ws('~',cast(user_id as varchar),cast(trip_id as varchar),cast(point_index as varchar),cast(event_id as varchar))),1,16) event_hash from tracks""",
    "feat": f"""
with p as (select *, row_number() over w rn, timestamp_unix-lag(timestamp_unix) over w time_delta, lag(lat) over w la, lag(lon) over w lo, lag(speed) over w pv
  from norm window w as (partition by user_id,trip_id order by timestamp_unix,point_index,event_id)),
 q as (select *, case when time_delta>0 then 1e0/time_delta end update_rate, coalesce(time_delta>30,false) has_gap, case when time_delta>30 then time_delta end gap_duration,
  {hav("la", "lo", "lat", "lon")} distance, {brg("la", "lo", "lat", "lon")} bearing, case when time_delta>0 then (speed-pv)/time_delta end acceleration from p),
 r as (select *, case when time_delta>0 then distance/time_delta end calc_speed, bearing-lag(bearing) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id) turn from q),
 s as (select *, case when turn>180 then turn-360 when turn<-180 then turn+360 else turn end bearing_change, speed-calc_speed speed_diff,
  case when rn=1 then is_moving<>1 else is_moving<>1 or activity='still' or coalesce(speed<0.5e0,false) or coalesce(calc_speed<0.5e0,false) end is_stop from r),
 t as (select *, case when is_stop is distinct from lag(is_stop) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id) then 1 else 0 end chg from s),
 u as (select *, sum(chg) over (partition by user_id,trip_id order by timestamp_unix,point_index,event_id rows unbounded preceding) run from t),
 v as (select *, row_number() over (partition by user_id,trip_id,run order by timestamp_unix,point_index,event_id) nth from u)
select * exclude (la,lo,pv,turn,chg,run,nth), case when is_stop and rn>1 then sum(case when nth>1 then time_delta else 0e0 end) over (partition by user_id,trip_id,run order by timestamp_unix,point_index,event_id rows unbounded preceding) end stop_duration from v""",
    "flag": f"""
select *, list_filter([
 case when not(lat between -90 and 90 and lon between -180 and 180) or (abs(lat)<1e-4 and abs(lon)<1e-4) then 'invalid_coordinates' end,
 case when speed>100 then 'unrealistic_speed' end, case when abs(acceleration)>15 then 'unrealistic_acceleration' end, case when calc_speed>100 then 'teleportation' end,
 case when coords_accuracy>100 then 'low_gps_accuracy' end, case when is_moving<>1 and distance>greatest(coalesce(coords_accuracy,0e0),10e0) then 'gps_drift' end,
 case when abs(time_delta)<=0.001e0 then 'duplicate_timestamp' end, case when time_delta<0 then 'timestamp_out_of_order' end, case when time_delta>300 then 'large_time_gap' end,
 case when time_delta<0.5e0 then 'rapid_updates' end, case when speed>1.5e0*({ACT_MAX}) then 'speed_activity_mismatch' end,
 case when activity='still' and is_moving=1 then 'movement_stillness_conflict' end, case when speed is null then 'missing_speed' end, case when coords_accuracy is null then 'missing_accuracy' end
 ], lambda x: x is not null) quality_flags,
 (lat between -90 and 90 and lon between -180 and 180) and not (abs(lat)<1e-4 and abs(lon)<1e-4) is_valid from feat""",
    "conf": f"""
with c as (select *,
 case when coords_accuracy is null then 0.3e0 when coords_accuracy<=5 then 1e0 when coords_accuracy<=10 then 0.9e0 when coords_accuracy<=25 then 0.7e0 when coords_accuracy<=50 then 0.5e0 when coords_accuracy<=100 then 0.3e0 else 0.1e0 end s_gps,
 least(1e0, case when speed>100 then 0.1e0 when speed>80 then 0.5e0 else 1e0 end, case when speed>1.5e0*({ACT_MAX}) then 0.6e0 else 1e0 end, case when speed is null then 0.7e0 else 1e0 end,
  case when calc_speed>1 and abs(speed_diff)/calc_speed>0.5e0 then 0.5e0 when calc_speed>1 and abs(speed_diff)/calc_speed>0.25e0 then 0.7e0 else 1e0 end) s_speed,
 case when acceleration is null then 0.8e0 when abs(acceleration)>15 then 0.2e0 when abs(acceleration)>10 then 0.4e0 when abs(acceleration)>5 then 0.7e0 when abs(acceleration)>3 then 0.85e0 else 1e0 end s_acceleration,
 case when time_delta is null then 0.8e0 when time_delta>300 then 0.2e0 when time_delta>60 then 0.4e0 when time_delta>30 then 0.6e0 when time_delta<0.5e0 then 0.6e0 when time_delta<=5 then 1e0 when time_delta<=15 then 0.9e0 else 0.8e0 end s_temporal,
 (case when activity='still' and is_moving=1 and coalesce(speed,0)>1 then 0.5e0 when activity='still' and coalesce(calc_speed,0)>2 then 0.6e0
   when activity in ('running','walking','in_vehicle') and is_moving<>1 and coalesce(speed,0)<0.5e0 and coalesce(calc_speed,0)<0.5e0 then 0.6e0 else 1e0 end)*(0.5e0+0.5e0*activity_confidence/100e0) s_activity,
 case when list_contains(quality_flags,'teleportation') then 0.1e0 when list_contains(quality_flags,'gps_drift') then 0.5e0 when abs(bearing_change)>150 and calc_speed>5 then 0.7e0 else 1e0 end s_continuity,
 least(0.8e0, list_sum(list_transform(list_append(quality_flags,''), lambda f: case f when 'invalid_coordinates' then 0.5e0 when 'teleportation' then 0.4e0 when 'timestamp_out_of_order' then 0.3e0 when 'unrealistic_speed' then 0.15e0
   when 'unrealistic_acceleration' then 0.1e0 when 'gps_drift' then 0.1e0 when 'low_gps_accuracy' then 0.05e0 when 'duplicate_timestamp' then 0.05e0 when 'large_time_gap' then 0.05e0 when 'missing_speed' then 0.02e0 when 'missing_accuracy' then 0.02e0 else 0e0 end))) penalty from flag),
 d as (select *, round(greatest(0e0,0.25e0*s_gps+0.2e0*s_speed+0.15e0*s_acceleration+0.15e0*s_temporal+0.15e0*s_activity+0.1e0*s_continuity-penalty)+1e-9,4) confidence from c)
select *, len(quality_flags)>0 has_issues, case when confidence>=0.9e0 then 'excellent' when confidence>=0.75e0 then 'good' when confidence>=0.5e0 then 'moderate' when confidence>=0.25e0 then 'low' else 'unreliable' end confidence_level from d""",
}
NEEDS: dict[str, list[str]] = {"tracks": [], "dirty": ["tracks"], "norm": ["tracks"], "feat": ["norm"], "flag": ["feat"], "conf": ["flag"]}


def define(name: str, needs: list[str], sql: str) -> None:
    """Add a table expression for later queries."""
    TABLES[name], NEEDS[name] = sql, needs


def query(needs: str, select: str) -> str:
    """`select` after the table expressions named in needs (blank separated) and what those need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    head = ",\n".join(f"{n} as materialized ({TABLES[n]})" for n in order)
    select = select.strip()
    if select.lower().startswith("with "):
        return f"with {head},\n{select[5:]}"
    return f"with {head}\n{select}"
