"""Delay, threat and drift from profiles, risks and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.functions.core import between, cases, names_where
from wayfold.operators import zones

# --- delay


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """requests (request_id, user_id, o_lat, o_lon, d_lat, d_lon) with the best of all routes both of whose zones hold the ends, and its confidence."""
    r = routes.select("user_id", "route_id", "frequency", "duration", "distance", "start_lat", "start_lon", "end_lat", "end_lon", "start_radius", "end_radius")
    met = zones.met(requests.select("request_id", "user_id", "o_lat", "o_lon", "d_lat", "d_lon"), r, ends={"start": ("o_lat", "o_lon"), "end": ("d_lat", "d_lon")})
    conf = 0.6 * F.least(F.lit(1.0), F.col("zone.frequency") / 10) + 0.4 * (1 - (F.col("start_distance") + F.col("end_distance")) / (F.col("zone.start_radius") + F.col("zone.end_radius") + 1))
    met = met.select(F.col("trip.request_id").alias("request_id"), "zone.route_id", conf.alias("route_confidence"), F.col("zone.duration").alias("route_duration"), F.col("zone.distance").alias("route_distance"))
    best = met.groupBy("request_id").agg(F.max_by(F.struct("route_id", "route_confidence", "route_duration", "route_distance"), F.struct("route_confidence", F.col("route_id"))).alias("b"))
    return requests.join(best, "request_id", "left").select(*requests.columns, "b.*").withColumn("route_confidence", F.coalesce("route_confidence", F.lit(0.0)))


def delay_features(requests: DataFrame) -> DataFrame:
    """The eight features: distance, usual duration, weather, traffic, hour, weekday (Monday 0), rush hour, route confidence."""

    hour = F.pmod(F.floor(F.col("departure") / 3600), F.lit(24)).cast("int")
    return requests.withColumns({
        "distance_m": geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")), "hist_duration": F.coalesce("route_duration", F.lit(0.0)), "hour": hour,
        "weekday": F.pmod(F.floor(F.col("departure") / 86400) + 3, F.lit(7)).cast("int"), "is_rush": hour.isin(7, 8, 9, 17, 18, 19),
    })


def fuse(weather: Column, traffic: Column) -> dict[str, Column]:
    """Our fusion of weather impact (0 to 1) and traffic factor (from 1): combined factor and context confidence."""
    factor = F.greatest(F.lit(1.0), F.coalesce(traffic, F.lit(1.0)) * (1 + 0.3 * F.coalesce(weather, F.lit(0.0))))
    confidence = F.when(weather.isNotNull(), 0.5).otherwise(0.0) + F.when(traffic.isNotNull(), 0.5).otherwise(0.0)
    return {"delay_factor": factor, "context_confidence": confidence}


def heuristic_delay(requests: DataFrame) -> DataFrame:
    """requests (features, weather_impact, traffic_factor, delay_factor, context_confidence) with delay_minutes, its parts and confidence."""
    base = F.when(F.col("hist_duration") > 0, F.col("hist_duration")).otherwise(F.col("distance_m") / (50.0 / 3.6))
    w, tf = F.coalesce("weather_impact", F.lit(0.0)), F.coalesce("traffic_factor", F.lit(1.0))
    out = requests.withColumn("base_seconds", base)
    delay = F.greatest(F.lit(0.0), F.col("base_seconds") * (F.col("delay_factor") - 1) / 60) * (1 + 0.3 * w)
    out = out.withColumn("delay_minutes", delay)
    explain = names_where(bad_weather=w > 0.3, heavy_traffic=tf > 1.3, rush_hour=F.col("is_rush"), known_route=F.col("route_confidence") > 0.5)
    return out.withColumns({
        "delay_confidence": 0.8 * F.col("context_confidence"), "weather_minutes": F.col("base_seconds") * w * 0.3 / 60, "traffic_minutes": F.col("base_seconds") * (tf - 1) / 60,
        "expected_minutes": F.col("base_seconds") / 60 + F.col("delay_minutes"), "delay_reasons": explain,
    })


# --- threat


def risk_history(risks: DataFrame, now: float, *, days: int = 7) -> DataFrame:
    """(user_id, avg, max, min, std, high, n) of risks (user_id, at, risk) in the last days."""
    r = F.when((F.col("at") > now - days * 86400) & (F.col("at") <= now), F.col("risk"))
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return risks.groupBy("user_id").agg(zero(F.avg(r), "avg_risk"), zero(F.max(r), "max_risk"), zero(F.min(r), "min_risk"), zero(F.stddev_pop(r), "std_risk"), zero(F.avg(F.when(r > 0.7, 1.0).when(r.isNotNull(), 0.0)), "high_share"), F.count(r).alias("n_risks"))


def anomaly_history(detected: DataFrame, signals: DataFrame) -> DataFrame:
    kinds = signals.groupBy("user_id").agg(F.countDistinct("kind").alias("kinds"))
    out = detected.groupBy("user_id").agg(F.avg(F.when(F.col("is_anomalous"), 1.0).otherwise(0.0)).alias("anomaly_rate"), F.avg("anomaly_score").alias("mean_anomaly"), F.count("*").alias("n_points"))
    return out.join(kinds, "user_id", "left").fillna({"kinds": 0})


def spoof_history(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.avg("spoofing").alias("mean_spoof"), F.max("spoofing").alias("max_spoof"), F.sum("n_signals").alias("signals"), F.avg("tampering").alias("mean_tamper"))


def trend(risks: DataFrame) -> DataFrame:
    """(user_id, slope, strength, trend): least squares over the order in time; fewer than 3 are stable."""
    order = Window.partitionBy("user_id").orderBy("at", "risk")
    p = risks.withColumn("x", F.row_number().over(order) - 1).groupBy("user_id").agg(F.regr_slope("risk", "x").alias("s"), F.count("*").alias("n"))
    slope = F.when(F.col("n") >= 3, F.col("s")).otherwise(0.0)
    p = p.withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    return p.select("user_id", "slope", F.least(F.lit(1.0), F.abs("slope") * F.col("n")).alias("strength"), cases((F.col("slope") > 0.02, "rising"), (F.col("slope") < -0.02, "falling"), other="stable").alias("trend"))


def threat(history: DataFrame) -> DataFrame:
    """history (all of the above joined by user, has_drift) with likelihood, level, confidence and advice."""
    part = 0.35 * (0.5 * F.col("avg_risk") + 0.3 * F.col("max_risk") + 0.2 * F.col("high_share")) + 0.25 * (0.6 * F.col("anomaly_rate") + 0.4 * F.col("mean_anomaly")) + 0.2 * F.col("max_spoof")
    part = part + 0.1 * F.when(F.col("has_drift"), 0.5).otherwise(0.0) + 0.1 * cases((F.col("trend") == "rising", 0.3 + 0.4 * F.col("strength")), (F.col("trend") == "falling", -0.1), other=0.0)
    out = history.withColumn("threat", between(part, 0.0, 1.0))
    t = F.col("threat")
    return out.withColumns({
        "threat_level": cases((t < 0.1, "minimal"), (t < 0.25, "low"), (t < 0.45, "moderate"), (t < 0.65, "elevated"), (t < 0.85, "high"), other="critical"),
        "threat_confidence": F.least(F.lit(0.9), 0.3 + 0.6 * F.col("n_risks") / 100), "outlook": cases((t < 0.2, "calm"), (t < 0.5, "watchful"), other="tense"), "advice": cases((t < 0.4, "none"), (t < 0.7, "watch"), other="act"),
    })


# --- drift

WINDOW_WEIGHTS = {7: 0.5, 30: 0.3, 90: 0.2}


def divergence(p: Column, q: Column, *, tiny: float = 1e-10) -> Column:
    """Jensen-Shannon distance (square root of the divergence) of two arrays of 24."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    def normal(a: Column) -> Column:
        up = F.transform(a, lambda x: x + tiny)
        return F.transform(up, lambda x: x / total(up))
    p, q = normal(p), normal(q)
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda a, b: total(F.zip_with(a, b, lambda x, y: (x + tiny) * F.log((x + tiny) / (y + tiny))))
    return F.sqrt(F.greatest(F.lit(0.0), (kl(p, m) + kl(q, m)) / 2))


def relative_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(1.0)).otherwise(F.abs(new - old) / F.abs(F.when(old != 0, old)))


def bounded_change(old: Column, new: Column) -> Column:
    most = F.greatest(F.abs(old), F.abs(new))
    return F.when(most == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(new - old) / F.when(most != 0, most)))


def recent_snapshots(snapshots: DataFrame, *, kept: int = 100) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("at"))
    return snapshots.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= kept).drop("_n")


def as_of(snapshots: DataFrame, times: DataFrame, *, key: str = "user_id") -> DataFrame:
    """times (key, t, ...) with the latest snapshot (a struct) at or before t: one aggregate over both sides, no range join.

    Snapshots and times are merged in one ordered stream per key.
    """
    cols = [c for c in snapshots.columns if c != key]
    s = snapshots.select(key, F.col("at").alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("snapshot"), F.lit(None).cast(times.select(F.struct(*[c for c in times.columns if c != key])).schema[0].dataType).alias("_row"))
    q = times.select(key, F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(s.schema["snapshot"].dataType).alias("snapshot"), F.struct(*[c for c in times.columns if c != key]).alias("_row"))
    order = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(q).withColumn("snapshot", F.last("snapshot", ignorenulls=True).over(order)).filter("_side = 1").select(key, "_row.*", "snapshot")


def drift_signals(pairs: DataFrame) -> DataFrame:
    """(user_id, window, kind, severity) from pairs (old, new: snapshot structs): five tests."""
    o, n = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    speed = 0.7 * bounded_change(o("speed_mean"), n("speed_mean")) + 0.3 * bounded_change(o("speed_std"), n("speed_std"))
    adherence, regularity = F.abs(n("route_adherence") - o("route_adherence")), F.abs(n("update_regularity") - o("update_regularity"))
    timing, stops = divergence(o("hours"), n("hours")), relative_change(o("stop_count").cast("double"), n("stop_count").cast("double"))
    one = F.lit(1.0)
    make = lambda cond, kind, sev: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.least(one, sev).alias("severity")))
    found = F.array_compact(F.array(make(speed >= 0.15, "speed", speed), make(adherence >= 0.15, "route", 2 * adherence), make(timing >= 0.15, "timing", 2 * timing), make(stops >= 0.3, "stops", stops), make(regularity >= 0.15, "regularity", 2 * regularity)))
    return pairs.select("user_id", "window", F.inline(found))


def drift_scores(signals: DataFrame, users: DataFrame, *, cumulative: bool = True) -> DataFrame:
    """(user_id, w7, w30, w90, drift): mean severity per window, over the signals of that and shorter windows (cumulative) or its own; weighted."""
    sums = users.select("user_id").distinct().withColumn("window", F.explode(F.array(*[F.lit(w) for w in WINDOW_WEIGHTS])))
    per = signals.groupBy("user_id", "window").agg(F.sum("severity").alias("s"), F.count("*").alias("n"))
    sums = sums.join(per, ["user_id", "window"], "left").fillna({"s": 0.0, "n": 0})
    if cumulative:
        order = Window.partitionBy("user_id").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumns({"cs": F.sum("s").over(order), "cn": F.sum("n").over(order)})
    else:
        sums = sums.withColumns({"cs": F.col("s"), "cn": F.col("n")})
    score = F.when(F.col("cn") > 0, F.col("cs") / F.col("cn")).otherwise(0.0)
    wide = sums.withColumn("score", score).groupBy("user_id").agg(*[F.max(F.when(F.col("window") == w, F.col("score"))).alias(f"w{w}") for w in WINDOW_WEIGHTS])
    total = sum((F.col(f"w{w}") * x for w, x in WINDOW_WEIGHTS.items()), F.lit(0.0))
    return wide.withColumn("drift", total / sum(WINDOW_WEIGHTS.values()))


def drift_concern(scores: DataFrame, signals: DataFrame) -> DataFrame:
    worst = signals.groupBy("user_id").agg(F.max(F.when(F.col("kind").isin("route", "timing"), F.col("severity"))).alias("place"))
    d, sudden = F.col("drift"), F.col("w7") > 2 * F.col("w90")
    mid = (F.coalesce("place", F.lit(0.0)) > 0.4) | sudden
    level = cases((d < 0.15, "none"), (d < 0.3, "low"), (d < 0.5, F.when(mid, "moderate").otherwise("low")), (d < 0.7, F.when(mid, "high").otherwise("moderate")), other="critical")
    return scores.join(worst, "user_id", "left").withColumn("concern", level).drop("place")


def cusum(values: DataFrame, by: str, order: str, x: str, *, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """(by, change_at, largest, detected): CUSUM against the mean of the first half, by windows: c = S - min(0, min S)."""
    w = Window.partitionBy(by).orderBy(order)
    v = values.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(by))})
    v = v.withColumn("target", F.avg(F.when(F.col("i") < F.floor(F.col("n") / 2), F.col(x))).over(Window.partitionBy(by)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.when(F.col("i") > 0, F.col(x) - F.col("target") - slack).otherwise(0.0), F.when(F.col("i") > 0, F.col("target") - F.col(x) - slack).otherwise(0.0)
    v = v.withColumns({"su": F.sum(up).over(upto), "sd": F.sum(down).over(upto)})
    v = v.withColumns({"cu": F.col("su") - F.least(F.lit(0.0), F.min("su").over(upto)), "cd": F.col("sd") - F.least(F.lit(0.0), F.min("sd").over(upto))})
    top = v.groupBy(by).agg(F.max("cu").alias("u"), F.max("cd").alias("d"), F.min_by("i", F.struct(-F.round("cu", 9), "i")).alias("iu"), F.min_by("i", F.struct(-F.round("cd", 9), "i")).alias("id"))
    return top.select(by, F.when(F.col("u") >= F.col("d"), F.col("iu")).otherwise(F.col("id")).alias("change_at"), F.greatest("u", "d").alias("largest"), (F.greatest("u", "d") > limit).alias("detected"))
