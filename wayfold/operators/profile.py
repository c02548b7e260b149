"""Behavioural profiles: hours of activity, stops, consistency, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.functions.core import cases
from wayfold.operators import zones
from wayfold.operators.places import clustered
from wayfold.operators.trips import KEYS
from wayfold.sources.staging import staged


def hour_of(t) -> object:
    return F.pmod(F.floor(t / 3600), F.lit(24)).cast("int")


def hours(points: DataFrame) -> DataFrame:
    """24 rows per user: share of points, most frequent activity (first of equals by time), mean speed, count."""
    kept = points.filter("confidence >= 0.5").withColumn("hour", hour_of(F.col("timestamp_unix")))
    counts = kept.groupBy("user_id", "hour").agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"))
    acts = kept.groupBy("user_id", "hour", "activity").agg(F.count("*").alias("c"), F.min(F.struct("timestamp_unix", "event_id")).alias("first"))
    top = acts.groupBy("user_id", "hour").agg(F.min_by("activity", F.struct(-F.col("c"), F.col("first"))).alias("activity"))
    grid = kept.groupBy("user_id").agg(F.count("*").alias("total")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    out = grid.join(counts, ["user_id", "hour"], "left").join(top, ["user_id", "hour"], "left")
    return out.select("user_id", "hour", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("probability"), F.coalesce("activity", F.lit("unknown")).alias("activity"), F.coalesce("mean_speed", F.lit(0.0)).alias("mean_speed"), F.coalesce("n", F.lit(0)).alias("n"))


def hour_probabilities(points: DataFrame) -> DataFrame:
    """(user_id, hour, probability): the shares of hours alone, those without points too."""
    counts = points.filter("confidence >= 0.5").groupBy("user_id", hour_of(F.col("timestamp_unix")).alias("hour")).agg(F.count("*").alias("n"))
    by_user = counts.groupBy("user_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("counts"))  # 24 entries at most
    grid = by_user.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.select("user_id", "hour", (F.coalesce(F.try_element_at("counts", "hour"), F.lit(0)) / F.col("total")).alias("probability"))


def stop_episodes(points: DataFrame, *, least: float = 60.0, flush_open: bool = False, per_trip: bool = False) -> DataFrame:
    """Runs of stop points over a user's trips in order; a run without a point after it is left out unless flush_open."""
    by = KEYS if per_trip else ["user_id"]
    order = Window.partitionBy(*by).orderBy("trip_id", "timestamp_unix", "point_index", "event_id")
    p = points.withColumn("_before", F.lag("is_stop").over(order)).withColumn("_run", F.sum(F.when(F.col("is_stop") != F.coalesce("_before", ~F.col("is_stop")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_last", F.max("_run").over(Window.partitionBy(*by)))
    if not flush_open:
        p = p.filter(F.col("_run") < F.col("_last"))
    runs = p.filter("is_stop").groupBy(*by, "_run").agg(F.min("timestamp_unix").alias("arrival"), F.max("timestamp_unix").alias("departure"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("points"))
    runs = runs.withColumn("duration", F.col("departure") - F.col("arrival")).filter(F.col("duration") >= least)
    return runs.select(*by, "arrival", "departure", "duration", "lat", "lon", "points", hour_of(F.col("arrival")).alias("arrival_hour"), hour_of(F.col("departure")).alias("departure_hour"))


def trip_signatures(points: DataFrame) -> DataFrame:
    s = points.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("timestamp_unix").alias("start"), F.max("timestamp_unix").alias("end"), F.coalesce(F.sum(F.when(F.col("distance") > 0, F.col("distance"))), F.lit(0.0)).alias("distance"), F.avg("speed").alias("mean_speed"),
        F.min_by("lat", "rn").alias("start_lat"), F.min_by("lon", "rn").alias("start_lon"), F.max_by("lat", "rn").alias("end_lat"), F.max_by("lon", "rn").alias("end_lon"),
    )
    return s.filter("n >= 2").withColumns({"duration": F.col("end") - F.col("start"), "start_hour": hour_of(F.col("start"))}).drop("n", "end")


def _route_id(prefix: str, *cols: str):
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(",", "user_id", *[F.format_number(F.col(c), 4) for c in cols])), 1, 8))


def routes(signatures: DataFrame, *, metres: float = 200.0) -> DataFrame:
    """Routes: clusters of two trips or more by both ends, with centres and radii."""
    ends = ["start_lat", "start_lon", "end_lat", "end_lon"]
    c = clustered(signatures, ends, metres)
    group = ["user_id", "place", "cluster"]
    own = Window.partitionBy(*group)
    c = c.withColumns({f"c_{e}": F.avg(e).over(own) for e in ends})
    c = c.withColumns({s: geo.haversine(F.col(f"c_{s}_lat"), F.col(f"c_{s}_lon"), F.col(f"{s}_lat"), F.col(f"{s}_lon")) for s in ("start", "end")})
    out = c.groupBy(*group).agg(
        *[F.first(f"c_{e}").alias(e) for e in ends], F.greatest(F.max("start"), F.lit(metres)).alias("start_radius"), F.greatest(F.max("end"), F.lit(metres)).alias("end_radius"), F.count("*").alias("frequency"),
        F.avg("duration").alias("duration"), F.avg("distance").alias("distance"), F.avg("mean_speed").alias("mean_speed"), F.min("start_hour").alias("first_hour"), F.max("start_hour").alias("last_hour"),
    )
    return out.filter("frequency >= 2").withColumn("route_id", _route_id("route_", *ends)).drop("place", "cluster")


def stops(episodes: DataFrame, *, metres: float = 100.0, least: int = 3) -> DataFrame:
    """Places of three episodes or more, with radius, mean duration and hours."""
    c = clustered(episodes, ["lat", "lon"], metres)
    group = ["user_id", "place", "cluster"]
    own = Window.partitionBy(*group)
    c = c.withColumns({"c_lat": F.avg("lat").over(own), "c_lon": F.avg("lon").over(own)}).withColumn("d", geo.haversine(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")))
    out = c.groupBy(*group).agg(
        F.first("c_lat").alias("lat"), F.first("c_lon").alias("lon"), F.greatest(F.max("d"), F.lit(metres)).alias("radius"), F.count("*").alias("frequency"), F.avg("duration").alias("duration"),
        F.array_sort(F.collect_set("arrival_hour")).alias("arrival_hours"), F.array_sort(F.collect_set("departure_hour")).alias("departure_hours"),
    )
    return out.filter(F.col("frequency") >= least).withColumn("stop_id", _route_id("stop_", "lat", "lon")).drop("place", "cluster")


def speed_consistency(points: DataFrame, base: DataFrame) -> DataFrame:
    """(user_id, speed_consistency): the smaller over the larger coefficient of variation, of all points and of the baseline."""
    s = points.groupBy("user_id").agg(F.avg("speed").alias("m"), F.stddev_pop("speed").alias("sd"), F.count("speed").alias("n"))
    out = s.join(base.select("user_id", F.col("speed.mean").alias("bm"), F.col("speed.std").alias("bs"), F.col("speed.sample_size").alias("bn")), "user_id", "left")
    cv = F.when(F.col("m") > 0, F.col("sd") / F.col("m"))
    bcv = F.when(F.col("bm") > 0, F.col("bs") / F.col("bm")).otherwise(1.0)
    value = cases(
        ((F.coalesce("bn", F.lit(0)) == 0) | (F.col("n") == 0), 0.5), (F.col("bs") == 0, F.when(F.col("sd") < 1, 1.0).otherwise(0.5)), (F.col("m") == 0, 0.5), (F.greatest(cv, bcv) == 0, 1.0), other=F.least(cv, bcv) / F.greatest(cv, bcv)
    )
    return out.select("user_id", value.alias("speed_consistency"))


def update_regularity(points: DataFrame) -> DataFrame:
    dt = F.when(F.col("time_delta") != 0, F.col("time_delta"))
    s = points.groupBy("user_id").agg(F.avg(dt).alias("m"), F.stddev_pop(dt).alias("sd"), F.count(dt).alias("n"))
    return s.select("user_id", F.when((F.col("n") < 2) | (F.col("m") == 0), 0.5).otherwise(F.least(F.lit(1.0), 1 / (1 + F.col("sd") / F.col("m")))).alias("update_regularity"))


def route_adherence(signatures: DataFrame, all_trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(user_id, route_adherence): the share of all trips with both ends in some route's zones."""
    hit = zones.met(signatures, routes).groupBy("user_id").agg(F.count_distinct("trip.trip_id").alias("hits"))
    return all_trips.select(*KEYS).distinct().groupBy("user_id").agg(F.count("*").alias("trips")).join(hit, "user_id", "left").select("user_id", (F.coalesce("hits", F.lit(0)) / F.col("trips")).alias("route_adherence"))


def profile_confidence(header: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    value = 0.3 * F.least(one, F.col("trips") / 20) + 0.3 * F.least(one, F.col("points") / 1000) + 0.4 * F.when(F.col("is_mature"), 1.0).otherwise(0.5)
    return header.select("user_id", value.alias("profile_confidence"))


def learn(points: DataFrame, base: DataFrame, *, mature_trips: int = 10, mature_points: int = 500) -> DataFrame:
    """One row per user: counts, consistency, confidence, maturity, and nested routes, stops and hours."""
    sig = staged(trip_signatures(points), "signatures")
    r, st = staged(routes(sig), "routes"), stops(stop_episodes(points))
    out = _assembled(points, sig, base, r, st, hours(points))
    return out.withColumn("is_mature", F.col("is_mature") & (F.col("trips") >= mature_trips) & (F.col("points") >= mature_points))


def _assembled(points: DataFrame, signatures: DataFrame, base: DataFrame, routes_: DataFrame, stops_: DataFrame, hours_: DataFrame) -> DataFrame:
    nested = lambda df, name: df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "user_id"]))).alias(name))
    out = base.select("user_id", "trips", "points", "is_mature")
    for part in (speed_consistency(points, base), update_regularity(points), route_adherence(signatures, points, routes_), profile_confidence(base)):
        out = out.join(part, "user_id", "left")
    for part, name in ((routes_, "routes"), (stops_, "stops"), (hours_, "hours")):
        out = out.join(nested(part, name), "user_id", "left")
    return out


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Routes or stops of both, an old one before a new one of the same id."""
    return old.unionByName(new.join(old.select("user_id", key).distinct(), ["user_id", key], "left_anti"))


def update_routes(old: DataFrame, signatures: DataFrame, *, metres: float = 200.0) -> DataFrame:
    """Known routes with the trips that came since.

    A new trip belongs to the known route whose zones hold both its ends, of
    several to that with the ends nearest; counts are added, usual duration,
    distance and speed become means over all trips, hours widen. Only trips
    beyond all known zones are clustered, into routes of their own. Zones and
    ids of known routes stay.
    """
    cols = old.columns
    nearest = F.struct((F.col("start_distance") + F.col("end_distance")).alias("d"), F.col("zone.route_id").alias("route_id"))
    taken = staged(zones.met(signatures, old).groupBy("user_id", "trip.trip_id").agg(F.min(nearest).alias("n"), F.first("trip").alias("trip")), "taken")
    added = taken.groupBy("user_id", F.col("n.route_id").alias("route_id")).agg(
        F.count("*").alias("_n"), *[F.sum(f"trip.{c}").alias(f"_{c}") for c in ("duration", "distance", "mean_speed")], *[F.count(f"trip.{c}").alias(f"_n_{c}") for c in ("duration", "distance", "mean_speed")],
        F.min("trip.start_hour").alias("_first"), F.max("trip.start_hour").alias("_last"),
    )
    n = F.coalesce("_n", F.lit(0))
    mean = lambda c: F.when(F.coalesce(f"_n_{c}", F.lit(0)) > 0, (F.col(c) * F.col("frequency") + F.col(f"_{c}")) / (F.col("frequency") + F.col(f"_n_{c}"))).otherwise(F.col(c))
    known = old.join(added, ["user_id", "route_id"], "left").withColumns({c: mean(c) for c in ("duration", "distance", "mean_speed")})
    known = known.withColumns({"frequency": F.col("frequency") + n, "first_hour": F.least("first_hour", "_first"), "last_hour": F.greatest("last_hour", "_last")})
    rest = signatures.join(taken.select("user_id", "trip_id"), ["user_id", "trip_id"], "left_anti")
    return merge(known.select(*cols), routes(rest, metres=metres).select(*cols), "route_id")


def update(old: DataFrame, points: DataFrame, base: DataFrame) -> DataFrame:
    """Profiles of `learn` with the points that came since: routes as in update_routes, stops of both, hours and consistency of the new points, counts of all.

    base: baselines of all points (user_id, trips, points, is_mature, speed).
    Users of only one side keep what that side says.
    """
    sig = trip_signatures(points)
    unnested = lambda name: old.select("user_id", F.explode(name).alias("v")).select("user_id", "v.*")
    r = staged(update_routes(unnested("routes"), sig), "routes")
    st = merge(unnested("stops"), stops(stop_episodes(points)).select(*unnested("stops").columns), "stop_id")
    now = _assembled(points, sig, base, r, st, hours(points))
    seen = points.select("user_id").distinct()
    quiet = old.join(seen, "user_id", "left_anti")
    return now.join(seen, "user_id", "left_semi").select(*old.columns).unionByName(quiet)


def summary(profiles: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return profiles.select("user_id", "trips", "points", "is_mature", n("routes").alias("n_routes"), n("stops").alias("n_stops"), F.size(F.filter("hours", lambda h: h["n"] > 0)).alias("active_hours"), "profile_confidence")
