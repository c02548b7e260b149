"""Features of a point against the one before it in its trip.

One shuffle on (user_id, trip_id) and one sort serve all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.functions.core import per
from wayfold.schema import MAX_NORMAL_GAP

def features(points: DataFrame) -> DataFrame:
    """points (normalized) with time_delta, update_rate, has_gap, gap_duration, distance, bearing, bearing_change,
    calc_speed, speed_diff, acceleration, is_stop and stop_duration; null where there is no point before."""
    ordered = Window.partitionBy("user_id", "trip_id").orderBy("timestamp_unix", "point_index", "event_id")
    lag = lambda c: F.lag(c).over(ordered)
    v = F.col("speed")
    out = points.withColumns({"rn": F.row_number().over(ordered), "_t": lag("timestamp_unix"), "_lat": lag("lat"), "_lon": lag("lon"), "_v": lag("speed")})
    dt = F.col("timestamp_unix") - F.col("_t")
    out = out.withColumn("time_delta", dt).withColumns({
        "update_rate": per(F.lit(1.0), F.col("time_delta")),
        "has_gap": F.coalesce(F.col("time_delta") > MAX_NORMAL_GAP, F.lit(False)),
        "gap_duration": F.when(F.col("time_delta") > MAX_NORMAL_GAP, F.col("time_delta")),
        "distance": geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")),
        "bearing": geo.bearing(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")),
        "acceleration": geo.acceleration(F.col("_v"), v, F.col("time_delta")),
    })
    out = out.withColumn("calc_speed", geo.speed(F.col("distance"), F.col("time_delta")))
    moving = F.col("is_moving") == 1
    out = out.withColumns({
        "bearing_change": geo.bearing_change(lag("bearing"), F.col("bearing")),
        "speed_diff": v - F.col("calc_speed"),
        "is_stop": F.when(F.col("rn") == 1, ~moving).otherwise(~moving | (F.col("activity") == "still") | F.coalesce(v < 0.5, F.lit(False)) | F.coalesce(F.col("calc_speed") < 0.5, F.lit(False))),
    })
    out = out.withColumn("_run", F.sum(F.when(F.col("is_stop") != F.coalesce(lag("is_stop"), ~F.col("is_stop")), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("user_id", "trip_id", "_run").orderBy("timestamp_unix", "point_index", "event_id")
    out = out.withColumn("_nth", F.row_number().over(run))
    since = F.sum(F.when(F.col("_nth") > 1, F.col("time_delta")).otherwise(0.0)).over(run.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("stop_duration", F.when(F.col("is_stop") & (F.col("rn") > 1), since))
    return out.drop("_t", "_lat", "_lon", "_v", "_run", "_nth")
