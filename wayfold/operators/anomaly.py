"""Anomaly detection: z-scores, histograms, physical limits, isolation forest, ensemble, low-confidence runs.

All fitted parameters are keyed by user.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from wayfold.functions.core import cases, let
from wayfold.operators.baseline import wide

KEYS = ["user_id", "trip_id"]
Z_COLUMNS = ("speed", "calc_speed", "acceleration", "time_delta", "distance")
HBOS_COLUMNS = ("speed", "calc_speed", "acceleration", "time_delta")


def feature_vector(points: DataFrame) -> DataFrame:
    """Points with the seven features of the isolation forest; null counts as 0, a missing accuracy as 50."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return points.withColumn("x", F.array(zero("speed"), zero("calc_speed"), zero("acceleration"), zero("time_delta"), zero("distance"), F.coalesce("coords_accuracy", F.lit(50.0)), F.col("confidence")))


def fit_z(points: DataFrame, *, least: int = 30) -> DataFrame:
    """(user_id, feature, mean, std), population std; zeros count for speed only; null for users with fewer points than `least`."""
    value = lambda c: F.col(c) if c == "speed" else F.when(F.col(c) != 0, F.col(c))
    rows = points.select("user_id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in Z_COLUMNS])))
    fit = rows.groupBy("user_id", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    return fit.select("user_id", "feature", F.when(F.col("n") >= least, F.col("mean")).alias("mean"), F.when(F.col("n") >= least, F.col("std")).alias("std"))


def z(v: Column, mean: Column, std: Column) -> Column:
    """Null where v or the fit is missing; 5 for another value than the only one."""
    return F.when(v.isNotNull() & mean.isNotNull(), F.when(std > 0, (v - mean) / F.when(std > 0, std)).otherwise(F.when(v == mean, 0.0).otherwise(5.0)))


def z_from_baseline(points: DataFrame, base: DataFrame) -> DataFrame:
    """points with z_speed and z_time from baselines; the time scale is the inverse of the rate's mean and std."""
    b = base.select("user_id", F.col("speed.mean").alias("_m"), F.col("speed.std").alias("_s"), F.col("update_rate.mean").alias("_rm"), F.col("update_rate.std").alias("_rs"))
    out = points.join(b, "user_id", "left")
    mean_t = F.when(F.col("_rm") > 0, 1 / F.when(F.col("_rm") > 0, F.col("_rm"))).otherwise(5.0)
    std_t = F.when(F.col("_rs") > 0, 1 / F.when(F.col("_rs") > 0, F.col("_rs"))).otherwise(2.0)
    return out.withColumns({"z_speed": z(F.col("speed"), F.col("_m"), F.col("_s")), "z_time": z(F.col("time_delta"), mean_t, std_t)}).drop("_m", "_s", "_rm", "_rs")


def z_score(points: DataFrame) -> DataFrame:
    """points (z_speed, z_time) with z_max over the flagged ones and stat_score."""
    speed, time = F.col("z_speed"), F.col("z_time")
    flagged = F.greatest(F.when(F.abs(speed) > 3, F.abs(speed)), F.when(time > 3, time), F.lit(0.0))
    score = F.when(flagged <= 3, flagged / 6).otherwise(F.least(F.lit(1.0), 0.5 + (flagged - 3) / 6))
    return points.withColumn("z_max", flagged).withColumn("stat_score", F.when(flagged <= 3, flagged / 6).otherwise(score))


def hbos_value(c: str) -> Column:
    """What a histogram counts: zeros for speed only."""
    return F.col(c) if c == "speed" else F.when(F.col(c) != 0, F.col(c))


def hbos_ends() -> list[Column]:
    """Aggregates that the histograms begin with: n_points, and least value, greatest and number by feature."""
    return [F.count("*").alias("n_points"), *[f(hbos_value(c)).alias(f"{n}_{c}") for c in HBOS_COLUMNS for n, f in (("a", F.min), ("b", F.max), ("n", F.count))]]


def fit_hbos_arrays(points: DataFrame, ends: DataFrame | None = None, *, least: int = 50, bins: int = 20) -> DataFrame:
    """(user_id, fits): per user with enough points, and feature with enough values, a struct (feature, low, width, densities) of `bins` densities plus 0.1, made to sum to 1.

    ends: (user_id and hbos_ends), where these are known already.
    """
    value = {c: hbos_value(c) for c in HBOS_COLUMNS}
    ends = points.groupBy("user_id").agg(*hbos_ends()) if ends is None else ends

    def end(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        low, high = F.when(a < b, a).otherwise(a - 0.5), F.when(a < b, b).otherwise(b + 0.5)
        return F.when(F.col(f"n_{c}") >= 10, F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), low.alias("low"), ((high - low) / bins).alias("width")))

    ends = ends.filter(F.col("n_points") >= least).select("user_id", *[end(c).alias(f"end_{c}") for c in HBOS_COLUMNS])

    def key(c: str) -> Column:
        """The number of the value's bin among those of all features; null without a value or a fit."""
        bin_ = F.floor((value[c] - F.col(f"end_{c}.low")) / F.col(f"end_{c}.width")).cast("int")
        return F.when(bin_.isNotNull(), F.least(bin_, F.lit(bins - 1)) + bins * HBOS_COLUMNS.index(c))

    rows = points.select("user_id", *HBOS_COLUMNS).join(ends, "user_id").select("user_id", F.explode(F.array_compact(F.array(*[key(c) for c in HBOS_COLUMNS]))).alias("key"))
    counts = rows.groupBy("user_id", "key").agg(F.count("*").alias("c"))
    counts = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "c"))).alias("counts"))  # a row per bin

    def fit(c: str) -> Column:
        e = F.col(f"end_{c}")
        raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("counts", b + bins * HBOS_COLUMNS.index(c)), F.lit(0)) / (e["n"] * e["width"]) + 0.1)
        part = let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda t, x: t + x), lambda total: F.transform(r, lambda x: x / total)))
        return F.when(e.isNotNull(), F.struct(e["feature"].alias("feature"), e["low"].alias("low"), e["width"].alias("width"), part.alias("densities")))

    return ends.join(counts, "user_id").select("user_id", F.array_compact(F.array(*[fit(c) for c in HBOS_COLUMNS])).alias("fits"))


def fit_hbos(points: DataFrame, **options: int) -> DataFrame:
    """The same in long form: (user_id, feature, low, width, bin, density, top)."""
    rows = fit_hbos_arrays(points, **options).select("user_id", F.inline("fits"))
    return rows.select("user_id", "feature", "low", "width", F.array_max("densities").alias("top"), F.posexplode("densities").alias("pos", "density")).withColumn("bin", F.col("pos") + 1).select("user_id", "feature", "low", "width", "bin", "density", "top")


def with_hbos(points: DataFrame, fit: DataFrame) -> DataFrame:
    """points with hbos_score, looked up in the user's arrays: mean of 1 - density / top over scores above 0; a value on an edge goes to the lower bin; a missing value scores 0.5; null without a fit."""

    def score(f: Column) -> Column:
        v = F.when(F.lit(False), 0.0)
        for c in HBOS_COLUMNS:
            v = F.when(f["feature"] == c, F.col(c)).otherwise(v)
        bin_ = F.greatest(F.lit(1), F.least(F.size(f["densities"]), F.ceil((v - f["low"]) / f["width"]).cast("int")))
        return F.when(v.isNull(), 0.5).otherwise(1 - F.element_at(f["densities"], bin_) / F.array_max(f["densities"]))

    scores = F.filter(F.transform("fits", score), lambda x: x > 0)
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda t, x: t + x) / F.size(scores)).otherwise(0.0)
    return points.join(fit, "user_id", "left").withColumn("hbos_score", F.when(F.size("fits") > 0, mean)).drop("fits")


def hbos_score(points: DataFrame, fit: DataFrame) -> DataFrame:
    """(event_id, hbos_score) of the users that have a fit (fit_hbos_arrays)."""
    return with_hbos(points, fit).filter("hbos_score is not null").select("event_id", "hbos_score")


def physical(points: DataFrame) -> DataFrame:
    """points with violates_physics: reported speed above 300, acceleration above 30, calculated speed above 450."""
    return points.withColumn("violates_physics", F.coalesce(F.col("speed") > 300, F.lit(False)) | F.coalesce(F.abs("acceleration") > 30, F.lit(False)) | F.coalesce(F.col("calc_speed") > 450, F.lit(False)))


#: What the ensemble weighs, by score column. Fixed values.
WEIGHTS = {"iso_score": 0.3, "stat_score": 0.4, "hbos_score": 0.2}


def ensemble(points: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """points (violates_physics and the weights' columns) with anomaly_score and is_anomalous."""
    mixed = F.least(F.lit(1.0), sum((w * F.coalesce(c, F.lit(0.0)) for c, w in (weights or WEIGHTS).items()), F.lit(0.0)))
    return points.withColumn("anomaly_score", F.when(F.col("violates_physics"), 1.0).otherwise(mixed)).withColumn("is_anomalous", F.col("anomaly_score") >= 0.5)


class Detector(Protocol):
    """What can be plugged in: scored points to (event_id, score), a score from 0 to 1 or null; events may be missing."""

    def __call__(self, points: DataFrame) -> DataFrame: ...


class Detectors:
    """Named detectors, each with its weight beside the built-in ones."""

    def __init__(self):
        self.known: dict[str, tuple[Detector, float]] = {}

    def register(self, name: str, detector: Detector, weight: float) -> None:
        if not name.isidentifier() or f"{name}_score" in WEIGHTS or name in self.known:
            raise ValueError(f"a detector can't be named {name}")
        if not 0 <= weight <= 1:
            raise ValueError("weights lie between 0 and 1")
        self.known[name] = (detector, weight)

    def scored(self, points: DataFrame) -> DataFrame:
        """points with a column <name>_score for each detector; of several scores of an event the highest."""
        for name, (detector, _) in self.known.items():
            found = detector(points).groupBy("event_id").agg(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score").cast("double")))).alias(f"{name}_score"))
            points = points.join(found, "event_id", "left")
        return points

    def weights(self) -> dict[str, float]:
        return WEIGHTS | {f"{name}_score": w for name, (_, w) in self.known.items()}


@udtf(returnType="event_id bigint, score double")
class Zigzag:
    """A detector as a table function over a trip's points in order: points where the heading turns back and forth, by more than 120 degrees each time."""

    def __init__(self):
        self.before: tuple[int, float] | None = None

    def eval(self, row: Row):
        turn = row["bearing_change"]
        if turn is not None and abs(turn) > 120:
            if self.before and self.before[1] * turn < 0:
                yield row["event_id"], min(1.0, abs(turn) / 180)
            self.before = (row["event_id"], turn)
        else:
            self.before = None


def zigzags(points: DataFrame) -> DataFrame:
    """The detector over `bearing_change` of points, trip by trip."""
    rows = points.select(*KEYS, "timestamp_unix", "point_index", "event_id", "bearing_change")
    return Zigzag(rows.asTable().partitionBy(*KEYS).orderBy("timestamp_unix", "point_index", "event_id"))


def low_confidence_runs(points: DataFrame, *, size: int = 5) -> DataFrame:
    """points with low_runs (windows of `size` rows with mean confidence below 0.5 that hold the row), each of which adds 0.1 to the score."""
    order = Window.partitionBy(*KEYS).orderBy("timestamp_unix", "point_index", "event_id")
    ahead = order.rowsBetween(0, size - 1)
    low = F.when((F.count("*").over(ahead) == size) & (F.avg("confidence").over(ahead) < 0.5 - 1e-9), 1).otherwise(0)
    out = points.withColumn("_low", low).withColumn("low_runs", F.sum("_low").over(order.rowsBetween(1 - size, 0))).drop("_low")
    score = F.least(F.lit(1.0), F.col("anomaly_score") + 0.1 * F.col("low_runs"))
    return out.withColumn("is_anomalous", F.col("is_anomalous") | (F.when(F.col("low_runs") > 0, score).otherwise(0.0) >= 0.5)).withColumn("anomaly_score", score)


def signals(points: DataFrame) -> DataFrame:
    """Long form: (keys, kind, severity)."""
    one = lambda condition, kind, severity: F.when(condition, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    calm = ~F.col("violates_physics")
    found = F.array_compact(F.array(
        one(F.col("speed") > 300, "impossible_speed", F.lit(1.0)), one(F.abs("acceleration") > 30, "impossible_acceleration", F.lit(1.0)), one(F.col("calc_speed") > 450, "teleportation", F.lit(1.0)),
        one(calm & (F.abs("z_speed") > 3), "unusual_speed", F.least(F.lit(1.0), F.abs("z_speed") / 6)), one(calm & (F.col("z_time") > 3), "unusual_gap", F.least(F.lit(1.0), F.col("z_time") / 6)),
        one(calm & (F.coalesce("hbos_score", F.lit(0.0)) > 0.7), "unusual_pattern", F.col("hbos_score")), one(calm & (F.coalesce("iso_score", F.lit(0.0)) > 0.5), "isolated", F.col("iso_score")),
        one(F.col("low_runs") > 0, "low_confidence_sequence", F.least(F.lit(1.0), 0.1 * F.col("low_runs"))),
    ))
    return points.select(*KEYS, "point_index", "event_id", F.inline(found))


def detect(points: DataFrame, base: DataFrame | None = None, iso: DataFrame | None = None, detectors: Detectors | None = None, fits: DataFrame | None = None) -> DataFrame:
    """Scored points with everything above. iso: (event_id, iso_score), else the points' own iso_score, else 0; detectors: further ones, which the ensemble weighs too; fits: histograms, if known."""
    base = wide(points) if base is None else base
    out = z_score(z_from_baseline(physical(points), base))
    out = with_hbos(out, fit_hbos_arrays(points) if fits is None else fits)
    if iso is not None:
        out = out.drop("iso_score").join(iso, "event_id", "left")
    elif "iso_score" not in out.columns:
        out = out.withColumn("iso_score", F.lit(0.0))
    if detectors is None:
        return low_confidence_runs(ensemble(out))
    return low_confidence_runs(ensemble(detectors.scored(out), detectors.weights()))


def query(detected: DataFrame, *, trip_id: int | None = None, sensitivity: float = 0.0) -> DataFrame:
    """Per user: points, anomalous points of at least the given score, and their rate."""
    found = detected if trip_id is None else detected.filter(F.col("trip_id") == trip_id)
    hit = F.col("is_anomalous") & (F.col("anomaly_score") >= sensitivity)
    return found.groupBy("user_id").agg(F.count("*").alias("points"), F.count_if(hit).alias("anomalies"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate"))


def severity(score: Column) -> Column:
    return cases((score >= 0.8, "critical"), (score >= 0.5, "high"), (score >= 0.3, "medium"), other="low")
