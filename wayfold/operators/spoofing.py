"""Spoofing and tampering: signals per check in long form, and session scores from them.

Signals: (user_id, trip_id, source, kind, idx, likelihood). idx is the place
of the point in its trip, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.core import cases

KEYS = ["user_id", "trip_id"]
WEIGHTS = {"physical": 0.3, "timestamp": 0.2, "accuracy": 0.1, "synthetic": 0.15, "pattern": 0.25}
#: Kinds of the synthetic checks by the group that a session score puts them in.
SYNTHETIC = ("regular_timing", "perfect_line", "identical_coordinates")


def indexed(points: DataFrame) -> DataFrame:
    return points.withColumn("idx", F.col("rn") - 1)


def _order() -> object:
    return Window.partitionBy(*KEYS).orderBy("idx")


def _signal(kind: str, likelihood: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), likelihood.alias("likelihood"))


def _signals(checks: dict[str, Column]) -> Column:
    """An array of the signals among likelihoods that aren't null."""
    return F.array_compact(F.array(*[F.when(likelihood.isNotNull(), _signal(kind, likelihood)) for kind, likelihood in checks.items()]))


def physical_checks() -> dict[str, Column]:
    v, c, a, one = F.col("speed"), F.col("calc_speed"), F.abs("acceleration"), F.lit(1.0)
    return {
        "impossible_speed": F.when(v > 300, F.least(one, v / 600)),
        "teleportation": F.when(c > 360, F.least(one, (c / 300 - 1) / 2)),
        "impossible_acceleration": F.when(a > 15, F.least(one, a / 15 - 1)),
    }


def physical(points: DataFrame) -> DataFrame:
    return points.select(*KEYS, F.lit("physical").alias("source"), "idx", F.inline(_signals(physical_checks())))


def repeated_teleports(points: DataFrame) -> DataFrame:
    """For each teleport the first 10 within 10 places on; three or more make a signal for every member (kept as often as it is one)."""
    jumps = points.filter("calc_speed > 360").select(*KEYS, "idx")
    ahead = Window.partitionBy(*KEYS).orderBy("idx").rangeBetween(0, 10)
    starts = jumps.withColumn("members", F.slice(F.sort_array(F.collect_list("idx").over(ahead)), 1, 10)).filter(F.size("members") >= 3)
    return starts.select(*KEYS, F.lit("physical").alias("source"), F.explode("members").alias("idx"), F.lit("repeated_teleportation").alias("kind"), F.least(F.lit(1.0), F.size("members") / 10.0).alias("likelihood"))


def clock_checks(gap: Column) -> dict[str, Column]:
    return {"clock_set_back": F.when(gap < -1, F.least(F.lit(1.0), F.abs(gap) / 60)), "long_silence": F.when(gap > 3000, F.lit(0.3))}


def timestamps(events: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """Clocks set back by more than a second, and gaps above 3000 s, in order of arrival."""
    order = Window.partitionBy(*KEYS).orderBy(arrival, "copy_no", "event_id")
    gap = F.col("timestamp_unix") - F.lag("timestamp_unix").over(order)
    e = events.withColumns({"idx": F.row_number().over(order) - 1, "gap": gap})
    return e.select(*KEYS, F.lit("timestamp").alias("source"), "idx", F.inline(_signals(clock_checks(F.col("gap")))))


def with_accuracy(points: DataFrame) -> DataFrame:
    """points with acc, how much worse than before it is (ratio), and whether it and the next four are bad."""
    p = points.withColumn("acc", F.coalesce("coords_accuracy", F.lit(50.0)))
    before, ahead = F.lag("acc").over(_order()), _order().rowsBetween(0, 4)
    return p.withColumns({"ratio": F.when(before > 0, F.col("acc") / before), "bad": (F.count("*").over(ahead) == 5) & (F.min("acc").over(ahead) >= 100)})


def accuracy_checks() -> dict[str, Column]:
    ratio = F.col("ratio")
    return {"accuracy_drop": F.when(ratio >= 5, F.least(F.lit(1.0), (ratio - 1) / 10)), "accuracy_lost": F.when(F.col("bad"), F.lit(0.4))}


def accuracy(points: DataFrame) -> DataFrame:
    return with_accuracy(points).select(*KEYS, F.lit("accuracy").alias("source"), "idx", F.inline(_signals(accuracy_checks())))


def identical_coordinates(points: DataFrame) -> DataFrame:
    """Places (6 decimals) met three times or more, not all in a row; the groups are joined back to their points."""
    p = points.select(*KEYS, "idx", F.round("lat", 6).alias("la"), F.round("lon", 6).alias("lo"))
    groups = p.groupBy(*KEYS, "la", "lo").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).filter((F.col("n") >= 3) & (F.col("b") - F.col("a") + 1 != F.col("n")))
    return p.join(groups, [*KEYS, "la", "lo"]).select(*KEYS, F.lit("synthetic").alias("source"), "idx", F.lit("identical_coordinates").alias("kind"), F.least(F.lit(1.0), F.col("n") / 10.0).alias("likelihood"))


def with_line(points: DataFrame) -> DataFrame:
    """points with worst: the largest distance of this and the next four from a straight line in the index; null where they are fewer or hardly move."""
    order = _order()
    p = points.withColumns({f"{c}{i}": F.lead(c, i).over(order) for c in ("lat", "lon") for i in range(5)})
    found, moves = [], F.col("lat4").isNotNull()
    for c in ("lat", "lon"):
        y = [F.col(f"{c}{i}") for i in range(5)]
        moves = moves & (F.size(F.array_distinct(F.array(*y))) > 2)
        mean, slope = (y[0] + y[1] + y[2] + y[3] + y[4]) / 5, (-2 * y[0] - y[1] + y[3] + 2 * y[4]) / 10
        found += [F.abs(y[i] - mean - (i - 2) * slope) for i in range(5)]
    return p.withColumn("worst", F.when(moves, F.greatest(*found))).drop(*[f"{c}{i}" for c in ("lat", "lon") for i in range(5)])


def line_check(most: float = 0.001) -> Column:
    return F.when(F.col("worst") < most, 1 - F.col("worst") / most)


def perfect_lines(points: DataFrame, *, most: float = 0.001) -> DataFrame:
    """Windows of five points whose latitude and longitude are straight in the index; the signal stands at the middle."""
    p = with_line(points.select(*KEYS, "idx", "lat", "lon")).withColumn("likelihood", line_check(most)).filter("likelihood is not null")
    return p.select(*KEYS, F.lit("synthetic").alias("source"), (F.col("idx") + 2).alias("idx"), F.lit("perfect_line").alias("kind"), "likelihood")


def regular_timing(points: DataFrame) -> DataFrame:
    dt = F.when(F.col("time_delta") > 0, F.col("time_delta"))
    s = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count(dt).alias("k"), F.avg(dt).alias("mean"), F.stddev_pop(dt).alias("std")).filter("n >= 10 and k >= 5 and mean > 0")
    cv = F.col("std") / F.col("mean")
    return s.filter(cv < 0.05).select(*KEYS, F.lit("synthetic").alias("source"), F.floor(F.col("n") / 2).cast("int").alias("idx"), F.lit("regular_timing").alias("kind"), (1 - cv / 0.05).alias("likelihood"))


def integrity(events: DataFrame) -> DataFrame:
    """Missing and repeated point indexes of a session."""
    per_index = events.groupBy(*KEYS, "point_index").agg(F.count("*").alias("c"))
    s = per_index.groupBy(*KEYS).agg(F.sum("c").alias("n"), (F.max("point_index") - F.min("point_index") + 1).alias("expected"), F.count("*").alias("found"), F.count_if(F.col("c") > 1).alias("repeated")).filter("n >= 2")
    missing = F.col("expected") - F.col("found")
    found = F.array_compact(F.array(
        F.when(missing > 0, _signal("missing_points", F.least(F.lit(1.0), 2 * missing / F.col("expected")))), F.when(F.col("repeated") > 0, _signal("repeated_points", F.least(F.lit(1.0), F.col("repeated") / F.col("n"))))
    ))
    return s.select(*KEYS, F.lit("integrity").alias("source"), F.lit(0).alias("idx"), F.inline(found))


COLUMNS = [*KEYS, "source", "kind", "idx", "likelihood"]


def session_signals(points: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """All signals of sessions. events: what arrived, with its order; else the points count as such."""
    p = indexed(points)
    e = p.withColumns({"arrival_seq": F.col("point_index"), "copy_no": F.lit(0)}) if events is None else events
    parts = [physical(p), repeated_teleports(p), timestamps(e), accuracy(p), identical_coordinates(p), perfect_lines(p), regular_timing(p), integrity(e)]
    out = parts[0].select(COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(COLUMNS))
    return out


def session_scores(signals: DataFrame) -> DataFrame:
    """(user_id, trip_id, spoofing, tampering, integrity, n_signals): weighted mean of the groups' largest likelihoods over the groups present."""
    group = cases((F.col("source") == "integrity", "pattern"), other=F.col("source"))
    tops = signals.withColumn("grp", group).groupBy(*KEYS, "grp").agg(F.max("likelihood").alias("top"), F.count("*").alias("n"))
    weight = cases(*[(F.col("grp") == g, w) for g, w in WEIGHTS.items()])
    tops = tops.withColumn("w", weight)
    tamper = F.greatest(F.max(F.when(F.col("grp").isin("timestamp", "pattern"), F.col("top"))), F.lit(0.0))
    return tops.groupBy(*KEYS).agg((F.sum(F.col("w") * F.col("top")) / F.sum("w")).alias("spoofing"), tamper.alias("tampering"), F.min(1 - F.col("top")).alias("integrity"), F.sum("n").alias("n_signals"))


def session_tops(points: DataFrame) -> DataFrame:
    """Per session `tops`, a struct (top, n) per group of checks: its largest likelihood (null: no signal) and how many signals it has.

    The same checks as in long form, with the points as what arrived, but in
    one shuffle: all windows and the aggregate go by session.
    """
    p = indexed(points).select(*KEYS, "idx", "event_id", "point_index", "timestamp_unix", "time_delta", "speed", "calc_speed", "acceleration", "coords_accuracy", "lat", "lon")
    p = with_line(with_accuracy(p))
    jump = F.col("calc_speed") > 360
    ahead = Window.partitionBy(*KEYS).orderBy("idx").rangeBetween(0, 10)
    p = p.withColumn("jumps", F.when(jump, F.least(F.lit(10), F.count_if(jump).over(ahead))))
    place = Window.partitionBy(*KEYS, "la", "lo")
    p = p.withColumns({"la": F.round("lat", 6), "lo": F.round("lon", 6)})
    p = p.withColumns({"same": F.count("*").over(place), "apart": (F.count("*").over(place) >= 3) & (F.max("idx").over(place) - F.min("idx").over(place) + 1 != F.count("*").over(place))})
    arrival = Window.partitionBy(*KEYS).orderBy("point_index", "event_id")
    one, two = F.lag("point_index", 1).over(arrival), F.lag("point_index", 2).over(arrival)
    p = p.withColumns({
        "gap": F.col("timestamp_unix") - F.lag("timestamp_unix").over(arrival),
        "second": F.coalesce((F.col("point_index") == one) & ~F.coalesce(F.col("point_index") == two, F.lit(False)), F.lit(False)),
        "new": F.coalesce(F.col("point_index") != one, F.lit(True)),
    })
    repeated = F.when(F.col("jumps") >= 3, F.least(F.lit(1.0), F.col("jumps") / 10.0))
    same = F.when(F.col("apart"), F.least(F.lit(1.0), F.col("same") / 10.0))
    groups = {
        "physical": [*physical_checks().values(), repeated], "timestamp": list(clock_checks(F.col("gap")).values()), "accuracy": list(accuracy_checks().values()), "synthetic": [same, line_check()],
    }
    dt, many = F.when(F.col("time_delta") > 0, F.col("time_delta")), F.when(F.col("jumps") >= 3, F.col("jumps") - 1)
    found = p.groupBy(*KEYS).agg(
        *[F.max(F.array_max(F.array(*c))).alias(f"{g}_top") for g, c in groups.items()],
        *[F.sum(F.size(F.array_compact(F.array(*c))) + (F.coalesce(many, F.lit(0)) if g == "physical" else 0)).alias(f"{g}_n") for g, c in groups.items()],
        F.count("*").alias("n"), F.count(dt).alias("k"), F.avg(dt).alias("mean"), F.stddev_pop(dt).alias("std"), (F.max("point_index") - F.min("point_index") + 1).alias("expected"), F.count_if("new").alias("found"), F.count_if("second").alias("repeated"),
    )
    cv, missing = F.col("std") / F.col("mean"), F.col("expected") - F.col("found")
    regular = F.when((F.col("n") >= 10) & (F.col("k") >= 5) & (F.col("mean") > 0) & (cv < 0.05), 1 - cv / 0.05)
    lost = F.when((F.col("n") >= 2) & (missing > 0), F.least(F.lit(1.0), 2 * missing / F.col("expected")))
    twice = F.when((F.col("n") >= 2) & (F.col("repeated") > 0), F.least(F.lit(1.0), F.col("repeated") / F.col("n")))
    more = {"synthetic": [regular], "pattern": [lost, twice]}

    def group(g: str) -> Column:
        own, late = [F.col(f"{g}_top")] if g in groups else [], more.get(g, [])
        n = (F.col(f"{g}_n") if own else F.lit(0)) + (F.size(F.array_compact(F.array(*late))) if late else 0)
        return F.struct(F.array_max(F.array(*own, *late)).alias("top"), n.alias("n")).alias(g)

    return found.select(*KEYS, F.struct(*[group(g) for g in WEIGHTS]).alias("tops"))


def scores_of_tops(tops: DataFrame) -> DataFrame:
    """session_scores from session_tops; null scores where there is no signal."""
    top = {g: F.col(f"tops.{g}.top") for g in WEIGHTS}
    total = lambda parts: sum(parts[1:], parts[0])
    weighted = total([F.coalesce(w * top[g], F.lit(0.0)) for g, w in WEIGHTS.items()]) / total([F.when(top[g].isNotNull(), w).otherwise(0.0) for g, w in WEIGHTS.items()])
    n = total([F.col(f"tops.{g}.n") for g in WEIGHTS]).cast("long")
    return tops.select(
        *KEYS, F.when(n > 0, weighted).alias("spoofing"), F.greatest(top["timestamp"], top["pattern"], F.lit(0.0)).alias("tampering"), F.when(n > 0, 1 - F.array_max(F.array(*top.values()))).alias("integrity"), n.alias("n_signals")
    )


def sessions(points: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """session_scores of every session, zeros without signals. events: what arrived, with its order; else the points count as such."""
    if events is None:
        out = scores_of_tops(session_tops(points))
    else:
        out = points.select(*KEYS).distinct().join(session_scores(session_signals(points, events)), KEYS, "left")
    out = out.fillna({"spoofing": 0.0, "tampering": 0.0, "integrity": 1.0, "n_signals": 0})
    return out.withColumn("requires_attention", (F.col("spoofing") >= 0.5) | (F.col("tampering") >= 0.5))


def point_scores(points: DataFrame) -> DataFrame:
    """points with spoof_likelihood, the largest of the physical checks."""
    v, c, a = F.col("speed"), F.col("calc_speed"), F.abs("acceleration")
    best = F.greatest(F.when(v > 300, v / 600), F.when(c > 360, (c / 300 - 1) / 2), F.when(a > 15, a / 15 - 1), F.lit(0.0))
    return points.withColumn("spoof_likelihood", F.least(F.lit(1.0), best))


def tampering(points: DataFrame, events: DataFrame) -> DataFrame:
    """Timestamps, integrity, and sessions without any accuracy or speed; spoofing counts half of it."""
    empty = points.groupBy(*KEYS).agg(F.count("coords_accuracy").alias("accs"), F.count("speed").alias("speeds"))
    found = F.array_compact(F.array(F.when(F.col("accs") == 0, _signal("no_accuracy", F.lit(0.5))), F.when(F.col("speeds") == 0, _signal("no_speed", F.lit(0.4)))))
    missing = empty.select(*KEYS, F.lit("missing").alias("source"), F.lit(0).alias("idx"), F.inline(found))
    all_ = timestamps(events).select(COLUMNS).unionByName(integrity(events).select(COLUMNS)).unionByName(missing.select(COLUMNS))
    top = all_.groupBy(*KEYS).agg(F.max("likelihood").alias("tampering"))
    return points.select(*KEYS).distinct().join(top, KEYS, "left").fillna({"tampering": 0.0}).withColumn("spoofing", 0.5 * F.col("tampering"))


def query(found: DataFrame) -> DataFrame:
    """Per user the largest scores over sessions, and how many need a look."""
    return found.groupBy("user_id").agg(F.max("spoofing").alias("spoofing"), F.max("tampering").alias("tampering"), F.min("integrity").alias("integrity"), F.count_if("requires_attention").alias("to_review"))
