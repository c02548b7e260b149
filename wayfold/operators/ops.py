"""Operational figures from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from wayfold.functions.core import cases, names_where


def inference_stats(log: DataFrame, *, last: int = 1000) -> DataFrame:
    """Per model over its last calls (model, at, time_ms, success): mean, percentiles, calls per second, error rate."""
    order = Window.partitionBy("model").orderBy(F.desc("at"), F.desc("call_id"))
    r = log.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= last)
    p = F.percentile("time_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = r.groupBy("model").agg(F.count("*").alias("calls"), F.avg("time_ms").alias("mean_ms"), p.alias("_p"), (F.count("*") / F.greatest(F.lit(1.0), F.sum("time_ms") / 1000)).alias("throughput"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"))
    return out.select("model", "calls", "mean_ms", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))], "throughput", "error_rate")


def gpu_cost(usage: DataFrame, as_of: str, budget: float) -> DataFrame:
    """Hours and spend of the month of as_of (usage: start, end, instance_type, hourly_cost), its projection and alert."""
    now = F.lit(as_of).cast("timestamp")
    month = usage.filter((F.col("start") >= F.date_trunc("month", now)) & (F.col("start") <= now))
    hours = (F.unix_timestamp("end") - F.unix_timestamp("start")) / 3600
    s = month.agg(F.coalesce(F.sum(hours), F.lit(0.0)).alias("hours"), F.coalesce(F.sum(hours * F.col("hourly_cost")), F.lit(0.0)).alias("spend"))
    s = s.withColumn("projected", F.col("spend") / F.dayofmonth(now) * F.dayofmonth(F.last_day(now)))
    used = F.col("spend") / budget
    return s.withColumns({"used": used, "alert": cases((used >= 1, "over_budget"), (used >= 0.8, "critical"), (used >= 0.6, "warning"), other="ok")})


def gpu_advice(cost: DataFrame, as_of: str, budget: float, *, least: float, hourly: float) -> DataFrame:
    """gpu_cost's row with what to do: hours a day that are missing to reach `least` by the month's end, and names of steps."""
    now = F.lit(as_of).cast("timestamp")
    days = F.dayofmonth(F.last_day(now)) - F.dayofmonth(now)
    short = F.when(F.col("projected") < least, (least - F.col("spend")) / hourly)
    steps = names_where(use_more=short.isNotNull(), stop_what_can_wait=F.col("spend") >= budget, expect_overspend=F.col("projected") > 1.1 * budget)
    return cost.withColumns({"missing_hours": short, "missing_hours_a_day": F.when(days > 0, short / days), "advice": F.array_join(steps, ",")})


INTERVALS = {"hourly": 3600, "daily": 86400, "weekly": 7 * 86400, "monthly": 30 * 86400}


def retraining_due(models: DataFrame, now: float) -> DataFrame:
    """models (model, schedule, trained_at in seconds) with when they are to be trained next, and whether that is due; an unknown schedule never is."""
    step = cases(*[(F.col("schedule") == n, s) for n, s in INTERVALS.items()])
    return models.withColumn("next_at", F.col("trained_at") + step).withColumn("due", F.coalesce(F.col("next_at") <= now, F.lit(False)))


def api_quotas(calls: DataFrame, as_of: float, per_day: int, *, last: int = 100) -> DataFrame:
    """Per api (api, at, success, latency_ms): calls today, this month (30 days) and in the last minute, errors, mean latency, status."""
    ago = as_of - F.col("at")
    c = calls.filter(ago >= 0).withColumn("_n", F.row_number().over(Window.partitionBy("api").orderBy(F.desc("at"), F.desc("call_id"))))
    out = c.groupBy("api").agg(F.count_if(ago < 86400).alias("today"), F.count_if(ago < 30 * 86400).alias("month"), F.count_if(ago < 60).alias("last_minute"), F.count_if(~F.col("success")).alias("errors"), F.avg(F.when(F.col("_n") <= last, F.col("latency_ms"))).alias("mean_latency_ms"))
    used = F.col("today") / per_day
    return out.withColumns({"used": used, "status": cases((used >= 1, "exceeded"), (used >= 0.9, "critical"), (used >= 0.75, "warning"), other="ok")})


def calls_per_minute(calls: DataFrame) -> DataFrame:
    w = F.window(F.timestamp_seconds("at"), "1 minute")
    return calls.groupBy("api", w.alias("w")).agg(F.count("*").alias("n")).select("api", F.unix_timestamp("w.start").alias("minute"), "n")


def newest_versions(versions: DataFrame, *, kept: int = 5) -> DataFrame:
    order = Window.partitionBy("model").orderBy(F.desc("version"))
    return versions.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= kept)


def processing_rate(log: DataFrame) -> DataFrame:
    """Records per second and error rate of jobs (job, records, errors, seconds)."""
    return log.groupBy("job").agg((F.sum("records") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("records_per_second"), (F.sum("errors") / F.greatest(F.sum("records"), F.lit(1))).alias("error_rate"))


def observed(stream: DataFrame, name: str, *, error: Column) -> DataFrame:
    """A stream whose progress tells records and errors of each micro-batch, counted while it runs."""
    return stream.observe(name, F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce(error, F.lit(False))).alias("errors"))


def counted(query: StreamingQuery, name: str) -> DataFrame:
    """(job, records, errors, seconds): a row for each micro-batch of a stream that `observed` named; as processing_rate takes them."""
    told = [(p["observedMetrics"][name], p["durationMs"].get("triggerExecution", 0) / 1000) for p in query.recentProgress if name in p["observedMetrics"]]
    return SparkSession.active().createDataFrame([(name, m["records"], m["errors"], s) for m, s in told], "job string, records bigint, errors bigint, seconds double")
