"""Learned predictors: boosted trees for delays, logistic regression for threats."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wayfold.operators import models
from wayfold.sources.staging import staged

DELAY_FEATURES = ["distance_m", "hist_duration", "weather_impact", "traffic_factor", "hour", "weekday", "rush", "route_confidence"]


def delay_rows(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"rush": F.col("is_rush").cast("double"), "weather_impact": F.coalesce("weather_impact", F.lit(0.0)), "traffic_factor": F.coalesce("traffic_factor", F.lit(1.0)), "label": F.col("delay_minutes")})


def fit_delay(requests: DataFrame, *, rounds: int = 10, depth: int = 3, folds: int = 0):
    """A fitted pipeline; with folds, the best depth of a cross validation."""
    gbt = GBTRegressor(maxIter=rounds, maxDepth=depth, seed=42)
    steps = Pipeline(stages=[VectorAssembler(inputCols=DELAY_FEATURES, outputCol="features"), gbt])
    rows = delay_rows(requests)
    if not folds:
        return steps.fit(rows)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [2, depth]).build()
    return CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), numFolds=folds, seed=42, parallelism=4).fit(rows).bestModel


def predict_delay(model, requests: DataFrame) -> DataFrame:
    """requests with delay_predicted (never below 0) and its confidence."""
    out = model.transform(delay_rows(requests))
    return out.withColumns({"delay_predicted": F.greatest(F.lit(0.0), F.col("prediction")), "model_confidence": 0.85 * F.col("context_confidence")}).drop("features", "prediction", "rush")


def evaluate_delay(requests: DataFrame) -> DataFrame:
    """One row: rows held out and mean absolute error of the model and of predicting the mean."""
    held = F.pmod(F.xxhash64("request_id"), F.lit(5)) == 0
    model = fit_delay(requests.filter(~held))
    mean = requests.filter(~held).agg(F.avg("delay_minutes")).first()[0] or 0.0
    out = predict_delay(model, requests.filter(held))
    return out.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("delay_predicted") - F.col("label"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("label") - mean)), 4).alias("mae_of_mean"))


THREAT_FEATURES = ["avg_risk", "max_risk", "min_risk", "std_risk", "high_share"]


def fit_threat(history: DataFrame, *, features: list[str] = THREAT_FEATURES, strength: float = 0.01):
    """A logistic regression fitted by log-loss; history: features by user and `label` (0 or 1: whether a threat came true)."""
    steps = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), LogisticRegression(maxIter=50, regParam=strength)]
    return Pipeline(stages=steps).fit(history.withColumn("label", F.col("label").cast("double")))


def predict_threat(model, history: DataFrame) -> DataFrame:
    """history with p, the chance of a threat."""
    out = model.transform(history).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def log_loss(label: Column, p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), p))
    return F.avg(-F.when(label == 1, F.log(p)).otherwise(F.log(1 - p)))


def evaluate_threat(history: DataFrame) -> DataFrame:
    """One row: users held out, log-loss of the model and of predicting the training share."""
    held = F.pmod(F.xxhash64("user_id"), F.lit(5)) == 0
    model = fit_threat(history.filter(~held))
    share = history.filter(~held).agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    out = predict_threat(model, history.filter(held))
    return out.agg(F.count("*").alias("n"), F.round(log_loss(F.col("label"), F.col("p")), 4).alias("log_loss"), F.round(log_loss(F.col("label"), F.lit(share)), 4).alias("log_loss_of_share"))


def batched_threat(model, history: DataFrame) -> DataFrame:
    """(user_id, p): a fitted pipeline's logistic regression run in Arrow batches, its weights loaded once a worker: the form in which outside models are called."""
    columns, weights, bias = models.inputs(model), model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept)

    def load():
        def predict(x: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-(x @ weights + bias)))

        return predict

    score = predict_batch_udf(load, return_type=DoubleType(), batch_size=4096, input_tensor_shapes=[[len(columns)]])
    return history.dropna(subset=columns).select("user_id", score(F.array(*[F.col(c).cast("double") for c in columns])).alias("p"))


# --- delays as they were observed


def observed_delays(requests: DataFrame, signatures: DataFrame) -> DataFrame:
    """requests (features by delay_features; request_id is a trip's) with delay_minutes as the trip ran: its duration over the route's, or where none is known over that of its distance at 50 km/h; heuristic_minutes is what delay_minutes was before."""
    took = signatures.select(F.col("trip_id").alias("request_id"), F.col("duration").alias("_took"))
    usual = F.when(F.col("hist_duration") > 0, F.col("hist_duration")).otherwise(F.col("distance_m") / (50.0 / 3.6))
    out = requests.withColumnRenamed("delay_minutes", "heuristic_minutes").join(took, "request_id")
    return out.withColumn("delay_minutes", F.greatest(F.lit(0.0), (F.col("_took") - usual) / 60)).drop("_took")


def evaluate_observed(requests: DataFrame, *, folds: int = 5) -> DataFrame:
    """One row: requests held out (one in five), the depth that cross validation chose, and mean absolute errors of the model, of the heuristic and of predicting the mean."""
    requests = staged(requests, "requests")
    held = F.pmod(F.xxhash64("request_id"), F.lit(5)) == 0
    train = requests.filter(~held)
    model = fit_delay(train, folds=folds)
    mean = train.agg(F.avg("delay_minutes")).first()[0] or 0.0
    out = predict_delay(model, requests.filter(held))
    error = lambda c: F.round(F.avg(F.abs(c - F.col("label"))), 4)
    found = out.agg(F.count("*").alias("n"), error(F.col("delay_predicted")).alias("mae"), error(F.col("heuristic_minutes")).alias("mae_of_heuristic"), error(F.lit(mean)).alias("mae_of_mean"))
    return found.withColumn("depth", F.lit(model.stages[-1].getMaxDepth()))
