"""Fitted pipelines kept by number in a shared folder."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

#: Written last: a version without it was never finished.
DONE = "_complete"


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def inputs(model: PipelineModel) -> list[str]:
    """The columns that a pipeline reads, in the order of its vector."""
    return next((s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler)), [])


def versions(spark: SparkSession, folder: str, model: str) -> list[int]:
    """Numbers of the finished versions, ascending; there are as few as are kept."""
    place, fs = _folder(spark, f"{folder}/{model}")
    if not fs.exists(place):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    return sorted(int(n) for n in found if n.isdigit() and fs.exists(_folder(spark, f"{folder}/{model}/{n}/{DONE}")[0]))


def save(fitted: PipelineModel, spark: SparkSession, folder: str, model: str, *, kept: int = 5) -> int:
    """Write a version under the next number, and delete all but the newest `kept`; the number. One writer at a time."""
    number = (versions(spark, folder, model) or [0])[-1] + 1
    path = f"{folder}/{model}/{number}"
    fitted.write().overwrite().save(path)  # over what an unfinished attempt left
    mark, fs = _folder(spark, f"{path}/{DONE}")
    fs.create(mark, True).close()
    for old in versions(spark, folder, model)[:-kept]:
        mark, fs = _folder(spark, f"{folder}/{model}/{old}/{DONE}")
        fs.delete(mark, False)
        fs.delete(mark.getParent(), True)
    return number


def load(spark: SparkSession, folder: str, model: str, *, version: int | None = None, columns: list[str] | None = None) -> PipelineModel:
    """A version, the newest by default. Fails where there is none, or where it doesn't read just `columns`."""
    known = versions(spark, folder, model)
    if not known or version is not None and version not in known:
        raise LookupError(f"no finished version {version or ''} of {model} in {folder}")
    fitted = PipelineModel.load(f"{folder}/{model}/{version or known[-1]}")
    if columns is not None and inputs(fitted) != list(columns):
        raise ValueError(f"{model} reads {inputs(fitted)}, not {list(columns)}")
    return fitted


def listed(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(model, version, newest) of the finished versions."""
    known = versions(spark, folder, model)
    return spark.createDataFrame([(model, v, v == known[-1]) for v in known], "model string, version bigint, newest boolean")
