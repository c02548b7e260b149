"""Keyed Parquet tables: get, page, append, upsert, delete, count; and dimensions that age."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


class Table:
    """A table in versions: version N is a small file that names the folders which hold its rows.

    A version's file appears whole or not at all, under a name that nobody else
    can take: readers never see half a write, and of two writers that began
    from the same version the second fails and has to begin again. Appending
    adds a folder; upserting and deleting write the rows anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._place = spark._jvm.org.apache.hadoop.fs.Path

    def _files(self) -> object:
        return self._place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        """The newest version: its number, folders and mark."""
        files, versions = self._files(), self._place(f"{self.path}/versions")
        numbers = [int(s.getPath().getName()) for s in files.listStatus(versions) if s.getPath().getName().isdigit()] if files.exists(versions) else []
        if not numbers:
            return {"number": 0, "folders": [], "mark": None}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{max(numbers)}").first()[0])

    def _publish(self, before: dict, folders: list[str], mark: str | None) -> None:
        version = {"number": before["number"] + 1, "folders": folders, "mark": before["mark"] if mark is None else mark}
        files, written = self._files(), self._place(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = files.create(written, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        name = self._place(f"{self.path}/versions/{version['number']}")
        if files.exists(name) or not files.rename(written, name):
            files.delete(written, False)
            raise RuntimeError(f"another writer has made version {version['number']} of {self.path}")

    def _folder(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.parquet(f"{self.path}/{folder}")
        return folder

    def _rows(self, version: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in version["folders"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._current())

    def mark(self) -> str | None:
        """What the last writer that gave a mark has left (a stream: its batch)."""
        return self._current()["mark"]

    def get(self, **key: object) -> DataFrame:
        rows = self.read()
        for k, v in key.items():
            rows = rows.filter(F.col(k) == v)
        return rows

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return self.read().orderBy(*self.keys).offset(offset).limit(limit)

    def create(self, rows: DataFrame, *, mark: str | None = None) -> int:
        """Append; the number of rows appended."""
        before = self._current()
        folder = self._folder(rows)
        self._publish(before, [*before["folders"], folder], mark)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()

    def upsert(self, rows: DataFrame, *, mark: str | None = None) -> None:
        before = self._current()
        self._publish(before, [self._folder(upsert(self._rows(before), rows.select(self.schema.names), self.keys))], mark)

    def delete(self, rows: DataFrame, *, mark: str | None = None) -> None:
        before = self._current()
        self._publish(before, [self._folder(delete(self._rows(before), rows, self.keys))], mark)

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        self._publish(self._current(), [], None)


def fresh(requests: DataFrame, records: DataFrame, seconds: float, *, cell: str = "cell", at: str = "at", value: list[str]) -> DataFrame:
    """requests with the latest record of their cell that is at most `seconds` old (weather: 900, traffic: 300), null without one.

    Requests and records are merged in one ordered pass, cell by cell and span
    by span of `seconds`: a record goes into its own span and the next, beyond
    which it is too old. So a busy cell is spread over its spans, and no request
    meets more than one record. Of records of one time the one with the largest
    values counts; requests without a cell or a time have none.
    """
    known = records.filter(F.col(cell).isNotNull() & F.col(at).isNotNull())
    record = known.select(F.col(cell).alias("cell"), F.col(at).alias("t"), F.struct(F.col(at).alias("at"), F.struct(*value).alias("of")).alias("record"))
    record = record.withColumn("span", F.explode(F.array(F.floor(F.col("t") / seconds), F.floor(F.col("t") / seconds) + 1)))
    request = requests.select(F.col(cell).alias("cell"), F.col(at).alias("t"), F.struct(*requests.columns).alias("request")).withColumn("span", F.floor(F.col("t") / seconds))
    both = record.unionByName(request, allowMissingColumns=True)
    order = Window.partitionBy("cell", "span").orderBy("t", F.col("request").isNotNull(), "record").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("last", F.last("record", ignorenulls=True).over(order)).filter(F.col("request").isNotNull())
    return met.select("request.*", *[F.when(F.col("t") - F.col("last.at") <= seconds, F.col(f"last.of.{v}")).alias(v) for v in value])
