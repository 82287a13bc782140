"""Append-only JSON logs and small JSON tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Folder


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of one JSON object a line; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def newest(log: DataFrame, order: str, n: int) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def compact(log: DataFrame, order: str, n: int, path: str) -> None:
    """Write the newest ``n`` rows as a log of their own; point readers at it when it is complete."""
    newest(log, order, n).write.mode("errorifexists").json(path)


def read_array(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """A JSON array as rows; ``fallback`` if it has none."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return fallback if fallback is not None and rows.isEmpty() else rows


class Log:
    """A log of appends below ``path``, of which the newest ``keep`` rows stand; rewritten to these after every ``every`` appends.

    The place of a row is its append and, within that, the columns ``order``. A version of the log
    is one small file that names the folders it consists of and appears at once: a reader that has
    planned its read sees that version to the end, also while an append or a rewrite goes on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, order: list[str], keep: int = 10_000, every: int = 100):
        self.spark, self.path, self.schema, self.order, self.keep, self.every = spark, path.rstrip("/"), schema, order, keep, every
        self._versions, self._parts = Folder(spark, f"{self.path}/versions"), Folder(spark, f"{self.path}/parts")

    def _told(self) -> dict:
        names = self._versions.names()
        return json.loads(self._versions.read(names[-1])) if names else {"version": 0, "appends": 0, "folders": []}

    def _write(self, told: dict, rows: DataFrame, folders: list[str], appends: int) -> None:
        folder = uuid.uuid4().hex
        rows.write.json(f"{self._parts.path}/{folder}")
        number = told["version"] + 1
        self._versions.put(f"{number:012d}.json", json.dumps({"version": number, "appends": appends, "folders": [*folders, folder]}))

    def append(self, rows: DataFrame) -> None:
        """Add rows at the end, one JSON object a line. Of two appends at once the second gets FileExistsError and may try again."""
        told = self._told()
        at = told["appends"] + 1
        self._write(told, rows.withColumn("_append", F.lit(at)), told["folders"], at)
        if at % self.every == 0:
            self.compact()

    def read(self) -> DataFrame:
        """The rows that stand, oldest first; lines that can't be read are left out."""
        told = self._told()
        if not told["folders"]:
            return self.spark.createDataFrame([], self.schema)
        rows = [read_log(self.spark, f"{self._parts.path}/{f}", f"{self.schema}, _append long") for f in told["folders"]]
        back = [F.desc("_append"), *[F.desc(c) for c in self.order]]
        newest_rows = reduce(DataFrame.unionByName, rows).where("_append is not null").orderBy(*back).limit(self.keep)
        return newest_rows.orderBy("_append", *self.order).drop("_append")

    def compact(self) -> None:
        """Write what stands as one folder, and make it the log. What it consisted of before is kept for readers until :meth:`expire`."""
        told = self._told()
        rows = [read_log(self.spark, f"{self._parts.path}/{f}", f"{self.schema}, _append long") for f in told["folders"]]
        if rows:
            back = [F.desc("_append"), *[F.desc(c) for c in self.order]]
            self._write(told, reduce(DataFrame.unionByName, rows).where("_append is not null").orderBy(*back).limit(self.keep), [], told["appends"])

    def expire(self) -> None:
        """Remove what the newest version doesn't name. Don't run it while others read or write."""
        names, used = self._versions.names(), set(self._told()["folders"])
        for n in names[:-1]:
            self._versions.remove(n)
        for f in self._parts.names():
            if f not in used:
                self._parts.remove(f)
