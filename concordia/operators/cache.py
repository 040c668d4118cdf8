"""Answers of lookups, kept between runs: a keyed table in snapshots, where the newest answer of a key wins."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table string, column string, description string, characteristic string, doc_url string, matched boolean, provider string, asked_at long"
KEY, VALUE = ["table", "column"], ["description", "characteristic", "doc_url", "matched", "provider", "asked_at"]
#: Snapshots that stay when another is written.
KEPT = 2


def keyed(rows: DataFrame) -> DataFrame:
    """Keys are compared in capitals; null is the empty key."""
    return rows.withColumns({k: F.upper(F.coalesce(k, F.lit(""))) for k in KEY})


def merge(cached: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each key, the newest by asked_at; of equals an answer before a cached row, then the greatest. Null times are oldest."""
    both = keyed(cached).withColumn("new", F.lit(0)).unionByName(keyed(answers).withColumn("new", F.lit(1)))
    # a maximum by time: partial, so a key with very many answers is no burden
    newest = F.max(F.struct("asked_at", "new", *[c for c in VALUE if c != "asked_at"])).alias("v")
    return both.groupBy(*KEY).agg(newest).select(*KEY, *[F.col(f"v.{c}").alias(c) for c in VALUE])


def to_ask(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """The distinct keys (table, column) that the cache does not hold."""
    return keyed(keys.select(*KEY)).distinct().join(keyed(cached).select(*KEY), KEY, "left_anti")


class EnrichmentCache:
    """A folder of numbered snapshots. A snapshot is written beside them and renamed, so a reader meets whole ones alone.

    A newest snapshot that cannot be read counts as an empty cache: everything is asked again, and the next flush mends it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202 - a JVM object
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def snapshots(self) -> list[int]:
        if not self.fs.exists(self._at("")):
            return []
        found = (re.fullmatch(r"snapshot-(\d+)", s.getPath().getName()) for s in self.fs.listStatus(self._at("")))
        return sorted(int(m[1]) for m in found if m)

    def load(self) -> DataFrame:
        if known := self.snapshots():
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/snapshot-{known[-1]}")
            try:
                rows.write.format("noop").mode("overwrite").save()  # every column of every file is read once
                return rows
            except (PySparkException, Py4JJavaError):
                pass
        return self.spark.createDataFrame([], SCHEMA)

    def flush(self, rows: DataFrame) -> None:
        """A new snapshot of rows, which may have been read from the one before."""
        known, part = self.snapshots(), self._at(f"_writing-{uuid.uuid4().hex}")
        rows.select(*KEY, *VALUE).write.parquet(part.toString())
        if not self.fs.rename(part, self._at(f"snapshot-{(known or [0])[-1] + 1}")):
            raise OSError(f"cannot write a snapshot to {self.path}")
        for old in known[: -(KEPT - 1)]:
            self.fs.delete(self._at(f"snapshot-{old}"), True)
