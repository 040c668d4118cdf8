"""Stages of a run that a second run does not repeat."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Named tables under a folder, each written once for the same inputs and options.

    The key is a hash of the options and of path, size and time of every input file. A stage that was written whole, as its
    _SUCCESS file tells, is read; one that a killed run left behind, or none, is written. Other inputs make other tables.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: list[str], options: dict[str, object]) -> None:
        self.spark, self.folder, self.done = spark, folder.rstrip("/"), []
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        told = [line for path in sorted(set(inputs)) if path for line in self._files(path)]
        self.key = hashlib.sha256(json.dumps([told, options], sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _fs(self, path: str):  # noqa: ANN202 - a JVM object
        at = self.hadoop.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _files(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        found, out = fs.globStatus(at), []
        for s in found or []:
            inner = fs.listFiles(s.getPath(), True)
            while inner.hasNext():
                f = inner.next()
                out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        return sorted(out) or [f"{path} -"]

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}-{self.key}"
        fs, at = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(at):
            make().write.mode("overwrite").parquet(path)
            self.done.append(name)
        return self.spark.read.parquet(path)
