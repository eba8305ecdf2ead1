"""A dataset as a list of commits, each naming the folders that belong to it.

Data folders are written first and are never changed; a commit counts from the
moment its record appears, which is one rename.  What an interrupted job left is
in no record and is never read.  A second writer that commits at the same time
finds its number taken and fails, with nothing lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from larkspur.sources import storage


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self) -> str:
        """A fresh path for data of a commit to come."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def commits(self) -> list[dict]:
        """The records in order, each with its ``number``."""
        if not storage.names(self.spark, f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema("record string").parquet(f"{self.root}/commits/*").collect()
        return sorted((json.loads(row["record"]) for row in rows), key=lambda record: record["number"])

    def add(self, after: int, **record) -> int:
        """Commit a record as the one after number ``after`` (-1: the first)."""
        number = after + 1
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        text = json.dumps({"number": number, **record})
        self.spark.createDataFrame([(text,)], "record string").coalesce(1).write.parquet(staging)
        if not storage.move(self.spark, staging, f"{self.root}/commits/{number:08d}"):
            storage.remove(self.spark, staging)
            raise Conflict(f"commit {number} of {self.root} exists")
        return number

    def remove_unused(self, used: set[str]) -> int:
        """Delete data folders that no live record names; only while nothing is being written or read from older ones."""
        gone = [n for n in storage.names(self.spark, f"{self.root}/data") if f"{self.root}/data/{n}" not in used]
        return sum(storage.remove(self.spark, f"{self.root}/data/{n}") for n in gone)
