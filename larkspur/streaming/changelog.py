"""Keyed tables fed by micro-batches: append-only change files, the latest row wins.

Each micro-batch writes its own ``batch=<id>`` folder in overwrite mode, so a
batch that is run again after a failure replaces its own files and nothing is
counted twice.  Readers reduce to the newest row per key; ``compact`` folds
finished batches into a snapshot so that reads stay short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.windows import latest_by_key
from larkspur.sources.writes import read_table


@dataclass(frozen=True)
class ChangeLog:
    path: str
    keys: tuple[str, ...]
    order: str | None = None  # column that tells which version of a row is newer; NULL is oldest

    def append(self, rows: DataFrame, batch_id: int, op: str | None = None) -> None:
        """Store the rows of one batch; ``_op`` is ``put`` unless the rows carry it."""
        marked = rows if "_op" in rows.columns else rows.withColumn("_op", F.lit(op or "put"))
        marked.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """All stored changes with their batch number."""
        return read_table(spark, self.path)

    def current(self, spark: SparkSession) -> DataFrame | None:
        """One row per key: the newest change, by ``order`` and then by batch, deletions left out."""
        changes = self.rows(spark)
        if changes is None:
            return None
        order = [F.col(c) for c in (self.order, "batch") if c]
        newest = latest_by_key(changes, list(self.keys), order)
        return newest.where(F.col("_op") != "delete").drop("_op", "batch")

    def compact(self, spark: SparkSession, path: str) -> DataFrame:
        """Write the current rows to a new folder as batch -1 of a fresh log."""
        rows = self.current(spark)
        rows.withColumn("_op", F.lit("put")).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return ChangeLog(path, self.keys, self.order).current(spark)


def kept_short(log: ChangeLog, spark: SparkSession, path: str, most_batches: int) -> ChangeLog:
    """The log itself, or its compacted copy at ``path`` once it holds more than ``most_batches`` batches."""
    stored = log.rows(spark)
    if stored is None or stored.select("batch").distinct().count() <= most_batches:
        return log
    log.compact(spark, path)
    return ChangeLog(path, log.keys, log.order)
