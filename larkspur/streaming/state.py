"""Windowed counts and duplicate removal in Spark's stream state, with a late side output.

A stateful operator drops rows behind its watermark without a trace.  So a stream
runs in two steps.  ``run_intake`` splits each micro-batch into accepted and late
rows by the newest time of the batches before it; one pass writes both, and a
rename of whole folders makes them visible, so a batch that is repeated after a
failure is seen once.  The stateful step reads the accepted rows.  Its own
watermark comes from some of those rows, so it is never ahead of the intake's:
it drops nothing, and every row is either counted or in the late table.

    work/accepted/<batch>   rows for the stateful step
    work/late/batch=<id>    rows behind the delay, and rows without a time where they are no use
    work/marks/<batch>      newest time up to that batch; two of them are kept
    work/intake, work/state checkpoints of the two steps
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources import storage
from larkspur.streaming.changelog import ChangeLog
from larkspur.streaming.ingest import start

DEFAULT_DELAY = "1 hour"


def newest_before(spark: SparkSession, work: str, batch_id: int):
    """The newest event time of the batches before ``batch_id``; None if there is none."""
    marks = [int(n) for n in storage.names(spark, f"{work}/marks") if n.isdigit() and int(n) < batch_id]
    return spark.read.parquet(f"{work}/marks/{max(marks)}").first()["newest"] if marks else None


def settle(batch: DataFrame, batch_id: int, work: str, ts: str, delay: str, undated_are_late: bool = True) -> None:
    """Store the accepted and the late rows of one micro-batch; a batch that is stored already stays as it is."""
    spark = batch.sparkSession
    if storage.exists(spark, f"{work}/marks/{batch_id}"):
        return
    newest = newest_before(spark, work, batch_id)
    late = F.col(ts).isNull() if undated_are_late else F.lit(False)
    if newest is not None:
        late |= F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    staging, seen = f"{work}/staging/{batch_id}", Observation()
    marked = batch.observe(seen, F.max(ts).alias("newest")).withColumn("_late", late)
    marked.write.mode("overwrite").partitionBy("_late").parquet(staging)  # the batch is evaluated once
    storage.move(spark, f"{staging}/_late=true", f"{work}/late/batch={batch_id}")
    storage.move(spark, f"{staging}/_late=false", f"{work}/accepted/{batch_id}")
    newest = max((t for t in (newest, seen.get["newest"]) if t is not None), default=None)
    if newest is not None:
        kind = batch.schema[ts].dataType.simpleString()
        spark.createDataFrame([(newest,)], f"newest {kind}").write.mode("overwrite").parquet(f"{work}/marks/{batch_id}")
        for name in storage.names(spark, f"{work}/marks"):
            if name.isdigit() and int(name) < batch_id - 1:  # only the batch before can be asked for again
                storage.remove(spark, f"{work}/marks/{name}")
    storage.remove(spark, staging)


def run_intake(
    rows: DataFrame, work: str, ts: str, delay: str = DEFAULT_DELAY, undated_are_late: bool = True, every: str | None = None
) -> StreamingQuery:
    """Split a stream into accepted and late rows."""
    return start(rows, f"{work}/intake", lambda batch, batch_id: settle(batch, batch_id, work, ts, delay, undated_are_late), every)


def accepted(spark: SparkSession, work: str, schema) -> DataFrame:
    """The accepted rows as a stream."""
    storage.make(spark, f"{work}/accepted")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{work}/accepted")


def late_rows(spark: SparkSession, work: str) -> DataFrame | None:
    return spark.read.parquet(f"{work}/late") if storage.names(spark, f"{work}/late") else None


def windowed(
    rows: DataFrame, ts: str, window: str, keys: dict[str, Column], measures: dict[str, Column], delay: str
) -> DataFrame:
    """``window_start``, keys and measures per tumbling window; a stream keeps a window until the watermark passes its end."""
    at = F.col(ts).cast("timestamp")
    counted = (
        rows.withColumn("_at", at).withWatermark("_at", delay)
        .groupBy(F.window("_at", window).alias("_w"), *[c.alias(n) for n, c in keys.items()])
        .agg(*[c.alias(n) for n, c in measures.items()])
    )
    return counted.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *keys, *measures)


def run_stateful(
    rows: DataFrame, log: ChangeLog, work: str, every: str | None = None, mode: str = "update"
) -> StreamingQuery:
    """Write what a stateful stream updates in each batch to the log; a window's newest row holds its totals."""
    writer = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: log.append(batch, batch_id))
    writer = writer.option("checkpointLocation", f"{work}/state")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_both(
    rows: DataFrame, work: str, ts: str, delay: str, undated_are_late: bool, every: str | None,
    second: Callable[[DataFrame], StreamingQuery],
) -> list[StreamingQuery]:
    """The intake and, on its accepted rows, the stateful step.

    Triggered runs come one after the other and have ended when this returns;
    standing ones (``every``) go on side by side.
    """
    spark = rows.sparkSession
    intake = run_intake(rows, work, ts, delay, undated_are_late, every)
    if not every:
        intake.awaitTermination()
    counting = second(accepted(spark, work, rows.schema))
    if not every:
        counting.awaitTermination()
    return [intake, counting]
