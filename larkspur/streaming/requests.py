"""Request streams: rate limits, daily guard counts and the metrics upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.windows import running_totals
from larkspur.streaming import state as st
from larkspur.streaming.changelog import ChangeLog
from larkspur.streaming.state import DEFAULT_DELAY

# a window of each unit is counted in slices of the finer unit
FINER = {"MINUTE": "SECOND", "HOUR": "MINUTE", "DAY": "HOUR"}


def rate_limit(
    requests: DataFrame, keys: list[str], ts: str, request_id: str, calls: int | None = None, tokens: int | None = None,
    tokens_column: str = "total_tokens", unit: str = "MINUTE",
) -> DataFrame:
    """Add the response code per request: 429 beyond ``calls`` or ``tokens`` per key and window.

    Every arriving request counts, refused ones too.  A caller with very many
    requests in one window is counted slice by slice, not in one task.
    """
    if unit not in FINER:
        raise ValueError(f"unit must be one of {sorted(FINER)}")
    if calls is None and tokens is None:
        raise ValueError("give a limit of calls, of tokens or both")
    counted = {}
    if calls is not None:
        counted["_calls"] = F.lit(1)
    if tokens is not None:
        counted["_tokens"] = F.coalesce(F.col(tokens_column), F.lit(0))
    out = running_totals(
        requests.withColumn("_window", F.date_trunc(unit, ts)),
        [*keys, "_window"],
        [F.date_trunc(FINER[unit], F.col(ts))],
        [F.col(ts), F.col(request_id)],
        counted,
    )
    limits = {"_calls": calls, "_tokens": tokens}
    over = reduce(lambda a, b: a | b, [F.col(n) > limits[n] for n in counted])
    return out.withColumn("response_code", F.when(over, 429).otherwise(200)).drop("_window", *counted)


def limit_measures(calls: int) -> dict[str, Column]:
    """Calls, tokens and the calls beyond ``calls`` of a group."""
    refused = F.greatest(F.count("*") - calls, F.lit(0).cast("bigint"))
    return {"calls": F.count("*"), "tokens": F.sum("total_tokens"), "refused": refused}


def limit_report(requests: DataFrame, keys: list[str], ts: str, calls: int, window: str = "1 minute") -> DataFrame:
    """Calls, tokens and refused calls per key and tumbling window of a batch."""
    counted = requests.groupBy(F.window(ts, window).alias("_w"), *keys).agg(
        *[c.alias(n) for n, c in limit_measures(calls).items()]
    )
    return counted.select(F.col("_w.start").alias("window_start"), *keys, "calls", "tokens", "refused")


def run_limit_stream(
    requests: DataFrame, log: ChangeLog, work: str, keys: list[str], ts: str, calls: int,
    window: str = "1 minute", delay: str = DEFAULT_DELAY, every: str | None = None,
) -> list[StreamingQuery]:
    """The limit report as a running table, counted in stream state.

    ``log`` has the keys ``window_start`` and ``keys``.  Every row is counted once
    or is in the late table; rows without a time are late.
    """
    columns = {k: F.col(k) for k in keys}
    return st.run_both(
        requests, work, ts, delay, True, every,
        lambda rows: st.run_stateful(st.windowed(rows, ts, window, columns, limit_measures(calls), delay), log, work, every),
    )


def run_daily_counts(
    requests: DataFrame, log: ChangeLog, work: str, ts: str, rule: Column, delay: str = DEFAULT_DELAY,
    every: str | None = None,
) -> list[StreamingQuery]:
    """Guard hits per day and rule as a running table; every row is counted once or is in the late table.

    ``log`` has the keys ``day`` and ``rule``.
    """

    def daily(rows: DataFrame) -> DataFrame:
        counted = st.windowed(rows, ts, "1 day", {"rule": rule}, {"hits": F.count("*")}, delay)
        return counted.select(F.to_date("window_start").alias("day"), "rule", "hits")

    return st.run_both(
        requests, work, ts, delay, True, every, lambda rows: st.run_stateful(daily(rows), log, work, every)
    )


def run_metrics_upsert(
    requests: DataFrame, log: ChangeLog, work: str, ts: str, delay: str = DEFAULT_DELAY, every: str | None = None
) -> list[StreamingQuery]:
    """Upsert requests by key; rows later than the delay go to the late table.

    A request that is delivered again within the delay (same key and, where the
    log has an order, the same version) is dropped by the stream's state, which
    forgets it when the watermark has passed.  A log with ``order`` keeps the newest
    version of a row whatever the order of arrival.  Rows without a time have no
    place in that state: they are never late and the log alone tells them apart.
    """
    version = [*log.keys, *([log.order] if log.order else [])]

    def distinct(rows: DataFrame) -> DataFrame:
        names = rows.columns
        timed = rows.where(F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
        undated = rows.where(F.col(ts).isNull())
        return timed.dropDuplicatesWithinWatermark(version).select(*names).unionAll(undated)

    return st.run_both(
        requests, work, ts, delay, False, every, lambda rows: st.run_stateful(distinct(rows), log, work, every, mode="append")
    )
