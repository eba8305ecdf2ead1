"""Wall-clock times as instants.  Watermarks need instants; tables hold wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def instant(df: DataFrame, column: str) -> DataFrame:
    """Read a wall-clock column as UTC, whatever the session time zone is."""
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return df
    micros = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{column}`)")
    return df.withColumn(column, F.timestamp_micros(micros))


def wall_clock(c: Column) -> Column:
    """An instant back to UTC wall clock."""
    seconds = F.unix_micros(c).cast("decimal(18,0)") / F.lit(1_000_000)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.expr(EPOCH) + since
