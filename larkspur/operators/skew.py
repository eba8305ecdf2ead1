"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 10_000  # a key is hot when it holds at least 1/10,000 of all rows


BROADCAST_BYTES = 64 * 1024 * 1024  # most that a checked broadcast may hold


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast when its known size fits; otherwise leave the choice to Spark.

    Spark plans from file sizes and would shuffle the large side before it
    learns that the other one is tiny; here the row count is known beforehand.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_hot_keys(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    spread: list[Column],
    how: str = "inner",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``left`` with ``right`` (unique by ``key``), hot keys spread.

    ``right[weight]`` is the number of left rows of each key.  The weights add
    up to the left row count, so at most ``HOT_SHARES`` keys can be hot: that
    list is small whatever the data size and is the only thing broadcast.
    Left rows of a hot key get one of S salts from a hash of ``spread``; the
    matching right rows are repeated S times.  All other keys join as usual; a
    NULL key is a key like any other.

    Give ``weights`` (key and weight) when ``right`` is costly to compute, so
    that finding the hot keys does not evaluate it again.
    """
    known = (right if weights is None else weights).select(key, weight)
    salts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    total = known.agg(F.sum(weight).alias("total")).scalar()
    is_hot = (F.col(weight) * HOT_SHARES >= total) & (F.col(weight) > salts)
    hot = known.where(is_hot).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    hot = hot.withColumnRenamed(key, "_hot_key")
    salted_left = (
        left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left").withColumn("_salt", salt)
        .drop("_hot", "_hot_key")
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_right = right.withColumn(
        "_right_salt", F.explode(F.when(is_hot, every_salt).otherwise(F.array(F.lit(0))))
    ).withColumnRenamed(key, "_right_key")
    same = F.col(key).eqNullSafe(F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt"))
    return salted_left.join(salted_right, same, how).drop("_salt", "_right_salt", "_right_key")
