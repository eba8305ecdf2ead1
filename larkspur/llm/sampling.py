"""A bounded sample of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.skew import broadcast_if_small
from larkspur.session import cut_lineage


def distinct_texts(rows: DataFrame, text_col: str, size: int, group_col: str | None = None) -> DataFrame:
    """``text_col`` (and ``group_col``) and ``turn``: the ``size`` texts with the smallest hashes, per group if given; stored.

    A text counts once however often it is repeated, so copies neither fill the
    sample nor shrink the chance of others.  Hashes are counted first; only the
    texts below a hash that leaves about four times ``size`` are shuffled, copies
    reduced before.  Rows with a NULL text or group are left out.
    """
    keys = [group_col] if group_col else []
    hashed = rows.select(*keys, text_col, F.xxhash64(text_col).alias("_draw")).dropna(subset=[*keys, text_col])
    counts = cut_lineage(hashed.select(*keys, "_draw").distinct().groupBy(*keys).agg(F.count("*").alias("_n")))
    share = counts.select(*keys, F.least(F.lit(1.0), F.lit(4.0 * size) / F.greatest("_n", F.lit(1))).alias("_share"))
    if keys:
        few = hashed.join(broadcast_if_small(share, counts.count(), 64), keys)
    else:
        few = hashed.withColumn("_share", F.lit(share.first()["_share"]))
    few = few.where(F.shiftrightunsigned("_draw", 33).cast("double") <= F.col("_share") * float(1 << 31))
    once = few.groupBy(*keys, "_draw").agg(F.min(text_col).alias(text_col))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw"))
    return cut_lineage(once.withColumn("turn", turn).where(F.col("turn") <= size).select(*keys, text_col, "turn"))
