"""Aggregations that need more than one ``agg`` call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.windows import running_totals
from larkspur.session import cut_lineage

SLICES = 1_000  # of a bracket


def daily_percentiles(
    df: DataFrame, day: Column, value: str, percentiles: dict[str, float], extra: list[Column] | None = None
) -> DataFrame:
    """Row count and approximate percentiles per day, in one sketch aggregate."""
    measures = [F.percentile_approx(value, p).alias(name) for name, p in percentiles.items()]
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("request_count"), *measures, *(extra or []))


def order_statistic(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The value at index ``floor(p * (n - 1))`` of the sorted values, per key.

    Exact without a global sort.  A quantile sketch brackets the wanted rank;
    only the rows inside the bracket are grouped by value and ranked, and the
    rows below it are counted.  The bracket holds a small share of the rows,
    equal values fold into one row, and the counts are summed up slice by slice
    of the bracket, so no task sees a whole key or a whole bracket.

    The brackets (one row per key) are stored first: their size is then known,
    and Spark broadcasts them instead of shuffling the rows by key.
    """
    slack, accuracy = 0.005, 10_000
    low, high = max(p - slack, 0.0), min(p + slack, 1.0)
    # one struct of keys: a NULL key is a key like any other
    clean = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key"), value)
    bounds = clean.groupBy("_key").agg(
        F.floor(F.lit(p) * (F.count("*") - 1)).alias("_rank"),
        (F.min(value) if low <= 0.0 else F.percentile_approx(value, low, accuracy)).alias("_low"),
        (F.max(value) if high >= 1.0 else F.percentile_approx(value, high, accuracy)).alias("_high"),
    )
    if keys:
        joined = clean.join(cut_lineage(bounds), "_key")
    else:
        only = bounds.first()
        if only is None:
            return clean.select(F.max(value).alias(name))
        joined = clean.withColumns({c: F.lit(only[c]) for c in ("_rank", "_low", "_high")})
    counts = (
        joined.where(F.col(value) <= F.col("_high"))
        .withColumn("_v", F.when(F.col(value) >= F.col("_low"), F.col(value)))
        .groupBy("_key", "_rank", "_low", "_high", "_v")
        .agg(F.count("*").alias("_c"))
    )
    width = F.nullif(F.col("_high").cast("double") - F.col("_low").cast("double"), F.lit(0.0))
    place = F.floor(F.lit(SLICES) * (F.col("_v").cast("double") - F.col("_low").cast("double")) / width)
    slice_ = F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(place, F.lit(0)))
    upto = running_totals(counts, ["_key"], [slice_], [F.col("_v").asc_nulls_first()], {"_upto": F.col("_c")})
    hit = upto.where((F.col("_upto") > F.col("_rank")) & F.col("_v").isNotNull())
    found = hit.groupBy("_key").agg(F.min("_v").alias(name))
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], name)


def share_of_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total per key and its percentage of the grand total, which is summed from the stored totals."""
    totals = cut_lineage(df.groupBy(*keys).agg(F.sum(value).alias("total")))
    grand = totals.agg(F.sum("total").alias("grand")).scalar()
    return totals.withColumn("pct", F.round(F.lit(100.0) * F.col("total") / grand, 1))


def rollup_totals(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """The same measures at every roll-up level, in one pass over the data."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *measures)


def melt_scores(df: DataFrame, ids: list[str], scores: list[str]) -> DataFrame:
    """Score columns to rows (scorer, value)."""
    return df.unpivot(ids, scores, "scorer", "value")
