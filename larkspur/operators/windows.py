"""Window operators: trailing baselines, top-k, versions and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_baseline(
    df: DataFrame, value: str, order: str, series: list[str] | None = None, rows: int = 7
) -> DataFrame:
    """Mean and sample deviation of the ``rows`` rows before each row.

    The input is an already aggregated series (one row per day and series), so
    a window over one series holds days, not requests.
    """
    w = Window.partitionBy(*(series or [])).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn("baseline_mean", F.avg(value).over(w)).withColumn(
        "baseline_sd", F.stddev_samp(value).over(w)
    )


def sigma_flag(value: Column, mean: Column, sd: Column, sigmas: float = 2.0) -> Column:
    """``ANOMALY`` above mean + sigmas * sd (a missing sd counts as 0), else ``ok``."""
    limit = mean + sigmas * F.coalesce(sd, F.lit(0.0))
    return F.when(value > limit, "ANOMALY").otherwise("ok")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; ties go to the greatest row.

    A maximum of structs rather than a ranking, so a key with very many rows
    is reduced on the map side and never gathered in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest]
    )
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def period_measures(df: DataFrame, value: str, order: str, series: list[str], rows: int) -> DataFrame:
    """Running total, trailing total over ``rows`` periods and change to the last period."""
    w = Window.partitionBy(*series).orderBy(order)
    return (
        df.withColumn("running_total", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("trailing_total", F.sum(value).over(w.rowsBetween(-(rows - 1), 0)))
        .withColumn("change", F.col(value) - F.lag(value).over(w))
    )


def last_turns(df: DataFrame, conversation: str, turn: str, keep: int) -> DataFrame:
    """The last ``keep`` messages of each conversation, in order, as one array."""
    kept = top_k(df, [conversation], [F.col(turn).desc()], keep)
    items = F.sort_array(F.collect_list(F.struct(turn, "role", "text")))
    return kept.groupBy(conversation).agg(items.alias("history"))


def running_totals(
    df: DataFrame, keys: list[str], slice_by: list[Column], order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """Running totals per key in two levels, so that no task holds a whole key.

    Rows are summed per (key, slice); the slice sums give each slice its offset
    and the detailed window runs inside one slice only.  ``slice_by`` must be
    a prefix of the row order in time (for example second, then tenth).
    ``values`` maps result names to the summed expressions.  NULL keys and
    slices count like any other value.
    """
    # one struct of keys and slices: never NULL itself, and NULL fields in it are equal
    rows = df.select(
        "*", *[v.alias(n) for n, v in values.items()], F.struct(*keys).alias("_totals_key"),
        F.struct(*[c.alias(f"s{i}") for i, c in enumerate(slice_by)]).alias("_totals_slice"),
    )
    sums = rows.groupBy("_totals_key", "_totals_slice").agg(*[F.sum(n).alias(f"_sum_{n}") for n in values])
    before = Window.partitionBy("_totals_key").orderBy("_totals_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_totals_key", "_totals_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in values]
    )
    inside = Window.partitionBy("_totals_key", "_totals_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({n: F.sum(n).over(inside) for n in values}).join(offsets, ["_totals_key", "_totals_slice"])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_offset_{n}")).alias(n) for n in values])
