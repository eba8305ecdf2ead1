"""Filters, routing, joins and set operations with the reference semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def split_quarantine(df: DataFrame, errors: str) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): a row is clean when the first element is absent or NULL."""
    first = F.get(F.col(errors), F.lit(0))
    return df.where(first.isNull()), df.where(first.isNotNull())


def expect_or_drop(df: DataFrame, expectations: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Drop rows that fail any expectation and count the failures of each.

    The counts ride on the same pass as an observed metric: read
    ``observation.get`` after the first action on the returned frame.
    """
    observation = Observation()
    passed = {name: F.coalesce(test, F.lit(False)) for name, test in expectations.items()}
    metrics = [F.count_if(~test).alias(f"dropped_{name}") for name, test in passed.items()]
    observed = df.observe(observation, F.count("*").alias("rows_in"), *metrics)
    return observed.where(reduce(lambda a, b: a & b, passed.values())), observation


def where_equal(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Equality conjunction from a dict; a list value means any of its items."""
    out = df
    for name, value in filters.items():
        if name not in df.columns:
            raise ValueError(f"unknown filter column {name!r}")
        column = F.col(name)
        out = out.where(column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column == value)
    return out


def where_sql(df: DataFrame, condition: str) -> DataFrame:
    """Filter by a SQL condition; an unknown column raises here, at once."""
    out = df.where(condition)
    out.schema  # forces analysis, so a wrong condition never goes unnoticed
    return out


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact with (dimension, fact key, dimension key), in order.

    No join hint: Spark broadcasts a dimension when its measured size is under
    the session threshold and shuffles it otherwise.
    """
    out = fact
    for dim, fact_key, dim_key in dims:
        out = out.join(dim, out[fact_key] == dim[dim_key], "left")
    return out


def orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Fact rows whose key is missing in the dimension."""
    return fact.join(dim.select(F.col(dim_key).alias(fact_key)), fact_key, "left_anti")


def compare_runs(run_a: DataFrame, run_b: DataFrame, key: str = "scorer", value: str = "mean") -> DataFrame:
    """Scores of two runs side by side; delta is NULL when one side is missing."""
    a = run_a.select(key, F.col(value).alias("v1"))
    b = run_b.select(key, F.col(value).alias("v2"))
    return a.join(b, key, "full_outer").withColumn("delta", F.col("v2") - F.col("v1"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Two aggregates per key, their gap and whether they agree."""
    joined = left.select(*keys, F.col(value).alias("left_value")).join(
        right.select(*keys, F.col(value).alias("right_value")), keys, "full_outer"
    )
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return joined.withColumn("agrees", F.coalesce(gap < tolerance, F.lit(False)))


def overlap_size(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys the two sides share."""
    shared = left.select(key).distinct().join(right.select(key), key, "left_semi")
    return shared.agg(F.count("*").alias("shared"))


def leaked(returned: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Returned keys that are not allowed; empty when the filter held."""
    return returned.select(key).distinct().join(allowed.select(key), key, "left_anti")


def union_sources(sources: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """Rows of all sources by column name, missing columns NULL, tagged by source."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def new_rows(candidates: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct candidates whose content is not in ``existing`` yet."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    fresh = candidates.withColumn("_h", digest).dropDuplicates(["_h"])
    return fresh.join(existing.select(digest.alias("_h")), "_h", "left_anti").drop("_h")
