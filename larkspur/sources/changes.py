"""Keyed upserts, snapshot differences and versioned datasets on plain parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.windows import latest_by_key


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merge updates into a target that is unique by key; the newest version wins.

    Updates shrink to one row per key first; one full outer join then decides
    each key.  A NULL order value counts as oldest on both sides, equal ones go
    to the update.  A NULL key equals no other key, as in MERGE: such rows of
    either side stay.
    """
    rest = [c for c in target.columns if c not in keys]
    newest = latest_by_key(updates.select(*target.columns), keys, [F.col(order)])
    old = target.select(*keys, F.struct(*rest).alias("_old"))
    both = old.join(newest.select(*keys, F.struct(*rest).alias("_new")), keys, "full_outer")
    newer = F.coalesce(F.col(f"_new.{order}") >= F.col(f"_old.{order}"), F.col(f"_old.{order}").isNull())
    winner = F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & ~newer), F.col("_old")).otherwise(F.col("_new"))
    return both.withColumn("_row", winner).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in target.columns]
    )


def delete_keys(target: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """The target without the deleted keys."""
    return target.join(deleted.select(*keys).distinct(), keys, "left_anti")


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Change rows between two versions of a table: key and insert, update or delete.

    Only the key and a hash of the content travel through the join.
    """

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(F.to_json(F.struct(*content)), 256).alias(name))

    both = digest(old, "_old").join(digest(new, "_new"), keys, "full_outer")
    op = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return both.select(*keys, op.alias("op")).where(F.col("op").isNotNull())


def sync_status(source: DataFrame, index: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Rows in the source and the index, and how many are missing, stale or extra."""
    ops = diff_snapshots(index, source, keys, content).groupBy().agg(
        F.count_if(F.col("op") == "insert").alias("missing"),
        F.count_if(F.col("op") == "update").alias("stale"),
        F.count_if(F.col("op") == "delete").alias("extra"),
    )
    return ops.select(
        source.agg(F.count("*")).scalar().alias("source_rows"),
        index.agg(F.count("*")).scalar().alias("index_rows"),
        "missing", "stale", "extra",
    )


def merge_records(dataset: DataFrame, rows: DataFrame, columns: list[str], version: str = "version") -> DataFrame:
    """Append rows whose inputs are new, as the next dataset version.

    ``columns`` are the input columns that identify a record.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    fresh = rows.withColumn("_h", digest).dropDuplicates(["_h"])
    fresh = fresh.join(dataset.select(digest.alias("_h")), "_h", "left_anti").drop("_h")
    next_version = dataset.agg(F.coalesce(F.max(version), F.lit(0)) + 1).scalar()
    return dataset.unionByName(fresh.withColumn(version, next_version.cast("int")), allowMissingColumns=True)
