"""Connected components of a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.skew import join_hot_keys
from larkspur.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has an edge.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself.
    Rounds grow with the logarithm of the longest path.  Every round is stored
    in the shared folder; nodes with many neighbours are spread over tasks.
    Loops and repeated edges do no harm; rows with a NULL end are no edges.
    """
    links = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _state(links)
    while state[0]:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        small = _with_smallest(large)
        links = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(large.groupBy("u").agg(F.min("v").alias("v")))
            .where("u > v").distinct()
        )
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )


def _with_smallest(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the smallest of u and its neighbours."""
    smallest = cut_lineage(
        links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    )
    return join_hot_keys(links, smallest, "u", "degree", [F.col("v")])


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
