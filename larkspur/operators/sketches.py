"""Mergeable sketches kept per slice: distinct counts, percentiles and heavy items that add up.

A distinct count or a percentile of two slices does not follow from those of each.
Their sketches do merge, so slices of a fine grain (an hour, a day, a customer
group) answer every coarser grain, and new rows only add slices.

* distinct counts: theta sketches of 2^16 entries, exact up to that many distinct
  values, with a relative error of about 1 / 256 (one deviation) beyond;
* percentiles: KLL sketches with k = 8000, exact for a few thousand values, with
  a rank error of about 0.03 % beyond;
* heavy items: the ``ITEMS`` most frequent candidates of a slice with their counts.

All are one fixed-size value per slice, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTINCT_LOG, QUANTILE_K, ITEMS = 16, 8_000, 10_000


@dataclass(frozen=True)
class Slices:
    """What is kept per slice: names map to SQL expressions over the rows, ``sums`` to additive aggregates."""

    distinct: dict[str, str] = field(default_factory=dict)
    quantiles: dict[str, str] = field(default_factory=dict)
    heavy: dict[str, str] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)

    def of(self, rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """One row per slice; store it, append the slices of later rows to it."""
        made = [F.expr(distinct_part(e)[0]).alias(n) for n, e in self.distinct.items()]
        made += [F.expr(quantile_part(e)[0]).alias(n) for n, e in self.quantiles.items()]
        made += [F.expr(f"approx_top_k_accumulate({e}, {ITEMS})").alias(n) for n, e in self.heavy.items()]
        made += [F.expr(e).alias(n) for n, e in self.sums.items()]
        return rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*made)

    def merged(self, slices: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """The slices of a coarser grain, again slices."""
        made = [F.expr(distinct_part(n)[1].format(n)).alias(n) for n in self.distinct]
        made += [F.expr(quantile_part(n)[1].format(n)).alias(n) for n in self.quantiles]
        made += [F.expr(f"approx_top_k_combine({n}, {ITEMS})").alias(n) for n in self.heavy]
        made += [F.sum(n).alias(n) for n in self.sums]
        return slices.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*made)


def distinct_count(sketch: str) -> Column:
    return F.theta_sketch_estimate(sketch)


def quantile(sketch: str, p: float) -> Column:
    """The smallest value with at least a share ``p`` of the values up to it; NULL without values."""
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def heavy_items(sketch: str, k: int) -> Column:
    """The ``k`` most frequent items with their counts."""
    return F.expr(f"approx_top_k_estimate({sketch}, {k})")


# parts of metric-view measures: (aggregate over rows, aggregate over slices)

def distinct_part(expression: str) -> tuple[str, str]:
    return f"theta_sketch_agg({expression}, {DISTINCT_LOG})", f"theta_union_agg({{}}, {DISTINCT_LOG})"


def quantile_part(expression: str) -> tuple[str, str]:
    return f"kll_sketch_agg_double(CAST({expression} AS DOUBLE), {QUANTILE_K})", f"kll_merge_agg_double({{}}, {QUANTILE_K})"
