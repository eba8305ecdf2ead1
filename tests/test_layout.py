"""Layout along a curve: files opened by a filter on any of its columns."""

import pytest
from pyspark.sql import functions as F

from larkspur.sources import writes


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    """Two skewed columns; a third of the rows have one value of ``a``, some have none."""
    rows = spark.range(40_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100)).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000)).alias("b"),
    )
    root = tmp_path_factory.mktemp("curve")
    stored = writes.write_curve(rows, str(root / "rows"), ["a", "b"], files=64)
    return rows, stored, writes.write_file_index(stored, ["a", "b"], str(root / "files"))


def test_rows_are_kept_and_hot_values_spread(spark, laid_out):
    rows, stored, index = laid_out
    assert stored.count() == 40_000 and stored.exceptAll(rows).isEmpty()
    sizes = [r["rows"] for r in index.collect()]
    assert len(sizes) == 64 and max(sizes) < 4 * 40_000 / 64


@pytest.mark.parametrize("ranges, share", [
    ({"a": (2.0, 2.5)}, 0.5), ({"b": (50_000, 55_000)}, 0.45), ({"a": (2.0, 3.0), "b": (10_000, 20_000)}, 0.15), ({"b": (200_000, 300_000)}, 0.0),
    ({"a": (7.0, 7.0), "b": (0, 10_000)}, 0.25),
])
def test_a_filter_opens_few_files(spark, laid_out, ranges, share):
    rows, stored, index = laid_out
    found, files = writes.read_ranges(stored, index, ranges)
    wanted = rows
    for column, (low, high) in ranges.items():
        wanted = wanted.where(F.col(column).between(low, high))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in wanted.collect())
    assert files <= share * 64


def test_empty_and_constant_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0)], "id int, a double, b double")
    stored = writes.write_curve(rows, str(tmp_path / "one"), ["a", "b"], files=4)
    index = writes.write_file_index(stored, ["a", "b"], str(tmp_path / "one-files"))
    assert writes.read_ranges(stored, index, {"b": (5, 5)})[0].count() == 2
    assert writes.read_ranges(stored, index, {"a": (0, 9)})[1] == 0
    empty = writes.write_curve(rows.limit(0), str(tmp_path / "none"), ["a", "b"], files=4)
    index = writes.write_file_index(empty, ["a", "b"], str(tmp_path / "none-files"))
    assert writes.read_ranges(empty, index, {"b": (5, 5)})[0].collect() == []
