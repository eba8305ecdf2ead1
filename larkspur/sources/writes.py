"""Table sinks.  Paths are parquet folders on storage that all executors share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing is there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def create_or_replace(df: DataFrame, path: str) -> DataFrame:
    """Replace the table, its schema included."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def insert_overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace the rows but keep the schema: columns are matched by position and cast."""
    old = read_table(df.sparkSession, path)
    if old is None:
        raise ValueError(f"no table at {path}")
    if len(df.columns) != len(old.columns):
        raise ValueError(f"expected {len(old.columns)} columns, got {len(df.columns)}")
    cast = df.toDF(*old.columns).to(old.schema)
    cast.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> DataFrame:
    """Add rows by column name; the schema of an existing table must fit."""
    old = read_table(df.sparkSession, path)
    rows = df if old is None else df.select(*old.columns).to(old.schema)
    rows.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def seed_when_empty(df: DataFrame, path: str) -> DataFrame:
    """Insert the rows only when the table has none, so a second call changes nothing."""
    old = read_table(df.sparkSession, path)
    if old is None or old.isEmpty():
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_clustered(df: DataFrame, path: str, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Write rows range-clustered by ``columns`` so that file statistics prune scans.

    A hash of the whole row breaks ties: the rows of one hot value then spread
    over several files instead of landing in one.
    """
    by = [*columns, "_spread"]
    spread = df.withColumn("_spread", F.xxhash64("*"))
    ranged = spread.repartitionByRange(partitions, *by) if partitions else spread.repartitionByRange(*by)
    ranged.sortWithinPartitions(*columns).drop("_spread").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rank_digits(df: DataFrame, column: str, bits: int) -> Column:
    """The place of a value among all values of the column, from 0 to 2^bits - 1, by its approximate quantiles.

    Equal steps of rank, not of value, so skewed columns use all digits; NULL comes first, NaN last.
    """
    cuts = df.select(F.percentile_approx(column, [i / (1 << bits) for i in range(1, 1 << bits)], 10_000)).first()[0] or []
    below = [F.when(F.col(column) > F.lit(c), 1).otherwise(0) for c in cuts]
    return reduce(lambda a, b: a + b, below, F.lit(0))


def curve_place(places: list[Column], bits: int) -> Column:
    """One number whose digits are those of all places, highest first in turn (a Z-order curve)."""
    out = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for place in places:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("long"))
    return out


def write_curve(df: DataFrame, path: str, columns: list[str], files: int = 64, bits: int = 5) -> DataFrame:
    """Write rows along a curve over several numeric columns, so that a filter on any of them skips most files.

    Files are ranges of the curve; a hash of the row spreads rows of equal
    values.  ``write_file_index`` stores the least and greatest values of each file.
    """
    places = [rank_digits(df, c, bits) for c in columns]
    marked = df.withColumn("_place", curve_place(places, bits)).withColumn("_spread", F.xxhash64(*df.columns))
    ranged = marked.repartitionByRange(files, "_place", "_spread").sortWithinPartitions("_place")
    ranged.drop("_place", "_spread").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_file_index(stored: DataFrame, columns: list[str], path: str) -> DataFrame:
    """One row per file with the least and greatest value of each column and its number of rows; stored."""
    sides = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    rows = stored.groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns], *sides
    )
    rows.write.mode("overwrite").parquet(path)
    return stored.sparkSession.read.parquet(path)


def read_ranges(stored: DataFrame, index: DataFrame, ranges: dict[str, tuple]) -> tuple[DataFrame, int]:
    """Rows with every column between its bounds, from the files that may hold some, and the number of those files.

    The index has one row per file; only the names of the chosen files reach the driver.
    """
    may_hold = F.lit(True)
    wanted = F.lit(True)
    for column, (low, high) in ranges.items():
        may_hold &= (F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high))
        wanted &= F.col(column).between(low, high)
    names = [r["file"] for r in index.where(may_hold).select("file").collect()]
    spark = stored.sparkSession
    rows = spark.read.schema(stored.schema).parquet(*names) if names else spark.createDataFrame([], stored.schema)
    return rows.where(wanted), len(names)
