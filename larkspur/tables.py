"""Table access: names resolve to parquet paths or to catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import ship_package

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# tables whose rows are long texts: work per row is high, so few scan tasks are slow
TEXT_TABLES = ("documents", "pages")


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Spread the rows when the scan has fewer tasks than the session has cores.

    A file with a single row group is read by one task.  Large tables have far
    more splits than cores and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Resolve table names to DataFrames: ``t.orders`` or ``t["orders"]``."""

    def __init__(self, spark: SparkSession, directory: str | None = None, schema: str | None = None):
        ship_package(spark)
        self.spark = spark
        self.directory = directory.rstrip("/") if directory else None
        self.schema = schema

    def path(self, name: str) -> str:
        if self.directory is None:
            raise ValueError("these tables come from the catalog, not from files")
        return f"{self.directory}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if self.directory is not None:
            rows = self.spark.read.parquet(self.path(name))
            return spread_small_scan(rows) if name in TEXT_TABLES else rows
        return self.spark.table(f"{self.schema}.{name}" if self.schema else name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return self[name]
