"""File sources: binary scans, incremental ingest and table streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def with_provenance(df: DataFrame) -> DataFrame:
    """Add the file each row came from and the time it was taken in."""
    return df.withColumn("source_path", F.col("_metadata.file_path")).withColumn(
        "ingested_at", F.current_timestamp()
    )


def ingest_stream(
    spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Append-only stream of new files with their provenance; each file is read once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return with_provenance(reader.load(path))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is a folder of part files (a single file otherwise)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the rows that arrive in a parquet table, a folder of part files or one file.

    Part files in subfolders belong to the table too.  The file source reads
    folders, so a single file is picked out of its own folder by name.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    if is_folder(spark, path):
        return reader.option("recursiveFileLookup", "true").parquet(path)
    folder, _slash, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)
