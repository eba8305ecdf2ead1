"""A corpus pipeline of five stages, each stored as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import stages
from larkspur.session import ship_package, work_dir

#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("language_id", stages.keep_known_language),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("secrets", stages.mask_secrets),
    ("mixture", stages.mix_sources),
    ("tokens", stages.encode_texts),
]

#: SimHash and language models are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
