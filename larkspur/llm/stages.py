"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, language_id, mixing, secret_scan, simhash
from larkspur.llm.queries import vocabulary
from larkspur.session import cut_lineage, ship_package


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the models reject: no letter, or far from every language."""
    ship_package(spark)
    return language_id.keep_accepted(docs, language_id.train(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: that with the smallest ``doc_id``, one row of it.

    Rows are numbered once and stored with their numbers: those of two reads
    would differ where files are packed into tasks in another way.  A NULL ``doc_id`` comes last in its group.  The kept rows are
    found by a merge join at every size: their numbers grow with the input, so
    they are not broadcast, and the plan of a small run is that of a large one.
    """
    ship_package(spark)
    row = F.monotonically_increasing_id()
    rows = cut_lineage(docs.select(F.struct(*docs.columns).alias("document"), row.alias("row")))
    own = F.col("document.doc_id")
    key = F.struct(own.isNull().alias("no_id"), own.alias("doc_id"), "row")
    numbered = rows.select(key.alias("key"), F.col("document.text").alias("text"))
    groups = simhash.near_duplicate_groups(numbered, "key")
    kept = groups.where(F.col("key") == F.col("component")).select(F.col("key.row").alias("row"))
    kept = cut_lineage(kept)
    return rows.join(kept.hint("merge"), "row", "left_semi").select(
        *[F.col("document").getField(name).alias(name) for name in docs.columns]
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in ``text`` by a mask and keep ``n_chars`` right."""
    ship_package(spark)
    return secret_scan.mask_secrets(docs, "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that the sources come to their target weights."""
    ship_package(spark)
    return mixing.repeat_to_weights(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; return ``doc_id``, ``n_tokens`` and digests of ids and decoded bytes."""
    ship_package(spark)
    return bpe.digests(docs, bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")))
