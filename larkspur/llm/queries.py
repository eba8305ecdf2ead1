"""Registered queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import (
    ann, bpe, exact_topk, hard_negatives, html_text, language_id, line_dedup,
    mixing, packing, secret_scan, simhash, token_counts, vector_codes,
)
from larkspur.llm.oracles import LINES_SQL, NEGATIVES_SQL, codes_sql
from larkspur.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(~language_id.learned_rows(F.col("doc_id")), F.lit(False))
    return language_id.identify(docs, language_id.train(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char", "accepted"
    )


@query("op2_packed_ids")
def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks)


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query("op4_mixture")
def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_posting_lists")
def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


OP8_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM valid q JOIN valid v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_pivot_top_k", OP8_SQL)
def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op9_simhash_groups")
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return grouped.select(
        "doc_id",
        simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks)


@query("op11_vector_codes", codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes.rows).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(vector_codes.codebook_digest(codes.codebooks)).alias("codebooks_sha256"),
    )


@query("op12_line_dedup", LINES_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stripped = line_dedup.LineIndex(spark).insert(docs).strip(docs)
    return stripped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0)
