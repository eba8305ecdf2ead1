"""One key holds a third of all rows: results must not change."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import aggregates as agg
from larkspur.operators import documents as dc
from larkspur.operators.skew import join_hot_keys
from larkspur.operators.windows import latest_by_key, running_totals
from larkspur.streaming.requests import rate_limit


def hot(spark, n=6000):
    """Rows whose key 0 holds a third of them."""
    return spark.range(n).withColumn("key", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500))


def test_hot_key_join_equals_plain_join(spark):
    rows = hot(spark)
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    want = rows.join(groups, "key").select("id", "key", "n", "first")
    got = join_hot_keys(rows, groups, "key", "n", [F.col("id")]).select("id", "key", "n", "first")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_key_join_spreads_the_hot_key(spark):
    rows = hot(spark)
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = join_hot_keys(rows, groups, "key", "n", [F.col("id")])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_copy_labels_with_one_huge_group(spark):
    texts = hot(spark, 900).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text  "), "key").alias("text"))
    got = dc.label_copies(texts, "doc_id", "text").select("doc_id", "canonical_id")
    want = texts.select("doc_id", F.min("doc_id").over(Window.partitionBy("text")).alias("canonical_id"))
    assert got.exceptAll(want).isEmpty() and got.count() == 900


def timed(spark, n=6000):
    second = (F.col("id") % 7200).cast("int")
    base = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    return hot(spark, n).withColumn("ts", base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second))


def test_running_total_in_slices(spark):
    rows = timed(spark)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.sum("id").over(w).alias("total"))
    got = running_totals(rows, ["key"], [F.date_trunc("MINUTE", "ts")], [F.col("ts"), F.col("id")], {"total": F.col("id")})
    got = got.select("id", "total")
    assert got.exceptAll(want).isEmpty() and got.count() == 6000


def test_rate_limit_counts_every_request(spark):
    rows = timed(spark).withColumn("total_tokens", F.lit(10).cast("bigint"))
    coded = rate_limit(rows, ["key"], "ts", "id", calls=5, unit="MINUTE")
    w = Window.partitionBy("key", F.date_trunc("MINUTE", "ts")).orderBy("ts", "id")
    want = rows.select("id", F.when(F.row_number().over(w) > 5, 429).otherwise(200).alias("response_code"))
    got = coded.select("id", "response_code")
    assert got.exceptAll(want).isEmpty() and coded.where("response_code = 429").count() > 0


def test_order_statistic_is_exact(spark):
    rows = hot(spark).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(42.5)).otherwise((F.col("id") * 7919 % 1009).cast("double")))
    rows = rows.withColumn("g", F.col("id") % 2)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["x"] for r in agg.order_statistic(rows, ["g"], "v", p, "x").collect()}
        for g in (0, 1):
            values = sorted(r["v"] for r in rows.where(F.col("g") == g).select("v").collect())
            assert got[g] == values[int(p * (len(values) - 1))]
        everything = sorted(r["v"] for r in rows.select("v").collect())
        assert agg.order_statistic(rows, [], "v", p, "x").first()["x"] == everything[int(p * (len(everything) - 1))]


def test_latest_by_key_reduces_before_the_shuffle(spark):
    rows = hot(spark)
    got = {r["key"]: r["id"] for r in latest_by_key(rows, ["key"], [F.col("id")]).collect()}
    want = {r["key"]: r["m"] for r in rows.groupBy("key").agg(F.max("id").alias("m")).collect()}
    assert got == want
