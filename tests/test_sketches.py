"""Sketches kept per slice: merged answers within their error, at every grain."""

from pyspark.sql import functions as F

from larkspur.operators import sketches as sk

KEPT = sk.Slices(
    distinct={"users": "user"}, quantiles={"value": "value"}, heavy={"heavy": "user"}, sums={"n": "count(*)"}
)


def test_large_slices_stay_within_the_stated_error(spark):
    """300,000 distinct users and values: beyond what the sketches hold exactly."""
    rows = spark.range(600_000).select(
        (F.col("id") % 300_000).alias("user"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("value"),
        (F.col("id") % 48).alias("hour"),
    )
    slices = KEPT.of(rows, {"hour": F.col("hour")})
    for grain in (F.lit(0), F.floor(F.col("hour") / 24)):
        merged = KEPT.merged(slices, {"grain": grain}).select(
            "grain", "n", sk.distinct_count("users").alias("users"),
            *[sk.quantile("value", p).alias(f"p{int(100 * p)}") for p in (0.05, 0.5, 0.95)],
        ).collect()
        exact = {
            r["grain"]: r for r in rows.groupBy(grain.alias("grain")).agg(
                F.countDistinct("user").alias("users"), F.count("*").alias("n"),
            ).collect()
        }
        for r in merged:
            assert r["n"] == exact[r["grain"]]["n"]
            assert abs(r["users"] - exact[r["grain"]]["users"]) <= 4 / 256 * exact[r["grain"]]["users"]
            for p in (0.05, 0.5, 0.95):  # values are spread evenly, so a rank error is a value error
                assert abs(r[f"p{int(100 * p)}"] / 1_000_003 - p) < 0.004


def test_small_slices_are_exact_and_later_rows_add_slices(spark, tmp_path):
    path = str(tmp_path / "slices")
    first = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0), (2, 5.0, 1), (None, None, 1)], "user int, value double, hour int")
    second = spark.createDataFrame([(2, 3.0, 1), (3, 4.0, 1), (2, 9.0, 0)], first.schema)
    for part in (first, second, first.limit(0)):
        KEPT.of(part, {"hour": F.col("hour")}).write.mode("append").parquet(path)
    merged = KEPT.merged(spark.read.parquet(path), {"all": F.lit("all")})
    row = merged.select(
        "n", sk.distinct_count("users").alias("users"), sk.quantile("value", 0.5).alias("p50"), sk.quantile("value", 0.0).alias("p0"),
        sk.quantile("value", 1.0).alias("p100"), sk.heavy_items("heavy", 1).alias("top"),
    ).first()
    assert (row["n"], row["users"], row["p50"], row["p0"], row["p100"]) == (7, 3, 3.0, 1.0, 9.0)
    assert [(x["item"], x["count"]) for x in row["top"]] == [(2, 4)]


def test_slices_without_values(spark):
    rows = spark.createDataFrame([(None, None, 1)], "user int, value double, hour int")
    row = KEPT.merged(KEPT.of(rows, {"hour": F.col("hour")}), {"all": F.lit(1)}).select(
        sk.distinct_count("users").alias("users"), sk.quantile("value", 0.5).alias("p50")
    ).first()
    assert (row["users"], row["p50"]) == (0, None)
