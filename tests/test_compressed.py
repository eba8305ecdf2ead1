"""Search over codes: recall, exact scores, what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import compressed as cp
from larkspur.operators import vectors as vec
from larkspur.sources import storage


@pytest.fixture(scope="module")
def clouds(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(20, 32))
    x = (centres[random.integers(0, 20, 3_000)] + 0.5 * random.normal(size=(3_000, 32))).astype(np.float32)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows, asked


def test_recall_scores_and_bytes(spark, clouds, tmp_path):
    rows, asked = clouds
    index = cp.build(rows.unionAll(spark.createDataFrame([(9_999, None)], rows.schema)), "vec_id", "embedding", str(tmp_path), cells=20)
    found = cp.search(index, asked, 10, nprobe=6)
    exact = vec.search(rows, asked, 10)
    recall = vec.recall_at_k(exact, found, "query_id", "vec_id").agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    both = found.join(vec.search(rows, asked, 3_000).withColumnRenamed("score", "whole").drop("rank"), ["query_id", "vec_id"])
    assert both.count() == 300 and both.where(F.abs(F.col("score") - F.col("whole")) > 1e-6).isEmpty()
    assert index.bytes_per_vector() == (16, 128)
    assert storage.size(spark, f"{tmp_path}/codes") < 3_000 * 128
    everything = cp.search(index, asked, 5, nprobe=20, depth=600)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, vec.search(rows, asked, 5).collect()))


def test_few_vectors_and_no_queries(spark, clouds, tmp_path):
    rows, asked = clouds
    few = rows.limit(5)
    index = cp.build(few, "vec_id", "embedding", str(tmp_path), cells=2, parts=5)
    got = cp.search(index, asked.limit(3), 10, nprobe=2)
    assert got.groupBy("query_id").count().collect()[0]["count"] == 5
    assert cp.search(index, asked.limit(0), 10, nprobe=2).collect() == []
