"""Bucketed tables: what a merge writes, what a difference reads, what a crash leaves."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import changes, storage
from larkspur.sources.keyed import KeyedTable
from larkspur.sources.versions import Versions

SCHEMA = "k long, v string, n int"


def rows(df):
    return sorted(map(tuple, df.select("k", "v", "n").collect()), key=str)


def test_random_merges_and_deletions_equal_the_plain_upsert(spark, tmp_path):
    draw = random.Random(4)
    start = [(i, f"v{i}", draw.choice([None, 1, 5])) for i in range(200)] + [(None, f"no key {i}", 1) for i in range(30)]
    plain = spark.createDataFrame(start, SCHEMA)
    table = KeyedTable(spark, str(tmp_path)).create(plain, ["k"], buckets=16)
    state = rows(plain)
    for step in range(4):
        some = [(draw.choice([None, draw.randrange(260)]), f"s{step}-{i}", draw.choice([None, 0, 3, 9])) for i in range(25)]
        some = list({(k if k is not None else f"null{i}"): (k, v, n) for i, (k, v, n) in enumerate(some)}.values())
        updates = spark.createDataFrame(some, SCHEMA)
        gone = spark.createDataFrame([(draw.randrange(260),) for _i in range(5)] + [(None,)], "k long")
        table = table.merge(updates, "n").delete(gone)
        now = changes.delete_keys(changes.upsert(spark.createDataFrame(state, SCHEMA), updates, ["k"], "n"), gone, ["k"])
        state = rows(now)
        assert rows(table.rows()) == state
        assert sum(e["rows"] for e in table.record["entries"].values()) == len(state)
    assert rows(KeyedTable(spark, str(tmp_path), version=0).rows()) == rows(plain)  # earlier versions stay readable


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path)
    big = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n"))
    table = KeyedTable(spark, root).create(big, ["k"], buckets=32)
    whole = storage.size(spark, f"{root}/data")
    after = table.merge(spark.createDataFrame([(5, "new", 2)], SCHEMA), "n")
    assert storage.size(spark, f"{root}/data") - whole < whole / 16
    assert len(table.changed_buckets(after)) == 1
    assert sum(a["path"] != after.record["entries"][b]["path"] for b, a in table.record["entries"].items()) == 1
    # the difference opens the files of that bucket only
    bucket = table.changed_buckets(after)
    assert len(after.rows(bucket).inputFiles()) < len(after.rows().inputFiles()) / 16
    assert [tuple(r) for r in table.changes_to(after, ["v", "n"]).collect()] == [(5, "update")]
    assert after.merge(big.limit(0), "n").version == after.version


def test_versions_with_equal_content_share_their_digest(spark, tmp_path):
    first = spark.createDataFrame([(i, f"v{i}", 1) for i in range(100)], SCHEMA)
    a = KeyedTable(spark, str(tmp_path / "a")).create(first, ["k"], buckets=8)
    b = KeyedTable(spark, str(tmp_path / "b")).create(first.repartition(3), ["k"], buckets=8)
    assert a.digest == b.digest and a.changed_buckets(b) == [] and a.changes_to(b, ["v"]).collect() == []
    again = a.create(first.orderBy("v"), ["k"])
    assert again.digest == a.digest and again.record["entries"] == a.record["entries"]  # nothing was written
    c = b.merge(spark.createDataFrame([(3, "other", 2), (700, "more", 1)], SCHEMA), "n").delete(spark.createDataFrame([(9,)], "k long"))
    status = a.sync_status(c, ["v"]).first()
    assert tuple(status) == (100, 100, 1, 1, 1)
    with pytest.raises(ValueError):
        a.changed_buckets(KeyedTable(spark, str(tmp_path / "d")).create(first, ["k"], buckets=4))


def test_a_crash_before_the_record_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path)).create(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), ["k"], buckets=4)
    monkeypatch.setattr(Versions, "add", lambda self, after, **record: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.merge(spark.createDataFrame([(1, "lost", 2)], SCHEMA), "n")
    monkeypatch.undo()
    again = KeyedTable(spark, str(tmp_path))
    assert again.version == 0 and rows(again.rows()) == [(1, "a", 1), (2, "b", 1)]
    assert rows(again.merge(spark.createDataFrame([(1, "kept", 2)], SCHEMA), "n").rows()) == [(1, "kept", 2), (2, "b", 1)]
