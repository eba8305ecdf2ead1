"""The stored inverted index against the scan of all token arrays."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.operators import inverted
from larkspur.operators import keyword as kw
from larkspur.operators import topk
from larkspur.operators.inverted import InvertedIndex, Segment, SegmentPostings
from larkspur.sources import storage
from larkspur.sources.versions import Conflict, Versions

from conftest import SF


def found(df):
    return sorted((r[0], r["rank"], r[1], round(r["score"], 8)) for r in df.collect())


def scanned(docs, asked, k, item="doc_id"):
    return found(kw.keyword_search(kw.text_index(docs, item, "text"), asked, k, item=item))


@pytest.fixture(scope="module")
def asked(tables):
    return tables.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def test_index_equals_the_scan(spark, tables, asked, tmp_path, monkeypatch):
    docs = tables.documents
    index = InvertedIndex(spark, str(tmp_path)).add(docs, "doc_id", "text")
    for k in (1, 10):
        assert found(index.search(asked, k)) == scanned(docs, asked, k)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(inverted, "FEW_TERMS", 3)
    assert found(index.search(asked, 4)) == scanned(docs, asked, 4)


def test_changes_and_compaction(spark, tables, asked, tmp_path):
    """Removed, replaced and added documents: scores are those of the documents that are left."""
    docs = tables.documents.select("doc_id", "text")
    index = InvertedIndex(spark, str(tmp_path)).add(docs.where("doc_id % 3 > 0"), "doc_id", "text")
    index = index.add(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    now = docs.where("doc_id % 5 <> 1")
    index = index.remove(docs.where("doc_id % 5 = 1").unionAll(spark.createDataFrame([(-7, "x")], docs.schema)), "doc_id")
    assert found(index.search(asked, 10)) == scanned(now, asked, 10)
    edit = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("refund policy "), "text")).otherwise(F.col("text"))
    feed = now.where("doc_id % 4 < 2").select(
        "doc_id", edit.alias("text"), F.when(F.col("doc_id") % 4 == 1, "delete").otherwise("update").alias("op")
    ).unionAll(spark.createDataFrame([(10**9, "a refund policy of our own", "insert")], "doc_id long, text string, op string"))
    index = index.apply(feed, "doc_id", "text")
    now = now.where("doc_id % 4 > 1").unionAll(feed.where("op <> 'delete'").drop("op"))
    wanted = scanned(now, asked, 10)
    assert found(index.search(asked, 10)) == wanted
    index = index.compact()
    assert len(index.commits) == 1 and found(index.search(asked, 10)) == wanted
    used = {c[n] for c in index.commits for n in ("docs", "postings")}
    assert index.versions.remove_unused(used) > 0 and found(InvertedIndex(spark, str(tmp_path)).search(asked, 10)) == wanted


def test_a_search_reads_only_its_terms(spark, tables, tmp_path):
    index = InvertedIndex(spark, str(tmp_path)).add(tables.documents, "doc_id", "text")
    one = spark.createDataFrame([(1, "refund")], "query_id int, query_text string")
    vocabulary = spark.createDataFrame([("refund",)], "term string")
    files = index.postings(vocabulary).select(F.input_file_name()).distinct().count()
    assert files <= 16 and {r["term"] for r in index.postings(vocabulary).collect()} <= {"refund"}
    plan = index.postings(vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert found(index.search(one, 5)) == scanned(tables.documents, one, 5)


def test_odd_texts_and_empty_indexes(spark, tmp_path):
    docs = spark.createDataFrame(
        [("b", "red fox"), ("a", "red fox"), ("c", None), ("d", ""), ("e", "Fox " * 3000 + "İstanbul"), ("f", "...")], "doc string, text string"
    )
    queries = spark.createDataFrame([(1, "RED fox"), (2, ""), (3, None), (4, "nothing like it"), (5, "i̇stanbul")], "query_id int, query_text string")
    index = InvertedIndex(spark, str(tmp_path / "a")).add(docs, "doc", "text")
    assert found(index.search(queries, 3, item="doc")) == scanned(docs, queries, 3, "doc")
    assert found(index.search(queries.limit(0), 3, item="doc")) == []
    empty = InvertedIndex(spark, str(tmp_path / "b"))
    assert empty.search(queries, 3, item="doc").collect() == []
    empty = empty.add(docs.limit(0), "doc", "text")
    assert empty.search(queries, 3, item="doc").collect() == []
    assert found(empty.add(docs, "doc", "text").remove(docs, "doc").search(queries, 3, item="doc")) == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.add(-1, name="first") == 0
    with pytest.raises(Conflict):
        versions.add(-1, name="second")
    assert [c["name"] for c in versions.commits()] == ["first"]
    assert storage.names(spark, f"{tmp_path}/staging") == []


def test_blocks_without_a_candidate_are_skipped():
    """A rare and a very common term: most blocks of the common one are never decoded, the answer is exact."""
    draw = np.random.default_rng(1)
    n = 6_000
    tokens = [["the"] * int(draw.integers(1, 4)) + ["filler"] * int(draw.integers(5, 60)) for _doc in range(n)]
    rare = {17, 2_400, 2_401, 5_990, 5_999, 700, 701, 702, 703, 704}
    for doc in rare:
        tokens[doc] += ["rare"] * 3
    segment = Segment(list(range(n)), [len(t) for t in tokens], tokens)
    blocks = list(segment.blocks())
    names = ("term", "base", "n", "most", "least", "offsets", "counts", "lengths")
    rows = sorted(blocks, key=lambda b: (b[0], b[1]))
    mean = float(segment.lengths.mean())
    one = SegmentPostings({name: [r[i] for r in rows] for i, name in enumerate(names)}, mean, np.array([17]))
    docs, scores = one.best(["the", "rare"], [0.05, 6.0], 5)
    wanted = {}
    for doc, words in enumerate(tokens):
        if doc != 17:
            s = sum(w * inverted.impact(words.count(t), len(words), mean) for t, w in (("rare", 6.0), ("the", 0.05)) if t in words)
            wanted[doc] = round(s, topk.SCORE_DIGITS)
    best = sorted(wanted.items(), key=lambda p: (-p[1], p[0]))[:5]
    assert [(d, s) for d, s in zip(docs.tolist(), scores.tolist())] == best
    total = sum(r[0] in ("the", "rare") for r in rows)
    assert one.decoded < total / 3


def test_a_segment_holds_tokens_as_numbers_and_gives_runs_back(monkeypatch):
    """Runs of any size make the same segment as all documents at once, and no run exceeds its bound by more than a document."""
    draw = np.random.default_rng(2)
    tokens = [[f"w{int(w)}" for w in draw.zipf(1.3, int(draw.integers(0, 60))) % 500] for _doc in range(700)]
    items = draw.permutation(700).tolist()
    whole = Segment(items, [len(t) for t in tokens], tokens)
    parts = Segment()
    for a in range(0, 700, 90):
        own = tokens[a:a + 90]
        parts.add(items[a:a + 90], np.array([len(t) for t in own]), pa.array(own, pa.list_(pa.string())).flatten())
    assert all(c.dtype == np.int32 for c in parts.codes)  # no strings are held, one number a token
    parts.close()
    assert sorted(parts.blocks()) == sorted(whole.blocks())
    monkeypatch.setattr(inverted, "RUN_TOKENS", 300)
    monkeypatch.setattr(inverted, "RUN_BLOCKS", 7)
    assert list(parts.blocks()) == list(whole.blocks())
    held = {}
    for first, end, terms, counts, offsets in parts.documents():
        assert len(terms) <= 300 + 60
        for i in range(first, end):
            own = slice(offsets[i - first], offsets[i - first + 1])
            held[parts.items[i]] = dict(zip(terms.to_pylist()[own], counts[own].tolist()))
    assert held == {item: {w: t.count(w) for w in t} for item, t in zip(items, tokens)}
