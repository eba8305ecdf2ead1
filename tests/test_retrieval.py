import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import similarity as sim
from larkspur.operators import keyword as kw
from larkspur.operators.inverted import InvertedIndex
from larkspur.operators import topk
from larkspur.operators import vectors as vec


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([2.0, 2.0], [4.0, 4.0], [2.0, -2.0])], "a array<double>, b array<double>, c array<double>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    row = df.select(
        sim.cosine(a, b).alias("same"), sim.dot(a, b).alias("far"), sim.dot(a, a).alias("near"),
        sim.cosine(a, c).alias("right_angle"), sim.dot(sim.l2_normalize(a), sim.l2_normalize(b)).alias("units"),
    ).first()
    assert row["same"] == pytest.approx(1.0) and row["units"] == pytest.approx(row["same"])
    assert (row["far"], row["near"]) == (16.0, 8.0)
    assert row["right_angle"] == pytest.approx(0.0)


def test_toy_precision_recall(spark):
    hits = spark.createDataFrame([(1, f"doc{d}", i + 1) for i, d in enumerate([1, 2, 4, 5])], "q int, d string, rank int")
    gold = spark.createDataFrame([(1, f"doc{d}") for d in (1, 3, 5, 6)], "q int, d string")
    row = kw.retrieval_metrics(hits, gold, "q", "d", 4).first()
    assert (row["precision"], row["recall"], row["reciprocal_rank"]) == (0.5, 0.5, 1.0)


def test_metrics_without_relevant_hit(spark):
    hits = spark.createDataFrame([(1, "x", 1)], "q int, d string, rank int")
    gold = spark.createDataFrame([(1, "y")], "q int, d string")
    row = kw.retrieval_metrics(hits, gold, "q", "d", 3).first()
    assert (row["precision"], row["recall"], row["reciprocal_rank"]) == (0.0, 0.0, 0.0)


def brute(matrix, queries, k):
    m = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    scores = np.round(q @ m.T, 9)
    return {
        (qi, int(i)) for qi in range(len(q)) for i in np.lexsort((np.arange(len(m)), -scores[qi]))[:k]
    }


def frames(spark, matrix, queries):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, query_vector array<float>")
    return corpus, asked


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(300, 8)).astype(np.float32)
    matrix[100:200] = matrix[0]  # a third of the corpus is one vector: ties go by id
    queries = rng.normal(size=(23, 8)).astype(np.float32)
    corpus, asked = frames(spark, matrix, queries)
    want = brute(matrix.astype(float), queries.astype(float), 7)
    whole = vec.search(corpus.repartition(5), asked, 7)
    assert {(r["query_id"], r["vec_id"]) for r in whole.collect()} == want
    monkeypatch.setattr(topk, "BLOCK_BYTES", 5 * (8 * 8 + 64))
    monkeypatch.setattr(topk, "PART_ROWS", 70)
    monkeypatch.setattr(topk, "CELLS_PER_STEP", 64)
    parts = vec.search(corpus.repartition(5), asked, 7)
    assert {(r["query_id"], r["vec_id"]) for r in parts.collect()} == want


def test_search_checks_the_dimension_and_metric(spark):
    corpus, asked = frames(spark, np.ones((3, 4), np.float32), np.ones((1, 5), np.float32))
    with pytest.raises(Exception, match="every vector must have 5 elements"):
        vec.search(corpus, asked, 2).collect()
    with pytest.raises(ValueError):
        vec.search(corpus, asked, 2, metric="manhattan")


def test_search_with_string_ids_and_no_queries(spark):
    corpus, asked = frames(spark, np.eye(4, dtype=np.float32), np.eye(4, dtype=np.float32)[:2])
    named = corpus.withColumn("vec_id", F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")))
    best = {r["query_id"]: r["vec_id"] for r in vec.search(named, asked, 1).collect()}
    assert best == {0: "chunk-0", 1: "chunk-1"}
    assert vec.search(corpus, asked.limit(0), 3).count() == 0


def test_cell_search_recall_and_stored_layout(spark, tables, tmp_path):
    asked = tables.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = vec.search(tables.embeddings, asked, 10)
    index = vec.build_cell_index(tables.embeddings, "vec_id", "embedding", cells=8).write(str(tmp_path / "cells"))
    found = vec.search_cells(index, asked, 10, nprobe=5)
    recall = vec.recall_at_k(exact, found, "query_id", "vec_id").agg(F.avg("recall")).first()[0]
    assert recall >= 0.8
    everything = vec.search_cells(index, asked, 10, nprobe=8)
    assert vec.recall_at_k(exact, everything, "query_id", "vec_id").agg(F.min("recall")).first()[0] == 1.0


def test_keyword_blocks_give_the_same_answer(spark, tables, monkeypatch):
    index = kw.text_index(tables.documents, "doc_id", "text")
    asked = tables.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    whole = kw.keyword_search(index, asked, 5).collect()
    monkeypatch.setattr(topk, "BLOCK_BYTES", 40_000)
    parts = kw.keyword_search(index, asked, 5).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_keyword_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue bird sings"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "Red?")], "query_id int, query_text string")
    got = {r["doc_id"]: r["score"] for r in kw.keyword_search(kw.text_index(docs, "doc_id", "text"), asked, 5).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 8 / 3
    want = {
        d: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) for d, tf, dl in ((1, 1, 2), (2, 2, 3))
    }
    assert got == pytest.approx(want, abs=1e-8)


def test_passages_inside_words_and_short_ones(spark):
    docs = spark.createDataFrame([(1, "xx the red fox runsaway yy"), (2, "the red fox"), (3, "the redfox runs")], "doc_id int, text string")
    passages = spark.createDataFrame([(9, "he red fox runs"), (8, "he red fox")], "item_id int, text string")
    got = {tuple(r) for r in kw.documents_containing(docs, passages).collect()}
    assert got == {(9, 1), (8, 1), (8, 2)}
    short = spark.createDataFrame([(9, "red fox")], "item_id int, text string")
    assert {tuple(r) for r in kw.documents_containing(docs, short).collect()} == {(9, 1), (9, 2)}
    hot = spark.range(3000).select("id", F.concat(F.lit("all the same words "), F.col("id"), F.lit(" end")).alias("text"))
    common = spark.createDataFrame([(1, "l the same words 7 en"), (2, "the same words"), (3, "no such words here"), (4, None)], "item_id int, text string")
    got = kw.documents_containing(hot, common, doc="id").groupBy("item_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 3000)}


@pytest.mark.parametrize("indexed", [False, True])
def test_any_number_of_short_passages(spark, tmp_path, monkeypatch, indexed):
    """Passages of at most two words in many blocks, next to long ones, against plain containment."""
    monkeypatch.setattr(kw, "SHORT_BYTES", 300)
    docs = [(i, f"red{i} fox {i % 7} -- İx the end of {i} all") for i in range(60)] + [(100, None), (101, "")]
    passages = [(i, f"ed{i} fo") for i in range(25)] + [
        (200, ""), (201, "--"), (202, " "), (203, "x the end o"), (204, "d of 5 al"), (205, None), (206, "fox 3 --"), (207, "x the end o"),
        (208, "- İx th"), (209, "no such thing here"),
    ]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    asked = spark.createDataFrame(passages, "item_id int, text string")
    if indexed:
        index = InvertedIndex(spark, str(tmp_path)).add(frame, "doc_id", "text")
        got = kw.indexed_documents_containing(index, frame, asked)
    else:
        got = kw.documents_containing(frame, asked)
    wanted = {(p, d) for p, own in passages for d, text in docs if own is not None and text is not None and own in text}
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)


def test_rerank_moves_the_specific_clause_up(spark):
    docs = spark.createDataFrame(
        [(1, "refund refund fare fare rules for every fare and refund"), (2, "a basic economy fare is non refundable within hours")],
        "doc_id int, text string",
    )
    asked = spark.createDataFrame([(1, "basic economy fare refund")], "query_id int, query_text string")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc_id int, rank int")
    out = kw.rerank(hits, asked, docs, "query_id", "query_text", "doc_id", "text", 2).orderBy("rank_after").collect()
    assert [r["doc_id"] for r in out] == [2, 1] and out[0]["moved_up"] == 1


def test_fusion_cap():
    with pytest.raises(ValueError):
        kw.fuse_ranks(None, None, "q", "d", 201)


def test_lookup_join_keeps_rows_without_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "k int, v array<float>")
    corpus = spark.createDataFrame([(5, [1.0, 0.1]), (6, [0.0, 1.0])], "i int, e array<float>")
    got = {r["k"]: r["matches"] for r in vec.lookup_join(rows, "k", "v", corpus, "i", "e", 1).collect()}
    assert got == {1: [5], 2: None}


def test_search_rows_filters_and_shows_columns(spark, tables):
    corpus = tables.embeddings.withColumn("name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    asked = corpus.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    out = vec.search_rows(corpus, asked, 3, ["name", "label"], {"label": [1, 2]})
    assert out.columns == ["query_id", "rank", "name", "label", "score"]
    rows = out.collect()
    assert len(rows) == 12 and {r["label"] for r in rows} <= {1, 2}
    want = vec.search(corpus.where("label IN (1, 2)"), asked, 3).collect()
    got = {(r["query_id"], r["rank"], r["name"]) for r in vec.search_rows(corpus, asked, 3, ["name"], "label IN (1, 2)").collect()}
    assert got == {(r["query_id"], r["rank"], f"v{r['vec_id']}") for r in want}
    with pytest.raises(ValueError):
        vec.search_rows(corpus, asked, 3, ["name"], {"colour": 1})


def test_queries_in_many_blocks_keep_one_plan(spark, monkeypatch):
    matrix = np.random.default_rng(0).normal(size=(60, 4)).astype(np.float32)
    corpus, asked = frames(spark, matrix, matrix)
    monkeypatch.setattr(topk, "PART_ROWS", 25)

    def plan(block_bytes):
        monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
        return vec.search(corpus, asked, 2)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(300) == plan(3000)


def test_query_vectors_are_views_of_one_buffer():
    """A block of queries costs its vectors' bytes, not a Python number per component; other columns are plain values."""
    vectors = pa.chunked_array([pa.array([[0.5, 1.0], [2.0]], pa.list_(pa.float32())), pa.array([[3.0, 4.0]], pa.list_(pa.float32()))])
    rows = topk._query_rows(pa.table({"q": [1, 2, 3], "v": vectors, "t": [["a"], [], None], "n": [[1.0, None], None, []]}))
    assert [r["v"].tolist() for r in rows] == [[0.5, 1.0], [2.0], [3.0, 4.0]]
    assert all(not r["v"].flags.owndata and r["v"].dtype == np.float32 for r in rows)
    assert [(r["q"], r["t"], r["n"]) for r in rows] == [(1, ["a"], [1.0, None]), (2, [], None), (3, None, [])]
    assert topk._query_rows(pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float32()))})) == []


def test_single_precision_only_leaves_out_what_cannot_be_among_the_best(monkeypatch):
    """Few pairs are scored exactly, however many equal vectors there are, and the answer is that of all pairs in doubles."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6_000, 16)).astype(np.float32)
    vectors[2_000:3_000] = vectors[7]  # copies
    vectors[3_000:3_200] = vectors[8] + rng.normal(size=(200, 16)).astype(np.float32) * 1e-7  # equal in single precision
    vectors[4_000] = np.nan
    items = rng.permutation(len(vectors))
    asked = vec.unit_rows(vectors[:40].astype(float))
    unit = vec.unit_rows(vectors.astype(float))
    scores = np.round(asked @ unit.T, 9)
    want = {(q, items[i]) for q in range(40) for i in np.lexsort((items, -np.nan_to_num(scores[q], nan=-9)))[:5]}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * 16), pa.array(vectors.ravel()))
    whole = pa.RecordBatch.from_arrays([pa.array(items), lists], names=["vec_id", "embedding"])
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    rows = [{"q": q} for q in range(40)]
    given, add_pairs = [], topk.BestPerQuery.add_pairs
    monkeypatch.setattr(topk.BestPerQuery, "add_pairs", lambda self, *a: given.append(len(a[0])) or add_pairs(self, *a))
    for size in (6_000, 700, 3):
        given.clear()
        shared = vec.UnitBatch(16, 5)
        tiles = [(range(n, n + 20), vec.CosineTile(asked[n : n + 20], shared)) for n in (0, 20)]
        batches = iter([whole.slice(n, size) for n in range(0, len(vectors), size)])
        found = list(topk._best_rows(batches, rows, "q", tiles, 5, schema))
        assert {(r["q"], r["vec_id"]) for b in found for r in b.to_pylist()} == want
        assert size == 3 or sum(given) < 40 * len(vectors) / 10
