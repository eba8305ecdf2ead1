"""Exact top-k and posting lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, exact_topk
from larkspur.llm.queries import QUERIES

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.5]),
        (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [-1.0]), (9, []), (None, [1.0, 1.0]), (20, [0.25, 0.25]), (50, [0.5, 0.0]),
    ]
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[int(q)] = [(n + 1, int(ids[i]), scores[i]) for n, i in enumerate(order)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    return rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)


def test_exact_top_k_equals_brute_force(spark, table):
    ids, x = table
    whole = np.floor(256 * x).astype(np.int64)
    assert ranked(QUERIES["op8_pivot_top_k"](spark, SF).collect()) == brute(ids, whole, ids[ids % 50 == 0], 5)


def test_exact_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "FINE_ROWS", 3)
    monkeypatch.setattr(exact_topk, "FIRST_BLOCKS", 1)
    got = ranked(exact_topk.top_k(odd_vectors(spark), F.col("id") % 50 == 0, k=3).collect())
    # 0: [256, 128]; 6, 7, 7 the same; 20: [64, 64]; 50: [128, 0]; 8: [-256]; 5 and 9: zeros
    same, half = 256 * 256 + 128 * 128, 256 * 128
    assert got[0] == [(1, 6, same), (2, 7, same), (3, 7, same)]
    assert got[50] == [(1, 0, half), (2, 6, half), (3, 7, half)]
    assert exact_topk.top_k(odd_vectors(spark).limit(0), F.col("id") % 50 == 0).collect() == []


def test_exact_top_k_with_clusters_and_ties(spark):
    random = np.random.default_rng(0)
    x = np.repeat(random.integers(-3, 4, (40, 6)), 20, axis=0) + random.integers(0, 2, (800, 6))
    rows = spark.createDataFrame([(i, [float(c) / 256 for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ranked(exact_topk.top_k(rows, F.col("id") % 7 == 0, k=9, pivots=4).collect())
    assert got == brute(np.arange(800), x, np.arange(0, 800, 7), 9)


@pytest.mark.parametrize("greatest", [1e6, 1e8, 1e17, 1e20, 1e300])
def test_exact_top_k_of_large_components(spark, monkeypatch, greatest):
    """Scores beyond the whole numbers of doubles, and beyond a long, in several blocks."""
    monkeypatch.setattr(exact_topk, "FINE_ROWS", 16)
    monkeypatch.setattr(exact_topk, "FIRST_BLOCKS", 2)
    random = np.random.default_rng(3)
    x = random.uniform(-greatest, greatest, (150, 6)) * random.choice([1, 1, 1e-6, 1e-12], (150, 1))
    x[20:30] = x[19]
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    whole = [[min(max(int(c * 256 // 1) if abs(c) < 1e15 else int(c) * 256, -2 ** 400), 2 ** 400) for c in row] for row in x.tolist()]
    wanted = {}
    for q in range(0, 150, 10):
        scores = [min(max(sum(a * b for a, b in zip(whole[q], other)), -2 ** 63), 2 ** 63 - 1) for other in whole]
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:7]
        wanted[q] = [(n + 1, i, scores[i]) for n, i in enumerate(order)]
    assert ranked(exact_topk.top_k(rows, F.col("id") % 10 == 0, k=7, pivots=5).collect()) == wanted


def test_blocks_asked_later_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "FINE_ROWS", 50)
    monkeypatch.setattr(exact_topk, "FIRST_BLOCKS", 1)
    x = np.random.default_rng(7).integers(-3, 4, (700, 5))
    rows = spark.createDataFrame([(i, [float(c) / 256 for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ranked(exact_topk.top_k(rows, F.col("id") % 9 == 0, k=6, pivots=3).collect())
    assert got == brute(np.arange(700), x, np.arange(0, 700, 9), 6)


def test_recall_of_posting_lists(spark, table):
    ids, x = table
    got = ranked(QUERIES["op5_posting_lists"](spark, SF).collect())
    wanted = brute(ids, x, ids[ids % 20 == 0], 20)
    assert got.keys() == wanted.keys() and all(len(rows) == 20 for rows in got.values())
    hits = sum(len({v for _r, v, _s in got[q]} & {v for _r, v, _s in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 20 * len(wanted)
    for q, rows in got.items():
        mine = x[np.flatnonzero(ids == q)[0]]
        for (_r, v, score), after in zip(rows, [*rows[1:], None]):
            assert score == pytest.approx(float(x[np.flatnonzero(ids == v)[0]] @ mine), abs=1e-12)
            assert after is None or (-score, v) < (-after[2], after[1])


def test_recall_with_many_lists(spark, monkeypatch):
    """Vectors of different lengths in clusters, lists that are dealt over tasks, thousands of equal vectors."""
    monkeypatch.setattr(ann, "LIST_ROWS", 32)
    monkeypatch.setattr(ann, "LIST_PART", 40)
    random = np.random.default_rng(1)
    centres = random.normal(size=(30, 16))
    x = centres[random.integers(0, 30, 4_000)] * random.uniform(0.5, 2, (4_000, 1)) + 0.3 * random.normal(size=(4_000, 16))
    x[1_000:2_500] = x[1_000]
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    queries = np.arange(0, 4_000, 40)
    got = ranked(ann.search(rows, F.col("id") % 40 == 0, k=10).collect())
    wanted = brute(np.arange(4_000), x, queries, 10)
    hits = sum(len({v for _r, v, _s in got[q]} & {v for _r, v, _s in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 10 * len(wanted)


def test_lists_read_grow_with_their_number(spark, monkeypatch):
    """A cloud without clusters in about a thousand lists: a fixed number of lists would lose answers."""
    monkeypatch.setattr(ann, "LIST_ROWS", 8)
    x = np.random.default_rng(6).normal(size=(8_000, 32))
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ranked(ann.search(rows, F.col("id") % 40 == 0, k=10).collect())
    wanted = brute(np.arange(8_000), x, np.arange(0, 8_000, 40), 10)
    hits = sum(len({v for _r, v, _s in got[q]} & {v for _r, v, _s in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 10 * len(wanted)


def test_ratio_prunes_and_boundary_vectors_are_copied():
    """In clusters: queries read few of the lists they look at, some vectors have copies and most have not."""
    random = np.random.default_rng(8)
    centres = random.normal(size=(60, 24))
    x = centres[random.integers(0, 60, 6_000)] + 0.35 * random.normal(size=(6_000, 24))
    norm = float((x * x).sum(axis=1).max())
    filled = ann._filled(x, norm)
    centroids = ann.Centroids(ann.refined(ann.balanced_centroids(filled, 200), filled, norm))
    assert len(centroids.points) > ann.SMALL
    at = ann.boundary(centroids, filled, ann.copying_margin(centroids, filled))
    copied = np.mean([len(own) > 1 for own in at])
    assert 0.15 < copied < 0.4
    queries = list(range(0, 6_000, 50))
    held = []
    for q in queries:
        scores = x @ x[q]
        held += [(q, at[v].tolist()) for v in np.argsort(-scores)[:20].tolist()]
    full = np.concatenate([x[queries], np.zeros((len(queries), 1))], axis=1)
    probes, ratio = ann.measured_ratio(centroids, full, queries, held, 0.93)
    read = [ann.lists_to_read(centroids, row, probes, ratio) for row in full]
    assert np.mean([len(own) for own in read]) < 0.5 * len(centroids.points)
    assert min(len(own) for own in read) < probes  # the ratio prunes
    by_query = dict(zip(queries, map(set, (own.tolist() for own in read))))
    assert sum(not by_query[q].isdisjoint(own) for q, own in held) >= 0.93 * len(held)


def test_posting_lists_of_odd_vectors(spark):
    got = ranked(ann.search(odd_vectors(spark), F.col("id") % 10 == 0, k=20).collect())
    assert {q: [v for _r, v, _s in rows] for q, rows in got.items()} == {
        0: [6, 7, 50, 20, 8], 20: [0, 6, 7, 50, 8], 50: [0, 6, 7, 20, 8],
    }
    assert ann.search(odd_vectors(spark).limit(0), F.col("id") % 10 == 0).collect() == []


def test_lists_are_balanced():
    x = np.random.default_rng(2).normal(size=(5_000, 8))
    points = ann.balanced_centroids(x, 50)
    assert 25 <= len(points) <= 100


def test_graph_walk_finds_the_nearest_centroids():
    random = np.random.default_rng(4)
    points = random.normal(size=(800, 12))
    centroids = ann.Centroids(points)
    hits = 0
    for _q in range(50):
        q = random.normal(size=12)
        found, _far = centroids.nearest(q, 10)
        hits += len(set(found.tolist()) & set(np.argsort(((points - q) ** 2).sum(axis=1))[:10].tolist()))
    assert hits >= 0.95 * 500
