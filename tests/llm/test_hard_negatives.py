"""Hard negatives and the cover tree against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import cover_tree, hard_negatives
from larkspur.llm.cover_tree import CoverTree, Window
from larkspur.llm.whole import LONG_MAX, LONG_MIN

SCHEMA = "vec_id long, embedding array<double>, label string, rank string, score string"


def brute(rows, anchor, positives=5, negatives=10, scale=256):
    kept = {
        (i, label, tuple(min(max(math.floor(scale * c), -2 ** 400), 2 ** 400) for c in v)) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), LONG_MIN), LONG_MAX)

    for i, label, x in kept:
        if not anchor(i):
            continue
        others = sorted(((-score(x, y), j, other) for j, other, y in kept if j != i), key=lambda r: r[:2])
        for p, pid, _label in [r for r in others if r[2] == label][:positives]:
            found = [(s, j) for s, j, other in others if other != label and -30 * p <= -100 * s <= -90 * p]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(found[:negatives])]
    return sorted(out)


def check(spark, rows, anchor, every, **options):
    vectors = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    got = hard_negatives.mine(vectors, F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows, anchor, **options)
    return found


def cloud(n, width, seed, labels=4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0.2, 0.5) for _c in range(width)] for _centre in range(12)]
    return [
        (i, [c * draw.uniform(0.5, 2) + 0.2 * draw.gauss(0, 1) for c in draw.choice(centres)], str(i % labels)) for i in range(n)
    ]


def test_negatives_equal_brute_force(spark):
    rows = cloud(900, 6, 3)
    assert check(spark, rows, lambda i: i % 40 == 0, 40)


def test_many_cells_and_hot_groups(spark, monkeypatch):
    """Anchors ask some cells first and the others with a limit; a third of the rows are equal, large cells are dealt."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "FIRST_CELLS", 2)
    monkeypatch.setattr(hard_negatives, "SALTS", 3)
    rows = cloud(500, 5, 8, labels=3)
    rows += [(1_000 + i, rows[4][1], "1") for i in range(150)] + [(2_000 + i, rows[6][1], str(i % 3)) for i in range(100)]
    assert check(spark, rows, lambda i: i % 50 == 0, 50)
    assert check(spark, rows, lambda i: i % 50 == 0, 50, positives=2, negatives=30)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], "a"), (0, [1.0, 0.5], "a"), (0, [0.5, 0.5], "a"), (0, [1.0, 0.5], "b"), (1, None, "a"), (2, [nan, 1.0], "a"),
        (3, [inf, 1.0], "b"), (4, [None, 1.0], "b"), (5, [0.0, 0.0], "b"), (6, [1.0, 0.5], None), (7, [1.0, 0.5], "a"),
        (8, [0.5], "b"), (9, [], "c"), (None, [1.0, 1.0], "c"), (20, [0.25, 0.25], "c"), (50, [0.5, 0.0], "b"),
        (50, [0.5, 0.0], "b"), (51, [0.4, 0.1], "c"), (60, [-1.0, -1.0], "a"),
    ]
    assert check(spark, rows, lambda i: i % 10 == 0, 10)
    vectors = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    assert hard_negatives.mine(vectors.limit(0), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives.mine(vectors, F.lit(None).cast("boolean")).collect() == []
    assert hard_negatives.mine(vectors.where("vec_id = 9"), F.col("id") == 9).collect() == []


@pytest.mark.parametrize("greatest", [1e6, 1e7, 1e17, 1e200])
def test_large_scores(spark, greatest):
    draw = random.Random(6)
    rows = [(i, [greatest * draw.choice((1, 1e-4)) * draw.uniform(-0.5, 1) for _c in range(4)], str(i % 2)) for i in range(120)]
    check(spark, rows, lambda i: i % 20 == 0, 20)


def test_score_window():
    assert hard_negatives.score_window(100) == Window(30, 90)
    assert hard_negatives.score_window(7) == Window(3, 6)
    assert hard_negatives.score_window(0) == Window(0, 0)
    low, high = hard_negatives.score_window(-50)
    assert low > high


@pytest.mark.parametrize("seed", range(4))
def test_tree_covers_separates_and_prunes(seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, 6)) * 300
    x = np.floor(centres[draw.integers(0, 40, 3_000)] + draw.normal(size=(3_000, 6)) * 15)
    labels = draw.integers(0, 5, 3_000)
    tree = CoverTree(x, np.arange(3_000), labels)
    assert sorted(tree.ids.tolist()) == list(range(3_000))
    for node in range(len(tree.starts)):
        rows = slice(tree.starts[node], tree.ends[node])
        assert np.sqrt(((tree.x[rows] - tree.centres[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        children = range(tree.first[node], tree.last[node])
        if len(children) > 1:
            full = np.concatenate([tree.centres, cover_tree.augmented(tree.centres, tree.norm)[:, None]], axis=1)[list(children)]
            gaps = np.sqrt(((full[:, None] - full[None]) ** 2).sum(axis=2))[~np.eye(len(full), dtype=bool)]
            assert gaps.min() >= min(tree.chord[node] / 2, max(tree.chord[c] for c in children)) - 1e-6
    scores = (x @ x[17]).astype(np.int64)
    windows = [Window(int(np.quantile(scores, a)), int(np.quantile(scores, b))) for a, b in ((0.6, 0.9), (0.2, 0.3))]
    found = tree.best(x[17], 17, int(labels[17]), False, windows, 10)
    for (ids, own), window in zip(found, windows):
        rows = [i for i in range(3_000) if labels[i] != labels[17] and window.low <= scores[i] <= window.high]
        wanted = sorted(rows, key=lambda i: (-scores[i], i))[:10]
        assert ids.tolist() == wanted and own.tolist() == [int(scores[i]) for i in wanted]
    assert tree.evaluated < 3_000
