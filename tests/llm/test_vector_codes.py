"""Vector codes against plain k-means in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import vector_codes as vc
from larkspur.llm.whole import LONG_MAX, LONG_MIN, products

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, vector, label) rows to (id, code, error) rows and codebooks, one distance after the other."""
    kept = [
        (i, [math.floor(scale * c) for c in v]) for i, v, _label in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = -(-max((len(x) for _i, x in kept), default=0) // parts) * parts
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]

    def cut(x, p):
        return x[p * size:(p + 1) * size]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, entry)) for entry in book]
        return min(range(len(book)), key=lambda j: (far[j], j)), min(far)

    books = [[cut(x, p) for _i, x in first] for p in range(parts)]
    for _round in range(rounds):
        for p in range(parts):
            groups = [[] for _entry in books[p]]
            for _i, x in kept:
                groups[nearest(cut(x, p), books[p])[0]].append(cut(x, p))
            books[p] = [
                [sum(c) // len(group) for c in zip(*group)] if group else entry for group, entry in zip(groups, books[p])
            ]
    out = []
    for i, x in kept:
        found = [nearest(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for j, _far in found), min(sum(far for _j, far in found), LONG_MAX)))
    return out, books


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in row)


def check(spark, rows, **options):
    vectors = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    got = vc.compress(vectors, **options)
    wanted, books = plain(rows, **options)
    assert got.codebooks == books
    assert sorted(((r.id, r.code, r.error) for r in got.rows.collect()), key=key) == sorted(wanted, key=key)
    return got


def test_codes_equal_plain_rounds(spark):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _c in range(16)] for _centre in range(30)]
    rows = [(i, [c + 0.4 * draw.gauss(0, 1) for c in draw.choice(centres)], i % 3) for i in range(600)]
    rows += [(600 + i, rows[7][1], None) for i in range(300)]  # a third of all rows are equal
    got = check(spark, rows)
    assert got.compared[0] == 1.0 and all(share < 0.6 for share in got.compared[1:])
    assert len(got.compared) == 7


def test_ties_go_to_the_lower_entry(spark):
    draw = random.Random(2)
    check(spark, [(i, [float(draw.randint(-2, 2)) for _c in range(8)], 0) for i in range(400)], scale=1, entries=12)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 0.5], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [0.0, 0.0], None),
        (6, [1.0, 0.5], None), (6, [1.0, 0.5], None), (7, [-1.0], 2), (8, [], 2), (None, [1.0, 1.0], 2),
        (9, [0.25] * 11, 2), (10, [-0.0, -1e-300], 1),
    ]
    check(spark, rows)
    check(spark, rows, parts=2, entries=3, rounds=2)
    got = vc.compress(spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).limit(0))
    assert got.rows.collect() == [] and got.codebooks == [[]] * 8
    only = vc.compress(spark.createDataFrame([(1, [], 2, "x", "y")], SCHEMA))
    assert [tuple(r) for r in only.rows.collect()] == [(1, 2, "00" * 8, 0)]


@pytest.mark.parametrize("greatest", [1e5, 3e9, 1e17])
def test_large_components(spark, greatest):
    """Squared distances beyond doubles' whole numbers, and beyond longs."""
    draw = random.Random(9)
    rows = [(i, [greatest * draw.choice((1, 1, 1e-6)) * draw.uniform(-1, 1) for _c in range(8)], 0) for i in range(80)]
    check(spark, rows, parts=2, entries=5, rounds=3)


def test_bounds_never_change_an_assignment():
    """Rounds of random moves on a lattice, where ties abound: lists stay right, and b shrinks and grows."""
    random_state = np.random.default_rng(4)
    x = random_state.integers(-3, 4, (400, 3)).astype(np.float64)
    book = random_state.integers(-3, 4, (10, 3)).astype(np.float64)
    lists, b = vc.searched(x, book, 4), 4
    for step in range(60):
        new = book + random_state.integers(-1, 2, book.shape) * (random_state.random((10, 1)) < 0.3)
        lists, used, _work = vc.moved(lists, x, new, np.sqrt(((new - book) ** 2).sum(axis=1)), b)
        book = new
        far = vc.squared_distances(x, book)
        assert (lists.near[:, 0] == far.argmin(axis=1)).all()
        roots = np.sqrt(far)
        for row in range(len(x)):
            listed = [j for j in lists.near[row].tolist() if j != vc.NONE]
            assert len(set(listed)) == len(listed)
            assert lists.upper[row] >= roots[row, listed[0]] - 1e-9
            for j in range(10):
                if j not in listed:
                    assert lists.outer[row] <= roots[row, j] + 1e-9
            for place, j in enumerate(lists.near[row, 1:].tolist()):
                assert j == vc.NONE or lists.lower[row, place] <= roots[row, j] + 1e-9
        b = (4, 2, 3)[step % 3]
        assert used.max() <= 5


def test_b_follows_the_entries_needed():
    assert vc.next_b(np.array([1000, 5, 0, 0, 0, 2]), 4, 2, 4) == 2
    assert vc.next_b(np.array([1000, 5, 3, 1, 0, 2]), 4, 2, 4) == 3
    assert vc.next_b(np.array([100, 5, 3, 50]), 2, 2, 4) == 3


def test_label_errors_and_digest(spark):
    rows = spark.createDataFrame(
        [(1, 0, "aa", 5), (2, 0, "ab", 7), (3, None, "aa", 1), (4, None, "ac", 2), (5, 1, "aa", LONG_MAX), (6, 1, "aa", 9)],
        "id long, label int, code string, error long",
    )
    got = {r.id: r.label_error for r in vc.with_label_error(rows).collect()}
    assert got == {1: 12, 2: 12, 3: 3, 4: 3, 5: LONG_MAX, 6: LONG_MAX}
    assert vc.codebook_digest([[[1, -2], [3, 4]], [[5, 6], [7, 8]]]) == hashlib.sha256(b"1,-2,3,4,5,6,7,8").hexdigest()


def test_products_are_exact_at_any_size():
    draw = random.Random(1)
    for size in (1e3, 1e8, 1e12, 1e30):
        x = np.floor(np.array([[draw.uniform(-size, size) for _c in range(5)] for _row in range(20)]))
        wanted = [min(max(sum(int(a) * int(b) for a, b in zip(row, x[3])), LONG_MIN), LONG_MAX) for row in x.tolist()]
        assert products(x, x[3]).tolist() == wanted
