"""Spelling candidates against the distance to every word."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import spelling
from larkspur.operators.spelling import SpellingIndex


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(draw, word, edits):
    for _edit in range(edits):
        at = draw.randrange(len(word) + 1)
        kind = draw.random()
        word = word[:at] + ("" if kind < 0.3 else draw.choice("abcé")) + word[at + (kind < 0.7):]
    return word


@pytest.fixture(scope="module")
def words():
    draw = random.Random(3)
    known = {"".join(draw.choice("abcé") for _c in range(draw.randint(1, 7))): draw.randint(1, 9) for _w in range(250)}
    for length in (17, 18, 19, 20, 21, 22, 23, 24, 30, 60):
        for _w in range(4):
            known["".join(draw.choice("abcé") for _c in range(length))] = draw.randint(1, 9)
    asked = {changed(draw, w, draw.randint(0, 4)) for w in draw.sample(sorted(known), 200) for _time in range(2)} - {""}
    return known, sorted(asked | {"zzzz", "x" * 40})


def test_candidates_and_corrections_equal_brute_force(spark, tmp_path, words):
    known, asked = words
    index = SpellingIndex(spark, str(tmp_path)).write(spark.createDataFrame(list(known.items()), "word string, n long"))
    rows = spark.createDataFrame([(w,) for w in [*asked, asked[0], None]], "word string")
    near = {(a, w, d, known[w]) for a in asked for w in known if (d := distance(a, w)) <= 2}
    assert {tuple(r) for r in index.candidates(rows).collect()} == near
    wanted = {}
    for a in asked:
        if a not in known:
            own = sorted((d, -n, w) for b, w, d, n in near if b == a)
            wanted[a] = (own[0][2], own[0][0], len(own)) if own else (None, None, 0)
    got = {r["word"]: (r["correction"], r["edits"], r["candidates"]) for r in index.corrections(rows).collect()}
    assert got == wanted


def test_texts_are_corrected_in_place(spark, tmp_path):
    docs = spark.createDataFrame([("refund policy for every basic fare " * 6,)], "text string")
    index = SpellingIndex(spark, str(tmp_path)).write(spelling.vocabulary(docs, "text"))
    texts = spark.createDataFrame(
        [(1, "Refnd polcy, for BASIC fares?!", "x"), (2, "nothing nearby", "y"), (3, None, "z"), (4, "", None), (1, "  refund\tplicy", "x")],
        "id int, text string, word string",
    )
    got = index.correct(texts, "text")
    assert got.columns == texts.columns
    assert sorted((r["id"], r["text"] or "") for r in got.collect()) == [
        (1, "  refund\tpolicy"), (1, "refund policy, for BASIC fare?!"), (2, "nothing nearby"), (3, ""), (4, ""),
    ]
    assert index.correct(texts.limit(0), "text").collect() == []


def test_long_words_have_few_keys():
    assert len(spelling.known_keys("x" * 5 + "abcdefghij" * 500, 2)) == 3
    assert len(spelling.asked_keys("abcdefghij" * 500, 2)) <= 75
    assert len(spelling.known_keys("abcdefghij" * 2, 2)) <= 1 + 20 + 190
