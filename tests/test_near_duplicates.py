"""Chunk groups against exact similarities of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import near_duplicates as nd


def plain_sets(texts, words=5):
    out = {}
    for i, text in texts:
        tokens = (text or "").lower().split()
        if tokens:
            out[i] = frozenset(" ".join(tokens[j:j + words]) for j in range(max(len(tokens) - words + 1, 1)))
    return out


def plain_groups(texts, threshold=0.8):
    sets = plain_sets(texts)
    root = {i: i for i, _text in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                    root[b], changed = root[a], True
    return root


def texts_with_copies(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[draw.choice(vocabulary) for _w in range(draw.randint(30, 120))] for _b in range(n // 4)]
    out = []
    for i in range(n):
        words = list(draw.choice(base))
        for _edit in range(draw.choice((0, 0, 1, 2, 5))):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("deal", [1_024, 3])
def test_groups_equal_all_pairs(spark, monkeypatch, deal):
    monkeypatch.setattr(nd, "DEAL", deal)
    texts = texts_with_copies(240, 4) + [(300, ""), (301, None), (302, "one two"), (303, "One TWO"), (304, "one two three")]
    got = nd.near_duplicate_groups(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    assert {r["id"]: r["group"] for r in got.collect()} == plain_groups(texts)


def test_a_hot_group_and_repeated_ids(spark, monkeypatch):
    """A chain of near copies of one text, thousands of exact ones, ids that are NULL or repeated."""
    monkeypatch.setattr(nd, "DEAL", 50)
    words = [f"x{i}" for i in range(200)]
    chain = [(10 + i, " ".join([*words[:i], *(["changed"] if i else []), *words[i + 1:]])) for i in range(150)]
    rows = chain + [(5_000 + i, " ".join(words)) for i in range(3_000)] + [(None, " ".join(words)), (None, "no copy of it at all"), (7, "a b"), (7, "c d")]
    got = nd.near_duplicate_groups(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], set()).add(r["group"])
    assert all(by_id[i] == {10} for i, _t in rows if i is not None and i != 7)
    assert by_id[7] == {7} and by_id[None] == {10, None}


def test_recall_of_the_bands():
    """Pairs at the threshold share a band nearly always, unrelated ones nearly never."""
    random_state = np.random.default_rng(2)
    hits = far = 0
    for _pair in range(300):
        common = random_state.integers(-2**62, 2**62, 160)
        a = np.r_[common, random_state.integers(-2**62, 2**62, 20)]
        b = np.r_[common, random_state.integers(-2**62, 2**62, 20)]
        keys = nd.band_keys([a, b, random_state.integers(-2**62, 2**62, 180)])
        hits += bool((keys[0] == keys[1]).any())
        far += bool((keys[0] == keys[2]).any())
    assert hits >= 298 and far == 0


def test_roots_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(300, 299), (299, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in nd.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(200) if 100 + i < 299}, 299: 100 if (100, 299) in links else 299, 300: 100 if (100, 299) in links else 299}
    assert nd.smallest_reachable(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_of_short_and_empty_texts(spark):
    rows = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), (None,), ("a b c d e a b c d e",)], "text string")
    sizes = [r[0] for r in rows.select(F.size(nd.shingles("text"))).collect()]
    assert sizes[:2] == [2, 1] and sizes[2] in (-1, None) and sizes[3] in (-1, None) and sizes[4] == 5


def test_shingles_are_stored_once(spark, monkeypatch):
    """Copies are found, labelled and handed back by digests; only sets that share a band take their shingles along."""
    stored = []

    def recorded(df, cut=nd.cut_lineage):
        stored.append(df.columns)
        return cut(df)

    monkeypatch.setattr(nd, "cut_lineage", recorded)
    texts = texts_with_copies(80, 9)
    got = nd.near_duplicate_groups(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    assert {r["id"]: r["group"] for r in got.collect()} == plain_groups(texts)
    assert sum("shingles" in columns for columns in stored) == 1


@pytest.mark.parametrize("deal", [1_024, 3])
def test_bands_that_go_on_in_the_next_batch(spark, monkeypatch, deal):
    monkeypatch.setattr(nd, "DEAL", deal)
    monkeypatch.setattr(nd, "RUN_TOKENS", 100)
    monkeypatch.setattr(nd, "RUN_VALUES", 150)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        texts = texts_with_copies(160, 5) + [(300, ""), (301, None), (302, "one two"), (303, "One TWO")]
        got = nd.near_duplicate_groups(spark.createDataFrame(texts, "id int, text string"), "id", "text")
        assert {r["id"]: r["group"] for r in got.collect()} == plain_groups(texts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_many_bands_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_BYTES", 0)
    texts = texts_with_copies(160, 6)
    got = nd.near_duplicate_groups(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    assert {r["id"]: r["group"] for r in got.collect()} == plain_groups(texts)


def test_shingle_hashes_stand_for_the_shingles(spark):
    """As many distinct hashes as distinct shingles, over all texts and shared by any two."""
    texts = texts_with_copies(60, 8) + [(100, "a b a b a b a b a b a b"), (101, "a b"), (102, "b a"), (103, "a b c"), (104, "a"), (105, "a a"), (106, "a b c d e")]
    rows = spark.createDataFrame(texts, "id int, text string").select("id", nd.shingles("text").alias("s")).collect()
    got, want = {r["id"]: set(r["s"]) for r in rows}, plain_sets(texts)
    assert all(list(r["s"]) == sorted(set(r["s"])) for r in rows)
    assert len(set().union(*got.values())) == len(set().union(*want.values()))
    assert all(len(got[a] & got[b]) == len(want[a] & want[b]) for a in got for b in got)


def test_recall_at_any_similarity():
    """Bands are shared as often as independent MinHash rows are."""
    draw = np.random.default_rng(3)
    for shared, other in ((160, 20), (140, 30), (100, 50), (60, 70)):
        pairs = 400
        common = draw.integers(-2**62, 2**62, (pairs, shared))
        sets = [np.r_[c, draw.integers(-2**62, 2**62, other)] for c in common for _side in range(2)]
        keys = nd.band_keys(sets)
        rate = (keys[0::2] == keys[1::2]).mean()
        expected = (shared / (shared + 2 * other)) ** nd.BAND_ROWS
        assert abs(rate - expected) < 5 * (expected * (1 - expected) / (pairs * nd.BANDS)) ** 0.5 + 0.004
