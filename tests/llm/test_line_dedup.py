"""Line deduplication, its deletions and its filters against plain dictionaries."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import line_dedup
from larkspur.llm.cuckoo import KEY_BYTES, CuckooFilter
from larkspur.llm.line_dedup import LineIndex
from larkspur.llm.queries import QUERIES

from .conftest import SF

SCHEMA = "doc_id long, text string, n_lines string, id string, key string"


def plain_key(line):
    line = re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def repeated_keys(docs, threshold, least_chars=1):
    found = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            found[plain_key(line)].add(doc)
    return {key for key, ids in found.items() if len(key) >= least_chars and len(ids) >= threshold}


def plain(docs, keys):
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if plain_key(line) not in keys]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, text, "x", "y", "z") for i, text in docs], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(draw, ids, words=12):
    lines = [f"Line {i} Été" for i in range(words)] + ["", " \t", "once"]
    out = []
    for i in ids:
        own = [draw.choice(lines) + draw.choice(("", " ", "\r")) for _n in range(draw.randint(0, 6))]
        out.append((i, "\n".join(line.upper().replace("ÉTÉ", "Été") if draw.random() < 0.2 else line for line in own)))
    return out


ODD = [
    (1, None), (2, ""), (3, "\n"), (None, "a\nb"), (None, "a\nb"), (None, "c"), (4, "A\n a\t\na"), (5, "İ\na"), (5, "a\nı"),
    (6, "a\x0bb\x0c\n\x0ba"), (7, "b\r\nb\r"), (8, " a"), (9, "x" * 300_000 + "\na"), (10, "a\n" * 100_000), (11, "É"), (12, "é"),
]


@pytest.mark.parametrize("by_block", [False, True])
def test_odd_texts(spark, monkeypatch, by_block):
    if by_block:
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
        monkeypatch.setattr(line_dedup, "BLOCK_BITS", 1)
    docs = frame(spark, ODD)
    for threshold in (2, 3, 7):
        got = LineIndex(spark, threshold=threshold).insert(docs).strip(docs)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
        assert rows(got) == plain(ODD, repeated_keys(ODD, threshold))
    assert rows(LineIndex(spark, threshold=2, least_chars=2).insert(docs).strip(docs)) == plain(ODD, repeated_keys(ODD, 2, 2))
    empty = docs.limit(0)
    assert LineIndex(spark).insert(empty).strip(empty).collect() == []
    assert rows(LineIndex(spark).insert(empty).strip(docs)) == plain(ODD, set())


def test_blocks_equal_reading_in_place(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = LineIndex(spark).insert(docs)
    here = rows(index.strip(docs))
    assert sum(r[2] for r in here) > 0
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", 4)
    assert rows(index.strip(docs)) == here


def test_whole_table_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    keys = repeated_keys(docs, 10)
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in QUERIES["op12_line_dedup"](spark, SF).collect()}
    assert keys and got == {r[:3] for r in plain(docs, keys)}


def test_insertions_and_deletions_undo_each_other(spark):
    """After every change lines are dropped as if the index had been built from the documents it holds."""
    draw = random.Random(11)
    held, index = [], LineIndex(spark, threshold=4)
    asked = corpus(draw, range(900, 920))
    for step in range(7):
        if step in (2, 5):
            gone = {i for i, _text in draw.sample(held, len(held) * 2 // 3)} | {-5}
            index = index.delete(spark.createDataFrame([(i,) for i in gone] + [(7,), (7,)], "doc_id long"))
            held = [d for d in held if d[0] not in gone | {7}]
        elif step == 4:
            index = index.compact()
        else:  # new ids, known ids with other texts, repeated and NULL ids
            more = corpus(draw, range(step * 10, step * 10 + 15)) + [(None, "line 1 Été")]
            index = index.insert(frame(spark, more + more[:2]))
            held += more
        keys = repeated_keys(held, 4)
        assert {k for k in repeated_keys(held, 1)} >= keys
        assert rows(index.strip(frame(spark, asked + held))) == plain(asked + held, keys)
        assert index.filters().agg(F.sum("held")).first()[0] or 0 == len(keys)
    again = LineIndex(spark, index.root, threshold=4)  # another process finds the same
    assert rows(again.repeated().select("n")) == rows(index.repeated().select("n"))


def test_an_interrupted_change_is_not_read(spark, monkeypatch):
    first = [(i, "same\nother") for i in range(3)]
    index = LineIndex(spark, threshold=3).insert(frame(spark, first))
    monkeypatch.setattr(LineIndex, "_record", lambda self, *_row: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    monkeypatch.undo()
    assert rows(LineIndex(spark, index.root, threshold=3).strip(frame(spark, first))) == [(i, 2, 2, "") for i in range(3)]


def test_keys_that_pass_a_filter_wrongly_stay(spark):
    """Two keys with one fingerprint and bucket: only the repeated one is dropped."""
    index = LineIndex(spark, threshold=2)
    docs = frame(spark, [(1, "twice\nonce"), (2, "twice")])
    index = index.insert(docs)
    key = line_dedup.line_key(b"once")
    one = CuckooFilter.for_keys(4)
    one.insert(np.frombuffer(key, np.uint8).reshape(1, -1))
    other = CuckooFilter.for_keys(4)
    other.insert(np.frombuffer(line_dedup.line_key(b"twice"), np.uint8).reshape(1, -1))
    forged = spark.createDataFrame(
        [(key[0], 1, bytearray(one.slots.tobytes()), []), (line_dedup.line_key(b"twice")[0], 1, bytearray(other.slots.tobytes()), [])],
        line_dedup._FILTER,
    )
    index.filters = lambda: forged
    wanted = [(1, 2, 1, "once"), (2, 1, 1, "")]
    assert rows(index.strip(docs)) == wanted


def test_shards_that_fill_up_are_rebuilt(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARDS", 256)
    first = "\n".join(f"line {i}" for i in range(300))
    many = "\n".join(f"line {i}" for i in range(6_000))
    index = LineIndex(spark, threshold=1).insert(frame(spark, [(1, first)])).insert(frame(spark, [(2, many)]))
    assert index.filters().agg(F.sum("held")).first()[0] == 6_000
    assert rows(index.strip(frame(spark, [(3, many + "\nnew")]))) == [(3, 6_001, 6_000, "new")]


@pytest.mark.parametrize("count", [1, 100, 5_000])
def test_filter_holds_what_it_was_given(count):
    draw = np.random.default_rng(count)
    keys = draw.integers(0, 256, (2 * count, KEY_BYTES), np.uint8)
    one = CuckooFilter.for_keys(count)
    one.insert(keys[:count])
    assert one.contains(keys[:count]).all()
    assert one.contains(keys[count:]).sum() <= 1
    one.delete(keys[:count // 2])
    assert one.contains(keys[count // 2:count]).all() and one.contains(keys[:count // 2]).sum() <= 1
    one.insert(keys[count:])  # beyond its size: what finds no place is kept beside the slots
    assert one.contains(keys[count // 2:]).all()
    assert one.held == count - count // 2 + count
    read = CuckooFilter.read(one.slots.tobytes(), list(one.spill), one.held)
    assert read.contains(keys[count // 2:]).all()
    one.delete(keys[count // 2:])
    assert not one.slots.any() and not one.spill
    with pytest.raises(KeyError):
        one.delete(keys[:1])
