"""Pre-tokens, token counts, encoding, decoding and packing against the libraries and round trips."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, packing, token_counts
from larkspur.llm.pretokens import Pretokenizer, pattern_classes, safe_pieces

SPLIT = Pretokenizer(pattern_classes())
PATTERN = regex.compile(public_tokenizers.PATTERN)
JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")


def split(texts):
    tokens = SPLIT.split(texts)
    ends = np.r_[0, np.cumsum(tokens.per_text)]
    return [[tokens.words[c] for c in tokens.codes[a:b]] for a, b in zip(ends, ends[1:])]


@given(st.lists(st.text(alphabet="'streveldm 1²\n\t 　!-Aé日́ſ"), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pretokens_follow_the_pattern(texts):
    assert split(texts) == [PATTERN.findall(text) for text in texts]


def test_long_texts_are_cut_where_nothing_changes():
    text = "abc def 's " * 30_000 + "z" * 500
    assert "".join(safe_pieces(text, 1_000)) == text and len(safe_pieces(text, 1_000)) > 100
    assert [w for piece in safe_pieces(text, 1_000) for w in PATTERN.findall(piece)] == PATTERN.findall(text)


def test_equal_hash_values_are_told_apart(monkeypatch):
    from larkspur.llm import pretokens

    monkeypatch.setattr(pretokens, "_MULTIPLIER", np.uint64(0))  # every hash is the length or less
    texts = ["ab cd ab ef", "cd ab"]
    assert split(texts) == [PATTERN.findall(text) for text in texts]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_counts_equal_the_library(spark, documents, odd_documents):
    library = Tokenizer.from_file(JSON_FILE)
    for docs in (documents, odd_documents, odd_documents.limit(0)):
        rows = docs.collect()
        expected = [
            (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
            for r in rows
        ]
        clash = docs.withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit("x"))
        assert by_key(map(tuple, token_counts.count_tokens(clash, JSON_FILE).collect())) == by_key(expected)


def test_whole_tokens_encode_alone_as_one():
    library = Tokenizer.from_file(JSON_FILE)
    whole = token_counts.whole_tokens(library)
    assert len(whole) > 40_000
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(0).sample(whole, 500))


def test_classes_follow_the_tokenizers_own_splitter():
    library = Tokenizer.from_file(JSON_FILE)
    own = Pretokenizer(token_counts.tokenizer_classes(library))
    rand = random.Random(1)
    for _try in range(300):
        text = "".join(chr(rand.choice([*range(0x20, 0x600), 0xA7CE, 0x1C, 0x85, 0x2028])) for _c in range(30))
        tokens = own.split([text])
        spans = [span for _word, span in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [tokens.words[c] for c in tokens.codes] == [text[a:b] for a, b in spans]


def test_encoding_equals_the_library_and_decodes_back(spark, documents, odd_documents, ranks, library):
    for docs in (documents, odd_documents):
        expected = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
        encoded = bpe.encode(docs.withColumn("ids", F.lit(1)).withColumn("block", F.lit(1)), ranks, block_bytes=40_000)
        got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(encoded, ranks).collect()]
        assert by_key(got) == by_key(expected)
    assert bpe.encode(documents.limit(0), ranks).collect() == []


def test_digests_are_those_of_ids_and_bytes(odd_documents, ranks, library):
    expected = []
    for row in odd_documents.collect():
        ids = library.encode_ordinary(row.text or "")
        expected.append(
            (
                row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((row.text or "").encode()).hexdigest(),
            )
        )
    assert by_key(map(tuple, bpe.digests(odd_documents, ranks).collect())) == by_key(expected)


def test_unknown_ids_fail_and_null_ids_stay(spark, ranks):
    known = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k long, ids array<int>")
    table = {v: k for k, v in ranks.items()}
    got = {r.k: r.decoded for r in bpe.decode(known, ranks).collect()}
    assert bytes(got[1]) == table[1] + table[2] and bytes(got[2]) == b"" and got[3] is None
    with pytest.raises(Exception, match="vocabulary|bounds|index"):
        bpe.decode(spark.createDataFrame([(1, [10 ** 6])], "k long, ids array<int>"), ranks).collect()
    with pytest.raises(ValueError, match="column already"):
        bpe.decode(known, ranks, out_col="k")


@given(st.integers(1, 70), st.lists(st.integers(1, 70), max_size=80))
@settings(max_examples=200, deadline=None)
def test_packing_equals_a_plain_best_fit(capacity, lengths):
    lengths = [n for n in lengths if n <= capacity]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [room for room in rooms if room >= n]
        if fitting:
            rooms[rooms.index(min(fitting))] -= n
        else:
            rooms.append(capacity - n)
    rows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    assert sorted(capacity - sum(lengths[i] for i in row) for row in rows) == sorted(rooms)


def test_packed_rows_give_every_text_back(documents, odd_documents, ranks, library, tmp_path):
    for docs in (documents, odd_documents):
        path = str(tmp_path / str(docs.count()))
        packing.write_packed(packing.pack(docs.withColumn("ids", F.lit(1)), ranks, length=256), path)
        rows = docs.sparkSession.read.parquet(path).collect()
        assert len({r.pack_id for r in rows}) == len(rows)
        pieces = collections.defaultdict(list)
        for row in rows:
            ids = np.frombuffer(row.ids, "<u2")
            assert len(ids) == 256 and row.cu_seqlens[-1] == row.n_tokens and row.cu_seqlens[0] == 0
            assert (ids[row.n_tokens:] == max(ranks.values()) + 1).all() and row.position_resets == row.cu_seqlens[:-1]
            for key, at, a, b in zip(row.doc_ids, row.doc_starts, row.cu_seqlens, row.cu_seqlens[1:]):
                pieces[key].append((at, ids[a:b].tolist()))
        expected = collections.defaultdict(list)
        for row in docs.collect():
            ids = library.encode_ordinary(row.text or "")
            expected[row.doc_id] += [(at, ids[at:at + 256]) for at in range(0, len(ids), 256)]
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert packing.pack(documents.limit(0), ranks).collect() == []


def test_positions_start_again_at_every_segment(spark):
    row = spark.createDataFrame([([0, 3, 4],)], "r array<int>").select(packing.position_ids(F.col("r"), 7).alias("p"))
    assert row.first().p == [0, 1, 2, 0, 0, 1, 2]
