"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Encoding:

1. Each task splits its texts into pre-tokens, block by block (a block is a run
   of consecutive rows of one input split).  A block numbers its distinct
   pre-tokens by falling frequency; the positions of a text are then a list of
   these numbers.
2. ``(block, number, word)`` rows are shuffled and sorted by word, so equal words
   of all blocks stand together and each distinct word is encoded once, in a
   stream, whatever their number.
3. The ids go back to their blocks, meet the positions there and are put
   together text by text.

Only distinct words, their ids and the packed positions are shuffled, never the
texts.  A word that is frequent everywhere is one row per block.  Both passes
over the texts must see the same rows in the same order, so ``docs`` must come
from stored files; a checksum per block makes a difference fail the job.

Decoding joins every id with the token-byte table, a fixed small vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import groups_in, text_slices, texts_of
from larkspur.llm.pretokens import Pretokenizer, pattern_classes

BLOCK_BYTES = 32 << 20  # text of a block: bounds what a task holds
PACK_WORDS = 200_000  # answers kept before they are sent back, packed by block
_WORD = "block long, number int, word binary"
_PART = "block long, part int, slice int, ids array<{id}>, counts array<int>, total int, check long, data binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordEncoder:
    """Encode single pre-tokens: a whole-token hit, else merges by lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        # only single pieces are encoded, so the library's own splitting is not used
        core = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self._piece = core._core_bpe.encode_single_piece
        self._ranks = ranks

    def __call__(self, word: bytes) -> list[int]:
        whole = self._ranks.get(word)
        return [whole] if whole is not None else self._piece(word)


class Block(NamedTuple):
    """One block: its words by number, and per slice the row keys, tokens per text and positions."""

    key: int
    words: list[str]
    slices: list[tuple[list, np.ndarray, np.ndarray]]


def blocks(batches: Iterator[pa.RecordBatch], split: Pretokenizer, limit: int) -> Iterator[Block]:
    """Number the distinct pre-tokens of each block by falling frequency."""
    key = None
    numbers: dict[str, int] = {}
    slices, held = [], 0

    def finished() -> Block:
        words = list(numbers)
        seen = np.zeros(len(words), np.int64)
        for _ids, _counts, codes in slices:
            seen += np.bincount(codes, minlength=len(words))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        ranked = [(ids, counts, rank[codes]) for ids, counts, codes in slices]
        return Block(key, [words[i] for i in order.tolist()], ranked)

    for batch in text_slices(batches, "text"):
        if key is None:
            key = batch.column("split")[0].as_py() << 32
        texts = texts_of(batch, "text")
        tokens = split.split(texts)
        for word in tokens.words:
            if word not in numbers:
                numbers[word] = len(numbers)
        known = np.fromiter((numbers[word] for word in tokens.words), np.uint32, len(tokens.words))
        codes = known[tokens.codes] if len(known) else np.empty(0, np.uint32)
        slices.append((batch.column("id").to_pylist(), tokens.per_text, codes))
        held += sum(map(len, texts)) + 64 * len(texts)
        if held >= limit:
            yield finished()
            key, numbers, slices, held = key + 1, {}, [], 0
    if slices:
        yield finished()


def _checksum(words: list[bytes], numbers: np.ndarray) -> int:
    sums = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return int(((sums * (numbers.astype(np.int64) + 1)) & 0xFFFFFFFF).sum())


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes: frequent words have small numbers, so high planes compress away."""
    return pa.compress(
        np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(),
        codec="zstd", asbytes=True,
    )


def _unplanes(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def encode(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row of ``docs``.

    NULL text counts as empty and gives no ids; repeated rows and NULL keys come
    out as often as they went in; other columns of ``docs`` are not read.
    """
    id_name = docs.schema[id_col].dataType.simpleString()
    return _assembled(
        docs, ranks, id_col, text_col, block_bytes, lambda batches: batches, f"id {id_name}, ids array<int>"
    )


def _assembled(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str, text_col: str, block_bytes: int,
    finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema_out: str,
) -> DataFrame:
    """Encode; the task that puts texts together hands its (id, ids) batches to ``finish``."""
    spark = docs.sparkSession
    id_name = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("split"))
    classes = pattern_classes()
    part = _PART.format(id=id_name)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, Pretokenizer(classes), block_bytes):
            for at in range(0, len(block.words), 50_000):
                words = [word.encode() for word in block.words[at:at + 50_000]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(words), block.key)),
                        pa.array(np.arange(at, at + len(words), dtype=np.int32)),
                        pa.array(words, pa.binary()),
                    ],
                    ["block", "number", "word"],
                )

    def positions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, Pretokenizer(classes), block_bytes):
            words = [word.encode() for word in block.words]
            check = _checksum(words, np.arange(len(words)))
            for i, (ids, counts, codes) in enumerate(block.slices):
                yield _part_batch(
                    schema, [(block.key, 1, i, ids, counts.tolist(), len(words), check, _planes(codes))]
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(ranks)
        last: tuple[bytes | None, list[int]] = (None, [])
        kept: list[tuple[np.ndarray, np.ndarray, list[bytes], list[list[int]]]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            ids: list[list[int]] = []
            for word in words:  # sorted: equal words follow each other
                if word != last[0]:
                    last = word, encoder(word)
                ids.append(last[1])
            kept.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), words, ids))
            held += len(words)
            if held >= PACK_WORDS:
                yield from _packed(schema, kept)
                kept, held = [], 0
        yield from _packed(schema, kept)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _block, runs in groups_in(batches, "block"):
            numbers, lengths, flats = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            answers, place, check = None, None, 0
            for run in runs:
                for i in range(run.num_rows):
                    row = run.slice(i, 1).to_pylist()[0]
                    if row["part"] == 0:
                        number, length, flat = _unpack(row["data"], row["total"])
                        check += row["check"]
                        numbers.append(number)
                        lengths.append(length)
                        flats.append(flat)
                        continue
                    if answers is None:
                        offsets = np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int32)
                        answers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats)))
                        number = np.concatenate(numbers)
                        if len(number) != row["total"] or check != row["check"]:
                            raise RuntimeError("texts changed between two passes; store them before encoding")
                        place = np.empty(len(number), np.int64)
                        place[number] = np.arange(len(number))
                        numbers, lengths, flats = [], [], []
                    yield _texts(row, answers, place, out)

    schema = _arrow_schema(spark, part)
    out = pa.schema([("id", schema.field("ids").type.value_type), ("ids", pa.list_(pa.int32()))])
    answers = (
        texts.mapInArrow(words_of, _WORD)
        .repartition("word").sortWithinPartitions("word")
        .mapInArrow(encoded, part)
    )
    return (
        answers.unionAll(texts.mapInArrow(positions_of, part))
        .repartition("block").sortWithinPartitions("block", "part")
        .mapInArrow(lambda batches: finish(together(batches)), schema_out)
        .withColumnRenamed("id", id_col)
    )


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _part_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema
    )


def _packed(schema: pa.Schema, kept: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Answers of a run of words, one packed row per block that asked."""
    if not kept:
        return
    block = np.concatenate([k[0] for k in kept])
    number = np.concatenate([k[1] for k in kept])
    words = [word for k in kept for word in k[2]]
    ids = [word_ids for k in kept for word_ids in k[3]]
    order = np.lexsort((number, block))
    edges = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
    rows = []
    for at, end in zip(edges, np.r_[edges[1:], len(order)]):
        chosen = order[at:end]
        own = [ids[i] for i in chosen.tolist()]
        flat = np.fromiter((t for word_ids in own for t in word_ids), np.uint32)
        length = np.fromiter(map(len, own), np.uint32, len(own))
        steps = np.diff(number[chosen], prepend=0).astype(np.uint32)
        data = _planes(np.concatenate([steps, length, flat]))
        check = _checksum([words[i] for i in chosen.tolist()], number[chosen])
        rows.append((int(block[chosen[0]]), 0, len(flat), None, None, len(own), check, data))
    yield _part_batch(schema, [(b, p, None, None, None, n, c, _framed(f, d)) for b, p, f, _i, _k, n, c, d in rows])


def _framed(flat: int, data: bytes) -> bytes:
    return flat.to_bytes(8, "little") + data


def _unpack(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = int.from_bytes(data[:8], "little")
    values = _unplanes(data[8:], 2 * words + flat)
    return (
        np.cumsum(values[:words], dtype=np.int64).astype(np.uint32),
        values[words:2 * words].astype(np.int64),
        values[2 * words:].astype(np.int32),
    )


def _texts(row: dict, answers: pa.ListArray, place: np.ndarray, out: pa.Schema) -> pa.RecordBatch:
    counts = np.array(row["counts"], np.int64)
    codes = _unplanes(row["data"], int(counts.sum()))
    taken = answers.take(pa.array(place[codes])) if len(codes) else pa.array([], pa.list_(pa.int32()))
    words_end = np.r_[0, np.cumsum(counts)]
    word_offsets = taken.offsets.to_numpy() if len(codes) else np.zeros(1, np.int32)
    ids = pa.ListArray.from_arrays(
        pa.array((word_offsets[words_end] - word_offsets[0]).astype(np.int32)), taken.flatten().cast(pa.int32())
    )
    return pa.RecordBatch.from_arrays([pa.array(row["ids"], out.field("id").type), ids], schema=out)


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table: bytes by id, NULL where the vocabulary has no such id."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def decode(
    encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """``encoded`` with the bytes of its ids in ``out_col``.

    NULL ids stay NULL, no ids give no bytes; an id outside the vocabulary
    fails.  ``out_col`` must not be a column of ``encoded``.
    """
    if out_col in encoded.columns:
        raise ValueError(f"{out_col} is a column already")
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    table = token_bytes(ranks)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_col)
            texts = [None if n is None else bytes(raw) for n, raw in zip(_lengths(ids), _spelled(ids, table))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out_col]
            )

    return encoded.mapInArrow(decoded, schema)


def _lengths(ids: pa.ListArray) -> list[int | None]:
    return pc.list_value_length(ids).to_pylist()


def _spelled(ids: pa.ListArray, table: pa.Array) -> Iterator[memoryview]:
    """Join every id with its bytes in ``table``; the bytes of each row stand together."""
    flat = table.take(ids.flatten())
    if flat.null_count:
        raise ValueError("an id is not in the vocabulary")
    ends = np.r_[0, np.cumsum([n or 0 for n in _lengths(ids)])].astype(np.int64)
    flat = flat.cast(pa.large_binary())
    _valid, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset + ends].tolist()
    raw = memoryview(data if data is not None else b"")
    for a, b in zip(at, at[1:]):
        yield raw[a:b]


def digests(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode, decode the ids, digest both.

    As ``decode(encode(...))`` with SHA-256 of the decimal ids joined by commas
    and of the decoded bytes, but the ids do not leave the task.
    """
    id_name = docs.schema[id_col].dataType.simpleString()
    table = token_bytes(ranks)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = pa.array([b"%d," % i for i in range(len(table))], pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            listed = [hashlib.sha256(raw[:-1]).hexdigest() for raw in _spelled(ids, decimal)]
            decoded = [hashlib.sha256(raw).hexdigest() for raw in _spelled(ids, table)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(_lengths(ids), pa.int64()), pa.array(listed), pa.array(decoded)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _assembled(
        docs, ranks, id_col, text_col, block_bytes, digested,
        f"id {id_name}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
