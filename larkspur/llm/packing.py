"""Token ids packed into rows of one length, best fit decreasing.

Texts are encoded and packed where they are read: a task gathers the ids of a
run of consecutive rows, packs them and goes on, so nothing is shuffled and
memory is bounded whatever the input.  A text longer than a row is split into
whole rows and a rest; nothing is cut off.  The pieces of a run are placed from
long to short, each into the row with the least room that still holds it; a
segment tree over room sizes finds that row.

Every packed row has its ids as little-endian binary of one length, the
cumulative lengths of its segments, the places where positions start again at 0,
and for each segment its text and where in the text it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import text_slices, texts_of
from larkspur.llm.bpe import WordEncoder
from larkspur.llm.pretokens import Pretokenizer, pattern_classes

ROW_TOKENS = 2_048
RUN_TOKENS = 2_000_000  # ids that are packed together
KEPT_WORDS = 300_000  # encoded words a task remembers


class RoomTree:
    """Open rows by the room they have left; a segment tree tells which room sizes exist."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()  # leaves for rooms 0 to most
        self.any = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _room in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, needed: int) -> tuple[int, int] | None:
        """(room, row) with the least room that is at least ``needed``, taken out of the tree."""
        node = self.size + needed
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node //= 2  # up until a right neighbour has something
            if node == 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node:
                self.any[node] = node < self.size and (self.any[2 * node] or self.any[2 * node + 1])
                if self.any[node]:
                    break
                node //= 2
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces of equal length keep their order."""
    tree, rows = RoomTree(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        tree.put(room - lengths[piece], row)
    return rows


class WordIds(dict):
    """Ids of pre-tokens, encoded when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self._encode = WordEncoder(ranks)

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = self._encode(word.encode())
        return ids


def pack(
    docs: DataFrame, ranks: dict[bytes, int], length: int = ROW_TOKENS, pad_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packed rows of ``length`` ids.

    Columns: ``pack_id`` (long, unique), ``n_tokens``, ``ids`` (binary, unsigned
    16-bit numbers if all ids fit, else 32-bit; filled up with ``pad_id``, by
    default the first number after the vocabulary), ``cu_seqlens`` (0, then the
    end of each segment), ``position_resets`` (where segments begin),
    ``doc_ids`` and ``doc_starts`` (per segment: its text's key and the number of
    ids of the text before it).

    NULL and empty texts have no ids and no segment; repeated rows are packed as
    often as they occur; a NULL key stays NULL.  Other columns are not read.
    """
    id_name = docs.schema[id_col].dataType.simpleString()
    classes = pattern_classes()
    pad = max(ranks.values()) + 1 if pad_id is None else pad_id
    kind = np.dtype("<u2") if max(*ranks.values(), pad) < 1 << 16 else np.dtype("<u4")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Pretokenizer(classes), WordIds(ranks)
        keys, ids, held, number = [], [], 0, None
        for batch in text_slices(batches, "text"):
            if number is None:
                number = batch.column("split")[0].as_py() << 33
            tokens = split.split(texts_of(batch, "text"))
            flat, ends = encoded(tokens, known)
            for key, a, b in zip(batch.column("id").to_pylist(), ends, ends[1:]):
                if b > a:
                    keys.append(key)
                    ids.append(flat[a:b])
            held += len(flat)
            if held >= RUN_TOKENS:
                out = _rows(keys, ids, length, pad, kind, number, batch.schema.field("id").type)
                number += out.num_rows
                yield out
                keys, ids, held = [], [], 0
        if keys:
            yield _rows(keys, ids, length, pad, kind, number, batch.schema.field("id").type)

    texts = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("split")
    )
    return texts.mapInArrow(
        packed,
        "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
        f"doc_ids array<{id_name}>, doc_starts array<int>",
    )


def encoded(tokens, known: WordIds) -> tuple[np.ndarray, list[int]]:
    """All ids of a slice of texts, and where each text begins and ends."""
    if not len(tokens.codes):
        return np.empty(0, np.int32), [0] * (len(tokens.per_text) + 1)
    words = [known[word] for word in tokens.words]
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    joined = np.fromiter((i for word in words for i in word), np.int32, int(offsets[-1]))
    answers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined))
    flat = answers.take(pa.array(tokens.codes)).flatten().to_numpy()
    ends = np.r_[0, np.cumsum(lengths[tokens.codes], dtype=np.int64)][np.r_[0, np.cumsum(tokens.per_text)]]
    return flat, ends.tolist()


def _rows(
    keys: list, ids: list[np.ndarray], length: int, pad: int, kind: np.dtype, number: int, key_type: pa.DataType
) -> pa.RecordBatch:
    pieces = [(i, at, min(at + length, len(own))) for i, own in enumerate(ids) for at in range(0, len(own), length)]
    rows = best_fit_decreasing([stop - at for _i, at, stop in pieces], length)
    columns: list[list] = [[] for _column in range(6)]
    for row in rows:
        matrix = np.full(length, pad, kind)
        ends = [0]
        for piece in row:
            i, at, stop = pieces[piece]
            matrix[ends[-1]:ends[-1] + stop - at] = ids[i][at:stop]
            ends.append(ends[-1] + stop - at)
        values = (
            ends[-1], matrix.tobytes(), ends, ends[:-1],
            [keys[pieces[piece][0]] for piece in row], [pieces[piece][1] for piece in row],
        )
        for column, value in zip(columns, values):
            column.append(value)
    whole = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.binary(), whole, whole, pa.list_(key_type), whole]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(number, number + len(rows))), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
        ["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
    )


def position_ids(resets: Column, length: int = ROW_TOKENS) -> Column:
    """Positions of a packed row: they start at 0 at every reset; filling goes on counting."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: i - F.array_max(F.filter(resets, lambda start: start <= i)),
    )


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed rows as Parquet; a run that is repeated replaces its own files."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """``pack_id``, ``doc_id``, ``doc_start``, ``begin``, ``end`` of every segment."""
    return packed.select("pack_id", "cu_seqlens", F.explode(F.arrays_zip("doc_ids", "doc_starts", "position_resets")).alias("s")).select(
        "pack_id", F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("doc_start"),
        F.col("s.position_resets").alias("begin"),
        F.array_min(F.filter("cu_seqlens", lambda end: end > F.col("s.position_resets"))).alias("end"),
    )
