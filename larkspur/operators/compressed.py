"""Vector search over short codes: cells, quantised residuals, table look-ups and exact re-scoring.

A vector is stored as its cell and, for each of ``PARTS`` parts of what remains
after the cell's centre is taken off, the number of the nearest of 256 entries:
one byte per part.  A query looks up, per part, its products with all entries
once; a code's score is then a sum of look-ups.  The best ``depth`` times k codes of
a query are scored again from the whole vectors, so the answer's scores are exact
and only those vectors are fetched.

The entries are fitted on a bounded sample; every vector is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.similarity import cosine
from larkspur.operators import topk
from larkspur.operators import vectors as vec
from larkspur.operators.skew import broadcast_if_small
from larkspur.operators.windows import top_k
from larkspur.session import cut_lineage

PARTS, ENTRIES, ROUNDS = 16, 256, 8
SAMPLE_BYTES = 32 << 20  # of vectors that the entries are fitted on
DEPTH = 10  # codes that are scored again, in units of k


def cut(matrix: np.ndarray, parts: int) -> np.ndarray:
    """(n, parts, size), filled up with zeros."""
    size = -(-matrix.shape[1] // parts)
    filled = np.zeros((len(matrix), parts * size))
    filled[:, :matrix.shape[1]] = matrix
    return filled.reshape(len(matrix), parts, size)


def nearest_entries(pieces: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the nearest entry of one part; ties go to the lower number."""
    far = (book ** 2).sum(axis=1) - 2 * pieces @ book.T
    return far.argmin(axis=1)


def fit_entries(residuals: np.ndarray, parts: int, entries: int = ENTRIES, seed: int = 5) -> np.ndarray:
    """(parts, entries, size): k-means per part, started from distinct sample rows."""
    pieces = cut(residuals, parts)
    random = np.random.default_rng(seed)
    books = np.zeros((parts, entries, pieces.shape[2]))
    for p in range(parts):
        own = pieces[:, p]
        book = own[random.choice(len(own), min(entries, len(own)), replace=False)] if len(own) else np.zeros((1, pieces.shape[2]))
        for _round in range(ROUNDS if len(own) else 0):
            code = nearest_entries(own, book)
            sums, n = np.zeros_like(book), np.bincount(code, minlength=len(book))
            np.add.at(sums, code, own)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books[p, :len(book)] = book
        books[p, len(book):] = book[0]
    return books


@dataclass(frozen=True)
class CodeScorer:
    """Scores code batches (item, (cell, code)) by table look-ups for the queries that probe their cell."""

    queries: np.ndarray
    probes: np.ndarray
    centres: np.ndarray
    books: np.ndarray

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
        parts = len(self.books)
        tables = np.einsum("qps,pes->qpe", cut(self.queries, parts), self.books)  # queries x parts x entries
        base = self.queries @ self.centres.T
        cells = batch.column(1).field("cell").to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(batch.column(1).field("code").to_pylist()), np.uint8).reshape(-1, parts)
        rows = max(topk.CELLS_PER_STEP // len(self.queries), 1)
        for start in range(0, len(codes), rows):
            step = slice(start, start + rows)
            scores = np.full((len(codes[step]), len(self.queries)), -np.inf)
            for cell in np.unique(cells[step]):
                mine = np.flatnonzero(cells[step] == cell)
                asked = np.flatnonzero((self.probes == cell).any(axis=1))
                if len(asked):
                    total = np.tile(base[asked, cell], (len(mine), 1))
                    for p in range(parts):
                        total += tables[asked][:, p, codes[step][mine, p]].T
                    scores[np.ix_(mine, asked)] = total
            yield step, scores


@dataclass(frozen=True)
class CompressedIndex:
    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame  # item, code, cell: in one folder per cell
    vectors: DataFrame  # item and whole vector
    item: str
    vector: str

    def bytes_per_vector(self) -> tuple[int, int]:
        """Bytes that a probe reads of each vector, and what the whole vector has."""
        return len(self.books), 4 * self.centres.shape[1]


def build(corpus: DataFrame, item: str, vector: str, path: str, cells: int | None = None, parts: int = PARTS) -> CompressedIndex:
    """Cells, entries and codes of all vectors, stored under ``path``; NULL vectors are left out."""
    index = vec.build_cell_index(corpus.select(item, vector), item, vector, cells)
    labelled = cut_lineage(index.rows)
    dim, centres = index.centres.shape[1], index.centres
    n = labelled.count()
    most = max(1, SAMPLE_BYTES // (8 * dim))
    sample = labelled.where(F.pmod(F.xxhash64(item), F.lit(max(1, n // most))) == 0).limit(2 * most).select(vector, "cell").toArrow()
    unit = vec.unit_rows(vec.dense(sample.column(vector).combine_chunks(), dim)) if sample.num_rows else np.zeros((0, dim))
    books = fit_entries(unit - centres[sample.column("cell").to_numpy()] if len(unit) else unit, parts)
    kind = corpus.schema[item].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            rest = cut(vec.unit_rows(vec.dense(batch.column(vector), dim)) - centres[cell], parts)
            code = np.stack([nearest_entries(rest[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(item), pa.array([row.tobytes() for row in code], pa.binary()), batch.column("cell")],
                names=[item, "code", "cell"],
            )

    coded = labelled.select(item, vector, "cell").mapInArrow(encode, f"`{item}` {kind}, code binary, cell int")
    spread = coded.repartition(F.col("cell"), F.pmod(F.xxhash64(item), F.lit(8)))
    spread.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    codes = corpus.sparkSession.read.schema(f"`{item}` {kind}, code binary, cell int").parquet(f"{path}/codes")
    return CompressedIndex(centres, books, codes, labelled.select(item, vector), item, vector)


def search(
    index: CompressedIndex, queries: DataFrame, k: int, nprobe: int, depth: int = DEPTH, query_key: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """(query, item, score, rank): cosine of the best ``k`` of the ``depth`` * k best codes in the probed cells, ties by item."""
    probing = vec.probed_queries(index.centres, queries, nprobe, query_key, query_vector)
    held = vec.rows_of_cells(index.codes, probing).select(index.item, F.struct("cell", "code").alias("_row"))
    centres, books = index.centres, index.books  # tasks get these, not the tables
    probes = min(nprobe, len(centres))

    def scorers(block):
        matrix = vec.unit_rows(np.asarray([r[query_vector] for r in block], dtype=np.float64))
        return [(range(len(block)), CodeScorer(matrix, np.asarray([r["_probes"] for r in block]), centres, books))]

    size = 8 * F.size(query_vector) + 4 * probes + 8 * books.shape[0] * books.shape[1] + 64
    near = cut_lineage(topk.scan_top_k(held, index.item, "_row", probing, query_key, size, scorers, depth * k))
    asked = probing.select(F.col(query_key), F.col(query_vector).cast("array<double>").alias("_q"))
    wanted = broadcast_if_small(near.select(query_key, index.item), near.count(), 64)
    pairs = index.vectors.join(wanted, index.item).join(broadcast_if_small(asked, asked.count(), 16 * centres.shape[1]), query_key)
    exact = F.round(cosine(F.col(index.vector).cast("array<double>"), F.col("_q")), topk.SCORE_DIGITS)
    scored = pairs.select(query_key, index.item, exact.alias("score"))
    return top_k(scored, [query_key], [F.col("score").desc(), F.col(index.item)], k)
