"""Exact top-k inner products of integer vectors by pivot-table elimination.

Distances from every vector to many pivots are computed once.  For a query q and
a vector x the triangle inequality gives d(q, x) >= max over pivots of
|d(q, p) - d(x, p)|, and with q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 the greatest
lower bound on the distance is an upper bound on the score.  A query takes its
candidates in the order of their bounds and stops when no bound left reaches its
k-th score, so the answer is exact.

Vectors are stored in blocks and every query streams through every block.  A
query first asks a few blocks; its k-th score there is a limit below which the
other blocks need not search nor emit.

Bounds are doubles that allow for rounding; scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.arrow import groups_in, matrix_of
from larkspur.llm.whole import LONG_MIN, packed, products, real_vectors, whole_matrix
from larkspur.session import cut_lineage

PIVOTS = 32
PIVOT_SAMPLE = 2_000  # vectors that pivots are chosen from, about
CHUNK = 256  # candidates evaluated at once
FINE_ROWS, BLOCK_ROWS = 2_048, 131_072  # vectors of a block: few when the table is small, never more than the latter
BLOCK_BYTES = 128 << 20  # of vectors and their pivot distances; wide vectors make smaller blocks
FIRST_SHARE, FIRST_BLOCKS = 16, 4  # one block in so many is asked first, at least so many
_SLACK = 1e-9  # for rounding in squares and bounds
_FAR_SLACK = 1e-13  # for rounding in distances


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sample vector farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Computed from differences, so that no large squares cancel."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.empty((len(x), 0))


def top_k(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, scale: int = 256,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (long): the best k other rows of each query row.

    ``is_query`` is a condition on column ``id``.  Components become
    floor(scale * component).  Ties go to the smaller id.  A row is no candidate
    of itself, but rows that repeat its id count once each for other queries;
    equal ids never answer each other.  Shorter vectors count as filled up with
    zeros.  Rows with a NULL id, and vectors that are NULL or have a NULL, NaN or
    infinite component, take no part.  A score beyond a long counts as the greatest
    or least long, and such scores tie.
    """
    rows = real_vectors(vectors.select(id_col, vector_col), id_col, vector_col).where(F.col("id").isNotNull())
    rows = cut_lineage(rows.select("id", "x").withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = width or 0
    every = max(1, n // PIVOT_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(4 * PIVOT_SAMPLE).select("x").toArrow()
    points = choose_pivots(whole_matrix(sample.column("x"), width, scale), pivots)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (width + len(points) + 1))))
    blocks = max(1, -(-n // most), min(-(-n // FINE_ROWS), 32))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole_matrix(batch.column("x"), width, scale)
                table = packed(np.concatenate([x, pivot_distances(x, points)], axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), table], ["id", "asks", "row"])

    tables = rows.mapInArrow(tabled, "id long, asks boolean, row binary")
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks))
    stored = cut_lineage(tables.withColumn("part", block).select("part", "id", "asks", "row"))
    asked = cut_lineage(stored.where("asks").select("id", "row", F.monotonically_increasing_id().alias("number")))
    first = min(blocks, max(FIRST_BLOCKS, blocks // FIRST_SHARE))
    floor = F.lit(LONG_MIN).cast("long")
    best = _ranked(_searched(stored, asked.withColumn("floor", floor), 0, first, width, k), k)
    if first < blocks:
        best = cut_lineage(best)
        limits = best.where(F.col("rank") == k).select("number", F.col("score").alias("limit"))
        limited = asked.join(limits, "number", "left").withColumn("floor", F.coalesce("limit", floor)).drop("limit")
        best = _ranked(best.drop("rank").unionAll(_searched(stored, limited, first, blocks, width, k)), k)
    return best.select("query_id", "rank", "vec_id", "score")


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(stored: DataFrame, asked: DataFrame, start: int, stop: int, width: int, k: int) -> DataFrame:
    """``number, query_id, vec_id, score``: the best ``k`` not below the floor, of each block from ``start`` to ``stop``."""
    every_block = F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))
    questions = asked.select(F.explode(every_block).alias("part"), F.lit(1).alias("side"), "number", "id", "row", "floor")
    nothing = F.lit(None).cast("long")
    vectors = stored.where(F.col("part").between(start, stop - 1)).select(
        "part", F.lit(0).alias("side"), nothing.alias("number"), "id", "row", nothing.alias("floor")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, runs in groups_in(batches, "part"):
            held, index = [], None
            for run in runs:
                asking = pa.array(run.column("side").to_numpy() == 1)
                own, questions = run.filter(pc.invert(asking)), run.filter(asking)
                if own.num_rows:
                    held.append((own.column("id").to_numpy(), _floats(own)))
                if not questions.num_rows or not held:
                    continue
                if index is None:
                    index = PivotTable(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), width)
                    held = [()]
                yield from index.answers(
                    questions.column("number").to_numpy(), questions.column("id").to_numpy(), _floats(questions),
                    questions.column("floor").to_numpy(), k,
                )

    spark = stored.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(stop - start, 4_096))
    return (
        vectors.unionAll(questions).repartition(tasks, "part").sortWithinPartitions("part", "side")
        .mapInArrow(searched, "number long, query_id long, vec_id long, score long")
    )


def _floats(batch: pa.RecordBatch) -> np.ndarray:
    rows = matrix_of(batch.column("row"))
    return rows.view(np.float64) if rows.size else np.empty((batch.num_rows, 0))


class PivotTable:
    """A block of vectors with their pivot distances, searched one query at a time."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, width: int):
        self.ids, self.width = ids, width
        self.x, self.distances = data[:, :width], np.ascontiguousarray(data[:, width:].T)
        self.squares = (self.x * self.x).sum(axis=1)
        self.lengths = np.sqrt(self.squares)

    def answers(
        self, number: np.ndarray, ids: np.ndarray, data: np.ndarray, floors: np.ndarray, k: int
    ) -> Iterator[pa.RecordBatch]:
        found = [
            self._best(int(q), row[:self.width], row[self.width:], int(floor), k) for q, row, floor in zip(ids, data, floors)
        ]
        lengths = [len(scores) for _who, scores in found]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(number, lengths)),
                    pa.array(np.repeat(ids, lengths)),
                    pa.array(np.concatenate([who for who, _scores in found])),
                    pa.array(np.concatenate([scores for _who, scores in found])),
                ],
                ["number", "query_id", "vec_id", "score"],
            )

    def _best(self, query: int, x: np.ndarray, distances: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.zeros(len(self.ids))
        for own, pivot in zip(self.distances, distances):
            np.maximum(least, np.abs(own - pivot) - _FAR_SLACK * (own + pivot), out=least)
        bound = ((x @ x) + self.squares - least * least) / 2.0
        bound += _SLACK * (self.squares + x @ x + 1.0)
        bound = np.maximum(bound, LONG_MIN)  # as the scores
        left = np.flatnonzero((self.ids != query) & (bound >= floor))
        who, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        size = min(CHUNK, len(left))
        while len(left):
            top = np.argpartition(-bound[left], size - 1)[:size] if size < len(left) else np.arange(len(left))
            chosen = left[top]
            found = products(self.x[chosen], x, self.lengths[chosen])
            high = found >= floor
            who = np.concatenate([who, self.ids[chosen[high]]])
            scores = np.concatenate([scores, found[high]])
            order = np.lexsort((who, ~scores))[:k]  # ~: descending, for every long
            who, scores = who[order], scores[order]
            keep = np.ones(len(left), bool)
            keep[top] = False
            left = left[keep]
            if len(scores) == k:  # an equal bound may still win a tie by its id
                left = left[bound[left] >= scores[-1]]
            size = min(2 * size, len(left)) or 1
        return who, scores
