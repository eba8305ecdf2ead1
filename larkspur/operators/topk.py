"""Exact top-k of a large corpus against a table of queries, without a cross join.

The measured size of the query side decides.  Queries that fit one block are
broadcast, the corpus is scanned in place and never shuffled.  A larger query
table is cut into blocks and the corpus into parts; every pair of a block and a
part meets in one task, by an equi-join on their numbers, and nothing passes
through the driver.  The plan is the same for any number of blocks.

Every task keeps the best k items per query and emits only those; a ranking over
the emitted rows finishes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.operators.windows import top_k
from larkspur.session import cut_lineage
from larkspur.tables import spread_small_scan

BLOCK_BYTES = 64 * 1024 * 1024  # size limit of one block of queries
SPREAD_BYTES = 1024 * 1024  # queries in one block beyond which a scan of few tasks is spread over the cores
PART_ROWS = 16_384  # corpus rows of a part at most, where queries come in blocks
PART_BYTES = 64 * 1024 * 1024  # corpus bytes of a part, about
DEALT_PAIRS = 1_024  # pairs of a part and a block up to which their number sets the tasks
MOST_TASKS = 4_096  # corpus tasks of one scan: each emits up to k rows per query
CELLS_PER_STEP = 4_000_000  # score cells held at a time in one task
SCORE_DIGITS = 9  # equal items must tie exactly, so scores are rounded


class BestPerQuery:
    """The best k (score, id) pairs of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.item: np.ndarray | None = None

    def add(self, items: np.ndarray, scores: np.ndarray) -> None:
        if scores.shape[0] > self.k:
            cut = scores.shape[0] - self.k
            self.floor = np.maximum(self.floor, np.partition(scores, cut, axis=0)[cut])
        rows, queries = np.nonzero((scores >= self.floor) & np.isfinite(scores))
        self.add_pairs(items[rows], queries, scores[rows, queries])

    def add_pairs(self, items: np.ndarray, queries: np.ndarray, scores: np.ndarray) -> None:
        if not len(items):
            return
        self.query = np.concatenate([self.query, queries])
        self.score = np.concatenate([self.score, scores])
        self.item = items if self.item is None else np.concatenate([self.item, items])
        self.compact()

    def compact(self) -> None:
        order = np.lexsort((self.item, -self.score, self.query))
        query = self.query[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        full = order[place == self.k - 1]  # the k-th best of a query is its floor from now on
        self.floor[self.query[full]] = np.maximum(self.floor[self.query[full]], self.score[full])
        kept = order[place < self.k]
        self.query, self.score, self.item = self.query[kept], self.score[kept], self.item[kept]


class PairScorer:
    """A scorer that looks at the floors itself and gives only pairs that may be among the best."""

    def pairs(
        self, batch: pa.RecordBatch, items: np.ndarray, best: BestPerQuery
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of (rows of the batch, queries, scores); ``best`` has the step before when the next is asked for."""
        raise NotImplementedError


#: Scorers of a block: the queries that each one scores, and a pair scorer or the function
#: that turns a record batch (item, payload) into (row slice, score matrix) steps.
Scorers = list[tuple[range, PairScorer | Callable[[pa.RecordBatch], Iterator[tuple[slice, np.ndarray]]]]]


def _query_rows(table: pa.Table) -> list[dict]:
    """A block of queries as dicts; vectors are views of one buffer, not a Python number per component."""
    columns = {}
    for name in table.column_names:
        column = table.column(name)
        lists = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else None
        numbers = isinstance(column.type, pa.ListType) and pa.types.is_floating(column.type.value_type)
        if lists is None or not numbers or lists.null_count or lists.flatten().null_count:
            columns[name] = column.to_pylist()
        else:
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            columns[name] = np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


def _best_rows(
    batches: Iterator[pa.RecordBatch], rows: list, query_key: str, scorers: Scorers, k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """The best ``k`` items of the batches for every query row."""
    kept = [BestPerQuery(len(own), k) for own, _score in scorers]
    for batch in batches:
        items = batch.column(0).to_numpy(zero_copy_only=False)
        items = items.astype(str) if items.dtype == object else items
        for best, (_own, score) in zip(kept, scorers):
            if isinstance(score, PairScorer):
                for place, queries, scores in score.pairs(batch, items, best):
                    best.add_pairs(items[place], queries, np.round(scores, SCORE_DIGITS))
                continue
            for step, scores in score(batch):
                best.add(items[step], np.round(scores, SCORE_DIGITS))
    for best, (own, _score) in zip(kept, scorers):
        if best.item is not None:
            keys = [rows[own[q]][query_key] for q in best.query.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, schema.field(0).type), pa.array(best.item, schema.field(1).type), pa.array(best.score)],
                schema=schema,
            )


def scan_top_k(
    corpus: DataFrame,
    item: str,
    payload: str,
    queries: DataFrame,
    query_key: str,
    query_bytes: Column,
    make_scorers: Callable[[list], Scorers],
    k: int,
    part_rows: int | None = None,
) -> DataFrame:
    """Rows (query, item, score, rank) of the best ``k`` items per query.

    ``make_scorers`` runs where the scoring runs and gets the query rows of one
    block; ``query_bytes`` is the size of a query row there.  A score of minus
    infinity means no hit.  Ties go to the smaller item.  ``part_rows``: other than
    ``PART_ROWS``, for scorers that hold little per row.
    """
    asked = cut_lineage(queries)
    size = asked.agg(F.sum(query_bytes)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    rows = corpus.select(item, payload)
    if blocks == 1 and size > SPREAD_BYTES:
        rows = spread_small_scan(rows)
    out = T.StructType(
        [asked.schema[query_key], T.StructField(item, corpus.schema[item].dataType), T.StructField("score", T.DoubleType())]
    )
    arrow = to_arrow_schema(out)
    hits = (
        _in_place(rows, asked, query_key, make_scorers, k, out, arrow) if blocks <= 1
        else _by_parts(rows, item, asked, query_key, int(blocks), make_scorers, k, out, arrow, part_rows or PART_ROWS)
    )
    return top_k(hits, [query_key], [F.col("score").desc(), F.col(item)], k)


def _in_place(
    rows: DataFrame, asked: DataFrame, query_key: str, make_scorers: Callable[[list], Scorers], k: int,
    out: T.StructType, arrow: pa.Schema,
) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(asked.toArrow())  # one block, measured

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _query_rows(shared.value)
        if block:
            yield from _best_rows(batches, block, query_key, make_scorers(block), k, arrow)

    return rows.coalesce(MOST_TASKS).mapInArrow(best, out)


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a payload in a task: arrays by their elements, structs by their fields."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.aggregate(value, F.lit(16), lambda n, t: n + F.octet_length(t) + 16)
        return F.size(value) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes(f.dataType, value[f.name]) for f in kind.fields])
    return F.octet_length(value) + 16 if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(16)


def _by_parts(
    rows: DataFrame, item: str, asked: DataFrame, query_key: str, blocks: int, make_scorers: Callable[[list], Scorers],
    k: int, out: T.StructType, arrow: pa.Schema, part_rows: int,
) -> DataFrame:
    payload = rows.columns[1]
    size = rows.agg(F.count("*").alias("n"), F.sum(_bytes(rows.schema[payload].dataType, F.col(payload))).alias("bytes")).first()
    parts = max(-(-size["n"] // part_rows), -(-(size["bytes"] or 0) // PART_BYTES), 1)

    def numbers(n: int) -> Column:
        return F.sequence(F.lit(0), F.lit(n - 1))

    part = F.pmod(F.xxhash64(item, F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64(query_key, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = rows.withColumn("_part", part).withColumn("_block", F.explode(numbers(blocks)))
    right = asked.withColumn("_block", block).withColumn("_part", F.explode(numbers(parts)))

    def best(items: pa.Table, block_rows: pa.Table) -> pa.Table:
        block = _query_rows(block_rows)
        found = []
        if block and items.num_rows:
            found = list(_best_rows(iter(items.combine_chunks().to_batches()), block, query_key, make_scorers(block), k, arrow))
        return pa.Table.from_batches(found, arrow)

    pairs = int(parts * blocks)
    if pairs <= DEALT_PAIRS:  # few and long: in as many tasks as before, several would share one
        left, right = (x.repartition(4 * pairs, "_part", "_block") for x in (left, right))
    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(best, out)
