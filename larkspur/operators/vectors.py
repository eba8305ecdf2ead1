"""Vectors: embedding, exact and approximate search, index layout and upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.functions.similarity import NORM_EPSILON, cosine
from larkspur.operators import topk
from larkspur.operators.relational import where_equal, where_sql
from larkspur.operators.skew import broadcast_if_small
from larkspur.session import cut_lineage


def adjacent_distance(df: DataFrame, position: str, vector: str, keys: list[str] | None = None) -> DataFrame:
    """Cosine distance of each row to the row before it, by position.

    An equi-join on position rather than a window, so a long sequence is
    spread over all tasks.
    """
    keys = keys or []
    before = df.select(*keys, (F.col(position) + 1).alias(position), F.col(vector).alias("_before"))
    return df.join(before, [*keys, position]).withColumn(
        "distance", 1 - cosine(F.col("_before"), F.col(vector))
    ).drop("_before")


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, summed element by element with map-side combine."""
    parts = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias(vector))


@dataclass(frozen=True)
class TextEmbedder:
    """Hashed TF-IDF vectors of unit length; one model for index and queries."""

    model: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, text: str, dim: int = 256) -> TextEmbedder:
        staged = df.select(tx.tokens(text).alias("_tokens"))
        pipeline = Pipeline(
            stages=[
                HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
                IDF(inputCol="_tf", outputCol="_idf"),
                Normalizer(inputCol="_idf", outputCol="_unit"),
            ]
        )
        return cls(pipeline.fit(staged))

    def embed(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """Add the vector column; NULL text gives NULL."""
        staged = df.withColumn("_tokens", F.coalesce(tx.tokens(text), F.array().cast("array<string>")))
        vectors = self.model.transform(staged).withColumn(
            out, F.when(F.col(text).isNotNull(), vector_to_array("_unit", "float32"))
        )
        return vectors.drop("_tokens", "_tf", "_idf", "_unit")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + NORM_EPSILON)


def dense(lists: pa.ListArray, dim: int) -> np.ndarray:
    """A list column as a matrix; every vector must have ``dim`` elements."""
    if not pc.all(pc.equal(pc.list_value_length(lists), dim), min_count=0).as_py():
        raise ValueError(f"every vector must have {dim} elements")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass(frozen=True)
class VectorScorer:
    """Scores record batches (id, vector) against a matrix of query vectors by their dot products."""

    queries: np.ndarray

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
        dim = self.queries.shape[1]
        matrix = dense(batch.column(1), dim)
        rows = max(topk.CELLS_PER_STEP // len(self.queries), 1)
        for start in range(0, len(matrix), rows):
            step = slice(start, start + rows)
            yield step, matrix[step] @ self.queries.T


TILE_QUERIES = 512  # queries of a tile: their best items and scores stay in the processor's cache
TILE_ROWS = 2_048  # rows scored with a tile at a time
FIRST_ROWS = 256  # rows that give the first floors
PAIRS = 16_384  # pairs scored exactly at a time


def rows_without_copies(vectors: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """Row numbers without those that ``k`` equal vectors with smaller ids precede: they can't be among the best ``k``."""
    bits = np.ascontiguousarray(vectors, dtype=np.float64).view(np.uint64)
    odd = np.random.default_rng(7).integers(1 << 63, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = (bits * odd).sum(axis=1, dtype=np.uint64)
    if len(np.unique(sums)) == len(sums):
        return np.arange(len(sums))
    whole = bits.view(np.dtype((np.void, bits.shape[1] * 8))).ravel()
    group = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((items, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order], side="left")
    return np.sort(order[place < k])


class UnitBatch:
    """The vectors of the batch at hand as unit rows, made once for all tiles of queries."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.batch = dim, k, None

    def __call__(self, batch: pa.RecordBatch, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers, unit vectors, the same in single precision)"""
        if batch is not self.batch:
            unit = unit_rows(dense(batch.column(1), self.dim))
            rows = rows_without_copies(unit, items, self.k)
            unit = unit if len(rows) == len(unit) else unit[rows]
            self.batch, self.made = batch, (rows, unit, unit.astype(np.float32))
        return self.made


class CosineTile(topk.PairScorer):
    """Cosines of a tile of unit queries: single precision decides what cannot be among the best, the rest is scored exactly.

    A dot product of unit vectors in single precision is off by at most about
    (dim + 2) / 2**24, so what lies further below the floor is out for certain.
    """

    def __init__(self, queries: np.ndarray, unit: UnitBatch):
        self.queries, self.unit = queries, unit
        self.rough = np.ascontiguousarray(queries.T, dtype=np.float32)
        self.margin = (queries.shape[1] + 16) * 2.0**-24 + 10.0**-topk.SCORE_DIGITS
        self.seen = 0

    def pairs(self, batch, items, best):
        rows, unit, single = self.unit(batch, items)
        step = max(min(topk.CELLS_PER_STEP // len(self.queries), TILE_ROWS), 1)
        first = min(max(FIRST_ROWS, 8 * best.k), step) if self.seen < best.k else step
        for start, end in pairwise([0, *range(first, len(rows), step), len(rows)]):
            scores = single[start:end] @ self.rough
            least = best.floor - self.margin
            if self.seen < best.k <= len(scores):  # no floor yet
                known = np.where(np.isfinite(scores), scores, -np.inf)
                least = np.maximum(least, np.partition(known, len(known) - best.k, axis=0)[-best.k] - 2 * self.margin)
            self.seen += len(scores)
            near = np.flatnonzero(scores >= least.astype(np.float32))
            for n in range(0, len(near), PAIRS):
                row, query = np.divmod(near[n : n + PAIRS], len(self.queries))
                exact = np.einsum("ij,ij->i", unit[start + row], self.queries[query])
                kept = np.isfinite(exact) & (np.round(exact, topk.SCORE_DIGITS) >= best.floor[query])
                yield rows[start + row[kept]], query[kept], exact[kept]


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    item: str = "vec_id",
    vector: str = "embedding",
    query_key: str = "query_id",
    query_vector: str = "query_vector",
    metric: str = "cosine",
) -> DataFrame:
    """Exact top-k: (query, item, score, rank), best first, ties by item id.

    Filter the corpus before the call to search a part of it.  ``metric`` is
    ``cosine`` or ``dot``.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector)
    good = corpus.where(F.col(vector).isNotNull())

    def scorers(rows):
        matrix = np.asarray([r[query_vector] for r in rows], dtype=np.float64)
        if metric == "dot":
            return [(range(len(rows)), VectorScorer(matrix))]
        tiles = [range(n, min(n + TILE_QUERIES, len(rows))) for n in range(0, len(rows), TILE_QUERIES)]
        matrix, unit = unit_rows(matrix), UnitBatch(matrix.shape[1], k)
        return [(own, CosineTile(matrix[own.start : own.stop], unit)) for own in tiles]

    size, part_rows = 8 * F.size(query_vector) + 64, 4 * topk.PART_ROWS  # fewer parts give fewer answers to rank
    return topk.scan_top_k(good, item, vector, asked, query_key, size, scorers, k, part_rows)


def search_rows(
    corpus: DataFrame, queries: DataFrame, k: int, columns: list[str], where: dict | str | None = None,
    item: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector",
    metric: str = "cosine",
) -> DataFrame:
    """Top-k hits with chosen columns of the corpus; the score comes last.

    ``where`` filters the corpus before the search, by equality (dict) or by
    SQL text.  The hits, at most queries times k, are joined back by item.
    """
    kept = corpus
    if where is not None:
        kept = where_equal(corpus, where) if isinstance(where, dict) else where_sql(corpus, where)
    hits = cut_lineage(search(kept, queries, k, item, vector, query_key, query_vector, metric))
    shown = kept.select(item, *[c for c in columns if c != item])
    joined = shown.join(broadcast_if_small(hits, hits.count(), 64), item)
    return joined.select(query_key, "rank", *columns, "score")


def lookup_join(rows: DataFrame, key: str, vector: str, corpus: DataFrame, item: str, corpus_vector: str, k: int) -> DataFrame:
    """Each row with the ordered ids of its k best corpus items."""
    asked = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    hits = search(corpus, asked, k, item, corpus_vector, "_key", "_vector")
    ordered = F.sort_array(F.collect_list(F.struct("rank", item)))
    lists = hits.groupBy("_key").agg(F.transform(ordered, lambda h: h[item]).alias("matches"))
    return rows.join(lists.withColumnRenamed("_key", key), key, "left")


def sweep_k(hits: DataFrame, ks: list[int]) -> DataFrame:
    """One ranked list cut at several depths; ``hits`` must reach the deepest."""
    return hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))


@dataclass(frozen=True)
class CellIndex:
    """An inverted-file index: cell centres and the corpus rows with their cell."""

    centres: np.ndarray
    rows: DataFrame
    item: str
    vector: str

    def write(self, path: str) -> CellIndex:
        """Store the rows in one folder per cell, so a search reads probed cells only.

        Rows spread over tasks by id and cell, so a crowded cell becomes many files.
        """
        spread = self.rows.repartition(F.col("cell"), F.pmod(F.xxhash64(self.item), F.lit(8)))
        spread.write.mode("overwrite").partitionBy("cell").parquet(path)
        return CellIndex(self.centres, self.rows.sparkSession.read.parquet(path), self.item, self.vector)


NAMED_CELLS = 1_000  # probed cells that are put into the plan as literals
MOST_CELLS = 65_536  # centres that every task holds


def nearest_cells(centres: np.ndarray, vectors: np.ndarray, cells: int) -> np.ndarray:
    scores = unit_rows(vectors) @ centres.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :cells]


def build_cell_index(corpus: DataFrame, item: str, vector: str, cells: int | None = None, seed: int = 7) -> CellIndex:
    """Cluster the vectors into cells (cosine k-means) and label every row.

    Centres are trained on all vectors.  Without a number given, cells grow
    with the square root of the rows, so a probe reads a smaller share of a
    larger corpus.  The assignment is map-only.
    """
    kept = corpus.where(F.col(vector).isNotNull())
    if cells is None:
        cells = min(max(int(kept.count() ** 0.5), 4), MOST_CELLS)
    unit = kept.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    means = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(unit)
    centres = unit_rows(np.asarray([list(c) for c in means.clusterCenters()]))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType())])
    place = kept.columns.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_cells(shared.value, dense(batch.column(place), shared.value.shape[1]), 1)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"]
            )

    return CellIndex(centres, kept.mapInArrow(assign, schema), item, vector)


@dataclass(frozen=True)
class CellScorer:
    """Scores each row only against the queries that probe its cell."""

    queries: np.ndarray
    probes: np.ndarray  # (queries, nprobe)

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
        cells = batch.column(1).field("cell").to_numpy(zero_copy_only=False)
        dim = self.queries.shape[1]
        matrix = unit_rows(dense(batch.column(1).field("vector"), dim))
        rows = max(topk.CELLS_PER_STEP // len(self.queries), 1)
        for start in range(0, len(matrix), rows):
            step = slice(start, start + rows)
            scores = np.full((len(matrix[step]), len(self.queries)), -np.inf)
            for cell in np.unique(cells[step]):
                mine = np.flatnonzero(cells[step] == cell)
                asked = np.flatnonzero((self.probes == cell).any(axis=1))
                if len(asked):
                    scores[np.ix_(mine, asked)] = matrix[step][mine] @ self.queries[asked].T
            yield step, scores


def probed_queries(centres: np.ndarray, queries: DataFrame, probes: int, query_key: str, query_vector: str) -> DataFrame:
    """Queries with a vector and the ``_probes`` nearest cells of each; stored."""
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector)
    place = asked.columns.index(query_vector)
    schema = T.StructType([*asked.schema.fields, T.StructField("_probes", T.ArrayType(T.IntegerType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest_cells(centres, dense(batch.column(place), centres.shape[1]), probes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "_probes"]
            )

    return cut_lineage(asked.mapInArrow(choose, schema))


def rows_of_cells(rows: DataFrame, probing: DataFrame) -> DataFrame:
    """Rows of the probed cells; the cell is a partition column where the index is stored."""
    probed = cut_lineage(probing.select(F.explode("_probes").alias("cell")).distinct())
    named = probed.limit(NAMED_CELLS + 1).collect()
    if len(named) <= NAMED_CELLS:
        return rows.where(F.col("cell").isin([r["cell"] for r in named]))
    return rows.join(F.broadcast(probed), "cell", "left_semi")  # at most MOST_CELLS numbers


def search_cells(
    index: CellIndex, queries: DataFrame, k: int, nprobe: int | None = 4,
    query_key: str = "query_id", query_vector: str = "query_vector",
) -> DataFrame:
    """Approximate top-k: only the ``nprobe`` cells nearest to each query are read (None: all, which is exact)."""
    probes = len(index.centres) if nprobe is None else min(nprobe, len(index.centres))
    probing = probed_queries(index.centres, queries, probes, query_key, query_vector)
    rows = rows_of_cells(index.rows, probing).select(
        index.item, F.struct(F.col("cell"), F.col(index.vector).alias("vector")).alias("_row")
    )

    def scorers(block):
        matrix = unit_rows(np.asarray([r[query_vector] for r in block], dtype=np.float64))
        return [(range(len(block)), CellScorer(matrix, np.asarray([r["_probes"] for r in block])))]

    size = 8 * F.size(query_vector) + 4 * probes + 64
    return topk.scan_top_k(rows, index.item, "_row", probing, query_key, size, scorers, k)


def recall_at_k(exact: DataFrame, approximate: DataFrame, query_key: str, item: str) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select(query_key, item, F.lit(1).alias("_found"))
    return exact.join(found, [query_key, item], "left").groupBy(query_key).agg(
        (F.count("_found") / F.count("*")).alias("recall")
    )


def storage_cost(rows: DataFrame, dims: list[int]) -> DataFrame:
    """Vectors stored and bytes needed (4 per element) for several dimensions."""
    counted = rows.agg(F.count("*").alias("vectors"))
    each = counted.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    return each.withColumn("bytes", F.col("vectors") * F.col("dim") * 4)
