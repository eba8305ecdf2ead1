"""Approximate nearest neighbours by balanced posting lists.

Centroids come from splitting a sample at medians until every part is small, so
lists are balanced, and moving a few rounds to the mean direction of the sample
vectors nearest to them.  A vector goes to its nearest centroid and, if it lies near a
boundary, to others too: those whose distance exceeds the smallest by no more
than a margin that a quarter of a sample stays below with their second centroid.

A query searches the centroids by a best-first walk over their neighbour graph,
held in memory.  It reads the lists whose distance exceeds the nearest by no more
than a ratio of its own spread, the gap from its nearest to its ``SPREAD``-th
centroid.  Distances in many dimensions are nearly alike, so a ratio of distances
would prune nothing.  The ratio is measured on each table: some queries are
answered by brute force, and it is the one that holds enough of those answers.
Scores are exact inner products in double precision of the original vectors.

Largest inner product becomes smallest distance by one more component that fills
every stored vector up to the greatest norm.  Equal vectors are stored once with
their smallest ids; lists that grew too long are dealt over several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.arrow import groups_in, matrix_of
from larkspur.llm.whole import packed
from larkspur.session import cut_lineage

LIST_ROWS = 256  # vectors of a posting list, about
SAMPLE = 100_000  # vectors that centroids are fitted on, at most
MAX_LISTS = 16_384  # centroids held by every task: a bound on what is sent
COPIES, COPY_SHARE = 4, 0.25  # lists a vector may be in; share of vectors that are near a boundary
SPREAD = 16  # distances are compared in units of the gap between the nearest centroid and this one
MARGIN_SAMPLE = 8_192  # vectors that the copying margin is measured on
RECALL, RECALL_QUERIES = 0.93, 128  # share of exact answers that the lists read must hold; queries it is measured on
GRAPH_DEGREE, SMALL = 24, 64  # neighbours of a centroid; so few centroids are simply compared
REFINED = 4  # rounds in which centroids move to the mean direction of their sample vectors
FIRST_LISTS = 4  # lists read first; the k-th score found there is a limit for the others
LIST_PART = 4_096  # a list is dealt over tasks beyond so many vectors


class Centroids:
    """Centroids with a neighbour graph; ``nearest`` walks it from a few entry points."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        self.squares = (self.points ** 2).sum(axis=1)
        n = len(points)
        degree = min(GRAPH_DEGREE, n - 1)
        self.links = np.empty((n, degree), np.int32)
        for at in range(0, n, 1024):
            own = self.points[at:at + 1024]
            far = self.squares - 2 * own @ self.points.T
            far[np.arange(len(own)), np.arange(at, at + len(own))] = np.inf
            if degree:
                self.links[at:at + 1024] = np.argpartition(far, degree - 1, axis=1)[:, :degree]
        random = np.random.default_rng(3)
        self.entries = random.choice(n, min(n, max(16, int(np.sqrt(n)))), replace=False)

    def compared(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row and their squared distances, all centroids compared."""
        x = x.astype(np.float32)
        k = min(k, len(self.points))
        near, far = np.empty((len(x), k), np.int64), np.empty((len(x), k))
        step = max(1, (1 << 22) // len(self.points))
        for at in range(0, len(x), step):
            own = x[at:at + step]
            all_far = self.squares - 2 * own @ self.points.T
            top = np.argpartition(all_far, k - 1, axis=1)[:, :k]
            values = np.take_along_axis(all_far, top, axis=1)
            order = np.argsort(values, axis=1, kind="stable")
            near[at:at + step] = np.take_along_axis(top, order, axis=1)
            squares = (own.astype(np.float64) ** 2).sum(axis=1)[:, None]
            far[at:at + step] = np.maximum(np.take_along_axis(values, order, axis=1) + squares, 0.0)
        return near, far

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found by the walk and their squared distances, nearest first."""
        if len(self.points) <= SMALL:
            near, far = self.compared(x[None], k)
            return near[0], far[0]
        x = x.astype(np.float32)
        square = float(x @ x)
        seen = np.zeros(len(self.points), bool)
        far = self.squares[self.entries] - 2 * self.points[self.entries] @ x
        seen[self.entries] = True
        open_set = list(zip(far.tolist(), self.entries.tolist()))
        heapq.heapify(open_set)
        best = [(-d, c) for d, c in open_set]
        best = heapq.nlargest(2 * k, best)
        heapq.heapify(best)
        while open_set:
            d, c = heapq.heappop(open_set)
            if len(best) >= 2 * k and d > -best[0][0]:
                break
            fresh = self.links[c][~seen[self.links[c]]]
            if not len(fresh):
                continue
            seen[fresh] = True
            far = self.squares[fresh] - 2 * self.points[fresh] @ x
            for d, c in zip(far.tolist(), fresh.tolist()):
                if len(best) < 2 * k:
                    heapq.heappush(best, (-d, c))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, c))
                else:
                    continue
                heapq.heappush(open_set, (d, c))
        best = sorted((-d, c) for d, c in best)[:k]
        return np.array([c for _d, c in best]), np.maximum(np.array([d for d, _c in best]) + square, 0.0)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of equal parts: split at the median along the axis between two centres, again and again."""
    random = np.random.default_rng(5)
    parts = [np.arange(len(sample))]
    least = max(len(sample) // max(lists, 1), 1)
    done = []
    while parts:
        own = parts.pop()
        if len(own) < 2 * least:
            done.append(own)
            continue
        x = sample[own]
        a, b = x[random.integers(len(x))], x[random.integers(len(x))]
        for _round in range(4):
            side = x @ (b - a)
            near = side <= np.median(side)
            if near.all() or not near.any():
                near = np.arange(len(x)) < len(x) // 2
            a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
        parts += [own[near], own[~near]]
    return np.stack([sample[own].mean(axis=0) for own in done])


def refined(points: np.ndarray, sample: np.ndarray, norm: float) -> np.ndarray:
    """Centroids on the sphere after some rounds of moving to the mean of the sample vectors nearest to them."""
    points = on_sphere(points, norm)
    for _round in range(REFINED):
        sums, n = np.zeros_like(points), np.zeros(len(points))
        turned = points.T.astype(np.float32)
        step = max(1, (1 << 22) // len(points))
        for at in range(0, len(sample), step):
            own = sample[at:at + step]
            near = (own.astype(np.float32) @ turned).argmax(axis=1)
            np.add.at(sums, near, own)
            n += np.bincount(near, minlength=len(points))
        points = on_sphere(np.where(n[:, None] > 0, sums, points), norm)
    return points


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x`` (array of double); NULL, zero and non-finite vectors and NULL ids are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull())
        .where(finite & F.exists("x", lambda c: c != 0))
    )


def search(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double): the nearest k other rows found.

    ``is_query`` is a condition on column ``id``.  Ties go to the smaller id.
    Rows with the query's own id are no candidates; repeated rows count once.
    Shorter vectors count as filled up with zeros.  Every vector is indexed; with
    at most k + 1 valid vectors every one is found.  How far a query reads is the
    smallest ratio with which the lists read hold the share ``recall`` of the exact
    answers of ``RECALL_QUERIES`` queries, those of the smallest hashes of their ids.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(valid_vectors(vectors, id_col, vector_col).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    n, queries, width, norm = rows.agg(
        F.count("*"), F.count_if("asks"), F.max(F.size("x")), F.max(square)
    ).first()
    width, norm = width or 0, norm or 0.0
    # of equal vectors no answer shows more than the k + 1 smallest ids
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    equal = Window.partitionBy("hash", "x", "salt").orderBy("id")
    every = Window.partitionBy("hash", "x").orderBy("id")
    few = (
        rows.select("id", "x", F.xxhash64("x").alias("hash"), salt.alias("salt")).distinct()
        .withColumn("turn", F.row_number().over(equal)).where(F.col("turn") <= k + 1)
        .withColumn("turn", F.row_number().over(every)).where(F.col("turn") <= k + 1)
    )
    stored = cut_lineage(few.groupBy("hash", "x").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    distinct = stored.count()
    share = max(1, -(-distinct // SAMPLE))
    sample = _matrix(
        stored.where(F.pmod("hash", F.lit(share)) == 0).select("x").limit(2 * SAMPLE).toArrow().column("x").to_pylist(), width
    )
    lists = min(max(1, -(-distinct // LIST_ROWS)), MAX_LISTS)
    if not len(sample):
        sample = np.zeros((1, width))
    filled = _filled(sample, norm)
    points = refined(balanced_centroids(filled, lists), filled, norm)
    centroids = Centroids(points)  # built once; tasks get it with its graph
    margin = copying_margin(centroids, filled[:MARGIN_SAMPLE])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x").to_pylist(), width)
            full = _filled(x, norm)
            at = boundary(centroids, full, margin)
            counts = [len(own) for own in at]
            copy = np.repeat(np.arange(len(x)), counts)
            ids = batch.column("ids").take(pa.array(copy))
            packed = pa.array([row.tobytes() for row in x], pa.binary()).take(pa.array(copy))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(at)), batch.column("hash").take(pa.array(copy)), ids, packed],
                ["list", "hash", "ids", "row"],
            )

    postings = cut_lineage(stored.mapInArrow(located, "list long, hash long, ids array<long>, row binary"))
    sizes = {row["list"]: row["n"] for row in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
    parts = np.array([max(1, -(-sizes.get(i, 0) // LIST_PART)) for i in range(len(points))])
    first = np.cumsum(np.r_[0, parts])
    questions = cut_lineage(rows.where("asks").select("id", "x").distinct())
    tried = questions.orderBy(F.xxhash64("id"), "id", "x").limit(RECALL_QUERIES).toArrow()
    probes, ratio = _budget(
        stored, postings, centroids, tried.column("id").to_numpy(), _matrix(tried.column("x").to_pylist(), width), k, recall
    )

    def asking(start: int, stop: int | None):
        """A task function: questions to the parts of the lists that they read, nearest first, from the start-th on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("x").to_pylist(), width)
                full = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
                part, who = [], []
                for i, row in enumerate(full):
                    for c in lists_to_read(centroids, row, probes, ratio)[start:stop].tolist():
                        part += range(first[c], first[c + 1])
                        who += [i] * parts[c]
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()), pa.array(np.ones(len(part), np.int32)), batch.column("id").take(at),
                        pa.nulls(len(part), pa.list_(pa.int64())), packed(x).take(at), batch.column("floor").take(at),
                    ],
                    ["part", "side", "id", "ids", "row", "floor"],
                )

        return run

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("list").to_numpy()
            mixed = (batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(17)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first[own] + mixed % parts[own]), pa.array(np.zeros(len(own), np.int32)),
                    pa.nulls(len(own), pa.int64()), batch.column("ids"), batch.column("row"), pa.nulls(len(own), pa.float64()),
                ],
                ["part", "side", "id", "ids", "row", "floor"],
            )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, runs in groups_in(batches, "part"):
            ids, x = [], []
            for run in runs:
                queries_here = run.column("side").to_numpy() == 1
                data = matrix_of(run.column("row")).view(np.float64)
                if not queries_here.all():
                    ids += [own for own in run.column("ids").to_pylist() if own is not None]
                    x.append(data[~queries_here])
                if queries_here.any() and ids:
                    if len(x) > 1:
                        x = [np.concatenate(x)]
                    mine = run.filter(pa.array(queries_here))
                    who = mine.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                    floors = mine.column("floor").to_numpy(zero_copy_only=False)
                    yield from _list_answers(who, data[queries_here], ids, x[0], k, floors)

    schema = "part long, side int, id long, ids array<long>, row binary, floor double"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(first[-1]), 4_096))

    def found(asked: DataFrame, start: int, stop: int | None) -> DataFrame:
        return (
            postings.mapInArrow(dealt, schema).unionAll(asked.mapInArrow(asking(start, stop), schema))
            .repartition(tasks, "part").sortWithinPartitions("part", "side")
            .mapInArrow(answered, "query_id long, vec_id long, score double")
        ).distinct()

    nearest = _ranked(found(questions.withColumn("floor", F.lit(float("-inf"))), 0, FIRST_LISTS), k)
    if lists <= FIRST_LISTS:
        return nearest
    nearest = cut_lineage(nearest)
    limits = nearest.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    limited = questions.join(limits, "id", "left").select("id", "x", F.coalesce("limit", F.lit(float("-inf"))).alias("floor"))
    return _ranked(nearest.drop("rank").unionAll(found(limited, FIRST_LISTS, None)).distinct(), k)


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def on_sphere(points: np.ndarray, norm: float) -> np.ndarray:
    """Points scaled to the vectors' length, as far as they have a direction."""
    lengths = np.sqrt((points * points).sum(axis=1))[:, None]
    return np.where(lengths > 0, points * (np.sqrt(norm) / np.where(lengths > 0, lengths, 1.0)), points)


def _gaps(far: np.ndarray) -> np.ndarray:
    """How much farther than the first each distance is, in units of the row's own spread; ``far``: squared, nearest first."""
    far = np.sqrt(far)
    spread = far[..., min(SPREAD, far.shape[-1]) - 1] - far[..., 0]
    return (far - far[..., :1]) / np.maximum(spread, 1e-12)[..., None]


def copying_margin(centroids: Centroids, sample: np.ndarray) -> float:
    """The gap to the second centroid that ``COPY_SHARE`` of the sample stays below."""
    _near, far = centroids.compared(sample, SPREAD)
    return float(np.quantile(_gaps(far)[:, 1], COPY_SHARE)) if far.shape[1] > 1 else 0.0


def boundary(centroids: Centroids, x: np.ndarray, margin: float) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and others within the margin; of equal centroids one."""
    near, far = centroids.compared(x, SPREAD)
    gaps = _gaps(far)
    out = []
    for own, gap in zip(near, gaps):
        chosen = [int(own[0])]
        for c in own[1:COPIES][gap[1:COPIES] <= margin].tolist():
            if (((centroids.points[chosen] - centroids.points[c]) ** 2).sum(axis=1) > 0).all():
                chosen.append(c)
        out.append(np.array(chosen))
    return out


def lists_to_read(centroids: Centroids, x: np.ndarray, probes: int, ratio: float) -> np.ndarray:
    """The lists found by the walk whose gap is within the ratio; ``probes`` of them are looked at."""
    own, far = centroids.nearest(x, max(probes, min(SPREAD, len(centroids.points))))
    return own[_gaps(far) <= ratio + 1e-9]


def _budget(
    stored: DataFrame, postings: DataFrame, centroids: Centroids, who: np.ndarray, asked: np.ndarray, k: int, recall: float
) -> tuple[int, float]:
    """How many lists the walk looks for, and the ratio that gives ``recall`` on the queries ``who``."""
    lists = len(centroids.points)
    if not len(who) or lists == 1:
        return lists, np.inf
    width = asked.shape[1]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _list_answers(
                    who, asked, batch.column("ids").to_pylist(), _matrix(batch.column("x").to_pylist(), width), k
                )

    answers = _ranked(stored.select("ids", "x").mapInArrow(exact, "query_id long, vec_id long, score double").distinct(), k)
    held = (
        postings.select("list", F.explode("ids").alias("vec_id"))
        .join(F.broadcast(cut_lineage(answers)), "vec_id")  # k rows of each query tried
        .groupBy("query_id", "vec_id").agg(F.collect_set("list").alias("lists")).collect()
    )
    full = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1)
    return measured_ratio(centroids, full, who.tolist(), [(row["query_id"], row["lists"]) for row in held], recall)


def measured_ratio(
    centroids: Centroids, full: np.ndarray, who: list[int], held: list[tuple[int, list[int]]], recall: float
) -> tuple[int, float]:
    """From the lists that hold each exact answer (query, lists): the smallest sufficient ratio, walk included."""
    lists = len(centroids.points)
    order, far = centroids.compared(full, lists)
    gaps = _gaps(far)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None], axis=1)
    at = {q: i for i, q in enumerate(who)}
    needed = np.sort([min(gaps[at[q], place[at[q], c]] for c in own) for q, own in held]) if held else np.zeros(1)
    share = recall
    while True:
        ratio = float(needed[min(int(np.ceil(share * len(needed))), len(needed)) - 1])
        probes = int(np.quantile((gaps <= ratio + 1e-9).sum(axis=1), 0.98, method="higher"))
        read: dict[int, set[int]] = {}
        for q, row in zip(who, full):
            read.setdefault(q, set()).update(lists_to_read(centroids, row, probes, ratio).tolist())
        found = sum(not read[q].isdisjoint(own) for q, own in held)
        if found >= recall * len(held):
            return probes, ratio
        if share >= 1.0:
            return lists, np.inf
        share = min(1.0, share + 0.01)


def _list_answers(
    who: np.ndarray, asked: np.ndarray, ids: list[list[int]], x: np.ndarray, k: int, floors: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(who), 512):
        scores = np.stack([x @ row for row in asked[at:at + 512]])  # one query at a time: the same sums in every list
        take = min(k + 1, scores.shape[1])
        top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
        edge = np.take_along_axis(scores, top, axis=1).min(axis=1)
        if floors is not None:  # an equal score may still win by its id
            edge = np.maximum(edge, floors[at:at + 512])
        query, vec, score = [], [], []
        for i, q in enumerate(who[at:at + 512].tolist()):
            rows = np.flatnonzero(scores[i] >= edge[i])
            pairs = sorted((-scores[i, r], v) for r in rows.tolist() for v in ids[r] if v != q)[:k]
            query += [q] * len(pairs)
            vec += [v for _s, v in pairs]
            score += [-s for s, _v in pairs]
        if query:
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                ["query_id", "vec_id", "score"],
            )


def _filled(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that every vector has the greatest norm."""
    return np.concatenate([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def _matrix(rows: list[list[float]], width: int) -> np.ndarray:
    matrix = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        matrix[i, :len(row)] = row
    return matrix
