"""Vector codes by parts: whole-number k-means whose assignments keep adaptive distance bounds.

Every vector is cut into equal parts, each part position has a codebook, and a
part's code is its nearest entry.  From round to round each part of a row keeps
its nearest entries in order: an upper bound on the distance to the one it is
assigned to, a lower bound to each of the b next, and one outer bound on all
others.  When entries move, bounds are widened by how far each moved.  If the
upper bound is still below all others, the part keeps its entry and no component
is read.  Otherwise the distance to its entry is computed, then the fewest listed
entries are compared that the bounds leave open, and all entries only if the outer
bound fails too.  b is set per part position between a quarter and an eighth
of the entries from the listed entries that rows needed in the round before.

Bounds are rounded outwards and only a strict gap counts, so every case that they
leave open, ties included, is decided by exact whole-number distances.  Rows with
their bounds are stored after every round, next to the sums of their task; the
driver sees only the sums per entry, and the folder of the round before is removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import matrix_of
from larkspur.llm.whole import LONG_MAX, packed, real_vectors, whole_matrix
from larkspur.operators.skew import join_hot_keys
from larkspur.session import cut_lineage, remove_work, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
NONE = 255  # no entry is known at this place of a list
RARE = 0.01  # b grows when more than this share of a round's rows had to compare all entries
LIMB = 40  # bits of a sum that are added up in one long
_OUT = 1e-12  # for rounding in sums of bounds


class Codes(NamedTuple):
    rows: DataFrame  # id, label, code, error
    codebooks: list[list[list[int]]]  # by part, entry, component
    compared: list[float]  # share of (row, part, entry) distances computed, by round


class Lists(NamedTuple):
    """What one part of many rows knows: nearest entries and bounds."""

    near: np.ndarray  # (n, 1 + kept) entry numbers, the assigned one first
    upper: np.ndarray  # (n,) at least the distance to the assigned entry
    lower: np.ndarray  # (n, kept) at most the distance to the next ones
    outer: np.ndarray  # (n,) at most the distance to any entry that is not listed


def arithmetic(greatest: float, components: int) -> type:
    """The cheapest numbers that hold every squared distance of parts exactly."""
    most = components * 4.0 * greatest * greatest
    return np.float64 if most < 2.0 ** 51 else np.int64 if most < 2.0 ** 62 else object


def as_numbers(x: np.ndarray, kind: type) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind)


def squared_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact, rows of ``x`` against all entries; both hold numbers of ``arithmetic``."""
    if x.dtype == np.float64:
        return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ book.T) + (book * book).sum(axis=1)
    out = np.empty((len(x), len(book)), x.dtype)
    for j, entry in enumerate(book):
        out[:, j] = ((x - entry) ** 2).sum(axis=1)
    return out


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def searched(x: np.ndarray, book: np.ndarray, kept: int) -> Lists:
    """Lists of rows whose distances to all entries are computed; ties go to the lower number."""
    far = squared_distances(x, book)
    order = np.argsort(far, axis=1, kind="stable")
    roots = np.take_along_axis(_root(far), order, axis=1)
    n, entries = far.shape
    near = np.full((n, 1 + kept), NONE, np.uint8)
    lower = np.full((n, kept), np.inf)
    held = min(1 + kept, entries)
    near[:, :held] = order[:, :held]
    lower[:, :held - 1] = roots[:, 1:held]
    outer = roots[:, held] if held < entries else np.full(n, np.inf)
    return Lists(near, roots[:, 0].copy(), lower, outer.copy())


def moved(lists: Lists, x: np.ndarray, book: np.ndarray, drift: np.ndarray, b: int) -> tuple[Lists, np.ndarray, int]:
    """Lists after the entries moved by ``drift``, entries used per row (0: none), and distances computed.

    ``x`` holds the numbers of the rows, read only where the bounds fail.  With
    fewer entries listed than before, those left out join the outer bound.
    """
    near, lower, outer = lists.near.copy(), lists.lower.copy(), lists.outer - drift.max(initial=0.0) * (1 + _OUT)
    upper = lists.upper + drift[near[:, 0]]
    known = near[:, 1:] != NONE
    lower[known] -= drift[near[:, 1:][known]]
    kept = lower.shape[1]
    if b < kept:
        outer = np.minimum(outer, lower[:, b:].min(axis=1, initial=np.inf))
        near[:, 1 + b:], lower[:, b:] = NONE, np.inf
    # beyond[:, z]: no entry after the z-th of the next ones is nearer than this
    beyond = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    beyond = beyond - _OUT * np.abs(np.where(np.isfinite(beyond), beyond, 0.0))
    used, computed = np.zeros(len(x), np.int64), 0

    def open_rows(rows: np.ndarray, z: int) -> np.ndarray:
        return upper[rows] * (1 + _OUT) >= beyond[rows, z]

    left = np.arange(len(x))
    left = left[open_rows(left, 0)]
    if len(left):
        own = x[left] - book[near[left, 0]]
        upper[left] = _root((own * own).sum(axis=1))
        computed += len(left)
        left = left[open_rows(left, 0)]
    for z in range(1, b + 1):
        still = open_rows(left, z)
        rows, left = left[~still], left[still]
        if not len(rows):
            continue
        listed = near[rows, :z + 1].astype(np.int64)
        empty = listed == NONE
        gap = x[rows][:, None, :] - book[np.where(empty, 0, listed)]
        far = (gap * gap).sum(axis=2)
        roots = np.where(empty, np.inf, _root(far))
        ties = np.argsort(listed, axis=1, kind="stable")  # by distance, then by number
        far = np.take_along_axis(far, ties, axis=1)
        if empty.any():
            far = far.astype(object)
            far[np.take_along_axis(empty, ties, axis=1)] = math.inf
        order = np.take_along_axis(ties, np.argsort(far, axis=1, kind="stable"), axis=1)
        near[rows, :z + 1] = np.take_along_axis(listed, order, axis=1)
        roots = np.take_along_axis(roots, order, axis=1)
        upper[rows], lower[rows, :z] = roots[:, 0], roots[:, 1:]
        used[rows] = z
        computed += len(rows) * (z + 1)
    if len(left):
        fresh = searched(x[left], book, kept)
        near[left], upper[left], lower[left], outer[left] = fresh
        used[left] = b + 1
        computed += len(left) * len(book)
    return Lists(near, upper, lower, outer), used, computed


def next_b(used: np.ndarray, b: int, least: int, most: int) -> int:
    """``used[z]``: rows that needed z listed entries; the last place: all entries."""
    total = used.sum()
    needed = int(np.flatnonzero(used[:b + 1]).max(initial=0))
    if total and used[b + 1:].sum() > RARE * total:
        needed = b + 1
    return min(max(needed, least), most)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """``rows`` (``id``, ``label``, ``code``, ``error``), the final codebooks and the work of each round.

    Vectors that are NULL or hold a NULL, NaN or infinite component are left
    out.  Components become floor(scale * component); shorter vectors are filled
    up with zeros to a width that the parts divide.  Codebooks start with
    the rows of the smallest ids, of repeated ids the smaller vector first, NULL ids
    last; with fewer rows there are as many entries.  Rows with a NULL id and
    repeated rows are rows like any other.  ``code`` has two hex digits per
    part.  ``error`` beyond a long is the greatest long.  No rows, no codebooks.
    At most 255 entries.
    """
    spark = vectors.sparkSession
    if not 0 < entries < NONE:
        raise ValueError("codes need 1 to 254 entries")
    whole = real_vectors(vectors.select(id_col, vector_col, F.col(label_col).alias("label")), id_col, vector_col)
    whole = whole.select("id", "label", "x")
    found = whole.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    n, width = found[0], -(-(found[1] or 0) // parts) * parts
    greatest = (found[2] or 0.0) * scale + 1
    size = width // parts
    kind = arithmetic(greatest, size)
    stored_as = np.int16 if greatest < 2 ** 15 else np.int32 if greatest < 2 ** 31 else np.float64
    kept = max(1, entries // 4)
    least = max(1, entries // 8)
    first = whole.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x")
    start = as_numbers(whole_matrix(first, width, scale), object)
    books = [[[int(c) for c in row[p * size:(p + 1) * size]] for row in start] for p in range(parts)]
    label_type = whole.schema["label"].dataType.simpleString()
    schema = f"id long, label {label_type}, row binary, near binary, bounds binary, sums array<long>"
    limbs = max(2, -(-int(math.log2(greatest) + 33) // LIMB))

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return matrix_of(batch.column("row")).view(stored_as).astype(np.float64)

    def part_of(x: np.ndarray, p: int) -> np.ndarray:
        return as_numbers(x[:, p * size:(p + 1) * size], kind)

    def arrays(books: list) -> list[np.ndarray]:
        return [np.array(book, kind).reshape(len(book), size) for book in books]

    def statistics(total, counts, used, computed) -> pa.Array:
        flat = [int(c) for c in counts.ravel()] + [int(c) for c in used.ravel()] + [int(computed)]
        for value in total.ravel():
            sign, value = (-1, -int(value)) if value < 0 else (1, int(value))
            flat += [sign * ((value >> (LIMB * i)) & ((1 << LIMB) - 1)) for i in range(limbs)]
        return pa.array([flat], pa.list_(pa.int64()))

    def rounded(lists: list[Lists]) -> pa.Array:
        with np.errstate(over="ignore"):
            up = np.stack([one.upper for one in lists], axis=1)
            down = np.stack([np.concatenate([one.lower, one.outer[:, None]], axis=1) for one in lists], axis=1)
            up = np.nextafter(up.astype(np.float32), np.float32(np.inf))
            down = np.where(np.isinf(down), np.float32(np.inf), np.nextafter(down.astype(np.float32), np.float32(-np.inf)))
        return packed(np.concatenate([up[:, :, None], down], axis=2).reshape(len(up), -1))

    def unpacked(batch: pa.RecordBatch) -> list[Lists]:
        near = matrix_of(batch.column("near")).reshape(-1, parts, 1 + kept)
        bounds = matrix_of(batch.column("bounds")).view(np.float32).astype(np.float64).reshape(-1, parts, kept + 2)
        return [
            Lists(near[:, p], bounds[:, p, 0], bounds[:, p, 1:-1].copy(), bounds[:, p, -1].copy()) for p in range(parts)
        ]

    def assigned(books: list, drifts: np.ndarray | None, b: list[int]):
        """A task function: rows of the round before (or vectors) to rows with new lists, then one row of sums."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = arrays(books)
            entries_here = len(book[0])
            total = np.zeros((parts, entries_here, size), object)
            counts = np.zeros((parts, entries_here), np.int64)
            used_by, computed, seen = np.zeros((parts, kept + 2), np.int64), 0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen += batch.num_rows
                x = numbers(batch) if drifts is not None else whole_matrix(batch.column("x"), width, scale)
                before = unpacked(batch) if drifts is not None else None
                lists = []
                for p in range(parts):
                    own = part_of(x, p)
                    if before is None:
                        one = searched(own, book[p], kept)
                        computed += len(own) * entries_here
                    else:
                        one, used, work = moved(before[p], own, book[p], drifts[p], b[p])
                        used_by[p] += np.bincount(np.where(used > b[p], kept + 1, used), minlength=kept + 2)
                        computed += work
                    lists.append(one)
                    code = one.near[:, 0].astype(np.int64)
                    counts[p] += np.bincount(code, minlength=entries_here)
                    order = np.argsort(code, kind="stable")
                    present, starts = np.unique(code[order], return_index=True)
                    exact = own[order] if kind is object else own[order].astype(np.int64)
                    total[p, present] += as_numbers(np.add.reduceat(exact, starts, axis=0), object)
                row = packed(x.astype(stored_as)) if drifts is None else batch.column("row")
                near = packed(np.concatenate([one.near for one in lists], axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("label"), row, near, rounded(lists),
                        pa.nulls(batch.num_rows, pa.list_(pa.int64())),
                    ],
                    ["id", "label", "row", "near", "bounds", "sums"],
                )
            if seen:
                label = batch.schema.field("label").type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(1, pa.int64()), pa.nulls(1, label), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                        pa.nulls(1, pa.binary()), statistics(total, counts, used_by, computed),
                    ],
                    ["id", "label", "row", "near", "bounds", "sums"],
                )

        return run

    def write(rows: DataFrame, run) -> tuple[str, DataFrame]:
        path = work_dir(spark, "codes")
        rows.mapInArrow(run, schema).write.parquet(path)
        return path, spark.read.schema(schema).parquet(path)

    if not n or not width:
        books = books if n else [[] for _part in range(parts)]
        empty = whole.select("id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty, books, [])

    share, b = [], [kept] * parts
    path, stored = write(whole, assigned(books, None, b))
    for _round in range(rounds):
        held = len(books[0])
        sums = _added(stored)
        counts = sums[:parts * held].reshape(parts, held)
        used = sums[parts * held:parts * (held + kept + 2)].reshape(parts, kept + 2)
        share.append(float(sums[parts * (held + kept + 2)]) / (n * parts * held))
        if len(share) > 1:
            b = [next_b(_by_place(used[p], b[p]), b[p], least, kept) for p in range(parts)]
        total = sums[parts * (held + kept + 2) + 1:].reshape(parts, held, size, limbs)
        new, drifts = [], np.zeros((parts, held))
        for p in range(parts):
            new.append([
                [sum(int(limb) << (LIMB * i) for i, limb in enumerate(total[p, j, c])) // int(counts[p, j]) for c in range(size)]
                if counts[p, j] else books[p][j]
                for j in range(held)
            ])
            for j in range(held):
                square = sum((int(u) - int(v)) ** 2 for u, v in zip(new[p][j], books[p][j]))
                drifts[p, j] = math.sqrt(float(square)) * (1 + _OUT)
        books = new
        old = path
        path, stored = write(stored.where("sums IS NULL"), assigned(books, drifts, b))
        remove_work(spark, old)
    share.append(float(_added(stored)[parts * (len(books[0]) + kept + 2)]) / (n * parts * len(books[0])))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = arrays(books)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = numbers(batch)
            code = matrix_of(batch.column("near")).reshape(-1, parts, 1 + kept)[:, :, 0]
            error = np.zeros(len(x), object)
            for p in range(parts):
                gap = part_of(x, p) - book[p][code[:, p]]
                error += as_numbers((gap * gap).sum(axis=1), object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in code], pa.string()),
                    pa.array([min(e, LONG_MAX) for e in error.tolist()], pa.int64()),
                ],
                ["id", "label", "code", "error"],
            )

    rows = stored.where("sums IS NULL").select("id", "label", "row", "near").mapInArrow(
        finished, f"id long, label {label_type}, code string, error long"
    )
    return Codes(rows, books, share)


def _by_place(used: np.ndarray, b: int) -> np.ndarray:
    """Rows by listed entries needed, those that compared all entries after the b-th."""
    return np.concatenate([used[:b + 1], [used[b + 1:].sum()]])


def _added(stored: DataFrame) -> np.ndarray:
    """The sums of all tasks, added by Spark: one number per entry and component."""
    rows = (
        stored.where("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "value"))
        .groupBy("place").agg(F.sum("value").alias("value")).collect()
    )
    out = np.zeros(len(rows), object)
    for row in rows:
        out[row["place"]] = row["value"]
    return out


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors of equal labels (NULLs together) added up, a long at most."""
    rows = cut_lineage(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(str(LONG_MAX)).cast("decimal(38,0)")).cast("long")
    totals = cut_lineage(
        rows.groupBy("label").agg(F.count("*").alias("_n"), total.alias("label_error")).withColumnRenamed("label", "_key")
    )
    keyed = rows.withColumnRenamed("label", "_key")
    spread = [F.xxhash64("id", "code")]
    return join_hot_keys(keyed, totals, "_key", "_n", spread).withColumnRenamed("_key", "label").drop("_n")


def codebook_digest(codebooks: list[list[list[int]]]) -> str:
    numbers = [str(c) for book in codebooks for entry in book for c in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()
