"""Hard negatives: rows of other labels whose score lies in a window below each positive's score.

Candidates are dealt to cells around centres that are taken farthest first from
a sample, the top level of a cover tree; each cell is a cover tree of its own,
built in the task that holds it (see ``cover_tree``).  An anchor goes only to the
cells whose covering radius lets a wanted score be inside: first to those with
the highest bounds, then, with the k-th score found so far as a limit, to the
others that may still hold better ones.  So a task emits few rows that do not
count, however many cells there are.

Positives are found first; each opens a window of scores, and all windows of an
anchor descend a tree together.  Of rows equal in label and vector only the
smallest ids can be in an answer, so only those are candidates; cells that grew
large are dealt over several tasks, all of which are asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from larkspur.llm.arrow import groups_in, matrix_of
from larkspur.llm.cover_tree import CoverTree, Window, augmented, score_bounds
from larkspur.llm.whole import GREATEST, LONG_MAX, LONG_MIN, packed, real_vectors, whole_matrix
from larkspur.session import cut_lineage

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
CELL_ROWS = 4_096  # candidates of a cell, about; a cell is dealt over tasks beyond four times as many
MAX_CELLS = 4_096
SAMPLE, SAMPLE_BYTES = 65_536, 32 << 20  # vectors that centres are chosen from, at most
FIRST_CELLS = 8  # cells asked first, at least; a sixteenth of all where that is more
SALTS = 64

_QUESTION = "part long, side int, number long, id long, label string, row binary, low array<long>, high array<long>"


def score_window(positive: int, low: int = LOW, high: int = HIGH) -> Window:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return Window(-(-low * positive // 100), high * positive // 100)


class Cells:
    """Centres of cells with what is known of the rows in them."""

    def __init__(self, centres: np.ndarray, norm: float, radius: np.ndarray, chord: np.ndarray, parts: np.ndarray):
        self.centres, self.norm, self.radius, self.chord, self.parts = centres, norm, radius, chord, parts
        self.lengths = np.sqrt((centres * centres).sum(axis=1))
        self.first = np.cumsum(np.r_[0, parts])
        self.at_first = max(FIRST_CELLS, len(centres) // 16)

    def asked(self, q: np.ndarray, windows: list[Window], second: bool) -> np.ndarray:
        """Cells that may hold a score of a window: the highest bounds, or all others."""
        least, most = score_bounds(q, self.centres, self.lengths, self.radius, self.chord, self.norm)
        most = np.where(self.parts > 0, most, -np.inf)
        order = np.argsort(-most, kind="stable")
        order = order[self.at_first:] if second else order[:self.at_first]
        open_to = np.zeros(len(order), bool)
        for w in windows:
            open_to |= (most[order] >= float(w.low)) & (least[order] <= float(w.high)) & (w.low <= w.high)
        return order[open_to & (self.parts[order] > 0)]


def farthest_first(x: np.ndarray, count: int, norm: float) -> np.ndarray:
    """Row numbers of centres, each one the row farthest from those before."""
    full = np.concatenate([x, augmented(x, norm)[:, None]], axis=1)
    chosen = [0]
    far = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def mine(
    vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (rank int, others long).

    ``is_anchor`` is a condition on column ``id``.  Components become
    floor(scale * component), a score is their inner product with the anchor's;
    ties go to the smaller id.  An anchor's positives are its best ``positives``
    other rows of the same label; for each, ``rank`` counts the best ``negatives`` rows
    of other labels with low * positive <= 100 * negative <= high * positive
    (percent; a negative positive score has none).  Rows with a NULL id, label or
    vector, or with a NULL, NaN or infinite component take no part.  Rows that
    repeat id, label and vector count once; rows that share only an id are rows
    of their own, none of which answers another.  Shorter vectors count as filled
    up with zeros.  A score beyond a long counts as the greatest or least long.
    """
    spark = vectors.sparkSession
    rows = real_vectors(vectors.select(id_col, vector_col, F.col(label_col).cast("string").alias("label")), id_col, vector_col)
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").select("id", "label", "x", F.xxhash64("label", "x").alias("hash"))
    rows = cut_lineage(rows.withColumn("asks", F.coalesce(is_anchor, F.lit(False))))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    width, longest = rows.agg(F.max(F.size("x")), F.max(length)).first()
    width = width or 0
    norm = (longest or 0.0) * scale + np.sqrt(width) + 1  # floors are at most one longer per component
    norm = float(min(norm, GREATEST * np.sqrt(width + 1)))
    candidates = cut_lineage(_smallest_ids(rows, max(positives, negatives) + 1))
    n = candidates.count()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
    every = max(1, n // most)
    sample = candidates.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0).limit(2 * most).select("x").toArrow()
    sample = whole_matrix(sample.column("x"), width, scale)
    sample = sample if len(sample) else np.zeros((1, width))
    centres = sample[farthest_first(sample, min(max(1, -(-n // CELL_ROWS)), MAX_CELLS), norm)]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = augmented(centres, norm)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_matrix(batch.column("x"), width, scale)
            own = augmented(x, norm)
            cell = np.empty(len(x), np.int64)
            for at in range(0, len(x), 1_024):
                part = slice(at, at + 1_024)
                cell[part] = (x[part] @ centres.T + own[part, None] * fill).argmax(axis=1)
            near = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            far = np.sqrt(near * near + (own - fill[cell]) ** 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell), batch.column("id"), batch.column("label"), batch.column("hash"), packed(x),
                    pa.array(near), pa.array(far),
                ],
                ["cell", "id", "label", "hash", "row", "near", "far"],
            )

    schema = "cell long, id long, label string, hash long, row binary, near double, far double"
    stored = cut_lineage(candidates.mapInArrow(located, schema))
    known = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far")).collect()
    radius, chord, parts = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for row in known:  # MAX_CELLS rows at most
        radius[row["cell"]], chord[row["cell"]] = row["near"], row["far"]
        parts[row["cell"]] = -(-row["n"] // CELL_ROWS) if row["n"] > 4 * CELL_ROWS else 1
    cells = Cells(centres, norm, radius, chord, parts)
    anchors = cut_lineage(
        rows.where("asks").select("id", "label", "x").distinct().withColumn("number", F.monotonically_increasing_id())
    )

    same = anchors.select(
        "number", "id", "label", "x", F.array(F.lit(LONG_MIN)).alias("low"), F.array(F.lit(LONG_MAX)).alias("high")
    )
    found = _searched(stored, same, cells, width, scale, positives, True)
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("order"), "vec_id", "score")), asc=False)
    chosen = cut_lineage(found.groupBy("number").agg(pairs.alias("positives")))
    low_of = F.transform("positives", lambda p: _window_edge(p["score"], low, True))
    high_of = F.transform("positives", lambda p: _window_edge(p["score"], high, False))
    other = cut_lineage(
        anchors.join(chosen, "number").select("number", "id", "label", "x", low_of.alias("low"), high_of.alias("high"))
    )
    answers = _searched(stored, other, cells, width, scale, negatives, False)
    listed = chosen.join(anchors.select("number", F.col("id").alias("anchor_id")), "number").select(
        "number", "anchor_id", F.posexplode("positives").alias("window", "p")
    )
    return answers.join(listed, ["number", "window"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _window_edge(score, percent: int, lower: bool):
    """``score_window`` of a column."""
    whole = F.lit(percent).cast("decimal(38,0)") * score.cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(whole) if lower else F.floor(whole)).cast("long")


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Distinct rows, of those equal in label and vector the ``k`` smallest ids; a hot group is cut in salts first."""
    salted = Over.partitionBy("hash", "label", "x", "salt").orderBy("id")
    whole = Over.partitionBy("hash", "label", "x").orderBy("id")
    return (
        rows.select("id", "label", "x", "hash", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).distinct()
        .withColumn("turn", F.row_number().over(salted)).where(F.col("turn") <= k)
        .withColumn("turn", F.row_number().over(whole)).where(F.col("turn") <= k)
        .drop("turn", "salt")
    )


def _searched(
    stored: DataFrame, questions: DataFrame, cells: Cells, width: int, scale: int, k: int, same: bool
) -> DataFrame:
    """``number, window, rank, vec_id, score``: the best ``k`` of every window of every question; stored."""
    best = cut_lineage(_ranked(_asked(stored, questions, cells, width, scale, k, same, False), k))
    if len(cells.centres) <= cells.at_first:
        return best
    # the k-th score so far raises a window's lower edge
    floors = best.where(F.col("rank") == k).groupBy("number").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors")
    )
    raised = F.transform("low", lambda edge, i: F.greatest(edge, F.element_at("floors", i)))
    further = questions.join(floors, "number", "left").withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(raised))
    more = _asked(stored, further.drop("floors"), cells, width, scale, k, same, True)
    return cut_lineage(_ranked(best.drop("rank").unionAll(more), k))


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Over.partitionBy("number", "window").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("number", "window", "rank", "vec_id", "score")


def _asked(
    stored: DataFrame, questions: DataFrame, cells: Cells, width: int, scale: int, k: int, same: bool, second: bool
) -> DataFrame:
    """``number, window, vec_id, score`` from the cells that the questions go to."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            mixed = (batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = cells.first[own] + mixed.astype(np.int64) % np.maximum(cells.parts[own], 1)
            nothing = pa.nulls(len(own), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part), pa.array(np.zeros(len(own), np.int32)), pa.nulls(len(own), pa.int64()), batch.column("id"),
                    batch.column("label"), batch.column("row"), nothing, nothing,
                ],
                ["part", "side", "number", "id", "label", "row", "low", "high"],
            )

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_matrix(batch.column("x"), width, scale)
            lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            part, who = [], []
            for i, q in enumerate(x):
                for cell in cells.asked(q, [Window(*w) for w in zip(lows[i], highs[i])], second).tolist():
                    part += range(cells.first[cell], cells.first[cell + 1])
                    who += [i] * int(cells.parts[cell])
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int64()), pa.array(np.ones(len(part), np.int32)), batch.column("number").take(at),
                    batch.column("id").take(at), batch.column("label").take(at), packed(x).take(at),
                    pa.array(lows, pa.list_(pa.int64())).take(at), pa.array(highs, pa.list_(pa.int64())).take(at),
                ],
                ["part", "side", "number", "id", "label", "row", "low", "high"],
            )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, runs in groups_in(batches, "part"):
            held, tree, names = [], None, {}
            for run in runs:
                asks = run.column("side").to_numpy() == 1
                own = run.filter(pa.array(~asks))
                if own.num_rows:
                    held.append((own.column("id").to_numpy(), own.column("label").to_pylist(), _rows(own, width)))
                asked = run.filter(pa.array(asks))
                if not asked.num_rows or not held:
                    continue
                if tree is None:
                    labels = [label for _ids, own_labels, _x in held for label in own_labels]
                    names = {label: i for i, label in enumerate(sorted(set(labels)))}
                    tree = CoverTree(
                        np.concatenate([h[2] for h in held]), np.concatenate([h[0] for h in held]),
                        np.array([names[label] for label in labels], np.int64), cells.norm,
                    )
                    held = [()]
                yield _answers(tree, names, asked, width, k, same)

    spark = stored.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(cells.first[-1]), 4_096))
    return (
        stored.mapInArrow(dealt, _QUESTION).unionAll(questions.mapInArrow(asking, _QUESTION))
        .repartition(tasks, "part").sortWithinPartitions("part", "side")
        .mapInArrow(answered, "number long, window int, vec_id long, score long")
    )


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return matrix_of(batch.column("row")).view(np.float64) if width else np.empty((batch.num_rows, 0))


def _answers(tree: CoverTree, names: dict, asked: pa.RecordBatch, width: int, k: int, same: bool) -> pa.RecordBatch:
    number, window, ids, scores = [], [], [], []
    lows, highs = asked.column("low").to_pylist(), asked.column("high").to_pylist()
    for i, q in enumerate(_rows(asked, width)):
        windows = [Window(*w) for w in zip(lows[i], highs[i])]
        label = names.get(asked.column("label")[i].as_py(), -1)
        found = tree.best(q, asked.column("id")[i].as_py(), label, same, windows, k)
        for j, (own_ids, own_scores) in enumerate(found):
            number.append(np.full(len(own_ids), asked.column("number")[i].as_py(), np.int64))
            window.append(np.full(len(own_ids), j, np.int32))
            ids.append(own_ids)
            scores.append(own_scores)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(column) if column else np.empty(0), kind)
            for column, kind in ((number, pa.int64()), (window, pa.int32()), (ids, pa.int64()), (scores, pa.int64()))
        ],
        ["number", "window", "vec_id", "score"],
    )
