"""SimHash near-duplicates: exact pairs within a Hamming radius through vantage-point trees.

A fingerprint has 64 bits.  Two fingerprints that differ in at most R bits
differ in at most R // 3 bits in one third of them, so there is one tree per
third.  A node of a tree holds a vantage point and a radius: fingerprints at
most that far go inside, the others outside.  By the triangle inequality a
query with tolerance r needs the inside only if its distance is at most radius
+ r and the outside only if it is more than radius - r.

The top of each tree is fitted on a sample and cuts the fingerprints into
shards; a fingerprint is stored in one shard per tree and asks every shard that
its tolerance overlaps.  Inside a shard the tree goes on, down to small leaves,
where pairs are compared exactly.  A shard that is far too large (many
fingerprints with one third in common) is dealt over several tasks, all of which
are asked.

A task emits a spanning forest of the pairs that it finds, at most one row per
query and one per stored fingerprint: no link between components is lost and
copies are never multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import groups_in, text_slices
from larkspur.llm.components import connected_components
from larkspur.operators.skew import join_hot_keys
from larkspur.session import cut_lineage

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
SAMPLE = 65_536  # fingerprints that the tops of the trees are fitted on, about
SHARD, MAX_SHARDS = 4_096, 4_096  # fingerprints of a shard; shards of a tree
LEAF = 64
_MASKS = [np.uint64(((1 << width) - 1) << low) for low, width in ((0, 22), (22, 21), (43, 21))]
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles, as a signed number; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - words_per_shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(words_per_shingle, len(words)) - 1:].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (long) of every row; NULL and empty texts have 0."""
    id_name = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values = [fingerprint(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int64())], ["id", "fingerprint"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(hashed, f"id {id_name}, fingerprint long")
        .withColumnRenamed("id", id_col)
    )


class VantageTree:
    """A vantage-point tree over one part (mask) of the fingerprints, held in arrays."""

    def __init__(self, values: np.ndarray, mask: np.uint64, tolerance: int, leaf: int, depth: int):
        self.mask, self.tolerance = mask, tolerance
        self.point, self.radius, self.inside, self.outside = [], [], [], []  # a child >= 0 is a node
        self.leaves = 0
        self.members: list[np.ndarray] = []
        root = self._grow(values & mask, np.arange(len(values)), leaf, depth, np.random.default_rng(7))
        self.root = root
        self.point = np.array(self.point, np.uint64)
        self.radius = np.array(self.radius, np.int64)
        self.inside = np.array(self.inside, np.int64)
        self.outside = np.array(self.outside, np.int64)

    def _grow(self, values: np.ndarray, own: np.ndarray, leaf: int, depth: int, random) -> int:
        split = self._split(values[own], random) if len(own) > leaf and depth else None
        if split is None:
            self.members.append(own)
            self.leaves += 1
            return -self.leaves  # leaf k is -1 - k
        point, radius, near = split
        node = len(self.radius)
        for kept, value in ((self.point, point), (self.radius, radius), (self.inside, 0), (self.outside, 0)):
            kept.append(value)
        self.inside[node] = self._grow(values, own[near], leaf, depth - 1, random)
        self.outside[node] = self._grow(values, own[~near], leaf, depth - 1, random)
        return node

    def _split(self, values: np.ndarray, random) -> tuple[np.uint64, int, np.ndarray] | None:
        """The vantage point and radius with the fewest fingerprints near the boundary, of a few tries."""
        best = None
        for point in values[random.integers(0, len(values), 6)]:
            distance = np.bitwise_count(values ^ point)
            counts = np.bincount(distance, minlength=66)
            share = np.cumsum(counts) / len(values)
            for radius in np.flatnonzero((share >= 0.25) & (share <= 0.75)).tolist():
                low = max(radius - self.tolerance + 1, 0)
                cost = counts[low:radius + self.tolerance + 1].sum() / len(values) + abs(share[radius] - 0.5)
                if best is None or cost < best[0]:
                    best = cost, point, radius, distance <= radius
        if best is None:  # no balanced radius: split off what is equal to one value, if anything is not
            point = values[0]
            distance = np.bitwise_count(values ^ point)
            if not distance.any():
                return None
            radius = int(np.sort(distance)[len(distance) // 2])
            radius = min(radius, int(distance.max()) - 1)
            return point, radius, distance <= radius
        return best[1:]

    def home(self, values: np.ndarray) -> np.ndarray:
        """The leaf that stores each value."""
        node = np.full(len(values), self.root)
        values = values & self.mask
        open_rows = np.flatnonzero(node >= 0)
        while len(open_rows):
            at = node[open_rows]
            near = np.bitwise_count(values[open_rows] ^ self.point[at]) <= self.radius[at]
            node[open_rows] = np.where(near, self.inside[at], self.outside[at])
            open_rows = open_rows[node[open_rows] >= 0]
        return -1 - node

    def overlapping(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold something within the tolerance."""
        rows, node = np.arange(len(values)), np.full(len(values), self.root)
        values = values & self.mask
        done_rows, done_leaves = [], []
        while len(rows):
            leaf = node < 0
            done_rows.append(rows[leaf])
            done_leaves.append(-1 - node[leaf])
            rows, node = rows[~leaf], node[~leaf]
            distance = np.bitwise_count(values[rows] ^ self.point[node]).astype(np.int64)
            near = distance - self.tolerance <= self.radius[node]
            far = distance + self.tolerance > self.radius[node]
            rows, node = (
                np.concatenate([rows[near], rows[far]]),
                np.concatenate([self.inside[node[near]], self.outside[node[far]]]),
            )
        if not done_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(done_rows), np.concatenate(done_leaves)


class Forest:
    """Union-find over stored fingerprints; remembers which links are new."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x


def _links(stored: np.ndarray, tree: VantageTree, forest: Forest, asked: np.ndarray, radius: int) -> list[tuple]:
    """Spanning links between ``asked`` and smaller stored fingerprints within ``radius`` bits."""
    links = []
    rows, leaves = tree.overlapping(asked)
    order = np.argsort(leaves, kind="stable")
    rows, leaves = rows[order], leaves[order]
    edges = np.flatnonzero(np.r_[True, np.diff(leaves) != 0]) if len(leaves) else []
    first: dict[int, int] = {}  # query row -> a stored fingerprint that it is linked to already
    for start, stop in zip(edges, np.r_[edges[1:], len(leaves)].astype(int) if len(leaves) else []):
        members = tree.members[leaves[start]]
        values = stored[members]
        step = max(1, (1 << 20) // len(values)) if len(values) else 1
        for at in range(start, stop, step):
            own = rows[at:min(at + step, stop)]
            query = asked[own][:, None]
            hit, member = np.nonzero((np.bitwise_count(query ^ values) <= radius) & (query > values))
            if not len(hit):
                continue
            roots = np.fromiter(map(forest.find, members[member].tolist()), np.int64, len(member))
            _pairs, chosen = np.unique(own[hit] * (len(stored) + 1) + roots, return_index=True)
            for i in chosen.tolist():
                q, x = int(own[hit[i]]), int(members[member[i]])
                known = first.get(q)
                if known is None:
                    first[q] = x
                    links.append((asked[q], stored[x]))
                elif (a := forest.find(known)) != (b := forest.find(x)):
                    forest.parent[b] = a
                    links.append((asked[q], stored[x]))
    return links


def linked_pairs(distinct: DataFrame, column: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """Links ``a`` > ``b`` between distinct fingerprints, enough to connect all within ``radius`` bits.

    ``distinct`` must be stored: it is read several times.
    """
    spark = distinct.sparkSession
    values = distinct.select(F.col(column).alias("f"))
    n = values.count()
    every = max(4, n // SAMPLE)
    sample = values.where(F.pmod(F.xxhash64("f"), F.lit(every)) == 0).toArrow().column("f").to_numpy().view(np.uint64)
    shard = max(SHARD, -(-n // MAX_SHARDS))
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    least = max(1, len(sample) * shard // max(2 * n, 1))
    tops = [VantageTree(sample, mask, radius // 3, least, depth) for mask in _MASKS]
    for top in tops:
        top.members = []

    def stored_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("f").to_numpy().view(np.uint64)
            for t, top in enumerate(tops):
                shards, counts = np.unique(top.home(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards * 3 + t, pa.int64()), pa.array(counts, pa.int64())], ["shard", "n"]
                )

    sizes = values.mapInArrow(stored_in, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    # at most three trees' shards, a fixed bound
    parts = {row.shard: -(-row.n // (4 * shard)) for row in sizes.collect()}
    deal = np.ones((3, max((top.leaves for top in tops), default=1)), np.int64)
    for key, count in parts.items():
        deal[key % 3, key // 3] = max(count, 1)
    offset = np.cumsum(np.r_[0, deal.ravel()])
    offset, groups = offset[:-1].reshape(deal.shape), int(offset[-1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("f").to_numpy().view(np.uint64)
            mixed = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for t, top in enumerate(tops):
                home = top.home(own)
                yield _dealt_batch(offset[t, home] + mixed % deal[t, home], 0, own)
                rows, leaves = top.overlapping(own)
                copies = deal[t, leaves]
                begin = np.repeat(np.cumsum(copies) - copies, copies)
                keys = np.repeat(offset[t, leaves], copies) + np.arange(len(begin)) - begin
                asked = own[np.repeat(rows, copies)]
                for at in range(0, len(keys), 100_000):
                    yield _dealt_batch(keys[at:at + 100_000], 1, asked[at:at + 100_000])

    tree_of = np.repeat(np.arange(3), deal.sum(axis=1))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, runs in groups_in(batches, "part"):
            held, tree, forest, stored = [], None, None, None
            for run in runs:
                own = run.column("f").to_numpy().view(np.uint64)
                asking = run.column("side").to_numpy() == 1
                if not asking.all():
                    held.append(own[~asking])
                if not asking.any() or not held:
                    continue
                if tree is None:
                    stored = np.concatenate(held)
                    tree = VantageTree(stored, _MASKS[tree_of[key]], radius // 3, LEAF, 64)
                    forest = Forest(len(stored))
                links = _links(stored, tree, forest, own[asking], radius)
                if links:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(side, np.uint64).view(np.int64)) for side in zip(*links)], ["a", "b"]
                    )

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, 4_096))
    return (
        values.mapInArrow(dealt, "part long, side int, f long")
        .repartition(tasks, "part").sortWithinPartitions("part", "side")
        .mapInArrow(matched, "a long, b long")
    )


def _dealt_batch(keys: np.ndarray, side: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys.astype(np.int64)),
            pa.array(np.full(len(keys), side, np.int32)),
            pa.array(np.ascontiguousarray(values).view(np.int64)),
        ],
        ["part", "side", "f"],
    )


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``component`` (smallest key reachable) of every row.

    Rows are linked when their fingerprints differ in at most ``radius`` bits;
    copies share a fingerprint.  NULL, empty and blank texts have fingerprint 0
    and are linked like any other.  Repeated rows come out as often as they went
    in; a NULL key counts for nothing when the smallest key is taken, and a
    component of NULL keys only has a NULL component.  Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut_lineage(fingerprints(named, "id"))
    distinct = cut_lineage(
        marked.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    )
    roots = cut_lineage(connected_components(cut_lineage(linked_pairs(distinct, radius=radius))))
    linked = cut_lineage(roots.join(distinct, roots.node == distinct.fingerprint).select("node", "root", "least"))
    best = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("members")))
    known = join_hot_keys(linked, best, "root", "members", [F.col("node")])
    components = cut_lineage(
        distinct.join(known.select(F.col("node").alias("fingerprint"), "best"), "fingerprint", "left")
        .select("fingerprint", "n", F.coalesce("best", "least").alias("component"))
    )
    return join_hot_keys(marked, components, "fingerprint", "n", [F.col("id")]).select(
        F.col("id").alias(id_col), "fingerprint", "component"
    )


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
