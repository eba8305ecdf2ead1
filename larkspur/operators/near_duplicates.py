"""Groups of near-duplicate chunks over a whole corpus: MinHash bands, exact check, smallest id as label.

The JVM hashes the words of a chunk; numpy makes the shingle hashes, the MinHash
signature and its bands of a run of chunks at once, where they are read.  Shingles
are stored once, packed, and leave that place only for sets that share a band.
Chunks with equal sets are one set with one representative, so copies cost
nothing further.  Sets that share a band meet in one task, where a pair counts
only if its exact Jaccard similarity reaches the threshold.  Most bands hold one
set and go no further than a count; bands with the same sets are looked into
once.  Inside a band a set is compared until it is known to be connected, so near
copies of one chunk cost one comparison each, and a task, which takes its bands
from one sorted stream, links what is connected to the smallest of it.
A band with very many sets is dealt: every two deals of it meet in some task.

Two sets of similarity s share a band with probability 1 - (1 - s^5)^25, that is
0.9999 at 0.8; nothing else is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.operators.skew import BROADCAST_BYTES, broadcast_if_small, join_hot_keys
from larkspur.session import cut_lineage

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 25, 5
TASK_BANDS = 1 << 20  # band hashes that a task sorts
BAND_BYTES = 40  # of a broadcast band
DEAL = 1_024  # sets of one deal of a band; two deals meet in a task
RUN_TOKENS = 1 << 21  # tokens whose shingles a task holds at a time
RUN_VALUES = 1 << 15  # shingles whose band hashes are computed together
_SEED = 20_240


def token_hashes(text: Column | str) -> Column:
    return F.transform(tx.tokens(text), lambda token: F.xxhash64(token))


def shingles(text: Column | str, words: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, without words there is none."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for run in token_runs(batches):
            values, ends = shingle_sets(run, words)
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values), mask=empty(ends))

    return sets(token_hashes(text))


def signed_shingles(text: Column | str, words: int = SHINGLE_WORDS) -> Column:
    """``shingles`` packed into one binary value, and the ``bands`` of the set; both NULL for a text without words."""

    @F.arrow_udf(T.StructType().add("shingles", "binary").add("bands", T.ArrayType(T.LongType())))
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for run in token_runs(batches):
            values, ends = shingle_sets(run, words)
            none = empty(ends)
            some = ~none.to_numpy(zero_copy_only=False)
            keys = pa.array(band_keys_of(values, ends[some]).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some * BANDS)], pa.int32()), keys, mask=none)
            offsets = pa.array(np.r_[0, ends * 8], pa.int32())
            packed = pa.Array.from_buffers(
                pa.binary(), len(run), [pa.array(some).buffers()[1], offsets.buffers()[1], pa.py_buffer(values)]
            )
            yield pa.StructArray.from_arrays([packed, bands], ["shingles", "bands"])

    return signed(token_hashes(text))


def token_runs(batches: Iterator[pa.ListArray]) -> Iterator[pa.ListArray]:
    """Lists cut into runs of about ``RUN_TOKENS`` numbers, in order; a longer list is a run of its own."""
    for lists in batches:
        if not len(lists):
            yield lists
            continue
        _values, ends = flat(lists)
        start = 0
        while start < len(lists):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + RUN_TOKENS, "right")))
            yield lists.slice(start, stop - start)
            start = stop


def empty(ends: np.ndarray) -> pa.BooleanArray:
    return pa.array(np.diff(ends, prepend=0) == 0)


def shingle_sets(tokens: pa.ListArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every list of token hashes, in one array, and where each list's end in it."""
    values, ends = flat(tokens)
    values = values.view(np.uint64)
    sizes = np.diff(ends, prepend=0)
    counts = np.where(sizes < words, np.minimum(sizes, 1), sizes - words + 1)
    offsets = np.r_[0, np.cumsum(counts)]
    # where each shingle starts among the tokens
    at = np.arange(offsets[-1]) + np.repeat(ends - sizes - offsets[:-1], counts)
    length = np.repeat(np.minimum(sizes, words), counts)
    hashed = length.astype(np.uint64)
    for i in range(words):
        inside = slice(None) if len(length) and length.min() > i else length > i
        part = (hashed[inside] ^ values[at[inside] + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashed[inside] = part ^ (part >> np.uint64(32))
    hashed = hashed.view(np.int64)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        hashed[start:end].sort()
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    fresh[offsets[:-1][counts > 0]] = True
    return hashed[fresh], np.r_[0, np.cumsum(fresh)][offsets[1:]]


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in one array, and where each list ends in it; NULL is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64)


def unpacked(sets: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` of packed shingles, none of them NULL."""
    _valid, offsets, data = sets.buffers()
    size = np.int64 if pa.types.is_large_binary(sets.type) else np.int32
    at = np.frombuffer(offsets, size)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
    return np.frombuffer(data, np.int64, int(at[-1] - at[0]) // 8, int(at[0])), (at[1:] - at[0]) // 8


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS hashes per set; sets share one with a probability that grows with their similarity."""
    return band_keys_of(np.concatenate(sets), np.cumsum([len(s) for s in sets]))


def band_keys_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``band_keys`` of sets that lie one after the other in ``values``, none of them empty.

    The hashes that are ordered have 32 bits: a band's rows mix the values each in
    its own way, and every band multiplies that by a number of its own.
    """
    random = np.random.default_rng(_SEED)
    mix = random.integers(0, 1 << 63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    odd = random.integers(0, 1 << 31, (BAND_ROWS, BANDS), np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(ends), BANDS), np.uint64)
    begin = 0
    while begin < len(ends):  # runs that stay in the processor's cache
        first = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, first + RUN_VALUES, "right")))
        run = values[first : int(ends[stop - 1])].view(np.uint64)
        starts = np.r_[0, ends[begin : stop - 1] - first]
        run = run ^ (run >> np.uint64(32))
        keys = out[begin:stop]
        for i in range(BAND_ROWS):
            mixed = run * mix[i]
            mixed ^= mixed >> np.uint64(29)
            mixed = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
            least = np.stack([np.minimum.reduceat(mixed * odd[i, band], starts) for band in range(BANDS)], axis=1)
            keys ^= least
            keys *= np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
        begin = stop
    return (out ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large) - 1e-9:
        return False
    shared = np.count_nonzero(large.take(np.searchsorted(large, small), mode="clip") == small)
    return shared >= threshold * (len(small) + len(large) - shared) - 1e-9


def connected(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: float) -> list[list[int]]:
    """What similar pairs connect, two sets and more; numbers of ``second`` follow those of ``first``.

    Pairs within ``first``, or between ``first`` and ``second`` if given.
    """
    sets = first + (second or [])
    root = list(range(len(sets)))
    members = [[i] for i in root]

    def join(a: int, b: int) -> None:
        keep, gone = (root[a], root[b]) if len(members[root[a]]) >= len(members[root[b]]) else (root[b], root[a])
        for m in members[gone]:
            root[m] = keep
        members[keep] += members[gone]
        members[gone] = []

    start, others = (0, range(len(sets))) if second is None else (len(first), range(len(first)))
    for i in range(start, len(sets)):
        done: set[int] = set()
        for j in others if second is not None else range(i):
            if root[j] in done or root[j] == root[i]:
                continue
            if similar(sets[i], sets[j], threshold):
                join(i, j)
                done.add(root[i])
    return [m for m in members if len(m) > 1]


def similar_links(sets: DataFrame, bodies: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` between ids of ``sets`` (id, bands; stored) that connect what similar pairs connect.

    ``bodies`` (id, shingles; stored) has the sets themselves, and may have more.
    """
    shared = cut_lineage(shared_bands(sets))
    once = cut_lineage(shared.groupBy("n", "ids", "least").agg(F.min("band").alias("band")).select("band", "n"))
    if once.count() * BAND_BYTES <= BROADCAST_BYTES:
        members = shared.join(F.broadcast(once.select("band")), "band")
    else:
        members = join_hot_keys(shared.select("band", "id"), once, "band", "n", [F.col("id")])
    deals = F.ceil(F.col("n") / DEAL).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit(7)), deals)
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), deals - 1),
        lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")),
    )
    meeting = members.select("band", "id", own.alias("deal"), F.explode(met).alias("at"))
    # one deal alone needs a task of its own only if it is the band's only deal; otherwise pairs of deals cover it
    keyed = cut_lineage(meeting.select("band", F.col("at.low").alias("low"), F.col("at.high").alias("high"), "deal", "id"))
    full = keyed.join(bodies, "id").select("band", "low", "high", "deal", "id", "shingles")
    place = ["band", "low", "high"]
    together = full.repartition(*place).sortWithinPartitions(*place, "id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of one group of rows with the same place after the other; a group may go on in the next batch."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*rest, batch])
            ends = group_ends(rows, place)
            yield group_links(rows, ends[:-1], threshold)
            rest = [rows.slice(ends[-2] if len(ends) > 1 else 0)]
        if rest:
            yield group_links(rest[0], group_ends(rest[0], place), threshold)

    return together.mapInArrow(linked, "a long, b long")


def shared_bands(sets: DataFrame) -> DataFrame:
    """``band`` and ``id`` of bands that two ``sets`` (id, bands; stored) or more have, with a digest of the band's ids.

    The digest is their number ``n``, the smallest, and the exclusive or of hashes of
    all.  Bands are dealt to tasks by their hash; a task sorts about a million numbers.
    """
    tasks = max(-(-sets.count() * BANDS // TASK_BANDS), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sets.select("id", F.explode("bands").alias("band")).repartition(tasks, "band")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(b.column("band").to_numpy(), b.column("id").to_numpy()) for b in batches if b.num_rows]
        if not columns:
            return
        band, ids = (np.concatenate(c) for c in zip(*columns))
        del columns
        order = np.argsort(band)
        band, ids = band[order], ids[order]
        starts = np.r_[0, np.flatnonzero(band[1:] != band[:-1]) + 1]
        n = np.diff(starts, append=len(band))
        rows = np.repeat(n > 1, n)
        band, ids, n = band[rows], ids[rows], n[n > 1]
        if not len(n):
            return
        starts = np.cumsum(n) - n
        hashed = (ids.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
        digest = np.bitwise_xor.reduceat(hashed, starts).view(np.int64)
        least = np.minimum.reduceat(ids, starts)
        out = pa.table([band, ids, np.repeat(n, n), np.repeat(digest, n), np.repeat(least, n)], names=["band", "id", "n", "ids", "least"])
        yield from out.to_batches(max_chunksize=1 << 16)

    return dealt.mapInArrow(shared, "band long, id long, n long, ids long, least long")


def group_ends(rows: pa.RecordBatch, place: list[str]) -> list[int]:
    """Where each group of neighbouring rows with the same ``place`` ends."""
    changes = np.zeros(rows.num_rows - 1, bool)
    for name in place:
        column = rows.column(name).to_numpy(zero_copy_only=False)
        changes |= column[1:] != column[:-1]
    return [*(np.flatnonzero(changes) + 1).tolist(), rows.num_rows]


def group_links(rows: pa.RecordBatch, ends: list[int], threshold: float) -> pa.RecordBatch:
    """Links of the groups that end at ``ends``; rows of a group are in the order of their ids."""
    values, stops = unpacked(rows.column("shingles"))
    stops = [0, *stops.tolist()]
    low, high, deal = (rows.column(name).to_numpy() for name in ("low", "high", "deal"))
    a: list[int] = []  # the smallest of what is connected
    b: list[int] = []
    start = 0
    for end in ends:
        bodies = [values[stops[i] : stops[i + 1]] for i in range(start, end)]
        if low[start] == high[start]:
            named, found = range(start, end), connected(bodies, None, threshold)
        else:
            mine = deal[start:end] == low[start]
            named = [*(np.flatnonzero(mine) + start).tolist(), *(np.flatnonzero(~mine) + start).tolist()]
            count = int(mine.sum())
            bodies = [bodies[i - start] for i in named]
            found = connected(bodies[:count], bodies[count:], threshold)
        for numbers in found:
            least, *others = sorted(named[i] for i in numbers)
            a += [least] * len(others)
            b += others
        start = end
    ids = rows.column("id")
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links ``a``, ``b`` lead to; nodes without a link are left out.

    Every round takes the smallest root among a node's neighbours and then the root
    of that root, until nothing changes; rounds are stored.  Nodes with very many
    links are spread over tasks.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    degree = cut_lineage(both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("root")))
    roots = degree.select(F.col("a").alias("node"), "root")
    while True:
        known = roots.join(degree.select(F.col("a").alias("node"), "n"), "node").withColumnRenamed("node", "b")
        seen = join_hot_keys(both, known, "b", "n", [F.col("a")]).groupBy("a").agg(F.min("root").alias("other"))
        nearer = cut_lineage(
            roots.join(seen, roots["node"] == seen["a"]).select("node", F.col("root").alias("before"), F.least("root", "other").alias("root"))
        )
        # roots of many nodes: one row each, looked up by a join that may be hot
        times = nearer.groupBy("root").agg(F.count("*").alias("n"))
        above = nearer.select(F.col("node").alias("root"), F.col("root").alias("top")).join(times, "root")
        jumped = join_hot_keys(nearer, above, "root", "n", [F.col("node")])
        roots = cut_lineage(jumped.select("node", "before", F.least("root", "top").alias("root")))
        if roots.where("root <> before").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")


def near_duplicate_groups(
    chunks: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS, threshold: float = SIMILARITY
) -> DataFrame:
    """``id_col`` and ``group``, the smallest id of the chunks that near copies connect with it.

    Texts without a word are copies of nothing: their group is their id.  Repeated
    ids and NULL ids come out as often as they went in; a group without any id is NULL.
    """
    signed = chunks.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), signed_shingles(text_col, words).alias("set")
    ).select("id", "row", "set.shingles", "set.bands")
    digests = (F.xxhash64("shingles").alias("h"), F.xxhash64(F.lit(1), "shingles").alias("g"))
    key = F.when(F.col("shingles").isNotNull(), F.struct(*digests)).alias("key")
    # what needs the shingles is made where they are; later steps read the narrow columns
    rows = cut_lineage(signed.select("id", "row", key, "shingles", "bands"))
    narrow = cut_lineage(rows.select("id", "row", "key"))
    keyed = narrow.where("key IS NOT NULL").select("id", "key")
    sets = cut_lineage(
        narrow.where("key IS NOT NULL").groupBy("key")
        .agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("row").alias("set"))
    )
    named_once = sets.select(F.col("set").alias("id"))
    banded = cut_lineage(rows.select(F.col("row").alias("id"), "bands").join(named_once, "id", "left_semi"))
    links = cut_lineage(similar_links(banded, rows.select(F.col("row").alias("id"), "shingles"), threshold))
    roots = smallest_reachable(links)
    rooted = cut_lineage(
        sets.select("key", "least", "n", "set").join(broadcast_if_small(roots, roots.count(), 24), F.col("set") == F.col("node"), "left")
        .select("key", "least", "n", F.coalesce("root", "set").alias("root"))
    )
    labels = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("group"), F.count("*").alias("sets")))
    named = cut_lineage(join_hot_keys(rooted, labels, "root", "sets", [F.col("key")]).select("key", "n", "group"))
    found = join_hot_keys(keyed, named, "key", "n", [F.xxhash64("id")])
    alone = narrow.where("key IS NULL").select("id", F.col("id").alias("group"))
    return found.select("id", "group").unionAll(alone).withColumnRenamed("id", id_col)
