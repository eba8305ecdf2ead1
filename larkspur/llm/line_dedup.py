"""Incremental line deduplication that document deletions undo.

A line's key is the first 16 bytes of the SHA-256 of the stripped, lower-cased
line.  ``LineIndex`` keeps, in a shared folder,

* references: the distinct keys of every document,
* exact counts: in how many documents a key is, as signed differences per commit,
* one cuckoo filter per shard of keys with the keys of at least ``threshold``
  documents.

An insert or deletion of documents writes its own references and differences.
Only keys whose exact count crosses the threshold are inserted into or deleted
from the filters, of which only the shards concerned are written anew; a filter
that would be too full is rebuilt from the exact counts.  So lines come back when
enough of their documents are deleted.  A commit counts once its record is
written, the last step; what an interrupted job left is never read.

``strip`` drops the lines that are in a filter and verifies those exactly: the
distinct keys that pass are compared with the counts.  Filters of up to
``FILTER_BYTES`` are sent to the tasks with the few keys that passed wrongly, and
texts are read in place.  Beyond it each block of rows sends its distinct keys to
the shards, and the keys that pass and are verified come back to the block's rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.arrow import groups_in, text_slices
from larkspur.llm.cuckoo import FULL, KEY_BYTES, CuckooFilter
from larkspur.operators.skew import broadcast_if_small, join_hot_keys
from larkspur.session import cut_lineage, work_dir

THRESHOLD, LEAST_CHARS = 10, 1
SHARDS = 256  # by the first byte of a key
FILTER_BYTES = 64 << 20
BLOCK_BITS = 12  # rows of a block, as a power of two
BLANKS = b" \t\n\x0b\x0c\r"

_FILTER = "shard int, held long, slots binary, spill array<binary>"
_COMMIT = "number int, base boolean, refs string, removed string, counts string, filters string"


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The key of a lower-cased line; None where it is too short to count."""
    line = line.strip(BLANKS)
    if len(line) < least_chars or (least_chars > 1 and len(line.decode()) < least_chars):
        return None
    return hashlib.sha256(line).digest()[:KEY_BYTES]


def _keys_of(text: str, least_chars: int) -> list[bytes | None]:
    return [line_key(line, least_chars) for line in text.encode().lower().split(b"\n")]  # bytes: only A-Z change


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)


class Filters:
    """The filters of all shards, for lookups inside a task."""

    def __init__(self, rows: list):
        self.by_shard = {row["shard"]: CuckooFilter.read(row["slots"], row["spill"], row["held"]) for row in rows}

    def passing(self, keys: list[bytes]) -> list[bytes]:
        if not keys or not self.by_shard:
            return []
        matrix = _matrix(keys)
        shard = matrix[:, 0]
        out: list[bytes] = []
        for number in np.unique(shard).tolist():
            one = self.by_shard.get(number)
            if one is not None:
                rows = np.flatnonzero(shard == number)
                out += [keys[i] for i in rows[one.contains(matrix[rows])].tolist()]
        return out


class LineIndex:
    """An index of lines under ``root``, a folder that all executors share.

    ``threshold``: documents that make a line a repeated one.  ``least_chars``:
    code points of a key, at least; shorter lines never count.  A document is an
    id: rows that share one, NULL too, are one document.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS):
        self.spark, self.threshold, self.least_chars = spark, threshold, least_chars
        self.root = (root or work_dir(spark, "lines")).rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        self.commits = [row.asDict() for row in self._records().collect()] if known else []  # a row per commit
        self.commits = sorted(self.commits, key=lambda c: c["number"])
        base = max((i for i, c in enumerate(self.commits) if c["base"]), default=0)
        self.next = self.commits[-1]["number"] + 1 if self.commits else 0
        self.commits = self.commits[base:]

    def _records(self) -> DataFrame:
        return self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits/*")

    # what is stored

    def _all(self, kind: str, schema: str | None = None) -> DataFrame | None:
        """The tables of a kind of all commits, with the ``commit`` they are from."""
        out = None
        for commit in self.commits:
            if commit[kind]:
                reader = self.spark.read.schema(schema) if schema else self.spark.read
                part = reader.parquet(commit[kind]).withColumn("commit", F.lit(commit["number"]))
                out = part if out is None else out.unionByName(part)
        return out

    def references(self) -> DataFrame | None:
        """``id`` and ``keys`` of the documents held; an id may have several rows, of different keys."""
        refs, removed = self._all("refs"), self._all("removed")
        if refs is None or removed is None:
            return refs
        gone = removed.groupBy("id").agg(F.max("commit").alias("_gone")).withColumnRenamed("id", "_id")
        gone = broadcast_if_small(gone, removed.count(), 64)
        return refs.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("commit") < F.col("_gone")), "left_anti")

    def counts(self, only: DataFrame | None = None) -> DataFrame:
        """``key`` and ``n``, its documents; of the keys in ``only`` if given."""
        parts = self._all("counts", "key binary, n long")
        if parts is None:
            return self.spark.createDataFrame([], "key binary, n long")
        if only is not None:
            parts = parts.join(only.select("key"), "key", "left_semi")
        return parts.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")

    def repeated(self) -> DataFrame:
        """``key`` and ``n`` of the lines to drop."""
        return self.counts().where(F.col("n") >= self.threshold)

    def filters(self) -> DataFrame:
        """The latest filter of every shard; SHARDS rows at most."""
        rows = self._all("filters", _FILTER)
        if rows is None:
            return self.spark.createDataFrame([], _FILTER)
        latest = rows.groupBy("shard").agg(F.max_by(F.struct("held", "slots", "spill"), "commit").alias("f"))
        return latest.select("shard", "f.held", "f.slots", "f.spill")

    # changes

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents; a known id gets the lines that it did not have.  NULL text has no lines."""
        least_chars = self.least_chars
        id_type = docs.schema[id_col].dataType.simpleString()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, "text"):
                keys = [
                    list(dict.fromkeys(k for k in _keys_of(text or "", least_chars) if k)) for text in batch.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.list_(pa.binary()))], ["id", "keys"])

        batch = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        batch = cut_lineage(batch.mapInArrow(read, f"id {id_type}, keys array<binary>"))
        refs = self._path()
        self._unshared(batch, self.references()).write.parquet(refs)
        added = self.spark.read.schema(batch.schema).parquet(refs)
        return self._commit(refs, None, added.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take documents out again; ids that are not held and NULL texts change nothing."""
        gone = cut_lineage(ids.select(F.col(id_col).alias("id")).distinct())
        held = self.references()
        if held is None:
            return self
        removed = self._path()
        gone.write.parquet(removed)
        gone = broadcast_if_small(gone.withColumnRenamed("id", "_id"), gone.count(), 64)
        lost = held.join(gone, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        return self._commit(
            None, removed, lost.select(F.explode("keys").alias("key")).groupBy("key").agg((-F.count("*")).alias("n"))
        )

    def compact(self) -> LineIndex:
        """Merge all commits into one; the tables before it are no longer read."""
        held = self.references()
        if held is None:
            return self
        refs, counts, filters = self._path(), self._path(), self._path()
        held.drop("commit").write.parquet(refs)
        self.counts().write.parquet(counts)
        keys = self.spark.read.schema("key binary, n long").parquet(counts).where(F.col("n") >= self.threshold)
        self._shards(keys.select(F.lit(1).alias("kind"), "key"), None).write.parquet(filters)
        return self._record(True, refs, None, counts, filters)

    def _path(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _unshared(self, batch: DataFrame, held: DataFrame | None) -> DataFrame:
        """``batch`` without keys that its id has already, in another row or in the index."""
        ids = batch.groupBy("id").agg(F.count("*").alias("rows"))
        if held is not None:
            known = held.select(F.col("id").alias("_known")).distinct()
            ids = ids.join(known, F.col("id").eqNullSafe(F.col("_known")), "left")
        else:
            ids = ids.withColumn("_known", F.lit(None)).where("rows > 1")
        several = cut_lineage(
            ids.where("rows > 1 OR _known IS NOT NULL OR id IS NULL").select("id", "rows", F.lit(True).alias("_several"))
        )
        n = several.count()
        if not n:
            return batch
        named = several.withColumnRenamed("id", "_id")
        if n * 64 <= FILTER_BYTES:
            marked = batch.join(F.broadcast(named.drop("rows")), F.col("id").eqNullSafe(F.col("_id")), "left")
        else:
            every = cut_lineage(batch.groupBy("id").agg(F.count("*").alias("_n")))
            every = every.join(named, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "_n", "_several")
            marked = join_hot_keys(batch, every, "id", "_n", [F.xxhash64("keys")])
        alone = marked.where("_several IS NULL").select("id", "keys")
        pairs = marked.where("_several").select("id", F.explode("keys").alias("key")).distinct()
        if held is not None:
            have = held.join(broadcast_if_small(named, n, 64), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
            have = have.select(F.col("id").alias("_id"), F.explode("keys").alias("_key"))
            pairs = pairs.join(have, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_anti")
        return alone.unionAll(pairs.select("id", F.array("key").alias("keys")))

    def _commit(self, refs: str | None, removed: str | None, differences: DataFrame) -> LineIndex:
        counts, filters = self._path(), self._path()
        differences.write.parquet(counts)
        new = self.spark.read.schema("key binary, n long").parquet(counts)
        if self.commits:
            before = self.counts(new).withColumnRenamed("n", "before")
            new = new.join(before, "key", "left").na.fill(0, ["before"])
        else:
            new = new.withColumn("before", F.lit(0).cast("long"))
        t, after = self.threshold, F.col("n") + F.col("before")
        kind = F.when((F.col("before") < t) & (after >= t), 1).when((F.col("before") >= t) & (after < t), -1)
        crossing = cut_lineage(new.select(kind.alias("kind"), "key").where("kind IS NOT NULL"))
        touched = {row["shard"]: row for row in crossing.groupBy(_shard().alias("shard")).agg(
            F.count_if(F.col("kind") == 1).alias("more"), F.count_if(F.col("kind") == -1).alias("less")
        ).collect()}  # SHARDS rows at most
        present = self.filters().where(F.col("shard").isin(list(touched)))
        sizes = {row["shard"]: row for row in present.select("shard", "held", F.octet_length("slots").alias("bytes")).collect()}
        rebuilt = [
            s for s, row in touched.items()
            if s in sizes and sizes[s]["held"] + row["more"] > sizes[s]["bytes"] // 4 * FULL
        ]
        changes = crossing.where(~_shard().isin(rebuilt))
        if rebuilt:
            whole = new.select("key", (F.col("n") + F.col("before")).alias("n"))
            whole = whole.unionAll(self.counts().join(new, "key", "left_anti").select("key", "n"))
            changes = changes.unionAll(
                whole.where((F.col("n") >= t) & _shard().isin(rebuilt)).select(F.lit(1).alias("kind"), "key")
            )
            present = present.where(~F.col("shard").isin(rebuilt))
        self._shards(changes, present).write.parquet(filters)
        return self._record(False, refs, removed, counts, filters)

    def _record(self, base: bool, refs, removed, counts, filters) -> LineIndex:
        row = [(self.next, base, refs, removed, counts, filters)]
        self.spark.createDataFrame(row, _COMMIT).coalesce(1).write.parquet(f"{self.root}/commits/{self.next:06d}")
        return LineIndex(self.spark, self.root, self.threshold, self.least_chars)

    def _shards(self, changes: DataFrame, present: DataFrame | None) -> DataFrame:
        """New filters: ``present`` ones, or empty ones, after the changes (kind 1: insert, -1: delete)."""
        schema = "shard int, kind int, key binary, held long, slots binary, spill array<binary>"
        nothing = {"held": F.lit(None).cast("long"), "slots": F.lit(None).cast("binary"), "spill": F.lit(None).cast("array<binary>")}
        rows = changes.select(_shard().alias("shard"), F.col("kind").cast("int"), "key", *[c.alias(n) for n, c in nothing.items()])
        if present is not None:
            old = present.select("shard", F.lit(-9).alias("kind"), F.lit(None).cast("binary").alias("key"), "held", "slots", "spill")
            rows = old.unionAll(rows)

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, runs in groups_in(batches, "shard"):
                one, kinds, keys = None, [], []
                for run in runs:  # a shard's keys are 16 bytes each
                    kind = run.column("kind").to_numpy()
                    if kind[0] == -9:
                        one = CuckooFilter.read(
                            run.column("slots")[0].as_py(), run.column("spill")[0].as_py(), run.column("held")[0].as_py()
                        )
                        kind, run = kind[1:], run.slice(1)
                    if len(kind):
                        kinds.append(kind)
                        keys.append(_matrix(run.column("key").to_pylist()))
                kind = np.concatenate(kinds) if kinds else np.empty(0)
                matrix = np.concatenate(keys) if keys else np.empty((0, KEY_BYTES), np.uint8)
                if one is None:
                    one = CuckooFilter.for_keys(2 * int((kind == 1).sum()))
                one.delete(matrix[kind == -1])
                one.insert(matrix[kind == 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()), pa.array([one.held], pa.int64()), pa.array([one.slots.tobytes()], pa.binary()),
                        pa.array([sorted(one.spill)], pa.list_(pa.binary())),
                    ],
                    ["shard", "held", "slots", "spill"],
                )

        rows = self.spark.createDataFrame([], schema).unionAll(rows)
        return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(built, _FILTER)

    # use

    def strip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col``, ``n_lines``, ``n_dropped`` and ``text`` without repeated lines, a row per row of ``docs``.

        Lines are cut at \\n; NULL and empty text are one empty line, which stays
        (``text`` is then empty).  The documents need not be in the index.
        """
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        filters = cut_lineage(self.filters())
        size = filters.agg(
            F.sum(F.octet_length("slots") + F.size("spill") * (2 * KEY_BYTES)).alias("bytes")
        ).first()["bytes"] or 0
        if size <= FILTER_BYTES:
            held = filters.collect()
            wrong = self._wrong(rows, held)
            n = wrong.count()
            if n * 2 * KEY_BYTES <= FILTER_BYTES:
                return self._in_place(rows, held, [row["key"] for row in wrong.collect()], id_col)
        return self._by_block(rows, filters, id_col)

    def _wrong(self, rows: DataFrame, held: list) -> DataFrame:
        """Keys of the texts that pass the filters although they are in too few documents; stored."""
        least_chars = self.least_chars

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters, seen = Filters(held), set()
            for batch in text_slices(batches, "text"):
                keys = {k for text in batch.column("text").to_pylist() for k in _keys_of(text or "", least_chars) if k}
                fresh = [k for k in filters.passing(list(keys)) if k not in seen]
                if len(seen) > 100_000:
                    seen.clear()  # only spares repetitions
                seen.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary())], ["key"])

        candidates = rows.select("text").mapInArrow(passing, "key binary").distinct()
        return cut_lineage(candidates.join(self.repeated(), "key", "left_anti"))

    def _in_place(self, rows: DataFrame, held: list, wrong: list[bytes], id_col: str) -> DataFrame:
        least_chars = self.least_chars

        def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters, exceptions = Filters(held), set(wrong)
            for batch in text_slices(batches, "text"):
                texts = [text or "" for text in batch.column("text").to_pylist()]
                keys = [_keys_of(text, least_chars) for text in texts]
                drop = set(filters.passing(list({k for own in keys for k in own if k}))) - exceptions
                yield _kept(batch.column("id"), texts, keys, drop)

        id_type = rows.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, n_lines long, n_dropped long, text string"
        return rows.mapInArrow(stripped, schema).withColumnRenamed("id", id_col)

    def _by_block(self, rows: DataFrame, filters: DataFrame, id_col: str) -> DataFrame:
        least_chars = self.least_chars
        block = F.shiftrightunsigned(F.monotonically_increasing_id(), BLOCK_BITS)
        rows = cut_lineage(rows.withColumn("block", block))  # numbered once: both passes see the same blocks
        id_type = rows.schema["id"].dataType.simpleString()

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, "text"):
                blocks = batch.column("block").to_pylist()
                pairs = sorted({
                    (b, k) for b, text in zip(blocks, batch.column("text").to_pylist()) for k in _keys_of(text or "", least_chars) if k
                })
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _k in pairs], pa.int64()), pa.array([k for _b, k in pairs], pa.binary())], ["block", "key"]
                )

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _shard_number, runs in groups_in(batches, "part"):
                one = None
                for run in runs:
                    asks = run.column("side").to_numpy() == 1
                    if not asks[0]:
                        one = CuckooFilter.read(
                            run.column("slots")[0].as_py(), run.column("spill")[0].as_py(), run.column("held")[0].as_py()
                        )
                        run = run.slice(1)
                    if one is not None and run.num_rows:
                        found = one.contains(_matrix(run.column("key").to_pylist()))
                        yield run.select(["block", "key"]).filter(pa.array(found))

        pairs = rows.select("block", "text").mapInArrow(keyed, "block long, key binary").distinct()
        salts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS, 1) * 8
        salt = F.pmod(F.xxhash64("block"), F.lit(salts))  # a key is in many blocks, a filter is sent to every salt
        asked = pairs.select(
            (_shard() * salts + salt).alias("part"), F.lit(1).alias("side"), "block", "key",
            F.lit(None).cast("long").alias("held"), F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("array<binary>").alias("spill"),
        )
        sent = filters.select(
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.col("shard").cast("long") * salts + i)).alias("part"),
            F.lit(0).alias("side"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("key"), "held", "slots", "spill",
        )
        candidates = cut_lineage(
            sent.unionAll(asked).repartition("part").sortWithinPartitions("part", "side").mapInArrow(passing, "block long, key binary")
        )
        weights = candidates.groupBy("key").agg(F.count("*").alias("blocks"))
        verified = cut_lineage(weights.join(self.repeated().select("key"), "key"))
        drops = join_hot_keys(candidates, verified, "key", "blocks", [F.col("block")]).select("block", "key")
        everything = drops.select(
            "block", F.lit(0).alias("side"), "key", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("text")
        ).unionAll(rows.select("block", F.lit(1).alias("side"), F.lit(None).cast("binary").alias("key"), "id", "text"))

        def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _block, runs in groups_in(batches, "block"):
                drop: set[bytes] = set()
                for run in runs:
                    asks = run.column("side").to_numpy() == 1
                    drop.update(run.column("key").filter(pa.array(~asks)).to_pylist())
                    for part in text_slices(iter([run.filter(pa.array(asks))]), "text"):
                        texts = [text or "" for text in part.column("text").to_pylist()]
                        yield _kept(part.column("id"), texts, [_keys_of(text, least_chars) for text in texts], drop)

        return (
            everything.repartition("block").sortWithinPartitions("block", "side")
            .mapInArrow(stripped, f"id {id_type}, n_lines long, n_dropped long, text string").withColumnRenamed("id", id_col)
        )


def _shard() -> Column:
    return F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int")


def _kept(ids: pa.Array, texts: list[str], keys: list[list], drop: set[bytes]) -> pa.RecordBatch:
    lines, dropped, kept = [], [], []
    for text, own in zip(texts, keys):
        lines.append(len(own))
        if drop.isdisjoint(own):
            dropped.append(0)
            kept.append(text)
        else:
            stay = [line for line, key in zip(text.split("\n"), own) if key not in drop]
            dropped.append(len(own) - len(stay))
            kept.append("\n".join(stay))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
        ["id", "n_lines", "n_dropped", "text"],
    )
