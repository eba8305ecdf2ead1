"""A keyed table in hash buckets: a merge rewrites only the buckets that it changes, a difference reads only those that differ.

Every version is one record that names, for each bucket, the folder of its rows,
their number and a digest of their content.  A merge reads and writes the buckets
of its keys and keeps the others as they are, so its cost follows the
changes and not the table.  Versions become visible by one rename (``Versions``);
until then, and after a crash before it, readers see the version before.

Digests form a tree of two levels: a version's digest combines those of its
buckets.  Equal versions are told by it alone; otherwise only buckets with
different digests are read.

Keys spread over buckets by their hash.  Rows with a NULL key, which may be very
many, are equal to no other and spread by a hash of the whole row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources import changes
from larkspur.sources.versions import Versions

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.versions = spark, Versions(spark, root)
        commits = [c for c in self.versions.commits() if version is None or c["number"] <= version]
        self.record = commits[-1] if commits else None

    # describing

    @property
    def version(self) -> int:
        return self.record["number"] if self.record else -1

    @property
    def digest(self) -> str:
        """The root of the tree: equal for equal content."""
        parts = [f"{b}:{e['digest']}" for b, e in sorted(self.record["entries"].items(), key=lambda p: int(p[0]))]
        return hashlib.sha256(",".join(parts).encode()).hexdigest()

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; other buckets' files are not opened."""
        paths = [e["path"] for b, e in self.record["entries"].items() if buckets is None or int(b) in buckets]
        schema = self.record["schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, rows: DataFrame, keys: list[str], buckets: int) -> Column:
        no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        return F.pmod(F.when(no_key, F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)), F.lit(buckets)).cast("int")

    # writing

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """The first version, or a new one with the same keys and buckets in which equal buckets are kept as they are."""
        if self.record:
            keys, buckets = self.record["keys"], self.record["buckets"]
        marked = rows.withColumn("_bucket", self._bucket(rows, keys, buckets))
        entries = self.record["entries"] if self.record else {}
        found = {str(r["_bucket"]): r["digest"] for r in self._digests(marked, rows.columns).collect()}  # a row per bucket
        same = {b: e for b, e in entries.items() if found.get(b) == e["digest"]}
        changed = [int(b) for b in found if b not in same]
        return self._written(marked.where(F.col("_bucket").isin(changed)), same, rows, keys, buckets)

    def merge(self, updates: DataFrame, order: str) -> KeyedTable:
        """Upsert; of versions of a key the greatest ``order`` wins, see ``changes.upsert``."""
        return self._changed(updates, lambda old, new: changes.upsert(old, new, self.record["keys"], order))

    def delete(self, keys: DataFrame) -> KeyedTable:
        """Take keys out; keys that are not there change nothing."""
        own = self.record["keys"]
        return self._changed(keys.select(*own), lambda old, gone: changes.delete_keys(old, gone, own))

    def _changed(self, rows: DataFrame, apply) -> KeyedTable:
        keys, buckets = self.record["keys"], self.record["buckets"]
        marked = rows.withColumn("_bucket", self._bucket(rows, keys, buckets))
        touched = [r["_bucket"] for r in marked.select("_bucket").distinct().collect()]  # at most the buckets
        old = self.rows(touched)
        new = apply(old, rows)
        kept = {b: e for b, e in self.record["entries"].items() if int(b) not in touched}
        if not touched:
            return self
        return self._written(new.withColumn("_bucket", self._bucket(old, keys, buckets)), kept, old, keys, buckets)

    def _written(self, marked: DataFrame, kept: dict, like: DataFrame, keys: list[str], buckets: int) -> KeyedTable:
        folder = self.versions.folder()
        marked.repartition("_bucket").sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(folder)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        stored = self.spark.read.schema(f"{schema}, _bucket int").parquet(folder)
        entries = dict(kept)
        for r in self._digests(stored, like.columns).collect():
            entries[str(r["_bucket"])] = {"path": f"{folder}/_bucket={r['_bucket']}", "rows": r["rows"], "digest": r["digest"]}
        self.versions.add(self.version, entries=entries, keys=keys, buckets=buckets, schema=schema)
        return KeyedTable(self.spark, self.versions.root)

    def _digests(self, marked: DataFrame, columns: list[str]) -> DataFrame:
        content = F.to_json(F.struct(*sorted(columns)))
        one, two = F.xxhash64(content), F.xxhash64(content, F.lit(1))
        parts = F.concat_ws(
            ":", F.count("*").cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.sum(two.cast("decimal(38,0)")).cast("string")
        )
        return marked.groupBy("_bucket").agg(F.count("*").alias("rows"), parts.alias("digest"))

    # comparing

    def changed_buckets(self, other: KeyedTable) -> list[int]:
        """Buckets whose content differs; the buckets of both tables must be of the same number and keys."""
        if (self.record["keys"], self.record["buckets"]) != (other.record["keys"], other.record["buckets"]):
            raise ValueError("tables with different keys or buckets have no common tree")
        if self.digest == other.digest:
            return []
        a, b = self.record["entries"], other.record["entries"]
        return sorted(int(n) for n in a.keys() | b.keys() if a.get(n, {}).get("digest") != b.get(n, {}).get("digest"))

    def changes_to(self, newer: KeyedTable, content: list[str]) -> DataFrame:
        """Key and ``op`` (insert, update, delete) of the rows that make ``newer`` from this table."""
        buckets = self.changed_buckets(newer)
        return changes.diff_snapshots(self.rows(buckets), newer.rows(buckets), self.record["keys"], content)

    def sync_status(self, index: KeyedTable, content: list[str]) -> DataFrame:
        """Rows here and in the index, and how many are missing, stale or extra there."""
        ops = index.changes_to(self, content).groupBy().agg(
            *[F.count_if(F.col("op") == op).alias(name) for op, name in (("insert", "missing"), ("update", "stale"), ("delete", "extra"))]
        )
        here, there = (sum(e["rows"] for e in t.record["entries"].values()) for t in (self, index))
        return ops.select(
            F.lit(here).cast("long").alias("source_rows"), F.lit(there).cast("long").alias("index_rows"), "missing", "stale", "extra"
        )
