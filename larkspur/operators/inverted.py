"""A stored inverted index: BM25 search that reads only the postings of the query's terms.

Documents are numbered in segments of consecutive rows, inside a segment in the
order of their items.  Postings are cut by term and segment into blocks of
``BLOCK`` documents: offsets coded as differences, term frequencies, lengths, and
for each block its greatest frequency and least length, which bound the score
that any of its documents can get.  Files are partitioned by a hash of the term
and sorted by term.

A search reads the partitions of its terms, sends the blocks of a segment to one
task and scores there, rare terms first.  Once the terms that are left cannot
lift a new document into the best k, only documents seen so far are followed, and
blocks without such a document are skipped undecoded.  The result is exact.

Changes add segments; removed documents are listed with their terms, so document
counts and lengths stay exact, and are left out when scoring.  ``compact``
writes everything anew.  A segment's postings of one term are bounded, so a term
that every document has is spread over all segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions import text as tx
from larkspur.operators import topk
from larkspur.operators.skew import broadcast_if_small
from larkspur.operators.windows import top_k
from larkspur.session import cut_lineage
from larkspur.sources.versions import Versions

# The published BM25 constants.
BM25_K1, BM25_B = 1.2, 0.75

BUCKETS = 128  # partitions of the postings, by term
BLOCK = 128  # documents of a block
SEGMENT_DOCS, SEGMENT_POSTINGS = 8_192, 4_000_000  # a segment ends at either
RUN_TOKENS, RUN_BLOCKS = 500_000, 20_000  # tokens coded, or blocks and documents' terms given back, at a time
FEW_TERMS = 500  # up to so many terms are named in the scan's filter

_POSTINGS = (
    "bucket int, term string, segment long, base int, n int, most int, least int, offsets binary, counts binary, lengths binary"
)


class Segment:
    """Documents gathered in a task until they make a segment; their tokens are held as numbers.

    ``close`` orders the documents by their items and counts; what is read afterwards
    is arrays over all postings, in the order of terms and documents.
    """

    def __init__(self, items: Iterable = (), lengths: Iterable[int] = (), tokens: Iterable[list[str]] = ()):
        self.items: list = []
        self.names: dict[str, int] = {}
        self.postings = 0
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        items = list(items)
        if items:
            self.add(items, np.array(lengths, np.int64), pa.array(tokens, pa.list_(pa.string())).flatten())
            self.close()

    def add(self, items: list, lengths: np.ndarray, tokens: pa.Array) -> None:
        """More documents with their lengths and, one after the other, their tokens."""
        coded = tokens.dictionary_encode()
        place = np.fromiter((self.names.setdefault(t, len(self.names)) for t in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        self.codes.append(place[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.empty(0, np.int32))
        self.items += items
        self.sizes.append(lengths)
        self.postings += len(tokens)

    def full(self) -> bool:
        return len(self.items) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def close(self) -> None:
        n = max(len(self.items), 1)
        order = sorted(range(len(self.items)), key=lambda i: (self.items[i] is None, self.items[i]))
        sizes = np.concatenate(self.sizes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cells = np.concatenate(self.codes).astype(np.int64)
        self.codes = []
        cells *= n
        cells += np.repeat(rank, sizes)
        cells.sort()
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, np.int64)
        self.counts = np.diff(starts, append=len(cells)).astype(np.uint32)
        cells = cells[starts]
        self.code, self.doc = (cells // n).astype(np.int32), (cells % n).astype(np.uint16)
        self.items = [self.items[i] for i in order]
        self.lengths = sizes[order].astype(np.uint32)
        self.terms = pa.array(list(self.names), pa.string())

    def documents(self) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
        """(first, end, terms, counts, offsets) of runs of documents: the terms of each and how often it has them."""
        order = np.argsort(self.doc, kind="stable")
        ends = np.searchsorted(self.doc, np.arange(len(self.items) + 1), sorter=order)
        first = 0
        while first < len(self.items):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + RUN_TOKENS, "right")) - 1)
            own = order[ends[first]:ends[end]]
            yield first, end, self.terms.take(pa.array(self.code[own])), self.counts[own], ends[first:end + 1] - ends[first]
            first = end

    def block_columns(self) -> Iterator[dict[str, pa.Array]]:
        """Columns term, base, n, most, least, offsets, counts, lengths of runs of blocks, in the order of terms and documents."""
        if not len(self.code):
            return
        at = np.arange(len(self.code))
        new = np.r_[True, self.code[1:] != self.code[:-1]]
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
        for i in range(0, len(starts), RUN_BLOCKS):
            own = starts[i:i + RUN_BLOCKS]
            end = starts[i + RUN_BLOCKS] if i + RUN_BLOCKS < len(starts) else len(self.code)
            run, first = slice(own[0], end), own - own[0]
            edges = np.r_[first, end - own[0]]
            docs, counts = self.doc[run], self.counts[run]
            lengths = self.lengths[docs]
            offsets = np.diff(docs, prepend=docs[:1])
            offsets[first] = 0
            yield {
                "term": self.terms.take(pa.array(self.code[own])), "base": pa.array(docs[first], pa.int32()),
                "n": pa.array(np.diff(edges), pa.int32()), "most": pa.array(np.maximum.reduceat(counts, first), pa.int32()),
                "least": pa.array(np.minimum.reduceat(lengths, first), pa.int32()), "offsets": _cut(offsets, edges),
                "counts": _cut(counts, edges), "lengths": _cut(lengths, edges),
            }

    def blocks(self) -> Iterator[tuple]:
        """(term, base, n, most, least, offsets, counts, lengths) of each block."""
        for columns in self.block_columns():
            yield from zip(*(c.to_pylist() for c in columns.values()))


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of runs of values as binary values."""
    values = np.ascontiguousarray(values)
    places = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(places), pa.py_buffer(values)])


def impact(counts, lengths, mean: float):
    return counts * (BM25_K1 + 1) / (counts + BM25_K1 * (1 - BM25_B + BM25_B * lengths / mean))


class SegmentPostings:
    """Blocks of the asked terms in one segment; ``decoded`` counts the blocks that were read."""

    def __init__(self, rows: dict[str, list], mean: float, removed: np.ndarray):
        self.mean, self.decoded = mean, 0
        self.rows, self.by_term = rows, {}
        terms = np.array(rows["term"], object)
        edges = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1], True]) if len(terms) else np.zeros(1, np.int64)
        base, n = np.array(rows["base"], np.int64), np.array(rows["n"], np.int64)
        high = impact(np.array(rows["most"], float), np.array(rows["least"], float), mean)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            order = a + np.argsort(base[a:b], kind="stable")
            self.by_term[terms[a]] = (order, base[order], high[order], n[order])
        lasts = [rows["base"][order[-1]] + int(np.frombuffer(rows["offsets"][order[-1]], np.uint16).sum(dtype=np.int64)) for order, *_rest in self.by_term.values()]
        self.size = max([*lasts, *removed.tolist()], default=-1) + 1
        self.removed = removed
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        if row not in self.held:
            self.decoded += 1
            docs = self.rows["base"][row] + np.cumsum(np.frombuffer(self.rows["offsets"][row], np.uint16), dtype=np.int64)
            counts = np.frombuffer(self.rows["counts"][row], np.uint32).astype(float)
            lengths = np.frombuffer(self.rows["lengths"][row], np.uint32).astype(float)
            self.held[row] = docs, impact(counts, lengths, self.mean)
        return self.held[row]

    def term(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of all blocks of a term, decoded together."""
        if term not in self.whole:
            order, base, _high, n = self.by_term[term]
            self.decoded += len(order)

            def joined(name: str, kind) -> np.ndarray:
                return np.frombuffer(b"".join([self.rows[name][row] for row in order.tolist()]), kind)

            steps = np.cumsum(joined("offsets", np.uint16), dtype=np.int64)
            starts = np.r_[0, np.cumsum(n)[:-1]]
            docs = steps + np.repeat(base - steps[starts], n)  # a block's first offset is 0
            self.whole[term] = docs, impact(joined("counts", np.uint32).astype(float), joined("lengths", np.uint32).astype(float), self.mean)
        return self.whole[term]

    def best(self, terms: list[str], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and rounded scores of the best ``k`` documents, ties by offset."""
        asked = sorted(((w, t) for t, w in zip(terms, weights) if t in self.by_term), reverse=True)
        bounds = np.array([w * self.by_term[t][2].max() for w, t in asked])
        rest = np.r_[np.cumsum(bounds[::-1])[::-1], 0.0]  # what the terms from each on can add
        total = np.zeros(self.size)
        edge, slack = 0.0, 2 * 10.0 ** -topk.SCORE_DIGITS  # scores that round alike tie
        for i, (weight, term) in enumerate(asked):
            rows, base, high, _n = self.by_term[term]
            if rest[i] < edge - slack:  # no new document can reach the k-th
                open_docs = np.flatnonzero(total + rest[i] >= edge - slack)
                ends = np.r_[base[1:], self.size]
                first = np.searchsorted(open_docs, base)
                held = np.searchsorted(open_docs, ends) > first
                for row in rows[held].tolist():
                    docs, part = self.block(row)
                    seen = total[docs] > 0
                    total[docs[seen]] += weight * part[seen]
            else:
                docs, part = self.term(term)
                total[docs] += weight * part
            total[self.removed] = 0.0
            if rest[i + 1] < total.max(initial=0.0):  # otherwise no score is an edge yet that could be missed
                positive = total[total > 0]
                if len(positive) >= k:
                    edge = np.partition(positive, len(positive) - k)[len(positive) - k]
        docs = np.flatnonzero(total)
        scores = np.round(total[docs], topk.SCORE_DIGITS)
        order = np.lexsort((docs, -scores))[:k]
        return docs[order], scores[order]


class InvertedIndex:
    """An index under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)
        commits = self.versions.commits()
        base = max((i for i, c in enumerate(commits) if c.get("base")), default=0)
        self.last = commits[-1]["number"] if commits else -1
        self.commits = commits[base:]

    # writing

    def add(self, rows: DataFrame, item: str, text: str) -> InvertedIndex:
        """Index more rows; NULL texts are left out.  Items must not be in the index yet."""
        return self._commit(self._written(rows, item, text))

    def remove(self, items: DataFrame, item: str) -> InvertedIndex:
        """Take items out; those that are not held change nothing."""
        return self._commit({"removed": self._leaving(items, item)})

    def apply(self, changes: DataFrame, item: str, text: str, op: str = "op") -> InvertedIndex:
        """One commit from change rows, one per item: ``delete`` takes it out, others replace or add it."""
        leaving = self._leaving(changes, item)
        return self._commit({"removed": leaving, **self._written(changes.where(F.col(op) != "delete"), item, text)})

    def compact(self) -> InvertedIndex:
        """Write the documents that are left as one commit, from their stored tokens."""
        docs = self.documents().select("item", F.flatten(F.transform(
            F.arrays_zip("terms", "counts"), lambda z: F.array_repeat(z["terms"], z["counts"])
        )).alias("tokens"))
        return self._commit({"base": True, **self._packed(docs)})

    def _commit(self, record: dict) -> InvertedIndex:
        self.versions.add(self.last, **record)
        return InvertedIndex(self.spark, self.versions.root)

    def _written(self, rows: DataFrame, item: str, text: str) -> dict:
        return self._packed(rows.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), tx.tokens(text).alias("tokens")))

    def _packed(self, rows: DataFrame) -> dict:
        kind = rows.schema["item"].dataType.simpleString()
        posting = ", ".join(part.replace(" ", ": ", 1) for part in _POSTINGS.split(", "))
        out = T._parse_datatype_string(
            f"segment long, doc int, item {kind}, length int, terms array<string>, counts array<int>, posting struct<{posting}>"
        )
        arrow = to_arrow_schema(out)

        def closed(one: Segment, number: int) -> Iterator[pa.RecordBatch]:
            one.close()
            for first, end, terms, counts, offsets in one.documents():
                places = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * (end - first), pa.int64()), pa.array(range(first, end), pa.int32()),
                        pa.array(one.items[first:end], arrow.field("item").type), pa.array(one.lengths[first:end], pa.int32()),
                        pa.ListArray.from_arrays(places, terms, type=arrow.field("terms").type),
                        pa.ListArray.from_arrays(places, pa.array(counts, pa.int32()), type=arrow.field("counts").type),
                        pa.nulls(end - first, arrow.field("posting").type),
                    ],
                    schema=arrow,
                )
            for columns in one.block_columns():
                yield _posting_batch(columns, number, arrow)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, number = Segment(), None
            for batch in batches:
                tokens, ids = batch.column("tokens"), batch.column("id")
                sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(sizes)]
                start = 0
                while start < batch.num_rows:
                    filled = int(np.searchsorted(ends, ends[start] + SEGMENT_POSTINGS - one.postings))  # the row that fills it included
                    run = max(start + 1, int(np.searchsorted(ends, ends[start] + RUN_TOKENS, "right")) - 1)
                    stop = min(batch.num_rows, max(filled, start + 1), run, start + SEGMENT_DOCS - len(one.items))
                    number = ids[start].as_py() if number is None else number
                    own = slice(start, stop)
                    one.add(batch.column("item").slice(start, stop - start).to_pylist(), sizes[own], tokens.slice(start, stop - start).flatten())
                    start = stop
                    if one.full():
                        yield from closed(one, number)
                        one, number = Segment(), None
            if one.items:
                yield from closed(one, number)

        numbered = rows.withColumn("id", F.monotonically_increasing_id())
        staged = cut_lineage(numbered.mapInArrow(pack, out))
        docs, postings = self.versions.folder(), self.versions.folder()
        documents = staged.where("posting IS NULL").drop("posting")
        documents.write.parquet(docs)
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        blocks = staged.where("posting IS NOT NULL").select("posting.*").withColumn("bucket", bucket)
        blocks.repartition("bucket", F.pmod("segment", F.lit(16))).sortWithinPartitions("bucket", "term", "segment").write.partitionBy(
            "bucket"
        ).parquet(postings)
        stats = self.spark.read.parquet(docs).agg(F.count("*"), F.sum("length")).first()
        return {"docs": docs, "postings": postings, "documents": stats[0], "length": stats[1] or 0}

    def _leaving(self, items: DataFrame, item: str) -> str | None:
        held = self.documents()
        if held is None:
            return None
        wanted = cut_lineage(items.select(F.col(item).alias("_item")).distinct())
        path = self.versions.folder()
        held.join(broadcast_if_small(wanted, wanted.count(), 64), F.col("item") == F.col("_item"), "left_semi").select(
            "part", "segment", "doc", "length", "terms"
        ).write.parquet(path)
        return path

    # reading

    def _all(self, kind: str) -> DataFrame | None:
        """The tables of all commits with the commit that they are ``part`` of."""
        out = None
        for commit in self.commits:
            if commit.get(kind):
                reader = self.spark.read.schema(_POSTINGS) if kind == "postings" else self.spark.read
                one = reader.parquet(commit[kind])
                if kind != "removed":
                    one = one.withColumn("part", F.lit(commit["number"]))
                out = one if out is None else out.unionByName(one)
        return out

    def documents(self) -> DataFrame | None:
        """``part``, ``segment``, ``doc``, ``item``, ``length``, ``terms`` and ``counts`` of the documents held."""
        docs, removed = self._all("docs"), self._all("removed")
        if docs is None or removed is None:
            return docs
        gone = removed.select("part", "segment", "doc")
        return docs.join(broadcast_if_small(gone, removed.count(), 24), ["part", "segment", "doc"], "left_anti")

    def postings(self, vocabulary: DataFrame) -> DataFrame | None:
        """Blocks of the terms in ``vocabulary`` (term, stored): other partitions are not read."""
        blocks = self._all("postings")
        if blocks is None:
            return None
        found = vocabulary.agg(
            F.collect_set(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).alias("buckets"), F.count("*").alias("n"),
            F.sum(F.octet_length("term") + 48).alias("bytes"),
        ).first()
        blocks = blocks.where(F.col("bucket").isin(found["buckets"]))
        if found["n"] <= FEW_TERMS:
            return blocks.where(F.col("term").isin([r["term"] for r in vocabulary.collect()]))
        return blocks.join(broadcast_if_small(vocabulary, 1, found["bytes"] or 0), "term", "left_semi")

    def statistics(self, vocabulary: DataFrame, blocks: DataFrame | None = None) -> tuple[DataFrame, int, float]:
        """``term`` and ``df`` of the vocabulary (stored), the number of documents and their mean length.

        ``blocks`` are the postings of the vocabulary, where they are at hand.
        """
        documents, length = (sum(c.get(name, 0) for c in self.commits) for name in ("documents", "length"))
        blocks, removed = self.postings(vocabulary) if blocks is None else blocks, self._all("removed")
        counted = blocks.select("term", F.col("n").cast("bigint").alias("n")) if blocks is not None else None
        if counted is None:
            return self.spark.createDataFrame([], "term string, df long"), 0, 1.0
        if removed is not None:
            gone = removed.agg(F.count("*"), F.sum("length")).first()
            documents, length = documents - gone[0], length - (gone[1] or 0)
            own = removed.select(F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi")
            counted = counted.unionAll(own.select("term", F.lit(-1).cast("bigint").alias("n")))
        df = cut_lineage(counted.groupBy("term").agg(F.sum("n").alias("df")))
        return df, documents, (length / documents if documents else 1.0) or 1.0

    def holders(self, vocabulary: DataFrame, item: str) -> DataFrame:
        """``term`` and ``item`` of the documents that have a term of the vocabulary (stored)."""
        docs, blocks = self.documents(), self.postings(vocabulary)
        if blocks is None:
            return self.spark.createDataFrame([], f"term string, {item} long")

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [np.cumsum(np.frombuffer(o, np.uint16), dtype=np.int64) for o in batch.column("offsets").to_pylist()]
                n = np.array([len(r) for r in rows], np.int64)
                at = pa.array(np.repeat(np.arange(len(rows)), n))
                doc = np.concatenate(rows) + np.repeat(batch.column("base").to_numpy(), n) if rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("term").take(at), batch.column("part").take(at), batch.column("segment").take(at), pa.array(doc, pa.int32())],
                    ["term", "_part", "_segment", "_doc"],
                )

        found = blocks.select("term", "part", "segment", "base", "offsets").mapInArrow(
            decoded, "term string, _part int, _segment long, _doc int"
        )
        held = docs.select(F.col("part").alias("_part"), F.col("segment").alias("_segment"), F.col("doc").alias("_doc"), F.col("item").alias(item))
        return found.join(held, ["_part", "_segment", "_doc"]).select("term", item)

    def search(
        self, queries: DataFrame, k: int, item: str = "doc_id", query_key: str = "query_id", query_text: str = "query_text"
    ) -> DataFrame:
        """BM25 top-k: (query, item, score, rank); ties go to the smaller item.

        Queries of any number: blocks of them that fit ``topk.BLOCK_BYTES`` are
        sent to the tasks one after the other.
        """
        asked = queries.select(query_key, F.array_distinct(tx.tokens(query_text)).alias("_terms"))
        terms = cut_lineage(asked.select(query_key, F.explode("_terms").alias("term")))
        vocabulary = cut_lineage(terms.select("term").distinct())
        postings = self.postings(vocabulary)
        df, documents, mean = self.statistics(vocabulary, postings)
        weight = F.log1p((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        size = df.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
        pairs = F.sort_array(F.collect_list(F.struct("term", weight.alias("weight"))))
        weighted = cut_lineage(
            terms.join(broadcast_if_small(df.where("df > 0"), 1, size), "term").groupBy(query_key).agg(pairs.alias("_pairs"))
        )
        docs = self.documents()
        kind = docs.schema["item"].dataType if docs is not None else T.LongType()
        bytes_ = weighted.agg(F.sum(F.aggregate("_pairs", F.lit(64), lambda n, p: n + F.octet_length(p["term"]) + 64))).first()[0] or 0
        blocks = max(1, -(-bytes_ // topk.BLOCK_BYTES))
        found = None
        for number in range(blocks):
            own = weighted.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == number) if blocks > 1 else weighted
            hits = self._scored(own.collect(), postings, query_key, weighted.schema[query_key], k, mean)
            if hits is not None:
                found = hits if found is None else found.unionAll(hits)
        if found is None:
            empty = T.StructType([
                queries.schema[query_key], T.StructField(item, kind), T.StructField("score", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ])
            return self.spark.createDataFrame([], empty)
        found = cut_lineage(found)
        held = docs.select(F.col("part").alias("_part"), F.col("segment").alias("_segment"), F.col("doc").alias("_doc"), F.col("item").alias(item))
        named = held.join(broadcast_if_small(found, found.count(), 64), ["_part", "_segment", "_doc"])
        return top_k(named.select(query_key, item, "score"), [query_key], [F.col("score").desc(), F.col(item)], k)

    def _scored(
        self, rows: list, blocks: DataFrame | None, query_key: str, key_field: T.StructField, k: int, mean: float
    ) -> DataFrame | None:
        if blocks is None or not rows:
            return None
        shared = self.spark.sparkContext.broadcast(
            [(r[query_key], [p["term"] for p in r["_pairs"]], [p["weight"] for p in r["_pairs"]]) for r in rows]
        )
        out = T.StructType([
            key_field, T.StructField("_part", T.IntegerType()), T.StructField("_segment", T.LongType()),
            T.StructField("_doc", T.IntegerType()), T.StructField("score", T.DoubleType()),
        ])
        arrow = to_arrow_schema(out)

        def best(key, blocks: pa.Table, gone: pa.Table) -> pa.Table:
            part, segment = (v.as_py() for v in key)
            keys, docs, scores = [], [], []
            if blocks.num_rows:
                table = blocks.sort_by("term")
                one = SegmentPostings(
                    {name: table.column(name).to_pylist() for name in ("term", "base", "n", "most", "least", "offsets", "counts", "lengths")},
                    mean, np.array(gone.column("doc").to_pylist(), np.int64),
                )
                for query, terms, weights in shared.value:
                    found, own = one.best(terms, weights, k)
                    keys += [query] * len(found)
                    docs += found.tolist()
                    scores += own.tolist()
            return pa.table(
                [
                    pa.array(keys, arrow.field(0).type), pa.array([part] * len(keys), pa.int32()),
                    pa.array([segment] * len(keys), pa.int64()), pa.array(docs, pa.int32()), pa.array(scores, pa.float64()),
                ],
                schema=arrow,
            )

        removed = self._all("removed")
        if removed is None:
            removed = self.spark.createDataFrame([], "part int, segment long, doc int")
        # the postings are small, scoring them is not: as many tasks as there are segments, however few bytes they have
        cores = self.spark.sparkContext.defaultParallelism
        documents = sum(c.get("documents", 0) for c in self.commits)
        tasks = max(4 * cores, min(-(-documents // SEGMENT_DOCS), topk.MOST_TASKS))
        left = blocks.select("part", "segment", "term", "base", "n", "most", "least", "offsets", "counts", "lengths")
        left = left.repartition(tasks, "part", "segment")
        right = removed.select("part", "segment", "doc").repartition(tasks, "part", "segment")
        return left.groupBy("part", "segment").cogroup(right.groupBy("part", "segment")).applyInArrow(best, out)


def _posting_batch(columns: dict[str, pa.Array], number: int, arrow: pa.Schema) -> pa.RecordBatch:
    kind = arrow.field("posting").type
    n = len(columns["term"])
    held = {**columns, "bucket": pa.nulls(n, pa.int32()), "segment": pa.array(np.full(n, number, np.int64))}
    fields = [kind.field(i) for i in range(kind.num_fields)]
    postings = pa.StructArray.from_arrays([held[f.name] for f in fields], fields=fields)
    nothing = [pa.nulls(n, arrow.field(i).type) for i in range(len(arrow) - 1)]
    return pa.RecordBatch.from_arrays([*nothing, postings], schema=arrow)
