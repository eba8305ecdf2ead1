"""Spelling correction against the words of a corpus, by deletion neighbourhoods.

Two words within ``edits`` insertions, deletions and replacements of each other
become equal after at most ``edits`` deletions from each.  The index holds, for
every known word, the hashes of what is left after such deletions; an unknown word
is looked up by its own, an equi-join, and candidates are checked by their edit
distance.  No word is compared with the whole vocabulary.

A long word has very many deletions, so beyond ``LONG`` letters it is indexed by
``edits`` + 1 pieces instead: one of them survives any ``edits`` changes, moved by
at most ``edits`` places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.skew import broadcast_if_small, join_hot_keys
from larkspur.session import cut_lineage

EDITS, LONG = 2, 20
SEEN = 5  # a word that occurs so often is taken as right


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def deletions(word: str, edits: int) -> set[int]:
    """Hashes of the word without up to ``edits`` of its letters."""
    out = set()
    for n in range(min(edits, len(word)) + 1):
        for gone in combinations(range(len(word)), n):
            left, at = [], 0
            for i in gone:
                left.append(word[at:i])
                at = i + 1
            out.add(_key("d", "".join([*left, word[at:]])))
    return out


def _pieces(length: int, edits: int) -> list[tuple[int, int]]:
    cuts = [length * i // (edits + 1) for i in range(edits + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def known_keys(word: str, edits: int) -> set[int]:
    """Keys of a word of the vocabulary."""
    if len(word) <= LONG + edits:  # a word that is longer by a few letters than an unknown one must be found too
        keys = deletions(word, edits)
    else:
        keys = set()
    if len(word) > LONG:
        keys |= {_key("p", len(word), i, word[a:b]) for i, (a, b) in enumerate(_pieces(len(word), edits))}
    return keys


def asked_keys(word: str, edits: int) -> set[int]:
    """Keys that an unknown word is looked up by."""
    if len(word) <= LONG:
        return deletions(word, edits)
    keys = set()
    for length in range(max(len(word) - edits, LONG + 1), len(word) + edits + 1):
        for i, (a, b) in enumerate(_pieces(length, edits)):
            keys |= {_key("p", length, i, word[a + shift:b + shift]) for shift in range(-edits, edits + 1) if a + shift >= 0}
    if len(word) - edits <= LONG:
        keys |= deletions(word, edits)
    return keys


def _keyed(words: DataFrame, keys_of, edits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                found = [sorted(keys_of(word, edits)) for word in part.column(0).to_pylist()]
                at = pa.array([i for i, keys in enumerate(found) for _key_ in keys], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array([k for keys in found for k in keys], pa.int64())], ["word", "key"]
                )

    return words.select("word").mapInArrow(run, "word string, key long")


def vocabulary(texts: DataFrame, text: str, seen: int = SEEN) -> DataFrame:
    """``word`` and ``n`` of the lower-cased words that occur at least ``seen`` times."""
    words = texts.select(F.explode(tx.tokens(text)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


class SpellingIndex:
    """Words with their frequencies and keys, stored under ``root``."""

    def __init__(self, spark, root: str, edits: int = EDITS):
        self.spark, self.root, self.edits = spark, root.rstrip("/"), edits

    def write(self, words: DataFrame) -> SpellingIndex:
        words.select("word", "n").write.mode("overwrite").parquet(f"{self.root}/words")
        _keyed(self.words(), known_keys, self.edits).write.mode("overwrite").parquet(f"{self.root}/keys")
        return self

    def words(self) -> DataFrame:
        return self.spark.read.schema("word string, n long").parquet(f"{self.root}/words")

    def candidates(self, words: DataFrame) -> DataFrame:
        """``word``, ``candidate``, ``edits`` and ``n``: every known word within the edits of each given word."""
        asked = cut_lineage(words.select("word").where("word IS NOT NULL").distinct())
        keys = cut_lineage(_keyed(asked, asked_keys, self.edits))
        held = self.spark.read.schema("word string, key long").parquet(f"{self.root}/keys").withColumnRenamed("word", "candidate")
        # a key that very many known words have (short leftovers) is spread
        times = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("asked")))
        wanted = held.join(broadcast_if_small(times.select("key"), times.count(), 24), "key", "left_semi")
        weights = wanted.groupBy("key").agg(F.count("*").alias("n")).join(times, "key")
        lists = keys.join(cut_lineage(weights), "key").groupBy("key", "n").agg(F.collect_set("word").alias("_words"))
        met = join_hot_keys(wanted, cut_lineage(lists), "key", "n", [F.col("candidate")])
        pairs = met.select(F.explode("_words").alias("word"), "candidate").distinct()
        near = pairs.withColumn("edits", F.levenshtein("word", "candidate", self.edits)).where("edits >= 0")
        return near.join(self.words().withColumnRenamed("word", "candidate"), "candidate").select("word", "candidate", "edits", "n")

    def corrections(self, words: DataFrame) -> DataFrame:
        """``word``, ``correction``, ``edits`` and ``candidates`` (their number) of words that are not known.

        Fewest edits first, then the most frequent word, then the smallest.  Without
        a candidate the correction is NULL.
        """
        unknown = words.select("word").where("word IS NOT NULL").distinct().join(self.words().select("word"), "word", "left_anti")
        unknown = cut_lineage(unknown)
        best = self.candidates(unknown).groupBy("word").agg(
            F.min(F.struct("edits", (-F.col("n")).alias("order"), "candidate")).alias("best"), F.count("*").alias("candidates")
        )
        return unknown.join(best, "word", "left").select(
            "word", F.col("best.candidate").alias("correction"), F.col("best.edits").alias("edits"),
            F.coalesce("candidates", F.lit(0)).alias("candidates"),
        )

    def correct(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` with every unknown word of column ``text`` replaced by its correction; all else stays.

        Words are letter-digit runs; a corrected word is lower-case.  Each distinct
        word is looked up once; the corrections of a text's words come back to it by
        its number.
        """
        rows = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
        used = rows.select("_row", F.explode(F.array_distinct(tx.tokens(text))).alias("word"))
        fixes = cut_lineage(self.corrections(used).where("correction IS NOT NULL").select("word", "correction"))
        size = fixes.agg(F.sum(F.octet_length("word") + F.octet_length("correction") + 64)).first()[0] or 0
        per_row = used.join(broadcast_if_small(fixes, 1, size), "word").groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("word", "correction"))).alias("_fixes")
        )
        # runs of letters and digits, and what stands between them
        pieces = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
        fixed = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at("_fixes", F.lower(p)), p)), "")
        return rows.join(per_row, "_row", "left").withColumn(
            text, F.when(F.col("_fixes").isNull(), F.col(text)).otherwise(fixed)
        ).drop("_row", "_fixes")
