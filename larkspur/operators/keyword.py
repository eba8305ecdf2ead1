"""Keyword search (BM25), rank fusion, reranking and relevance metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions import text as tx
from larkspur.operators import topk
from larkspur.operators.inverted import BM25_B, BM25_K1, InvertedIndex
from larkspur.operators.skew import broadcast_if_small, join_hot_keys
from larkspur.operators.windows import top_k
from larkspur.session import cut_lineage

# Fixed value: the published rank-fusion constant.
FUSION_K = 60
MAX_HYBRID_RESULTS = 200


@dataclass(frozen=True)
class Bm25Scorer:
    """Scores record batches (id, tokens) against queries as a term-weight matrix."""

    terms: list[str]
    weights: np.ndarray  # (terms, queries): idf where the query has the term
    mean_length: float

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
        vocabulary = pa.array(self.terms, pa.string())
        lists = batch.column(1)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        size = len(self.terms)
        rows = max(topk.CELLS_PER_STEP // max(size, self.weights.shape[1]), 1)
        for start in range(0, len(lengths), rows):
            step = slice(start, min(start + rows, len(lengths)))
            own = lengths[step]
            part = codes[ends[step.start] - own[0] : ends[step.stop - 1]]
            owner = np.repeat(np.arange(len(own)), own)
            hit = part >= 0
            present, column = np.unique(part[hit], return_inverse=True)
            cells = owner[hit] * len(present) + column
            tf = np.bincount(cells, minlength=len(own) * len(present)).reshape(len(own), len(present)).astype(float)
            norm = BM25_K1 * (1 - BM25_B + BM25_B * own / self.mean_length)
            scores = (tf * (BM25_K1 + 1) / (tf + norm[:, None])) @ self.weights[present]
            yield step, np.where(scores > 0, scores, -np.inf)


def text_index(df: DataFrame, item: str, text: str) -> DataFrame:
    """The keyword index: (item, tokens).  Store it once to search it many times."""
    return df.where(F.col(text).isNotNull()).select(item, tx.tokens(text).alias("tokens"))


def weight_blocks(rows: list) -> list[range]:
    """Runs of query rows whose term-by-query weight matrix stays within the block size."""
    blocks, start, terms = [], 0, set()
    for i, r in enumerate(rows):
        grown = terms.union(r["_terms"])
        if i > start and 8 * len(grown) * (i - start + 1) > topk.BLOCK_BYTES:
            blocks.append(range(start, i))
            start, grown = i, set(r["_terms"])
        terms = grown
    return [*blocks, range(start, len(rows))]


EVERY_DOCUMENT = ""  # no token is empty, so this marks the row that counts all documents


def term_statistics(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Documents per term of the vocabulary, and the document count with total length, in one pass.

    Only the distinct query terms of a document leave the row, and counts
    combine on the map side, so a term that every document has costs no more.
    ``vocabulary`` (term) must be stored; it is broadcast if its measured size
    allows.
    """
    size = vocabulary.agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + 48).alias("bytes")).first()
    marks = index.sparkSession.createDataFrame([(EVERY_DOCUMENT,)], "term string")
    wanted = vocabulary.unionAll(marks)
    wanted = broadcast_if_small(wanted, 1, size["bytes"] or 0)
    own = F.array_append(F.array_distinct("tokens"), F.lit(EVERY_DOCUMENT))
    found = index.select(F.size("tokens").alias("_n"), F.explode(own).alias("term")).join(wanted, "term")
    length = F.sum(F.when(F.col("term") == EVERY_DOCUMENT, F.col("_n")))
    return found.groupBy("term").agg(F.count("*").alias("df"), length.alias("length"))


def weighted_queries(index: DataFrame, asked: DataFrame, query_key: str) -> tuple[DataFrame, float]:
    """Queries with the weight of each of their terms, and the mean document length.

    The terms of all queries are counted in one pass over the index, whatever
    the number of queries.
    """
    terms = asked.select(query_key, F.explode("_terms").alias("term"))
    vocabulary = cut_lineage(terms.select("term").distinct())
    counted = cut_lineage(term_statistics(index, vocabulary))
    every = counted.where(F.col("term") == EVERY_DOCUMENT).first()
    documents, mean_length = (every["df"], every["length"] / every["df"]) if every else (0, 1.0)
    df = F.coalesce("df", F.lit(0))
    weight = F.log1p((F.lit(documents) - df + 0.5) / (df + 0.5))
    sizes = counted.agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + 64).alias("bytes")).first()
    joined = terms.join(broadcast_if_small(counted.select("term", "df"), 1, sizes["bytes"] or 0), "term", "left")
    pairs = F.sort_array(F.collect_list(F.struct("term", weight.alias("weight"))))
    weighted = joined.groupBy(query_key).agg(pairs.alias("_pairs"))
    return weighted.select(
        query_key, F.col("_pairs.term").alias("_terms"), F.col("_pairs.weight").alias("_weights")
    ), mean_length or 1.0


def keyword_search(
    index: DataFrame, queries: DataFrame, k: int, item: str = "doc_id", query_key: str = "query_id",
    query_text: str = "query_text",
) -> DataFrame:
    """BM25 top-k: (query, item, score, rank).

    Two linear passes over the index and no shuffle of postings while the
    queries fit one block: one counts documents per query term
    (pre-aggregated), one scores documents in place.
    """
    asked = queries.select(query_key, F.array_distinct(tx.tokens(query_text)).alias("_terms"))
    weighted, mean_length = weighted_queries(index, asked, query_key)

    def scorers(rows):
        made = []
        for own in weight_blocks(rows):
            terms = sorted({term for q in own for term in rows[q]["_terms"]})
            place = {term: i for i, term in enumerate(terms)}
            weights = np.zeros((len(terms), len(own)))
            for column, q in enumerate(own):
                for term, weight in zip(rows[q]["_terms"], rows[q]["_weights"]):
                    weights[place[term], column] = weight
            made.append((own, Bm25Scorer(terms, weights, mean_length)))
        return made

    size = F.aggregate("_terms", F.lit(64), lambda n, t: n + F.octet_length(t) + 64)
    return topk.scan_top_k(index, item, "tokens", weighted, query_key, size, scorers, k)


def fuse_ranks(dense: DataFrame, sparse: DataFrame, query_key: str, item: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists, at most 200 results."""
    if k > MAX_HYBRID_RESULTS:
        raise ValueError(f"hybrid search returns at most {MAX_HYBRID_RESULTS} results")
    a = dense.select(query_key, item, F.col("rank").alias("dense_rank"))
    b = sparse.select(query_key, item, F.col("rank").alias("keyword_rank"))
    joined = a.join(b, [query_key, item], "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.col(c) + FUSION_K), F.lit(0.0))
    scored = joined.withColumn("score", F.round(part("dense_rank") + part("keyword_rank"), topk.SCORE_DIGITS))
    return top_k(scored, [query_key], [F.col("score").desc(), F.col(item)], k)


def pair_score(query_tokens: Column, passage_tokens: Column) -> Column:
    """Word-set F1 plus half the share of query bigrams found in the passage.

    A bigram occurs when its two tokens stand side by side in the blank-joined
    passage, so the passage's own bigrams are never built.
    """
    q, p = F.array_distinct(query_tokens), F.array_distinct(passage_tokens)
    shared = F.size(F.array_intersect(q, p)).cast("double")
    f1 = F.coalesce(2.0 * shared / F.nullif(F.size(q) + F.size(p), F.lit(0)), F.lit(0.0))
    passage = F.concat(F.lit(" "), F.array_join(passage_tokens, " "), F.lit(" "))
    bigrams = F.array_distinct(tx.ngrams(query_tokens, 2))
    found = tx.let(
        passage, lambda t: F.size(F.filter(bigrams, lambda g: F.contains(t, F.concat(F.lit(" "), g, F.lit(" ")))))
    )
    bonus = F.coalesce(found / F.nullif(F.size(bigrams), F.lit(0)), F.lit(0.0))
    return f1 + 0.5 * bonus


def rerank(
    hits: DataFrame, queries: DataFrame, corpus: DataFrame, query_key: str, query_text: str, item: str, text: str, n: int,
    depth: int = 50, scorer=pair_score,
) -> DataFrame:
    """Rescore the first ``depth`` hits pair by pair and keep the best ``n``.

    ``scorer`` maps two token columns to a score column; a Pandas function fits.
    The hits number at most queries times depth: when that fits, they are
    broadcast and the corpus texts stay where they are.
    """
    asked = queries.select(query_key, F.col(query_text).alias("_qt"))
    size = queries.agg(F.count("*").alias("rows"), F.avg(F.octet_length(query_text)).alias("bytes")).first()
    recalled = (
        hits.where(F.col("rank") <= depth).select(query_key, item, F.col("rank").alias("rank_before")).join(asked, query_key)
    )
    recalled = broadcast_if_small(recalled, size["rows"] * depth, int(size["bytes"] or 0) + 64)
    # texts are split after the join: only recalled passages are
    pairs = corpus.select(item, F.col(text).alias("_pt")).join(recalled, item).select(
        query_key, item, "rank_before", tx.tokens("_qt").alias("_q"), tx.tokens("_pt").alias("_p")
    )
    scored = pairs.withColumn("rerank_score", F.round(scorer(F.col("_q"), F.col("_p")), topk.SCORE_DIGITS)).drop("_q", "_p")
    order = [F.col("rerank_score").desc(), F.col("rank_before")]
    return top_k(scored, [query_key], order, n, "rank_after").withColumn(
        "moved_up", F.col("rank_before") - F.col("rank_after")
    )


SHORT_BYTES = 16 << 20  # passages without an inner word that are looked for together


def documents_containing(
    documents: DataFrame, passages: DataFrame, doc: str = "doc_id", text: str = "text", passage: str = "item_id",
    passage_text: str = "text",
) -> DataFrame:
    """(passage, document) pairs where the document text contains the passage.

    A document that contains a passage holds the passage's inner words as
    whole words.  The inner word that the fewest documents have is the join
    key; only ids go through that join, a key that very many documents have is
    spread, and the text is fetched for surviving pairs, which ``contains``
    checks.  Passages of one or two words have no inner word; blocks of them are
    looked for in every text, one automaton per block.
    """
    held = _with_inner(passages, passage, passage_text, tx.words)
    long = held.select(passage, "_passage", F.explode("_inner").alias("_key"))
    vocabulary = cut_lineage(long.select("_key").distinct())
    size = vocabulary.agg(F.sum(F.octet_length("_key") + 48)).first()[0] or 0
    words = documents.select(doc, F.explode(F.array_distinct(tx.words(text))).alias("_key"))
    known = broadcast_if_small(vocabulary, 1, size)
    holders = cut_lineage(words.join(known, "_key", "left_semi"))
    counts = cut_lineage(holders.groupBy("_key").agg(F.count("*").alias("_docs")))
    rarest = _rarest(long, counts, passage)
    return _checked(documents, held, rarest, holders, doc, text, passage)


def indexed_documents_containing(
    index: InvertedIndex, documents: DataFrame, passages: DataFrame, doc: str = "doc_id", text: str = "text",
    passage: str = "item_id", passage_text: str = "text",
) -> DataFrame:
    """As ``documents_containing``, with the documents' full-text index: only the postings of rare words are read.

    The inner terms of a passage (all but its first and last letter-digit run)
    are terms of every document that contains it.
    """
    held = _with_inner(passages, passage, passage_text, tx.tokens)
    long = held.select(passage, "_passage", F.explode("_inner").alias("_key"))
    df, _documents, _mean = index.statistics(cut_lineage(long.select(F.col("_key").alias("term")).distinct()))
    counts = df.select(F.col("term").alias("_key"), F.col("df").alias("_docs"))
    rarest = cut_lineage(_rarest(long, counts, passage))
    holders = index.holders(cut_lineage(rarest.select(F.col("_key").alias("term")).distinct()), doc).withColumnRenamed("term", "_key")
    return _checked(documents, held, rarest, holders, doc, text, passage)


def _with_inner(passages: DataFrame, passage: str, passage_text: str, words) -> DataFrame:
    inner = F.array_distinct(F.slice(words(passage_text), F.lit(2), F.greatest(F.size(words(passage_text)) - 2, F.lit(0))))
    return cut_lineage(
        passages.where(F.col(passage_text).isNotNull()).select(passage, F.col(passage_text).alias("_passage"), inner.alias("_inner"))
    )


def _rarest(long: DataFrame, counts: DataFrame, passage: str) -> DataFrame:
    """The word of each passage that the fewest documents have; a word that none has is the rarest: its passage is in none."""
    return (
        long.join(counts, "_key", "left").groupBy(passage, "_passage")
        .agg(F.min(F.struct(F.coalesce("_docs", F.lit(0)).alias("_docs"), "_key")).alias("_r"))
        .select(passage, F.col("_r._key").alias("_key"), F.col("_r._docs").alias("_docs")).where("_docs > 0")
    )


def _checked(
    documents: DataFrame, held: DataFrame, rarest: DataFrame, holders: DataFrame, doc: str, text: str, passage: str
) -> DataFrame:
    lists = rarest.groupBy("_key", "_docs").agg(F.collect_set(passage).alias("_ids"))
    pairs = cut_lineage(
        join_hot_keys(holders, lists, "_key", "_docs", [F.col(doc)]).select(doc, F.explode("_ids").alias(passage)).distinct()
        .join(held.select(passage, "_passage"), passage)
    )
    bytes_ = pairs.agg(F.sum(F.octet_length("_passage") + 64)).first()[0] or 0
    checked = documents.select(doc, F.col(text).alias("_text")).join(broadcast_if_small(pairs, 1, bytes_), doc)
    found = checked.where(F.contains("_text", "_passage")).select(passage, doc)
    return found.unionByName(_holding_short(documents, held.where(F.size("_inner") == 0), doc, text, passage)).distinct()


def _holding_short(documents: DataFrame, short: DataFrame, doc: str, text: str, passage: str) -> DataFrame:
    """Each block of short passages is looked for in all texts, in one scan."""
    short = cut_lineage(short.select(passage, "_passage"))
    out = T.StructType([short.schema[passage], documents.schema[doc]])
    found = short.sparkSession.createDataFrame([], out)
    size = short.agg(F.sum(F.octet_length("_passage") + 64)).first()[0]
    if not size:
        return found
    blocks = -(-size // SHORT_BYTES)
    for number in range(blocks):
        own = short.where(F.pmod(F.xxhash64("_passage"), F.lit(blocks)) == number)
        ids: dict[str, list] = {}
        for row in own.collect():  # a block: SHORT_BYTES
            ids.setdefault(row["_passage"], []).append(row[passage])
        found = found.unionAll(documents.select(doc, text).mapInArrow(_finder(ids, to_arrow_schema(out)), out))
    return found


def _finder(ids: dict[str, list], schema: pa.Schema):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_text = _matcher(list(ids))
        for batch in batches:
            passages, docs = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for passage in in_text(text) if text is not None else ():
                    passages += ids[passage]
                    docs += [number] * len(ids[passage])
            yield pa.RecordBatch.from_arrays([pa.array(passages, schema.field(0).type), pa.array(docs, schema.field(1).type)], schema=schema)

    return find


def _matcher(passages: list[str]):
    """The passages that a text contains; one pass over the text where an automaton library is installed."""
    empty = [p for p in passages if not p]
    rest = [p for p in passages if p]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {p for p in rest if p in text}.union(empty)
    automaton = ahocorasick.Automaton()
    for p in rest:
        automaton.add_word(p, p)
    if not rest:
        return lambda text: set(empty)
    automaton.make_automaton()
    return lambda text: {p for _end, p in automaton.iter(text)}.union(empty)


def retrieval_metrics(hits: DataFrame, gold: DataFrame, query_key: str, item: str, k: int) -> DataFrame:
    """Per labelled query: precision@k (divided by k), recall@k and reciprocal rank.

    The reciprocal rank looks at the whole ranked list; a query without a
    relevant hit scores 0.
    """
    relevant = gold.select(query_key, item).distinct()
    wanted = relevant.groupBy(query_key).agg(F.count("*").alias("relevant"))
    good = hits.join(relevant, [query_key, item], "left_semi").groupBy(query_key).agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first_rank")
    )
    joined = wanted.join(good, query_key, "left")
    found = F.coalesce(F.col("found"), F.lit(0))
    return joined.select(
        query_key,
        (found / F.lit(float(k))).alias("precision"),
        (found / F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the labelled queries: precision, recall and MRR."""
    return metrics.agg(
        F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"),
    )


# Which metric is low, its likely cause and the action to take.
DIAGNOSIS = {
    "precision": ("noisy or too broad chunks", "better filtering, reranking, tighter chunks"),
    "recall": ("chunks too small or coverage gaps", "adjust chunk size, improve ingestion, align embeddings"),
    "mrr": ("poor ranking of top results", "tune ranking, rerank"),
}


def diagnose(means: DataFrame, floor: float) -> DataFrame:
    """One row per metric with its value; cause and action where it is below the floor."""
    long = means.select(*DIAGNOSIS).unpivot([], list(DIAGNOSIS), "metric", "value")
    low = F.col("value") < floor

    def pick(part: int) -> Column:
        pairs = [F.lit(x) for name, texts in DIAGNOSIS.items() for x in (name, texts[part])]
        return F.when(low, F.create_map(*pairs)[F.col("metric")])

    return long.select("metric", "value", pick(0).alias("cause"), pick(1).alias("action"))
