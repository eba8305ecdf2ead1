"""Vector, keyword and retrieval-quality queries (L, C6, C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import similarity as sim
from larkspur.operators import compressed as cp
from larkspur.operators import keyword as kw
from larkspur.operators import vectors as vec
from larkspur.operators.inverted import InvertedIndex
from larkspur.queries.registry import query
from larkspur.session import cut_lineage, work_dir
from larkspur.queries.shared import stored_once, tokens
from larkspur.sources import changes

VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
CENTRES = f"""{VECTORS},
parts AS (SELECT label, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM v),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY 1, 2),
centres AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM means GROUP BY 1)"""


def label_queries(t):
    return vec.centroids(t.embeddings, "label", "embedding").select(
        F.col("label").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def pairs(t):
    """Each vector next to its predecessor."""
    doubles = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("b"))
    before = doubles.select((F.col("vec_id") + 1).alias("vec_id"), F.col("b").alias("a"))
    return doubles.join(before, "vec_id")


PAIRS = f"{VECTORS}, p AS (SELECT y.vec_id, x.e AS a, y.e AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)"


@query("l1_embed_text", """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN 256::BIGINT END AS dim, true AS as_copies, true AS whole FROM documents""")
def _(t):
    """Vectors of copies are equal, those of rows without text are NULL, and squares sum up to 1."""
    model = vec.TextEmbedder.fit(t.documents, "text", 256)
    rows = cut_lineage(model.embed(t.documents.select("doc_id", "text"), "text").select(
        "doc_id", F.xxhash64("text").alias("copy"), F.col("text").isNull().alias("none"), "embedding"
    ))
    first = rows.groupBy("copy").agg(F.min(F.struct("doc_id", F.col("embedding"))).alias("f"))
    unit = F.abs(sim.norm(F.col("embedding")) - 1) < 1e-4
    return rows.join(first, "copy").select(
        "doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dim"),
        F.col("embedding").eqNullSafe(F.col("f.embedding")).alias("as_copies"),
        F.when(F.col("none"), F.col("embedding").isNull()).otherwise(unit).alias("whole"),
    )


@query("l2_cosine", f"WITH {PAIRS} SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM p")
def _(t):
    return pairs(t).select("vec_id", F.round(sim.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("l3_dot", f"WITH {PAIRS} SELECT vec_id, round(list_inner_product(a, b), 6) AS dot FROM p")
def _(t):
    return pairs(t).select("vec_id", F.round(sim.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("l4_normalize", f"""
WITH {PAIRS} SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS dot_of_units, round(a[1] / sqrt(list_inner_product(a, a)), 6) AS first
FROM p""")
def _(t):
    a, b = sim.l2_normalize(F.col("a")), sim.l2_normalize(F.col("b"))
    return pairs(t).select(
        "vec_id", F.round(sim.dot(a, b), 6).alias("dot_of_units"), F.round(F.element_at(a, 1), 6).alias("first")
    )


EXACT = f"""
WITH {CENTRES},
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, e), 9) AS score FROM centres, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


@query("l5_exact_top_k", EXACT)
def _(t):
    hits = vec.search(t.embeddings, label_queries(t), 10)
    return hits.withColumn("score", F.round("score", 6))


@query("l5_dot_top_k", f"""
WITH {CENTRES},
s AS (SELECT query_id, vec_id, round(list_inner_product(q, e), 9) AS score FROM centres, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def _(t):
    hits = vec.search(t.embeddings, label_queries(t), 10, metric="dot")
    return hits.withColumn("score", F.round("score", 6))


def stored_cells(t):
    return vec.build_cell_index(t.embeddings, "vec_id", "embedding").write(work_dir(t.spark, "cells"))


@query("l6_cell_search_recall")
def _(t):
    """Approximate hits next to the exact ones; recall per query when a quarter of the cells is read."""
    asked, index = label_queries(t), stored_cells(t)
    found = vec.search_cells(index, asked, 10, nprobe=max(len(index.centres) // 4, 1))
    return vec.recall_at_k(vec.search(t.embeddings, asked, 10), found, "query_id", "vec_id")


@query("l6_all_cells", EXACT)
def _(t):
    """The stored layout read whole gives the exact answer."""
    hits = vec.search_cells(stored_cells(t), label_queries(t), 10, nprobe=None)
    return hits.withColumn("score", F.round("score", 6))


def compressed_hits(t):
    index = cp.build(t.embeddings, "vec_id", "embedding", work_dir(t.spark, "codes"))
    return index, cp.search(index, label_queries(t), 10, nprobe=max(3 * len(index.centres) // 4, 1))


@query("l6_compressed_search")
def _(t):
    """Hits found through codes, with their exact scores."""
    return compressed_hits(t)[1].withColumn("score", F.round("score", 6))


@query("l6_compressed_recall", "SELECT CAST(label AS BIGINT) AS query_id, true AS enough, 16::BIGINT AS read_bytes, 256::BIGINT AS vector_bytes FROM embeddings GROUP BY 1")
def _(t):
    """Whether the mean recall over all queries is 0.9 or more, and the bytes that a probe reads of a vector."""
    index, found = compressed_hits(t)
    recall = vec.recall_at_k(vec.search(t.embeddings, label_queries(t), 10), found, "query_id", "vec_id")
    mean = cut_lineage(recall.agg(F.avg("recall").alias("mean")))
    read, whole = index.bytes_per_vector()
    return recall.crossJoin(F.broadcast(mean)).select(
        "query_id", (F.col("mean") >= 0.9).alias("enough"), F.lit(read).alias("read_bytes"), F.lit(whole).alias("vector_bytes")
    )


@query("l7_filtered_search", f"""
WITH {CENTRES},
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, e), 9) AS score FROM centres, v
      WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def _(t):
    english = t.documents.where(F.col("lang") == "en").select(F.col("doc_id").alias("vec_id"))
    corpus = t.embeddings.join(english, "vec_id", "left_semi")
    return vec.search(corpus, label_queries(t), 5).withColumn("score", F.round("score", 6))


@query("l8_k_sweep", f"""
WITH {CENTRES},
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(q, e), 9) AS score FROM centres, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(k AS BIGINT) AS k, round(avg(CASE WHEN label = query_id THEN 1.0 ELSE 0.0 END), 6) AS same_label
FROM r, (VALUES (3), (5), (10)) ks(k) WHERE rank <= k GROUP BY 1, 2""")
def _(t):
    hits = vec.search(t.embeddings, label_queries(t), 10)
    swept = vec.sweep_k(hits, [3, 5, 10]).join(t.embeddings.select("vec_id", "label"), "vec_id")
    same = F.avg(F.when(F.col("label") == F.col("query_id"), 1.0).otherwise(0.0))
    return swept.groupBy("query_id", "k").agg(F.round(same, 6).alias("same_label"))


@query("c6_lookup_join", f"""
WITH {VECTORS},
s AS (SELECT a.vec_id AS q, b.vec_id AS i, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s)
SELECT q AS vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rank) AS matches FROM r WHERE rank <= 3 GROUP BY 1""")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding")
    out = vec.lookup_join(rows, "vec_id", "embedding", t.embeddings.withColumnRenamed("vec_id", "item"), "item", "embedding", 3)
    return out.select("vec_id", F.array_join(F.col("matches").cast("array<string>"), ",").alias("matches"))


BM25 = f"""d AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens('text')})) AS term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def benchmark_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def document_index(t) -> InvertedIndex:
    """The full-text index of the documents: built once per session and table, then read."""
    path = stored_once(
        t, "documents", "text-index", lambda root: InvertedIndex(t.spark, root).add(t.documents, "doc_id", "text")
    )
    return InvertedIndex(t.spark, path)


def keyword_hits(t, k):
    return document_index(t).search(benchmark_queries(t), k)


@query("l9_keyword_search", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def _(t):
    return keyword_hits(t, 10).withColumn("score", F.round("score", 6))


@query("l10_hybrid_search", f"""
WITH {BM25}, {VECTORS},
ds AS (SELECT b.item_id AS query_id, x.vec_id AS doc_id, round(list_cosine_similarity(y.e, x.e), 9) AS score
  FROM benchmark b JOIN v y ON y.vec_id = b.item_id, v x),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS keyword_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM dr WHERE rank <= 50) a FULL JOIN (SELECT * FROM bmr WHERE rank <= 50) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, dense_rank, keyword_rank, score, rank FROM r WHERE rank <= 10""")
def _(t):
    items = t.benchmark.select(F.col("item_id").alias("query_id"))
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    corpus = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    dense = vec.search(corpus, items.join(own, "query_id"), 50, item="doc_id")
    return kw.fuse_ranks(dense, keyword_hits(t, 50), "query_id", "doc_id", 10)


RERANK = f"""{BM25},
qt AS (SELECT item_id AS query_id, {tokens('text')} AS t FROM benchmark),
pr AS (SELECT h.query_id, h.doc_id, h.rank AS rank_before, qt.t AS q, d.t AS p FROM bmr h JOIN qt ON qt.query_id = h.query_id JOIN d ON d.doc_id = h.doc_id WHERE h.rank <= 50),
g AS (SELECT *, len(list_distinct(q)) AS nq, len(list_distinct(p)) AS np, len(list_intersect(list_distinct(q), list_distinct(p))) AS s,
  list_distinct([q[i] || ' ' || q[i + 1] FOR i IN range(1, len(q))]) AS q2, list_distinct([p[i] || ' ' || p[i + 1] FOR i IN range(1, len(p))]) AS p2 FROM pr),
sc AS (SELECT query_id, doc_id, rank_before, round(2.0::DOUBLE * s / (nq + np) + 0.5::DOUBLE * coalesce(len(list_intersect(q2, p2)) / nullif(len(q2), 0), 0), 9) AS rerank_score FROM g),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank_before) AS rank_after FROM sc)"""


def reranked(t, n):
    return kw.rerank(
        keyword_hits(t, 50), benchmark_queries(t), t.documents, "query_id", "query_text", "doc_id", "text", n
    )


@query("l11_rerank", f"WITH {RERANK} SELECT query_id, doc_id, rerank_score, rank_after FROM rr WHERE rank_after <= 5")
def _(t):
    return reranked(t, 5).select("query_id", "doc_id", "rerank_score", "rank_after")


@query("l12_rank_change", f"""
WITH {RERANK} SELECT query_id, doc_id, rank_before, rank_after, rank_before - rank_after AS moved_up FROM rr WHERE rank_after <= 50""")
def _(t):
    return reranked(t, 50).select("query_id", "doc_id", "rank_before", "rank_after", "moved_up")


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold_pairs(t):
    """Documents that contain a benchmark passage are its relevant documents."""
    found = kw.indexed_documents_containing(document_index(t), t.documents, t.benchmark)
    return found.withColumnRenamed("item_id", "query_id")


@query("c11_relevance_labels", f"""
WITH {GOLD}, {BM25} SELECT query_id, doc_id, rank FROM bmr JOIN gold USING (query_id, doc_id) WHERE rank <= 10""")
def _(t):
    return keyword_hits(t, 10).join(gold_pairs(t), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rank")


METRICS = f"""{GOLD}, {BM25},
w AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (WHERE rank <= 3) AS found, min(rank) AS first_rank FROM bmr JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(found, 0) / 3.0::DOUBLE AS precision, coalesce(found, 0) / relevant AS recall,
  coalesce(1.0::DOUBLE / first_rank, 0) AS reciprocal_rank FROM w LEFT JOIN h USING (query_id))"""


@query("l13_retrieval_metrics", f"""
WITH {METRICS} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM m""")
def _(t):
    out = kw.retrieval_metrics(keyword_hits(t, 10), gold_pairs(t), "query_id", "doc_id", 3)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


@query("l14_diagnosis", f"""
WITH {METRICS}, a AS (SELECT avg(precision) AS p, avg(recall) AS r, avg(reciprocal_rank) AS m FROM m),
l AS (SELECT 'precision' AS metric, p AS value FROM a UNION ALL SELECT 'recall', r FROM a UNION ALL SELECT 'mrr', m FROM a)
SELECT metric, round(value, 6) AS value, CASE WHEN value < 0.9 THEN CASE metric WHEN 'precision' THEN 'noisy or too broad chunks'
  WHEN 'recall' THEN 'chunks too small or coverage gaps' ELSE 'poor ranking of top results' END END AS cause,
  CASE WHEN value < 0.9 THEN CASE metric WHEN 'precision' THEN 'better filtering, reranking, tighter chunks'
  WHEN 'recall' THEN 'adjust chunk size, improve ingestion, align embeddings' ELSE 'tune ranking, rerank' END END AS action FROM l""")
def _(t):
    metrics = kw.retrieval_metrics(keyword_hits(t, 10), gold_pairs(t), "query_id", "doc_id", 3)
    return kw.diagnose(kw.mean_metrics(metrics), 0.9).withColumn("value", F.round("value", 6))


@query("l15_sync_status", """
SELECT (SELECT count(*) FROM documents) AS source_rows,
  (SELECT count(*) FROM documents WHERE lang <> 'es') AS index_rows, (SELECT count(*) FROM documents WHERE lang = 'es') AS missing,
  (SELECT count(*) FROM documents WHERE lang = 'de') AS stale, CAST(0 AS BIGINT) AS extra""")
def _(t):
    source = t.documents.select("doc_id", "text", "lang")
    stale = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    index = source.where(F.col("lang") != "es").withColumn("text", stale)
    return changes.sync_status(source, index, ["doc_id"], ["text"])


@query("l16_vector_upsert", """
SELECT vec_id, label, version FROM (
  SELECT vec_id, CAST(CASE WHEN label = 1 THEN 99 ELSE label END AS BIGINT) AS label, CAST(CASE WHEN label = 1 THEN 2 ELSE 1 END AS BIGINT) AS version FROM embeddings WHERE label <> 2
  UNION ALL SELECT vec_id + 1000000, 99, 2 FROM embeddings WHERE label = 3)""")
def _(t):
    index = t.embeddings.withColumn("version", F.lit(1))
    changed = index.where(F.col("label") == 1).withColumn("label", F.lit(99)).withColumn("version", F.lit(2))
    added = index.where(F.col("label") == 3).withColumn("vec_id", F.col("vec_id") + 1_000_000)
    added = added.withColumn("label", F.lit(99)).withColumn("version", F.lit(2))
    merged = changes.upsert(index, changed.unionByName(added), ["vec_id"], "version")
    gone = index.where(F.col("label") == 2)
    return changes.delete_keys(merged, gone, ["vec_id"]).select("vec_id", "label", "version")


@query("l17_storage_cost", """
SELECT count(*) AS vectors, CAST(dim AS BIGINT) AS dim, CAST(count(*) * dim * 4 AS BIGINT) AS bytes
FROM documents, (VALUES (64), (384), (1024)) d(dim) GROUP BY dim""")
def _(t):
    return vec.storage_cost(t.documents, [64, 384, 1024])
