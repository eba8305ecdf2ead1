"""Streaming queries (I, A15): each runs its stream to the end and reads the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import documents as dc
from larkspur.operators import telemetry as tm
from larkspur.operators.vectors import TextEmbedder
from larkspur.queries.enrichment import INTENTS, MOOD, NEGATIVE, POSITIVE, hits
from larkspur.queries.documents import BROKEN
from larkspur.queries.governance import LEXICON
from larkspur.queries.registry import query
from larkspur.queries.shared import REQUESTS, tokens, words
from larkspur.session import work_dir
from larkspur.sources import changes, files
from larkspur.streaming import index as ix
from larkspur.streaming import ingest as ig
from larkspur.streaming import requests as rq
from larkspur.streaming.changelog import ChangeLog, kept_short


def stream_of(t, name: str):
    return files.table_stream(t.spark, t.path(name), t[name].schema)


GOOD, BAD = f"FROM pages WHERE NOT ({BROKEN})", f"FROM pages WHERE {BROKEN}"


@query("a15_declared_graph", f"""
SELECT dataset, n, CAST(ids AS BIGINT) AS ids FROM (SELECT 'bronze' AS dataset, count(*) AS n, sum(page_id) AS ids FROM pages UNION ALL SELECT 'parsed', count(*), sum(page_id) FROM pages
UNION ALL SELECT 'quarantine', count(*), sum(page_id) {BAD} UNION ALL SELECT 'text', count(*), sum(page_id) {GOOD}
UNION ALL SELECT 'chunks', count(*), sum(page_id) {GOOD})""")
def _(t):
    """Rows and a sum of ids of every dataset; chunks by the documents that they cover."""
    datasets = ig.document_graph(t.pages)
    datasets["chunks"] = datasets["chunks"].select(F.col("source_doc").cast("bigint").alias("page_id")).distinct()
    counted = [
        rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.sum("page_id").alias("ids"))
        for name, rows in datasets.items()
    ]
    return reduce(DataFrame.union, counted)


@query("i1_page_stream_to_chunks", f"""
SELECT page_id, true AS numbered, true AS within, true AS covered, true AS as_batch {GOOD}""")
def _(t):
    """Per document: chunks numbered from 0, none over the size, the text covered from end to end, and the stream equal to the batch."""
    out, state = work_dir(t.spark, "pages"), work_dir(t.spark, "pages-state")
    ig.run_document_stream(stream_of(t, "pages"), out, state, size=900, overlap=150).awaitTermination()
    batch = ig.document_graph(t.pages, size=900, overlap=150)

    def per_document(chunks):
        row = F.struct("chunk_index", "content")
        return chunks.groupBy(F.col("source_doc").cast("bigint").alias("page_id")).agg(F.sort_array(F.collect_list(row)).alias("c"))

    text = F.trim("doc_text")
    inside = F.forall("c", lambda x: F.contains(text, x["content"]))
    ends = F.startswith(text, F.get("c", F.lit(0))["content"]) & F.endswith(text, F.element_at("c", -1)["content"])
    enough = F.aggregate("c", F.lit(0), lambda n, x: n + F.length(x["content"])) >= F.length(F.regexp_replace(text, r"\s+", ""))
    streamed, direct = per_document(t.spark.read.parquet(f"{out}/chunks")), per_document(batch["chunks"])
    joined = streamed.join(direct.select("page_id", F.col("c").alias("b")), "page_id", "full_outer").join(
        batch["text"].select("page_id", "doc_text"), "page_id", "left"
    )
    return joined.select(
        "page_id",
        F.forall(F.transform("c", lambda x, i: x["chunk_index"] == i), lambda x: x).alias("numbered"),
        F.forall("c", lambda x: (F.length(x["content"]) > 0) & (F.length(x["content"]) <= 900)).alias("within"),
        (inside & ends & enough).alias("covered"),
        F.coalesce(F.col("b") == F.col("c"), F.lit(False)).alias("as_batch"),
    )


@query("i1_stream_chunk_rows")
def _(t):
    """The chunks that the stream wrote, as digests."""
    out, state = work_dir(t.spark, "pages"), work_dir(t.spark, "pages-state")
    ig.run_document_stream(stream_of(t, "pages"), out, state, size=900, overlap=150).awaitTermination()
    chunks = t.spark.read.parquet(f"{out}/chunks")
    return chunks.select("chunk_id", "source_doc", "chunk_index", F.md5("content").alias("digest"))


@query("i2_fan_out", f"""
SELECT CASE WHEN {BROKEN} THEN 'quarantine' ELSE 'clean' END AS route, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM pages GROUP BY 1""")
def _(t):
    """Pages routed by the errors of their parse."""
    out, state = work_dir(t.spark, "routes"), work_dir(t.spark, "routes-state")
    parsed = dc.parse_pages(stream_of(t, "pages").select("page_id", "html"))
    ig.fan_out(parsed, out, state, F.get("parsed.error_status", F.lit(0)).isNull()).awaitTermination()
    return t.spark.read.parquet(out).groupBy(F.col("route").cast("string").alias("route")).agg(
        F.count("*").alias("n"), F.sum("page_id").alias("ids")
    )


@query("i3_triggered_sync", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    """Two triggered runs over the same state: the second run adds nothing."""
    log = ChangeLog(work_dir(t.spark, "sync"), ("doc_id",))
    state = work_dir(t.spark, "sync-state")
    for _run in range(2):
        rows = stream_of(t, "documents").select("doc_id", "lang")
        ig.start(rows, state, lambda batch, batch_id: log.append(batch, batch_id)).awaitTermination()
    return log.current(t.spark).groupBy("lang").agg(F.count("*").alias("n"))


@query("i4_index_maintenance", """
SELECT d.doc_id, 256::BIGINT AS dim FROM (SELECT doc_id::BIGINT AS doc_id FROM documents WHERE lang <> 'es') d""")
def _(t):
    """A first load, then a change batch that removes one language and edits another; the log is compacted."""
    old = t.documents.select("doc_id", "text")
    german = F.col("lang") == "de"
    new = t.documents.where(F.col("lang") != "es").select(
        "doc_id", F.when(german, F.concat("text", F.lit(" neu"))).otherwise(F.col("text")).alias("text")
    )
    model = TextEmbedder.fit(old, "text", 256)
    log = ChangeLog(work_dir(t.spark, "index"), ("doc_id",))
    first = old.select("doc_id", "text", F.lit("insert").alias("op"), F.lit(0).alias("seq"))
    ix.apply_changes(log, first, 0, model, "doc_id", "text", "seq")
    feed = changes.diff_snapshots(old, new, ["doc_id"], ["text"]).join(new, "doc_id", "left")
    ix.apply_changes(log, feed.withColumn("seq", F.lit(1)), 1, model, "doc_id", "text", "seq")
    log = kept_short(log, t.spark, work_dir(t.spark, "index-compact"), most_batches=1)
    return log.current(t.spark).select("doc_id", F.size("embedding").cast("bigint").alias("dim"))


LIMITED = f"""
WITH {REQUESTS}, r AS (SELECT *, row_number() OVER w AS c, sum(total_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS tk FROM requests
  WINDOW w AS (PARTITION BY topic, date_trunc('hour', ts) ORDER BY ts, request_id))"""


@query("i5_rate_limit", LIMITED + """
SELECT request_id, CAST(CASE WHEN c > 3 OR tk > 200 THEN 429 ELSE 200 END AS BIGINT) AS response_code FROM r""")
def _(t):
    requests = tm.requests_from_events(t.events)
    out = rq.rate_limit(requests, ["topic"], "ts", "request_id", calls=3, tokens=200, unit="HOUR")
    return out.select("request_id", "response_code")


@query("i5_rate_limit_stream", f"""
WITH {REQUESTS} SELECT topic, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  greatest(count(*) - 3, 0) AS refused FROM requests GROUP BY 1, 2""")
def _(t):
    log = ChangeLog(work_dir(t.spark, "limits"), ("window_start", "topic"))
    stream = tm.requests_from_events(stream_of(t, "events"))
    rq.run_limit_stream(stream, log, work_dir(t.spark, "limits-work"), ["topic"], "ts", 3, "1 hour")
    return log.current(t.spark).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).select(
        "topic", "window_start", "calls", "tokens", "refused"
    )


@query("i6_daily_guard_counts", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS rule, count(*) AS hits FROM events GROUP BY 1, 2""")
def _(t):
    log = ChangeLog(work_dir(t.spark, "guard"), ("day", "rule"))
    rq.run_daily_counts(stream_of(t, "events"), log, work_dir(t.spark, "guard-work"), "ts", F.col("event_type"))
    return log.current(t.spark)


@query("i8_metrics_upsert", f"""
WITH {REQUESTS} SELECT status, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency FROM requests GROUP BY 1""")
def _(t):
    log = ChangeLog(work_dir(t.spark, "metrics"), ("request_id",), "ts")
    stream = tm.requests_from_events(stream_of(t, "events"))
    rq.run_metrics_upsert(stream, log, work_dir(t.spark, "metrics-work"), "ts")
    return log.current(t.spark).groupBy("status").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency"))


SUMMARY_WORDS = 30
TOPICS = {"Legal": INTENTS["legal"], "German": INTENTS["german"], "Romance": INTENTS["romance"]}
CONTRACT = f"""WITH {REQUESTS},
tx AS (SELECT conv_id AS event_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1),
j AS (SELECT r.*, q, a, {tokens('q')} AS qt, {tokens('a')} AS answer_tokens FROM requests r JOIN tx USING (event_id) WHERE q IS NOT NULL),
s AS (SELECT *, {hits(INTENTS['legal'], 'qt')} AS s0, {hits(INTENTS['german'], 'qt')} AS s1, {hits(INTENTS['romance'], 'qt')} AS s2,
  {hits(POSITIVE, 'qt')} AS pos, {hits(NEGATIVE, 'qt')} AS neg, list_distinct(qt) AS qd, list_distinct(answer_tokens) AS ad FROM j),
m AS (SELECT request_id, ts, a AS answer, q AS question, latency_ms, len({words('q')}) AS input_tokens, coalesce(len({words('a')}), 0) AS output_tokens, status, user_feedback,
  CASE WHEN a IS NOT NULL THEN len(list_intersect(qd, ad)) / nullif(len(qd), 0) END AS relevance, len(list_intersect(ad, qd)) / nullif(len(ad), 0) AS grounded,
  CASE WHEN a IS NULL THEN NULL WHEN {hits(LEXICON, 'answer_tokens')} > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety,
  CASE WHEN greatest(s0, s1, s2) = 0 THEN 'Other' WHEN s0 = greatest(s0, s1, s2) THEN 'Legal' WHEN s1 = greatest(s0, s1, s2) THEN 'German' ELSE 'Romance' END AS topic,
  {MOOD} AS sentiment FROM s)"""


def contract(t):
    rows = tm.with_texts(tm.requests_from_events(t.events).drop("groundedness", "total_tokens", "topic"), t.conversations)
    return tm.request_metrics(rows, TOPICS, POSITIVE, NEGATIVE, LEXICON, summary_words=SUMMARY_WORDS)


@query("p4_request_metrics", CONTRACT + """
SELECT request_id, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS ts, md5(question) AS user_question, md5(answer) AS agent_response, true AS summary_fits, latency_ms, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, status, user_feedback,
  round(relevance, 6) AS relevance, round(grounded, 6) AS groundedness, safety, topic, sentiment FROM m""")
def _(t):
    """All columns of the contract, texts as digests; a summary has words of its answer only, and few."""
    words = tx.words("answer_summary")
    fits = F.coalesce(
        (F.size(words) <= SUMMARY_WORDS) & (F.size(F.array_except(words, tx.words("agent_response"))) == 0),
        F.col("agent_response").isNull() & F.col("answer_summary").isNull(),
    )
    return contract(t).select(
        "request_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.md5("user_question").alias("user_question"),
        F.md5("agent_response").alias("agent_response"), fits.alias("summary_fits"),
        "latency_ms", "input_tokens", "output_tokens", "total_tokens", "status", "user_feedback",
        F.round("relevance", 6).alias("relevance"), F.round("groundedness", 6).alias("groundedness"), "safety",
        "topic", "sentiment",
    )


@query("p13_curate_failures", CONTRACT + """,
known AS (SELECT text AS question FROM benchmark), fresh AS (SELECT DISTINCT question FROM m WHERE user_feedback = 'down' OR grounded < 0.85)
SELECT md5(question) AS digest, CAST(1 AS BIGINT) AS version FROM known UNION ALL
SELECT md5(question), 2 FROM fresh WHERE question NOT IN (SELECT question FROM known)""")
def _(t):
    dataset = t.benchmark.select(F.col("text").alias("question"), F.lit(1).alias("version"))
    out = tm.curate_failures(contract(t), dataset)
    return out.select(F.md5("question").alias("digest"), "version")
