"""Projections, filters, joins, sets, sorts and scalar functions (B, C, F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import relational as rel
from larkspur.operators import telemetry as tm
from larkspur.operators.windows import top_k
from larkspur.queries.registry import query
from larkspur.queries.shared import REQUESTS, words
from larkspur.sources import changes

# ---- B: projections, filters, routing -------------------------------------


@query("b1_project", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net_price,
       upper(l_returnflag || l_linestatus) AS flags FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net_price"),
        F.upper(F.concat("l_returnflag", "l_linestatus")).alias("flags"),
    )


@query("b2_null_guard", "SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def _(t):
    return t.documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("chars"))


@query("b4_expect_or_drop", """
SELECT doc_id, n_chars FROM documents WHERE length(text) > 0 AND n_chars >= 100""")
def _(t):
    tests = {"non_empty_text": F.length("text") > 0, "long_enough": F.col("n_chars") >= 100}
    kept, _observation = rel.expect_or_drop(t.documents, tests)
    return kept.select("doc_id", "n_chars")


@query("b5_case_bucket", """
SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS bucket,
       count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    price = F.col("o_totalprice")
    bucket = F.when(price < 100000, "small").when(price < 300000, "medium").otherwise("large")
    return t.orders.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("b6_filter_dict", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src0', 'src3')")
def _(t):
    return rel.where_equal(t.documents, {"lang": "en", "source": ["src0", "src3"]}).select("doc_id", "source")


@query("b7_filter_sql", "SELECT doc_id, n_chars FROM documents WHERE source = 'src1' AND n_chars < 2000")
def _(t):
    return rel.where_sql(t.documents, "source = 'src1' AND n_chars < 2000").select("doc_id", "n_chars")


@query("b8_trace_conditions", f"""
WITH {REQUESTS}
SELECT request_id AS trace_id, latency_ms AS execution_time_ms FROM requests
WHERE status = 'OK' AND topic = 'purchase' AND latency_ms >= 5000""")
def _(t):
    traces = tm.traces_from_requests(tm.requests_from_events(t.events))
    found = tm.search_traces(
        traces,
        [("attributes.status", "=", "OK"), ("tags.app", "=", "purchase"), ("attributes.execution_time_ms", ">=", 5000)],
    )
    return found.select("trace_id", "execution_time_ms")


@query("b9_failing_rows", f"""
WITH {REQUESTS}
SELECT request_id, topic, groundedness FROM requests WHERE user_feedback = 'down' OR groundedness < 0.85""")
def _(t):
    return tm.failing(tm.requests_from_events(t.events)).select("request_id", "topic", "groundedness")


# ---- C: joins --------------------------------------------------------------


@query("c1_inner_join", """
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(t.orders, "o_orderkey").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query("c2_star_join", """
SELECT p_brand, CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS n FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def _(t):
    joined = rel.star_join(t.lineitem, [(t.part, "l_partkey", "p_partkey"), (t.supplier, "l_suppkey", "s_suppkey")])
    return joined.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("c3_snowflake_join", """
SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t):
    joined = rel.star_join(
        t.lineitem,
        [
            (t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"),
            (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"),
        ],
    )
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.round(revenue, 2).alias("revenue"))


@query("c4_orphans", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def _(t):
    return rel.orphans(t.documents, t.labels, "doc_id", "doc_id").select("doc_id", "source")


@query("c5_latest_day", f"""
WITH {REQUESTS}
SELECT count(*) AS requests, count(*) FILTER (WHERE status = 'ERROR') AS errors FROM requests
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM requests)""")
def _(t):
    return tm.latest_day(tm.requests_from_events(t.events)).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "ERROR").alias("errors")
    )


@query("c7_enrichment_join", f"""
WITH {REQUESTS}
SELECT request_id, latency_ms, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, lang FROM requests
LEFT JOIN labels l ON event_id = l.doc_id LEFT JOIN documents d ON event_id = d.doc_id""")
def _(t):
    scores = t.labels.withColumnRenamed("doc_id", "event_id")
    features = t.documents.select(F.col("doc_id").alias("event_id"), "lang")
    joined = tm.requests_from_events(t.events).join(scores, "event_id", "left").join(features, "event_id", "left")
    return joined.select("request_id", "latency_ms", "quality", "toxic", "lang")


@query("c8_compare_runs", """
WITH a AS (SELECT lang || '/' || source AS scorer, avg(n_chars) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
b AS (SELECT lang || '/' || source AS scorer, avg(n_chars) AS m FROM documents WHERE doc_id % 2 <> 0 GROUP BY 1)
SELECT scorer, round(a.m, 4) AS v1, round(b.m, 4) AS v2, round(b.m - a.m, 4) AS delta FROM a FULL JOIN b USING (scorer)""")
def _(t):
    """Two runs that share all documents between them, every language and source a scorer."""
    def run(rest: int):
        rows = t.documents.where((F.col("doc_id") % 2 != 0).cast("int") == rest)
        return rows.groupBy(F.concat_ws("/", "lang", "source").alias("scorer")).agg(F.avg("n_chars").alias("mean"))

    out = rel.compare_runs(run(0), run(1))
    return out.select("scorer", *[F.round(c, 4).alias(c) for c in ("v1", "v2", "delta")])


@query("c9_judge_vs_human", """
SELECT doc_id, n_chars >= 1000 AS judge, quality = 1 AS human, (n_chars >= 1000) = (quality = 1) AS agree
FROM labels JOIN documents USING (doc_id)""")
def _(t):
    judge, human = F.col("n_chars") >= 1000, F.col("quality") == 1
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", judge.alias("judge"), human.alias("human"), (judge == human).alias("agree")
    )


@query("c10_reconcile", """
WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, sum(l_quantity) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, coalesce(abs(a.v - b.v) < 1e-6, false) AS agrees
FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    b = joined.groupBy(F.col("o_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return rel.reconcile(a, b, ["k"], "v")


@query("c12_latest_feedback", f"""
WITH {REQUESTS},
feedback AS (SELECT 'req-' || (event_id - event_id % 3) AS request_id, ts, event_id AS feedback_id, event_type AS comment FROM events),
latest AS (SELECT request_id, arg_max(comment, ts) AS comment FROM feedback GROUP BY 1)
SELECT r.request_id, r.status, l.comment FROM requests r LEFT JOIN latest l USING (request_id)""")
def _(t):
    owner = F.col("event_id") - F.col("event_id") % 3
    feedback = t.events.select(
        F.concat(F.lit("req-"), owner.cast("string")).alias("request_id"), "ts", F.col("event_type").alias("comment")
    )
    requests = tm.requests_from_events(t.events).select("request_id", "status")
    return tm.attach_feedback(requests, feedback)


# ---- F: sorts and limits ---------------------------------------------------


@query("f1_order_by_alias", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1 ORDER BY balance DESC""")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("balance")).orderBy(
        F.col("balance").desc()
    )


@query("f2_shortest_documents", "SELECT doc_id, length(text) AS chars FROM documents ORDER BY chars, doc_id LIMIT 10")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("chars")).orderBy("chars", "doc_id").limit(10)


@query("f3_having_top_n", """
SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders
GROUP BY 1 HAVING count(*) > 5 ORDER BY spent DESC, o_custkey LIMIT 20""")
def _(t):
    spent = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    return spent.where(F.col("orders") > 5).orderBy(F.col("spent").desc(), "o_custkey").limit(20)


@query("f4_newest_first", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(t):
    return t.events.orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "event_type")


@query("f5_worst_row", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id)
ORDER BY quality ASC NULLS LAST, doc_id LIMIT 1""")
def _(t):
    scored = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return scored.orderBy(F.col("quality").asc_nulls_last(), "doc_id").limit(1)


@query("f6_ordinal_sort", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1 DESC""")
def _(t):
    return t.spark.sql(
        "SELECT DATE(ts) AS day, event_type, count(*) AS n FROM {events} GROUP BY 1, 2 ORDER BY 1 DESC", events=t.events
    )


# ---- G: set operations -----------------------------------------------------


@query("g1_overlap", """
SELECT count(*) AS shared FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders)""")
def _(t):
    rich = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
    return rel.overlap_size(rich, t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("g2_union_keys", """
SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)""")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


@query("g3_filter_leak", """
SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src0')""")
def _(t):
    returned = rel.where_equal(t.documents, {"lang": "en"})
    return rel.leaked(returned, t.documents.where(F.col("source") != "src0"), "doc_id")


@query("g4_union_sources", """
SELECT 'traces' AS origin, event_id AS id, event_type AS label, CAST(NULL AS VARCHAR) AS text FROM events
UNION ALL SELECT 'expert', doc_id, CAST(quality AS VARCHAR), NULL FROM labels
UNION ALL SELECT 'edge', item_id, NULL, text FROM benchmark""")
def _(t):
    return rel.union_sources(
        {
            "traces": t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("label")),
            "expert": t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label")),
            "edge": t.benchmark.select(F.col("item_id").alias("id"), "text"),
        }
    )


@query("g5_new_rows", """
SELECT DISTINCT md5(text) AS digest FROM conversations WHERE role = 'user'
AND text NOT IN (SELECT text FROM conversations WHERE role = 'assistant')""")
def _(t):
    asked = t.conversations.where(F.col("role") == "user").select("text")
    answered = t.conversations.where(F.col("role") == "assistant").select("text")
    return rel.new_rows(asked, answered, ["text"]).select(F.md5("text").alias("digest"))


# ---- H: scalar functions ---------------------------------------------------


@query("h1_concat", """
SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS a, c_name || ':' || c_nationkey AS b,
       concat_ws('::', c_name, c_mktsegment, c_nationkey) AS c FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", F.concat("c_name", F.lit("-"), "c_mktsegment").alias("a"),
        F.expr("c_name || ':' || c_nationkey").alias("b"),
        F.concat_ws("::", "c_name", "c_mktsegment", "c_nationkey").alias("c"),
    )


@query("h2_string_shapes", """
SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded, left(text, 40) AS preview, length(text) AS chars,
       md5(lower(text)) AS lowered, trim('  ' || lang || ' ') AS trimmed FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"), F.left("text", F.lit(40)).alias("preview"),
        F.length("text").alias("chars"), F.md5(F.lower("text")).alias("lowered"),
        F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("trimmed"),
    )


@query("h3_regexp_replace", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)the ', '', 'g'), '\n{2,}', chr(10), 'g')) AS digest FROM documents""")
def _(t):
    out = F.regexp_replace(F.regexp_replace("text", "(?i)the ", ""), r"\n{2,}", "\n")
    return t.documents.select("doc_id", F.md5(out).alias("digest"))


@query("h4_path_stem", r"""
SELECT page_id, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) AS stem FROM pages""")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1).alias("stem"))


@query("h5_split_item", """
SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS rank, string_split(o_orderpriority, '-')[2] AS label FROM orders""")
def _(t):
    parts = F.split("o_orderpriority", "-")
    return t.orders.select("o_orderkey", parts.getItem(0).alias("rank"), F.get(parts, F.lit(1)).alias("label"))


@query("h6_content_key", "SELECT doc_id, sha256(source || '::' || doc_id) AS chunk_id FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.content_key("source", "doc_id").alias("chunk_id"))


@query("h7_dates", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 14 AS VARCHAR) AS plus, CAST(CAST(o_orderdate AS DATE) - 30 AS VARCHAR) AS minus,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_add(day, 14).alias("plus"), F.date_sub(day, 30).alias("minus"), day.alias("day")
    )


@query("h8_date_trunc", """
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
       CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter, count(*) AS n
FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1, 2""")
def _(t):
    rows = t.orders.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    month, quarter = F.date_trunc("MONTH", "o_orderdate"), F.date_trunc("QUARTER", "o_orderdate")
    return rows.groupBy(month.cast("date").alias("month"), quarter.cast("date").alias("quarter")).agg(
        F.count("*").alias("n")
    )


@query("h9_arithmetic", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (l_orderkey * 13) % 18 AS cycled, l_partkey % 7 AS rest,
       round(l_extendedprice * l_tax, 6) AS tax FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.pmod(F.col("l_orderkey") * 13, F.lit(18)).alias("cycled"),
        (F.col("l_partkey") % 7).alias("rest"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 6).alias("tax"),
    )


@query("h10_cast_coalesce_in", """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unlabelled') AS quality, lang IN ('en', 'de') AS germanic,
       quality IS NULL AS missing, CASE WHEN lang <> 'en' THEN 'foreign' ELSE 'home' END AS side
FROM documents d LEFT JOIN labels USING (doc_id)""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality"),
        F.col("lang").isin("en", "de").alias("germanic"), F.col("quality").isNull().alias("missing"),
        F.when(F.col("lang") != "en", "foreign").otherwise("home").alias("side"),
    )


@query("h11_arrays", """
SELECT vec_id, round(embedding[1], 6) AS first, round(embedding[-1], 6) AS last,
       len([x FOR x IN embedding IF x > 0]) AS positives, round(list_max([x * 2 FOR x IN embedding]), 6) AS doubled_max
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)""")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        "vec_id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"),
        F.size(F.filter(v, lambda x: x > 0)).alias("positives"),
        F.round(F.array_max(F.transform(v, lambda x: x * 2)), 6).alias("doubled_max"),
    )


@query("h12_map_struct", """
SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance, c_name AS from_map FROM customer""")
def _(t):
    made = t.customer.select(
        "c_custkey", F.expr("named_struct('segment', c_mktsegment, 'balance', c_acctbal)").alias("s"),
        F.create_map(F.lit("name"), F.col("c_name")).alias("m"),
    )
    return made.select("c_custkey", "s.segment", "s.balance", F.col("m")["name"].alias("from_map"))


@query("h13_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS parsed, json_extract_string(props, '$.k') AS extracted,
       '{"id":' || event_id || ',"type":"' || event_type || '"}' AS written FROM events""")
def _(t):
    return t.events.select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("parsed"),
        F.get_json_object("props", "$.k").alias("extracted"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("written"),
    )


@query("h14_variant", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS missing
FROM events""")
def _(t):
    parsed = t.events.select("event_id", F.parse_json("props").alias("v"))
    return parsed.selectExpr(
        "event_id", "v:k::bigint AS k", "variant_get(v, '$.missing', 'string') IS NULL AS missing"
    )


@query("h15_text_tests", f"""
SELECT doc_id, len({words('text')}) AS words, contains(text, 'License') AS has_licence,
       md5(replace(text, 'the', 'THE')) AS replaced FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", tx.word_count("text").alias("words"), tx.contains_any("text", ["License"]).alias("has_licence"),
        F.md5(tx.substitute("text", {"the": "THE"})).alias("replaced"),
    )
