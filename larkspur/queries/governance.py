"""Guardrail, masking and licence queries (N, J2, J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import chunking as ch
from larkspur.operators import guard as gd
from larkspur.queries.registry import query
from larkspur.queries.shared import tokens

MARKERS = ["the of", "de la", "and th"]  # word pairs that occur in the test texts
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
REASON = (
    f"CASE WHEN length({STRIPPED}) < 3 THEN 'too_short' WHEN length({STRIPPED}) > 2000 THEN 'too_long' "
    + " ".join(f"WHEN contains(lower(text), '{m}') THEN 'prompt_injection_marker:{m}'" for m in MARKERS)
    + " ELSE 'ok' END"
)
W = r"[\p{L}\p{N}_"
REDACTED = "text"
for _pattern, _mark in ((W + r".+-]+@" + W + r"-]+\." + W + r".-]+", "[EMAIL]"), (r"\+?\d[\d\s().-]{7,}\d", "[PHONE]")):
    REDACTED = f"regexp_replace({REDACTED}, '{_pattern}', '{_mark}', 'g')"
# The SQL dialect has no Unicode word boundary: mark every non-word character, anchor on the mark, drop the marks.
for _pattern, _mark in ((r"[A-Z]\d{7,8}", "[PASSPORT]"), (r"[A-Z0-9]{6}", "[PNR]")):
    _marked = f"regexp_replace({REDACTED}, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g')"
    REDACTED = f"replace(regexp_replace({_marked}, '(^|\\x01){_pattern}([^\\p{{L}}\\p{{N}}_]|$)', '\\1{_mark}\\2', 'g'), chr(1), '')"


@query("n1_validate_input", f"SELECT conv_id, turn, {REASON} AS reason FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", gd.validate_input("text", MARKERS).alias("reason"))


@query("n1_validate_documents", """
SELECT doc_id, CASE WHEN length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 2000 THEN 'too_long' ELSE 'ok' END AS reason FROM documents""")
def _(t):
    return t.documents.select("doc_id", gd.validate_input("text").alias("reason"))


@query("n2_redact", f"SELECT doc_id, md5({REDACTED}) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(gd.redact("text")).alias("digest"))


@query("n3_guard_prompt", f"""
SELECT conv_id, turn, r = 'ok' AS send_to_model, r AS reason, CASE WHEN r = 'ok' THEN {REDACTED} END AS safe_text
FROM (SELECT *, CASE WHEN length({STRIPPED}) < 3 THEN 'too_short' WHEN length({STRIPPED}) > 2000 THEN 'too_long' ELSE 'ok' END AS r FROM conversations)""")
def _(t):
    return gd.guard_prompt(t.conversations, "text").select("conv_id", "turn", "send_to_model", "reason", "safe_text")


@query("n4_masking_styles", """
SELECT c_custkey, '***' AS placeholder, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS shape,
  sha256('pepper' || c_name) AS token FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", gd.mask_placeholder("c_name", "***").alias("placeholder"), gd.mask_shape("c_name").alias("shape"),
        gd.mask_token("c_name", "pepper").alias("token"),
    )


@query("n4_tokens_still_join", """
SELECT count(*) AS pairs FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.c_custkey = b.c_custkey""")
def _(t):
    a = t.customer.select(gd.mask_token("c_name", "pepper").alias("token"), "c_nationkey")
    b = t.customer.select(gd.mask_token("c_name", "pepper").alias("token"), "c_mktsegment")
    return a.join(b, "token").agg(F.count("*").alias("pairs"))


@query("n5_column_mask", """
SELECT c_custkey, '****@' || lower(c_mktsegment) || '.example.com' AS email, '***' AS c_name FROM customer""")
def _(t):
    mail = F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    rows = t.customer.select("c_custkey", mail.alias("email"), "c_name")
    return gd.masked_view(rows, {"email": "domain", "c_name": "stars"}, member=False)


@query("n6_masked_view", f"SELECT doc_id, '***' AS source, md5({REDACTED}) AS digest FROM documents")
def _(t):
    view = gd.masked_view(t.documents, {"source": "stars", "text": "redact"}, member=False)
    return view.select("doc_id", "source", F.md5("text").alias("digest"))


BAD_WORDS, TOPICS = ["idiot", "scum"], {"home": ["the", "and"], "abroad": ["der", "que"]}


@query("n7_keyword_block", f"""
SELECT doc_id, CASE WHEN list_has_any(t, ['idiot', 'scum']) THEN 'blocked_keyword' WHEN NOT list_has_any(t, ['the', 'and', 'der', 'que']) THEN 'off_topic' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""")
def _(t):
    return t.documents.select("doc_id", gd.keyword_block("text", BAD_WORDS, TOPICS).alias("verdict"))


@query("n8_policy", f"""
SELECT doc_id, verdict, md5(CASE verdict WHEN 'masked' THEN r WHEN 'passed' THEN text END) AS digest FROM (
  SELECT doc_id, text, {REDACTED} AS r, CASE WHEN list_has_any({tokens('text')}, ['idiot', 'scum']) THEN 'blocked_keyword'
    WHEN {REDACTED} <> text THEN 'masked' ELSE 'passed' END AS verdict FROM documents)""")
def _(t):
    out = gd.apply_policy(t.documents, "text", gd.Policy("MASK", tuple(BAD_WORDS)))
    return out.select("doc_id", "verdict", F.md5("safe_text").alias("digest"))


LEXICON = ["idiot", "stupid", "trash", "scum", "worthless"]


@query("n9_toxicity", f"""
SELECT toxic, count(*) AS docs, count(*) FILTER (WHERE n > 0) AS flagged FROM (
  SELECT CAST(toxic AS BIGINT) AS toxic, len([x FOR x IN {tokens('text')} IF x IN ('idiot', 'stupid', 'trash', 'scum', 'worthless')]) AS n
  FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def _(t):
    scored = t.documents.join(t.labels, "doc_id").select("toxic", gd.toxic_words("text", LEXICON).alias("n"))
    return scored.groupBy("toxic").agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("flagged"))


@query("n9_intervention", r"""
SELECT doc_id, md5(regexp_replace(text, '(?i)\b(idiot|stupid|trash|scum|worthless)\b', '***', 'g')) AS redacted,
  CASE WHEN regexp_matches(text, '(?i)\b(idiot|stupid|trash|scum|worthless)\b') THEN '[removed]' ELSE md5(text) END AS substituted FROM documents""")
def _(t):
    swapped = gd.moderate("text", LEXICON, "substitute")
    return t.documents.select(
        "doc_id", F.md5(gd.moderate("text", LEXICON, "redact")).alias("redacted"),
        F.when(swapped == "[removed]", swapped).otherwise(F.md5(swapped)).alias("substituted"),
    )


LICENCE = """lic AS (SELECT doc_id, CASE WHEN contains(text, 'CC BY-NC') THEN 'cc-by-nc' WHEN contains(text, 'GNU General Public License') THEN 'gpl-3'
  WHEN contains(text, 'Apache License') THEN 'apache-2' WHEN contains(text, 'MIT License') THEN 'mit' ELSE 'unknown' END AS license_type, source FROM documents),
ranked AS (SELECT *, CASE license_type WHEN 'cc-by-nc' THEN 3 WHEN 'gpl-3' THEN 2 WHEN 'unknown' THEN 4 ELSE 1 END AS license_rank FROM lic)"""


@query("n10_licence_intake", f"""
WITH {LICENCE} SELECT doc_id, license_type, CASE license_type WHEN 'cc-by-nc' THEN 'research' WHEN 'unknown' THEN 'none' ELSE 'any' END AS allowed_uses,
  CASE license_type WHEN 'cc-by-nc' THEN 'commercial' WHEN 'gpl-3' THEN 'closed redistribution' WHEN 'unknown' THEN 'all' ELSE '' END AS disallowed_uses,
  CASE license_type WHEN 'cc-by-nc' THEN 'name the author' WHEN 'gpl-3' THEN 'licence and source' WHEN 'apache-2' THEN 'licence and notices'
    WHEN 'mit' THEN 'licence text' ELSE 'unknown' END AS attribution, source AS reviewed_by,
  CASE WHEN license_rank >= 3 OR source IS NULL THEN 'quarantine' ELSE 'accepted' END AS route FROM ranked""")
def _(t):
    out = gd.licence_intake(t.documents, "text", reviewed_by="source")
    return out.select("doc_id", "license_type", "allowed_uses", "disallowed_uses", "attribution", "reviewed_by", "route")


@query("n11_licence_propagation", f"""
WITH {LICENCE}, best AS (SELECT source || '/' || lang AS derived, max(license_rank) AS license_rank FROM ranked JOIN documents USING (doc_id, source) GROUP BY 1)
SELECT derived, CASE license_rank WHEN 4 THEN 'unknown' WHEN 3 THEN 'cc-by-nc' WHEN 2 THEN 'gpl-3' ELSE (
  SELECT max(license_type) FROM ranked r JOIN documents d USING (doc_id) WHERE r.source || '/' || d.lang = derived AND r.license_rank = 1) END AS license_type,
  CAST(license_rank AS BIGINT) AS license_rank FROM best""")
def _(t):
    """Per source and language, the strictest licence among all its documents; ``unknown`` is the strictest."""
    marked = gd.licence_intake(t.documents, "text")
    lineage = marked.select(F.concat_ws("/", "source", "lang").alias("derived"), "doc_id")
    return gd.propagate_licence(lineage, marked, "derived", "doc_id")


@query("n11_chunk_licence", f"""
WITH {LICENCE} SELECT license_type, count(*) AS chunks FROM ranked JOIN (
  SELECT doc_id, unnest([s FOR s IN string_split(text, chr(10)) IF regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '']) AS c FROM documents) USING (doc_id) GROUP BY 1""")
def _(t):
    """Every chunk carries the licence of the document it was cut from."""
    marked = gd.licence_intake(t.documents, "text")
    chunks = marked.select("license_type", F.explode(ch.paragraph_chunks("text", r"\n")).alias("content"))
    return chunks.groupBy("license_type").agg(F.count("*").alias("chunks"))


@query("n12_pseudonymous_feedback", f"""
SELECT sha256('s' || conv_id) AS session_hash, turn, CASE WHEN a >= b AND a > 0 THEN 'english' WHEN b > 0 THEN 'german' ELSE 'other' END AS category
FROM (SELECT conv_id, turn, len([x FOR x IN t IF x IN ('the', 'and')]) AS a, len([x FOR x IN t IF x IN ('der', 'und')]) AS b
      FROM (SELECT *, {tokens('text')} AS t FROM conversations))""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", "text")
    return gd.pseudonymous_feedback(rows, "conv_id", "text", {"english": ["the", "and"], "german": ["der", "und"]}, "s")


@query("n13_output_guard", f"""
SELECT conv_id, turn, regexp_replace({STRIPPED}, '\\b[A-Z0-9]{{6}}\\b', '[REDACTED-PNR]', 'g') AS answer,
  contains(lower(text), 'policy') AS grounded FROM conversations WHERE role = 'assistant'""")
def _(t):
    out = t.conversations.where(F.col("role") == "assistant").select("conv_id", "turn", gd.output_guard("text").alias("g"))
    return out.select("conv_id", "turn", "g.answer", "g.grounded")


@query("n14_guard_report", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, r AS rule, count(*) AS hits FROM (
  SELECT conv_id, {REASON} AS r FROM conversations) JOIN events ON event_id = conv_id GROUP BY 1, 2""")
def _(t):
    checked = t.conversations.select(F.col("conv_id").alias("event_id"), gd.validate_input("text", MARKERS).alias("reason"))
    return gd.guard_report(checked.join(t.events.select("event_id", "ts"), "event_id"), F.to_date("ts"))


@query("j2_sql_mask_function", """
SELECT c_custkey, '****@' || lower(c_mktsegment) || '.com' AS email FROM customer""")
def _(t):
    gd.register_sql_functions(t.spark)
    mail = F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), F.lit(".com"))
    return t.customer.select("c_custkey", mail.alias("mail")).selectExpr("c_custkey", "mask_email(mail) AS email")


@query("j3_status_lookup", """
SELECT o.o_custkey AS custkey, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS day, o.o_orderkey, o.o_orderstatus AS status
FROM orders o JOIN (SELECT DISTINCT c_custkey FROM customer) ON o_custkey = c_custkey""")
def _(t):
    """The table function in set form: a parameter table joined with the records."""
    asked = t.customer.select(F.col("c_custkey").alias("custkey"))
    records = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("day"), "o_orderkey",
        F.col("o_orderstatus").alias("status"),
    )
    return gd.lookup_status(asked, records, ["custkey"])


@query("j3_status_function", """
SELECT DISTINCT o_custkey AS custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    """The SQL table function, called for every customer and day that has an order."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t.orders.select(
        F.col("o_custkey").cast("string").alias("number"), day.alias("day"), "o_orderkey", F.col("o_orderstatus").alias("status")
    ).createOrReplaceTempView("status_records")
    gd.register_status_function(t.spark, "status_records", "number", "day", {"o_orderkey": "BIGINT", "status": "STRING"})
    asked = t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    asked.select(F.col("c_custkey").alias("custkey"), day.alias("day")).distinct().createOrReplaceTempView("status_asked")
    return t.spark.sql(
        "SELECT a.custkey, a.day, s.o_orderkey, s.status FROM status_asked a, "
        "LATERAL get_status(CAST(a.custkey AS STRING), a.day) s"
    )
