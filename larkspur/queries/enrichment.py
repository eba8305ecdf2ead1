"""Batch enrichment queries (M, J4, J5) over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import enrichment as en
from larkspur.operators import vectors as vec
from larkspur.queries.registry import query
from larkspur.queries.shared import tokens, words

INTENTS = {
    "legal": ["license", "licensed", "rights", "reserved", "apache"],
    "abuse": ["idiot", "stupid", "trash", "scum", "worthless"],
    "german": ["der", "die", "und", "nicht"],
    "romance": ["la", "le", "el", "que", "des"],
}
POSITIVE, NEGATIVE = ["with", "for", "avec", "mit"], ["not", "nicht", "pas", "idiot", "trash"]


def hits(items, column="t"):
    listed = ", ".join(f"'{w}'" for w in items)
    return f"len([x FOR x IN {column} IF x IN ({listed})])"


SCORES = "SELECT doc_id, text, lang, " + ", ".join(f"{hits(w)} AS s{i}" for i, w in enumerate(INTENTS.values())) + \
    f", {hits(POSITIVE)} AS pos, {hits(NEGATIVE)} AS neg FROM (SELECT *, {tokens('text')} AS t FROM documents)"
INTENT = (
    "CASE WHEN greatest(s0, s1, s2, s3) = 0 THEN 'other' "
    + " ".join(f"WHEN s{i} = greatest(s0, s1, s2, s3) THEN '{label}'" for i, label in enumerate(INTENTS))
    + " END"
)
MOOD = "CASE WHEN pos > 0 AND neg > 0 THEN 'mixed' WHEN pos > 0 THEN 'positive' WHEN neg > 0 THEN 'negative' ELSE 'neutral' END"


@query("m1_classify", f"SELECT doc_id, {INTENT} AS intent FROM ({SCORES})")
def _(t):
    return t.documents.select("doc_id", en.classify("text", INTENTS).alias("intent"))


@query("m2_classify_many", f"""
SELECT doc_id, array_to_string(list_sort([x FOR x IN [
  {', '.join(f"CASE WHEN s{i} > 1 THEN '{label}' END" for i, label in enumerate(INTENTS))}] IF x IS NOT NULL]), ',') AS intents FROM ({SCORES})""")
def _(t):
    return t.documents.select("doc_id", F.array_join(en.classify_many("text", INTENTS, 1), ",").alias("intents"))


@query("m3_trained_classifier", """
SELECT count(*) AS labelled, true AS at_least_majority, (SELECT count(*) FROM documents) AS predicted FROM documents JOIN labels USING (doc_id)""")
def _(t):
    """The model labels every document; on the labelled ones it is right at least as often as the commoner label."""
    labelled = t.documents.join(t.labels, "doc_id")
    model = en.train_classifier(labelled, "text", "toxic")
    predicted = en.predict(model, t.documents.select("doc_id", "text"), "text").select("doc_id", "prediction")
    scored = predicted.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").agg(
        F.count("toxic").alias("labelled"), F.avg((F.col("prediction") == F.col("toxic")).cast("double")).alias("right"),
        F.avg("toxic").alias("share"), F.count("prediction").alias("predicted"),
    )
    majority = F.greatest(F.col("share"), 1 - F.col("share"))
    return scored.select("labelled", (F.col("right") >= majority).alias("at_least_majority"), "predicted")


@query("m3_predictions")
def _(t):
    """The label that the trained classifier gives to each document."""
    model = en.train_classifier(t.documents.join(t.labels, "doc_id"), "text", "toxic")
    return en.predict(model, t.documents.select("doc_id", "text"), "text").select("doc_id", "prediction")


@query("m4_sentiment", f"SELECT doc_id, {MOOD} AS sentiment FROM ({SCORES})")
def _(t):
    return t.documents.select("doc_id", en.sentiment("text", POSITIVE, NEGATIVE).alias("sentiment"))


def summary_facts(summary, text, most: int):
    """A summary has pieces of its text only, and at most so many words."""
    words = tx.words(summary)
    fits = (F.size(words) <= most) & F.forall(words, lambda w: F.contains(text, w))
    return F.coalesce(fits & (F.size(words) > 0), F.size(tx.words(text)) == 0)


@query("m5_summarize", "SELECT doc_id, true AS fits FROM documents WHERE text IS NOT NULL")
def _(t):
    rows = t.documents.where(F.col("text").isNotNull()).select("doc_id", "text", en.summarize(20)(F.col("text")).alias("summary"))
    return rows.select("doc_id", summary_facts(F.col("summary"), F.col("text"), 20).alias("fits"))


@query("m5_summaries")
def _(t):
    """The summaries themselves."""
    return t.documents.select("doc_id", en.summarize(20)(F.col("text")).alias("summary"))


@query("m6_mask_entities", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[MASKED]', 'g'),
  '\+?\d[\d\s().-]{7,}\d', '[MASKED]', 'g')) AS digest FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(en.mask_entities("text", ["email", "phone"])).alias("digest"))


@query("m7_extract_entities", r"""
SELECT conv_id, turn, nullif(regexp_extract(text, '(\d+)', 1), '') AS number, nullif(regexp_extract(text, '([A-Z]\w+)', 1), '') AS name
FROM conversations""")
def _(t):
    from larkspur.operators import documents as dc

    fields = [dc.Field("number", r"(\d+)"), dc.Field("name", r"([A-Z]\w+)")]
    rows = t.conversations.select("conv_id", "turn", "text")
    return dc.typed_columns(dc.extract_fields(rows, "text", fields), fields).drop("text", "extract_error")


def reply(text: str) -> str:
    """A stand-in for a hosted function: JSON facts about the text, or an error."""
    count = len(text.split())
    if count < 5:
        raise ValueError("text too short")
    return en.json_reply(words=count, first=text.split()[0])


@query("j5_batch_infer", f"""
SELECT doc_id, n AS words, CASE WHEN n < 5 THEN 'ValueError: text too short' END AS error
FROM (SELECT doc_id, len({words('text')}) AS n FROM documents)""")
def _(t):
    """Responses and per-row errors; the word count of a failed row is taken from its text."""
    out = en.batch_infer(t.documents, "doc_id", "text", lambda s: reply(s))
    parsed = out.select(
        "doc_id", F.get_json_object("result.response", "$.words").cast("bigint").alias("words"),
        F.col("result.errorMessage").alias("error"),
    )
    from larkspur.functions.text import word_count

    sizes = t.documents.select("doc_id", word_count("text").cast("bigint").alias("n"))
    return parsed.join(sizes, "doc_id").select("doc_id", F.coalesce("words", "n").alias("words"), "error")


@query("m8_json_results", f"""
SELECT doc_id, w[1] AS first, len(w) AS words FROM (SELECT doc_id, {words('text')} AS w FROM documents) WHERE len(w) >= 5""")
def _(t):
    out = en.batch_infer(t.documents, "doc_id", "text", lambda s: reply(s))
    good, _failed = en.parse_results(out, "doc_id", "words BIGINT, first STRING")
    return good


@query("m9_contract_check", """
SELECT event_id, event_type IN ('click', 'view') AS ok, CASE WHEN event_type = 'error' THEN 'not valid JSON'
  WHEN event_type NOT IN ('click', 'view') THEN 'unexpected keys: extra,k' END AS error FROM events""")
def _(t):
    """JSON properties, some broken and some with one key too many."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), "props")).when(
        ~F.col("event_type").isin("click", "view"), F.replace("props", F.lit("{"), F.lit('{"extra": 1, '))
    ).otherwise(F.col("props"))
    return t.events.select("event_id", en.check_contract(text, ["k"]).alias("c")).select("event_id", "c.*")


MASKED = r"""md5(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[MASKED]', 'g'),
  '\+?\d[\d\s().-]{7,}\d', '[MASKED]', 'g'))"""


@query("m10_enrich_one_pass", f"""
SELECT doc_id, intent, sentiment, true AS fits, {MASKED} AS safe_digest
FROM (SELECT doc_id, {INTENT} AS intent, {MOOD} AS sentiment FROM ({SCORES})) JOIN documents USING (doc_id)""")
def _(t):
    out = en.enrich(t.documents, "text", INTENTS, POSITIVE, NEGATIVE)
    return out.select(
        "doc_id", "intent", "sentiment", summary_facts(F.col("one_liner"), F.col("text"), 20).alias("fits"),
        F.md5("safe_text").alias("safe_digest"),
    )


@query("m11_enrichment_report", f"SELECT intent, sentiment, count(*) AS n FROM (SELECT {INTENT} AS intent, {MOOD} AS sentiment FROM ({SCORES})) GROUP BY 1, 2")
def _(t):
    rows = t.documents.select(
        en.classify("text", INTENTS).alias("intent"), en.sentiment("text", POSITIVE, NEGATIVE).alias("sentiment")
    )
    return en.enrichment_report(rows)


@query("m12_foreign_rows", "SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en'")
def _(t):
    return en.route_foreign(t.documents, "lang").select("doc_id", "lang", "n_chars")


@query("m13_distinct_inputs", f"""
SELECT conv_id, turn, len({words('text')}) AS words FROM conversations WHERE len({words('text')}) >= 5""")
def _(t):
    """Each distinct turn text is scored once; short texts fail and drop out here."""
    rows = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    out = en.infer_distinct(rows, "key", "text", lambda s: reply(s)).where(F.col("result.errorMessage").isNull())
    parts = F.split("key", ":")
    return out.select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"),
        F.get_json_object("result.response", "$.words").cast("bigint").alias("words"),
    )


@query("m14_cost_estimate", f"""
WITH s AS (SELECT count(*) AS rows, avg(len({words('text')})) AS m FROM documents),
c AS (SELECT rows, m, round(rows * m / 1000 * 3e-3 + rows * 300::DOUBLE / 1000 * 15e-3, 2) AS fat_usd,
  round(rows * (m * 2e-1) / 1000 * 3e-3 + rows * 300::DOUBLE / 1000 * 15e-3, 2) AS lean_usd FROM s)
SELECT rows, round(m, 4) AS mean_tokens, fat_usd, lean_usd, round(100 * (fat_usd - lean_usd) / fat_usd, 2) AS saving_pct FROM c""")
def _(t):
    return en.cost_report(t.documents, "text", 300, 0.2)


@query("m15_prompt_column", """
SELECT doc_id, CASE WHEN contains(text, '{{') THEN NULL ELSE md5('Language: ' || lang || '. Source ' || source || '. Text: ' || text) END AS digest,
  CASE WHEN contains(text, '{{') THEN 'unfilled placeholder' END AS error FROM documents""")
def _(t):
    template = "Language: {{lang}}. Source {{source}}. Text: {{body}}"
    made = en.render_template(template, {"lang": "lang", "source": "source", "body": "text"})
    return t.documents.select("doc_id", made.alias("p")).select("doc_id", F.md5("p.prompt").alias("digest"), "p.error")


@query("m16_text_similarity", """
WITH q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, true AS bounded, true AS symmetric, 1.0::DOUBLE AS with_itself FROM q JOIN a USING (conv_id, turn)""")
def _(t):
    """Of every question and answer: a cosine from 0 to 1, the same both ways, and 1 for the question with itself."""
    model = vec.TextEmbedder.fit(t.documents, "text", 256)
    asked = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pairs = asked.join(answers, ["conv_id", "turn"]).withColumn("same", F.col("question"))
    out = en.similarity(model, pairs, "question", "answer", "one")
    out = en.similarity(model, out, "answer", "question", "other")
    out = en.similarity(model, out, "question", "same", "self")
    return out.select(
        "conv_id", "turn", F.col("one").between(-1e-6, 1 + 1e-6).alias("bounded"),
        (F.abs(F.col("one") - F.col("other")) < 1e-6).alias("symmetric"), F.round("self", 4).alias("with_itself"),
    )


@query("m16_similarities")
def _(t):
    """The similarity of every question and its answer."""
    model = vec.TextEmbedder.fit(t.documents, "text", 256)
    asked = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    out = en.similarity(model, asked.join(answers, ["conv_id", "turn"]), "question", "answer", "similarity")
    return out.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query("m17_forecast", """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
sp AS (SELECT event_type, min(day) AS f, max(day) AS l FROM daily GROUP BY 1),
cal AS (SELECT event_type, f, l, CAST(unnest(generate_series(f, l + 7, INTERVAL 1 DAY)) AS DATE) AS day FROM sp),
de AS (SELECT c.*, date_diff('day', c.f, c.day)::DOUBLE AS x, coalesce(d.n, 0)::DOUBLE AS y, dayofweek(c.day) AS wd FROM cal c LEFT JOIN daily d ON c.event_type = d.event_type AND c.day = d.day),
li AS (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM de WHERE day <= l GROUP BY 1),
ef AS (SELECT de.event_type, wd, avg(y - (a + b * x)) AS e FROM de JOIN li ON de.event_type = li.event_type WHERE day <= l GROUP BY 1, 2),
fi AS (SELECT de.event_type, de.day, l, y, a + b * x + coalesce(e, 0) AS fc FROM de JOIN li ON de.event_type = li.event_type LEFT JOIN ef ON ef.event_type = de.event_type AND ef.wd = de.wd),
rs AS (SELECT event_type, stddev_samp(y - fc) AS sd FROM fi WHERE day <= l GROUP BY 1)
SELECT fi.event_type, CAST(day AS VARCHAR) AS day, round(fc, 4) AS forecast, round(fc - 1.96::DOUBLE * sd, 4) AS lower, round(fc + 1.96::DOUBLE * sd, 4) AS upper
FROM fi JOIN rs ON fi.event_type = rs.event_type WHERE day > l""")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = en.forecast(daily, "event_type", "day", "n", 7)
    return out.select("event_type", "day", *[F.round(c, 4).alias(c) for c in ("forecast", "lower", "upper")])
