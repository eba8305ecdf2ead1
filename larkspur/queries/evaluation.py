"""Evaluation queries (Q, J4) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import evaluation as ev
from larkspur.operators import relational as rel
from larkspur.operators import telemetry as tm
from larkspur.queries.registry import query
from larkspur.queries.shared import REQUESTS, tokens, words

PAIRS = """pairs AS (SELECT q.conv_id * 1000 + q.turn AS pair_id, q.text AS question, a.text AS answer FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""
U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def answer_pairs(t):
    """Each user turn with the assistant turn that follows it."""
    asked = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    both = asked.join(said, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "question", "answer")


@query("q1_response_length", f"""
SELECT conv_id, turn, CAST(CASE WHEN n < 5 THEN 0.0 WHEN n > 120 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS value,
  CASE WHEN n < 5 THEN 'Response too short (' WHEN n > 120 THEN 'Response quite long (' ELSE 'Appropriate length (' END || n || ' words)' AS rationale
FROM (SELECT conv_id, turn, len({words('text')}) AS n FROM conversations WHERE role = 'assistant')""")
def _(t):
    rows = t.conversations.where(F.col("role") == "assistant")
    return rows.select("conv_id", "turn", ev.response_length("text").alias("s")).select("conv_id", "turn", "s.*")


@query("q2_citation_score", """
SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, '§') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM documents""")
def _(t):
    return t.documents.select("doc_id", ev.cites("text", ["License", "§"])["value"].alias("value"))


@query("j4_code_scorer", """
SELECT conv_id, turn, CASE WHEN contains(text, 'Fare Rules') OR contains(text, 'fare rules') OR contains(text, 'policy') OR contains(text, 'source') OR contains(text, '§')
  THEN 'cites a policy / source reference' ELSE 'no policy citation found' END AS rationale FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", ev.cites("text")["rationale"].alias("rationale"))


COVERAGE = f"""{PAIRS},
facts AS (SELECT pair_id, lower(answer) AS low, [s FOR s IN string_split(question, chr(10)) IF s <> ''] AS facts FROM pairs),
f AS (SELECT pair_id, low, unnest(facts) AS fact, len(facts) AS total FROM facts),
w AS (SELECT pair_id, low, total, [x FOR x IN {words('lower(fact)')} IF length(x) > 3] AS w FROM f),
h AS (SELECT pair_id, total, len([x FOR x IN w IF contains(low, x)]) >= greatest(1, len(w) // 2) AS hit FROM w)"""


@query("q3_fact_coverage", f"""
WITH {COVERAGE} SELECT pair_id, round(count(*) FILTER (WHERE hit) / max(total), 6) AS coverage FROM h GROUP BY 1""")
def _(t):
    facts = F.filter(F.split("question", "\n"), lambda s: s != "")
    return answer_pairs(t).select("pair_id", F.round(ev.fact_coverage("answer", facts), 6).alias("coverage"))


@query("q4_reference_scores", f"""
SELECT doc_id, quality IS NOT NULL AS has_reference, CAST(CASE WHEN quality IS NOT NULL THEN (quality = 1) = (n_chars >= 1000) END AS DOUBLE) AS agreement,
  CAST(CASE WHEN len({words('text')}) < 5 THEN 0.0 WHEN len({words('text')}) > 120 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS free_score
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    agree = ((F.col("quality") == 1) == (F.col("n_chars") >= 1000)).cast("double")
    return rows.select(
        "doc_id", F.col("quality").isNotNull().alias("has_reference"), ev.skip_without("quality", agree).alias("agreement"),
        ev.response_length("text")["value"].alias("free_score"),
    )


@query("q5_token_support", f"""
WITH {PAIRS}, g AS (SELECT pair_id, list_distinct({tokens('answer')}) AS a, list_distinct({tokens('question')}) AS q FROM pairs)
SELECT pair_id, round(len(list_intersect(a, q)) / nullif(len(a), 0), 6) AS groundedness, round(len(list_intersect(q, a)) / nullif(len(q), 0), 6) AS relevance FROM g""")
def _(t):
    return answer_pairs(t).select(
        "pair_id", F.round(ev.token_support("answer", "question"), 6).alias("groundedness"),
        F.round(ev.token_support("question", "answer"), 6).alias("relevance"),
    )


NORMAL = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


@query("q6_exact_match", f"""
WITH {PAIRS} SELECT pair_id, CAST({NORMAL.format(c="question")} = {NORMAL.format(c="CASE WHEN pair_id % 2 = 0 THEN '  ' || replace(question, ' ', '   ') ELSE answer END")} AS DOUBLE) AS exact FROM pairs""")
def _(t):
    pairs = answer_pairs(t)
    reference = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("  "), F.replace("question", F.lit(" "), F.lit("   ")))).otherwise(F.col("answer"))
    return pairs.select("pair_id", ev.exact_match("question", reference).alias("exact"))


def gram_sql(n: int) -> str:
    def side(c):
        joined = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        grams = "t" if n == 1 else f"[{joined} FOR i IN range(1, len(t) - {n} + 2)]"
        return f"SELECT pair_id, unnest({grams}) AS gram FROM (SELECT pair_id, {tokens(c)} AS t FROM pairs)"

    return f"""h{n} AS (SELECT pair_id, gram, count(*) AS c FROM ({side('answer')}) GROUP BY 1, 2),
r{n} AS (SELECT pair_id, gram, count(*) AS c FROM ({side('question')}) GROUP BY 1, 2),
c{n} AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.c, 0) AS h, coalesce(b.c, 0) AS r FROM h{n} a FULL JOIN r{n} b ON a.pair_id = b.pair_id AND a.gram = b.gram)"""


@query("q7_rouge_n", f"""
WITH {PAIRS}, {gram_sql(2)}, s AS (SELECT pair_id, sum(least(h, r)) AS o, sum(h) AS h, sum(r) AS r FROM c2 GROUP BY 1)
SELECT p.pair_id, round(coalesce(o / nullif(r, 0), 0), 6) AS recall, round(coalesce(o / nullif(h, 0), 0), 6) AS precision,
  round(coalesce(2.0::DOUBLE * o / nullif(h + r, 0), 0), 6) AS f1 FROM pairs p LEFT JOIN s USING (pair_id)""")
def _(t):
    out = ev.rouge_n(answer_pairs(t), "pair_id", "answer", "question", 2)
    return out.select("pair_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("q7_rouge_l")
def _(t):
    out = ev.rouge_l(answer_pairs(t), "pair_id", "answer", "question")
    return out.select("pair_id", F.round("rouge_l", 6).alias("rouge_l"))


@query("q8_bleu", f"""
WITH {PAIRS}, {', '.join(gram_sql(n) for n in (1, 2, 3, 4))},
p AS ({' UNION ALL '.join(f"SELECT sum(least(h, r)) AS clipped, sum(h) AS total FROM c{n}" for n in (1, 2, 3, 4))}),
l AS (SELECT sum(len({tokens('answer')})) AS c, sum(len({tokens('question')})) AS r FROM pairs)
SELECT round((SELECT CASE WHEN min(clipped) > 0 THEN exp(least(0.0::DOUBLE, 1 - (SELECT r / c FROM l)) + avg(ln(clipped / total))) ELSE 0 END FROM p), 8) AS bleu""")
def _(t):
    out = ev.bleu(answer_pairs(t), "pair_id", "answer", "question")
    return out.select(F.round("bleu", 8).alias("bleu"))


@query("q9_perplexity", f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY 1, 2),
cf AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY 1), z AS (SELECT sum(cf) AS n, count(*) AS v FROM cf)
SELECT doc_id, round(exp(-sum(tf * ln((cf + 1) / (n + v + 1))) / sum(tf)), 4) AS perplexity FROM tf JOIN cf USING (term), z GROUP BY 1""")
def _(t):
    out = ev.unigram_perplexity(t.documents, t.documents, "doc_id", "text")
    return out.select("doc_id", F.round("perplexity", 4).alias("perplexity"))


def run_scores(t):
    """Two runs over the labelled documents: correctness, groundedness and safety per row."""
    rows = t.documents.join(t.labels, "doc_id")
    scores = rows.select(
        "doc_id", "lang", F.col("quality").cast("double").alias("correctness"),
        (1 - F.col("toxic")).cast("double").alias("safety"),
        F.when(F.col("n_chars") >= 1000, 1.0).otherwise(0.5).alias("groundedness"),
    )
    second = scores.withColumn("correctness", F.when(F.col("lang") == "de", 1.0).otherwise(F.col("correctness")))
    return scores.withColumn("run", F.lit("v1")).unionByName(second.withColumn("run", F.lit("v2")))


RUNS = """s AS (SELECT doc_id, lang, quality::DOUBLE AS correctness, (1 - toxic)::DOUBLE AS safety, CASE WHEN n_chars >= 1000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS groundedness
  FROM documents JOIN labels USING (doc_id)),
runs AS (SELECT 'v1' AS run, * FROM s UNION ALL SELECT 'v2', doc_id, lang, CASE WHEN lang = 'de' THEN 1.0 ELSE correctness END, safety, groundedness FROM s),
means AS (SELECT run, 'correctness' AS scorer, avg(correctness) AS mean FROM runs GROUP BY 1 UNION ALL SELECT run, 'safety', avg(safety) FROM runs GROUP BY 1
  UNION ALL SELECT run, 'groundedness', avg(groundedness) FROM runs GROUP BY 1)"""
SCORERS = ["correctness", "safety", "groundedness"]


@query("q10_run_means", f"WITH {RUNS} SELECT run, scorer, round(mean, 6) AS mean FROM means")
def _(t):
    return ev.run_means(run_scores(t), "run", SCORERS).withColumn("mean", F.round("mean", 6))


@query("q11_compare_versions", f"""
WITH {RUNS} SELECT scorer, round(a.mean, 6) AS v1, round(b.mean, 6) AS v2, round(b.mean - a.mean, 6) AS delta
FROM (SELECT * FROM means WHERE run = 'v1') a FULL JOIN (SELECT * FROM means WHERE run = 'v2') b USING (scorer)""")
def _(t):
    means = ev.run_means(run_scores(t), "run", SCORERS)
    out = rel.compare_runs(means.where(F.col("run") == "v1"), means.where(F.col("run") == "v2"))
    return out.select("scorer", *[F.round(c, 6).alias(c) for c in ("v1", "v2", "delta")])


@query("q12_choose_winner", f"""
WITH {RUNS}, p AS (SELECT max(mean) FILTER (WHERE run = 'v1' AND scorer = 'correctness') AS c1, max(mean) FILTER (WHERE run = 'v2' AND scorer = 'correctness') AS c2,
  max(mean) FILTER (WHERE run = 'v1' AND scorer = 'safety') AS s1, max(mean) FILTER (WHERE run = 'v2' AND scorer = 'safety') AS s2 FROM means)
SELECT s2 >= s1 - 1e-9 AS safety_ok, CASE WHEN s2 >= s1 - 1e-9 AND c2 > c1 THEN 'v2' ELSE 'v1' END AS winner FROM p""")
def _(t):
    means = ev.run_means(run_scores(t), "run", SCORERS)
    return ev.choose_winner(means, "run", "v1", "v2").select("safety_ok", "winner")


@query("q13_promotion_gate", f"WITH {RUNS} SELECT count(*) AS metrics, bool_and(mean >= 0.8) AS passed FROM means WHERE run = 'v2'")
def _(t):
    means = ev.run_means(run_scores(t), "run", SCORERS)
    return ev.promotion_gate(means.where(F.col("run") == "v2"))


@query("q14_calibration", """
SELECT lang, count(*) AS n, round(avg(CASE WHEN (n_chars >= 1000) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement,
  count(*) FILTER (WHERE n_chars >= 1000 AND quality = 1) AS true_pos, count(*) FILTER (WHERE n_chars >= 1000 AND quality = 0) AS false_pos,
  count(*) FILTER (WHERE n_chars < 1000 AND quality = 1) AS false_neg, count(*) FILTER (WHERE n_chars < 1000 AND quality = 0) AS true_neg
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang", (F.col("n_chars") >= 1000).alias("judge"), (F.col("quality") == 1).alias("human")
    )
    return ev.calibration(rows, "judge", "human", ["lang"]).withColumn("agreement", F.round("agreement", 6))


@query("q15_length_bands", f"""
SELECT band, count(*) AS n FROM (SELECT CASE WHEN w BETWEEN 40 AND 110 THEN 'pass' WHEN w BETWEEN 25 AND 140 THEN 'review' ELSE 'fail' END AS band
  FROM (SELECT len({words('text')}) AS w FROM conversations)) GROUP BY 1""")
def _(t):
    band = ev.length_band(tx.word_count("text")).alias("band")
    return t.conversations.select(band).groupBy("band").agg(F.count("*").alias("n"))


@query("q16_slice_report", """
WITH s AS (SELECT CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium' ELSE 'hard' END AS band,
  quality::DOUBLE AS a, CASE WHEN lang = 'de' THEN 0.0::DOUBLE ELSE quality::DOUBLE END AS b FROM documents JOIN labels USING (doc_id))
SELECT band, count(*) AS n, round(avg(a), 6) AS before, round(avg(b), 6) AS after, avg(b) < avg(a) AS regressed FROM s GROUP BY 1""")
def _(t):
    size, quality = F.col("n_chars"), F.col("quality").cast("double")
    rows = t.documents.join(t.labels, "doc_id").select(
        F.when(size < 500, "easy").when(size < 2000, "medium").otherwise("hard").alias("band"),
        quality.alias("a"), F.when(F.col("lang") == "de", 0.0).otherwise(quality).alias("b"),
    )
    out = ev.slice_report(rows, "band", "a", "b")
    return out.withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6))


POISSON = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in ev.POISSON_ONE)


@query("q17_bootstrap_interval", f"""
WITH d AS (SELECT doc_id, quality::DOUBLE AS y, b, {U.format("doc_id || ':' || b")} AS u FROM labels, range(1, 101) r(b)),
w AS (SELECT b, y, {POISSON} AS w FROM d), m AS (SELECT b, sum(w * y) / sum(w) AS m FROM w GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round((SELECT avg(quality) FROM labels), 6) AS mean FROM m""")
def _(t):
    out = ev.bootstrap_interval(t.labels, "doc_id", "quality", 100)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean")])


@query("q18_worst_rows", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 25""")
def _(t):
    scored = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return ev.worst_rows(scored, "quality", "doc_id", 25)


@query("q18_flipped_rows", f"""
WITH {RUNS} SELECT a.doc_id, a.correctness >= 0.5 AS passed_before, b.correctness >= 0.5 AS passed_after
FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND a.run = 'v1' AND b.run = 'v2' WHERE (a.correctness >= 0.5) <> (b.correctness >= 0.5)""")
def _(t):
    scores = run_scores(t)
    return ev.flipped_rows(scores.where(F.col("run") == "v1"), scores.where(F.col("run") == "v2"), "doc_id", "correctness")


@query("q19_recheck_failures", f"""
WITH {RUNS} SELECT doc_id, correctness, CASE WHEN correctness >= 0.5 THEN 'fixed' ELSE 'failing' END AS state FROM runs
WHERE run = 'v2' AND doc_id IN (SELECT doc_id FROM runs WHERE run = 'v1' AND correctness < 0.5)""")
def _(t):
    scores = run_scores(t)
    failed = scores.where((F.col("run") == "v1") & (F.col("correctness") < 0.5))
    return ev.recheck_failures(failed, scores.where(F.col("run") == "v2"), "doc_id", "correctness")


@query("q20_traffic_split", f"""
SELECT arm, count(*) AS requests, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM (
  SELECT user_id, value, CASE WHEN {U.format("'split:' || user_id")} < 0.1 THEN 'challenger' ELSE 'champion' END AS arm FROM events) GROUP BY 1""")
def _(t):
    arms = t.events.select("user_id", "value", ev.traffic_arm("user_id").alias("arm"))
    per_user = arms.groupBy("arm", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return per_user.groupBy("arm").agg(
        F.sum("n").alias("requests"), F.count("*").alias("users"), F.round(F.sum("v") / F.sum("n"), 6).alias("mean_value")
    )


@query("q21_child_runs", """
SELECT parent_id, count(*) AS children, max(score) AS best, arg_max(run_id, score * 1e9 + run_id) AS best_run FROM (
  SELECT o_orderkey AS run_id, o_custkey AS parent_id, round(o_totalprice, 2) AS score FROM orders) GROUP BY 1""")
def _(t):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("parent_id"), F.round("o_totalprice", 2).alias("score")
    )
    return ev.child_runs(runs)


@query("q22_scorecard", f"""
WITH {REQUESTS}, {RUNS},
v AS (SELECT scorer AS metric, mean AS value FROM means WHERE run = 'v2' UNION ALL SELECT 'p95_ms', CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) FROM requests)
SELECT t.metric, t.target, round(v.value, 6) AS value, coalesce(CASE WHEN t.metric = 'p95_ms' THEN v.value <= t.target ELSE v.value >= t.target END, false) AS passed
FROM (VALUES ('correctness', 0.85::DOUBLE), ('groundedness', 0.9::DOUBLE), ('p95_ms', 3000.0::DOUBLE)) t(metric, target) LEFT JOIN v USING (metric)""")
def _(t):
    means = ev.run_means(run_scores(t), "run", SCORERS).where(F.col("run") == "v2")
    values = means.select(F.col("scorer").alias("metric"), F.col("mean").alias("value"))
    p95 = tm.requests_from_events(t.events).agg(
        F.percentile_approx("latency_ms", 0.95, 100000).cast("double").alias("value")
    ).select(F.lit("p95_ms").alias("metric"), "value")
    return ev.scorecard(values.unionByName(p95)).withColumn("value", F.round("value", 6))


@query("q23_format_scores", r"""
SELECT doc_id, CAST(regexp_matches(x, '(?:\+?\d[\d .()-]{7,}\d|[\w.+-]+@[\w-]+\.[\w.-]+)') AS DOUBLE) AS contact,
  CAST(regexp_matches(x, '\b\d{4}-\d{2}-\d{2}\b') AS DOUBLE) AS dated, CASE WHEN n_chars <= 20000 THEN 'within limit' ELSE 'over limit' END AS size_note
FROM (SELECT doc_id, n_chars, regexp_replace(text, '\s+', ' ', 'g') AS x FROM documents)""")
def _(t):
    return t.documents.select(
        "doc_id", ev.format_score("text", "contact_present")["value"].alias("contact"),
        ev.format_score("text", "date_present")["value"].alias("dated"),
        ev.limit_score(F.col("n_chars"), 20000)["rationale"].alias("size_note"),
    )


@query("q24_label_summary", """
SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'Accurate' WHEN quality = 1 THEN 'Partially Accurate' ELSE 'Inaccurate' END AS label, count(*) AS n FROM labels GROUP BY 1""")
def _(t):
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Accurate").when(
        F.col("quality") == 1, "Partially Accurate"
    ).otherwise("Inaccurate")
    return ev.label_summary(t.labels.select(label.alias("label")), "label")


@query("q24_review_queue", f"""
WITH {REQUESTS} SELECT request_id, topic FROM requests WHERE user_feedback = 'down' ORDER BY ts DESC, request_id LIMIT 20""")
def _(t):
    rows = tm.requests_from_events(t.events).where(F.col("user_feedback").isNotNull()).select(
        "request_id", "ts", "topic", (F.col("user_feedback") == "up").alias("positive")
    )
    return ev.review_queue(rows, "positive", "ts", "request_id", 20).select("request_id", "topic")


@query("i7_sampled_scoring", f"""
WITH {REQUESTS}, n AS (SELECT *, {U.format("'safety:' || request_id")} < 1.0 AS s, {U.format("'relevance:' || request_id")} < 0.5 AS r FROM requests)
SELECT topic, count(*) FILTER (WHERE s) AS safety_scored, count(*) FILTER (WHERE r) AS relevance_scored, round(avg(groundedness) FILTER (WHERE r), 6) AS sampled_mean FROM n GROUP BY 1""")
def _(t):
    rows = tm.requests_from_events(t.events)
    marked = rows.withColumn("s", ev.sampled("request_id", "safety", 1.0)).withColumn(
        "r", ev.sampled("request_id", "relevance", 0.5)
    )
    return marked.groupBy("topic").agg(
        F.count_if("s").alias("safety_scored"), F.count_if("r").alias("relevance_scored"),
        F.round(F.avg(F.when(F.col("r"), F.col("groundedness"))), 6).alias("sampled_mean"),
    )
