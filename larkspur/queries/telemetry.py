"""Telemetry queries (P) over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import sketches as sk
from larkspur.operators import telemetry as tm
from larkspur.queries.registry import query
from larkspur.queries.shared import OTHER_TOPIC, REQUESTS
from larkspur.session import cut_lineage

SPANS = f"""WITH {REQUESTS},
base AS (SELECT *, floor(latency_ms * total_tokens / 400) AS r, floor(latency_ms * 5 / 100) AS c FROM requests),
spans AS (
  SELECT request_id AS trace_id, 0 AS span_id, NULL AS parent_id, 'AGENT' AS span_type, latency_ms AS duration_ms FROM base
  UNION ALL SELECT request_id, 1, 0, 'RETRIEVER', r FROM base
  UNION ALL SELECT request_id, 2, 0, 'CHAIN', c FROM base
  UNION ALL SELECT request_id, 3, 0, 'CHAT_MODEL', floor((latency_ms - r - c) * 9 / 10) FROM base),
own AS (
  SELECT s.trace_id, s.span_id, s.parent_id, s.span_type, CAST(s.duration_ms AS BIGINT) AS duration_ms,
         CAST(s.duration_ms - coalesce(ch.used, 0) AS BIGINT) AS exclusive_ms
  FROM spans s LEFT JOIN (SELECT trace_id, parent_id, sum(duration_ms) AS used FROM spans GROUP BY 1, 2) ch
    ON s.trace_id = ch.trace_id AND s.span_id = ch.parent_id)"""


@query("p1_search_traces", f"""
WITH {REQUESTS}
SELECT request_id AS trace_id, topic AS app, latency_ms AS execution_time_ms
FROM requests WHERE status = 'ERROR' AND latency_ms > 2000 AND topic = 'error'
ORDER BY ts DESC, request_id LIMIT 100""")
def _(t):
    found = tm.search_traces(
        tm.traces_from_requests(tm.requests_from_events(t.events)),
        [("attributes.status", "=", "ERROR"), ("attributes.execution_time_ms", ">", 2000), ("tags.app", "=", "error")],
        newest_first="ts",
        max_results=100,
    )
    return found.select("trace_id", F.col("tags")["app"].alias("app"), "execution_time_ms")


@query("p2_span_exclusive_time", SPANS + """
SELECT trace_id, CAST(span_id AS BIGINT) AS span_id, CAST(parent_id AS BIGINT) AS parent_id,
       span_type, duration_ms, exclusive_ms FROM own""")
def _(t):
    return tm.exclusive_times(tm.traces_from_requests(tm.requests_from_events(t.events)))


@query("p3_stage_bottleneck", SPANS + """
, means AS (SELECT span_type, avg(exclusive_ms) AS m FROM own GROUP BY 1)
SELECT span_type, round(m, 4) AS mean_ms, round(100.0 * m / (SELECT sum(m) FROM means), 1) AS pct,
       m = (SELECT max(m) FROM means) AS bottleneck FROM means""")
def _(t):
    return tm.stage_profile(tm.exclusive_times(tm.traces_from_requests(tm.requests_from_events(t.events))))


@query("p3_critical_path", SPANS.replace("WITH requests", "WITH RECURSIVE requests", 1) + """
, best AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY duration_ms DESC, span_id) AS place FROM own),
walk AS (SELECT trace_id, 0 AS depth, span_id, span_type, duration_ms, exclusive_ms FROM best WHERE parent_id IS NULL AND place = 1
  UNION ALL SELECT b.trace_id, w.depth + 1, b.span_id, b.span_type, b.duration_ms, b.exclusive_ms
  FROM walk w JOIN best b ON b.trace_id = w.trace_id AND b.parent_id = w.span_id AND b.place = 1)
SELECT trace_id, CAST(depth AS BIGINT) AS depth, CAST(span_id AS BIGINT) AS span_id, span_type, duration_ms, exclusive_ms FROM walk""")
def _(t):
    """The slowest way through every trace."""
    return tm.critical_path(tm.traces_from_requests(tm.requests_from_events(t.events)))


@query("p5_telemetry_daily", f"""
WITH {REQUESTS}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS request_count,
       quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
       round(avg(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END), 4) AS error_rate
FROM requests GROUP BY 1""")
def _(t):
    return tm.daily_metrics(tm.requests_from_events(t.events))


@query("p5_daily_from_slices", f"""
WITH {REQUESTS}
SELECT topic, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS request_count, CAST(quantile_disc(latency_ms, 0.5) AS DOUBLE) AS p50_latency_ms,
  CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95_latency_ms, round(avg(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END), 4) AS error_rate
FROM requests GROUP BY 1, 2""")
def _(t):
    """Daily report from hourly slices, which any other grain could use too."""
    kept = sk.Slices(
        quantiles={"latency": "latency_ms"}, sums={"request_count": "count(*)", "errors": "count_if(status = 'ERROR')"}
    )
    requests = tm.requests_from_events(t.events)
    hourly = cut_lineage(kept.of(requests, {"topic": F.col("topic"), "hour": F.date_trunc("HOUR", "ts")}))
    daily = kept.merged(hourly, {"topic": F.col("topic"), "day": F.to_date("hour")})
    return daily.select(
        "topic", "day", "request_count", sk.quantile("latency", 0.5).alias("p50_latency_ms"),
        sk.quantile("latency", 0.95).alias("p95_latency_ms"), F.round(F.col("errors") / F.col("request_count"), 4).alias("error_rate"),
    )


@query("p5_telemetry_lookback", f"""
WITH {REQUESTS}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS request_count,
       quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
       round(avg(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END), 4) AS error_rate
FROM requests WHERE ts >= DATE '2024-01-31' - 14 GROUP BY 1""")
def _(t):
    return tm.daily_metrics(tm.requests_from_events(t.events), as_of="2024-01-31", days=14)


@query("p6_quality_trend", f"""
WITH {REQUESTS}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(groundedness), 3) AS avg_groundedness,
       round(avg(total_tokens), 3) AS avg_total_tokens
FROM requests GROUP BY 1""")
def _(t):
    return tm.quality_trend(tm.requests_from_events(t.events), ["groundedness", "total_tokens"])


@query("p7_topic_mix", f"""
WITH {REQUESTS}
SELECT topic, count(*) AS n, count(*) FILTER (WHERE user_feedback = 'down') AS thumbs_down
FROM requests GROUP BY 1 ORDER BY n DESC""")
def _(t):
    return tm.category_mix(tm.requests_from_events(t.events), "topic").orderBy(F.col("n").desc())


@query("p8_request_detail", f"""
WITH {REQUESTS}
SELECT request_id, topic, latency_ms, groundedness, user_feedback
FROM requests ORDER BY ts DESC, request_id LIMIT 200""")
def _(t):
    columns = ["request_id", "topic", "latency_ms", "groundedness", "user_feedback"]
    return tm.request_detail(tm.requests_from_events(t.events), columns)


@query("p9_static_alerts", f"""
WITH {REQUESTS},
day AS (SELECT * FROM requests WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM requests)),
vals AS (
  SELECT 'other_count_latest_day' AS alert, CAST(count(*) FILTER (WHERE topic = '{OTHER_TOPIC}') AS DOUBLE) AS value, CAST(2 AS DOUBLE) AS threshold FROM day
  UNION ALL
  SELECT 'p95_latency_ms_latest_day', CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE), 5000 FROM day)
SELECT alert, value, threshold, value > threshold AS fired FROM vals""")
def _(t):
    return tm.static_alerts(tm.requests_from_events(t.events), OTHER_TOPIC, 2, 5000)


@query("p10_baseline_anomalies", f"""
WITH {REQUESTS},
daily AS (
  SELECT CAST(ts AS DATE) AS day, CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95_latency_ms,
         CAST(sum(CASE WHEN topic = '{OTHER_TOPIC}' THEN 1 ELSE 0 END) AS DOUBLE) AS other_count
  FROM requests GROUP BY 1),
series AS (
  SELECT day, 'p95_latency_ms' AS series, p95_latency_ms AS value FROM daily
  UNION ALL SELECT day, 'other_count', other_count FROM daily),
based AS (
  SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM series
  WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, series, value, round(m, 4) AS baseline_mean, round(sd, 4) AS baseline_sd,
       CASE WHEN value > m + 2 * coalesce(sd, 0) THEN 'ANOMALY' ELSE 'ok' END AS flag FROM based""")
def _(t):
    daily = tm.daily_series(tm.requests_from_events(t.events), OTHER_TOPIC)
    out = tm.baseline_anomalies(daily, ["p95_latency_ms", "other_count"])
    return out.withColumn("baseline_mean", F.round("baseline_mean", 4)).withColumn(
        "baseline_sd", F.round("baseline_sd", 4)
    )


@query("p11_topic_drift", f"""
WITH {REQUESTS},
daily AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN topic = '{OTHER_TOPIC}' THEN 1.0 ELSE 0.0 END) AS v FROM requests GROUP BY 1),
based AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM daily
          WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, round(v, 6) AS other_share,
       CASE WHEN v > m + 2 * coalesce(sd, 0) THEN 'ANOMALY' ELSE 'ok' END AS flag FROM based""")
def _(t):
    out = tm.topic_drift(tm.requests_from_events(t.events), OTHER_TOPIC)
    return out.select("day", F.round("value", 6).alias("other_share"), "flag")


@query("p12_failure_split", f"""
WITH {REQUESTS}
SELECT failure, count(*) AS n FROM (
  SELECT CASE WHEN total_tokens / 100.0 < 0.5 THEN 'retrieval_failure'
              WHEN latency_ms / 10000.0 < 0.85 THEN 'unsupported_answer' ELSE 'ok' END AS failure
  FROM requests) GROUP BY 1""")
def _(t):
    scored = tm.requests_from_events(t.events).select(
        (F.col("total_tokens") / 100.0).alias("retrieval"), (F.col("latency_ms") / 10000.0).alias("grounded")
    )
    return tm.failure_split(scored, "retrieval", "grounded").groupBy("failure").agg(F.count("*").alias("n"))


@query("p14_usage_by_caller", f"""
WITH {REQUESTS},
use AS (SELECT user_id, CAST(ts AS DATE) AS period, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM requests GROUP BY 1, 2)
SELECT user_id, CAST(period AS VARCHAR) AS period, calls, tokens,
       CAST(sum(tokens) OVER (PARTITION BY user_id ORDER BY period) AS BIGINT) AS running_tokens FROM use""")
def _(t):
    from larkspur.operators.windows import period_measures

    used = tm.usage(tm.requests_from_events(t.events), ["user_id"], F.to_date("ts"))
    run = period_measures(used, "tokens", "period", ["user_id"], 7)
    return run.select("user_id", "period", "calls", "tokens", F.col("running_total").alias("running_tokens"))


@query("p15_budget_alert", f"""
WITH {REQUESTS},
use AS (SELECT topic, CAST(ts AS DATE) AS period, round(CAST(sum(total_tokens) AS DOUBLE) * 3e-3, 6) AS spend FROM requests GROUP BY 1, 2),
run AS (SELECT *, sum(spend) OVER (PARTITION BY topic ORDER BY period) AS running_total FROM use)
SELECT topic, CAST(period AS VARCHAR) AS period, round(spend, 4) AS spend, round(running_total, 4) AS running_total,
       running_total >= 100.0 AS over_budget FROM run""")
def _(t):
    used = tm.usage(tm.requests_from_events(t.events), ["topic"], F.to_date("ts"))
    spend = used.withColumn("spend", F.round(F.col("tokens") * 0.003, 6))
    out = tm.budget_alerts(spend, ["topic"], "period", "spend", 100.0)
    return out.select(
        "topic", "period", F.round("spend", 4).alias("spend"),
        F.round("running_total", 4).alias("running_total"), "over_budget",
    )


@query("p16_engagement", f"""
WITH {REQUESTS}
SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) AS requests,
       count(*) FILTER (WHERE status = 'ERROR') AS failures, count(DISTINCT CAST(ts AS DATE)) > 1 AS recurring
FROM requests WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1""")
def _(t):
    return tm.engagement(tm.requests_from_events(t.events), as_of="2024-01-30", days=7)


@query("p17_session_rollup", """
SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role
FROM conversations GROUP BY 1""")
def _(t):
    return tm.session_rollup(t.conversations)
