"""Aggregation and window queries (D, E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregates as agg
from larkspur.operators import sketches as sk
from larkspur.operators import telemetry as tm
from larkspur.operators import windows as win
from larkspur.queries.registry import query
from larkspur.queries.shared import REQUESTS
from larkspur.session import work_dir


@query("d1_table_audit", """
SELECT count(*) AS documents, count(text) AS with_text, count(DISTINCT source) AS sources,
       min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM documents""")
def _(t):
    return t.documents.agg(
        F.count("*").alias("documents"), F.count("text").alias("with_text"),
        F.countDistinct("source").alias("sources"), F.min(F.length("text")).alias("min_chars"),
        F.max(F.length("text")).alias("max_chars"),
    )


@query("d2_completeness", """
SELECT count(*) AS docs, count(quality) AS labelled, count(*) FILTER (WHERE quality IS NULL) AS unlabelled,
       count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").agg(
        F.count("*").alias("docs"), F.count("quality").alias("labelled"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )


@query("d3_basic_measures", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price,
       min(l_discount) AS min_discount, max(l_tax) AS max_tax FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_discount"),
        F.max("l_tax").alias("max_tax"),
    )


@query("d4_filtered_measure", """
SELECT l_linestatus, count(1) FILTER (WHERE l_returnflag = 'R') AS returned,
       round(count(1) FILTER (WHERE l_returnflag = 'R') / count(1), 6) AS return_rate FROM lineitem GROUP BY 1""")
def _(t):
    return t.spark.sql(
        "SELECT l_linestatus, COUNT(1) FILTER (WHERE l_returnflag = 'R') AS returned, "
        "ROUND(CAST(COUNT(1) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / COUNT(1), 6) AS return_rate "
        "FROM {lineitem} GROUP BY l_linestatus",
        lineitem=t.lineitem,
    )


@query("d5_ratio_measure", """
SELECT l_returnflag, round(sum(l_extendedprice * l_tax) / sum(l_extendedprice), 8) AS tax_ratio FROM lineitem GROUP BY 1""")
def _(t):
    ratio = F.sum(F.col("l_extendedprice") * F.col("l_tax")) / F.sum("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(ratio, 8).alias("tax_ratio"))


@query("d6_group_by_all", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def _(t):
    return t.spark.sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total "
        "FROM {orders} GROUP BY ALL",
        orders=t.orders,
    )


@query("d7_rollup_totals", """
SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def _(t):
    measures = [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")]
    return agg.rollup_totals(t.lineitem, ["l_returnflag", "l_linestatus"], measures)


@query("d8_percentiles", """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(t):
    # accuracy above the row count of small groups keeps the sketch exact there
    return t.events.groupBy("event_type").agg(
        F.percentile_approx("value", 0.5, 100000).alias("p50"), F.percentile_approx("value", 0.95, 100000).alias("p95")
    )


@query("d9_conditional_rate", f"""
WITH {REQUESTS}
SELECT user_id, round(avg(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END), 4) AS error_rate FROM requests GROUP BY 1""")
def _(t):
    rate = F.avg(F.when(F.col("status") == "ERROR", 1).otherwise(0))
    return tm.requests_from_events(t.events).groupBy("user_id").agg(F.round(rate, 4).alias("error_rate"))


@query("d10_category_mix", """
SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC""")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


@query("d11_daily_means", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 3) AS avg_value FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 3).alias("avg_value"))


@query("d12_scorer_means", """
SELECT lang, 'quality' AS scorer, round(avg(quality), 6) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1
UNION ALL SELECT lang, 'toxic', round(avg(toxic), 6) FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(t):
    scored = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    long = agg.melt_scores(scored, ["doc_id", "lang"], ["quality", "toxic"])
    return long.groupBy("lang", "scorer").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("d13_stddev", """
SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    return t.part.groupBy("p_brand").agg(F.round(F.stddev("p_retailprice"), 6).alias("sd"), F.count("*").alias("n"))


@query("d14_global_aggregate", """
SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 8) AS discount FROM lineitem""")
def _(t):
    return t.lineitem.agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 8).alias("discount"),
    )


@query("d15_exact_order_statistic", f"""
WITH {REQUESTS},
ranked AS (SELECT topic, latency_ms, row_number() OVER (PARTITION BY topic ORDER BY latency_ms) AS rn,
                  count(*) OVER (PARTITION BY topic) AS n FROM requests),
means AS (SELECT topic, round(avg(latency_ms), 4) AS mean_ms, count(*) AS requests FROM requests GROUP BY 1)
SELECT r.topic, requests, mean_ms, latency_ms AS p95_ms FROM ranked r JOIN means m ON r.topic = m.topic
WHERE rn = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1""")
def _(t):
    requests = tm.requests_from_events(t.events).select("topic", "latency_ms")
    means = requests.groupBy("topic").agg(
        F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 4).alias("mean_ms")
    )
    return means.join(agg.order_statistic(requests, ["topic"], "latency_ms", 0.95, "p95_ms"), "topic")


@query("d16_share_of_total", """
SELECT event_type, round(sum(value), 2) AS total, round(100.0 * sum(value) / (SELECT sum(value) FROM events), 1) AS pct,
       sum(value) = (SELECT max(s) FROM (SELECT sum(value) AS s FROM events GROUP BY event_type)) AS top
FROM events GROUP BY 1""")
def _(t):
    shares = agg.share_of_total(t.events, ["event_type"], "value")
    top = shares.agg(F.max("total")).scalar()
    return shares.select("event_type", F.round("total", 2).alias("total"), "pct", (F.col("total") == top).alias("top"))


HOURLY = sk.Slices(
    distinct={"users": "user_id"}, quantiles={"value": "value"}, heavy={"heavy": "user_id"}, sums={"n": "count(*)"}
)


def hourly_slices(t):
    """Sketches per event type and hour: the earlier half of the events, the later half appended to it."""
    path = work_dir(t.spark, "hourly")
    early = F.col("event_id") % 2 == 0
    for part in (t.events.where(early), t.events.where(~early)):
        HOURLY.of(part, {"event_type": F.col("event_type"), "hour": F.date_trunc("HOUR", "ts")}).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("d17_approximate_distinct", """
WITH u AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2),
h AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC) AS place FROM u)
SELECT event_type, (SELECT count(DISTINCT user_id) FROM events e WHERE e.event_type = h.event_type) AS users,
  string_agg(CAST(n AS VARCHAR), ',' ORDER BY place) AS most FROM h WHERE place <= 3 GROUP BY 1""")
def _(t):
    """Distinct users and the counts of the heaviest ones, from stored hourly slices."""
    merged = HOURLY.merged(hourly_slices(t), {"event_type": F.col("event_type")})
    counts = F.sort_array(F.transform(sk.heavy_items("heavy", 3), lambda x: x["count"]), False)
    return merged.select(
        "event_type", sk.distinct_count("users").alias("users"), F.array_join(counts.cast("array<string>"), ",").alias("most")
    )


@query("d17_distinct_at_each_grain", """
SELECT 'type' AS grain, event_type AS key, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(DISTINCT user_id), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'all', 'all', count(DISTINCT user_id), count(*) FROM events""")
def _(t):
    """The same stored slices merged to three grains."""
    slices = hourly_slices(t)
    keys = {"type": F.col("event_type"), "day": F.date_format("hour", "yyyy-MM-dd"), "all": F.lit("all")}
    merged = [
        HOURLY.merged(slices, {"key": key}).select(F.lit(grain).alias("grain"), "key", sk.distinct_count("users").alias("users"), "n")
        for grain, key in keys.items()
    ]
    return reduce(DataFrame.unionAll, merged)


@query("d8_percentiles_from_slices", """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(t):
    merged = HOURLY.merged(hourly_slices(t), {"event_type": F.col("event_type")})
    return merged.select("event_type", sk.quantile("value", 0.5).alias("p50"), sk.quantile("value", 0.95).alias("p95"))


@query("e1_trailing_baseline", """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(day AS VARCHAR) AS day, n,
       round(avg(n) OVER w, 6) AS baseline_mean, round(stddev_samp(n) OVER w, 6) AS baseline_sd
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = win.trailing_baseline(daily, "n", "day", ["event_type"])
    return out.withColumn("baseline_mean", F.round("baseline_mean", 6)).withColumn(
        "baseline_sd", F.round("baseline_sd", 6)
    )


@query("e2_sigma_flag", """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
based AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM daily
  WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN n > m + 2 * coalesce(sd, 0) THEN 'ANOMALY' ELSE 'ok' END AS flag FROM based""")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = win.trailing_baseline(daily, "n", "day", ["event_type"])
    flag = win.sigma_flag(F.col("n"), F.col("baseline_mean"), F.col("baseline_sd"))
    return out.select("event_type", "day", flag.alias("flag"))


@query("e3_top_k_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 3""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return win.top_k(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("e4_first_hit_rank", """
WITH ranked AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, min(rank) AS first_rank, round(1.0 / min(rank), 6) AS reciprocal FROM ranked
WHERE rank <= 10 AND o_orderstatus = 'F' GROUP BY 1""")
def _(t):
    ranked = win.top_k(
        t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"),
        ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10,
    )
    hits = ranked.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.min("rank").alias("first_rank"))
    return hits.withColumn("reciprocal", F.round(F.lit(1.0) / F.col("first_rank"), 6))


@query("e5_window_measures", """
WITH monthly AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, CAST(month AS VARCHAR) AS month, round(total, 2) AS total,
       round(sum(total) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running_total,
       round(sum(total) OVER (w ROWS 2 PRECEDING), 2) AS trailing_total,
       round(total - lag(total) OVER w, 2) AS change
FROM monthly WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""")
def _(t):
    month = F.date_trunc("MONTH", "o_orderdate").cast("date").alias("month")
    monthly = t.orders.groupBy("o_orderstatus", month).agg(F.sum("o_totalprice").alias("total"))
    out = win.period_measures(monthly, "total", "month", ["o_orderstatus"], 3)
    money = ("total", "running_total", "trailing_total", "change")
    return out.select("o_orderstatus", "month", *[F.round(c, 2).alias(c) for c in money])


@query("e6_last_turns", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, string_agg(turn || ':' || role || ':' || length(text), '|' ORDER BY turn) AS history FROM ranked WHERE rn <= 4 GROUP BY 1""")
def _(t):
    kept = win.last_turns(t.conversations, "conv_id", "turn", keep=4)
    shown = F.transform(
        "history",
        lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], F.length(m["text"]).cast("string")),
    )
    return kept.select("conv_id", F.array_join(shown, "|").alias("history"))


@query("e7_latest_version", """
SELECT conv_id, arg_max(role, turn) AS role, CAST(max(turn) AS VARCHAR) AS version FROM conversations GROUP BY 1""")
def _(t):
    versions = t.conversations.select("conv_id", "role", F.col("turn").cast("string").alias("version"))
    return win.latest_by_key(versions, ["conv_id"], [F.col("version").cast("int")])


@query("e8_positions", """
SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS part FROM (SELECT doc_id, string_split(source, 'c') AS p FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("source", "c")).alias("pos", "part"))


@query("e9_adjacent_distance", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT b.vec_id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def _(t):
    from larkspur.operators.vectors import adjacent_distance

    out = adjacent_distance(t.embeddings, "vec_id", "embedding")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))
