"""Request telemetry: traces, daily metrics, alerts, drift and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.aggregates import daily_percentiles
from larkspur.operators.enrichment import classify, sentiment, summarize
from larkspur.operators.evaluation import token_support
from larkspur.operators.guard import toxic_words
from larkspur.operators.windows import latest_by_key, period_measures, sigma_flag, trailing_baseline
from larkspur.session import cut_lineage
from larkspur.sources.changes import merge_records

OPS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def requests_from_events(events: DataFrame) -> DataFrame:
    """One row per request in the metrics contract, taken from raw events.

    latency is the event value in hundredths, tokens and groundedness come from
    the JSON property ``k``, the topic is the event type and its error type
    sets status and thumbs.
    """
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        "event_id",
        "ts",
        "user_id",
        F.round(F.col("value") * 100).cast("bigint").alias("latency_ms"),
        k.alias("total_tokens"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
        F.col("event_type").alias("topic"),
        (k / 100.0).alias("groundedness"),
        F.when(F.col("event_type") == "error", "down")
        .when(F.col("event_type") == "purchase", "up")
        .alias("user_feedback"),
    )


def _day(ts: str = "ts") -> Column:
    return F.to_date(ts)


def traces_from_requests(requests: DataFrame) -> DataFrame:
    """Traces with nested spans: a root and its three stages per request."""
    k, total = F.col("total_tokens"), F.col("latency_ms")
    retrieval = F.floor(total * k / 400)
    orchestration = F.floor(total * 5 / 100)

    def span(number: int, parent: int | None, kind: str, duration: Column) -> Column:
        return F.struct(
            F.lit(number).cast("bigint").alias("span_id"),
            F.lit(parent).cast("bigint").alias("parent_id"),
            F.lit(kind).alias("span_type"),
            duration.cast("bigint").alias("duration_ms"),
        )

    spans = F.array(
        span(0, None, "AGENT", total),
        span(1, 0, "RETRIEVER", retrieval),
        span(2, 0, "CHAIN", orchestration),
        span(3, 0, "CHAT_MODEL", F.floor((total - retrieval - orchestration) * 9 / 10)),
    )
    return requests.select(
        F.col("request_id").alias("trace_id"),
        "ts",
        F.col("status"),
        total.alias("execution_time_ms"),
        F.create_map(F.lit("app"), F.col("topic"), F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
        spans.alias("spans"),
    )


def search_traces(
    traces: DataFrame,
    conditions: list[tuple[str, str, object]],
    newest_first: str | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Traces that meet every ``(field, op, value)`` condition.

    Fields are ``attributes.<column>``, ``tags.<key>`` or ``metadata.<key>``;
    names and values are case-sensitive and conditions only combine by AND.
    """
    out = traces
    for field, op, value in conditions:
        table, _, name = field.partition(".")
        if op not in OPS:
            raise ValueError(f"unknown operator {op!r}")
        if table == "attributes" and name in traces.columns:
            column = F.col(f"`{name}`")
        elif table in ("tags", "metadata") and table in traces.columns and name:
            column = F.col(table)[name]
        else:
            raise ValueError(f"unknown trace field {field!r}")
        out = out.where(OPS[op](column, F.lit(value)))
    if newest_first:
        out = out.orderBy(F.col(newest_first).desc(), F.col("trace_id"))
    return out.limit(max_results) if max_results else out


def flatten_spans(traces: DataFrame) -> DataFrame:
    """One row per span.

    The outer form with a later filter: for the plain form Spark would test
    ``size(spans) > 0`` beforehand and so compute the spans twice.
    """
    rows = traces.select("trace_id", F.explode_outer("spans").alias("s"))
    return rows.where(F.col("s").isNotNull()).select("trace_id", "s.*")


SPANS_IN_ROW = 64  # spans of a trace whose children are looked for inside the row


def exclusive_times(traces: DataFrame) -> DataFrame:
    """Spans with their own time: duration less the duration of direct children.

    A trace carries its spans in one row, so the children of a short trace are
    summed inside the row and nothing is shuffled.  That takes the square of the
    spans; longer traces are exploded, and children are summed by their parent.
    """

    def own(s: Column) -> Column:
        children = F.filter(F.col("spans"), lambda c: c["parent_id"] == s["span_id"])
        used = F.aggregate(children, F.lit(0).cast("bigint"), lambda acc, c: acc + c["duration_ms"])
        return s.withField("exclusive_ms", s["duration_ms"] - used)

    short = traces.where(F.size("spans") <= SPANS_IN_ROW)
    in_row = flatten_spans(short.withColumn("spans", F.transform("spans", own)))
    long = flatten_spans(traces.where(F.size("spans") > SPANS_IN_ROW))
    used = long.where("parent_id IS NOT NULL").groupBy(F.col("trace_id").alias("_trace"), F.col("parent_id").alias("_span")).agg(
        F.sum("duration_ms").alias("_used")
    )
    same = (F.col("trace_id") == F.col("_trace")) & (F.col("span_id") == F.col("_span"))
    joined = long.join(used, same, "left").withColumn(
        "exclusive_ms", F.col("duration_ms") - F.coalesce("_used", F.lit(0).cast("bigint"))
    )
    return in_row.unionByName(joined.drop("_trace", "_span", "_used"))


def critical_path(traces: DataFrame) -> DataFrame:
    """``trace_id``, ``depth`` (0: the root), ``span_id``, ``span_type``, ``duration_ms`` and ``exclusive_ms`` of the slowest path.

    The path starts at the longest root span and goes on to the longest child,
    ties to the smaller span, down to a span without children.  Every span points
    to its longest child; the path grows by pointer doubling, so the number of
    joins follows the logarithm of the depth, and a trace of any size is spread
    over tasks.  Spans that no root leads to, such as loops, are on no path.
    """
    spans = cut_lineage(exclusive_times(traces))
    longest = F.max(F.struct("duration_ms", (-F.col("span_id")).alias("order"))).alias("_best")
    heads = spans.where("parent_id IS NULL").groupBy("trace_id").agg(longest)
    path = cut_lineage(heads.select("trace_id", (-F.col("_best.order")).alias("span_id"), F.lit(0).alias("depth")))
    children = spans.where("parent_id IS NOT NULL").groupBy("trace_id", "parent_id").agg(longest)
    step = cut_lineage(
        children.select("trace_id", F.col("parent_id").alias("span_id"), (-F.col("_best.order")).alias("_next"))
    )
    stride = 1
    while True:
        further = path.join(step, ["trace_id", "span_id"]).select(
            "trace_id", F.col("_next").alias("span_id"), (F.col("depth") + stride).alias("depth")
        )
        further = cut_lineage(further)
        if further.isEmpty():
            break
        path = cut_lineage(path.unionAll(further))
        beyond = step.select("trace_id", F.col("span_id").alias("_next"), F.col("_next").alias("_far"))
        step = cut_lineage(step.join(beyond, ["trace_id", "_next"]).select("trace_id", "span_id", F.col("_far").alias("_next")))
        stride *= 2
    return path.join(spans, ["trace_id", "span_id"]).select(
        "trace_id", "depth", "span_id", "span_type", "duration_ms", "exclusive_ms"
    )


def stage_profile(spans: DataFrame) -> DataFrame:
    """Mean exclusive time per span type, its share and the bottleneck flag."""
    means = spans.groupBy("span_type").agg(F.avg("exclusive_ms").alias("mean_ms"))
    every = Window.partitionBy()  # one row per span type
    grand, top = F.sum("mean_ms").over(every), F.max("mean_ms").over(every)
    return means.select(
        "span_type",
        F.round("mean_ms", 4).alias("mean_ms"),
        F.round(F.lit(100.0) * F.col("mean_ms") / grand, 1).alias("pct"),
        (F.col("mean_ms") == top).alias("bottleneck"),
    )


def daily_metrics(requests: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Requests, p50, p95 and error rate per day, over a look-back window if given."""
    rows = requests
    if as_of and days:
        start = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
        rows = rows.where(F.col("ts") >= start)
    error = F.avg(F.when(F.col("status") == "ERROR", 1).otherwise(0))
    return daily_percentiles(
        rows,
        _day(),
        "latency_ms",
        {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
        [F.round(error, 4).alias("error_rate")],
    )


def quality_trend(requests: DataFrame, scores: list[str]) -> DataFrame:
    """Mean of each score per day."""
    return requests.groupBy(_day().alias("day")).agg(
        *[F.round(F.avg(s), 3).alias(f"avg_{s}") for s in scores]
    )


def category_mix(requests: DataFrame, category: str) -> DataFrame:
    """Requests and thumbs-down per category."""
    down = F.count_if(F.col("user_feedback") == "down")
    return requests.groupBy(category).agg(F.count("*").alias("n"), down.alias("thumbs_down"))


def request_detail(requests: DataFrame, columns: list[str], rows: int = 200) -> DataFrame:
    """The newest requests, ties by id."""
    return requests.orderBy(F.col("ts").desc(), F.col("request_id")).select(*columns).limit(rows)


def latest_day(requests: DataFrame) -> DataFrame:
    """Requests of the most recent day in the data.

    The newest day is read first as a scalar, so the scan filters on ``ts``
    itself and files of older days are skipped.
    """
    newest = requests.agg(F.date_trunc("DAY", F.max("ts"))).scalar()
    return requests.where(F.col("ts") >= newest.cast("timestamp_ntz"))


def static_alerts(requests: DataFrame, other_topic: str, other_limit: int, p95_limit: int) -> DataFrame:
    """Two fixed-threshold alerts over the most recent day, one row each."""
    day = latest_day(requests).agg(
        F.count_if(F.col("topic") == other_topic).cast("double").alias("other_count_latest_day"),
        F.percentile_approx("latency_ms", 0.95).cast("double").alias("p95_latency_ms_latest_day"),
    )
    limits = F.create_map(
        F.lit("other_count_latest_day"), F.lit(float(other_limit)),
        F.lit("p95_latency_ms_latest_day"), F.lit(float(p95_limit)),
    )
    rows = day.unpivot([], list(day.columns), "alert", "value")
    return rows.withColumn("threshold", limits[F.col("alert")]).withColumn(
        "fired", F.col("value") > F.col("threshold")
    )


def daily_series(requests: DataFrame, other_topic: str) -> DataFrame:
    """Daily p95 latency and catch-all topic count."""
    other = F.sum(F.when(F.col("topic") == other_topic, 1).otherwise(0)).alias("other_count")
    return daily_percentiles(requests, _day(), "latency_ms", {"p95_latency_ms": 0.95}, [other])


def baseline_anomalies(daily: DataFrame, series: list[str], rows: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Trailing-baseline flags for several daily series, as rows."""
    long = daily.select("day", *[F.col(s).cast("double").alias(s) for s in series]).unpivot(
        ["day"], series, "series", "value"
    )
    based = trailing_baseline(long, "value", "day", ["series"], rows)
    return based.withColumn(
        "flag", sigma_flag(F.col("value"), F.col("baseline_mean"), F.col("baseline_sd"), sigmas)
    )


def topic_drift(requests: DataFrame, other_topic: str) -> DataFrame:
    """Daily share of the catch-all topic with its trailing-baseline flag."""
    share = F.avg(F.when(F.col("topic") == other_topic, 1.0).otherwise(0.0)).alias("other_share")
    daily = requests.groupBy(_day().alias("day")).agg(share)
    return baseline_anomalies(daily, ["other_share"])


def failure_split(rows: DataFrame, retrieval: str, grounded: str, low: float = 0.5, good: float = 0.85) -> DataFrame:
    """Weak retrieval first; an unsupported answer only when the context was good."""
    kind = (
        F.when(F.col(retrieval) < low, "retrieval_failure")
        .when(F.col(grounded) < good, "unsupported_answer")
        .otherwise("ok")
    )
    return rows.withColumn("failure", kind)


def failing(requests: DataFrame, grounded_min: float = 0.85) -> DataFrame:
    """Thumbs-down or weakly grounded requests."""
    return requests.where((F.col("user_feedback") == "down") | (F.col("groundedness") < grounded_min))


def usage(requests: DataFrame, keys: list[str], period: Column, name: str = "period") -> DataFrame:
    """Calls and tokens per caller and period."""
    return requests.groupBy(*keys, period.alias(name)).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens")
    )


def budget_alerts(spend: DataFrame, keys: list[str], period: str, value: str, cap: float) -> DataFrame:
    """Running spend per key against its cap, over per-period totals."""
    run = period_measures(spend, value, period, keys, 7)
    return run.withColumn("over_budget", F.col("running_total") >= cap)


def engagement(requests: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per user over the last ``days`` days: active days, requests and failures."""
    end = F.date_add(F.lit(as_of).cast("date"), 1)
    start = F.date_sub(end, days)
    rows = requests.where(
        (F.col("ts") >= start.cast("timestamp_ntz")) & (F.col("ts") < end.cast("timestamp_ntz"))
    )
    # one row per (user, day) first, so the distinct count works on few rows
    daily = rows.groupBy("user_id", _day().alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "ERROR").alias("failures")
    )
    return daily.groupBy("user_id").agg(
        F.count("day").alias("active_days"),
        F.sum("requests").alias("requests"),
        F.sum("failures").alias("failures"),
        (F.count("day") > 1).alias("recurring"),
    )


def session_rollup(turns: DataFrame) -> DataFrame:
    """Turns, size, first and last message per session."""
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.sum(F.length("text")).alias("chars"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
    )


def with_texts(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """Requests with the first question and the first answer of their conversation.

    Requests without a question are left out.
    """

    def first_of(role: str) -> Column:
        mine = F.col("role") == role
        return F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn")))

    texts = turns.groupBy(F.col("conv_id").alias("event_id")).agg(
        first_of("user").alias("user_question"), first_of("assistant").alias("agent_response")
    )
    return requests.join(texts.where(F.col("user_question").isNotNull()), "event_id")


def request_metrics(
    rows: DataFrame, topics: dict[str, list[str]], positive: list[str], negative: list[str], toxic: list[str],
    summary_words: int = 20,
) -> DataFrame:
    """The 16-column contract: one row per request, every metric a column.

    Scores, topic, mood and summary are added in one pass over the rows.
    """
    question, answer = F.col("user_question"), F.col("agent_response")
    staged = rows.withColumns({"_in": tx.word_count(question), "_out": F.coalesce(tx.word_count(answer), F.lit(0))})
    return staged.select(
        "request_id", "ts", "user_question", "agent_response", "latency_ms",
        F.col("_in").cast("bigint").alias("input_tokens"),
        F.col("_out").cast("bigint").alias("output_tokens"),
        (F.col("_in") + F.col("_out")).cast("bigint").alias("total_tokens"),
        "status",
        token_support(question, answer).alias("relevance"),
        F.when(answer.isNotNull(), F.when(toxic_words(answer, toxic) > 0, 0.0).otherwise(1.0)).alias("safety"),
        token_support(answer, question).alias("groundedness"),
        "user_feedback",
        classify(question, topics, other="Other").alias("topic"),
        sentiment(question, positive, negative).alias("sentiment"),
        summarize(summary_words)(answer).alias("answer_summary"),
    )


def curate_failures(metrics: DataFrame, dataset: DataFrame, question: str = "user_question") -> DataFrame:
    """Questions of failing requests appended to an evaluation set as its next version."""
    asked = failing(metrics).select(F.col(question).alias("question"))
    return merge_records(dataset, asked, ["question"])


def attach_feedback(requests: DataFrame, feedback: DataFrame, key: str = "request_id", order: str = "ts") -> DataFrame:
    """Left join of requests with the latest feedback on each."""
    latest = latest_by_key(feedback, [key], [F.col(order)])
    return requests.join(latest.drop(order), key, "left")
