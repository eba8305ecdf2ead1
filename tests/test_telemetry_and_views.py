import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.operators import telemetry as tm
from larkspur.operators.relational import orphans, reconcile, where_equal, where_sql
from larkspur.plans import metric_view as mv
from larkspur.queries.semantic import SALES, TRIPS
from larkspur.sources import seeds

# Day, latency, topic, groundedness and feedback of the seeded requests.
SEEDED = [
    (6, 1820, "Check-in", 0.95, "up"), (6, 2510, "Baggage", 0.90, None), (7, 1990, "Cancellation", 0.86, "down"),
    (7, 1750, "Baggage", 0.94, "up"), (8, 2120, "Loyalty", 0.88, None), (8, 3010, "Check-in", 0.80, "down"),
    (9, 2280, "Refunds", 0.87, "down"), (9, 1680, "Refunds", 0.93, "up"), (10, 2350, "Baggage", 0.89, None),
    (10, 2740, "Cancellation", 0.85, "down"), (11, 1900, "Check-in", 0.91, "up"), (11, 1770, "Baggage", 0.92, None),
    (12, 2050, "Other", 0.70, "down"), (12, 1980, "Other", 0.68, "down"), (12, 2200, "Other", 0.69, None),
    (12, 8200, "Refunds", 0.82, "down"),
]


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        (f"tr-{i:04d}", dt.datetime(2026, 7, day, 9, i), latency, topic, "OK", ground, thumbs)
        for i, (day, latency, topic, ground, thumbs) in enumerate(SEEDED, 1)
    ]
    return spark.createDataFrame(
        rows, "request_id string, ts timestamp_ntz, latency_ms bigint, topic string, status string, groundedness double, user_feedback string"
    )


def test_last_day_is_flagged_on_both_series(requests):
    daily = tm.daily_series(requests, "Other")
    flags = tm.baseline_anomalies(daily, ["p95_latency_ms", "other_count"]).where("flag = 'ANOMALY'")
    found = {(str(r["day"]), r["series"]) for r in flags.collect()}
    assert {("2026-07-12", "p95_latency_ms"), ("2026-07-12", "other_count")} <= found


def test_first_and_second_baseline_rows(spark):
    rows = [(dt.date(2026, 7, d), "s", v) for d, v in ((1, 5.0), (2, 6.0), (3, 5.5))]
    daily = spark.createDataFrame(rows, "day date, series string, value double").drop("series").withColumnRenamed("value", "s")
    got = [(r["flag"], r["baseline_sd"]) for r in tm.baseline_anomalies(daily, ["s"]).orderBy("day").collect()]
    assert got[0] == ("ok", None) and got[1] == ("ANOMALY", None) and got[2][0] == "ok"


def test_static_alerts_fire(requests):
    fired = {r["alert"]: (r["value"], r["fired"]) for r in tm.static_alerts(requests, "Other", 2, 5000).collect()}
    assert fired == {"other_count_latest_day": (3.0, True), "p95_latency_ms_latest_day": (8200.0, True)}


def test_curation_takes_thumbs_down_and_weak_rows(spark, requests):
    assert tm.failing(requests).count() == 8
    asked = requests.withColumn("user_question", F.col("topic"))
    dataset = spark.createDataFrame([("Refunds", 1)], "question string, version int")
    grown = tm.curate_failures(asked, dataset)
    assert {(r["question"], r["version"]) for r in grown.collect()} == {
        ("Refunds", 1), ("Cancellation", 2), ("Check-in", 2), ("Other", 2),
    }


def test_latest_feedback_wins(spark, requests):
    feedback = spark.createDataFrame(
        [("tr-0001", dt.datetime(2026, 7, 7), "bad"), ("tr-0001", dt.datetime(2026, 7, 8), "good")],
        "request_id string, ts timestamp_ntz, comment string",
    )
    out = tm.attach_feedback(requests.select("request_id"), feedback)
    assert {r["comment"] for r in out.where("request_id = 'tr-0001'").collect()} == {"good"} and out.count() == 16


def test_trace_conditions_are_checked(requests):
    traces = tm.traces_from_requests(requests.withColumns({"total_tokens": F.lit(10), "user_id": F.lit(1)}))
    assert tm.search_traces(traces, [("tags.app", "=", "Other")]).count() == 3
    assert tm.search_traces(traces, [("tags.app", "=", "other")]).count() == 0
    for field, op in (("app", "="), ("attributes.nope", "="), ("tags.app", "like")):
        with pytest.raises(ValueError):
            tm.search_traces(traces, [(field, op, "x")])


def test_exclusive_times_add_up(requests):
    traces = tm.traces_from_requests(requests.withColumns({"total_tokens": F.lit(40), "user_id": F.lit(1)}))
    sums = tm.exclusive_times(traces).groupBy("trace_id").agg(
        F.sum("exclusive_ms").alias("own"), F.max("duration_ms").alias("total")
    )
    assert sums.where("own <> total").isEmpty()


def test_filters_refuse_unknown_columns(requests):
    with pytest.raises(ValueError):
        where_equal(requests, {"sourcedoc": "faq"})
    with pytest.raises(Exception):
        where_sql(requests, "sourcedoc = 'faq'")


# ---- the booking star ------------------------------------------------------


@pytest.fixture(scope="module")
def star(spark):
    flights = seeds.dim_flights(spark)
    return {
        "bookings": seeds.bookings(spark.range(240), flights), "flights": flights,
        "airports": seeds.dim_airports(spark), "customers": seeds.dim_customers(spark),
    }


def test_seed_counts_and_integrity(star):
    assert [star[n].count() for n in ("bookings", "flights", "customers", "airports")] == [240, 8, 10, 6]
    assert orphans(star["bookings"], star["flights"], "flight_id", "flight_id").isEmpty()
    first = star["bookings"].where("booking_id = 1").first()
    assert (first["flight_id"], first["customer_id"], first["status"], first["base_fare_usd"]) == ("FL006", "CUST04", "booked", 317.5)


def test_generated_rows_depend_on_the_id_alone(spark):
    rules = {"level": seeds.Cycle(("a", "b", "c"), 2), "n": seeds.Ladder(1, 2, 4), "day": seeds.Days("2024-02-28", 3)}
    once = seeds.generate(spark.range(12), "k", rules)
    again = seeds.generate(spark.range(12).repartition(3), "k", rules)
    assert once.exceptAll(again).isEmpty()
    got = [tuple(map(str, r)) for r in once.orderBy("k").limit(4).collect()]
    assert got == [("0", "a", "1", "2024-02-28"), ("1", "c", "3", "2024-02-29"), ("2", "b", "5", "2024-03-01"), ("3", "a", "7", "2024-02-28")]


def test_view_totals_agree_at_every_grain(star):
    TRIPS.validate(star)
    grand = TRIPS.query(star, [], ["Income", "Trips", "Lost Share"]).first()
    by_class = TRIPS.query(star, ["Cabin"], ["Income", "Trips"]).collect()
    assert sum(r["Income"] for r in by_class) == pytest.approx(grand["Income"])
    assert sum(r["Trips"] for r in by_class) == grand["Trips"] == 240
    assert grand["Lost Share"] == pytest.approx(star["bookings"].where("status = 'cancelled'").count() / 240)
    assert TRIPS.query(star, ["Departure Region"], ["Trips"]).where("`Departure Region` IS NULL").isEmpty()


def test_only_reached_tables_are_joined(star):
    plan = TRIPS.query(star, ["Cabin"], ["Trips"])._jdf.queryExecution().optimizedPlan().toString()
    assert "loyalty_tier" not in plan and "airport_code" not in plan


def test_added_measure_keeps_old_answers(star):
    more = TRIPS.with_measure(
        mv.Measure("Lost Trips", "COUNT(1) FILTER (WHERE source.status = 'cancelled')", additive=True)
    )
    old = TRIPS.query(star, ["Sold Through"], ["Income"])
    new = more.query(star, ["Sold Through"], ["Income", "Lost Trips"])
    checked = reconcile(
        old.withColumnRenamed("Income", "v"), new.withColumnRenamed("Income", "v"), ["Sold Through"], "v"
    )
    assert checked.where(~F.col("agrees")).isEmpty()


def test_broken_definitions_and_queries(tables):
    bad_dimension = mv.MetricView("lineitem", (mv.Dimension("D", "SUM(source.l_tax)"),), SALES.measures)
    bare = mv.MetricView("lineitem", SALES.dimensions[:1], (mv.Measure("M", "source.l_tax"),))
    for broken in (bad_dimension, bare):
        with pytest.raises(mv.MetricViewError):
            broken.validate(tables)
    for dims, measures in ((["Line Count"], ["Total Revenue"]), (["*"], ["Total Revenue"]), (["Colour"], ["Total Revenue"]), (["Brand"], ["Nope"]), (["Brand"], [])):
        with pytest.raises(mv.MetricViewError):
            SALES.query(tables, dims, measures)


def test_slice_refuses_what_it_cannot_answer(star):
    part = TRIPS.materialize(star, ["Sold Through"], ["Income"])
    assert part.columns == ["Sold Through", "Income::value"]
    with pytest.raises(mv.MetricViewError):
        TRIPS.query(star, ["Cabin"], ["Income"], slice_rows=part)
    with pytest.raises(mv.MetricViewError):
        TRIPS.materialize(star, ["Sold Through"], ["Mean Fare"])


def test_synonyms_resolve(spark):
    terms = spark.createDataFrame([("seat class",), ("takings",), ("weather",)], "term string")
    got = {r["term"]: r["field"] for r in mv.resolve_terms(terms, TRIPS.synonyms(spark)).collect()}
    assert got == {"seat class": "Cabin", "takings": "Income", "weather": None}


def test_casts_order_and_limit(star):
    out = TRIPS.query(
        star, ["Cabin"], ["Income"], order=["`Income` DESC"], limit=2, casts={"Income": "bigint"}
    )
    assert dict(out.dtypes)["Income"] == "bigint" and len(out.collect()) == 2


def test_slices_are_picked_where_they_fit(star):
    by_cabin = TRIPS.materialize(star, ["Cabin"], ["Income", "Trips"])
    finer = TRIPS.materialize(star, ["Cabin", "Sold Through", "Sold On"], ["Income"])
    other = TRIPS.materialize(star, ["Sold Through"], ["Trips"])
    slices = [finer, other, by_cabin]

    def same(dims, measures, **rest):
        got = TRIPS.answer(star, slices, dims, measures, **rest)
        want = TRIPS.query(star, dims, measures, **rest)
        shown = [F.round(m, 4).alias(m) for m in measures]
        assert sorted(map(str, got.select(*dims, *shown).collect())) == sorted(map(str, want.select(*dims, *shown).collect()))
        return got._jdf.queryExecution().optimizedPlan().toString()

    assert "customer_id" not in same(["Cabin"], ["Income", "Trips"])
    same(["Cabin"], ["Income"], where="`Sold On` >= DATE '2025-06-01'")  # only the finer slice can apply it
    same(["Departure Region"], ["Trips"])  # no slice has it
    same(["Cabin"], ["Mean Fare"])  # cannot be added up
    with pytest.raises(mv.MetricViewError):
        TRIPS.answer(star, slices, ["Cabin"], ["Nope"])


def plain_path(spans):
    """Root to leaf through the longest child, one step after the other."""
    children = {}
    for s in spans:
        children.setdefault(s[1], []).append(s)
    out, depth, at = [], 0, None
    while children.get(at):
        best = min(children[at], key=lambda s: (-s[3], s[0]))
        used = sum(c[3] for c in children.get(best[0], []))
        out.append((depth, best[0], best[2], best[3], best[3] - used))
        depth, at = depth + 1, best[0]
    return out


def test_critical_paths_equal_a_plain_walk(spark):
    """Random trees, a chain of 3,000 spans, a trace of 10,000 spans, and traces without a root, with a loop, or empty."""
    import random

    draw = random.Random(6)
    traces = {}
    for t in range(30):
        traces[f"t{t}"] = [(i, draw.randrange(i) if i else None, f"K{i % 4}", draw.randint(1, 9)) for i in range(draw.randint(1, 100))]
    traces["chain"] = [(i, i - 1 if i else None, "C", 5000 - i) for i in range(3_000)]
    traces["wide"] = [(i, draw.randrange(max(i // 2, 1)) if i else None, "W", draw.randint(1, 1000)) for i in range(10_000)]
    traces["loop"] = [(0, None, "R", 5), (1, 2, "A", 3), (2, 1, "B", 3), (3, 0, "C", 1)]
    traces["no root"] = [(1, 7, "A", 3)]
    traces["two roots"] = [(1, None, "A", 3), (2, None, "B", 4), (3, 2, "C", 4), (4, 2, "D", 4)]
    traces["empty"] = []
    schema = "trace_id string, spans array<struct<span_id:bigint,parent_id:bigint,span_type:string,duration_ms:bigint>>"
    got = {}
    for r in tm.critical_path(spark.createDataFrame(list(traces.items()), schema)).collect():
        got.setdefault(r["trace_id"], []).append((r["depth"], r["span_id"], r["span_type"], r["duration_ms"], r["exclusive_ms"]))
    assert {t: sorted(p) for t, p in got.items()} == {t: p for t, spans in traces.items() if (p := plain_path(spans))}


def test_exclusive_times_of_long_and_short_traces_agree(spark, monkeypatch):
    schema = "trace_id string, spans array<struct<span_id:bigint,parent_id:bigint,span_type:string,duration_ms:bigint>>"
    spans = [(i, (i - 1) // 3 if i else None, "S", 100 - i) for i in range(60)]
    traces = spark.createDataFrame([("a", spans), ("b", spans[:5]), ("c", None)], schema)
    inside = sorted(map(tuple, tm.exclusive_times(traces).collect()), key=str)
    monkeypatch.setattr(tm, "SPANS_IN_ROW", 3)
    assert sorted(map(tuple, tm.exclusive_times(traces).collect()), key=str) == inside and len(inside) == 65
