"""Source and sink queries (A) over the whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.queries.registry import query
from larkspur.queries.shared import REQUESTS
from larkspur.session import work_dir
from larkspur.sources import changes, files, seeds, writes
from larkspur.sources.keyed import KeyedTable
from larkspur.operators import telemetry as tm


PAGE_ROWS = "SELECT page_id, count(*) AS times, md5(html) AS digest FROM pages GROUP BY page_id, html"


def page_files(t) -> str:
    """The pages as text files, one JSON object per line."""
    folder = work_dir(t.spark, "page-files")
    t.pages.select(F.to_json(F.struct("page_id", "html"))).write.text(folder)
    return folder


def pages_in(binary):
    """Page rows rebuilt from the contents of binary file rows."""
    line = F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")
    page = F.from_json("line", "page_id bigint, html string").alias("page")
    rows = binary.select(line).where("line <> ''").select(page).select("page.*")
    return rows.groupBy("page_id", "html").agg(F.count("*").alias("times")).select(
        "page_id", "times", F.md5("html").alias("digest")
    )


@query("a1_binary_scan", PAGE_ROWS)
def _(t):
    """Files scanned as bytes give every page back."""
    return pages_in(files.read_binary(t.spark, page_files(t), "*.txt"))


@query("a2_incremental_ingest", PAGE_ROWS)
def _(t):
    """Two runs over the same folder: the second finds nothing new, and the stored contents give every page once."""
    landing, out, state = page_files(t), work_dir(t.spark, "bronze"), work_dir(t.spark, "bronze-state")
    for _run in range(2):
        stream = files.ingest_stream(t.spark, landing, "*.txt")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", state)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    return pages_in(t.spark.read.parquet(out))


@query("a3_file_provenance", "SELECT 'orders.parquet' AS source_file, count(*) AS n FROM orders")
def _(t):
    rows = files.with_provenance(t.orders)
    name = F.element_at(F.split("source_path", "/"), -1)
    return rows.groupBy(name.alias("source_file")).agg(F.count("*").alias("n"))


@query("a4_batch_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


@query("a5_table_stream", """
SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS user_sum FROM events GROUP BY 1""")
def _(t):
    out, state = work_dir(t.spark, "copied"), work_dir(t.spark, "copied-state")
    stream = files.table_stream(t.spark, t.path("events"), t.events.schema)
    writer = stream.select("event_id", "user_id", "event_type").writeStream.format("parquet")
    writer.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("user_id").alias("user_sum")
    )


BOOKINGS = """flights(flight_id, route_id, origin_airport, region) AS (VALUES
  ('FL001','SFO-JFK','SFO','AMER'), ('FL002','JFK-LHR','JFK','AMER'), ('FL003','LHR-DXB','LHR','EMEA'),
  ('FL004','DXB-SIN','DXB','EMEA'), ('FL005','SIN-NRT','SIN','APAC'), ('FL006','NRT-SFO','NRT','APAC'),
  ('FL007','SFO-LHR','SFO','AMER'), ('FL008','JFK-DXB','JFK','AMER')),
bookings AS (
  SELECT k AS booking_id, printf('FL%03d', k * 5 % 8 + 1) AS flight_id, printf('CUST%02d', k * 3 % 10 + 1) AS customer_id,
    ['Economy', 'Premium', 'Business', 'First'][k * 7 % 4 + 1] AS fare_class,
    ['Direct', 'OTA', 'Agent', 'Mobile'][k * 3 % 4 + 1] AS channel,
    CAST(DATE '2025-01-01' + CAST(k * 17 % 365 AS INT) AS DATE) AS booking_date,
    80 + k * 19 % 64 * 12.5::DOUBLE AS base_fare_usd, k * 4 % 13 * 7.5::DOUBLE AS ancillary_usd, k * 2 % 5 + 1 AS seats,
    ['flown', 'flown', 'booked', 'flown', 'cancelled', 'flown', 'booked'][k * 2 % 7 + 1] AS status
  FROM (SELECT o_orderkey AS k FROM orders))"""


@query("a6_inline_rows", """
SELECT region, count(*) AS orders FROM (
  SELECT CASE o_orderkey % 8 WHEN 0 THEN 'AMER' WHEN 1 THEN 'AMER' WHEN 2 THEN 'EMEA' WHEN 3 THEN 'EMEA'
              WHEN 4 THEN 'APAC' WHEN 5 THEN 'APAC' WHEN 6 THEN 'AMER' ELSE 'AMER' END AS region FROM orders)
GROUP BY 1""")
def _(t):
    flights = seeds.dim_flights(t.spark).join(
        seeds.dim_airports(t.spark), F.col("origin_airport") == F.col("airport_code")
    )
    keyed = t.orders.select(
        F.concat(F.lit("FL"), F.lpad((F.col("o_orderkey") % 8 + 1).cast("string"), 3, "0")).alias("flight_id")
    )
    return keyed.join(flights, "flight_id").groupBy("region").agg(F.count("*").alias("orders"))


@query("a7_booking_generator", f"""
WITH {BOOKINGS}
SELECT booking_id, b.flight_id, customer_id, route_id, CAST(booking_date AS VARCHAR) AS booking_date,
       CAST(booking_date + CAST(10 + booking_id * 9 % 40 AS INT) AS VARCHAR) AS travel_date,
       fare_class, channel, base_fare_usd, ancillary_usd, CAST(seats AS BIGINT) AS seats, status
FROM bookings b JOIN flights f ON b.flight_id = f.flight_id""")
def _(t):
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    return seeds.bookings(ids, seeds.dim_flights(t.spark))


MEMBERS = {
    "level": seeds.Cycle(("none", "bronze", "silver"), 2),
    "joined": seeds.Days("2020-01-01", 1000, 7),
}


@query("a7_yearly_bookings", f"""
WITH {BOOKINGS}, members AS (SELECT c_custkey AS member_id, ['none', 'bronze', 'silver'][c_custkey * 2 % 3 + 1] AS level FROM customer),
owned AS (SELECT b.*, o_custkey FROM bookings b JOIN orders ON booking_id = o_orderkey)
SELECT quarter(booking_date) AS quarter, level, fare_class, channel, count(*) AS bookings, sum(base_fare_usd + ancillary_usd) AS income,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled
FROM owned LEFT JOIN members ON o_custkey = member_id GROUP BY 1, 2, 3, 4""")
def _(t):
    """A year of bookings, one per order, by quarter, level of the member, class and channel."""
    members = seeds.generate(t.customer.select(F.col("c_custkey").alias("id")), "member_id", MEMBERS)
    made = seeds.generate(t.orders.select(F.col("o_orderkey").alias("id")), "booking_id", seeds.BOOKING_COLUMNS)
    owners = t.orders.select(F.col("o_orderkey").alias("booking_id"), F.col("o_custkey").alias("member_id"))
    rows = made.join(owners, "booking_id").join(members, "member_id", "left")
    return rows.groupBy(F.quarter("booking_date").cast("bigint").alias("quarter"), "level", "fare_class", "channel").agg(
        F.count("*").alias("bookings"), F.sum(F.col("base_fare_usd") + F.col("ancillary_usd")).alias("income"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    )


@query("a8_create_or_replace", """
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(t):
    kept = t.documents.where(F.col("text").isNotNull()).select("doc_id", "lang", "n_chars")
    stored = writes.create_or_replace(kept, work_dir(t.spark, "created"))
    return stored.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a9_seed_when_empty", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(t):
    path = work_dir(t.spark, "seeded")
    rows = t.events.select("event_id", "event_type")
    writes.seed_when_empty(rows, path)
    return writes.seed_when_empty(rows, path).agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")
    )


@query("a10_insert_overwrite", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    path = work_dir(t.spark, "overwritten")
    writes.create_or_replace(t.supplier.select("s_suppkey", F.lit("supplier").alias("segment")), path)
    stored = writes.insert_overwrite(t.customer.select("c_custkey", "c_mktsegment"), path)
    return stored.groupBy("segment").agg(F.count("*").alias("n"))


@query("a11_append", """
SELECT kind, count(*) AS n, CAST(sum(key) AS BIGINT) AS key_sum FROM (
  SELECT 'customer' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier)
GROUP BY 1""")
def _(t):
    path = work_dir(t.spark, "appended")
    writes.append(t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")), path)
    stored = writes.append(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key")), path)
    return stored.groupBy("kind").agg(F.count("*").alias("n"), F.sum("key").alias("key_sum"))


UPSERTED = """
WITH updates AS (
  SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'Y', o_totalprice * 3, o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'Z', o_totalprice, o_orderdate - INTERVAL 2 DAY FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey + 1000000000, 'N', o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O'),
both_sides AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders UNION ALL SELECT * FROM updates),
last AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) AS rn FROM both_sides)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
FROM last WHERE rn = 1"""


def order_updates(t):
    """Orders and changes to them: newer, twice, older and new ones."""
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")

    def change(status: str, mark: str, days: int, factor: int, key_shift: int = 0):
        return target.where(F.col("o_orderstatus") == status).select(
            (F.col("o_orderkey") + key_shift).alias("o_orderkey"),
            F.lit(mark).alias("o_orderstatus"),
            (F.col("o_totalprice") * factor).alias("o_totalprice"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("o_orderdate"),
        )

    updates = change("P", "X", 1, 2).union(change("P", "Y", 2, 3)).union(change("F", "Z", -2, 1))
    updates = updates.union(change("O", "N", 0, 1, 1_000_000_000))
    return target, updates


def shown(merged):
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 2)).withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("a12_upsert", UPSERTED)
def _(t):
    return shown(changes.upsert(*order_updates(t), ["o_orderkey"], "o_orderdate"))


@query("a12_bucketed_merge", UPSERTED)
def _(t):
    """The same merge into a table in buckets, one kind of change after the other."""
    target, updates = order_updates(t)
    table = KeyedTable(t.spark, work_dir(t.spark, "keyed")).create(target, ["o_orderkey"])
    for marks in (["X", "Z"], ["Y", "N"]):
        table = table.merge(updates.where(F.col("o_orderstatus").isin(marks)), "o_orderdate")
    return shown(table.rows())


@query("a13_overwrite_schema", "SELECT doc_id, lang, n_chars > 1000 AS is_long FROM documents")
def _(t):
    path = work_dir(t.spark, "reshaped")
    writes.create_or_replace(t.documents.select("doc_id"), path)
    return writes.create_or_replace(
        t.documents.select("doc_id", "lang", (F.col("n_chars") > 1000).alias("is_long")), path
    )


FEED = """
SELECT o_orderkey, 'update' AS op FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey + 1000000000, 'insert' FROM orders WHERE o_orderstatus = 'O'"""


def order_versions(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    status = F.col("o_orderstatus")
    price = F.when(status == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = old.where((F.col("o_orderpriority") != "1-URGENT") | (status == "P")).withColumn("o_totalprice", price)
    added = old.where(status == "O").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return old, kept.unionByName(added)


@query("a14_change_feed", FEED)
def _(t):
    return changes.diff_snapshots(*order_versions(t), ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


@query("a14_feed_between_versions", FEED)
def _(t):
    """Two snapshots loaded into one bucketed table; only buckets with different digests are compared."""
    old, new = order_versions(t)
    before = KeyedTable(t.spark, work_dir(t.spark, "snapshots")).create(old, ["o_orderkey"])
    after = before.create(new, ["o_orderkey"])
    return before.changes_to(after, ["o_totalprice", "o_orderpriority"])


@query("a16_clustered_layout", "SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def _(t):
    rows = t.documents.select("doc_id", "source", "lang", "n_chars")
    stored = writes.write_clustered(rows, work_dir(t.spark, "clustered"), ["source"])
    return stored.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("a16_curve_layout", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, true AS few FROM lineitem
WHERE l_partkey BETWEEN (SELECT quantile_disc(l_partkey, 0.4) FROM lineitem) AND (SELECT quantile_disc(l_partkey, 0.5) FROM lineitem)
  AND l_extendedprice BETWEEN 20000 AND 30000 GROUP BY 1""")
def _(t):
    """A filter on two columns of a table laid along a curve over both, and whether it opened less than half of the files."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    columns = ["l_partkey", "l_extendedprice"]
    stored = writes.write_curve(rows, work_dir(t.spark, "curve"), columns, files=32)
    index = writes.write_file_index(stored, columns, work_dir(t.spark, "curve-files"))
    low, high = t.lineitem.select(F.percentile_approx("l_partkey", [0.4, 0.5], 1_000_000)).first()[0]
    found, files = writes.read_ranges(stored, index, {"l_partkey": (low, high), "l_extendedprice": (20_000, 30_000)})
    return found.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.lit(2 * files < index.count()).alias("few")
    )


@query("a17_merge_records", f"""
WITH {REQUESTS},
existing AS (SELECT conv_id AS question_id, 1 AS version FROM conversations GROUP BY 1),
fresh AS (SELECT DISTINCT event_id AS question_id FROM requests WHERE user_feedback = 'down' OR groundedness < 0.85)
SELECT question_id, CAST(version AS BIGINT) AS version FROM existing
UNION ALL SELECT question_id, 2 FROM fresh WHERE question_id NOT IN (SELECT question_id FROM existing)""")
def _(t):
    existing = t.conversations.select(F.col("conv_id").alias("question_id")).distinct().withColumn("version", F.lit(1))
    failed = tm.failing(tm.requests_from_events(t.events)).select(F.col("event_id").alias("question_id"))
    return changes.merge_records(existing, failed, ["question_id"])
