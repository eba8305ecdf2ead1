import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from larkspur import session
from larkspur.operators import telemetry as tm
from larkspur.operators.vectors import TextEmbedder
from larkspur.sources import changes, files, storage, writes
from larkspur.streaming import index as ix
from larkspur.streaming import ingest as ig
from larkspur.streaming import requests as rq
from larkspur.streaming import state as st
from larkspur.streaming.changelog import ChangeLog, kept_short


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upsert_keeps_the_newest_version(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "new", 6), (1, "newer", 7), (2, "old", 4), (9, "add", 1)], "k int, v string, n int")
    assert rows(changes.upsert(target, updates, ["k"], "n"), "k", "v") == [(1, "newer"), (2, "b"), (3, "c"), (9, "add")]


def test_snapshot_difference_sees_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    assert rows(changes.diff_snapshots(old, new, ["k"], ["v"]), "k", "op") == [(2, "update"), (3, "delete"), (4, "insert")]


def test_merge_records_adds_one_version(spark):
    dataset = spark.createDataFrame([("q1", 1)], "question string, version int")
    more = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "question string")
    assert rows(changes.merge_records(dataset, more, ["question"]), "question", "version") == [("q1", 1), ("q2", 2)]


def test_table_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writes.read_table(spark, path) is None
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    writes.seed_when_empty(one, path)
    assert writes.seed_when_empty(one, path).count() == 1
    assert writes.append(one.select("v", "k"), path).count() == 2
    replaced = writes.insert_overwrite(spark.createDataFrame([(7, "z")], "other int, name string"), path)
    assert rows(replaced, "k", "v") == [(7, "z")]
    with pytest.raises(ValueError):
        writes.insert_overwrite(one.select("k"), path)
    assert writes.create_or_replace(one.select("v"), path).columns == ["v"]


def test_clustered_write_spreads_a_hot_value(spark, tmp_path):
    df = spark.range(4000).withColumn("source", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)))
    out = writes.write_clustered(df, str(tmp_path / "c"), ["source"], 8)
    files_of_hot = out.where("source = 'hot'").select(F.input_file_name()).distinct().count()
    assert files_of_hot >= 2 and out.count() == 4000


def test_work_folder_follows_the_setting(spark):
    assert session.work_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and df.columns == ["id", "x"]


def test_intermediate_folders_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    kept, path = session.cut_lineage(spark.range(3)), session.work_dir(spark, "never-written")
    assert kept.count() == 3 and path in session._made
    assert session.clear_work(spark) == 1 and session._made == [] and session.clear_work(spark) == 0


PAGE = "<html><head><title>T{0}</title></head><body><p>Text {0} one. Text two.</p>{1}"


def drop(folder, number, closed=True):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"p{number}.html"), "w") as f:
        f.write(PAGE.format(number, "</body></html>" if closed else ""))


def test_files_to_chunks_in_two_drops(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    drop(landing, 1), drop(landing, 2, closed=False)

    def run():
        raw = ig.text_files(files.ingest_stream(spark, landing, "*.html"))
        ig.run_document_stream(raw, out, state, size=20, overlap=5).awaitTermination()

    run()
    drop(landing, 3)
    run()
    run()  # nothing new: nothing is added
    batch = ig.document_graph(
        files.with_provenance(files.read_binary(spark, landing)).select(
            F.col("source_path").alias("page_id"), F.decode("content", "utf-8").alias("html")
        ), size=20, overlap=5,
    )
    streamed = spark.read.parquet(f"{out}/chunks")
    assert rows(streamed, "chunk_id", "content") == rows(batch["chunks"], "chunk_id", "content")
    assert streamed.select("source_doc").distinct().count() == 2
    failed = spark.read.parquet(f"{out}/quarantine")
    assert [r["error_message"] for r in failed.collect()] == ["document is not closed"]


def test_standing_query_and_fan_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(10).write.parquet(folder)
    out = str(tmp_path / "routes")
    stream = files.table_stream(spark, folder, spark.range(0).schema)
    query = ig.fan_out(stream, out, str(tmp_path / "state"), F.col("id") < 7, every="1 second")
    query.processAllAvailable()
    spark.range(10, 12).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    got = {r["route"]: r["count"] for r in spark.read.parquet(out).groupBy("route").count().collect()}
    assert got == {"clean": 7, "quarantine": 5}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    log = ChangeLog(str(tmp_path / "log"), ("k",))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log.append(first, 0)
    log.append(first, 0)
    log.append(spark.createDataFrame([(2, "c", "put"), (1, None, "delete")], "k int, v string, _op string"), 1)
    assert log.rows(spark).count() == 4
    assert rows(log.current(spark), "k", "v") == [(2, "c")]
    assert rows(log.compact(spark, str(tmp_path / "compact")), "k", "v") == [(2, "c")]


def test_index_stream_equals_rebuild(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"word{i} common text") for i in range(20)], "k int, t string")
    model = TextEmbedder.fit(texts, "t", 64)
    feed = str(tmp_path / "feed")
    texts.select("k", "t", F.lit("insert").alias("op"), F.lit(1).alias("seq")).coalesce(1).write.parquet(feed)
    log = ChangeLog(str(tmp_path / "index"), ("k",))

    def run():
        stream = files.table_stream(spark, feed, spark.read.parquet(feed).schema)
        ix.run_index_stream(stream, log, str(tmp_path / "state"), model, "k", "t", "seq").awaitTermination()

    run()
    late = [(3, "new words", "update", 2), (3, "newest words", "update", 3), (4, None, "delete", 2), (99, "added", "insert", 2)]
    spark.createDataFrame(late, "k int, t string, op string, seq int").coalesce(1).write.mode("append").parquet(feed)
    run()
    now = texts.where("k NOT IN (3, 4)").union(spark.createDataFrame([(3, "newest words"), (99, "added")], "k int, t string"))
    want = model.embed(now, "t").select("k", "embedding")
    got = log.current(spark).select("k", "embedding")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def events(spark, *items):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, base + dt.timedelta(minutes=m), u, 10) for i, m, u in items],
        "request_id int, ts timestamp_ntz, user_id int, total_tokens bigint",
    )


def feed_stream(spark, path, rowset):
    return files.table_stream(spark, path, rowset.schema)


def test_late_and_repeated_rows_of_the_upsert(spark, tmp_path):
    """A request delivered again counts once, a newer version wins, one beyond the delay is late, undated ones are kept."""
    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    log = ChangeLog(str(tmp_path / "log"), ("request_id",), "ts")
    undated = events(spark, (9, 0, 1)).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    drops = [
        events(spark, (1, 0, 1), (2, 200, 1), (2, 200, 1)).unionAll(undated),
        events(spark, (2, 200, 1), (3, 190, 1), (4, 150, 1), (1, 210, 7)).unionAll(undated),
        events(spark, (2, 200, 1), (5, 500, 1), (3, 120, 1)),
    ]
    for rowset in drops:
        rowset.coalesce(1).write.mode("append").parquet(feed)
        queries = rq.run_metrics_upsert(feed_stream(spark, feed, rowset), log, work, "ts")
    assert rows(log.current(spark), "request_id", "user_id") == [(1, 7), (2, 1), (3, 1), (4, 1), (5, 1), (9, 1)]
    assert rows(st.late_rows(spark, work), "request_id") == [(3,)]
    written = log.rows(spark).groupBy("request_id").count()
    assert {r[0]: r[1] for r in written.collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 9: 2}
    assert queries[1].lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_duplicate_state_is_bounded(spark, tmp_path):
    """Requests far apart in time: the state forgets those that the watermark has passed."""
    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    log = ChangeLog(str(tmp_path / "log"), ("request_id",))
    held = []
    for drop in range(4):
        rowset = events(spark, *[(1000 * drop + i, 1000 * drop + i, 1) for i in range(50)])
        rowset.coalesce(1).write.mode("append").parquet(feed)
        _intake, counting = rq.run_metrics_upsert(feed_stream(spark, feed, rowset), log, work, "ts")
        held.append(counting.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 100 and log.current(spark).count() == 200


def test_limit_stream_equals_batch(spark, tmp_path):
    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    rowset = events(spark, *[(i, i % 3 + 100 * (i // 30), i % 2) for i in range(60)])
    log = ChangeLog(str(tmp_path / "log"), ("window_start", "user_id"))

    def run(part):
        part.coalesce(1).write.mode("append").parquet(feed)
        return rq.run_limit_stream(feed_stream(spark, feed, rowset), log, work, ["user_id"], "ts", 8)

    run(rowset.where("request_id < 30"))
    undated = events(spark, (70, 0, 1)).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    run(rowset.where("request_id >= 30").unionAll(undated).unionAll(events(spark, (71, -90, 1))))
    columns = ("window_start", "user_id", "calls", "refused")
    assert rows(log.current(spark), *columns) == rows(rq.limit_report(rowset, ["user_id"], "ts", 8), *columns)
    assert rows(st.late_rows(spark, work), "request_id") == [(70,), (71,)]
    counting = run(events(spark, (80, 10_000, 1)))[1]
    run(events(spark, (81, 20_000, 1)))
    assert len(storage.names(spark, f"{work}/marks")) == 2
    assert counting.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # old windows have left the state
    compacted = kept_short(log, spark, str(tmp_path / "short"), 2)
    assert compacted.path != log.path
    assert rows(compacted.current(spark), *columns) == rows(log.current(spark), *columns)


def test_daily_counts_lose_no_row(spark, tmp_path):
    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    log = ChangeLog(str(tmp_path / "log"), ("day", "rule"))
    for part in (events(spark, (1, 0, 1), (2, 3000, 2)), events(spark, (3, 2990, 2), (4, 10, 1)), events(spark, (5, 3001, 2))):
        part.coalesce(1).write.mode("append").parquet(feed)
        rq.run_daily_counts(feed_stream(spark, feed, part), log, work, "ts", F.col("user_id"))
    assert log.current(spark).agg(F.sum("hits")).first()[0] == 4
    assert rows(st.late_rows(spark, work), "request_id") == [(4,)]


def test_repeated_intake_batch_changes_nothing(spark, tmp_path):
    """A batch that is settled again, after a crash at any step, leaves its rows once."""
    work = str(tmp_path / "work")
    st.settle(events(spark, (1, 100, 1), (2, 300, 1)), 0, work, "ts", "1 hour")
    second = events(spark, (3, 10, 1), (4, 290, 1))
    st.settle(second, 1, work, "ts", "1 hour")
    st.settle(second, 1, work, "ts", "1 hour")
    storage.remove(spark, f"{work}/marks/1")  # as if the job had ended before its mark
    st.settle(second, 1, work, "ts", "1 hour")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{work}/accepted")
    assert rows(stored, "request_id") == [(1,), (2,), (4,)]
    assert rows(st.late_rows(spark, work), "request_id") == [(3,)]
    assert st.newest_before(spark, work, 2) == st.newest_before(spark, work, 1)


def test_standing_streams_count_side_by_side(spark, tmp_path):
    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    rowset = events(spark, (1, 0, 1), (2, 1, 1), (3, 70, 2))
    rowset.coalesce(1).write.parquet(feed)
    log = ChangeLog(str(tmp_path / "log"), ("window_start", "user_id"))
    queries = rq.run_limit_stream(feed_stream(spark, feed, rowset), log, work, ["user_id"], "ts", 8, every="1 second")
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not storage.exists(spark, f"{log.path}/batch=0/_SUCCESS"):
            time.sleep(1)
        assert log.current(spark).agg(F.sum("calls")).first()[0] == 3
    finally:
        for query in queries:
            query.stop()


def test_streams_read_folders_and_single_files(spark, tmp_path):
    folder, single = str(tmp_path / "many"), str(tmp_path / "one")
    spark.range(100).repartition(3).write.parquet(folder)
    spark.range(7).coalesce(1).write.parquet(single)
    name = next(n for n in os.listdir(single) if n.endswith(".parquet"))
    for i, (path, n) in enumerate(((folder, 100), (os.path.join(single, name), 7))):
        out = str(tmp_path / f"out{i}")
        stream = files.table_stream(spark, path, spark.range(0).schema)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"state{i}"))
        writer.trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_null_keys_and_times_are_counted(spark):
    base = dt.datetime(2024, 1, 1)
    given = [(1, base, "a"), (2, base, "a"), (3, base, None), (4, None, "a"), (5, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in given], "request_id int, ts timestamp_ntz, topic string, total_tokens bigint")
    out = rq.rate_limit(df, ["topic"], "ts", "request_id", calls=1)
    assert rows(out, "request_id", "response_code") == [(1, 200), (2, 429), (3, 200), (4, 200), (5, 200)]


def test_upsert_with_null_order_and_keys(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 5), (None, "c", 5)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "new", 1), (2, "undated", None), (None, "other", 9), (3, "add", None)], "k int, v string, n int")
    got = changes.upsert(target, updates, ["k"], "n")
    assert sorted(map(tuple, got.select("k", "v").collect()), key=str) == sorted(
        [(1, "new"), (2, "b"), (None, "c"), (None, "other"), (3, "add")], key=str
    )


def test_older_rows_of_later_batches_do_not_win(spark, tmp_path):
    log = ChangeLog(str(tmp_path / "log"), ("request_id",), "ts")
    log.append(events(spark, (1, 10, 1), (2, 10, 1)), 0)
    undated = events(spark, (2, 0, 9)).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    log.append(events(spark, (1, 5, 2), (3, 1, 1)).unionAll(undated), 1)
    assert rows(log.current(spark), "request_id", "user_id") == [(1, 1), (2, 1), (3, 1)]


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        rq.rate_limit(events(spark), ["user_id"], "ts", "request_id")
    with pytest.raises(ValueError):
        rq.rate_limit(events(spark), ["user_id"], "ts", "request_id", calls=1, unit="WEEK")


def test_declared_graph_runs_as_streams(spark, tmp_path):
    """Declare against the real decorators, then run each declared flow once as a stream."""
    from pyspark import pipelines as dp
    from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context

    class Collect(GraphElementRegistry):
        def __init__(self):
            self.outputs, self.flows = [], []

        def register_output(self, output):
            self.outputs.append(output.name)

        def register_flow(self, flow):
            self.flows.append(flow)

        def register_sql(self, sql_text, file_path):
            raise AssertionError("no SQL files here")

    landing = str(tmp_path / "landing")
    drop(landing, 1), drop(landing, 2, closed=False), drop(landing, 3)
    graph = Collect()
    with graph_element_registration_context(graph):
        ig.declare_document_graph(dp, spark, landing, size=20, overlap=5)
    assert graph.outputs == ["docs_bronze", "docs_parsed", "docs_quarantine", "docs_text", "doc_chunks"]
    for flow in graph.flows:
        writer = flow.func().writeStream.option("checkpointLocation", str(tmp_path / flow.name))
        writer.trigger(availableNow=True).toTable(flow.name).awaitTermination()
    counts = {name: spark.table(name).count() for name in graph.outputs[:4]}
    assert counts == {"docs_bronze": 3, "docs_parsed": 3, "docs_quarantine": 1, "docs_text": 2}
    chunks = spark.table("doc_chunks")
    assert chunks.columns == ["chunk_id", "content", "source_doc", "chunk_index", "ingested_at"]
    assert chunks.select("source_doc").distinct().count() == 2


def test_requests_survive_broken_properties(spark):
    raw = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 5, "click", 1.5, '{"k": "x"}'), (2, dt.datetime(2024, 1, 1), 5, "error", 2.0, "oops")],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    assert rows(tm.requests_from_events(raw), "event_id", "total_tokens", "status") == [(1, None, "OK"), (2, None, "ERROR")]
