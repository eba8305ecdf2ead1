"""Incremental document flow: raw pages to parsed, quarantine, text and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators import chunking as ch
from larkspur.operators import documents as dc
from larkspur.operators.relational import expect_or_drop


def document_graph(raw: DataFrame, id_column: str = "page_id", html: str = "html", size: int = 1200, overlap: int = 200) -> dict[str, DataFrame]:
    """The named datasets of the flow, each a plain function of the one before.

    Works on a batch frame and, up to the expectations, on a stream.
    """
    parsed = dc.parse_pages(raw.select(id_column, html), id_column, html)
    texts = dc.document_text(parsed)
    kept, _dropped = expect_or_drop(texts, {"non_empty_text": F.length("doc_text") > 0})
    chunks = ch.chunk_rows(kept, id_column, ch.recursive_chunks(size, overlap)(F.col("doc_text")))
    return {"bronze": raw, "parsed": parsed, "quarantine": dc.quarantined(parsed, id_column), "text": kept, "chunks": chunks}


def text_files(binary: DataFrame) -> DataFrame:
    """Binary file rows as (path, html) pages."""
    return binary.select(F.col("source_path").alias("page_id"), F.decode("content", "utf-8").alias("html"), "ingested_at")


def start(
    stream: DataFrame, state: str, write_batch, every: str | None = None
) -> StreamingQuery:
    """Triggered sync (one run over what is there) or, with ``every``, a standing one."""
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", state)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_document_stream(
    raw: DataFrame, out: str, state: str, id_column: str = "page_id", html: str = "html",
    size: int = 1200, overlap: int = 200, every: str | None = None,
) -> StreamingQuery:
    """Feed new raw rows through the graph into parquet tables under ``out``.

    One micro-batch writes quarantine, text and chunks from one parse.  Every
    table gets the batch as its own folder in overwrite mode, so a repeated
    batch leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # the parse is shared by three sinks; kept in memory and on disk for this batch only
        parsed = dc.parse_pages(batch.select(id_column, html), id_column, html).persist()
        try:
            quarantine = dc.quarantined(parsed, id_column)
            quarantine.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
            texts = dc.document_text(parsed).where(F.length("doc_text") > 0)
            texts.write.mode("overwrite").parquet(f"{out}/text/batch={batch_id}")
            stored = batch.sparkSession.read.schema(texts.schema).parquet(f"{out}/text/batch={batch_id}")
            chunks = ch.chunk_rows(stored, id_column, ch.recursive_chunks(size, overlap)(F.col("doc_text")))
            chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        finally:
            parsed.unpersist()

    return start(raw, state, write, every)


def fan_out(
    stream: DataFrame, out: str, state: str, is_clean: Column, every: str | None = None
) -> StreamingQuery:
    """Each row to the clean or to the quarantine table, in one pass over the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = batch.withColumn("route", F.when(F.coalesce(is_clean, F.lit(False)), "clean").otherwise("quarantine"))
        routed.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("route", "batch").parquet(out)

    return start(stream, state, write, every)


def declare_document_graph(dp, spark: SparkSession, landing: str, size: int = 1200, overlap: int = 200) -> None:
    """Declare the flow as a pipeline graph; ``dp`` is ``pyspark.pipelines``.

    Dependencies follow from the tables each dataset reads.
    """
    from larkspur.sources.files import ingest_stream

    @dp.table(name="docs_bronze", comment="Raw files with their provenance.", cluster_by=["source_path"])
    def docs_bronze():
        return ingest_stream(spark, landing)

    @dp.table(name="docs_parsed", comment="Typed elements and error status per document.")
    def docs_parsed():
        return dc.parse_pages(text_files(spark.readStream.table("docs_bronze")))

    @dp.table(name="docs_quarantine", comment="Documents whose parse failed.")
    def docs_quarantine():
        return dc.quarantined(spark.readStream.table("docs_parsed"), "page_id")

    @dp.table(name="docs_text", comment="Clean parses as text.")
    def docs_text():
        return dc.document_text(spark.readStream.table("docs_parsed")).where(F.length("doc_text") > 0)

    @dp.table(name="doc_chunks", comment="Chunks with ids and provenance.", cluster_by=["source_doc"])
    def doc_chunks():
        texts = spark.readStream.table("docs_text")
        return ch.chunk_rows(texts, "page_id", ch.recursive_chunks(size, overlap)(F.col("doc_text")))
