"""Incremental vector-index upkeep from change rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.vectors import TextEmbedder
from larkspur.operators.windows import latest_by_key
from larkspur.streaming.changelog import ChangeLog
from larkspur.streaming.ingest import start


def apply_changes(index: ChangeLog, changes: DataFrame, batch_id: int, embedder: TextEmbedder, key: str, text: str, order: str) -> None:
    """Embed the changed rows only and append them to the index.

    ``changes`` holds key, text, ``op`` (insert, update or delete) and an order
    column; the last change of a key within the batch wins.
    """
    last = latest_by_key(changes, [key], [F.col(order)])
    body = F.when(F.col("op") != "delete", F.col(text))
    vectors = embedder.embed(last.withColumn(text, body), text)
    marked = vectors.withColumn("_op", F.when(F.col("op") == "delete", "delete").otherwise("put"))
    index.append(marked.select(key, "embedding", "_op"), batch_id)


def run_index_stream(
    changes: DataFrame, index: ChangeLog, state: str, embedder: TextEmbedder, key: str, text: str, order: str,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the index in step with a stream of change rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_changes(index, batch, batch_id, embedder, key, text, order)

    return start(changes, state, write, every)
