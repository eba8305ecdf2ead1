"""Chunk splitters.  Each returns an array column; ``chunk_rows`` makes the rows.

All but the recursive splitter are JVM expressions on the row, so chunking
needs no shuffle.  A text is one row and is always processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.functions.batches import byte_runs
from larkspur.functions.similarity import set_cosine

# Boundaries from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def window_starts(size: Column, window: int, overlap: int) -> Column:
    """0, stride, 2*stride ... until a window reaches the end; empty for size 0."""
    stride = window - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the window")
    steps = F.ceil(F.greatest(size - window, F.lit(0)) / F.lit(stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), steps), lambda i: i * stride)
    return F.when(size > 0, starts).otherwise(F.array().cast("array<int>"))


def fixed_chunks(c: Column | str, window: int, overlap: int = 0) -> Column:
    """Windows of a fixed number of characters."""
    c = F.col(c) if isinstance(c, str) else c
    return tx.let(
        c,
        lambda t: F.transform(
            window_starts(F.length(t), window, overlap), lambda i: F.substring(t, i + 1, F.lit(window))
        ),
    )


def token_chunks(c: Column | str, window: int, overlap: int = 0) -> Column:
    """Windows of a fixed number of whitespace tokens."""
    return regroup(tx.words(c), window, overlap, " ")


def regroup(items: Column, window: int, overlap: int, joiner: str) -> Column:
    """Windows over an array, each joined to one text."""
    return tx.let(
        items,
        lambda a: F.transform(
            window_starts(F.size(a), window, overlap), lambda i: F.array_join(F.slice(a, i + 1, window), joiner)
        ),
    )


def sentence_chunks(c: Column | str, sentences: int = 3) -> Column:
    """A fixed number of whole sentences per chunk."""
    return regroup(tx.sentences(c), sentences, 0, " ")


def paragraph_chunks(c: Column | str, pattern: str = r"\n\n+") -> Column:
    """One chunk per paragraph."""
    return tx.paragraphs(c, pattern)


def sliding_paragraphs(c: Column | str, window: int, overlap: int, pattern: str = r"\n\n+") -> Column:
    """Overlapping windows of whole paragraphs."""
    return regroup(tx.paragraphs(c, pattern), window, overlap, "\n\n")


def interpolated_percentile(values: Column, percentile: float) -> Column:
    """Linearly interpolated percentile of an array; NULL when it is empty."""

    def pick(ordered: Column) -> Column:
        at = F.lit(percentile) * (F.size(ordered) - 1)
        low = F.get(ordered, F.floor(at).cast("int"))
        high = F.get(ordered, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return tx.let(F.sort_array(values), pick)


def semantic_chunks(c: Column | str, percentile: float = 0.95) -> Column:
    """Break where neighbouring sentences differ more than the percentile of the document.

    The distance is one less the cosine of the two word sets; the threshold is
    the linearly interpolated percentile of the document's own distances.
    Everything stays in the row.
    """

    def neighbours(items: Column) -> tuple[Column, Column]:
        count = F.greatest(F.size(items) - 1, F.lit(0))
        return F.slice(items, F.lit(1), count), F.slice(items, F.lit(2), count)

    def join_between(sentences: Column, starts: Column) -> Column:
        ends = F.concat(neighbours(starts)[1], F.array(F.size(sentences)))
        return F.zip_with(
            starts, ends, lambda start, end: F.array_join(F.slice(sentences, start + 1, end - start), " ")
        )

    def breaks(distances: Column) -> Column:
        limits = F.array_repeat(interpolated_percentile(distances, percentile), F.size(distances))
        over = F.zip_with(distances, limits, lambda d, limit: d > limit)
        at = F.transform(over, lambda is_break, i: F.when(is_break, i + 1))
        return F.concat(F.array(F.lit(0)), F.filter(at, lambda i: i.isNotNull()))

    def assemble(sentences: Column) -> Column:
        bags = F.transform(sentences, lambda s: F.array_distinct(tx.tokens(s)))
        distances = tx.let(
            bags, lambda b: F.zip_with(*neighbours(b), lambda x, y: F.lit(1.0) - set_cosine(x, y))
        )
        starts = tx.let(distances, breaks)
        return tx.let(starts, lambda s: join_between(sentences, s))

    found = tx.let(tx.sentences(c), lambda s: F.when(F.size(s) > 0, assemble(s)))
    return F.coalesce(found, F.array().cast("array<string>"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest boundary present, refine what is too long, merge with overlap.

    A separator stays at the front of the piece that follows it.  Pieces are
    packed up to ``size`` characters; a new chunk repeats trailing pieces of
    the one before it while they fit into ``overlap``.
    """
    if not text:
        return []
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[level], separators[level + 1 :]
    if separator:
        first, *others = text.split(separator)
        pieces = [p for p in (first, *(separator + o for o in others)) if p]
    else:
        pieces = list(text)

    chunks: list[str] = []
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        chunks += pack_pieces(small, size, overlap)
        small = []
        chunks += split_recursively(piece, size, overlap, finer) if finer else [piece]
    return chunks + pack_pieces(small, size, overlap)


def pack_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pack neighbouring pieces greedily; see ``split_recursively``."""
    chunks: list[str] = []
    start, length = 0, 0  # the open chunk is pieces[start:i]
    for i, piece in enumerate(pieces):
        if length + len(piece) > size and i > start:
            chunks.append("".join(pieces[start:i]).strip())
            while start < i and (length > overlap or length + len(piece) > size):
                length -= len(pieces[start])
                start += 1
        length += len(piece)
    chunks.append("".join(pieces[start:]).strip())
    return [c for c in chunks if c]


def recursive_chunks(size: int = 1200, overlap: int = 200) -> Callable[[Column], Column]:
    """The recursive splitter as an Arrow-batched function of a text column.

    Chunks are given back after every run of a few megabytes of text, so a task
    holds the strings of one run, however many rows a batch has.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the size")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for run in byte_runs(batch):
                yield pa.array([split_recursively(s, size, overlap) if s else [] for s in run.to_pylist()], pa.list_(pa.string()))

    return split


def chunk_by_strategy(df: DataFrame, text: str, kind: str, strategies: dict[str, str], size: int, overlap: int) -> DataFrame:
    """One splitter per document kind: ``token``, ``recursive`` or ``semantic``.

    All kinds go through one pass.  The Python splitter receives NULL for rows
    of other kinds, so only its own texts cross the process boundary.
    """
    choice = F.create_map(*[F.lit(x) for pair in strategies.items() for x in pair])[F.col(kind)]
    staged = df.withColumn("strategy", F.coalesce(choice, F.lit("recursive")))
    split = recursive_chunks(size, overlap)
    staged = staged.withColumn("_recursive", split(F.when(F.col("strategy") == "recursive", F.col(text))))
    chunks = (
        F.when(F.col("strategy") == "token", token_chunks(text, 180, 30))
        .when(F.col("strategy") == "semantic", semantic_chunks(text))
        .otherwise(F.col("_recursive"))
    )
    return staged.withColumn("chunks", chunks).drop("_recursive")


def chunk_rows(df: DataFrame, source_doc: str, chunks: Column | str = "chunks", ingested_at: Column | None = None) -> DataFrame:
    """The chunk table: chunk_id, content, source_doc, chunk_index, ingested_at.

    Arrays are exploded in the outer form and empty rows dropped after it:
    for the plain form Spark would test the array's size first and so compute
    the chunks twice.
    """
    array = F.col(chunks) if isinstance(chunks, str) else chunks
    time = F.current_timestamp() if ingested_at is None else ingested_at
    rows = df.select(
        F.col(source_doc).cast("string").alias("source_doc"),
        time.alias("ingested_at"),
        F.posexplode_outer(array).alias("chunk_index", "content"),
    )
    return rows.where(F.length("content") > 0).select(
        tx.content_key("source_doc", "chunk_index").alias("chunk_id"),
        "content", "source_doc", "chunk_index", "ingested_at",
    )
