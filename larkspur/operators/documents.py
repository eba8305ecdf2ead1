"""Document preparation: parse, flatten, clean, deduplicate, extract, assemble."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.similarity import jaccard
from larkspur.operators.skew import join_hot_keys
from larkspur.operators.windows import top_k
from larkspur.session import cut_lineage

# Element types that never belong in the flattened text.
NOISE_ELEMENT_TYPES = ["page_number", "page_footer", "page_header"]

# The entities that pages use.
ENTITIES = {
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&",
}
INLINE_BYTES = 1 << 20  # boilerplate lines that a plan may carry
REGION_MARK, TYPE_MARK = "\u0001", "\u0002"
BLOCK_TAGS = "h[1-6]|p|div|li|ul|ol|table|tr|td|th|br|section|article|blockquote|pre"


def parse_pages(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """Parse markup into typed elements in reading order, with an error list.

    Scripts, styles and comments are dropped.  ``title`` becomes a title
    element, ``nav`` a page header, ``footer`` a page footer, headings section
    headers and every other block a text element.  A document without a body
    or without its closing tag gets one entry in ``error_status``.  All steps
    are expressions on one row: nothing is shuffled and no Python runs.
    """
    c = F.col(html)
    stripped = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    marked = stripped
    for tag, kind in (("title", "title"), ("nav", "page_header"), ("footer", "page_footer")):
        marked = F.regexp_replace(marked, rf"(?i)<{tag}\b[^>]*>", f"{REGION_MARK}{kind}{TYPE_MARK}")
        marked = F.regexp_replace(marked, rf"(?i)</{tag}>", f"{REGION_MARK}text{TYPE_MARK}")
    regions = F.split(F.concat(F.lit(f"text{TYPE_MARK}"), marked), REGION_MARK)

    def plain(s: Column) -> Column:
        out = tx.substitute(F.regexp_replace(s, tx.TAG_PATTERN, " "), ENTITIES)
        return tx.strip(F.regexp_replace(out, r"\s+", " "))

    def element(kind: Column, content: Column) -> Column:
        return F.struct(kind.alias("type"), plain(content).alias("content"))

    def blocks(region: Column) -> Column:
        kind = F.substring_index(region, TYPE_MARK, 1)
        body = F.substring_index(region, TYPE_MARK, -1)
        heads = F.regexp_replace(body, r"(?i)<h[1-6]\b[^>]*>", f"{REGION_MARK}section_header{TYPE_MARK}")
        cut = F.regexp_replace(heads, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", f"{REGION_MARK}text{TYPE_MARK}")
        pieces = F.split(F.concat(F.lit(f"text{TYPE_MARK}"), cut), REGION_MARK)
        split_up = F.transform(
            pieces,
            lambda p: element(F.substring_index(p, TYPE_MARK, 1), F.substring_index(p, TYPE_MARK, -1)),
        )
        return F.when(kind == "text", split_up).otherwise(F.array(element(kind, body)))

    raw = F.filter(F.flatten(F.transform(regions, blocks)), lambda e: e["content"] != "")
    elements = F.transform(
        raw, lambda e, i: F.struct(i.alias("id"), e["type"].alias("type"), e["content"].alias("content"))
    )
    no_body = ~F.contains(F.lower(c), F.lit("<body")) | c.isNull()
    unclosed = ~F.contains(F.lower(c), F.lit("</html>"))
    error = F.when(no_body, "document has no body").when(unclosed, "document is not closed")
    status = F.when(
        error.isNotNull(), F.array(F.struct(error.alias("error_message"), F.lit(0).alias("page_id")))
    ).otherwise(F.array().cast("array<struct<error_message:string,page_id:int>>"))
    return pages.select(
        id_column,
        *[x for x in pages.columns if x not in (id_column, html)],
        F.struct(
            F.struct(F.array(F.struct(F.lit(0).alias("id"))).alias("pages"), elements.alias("elements")).alias("document"),
            status.alias("error_status"),
            F.struct(F.md5(c).alias("id"), F.lit("1.0").alias("version")).alias("metadata"),
        ).alias("parsed"),
    )


def element_rows(parsed: DataFrame, id_column: str) -> DataFrame:
    """One row per element.

    The outer form with a later filter: for the plain form Spark would test
    the array's size beforehand and so parse every document twice.
    """
    rows = parsed.select(id_column, F.explode_outer("parsed.document.elements").alias("e"))
    return rows.where(F.col("e").isNotNull()).select(id_column, "e.*")


def to_variant(df: DataFrame, column: str = "parsed") -> DataFrame:
    """The parsed struct as one VARIANT value."""
    return df.withColumn(column, F.to_variant_object(F.col(column)))


def flatten_elements(elements: Column, noise: list[str] | None = None) -> Column:
    """Element contents joined by newlines; noise types dropped, untyped ones kept."""
    noise = NOISE_ELEMENT_TYPES if noise is None else noise
    kept = F.filter(elements, lambda e: e["type"].isNull() | ~e["type"].isin(noise))
    return F.concat_ws("\n", F.transform(kept, lambda e: e["content"]))


def flatten_variant(column: str = "parsed", noise: list[str] | None = None) -> Column:
    """The same for a VARIANT document: its elements are cast once, then flattened alike."""
    elements = F.variant_get(F.col(column), "$.document.elements", "array<struct<type: string, content: string>>")
    return flatten_elements(elements, noise)


def document_text(parsed: DataFrame) -> DataFrame:
    """Clean parses only, flattened and scrubbed to ``doc_text``."""
    clean = parsed.where(F.get(F.col("parsed.error_status"), F.lit(0)).isNull())
    text = tx.scrub_flat_text(flatten_elements(F.col("parsed.document.elements")))
    return clean.withColumn("doc_text", text).drop("parsed")


def quarantined(parsed: DataFrame, id_column: str) -> DataFrame:
    """Failed parses with the first error message."""
    first = F.get(F.col("parsed.error_status"), F.lit(0))
    return parsed.where(first.isNotNull()).select(id_column, first["error_message"].alias("error_message"))


def boilerplate_lines(df: DataFrame, id_column: str, text: str, min_doc_fraction: float) -> DataFrame:
    """Lines that occur in at least the given share of documents.

    Each document counts a line once.  Every document brings its distinct
    lines only, so at most (mean lines per document / fraction) lines qualify.
    """
    total = df.agg(F.count("*")).scalar()
    per_line = df.select(F.explode(F.array_distinct(tx.lines(text))).alias("line")).groupBy("line").agg(
        F.count("*").alias("documents")
    )
    return per_line.where(F.col("documents") >= F.lit(min_doc_fraction) * total)


def drop_boilerplate(df: DataFrame, id_column: str, text: str, min_doc_fraction: float) -> DataFrame:
    """Remove boilerplate lines from every document, order of the rest kept.

    Lines whose measured size fits become a hash-set test inside the row, so
    texts are not shuffled; a larger list takes an anti-join of exploded lines.
    Both give the same: a document that loses every line keeps an empty text, a
    NULL text stays NULL.
    """
    frequent = cut_lineage(boilerplate_lines(df, id_column, text, min_doc_fraction).select("line"))
    size = frequent.agg(F.sum(F.octet_length("line") + 64)).first()[0] or 0
    if size <= INLINE_BYTES:
        known = [r["line"] for r in frequent.collect()]
        kept = tx.lines(text)
        if known:
            kept = F.filter(kept, lambda x: ~x.isin(known))
        return df.withColumn(text, F.array_join(kept, "\n"))
    rest = [c for c in df.columns if c not in (id_column, text)]
    exploded = df.select(id_column, F.posexplode(tx.lines(text)).alias("_pos", "line"))
    left = exploded.join(frequent, "line", "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    texts = left.groupBy(id_column).agg(joined.alias("_kept"))
    return df.select(id_column, *rest, F.col(text).isNull().alias("_none")).join(texts, id_column, "left").withColumn(
        text, F.when(~F.col("_none"), F.coalesce("_kept", F.lit("")))
    ).select(*df.columns)


def _copy_key(id_column: str, text: str) -> Column:
    """Rows with this key are copies; a NULL text is a copy of nothing but its own id."""
    digest = F.sha2(tx.normalized(text), 256)
    return F.struct(digest.alias("content_hash"), F.when(digest.isNull(), F.col(id_column)).alias("own"))


def exact_groups(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row per distinct normalized text: hash, smallest id, number of copies.

    NULL texts are no copies of each other and have a NULL hash.
    """
    return df.groupBy(_copy_key(id_column, text).alias("_key")).agg(
        F.min(id_column).alias("canonical_id"), F.count("*").alias("copies")
    ).select("_key.content_hash", "canonical_id", "copies")


def dedup_exact(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The first row of every group of equal texts, and every row without text.  The join is on unique ids."""
    keep = exact_groups(df, id_column, text).select(F.col("canonical_id").alias(id_column))
    return df.join(keep, id_column, "left_semi")


def label_copies(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Every row id with the id of the row it copies; a huge copy group is spread.

    Ids and hashes are stored first: the texts are read and hashed once.  A
    NULL text copies nothing but itself.
    """
    keyed = cut_lineage(df.select(id_column, _copy_key(id_column, text).alias("_key")))
    groups = keyed.groupBy("_key").agg(F.min(id_column).alias("canonical_id"), F.count("*").alias("copies"))
    joined = join_hot_keys(keyed, groups, "_key", "copies", [F.col(id_column)])
    return joined.select(id_column, "_key.content_hash", "canonical_id", "copies")


def dedup_paragraphs(df: DataFrame, id_column: str, text: str, separator: str = r"\n\n+") -> DataFrame:
    """Text of each document with paragraphs kept only in the first document that has them.

    Every id comes out: a document that keeps no paragraph has an empty text,
    a NULL text stays NULL.
    """
    pieces = df.select(id_column, F.posexplode(tx.paragraphs(text, separator)).alias("pos", "paragraph"))
    first = pieces.groupBy(F.sha2(tx.normalized("paragraph"), 256).alias("h")).agg(
        F.min(F.struct(id_column, "pos", "paragraph")).alias("f")
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "paragraph")))
    kept = (
        first.select("f.*")
        .groupBy(id_column)
        .agg(F.array_join(F.transform(ordered, lambda x: x["paragraph"]), "\n\n").alias("_kept"))
    )
    every = df.select(id_column, F.col(text).isNull().alias("_none"))
    return every.join(kept, id_column, "left").select(
        id_column, F.when(~F.col("_none"), F.coalesce("_kept", F.lit(""))).alias(text)
    )


def similar_neighbours(chunks: DataFrame, doc: str, index: str, content: str, threshold: float) -> DataFrame:
    """Neighbouring chunks of one document that overlap at or above a Jaccard of words.

    The partner is found by position, so the work grows with the number of
    chunks and never with their square.
    """
    grams = F.array_distinct(tx.tokens(content))
    rows = chunks.select(doc, F.col(index).alias("chunk_index"), grams.alias("grams"))
    after = rows.select(doc, (F.col("chunk_index") - 1).alias("chunk_index"), F.col("grams").alias("next_grams"))
    return (
        rows.join(after, [doc, "chunk_index"])
        .withColumn("jaccard", jaccard(F.col("grams"), F.col("next_grams")))
        .where(F.col("jaccard") >= threshold)
        .drop("grams", "next_grams")
    )


def drop_similar_hits(hits: DataFrame, query: str, rank: str, content: str, threshold: float) -> DataFrame:
    """Ranked hits without those that nearly repeat a kept hit of better rank.

    ``hits`` is a ranked list of bounded length per query (a top-k result).
    The list is walked in rank order inside one row; a hit stays when its word
    Jaccard with every kept hit is below the threshold.
    """
    rest = [c for c in hits.columns if c != query]
    item = F.struct(F.col(rank).alias("_r"), F.array_distinct(tx.tokens(content)).alias("_g"), F.struct(*rest).alias("_row"))
    lists = hits.groupBy(query).agg(F.sort_array(F.collect_list(item)).alias("items"))
    lists = lists.withColumn("kept", F.slice("items", 1, 1))

    def step(kept: Column, candidate: Column) -> Column:
        repeats = F.exists(kept, lambda k: jaccard(k["_g"], candidate["_g"]) >= threshold)
        return F.when(repeats, kept).otherwise(F.concat(kept, F.array(candidate)))

    kept = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), F.col("kept"), step)
    return lists.select(query, F.explode(F.transform(kept, lambda k: k["_row"])).alias("_row")).select(query, "_row.*")


def chunk_audit(chunks: DataFrame, limits: dict[str, int], content: str = "content", key: str = "chunk_id") -> DataFrame:
    """Counts, uniqueness, emptiness and tokens lost to truncation per model limit."""
    tokens = tx.word_count(content)
    measured = chunks.select(key, F.length(content).alias("chars"), tokens.cast("bigint").alias("tokens"))
    # ids counted by group first: a plain distinct count of a unique key keeps all ids per task
    per_id = measured.groupBy(key).agg(
        F.count("*").alias("n"), F.min("chars").alias("min_chars"), F.max("tokens").alias("max_tokens"),
        *[F.sum(F.greatest(F.col("tokens") - limit, F.lit(0))).alias(f"lost_{name}") for name, limit in limits.items()],
        *[F.count_if(F.col("tokens") > limit).alias(f"over_{name}") for name, limit in limits.items()],
    )
    lost = [F.sum(f"{kind}_{name}").alias(f"{kind}_{name}") for name in limits for kind in ("lost", "over")]
    out = per_id.agg(
        F.sum("n").alias("chunks"), F.count("*").alias("unique_ids"), F.min("min_chars").alias("min_chars"),
        F.max("max_tokens").alias("max_tokens"), *lost,
    )
    return out.withColumn("ok", (F.col("chunks") == F.col("unique_ids")) & (F.col("min_chars") > 0))


@dataclass(frozen=True)
class Field:
    """One field to pull out of a text: first match of ``pattern`` (group 1)."""

    name: str
    pattern: str
    type: str = "string"  # string, integer, number, date or enum
    labels: tuple[str, ...] = ()


SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "date": "date", "enum": "string"}


def extract_fields(df: DataFrame, text: str, fields: list[Field]) -> DataFrame:
    """Add ``fields``: a response struct of ``{value}`` objects and an error message.

    NULL text gives NULL.  A value that does not cast to its type, or an enum
    value outside its labels, becomes NULL.
    """
    values = []
    for field in fields:
        found = F.nullif(F.regexp_extract(text, field.pattern, 1), F.lit(""))
        if field.type == "enum":
            low = F.lower(found)
            value = F.coalesce(*[F.when(low == label.lower(), F.lit(label)) for label in field.labels])
        elif field.type == "string":
            value = found
        else:
            value = found.try_cast(SQL_TYPES[field.type])
        values.append(F.struct(value.alias("value")).alias(field.name))
    missing = F.lit(True)
    for field_value in values:
        missing = missing & field_value["value"].isNull()
    result = F.struct(
        F.struct(*values).alias("response"),
        F.when(missing, F.lit("no field found")).alias("error_message"),
    )
    return df.withColumn("fields", F.when(F.col(text).isNotNull(), result))


def typed_columns(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The extracted values as plain columns plus ``extract_error``."""
    values = [F.col(f"fields.response.{f.name}.value").alias(f.name) for f in fields]
    return df.select(*[c for c in df.columns if c != "fields"], *values, F.col("fields.error_message").alias("extract_error"))


def completeness(extracted: DataFrame, fields: list[Field]) -> DataFrame:
    """Rows, errors and non-NULL count of each field."""
    return extracted.agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("extract_error").isNotNull()).alias("extraction_errors"),
        *[F.count(f.name).alias(f"got_{f.name}") for f in fields],
    )


def expand_terms(c: Column | str, rules: dict[str, str], whole_words: bool = False) -> Column:
    """Trimmed text with each term replaced by its expansion, rule by rule in order.

    Terms are literals that match anywhere, or only as whole words on request.
    """
    out = tx.strip(c)
    if not whole_words:
        return tx.substitute(out, rules)
    for term, expansion in rules.items():
        replacement = expansion.replace("\\", "\\\\").replace("$", r"\$")
        out = F.regexp_replace(out, rf"\b{re.escape(term)}\b", replacement)
    return out


def assemble_context(
    ranked: DataFrame, query: str, rank: str, content: str, budget: int, separator: str = "\n\n"
) -> DataFrame:
    """Per query, the leading hits whose running token count fits the budget.

    Hits are joined in rank order; the first hit that does not fit ends the
    list.  Empty hits are skipped, so every hit costs at least one token and
    no more than ``budget`` hits per query can matter; the ranking keeps only
    those before anything is gathered.
    """
    sized = ranked.select(query, F.col(rank).alias("_r"), F.col(content).alias("_c"), tx.word_count(content).alias("_n"))
    leading = top_k(sized.where(F.col("_n") > 0), [query], [F.col("_r")], budget, "_place")
    w = Window.partitionBy(query).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    fitting = leading.withColumn("_used", F.sum("_n").over(w)).where(F.col("_used") <= budget)
    ordered = F.sort_array(F.collect_list(F.struct("_place", "_c")))
    return fitting.groupBy(query).agg(
        F.array_join(F.transform(ordered, lambda x: x["_c"]), separator).alias("context"),
        F.count("*").alias("hits_used"),
        F.max("_used").alias("tokens_used"),
    )
