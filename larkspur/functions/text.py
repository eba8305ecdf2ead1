"""Text expressions.  All run in the JVM and take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and whitespace classes, shared with the SQL oracles.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SENTENCE_PATTERN = r"[^.!?]*[.!?]+|[^.!?]+"

# Only a newline ends a line in the noise rules, so text with CRLF is cleaned too.
NEWLINE_ONLY = "(?d)"
# Noise rules of the cleaning step, in the order they apply.
TAG_PATTERN = r"<[^>]+>"
DISCLAIMER_PATTERN = r"(?i)this document is confidential.*?(\n|$)"
PAGE_MARK_PATTERN = r"(?i)page \d+ of \d+"
LAST_UPDATED_PATTERN = r"(?i)last updated:.*?(\n|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that names an outer expression would compute it again for every
    element; bound as a lambda variable it is computed a single time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def words(c: Column | str) -> Column:
    """Whitespace-separated words, case and punctuation kept."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def lines(c: Column | str) -> Column:
    """Trimmed non-blank lines, in order."""
    return F.filter(F.transform(F.split(_col(c), r"\R"), strip), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    """Trimmed sentences: runs that end in ``.``, ``!`` or ``?``, plus a last run."""
    found = F.regexp_extract_all(_col(c), F.lit(SENTENCE_PATTERN), F.lit(0))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def paragraphs(c: Column | str, pattern: str = r"\n\n+") -> Column:
    """Trimmed non-empty paragraphs."""
    return F.filter(F.transform(F.split(_col(c), pattern), strip), lambda x: x != "")


def remove_noise(c: Column | str) -> Column:
    """Drop tags, confidentiality lines, page marks and update stamps."""
    out = F.regexp_replace(_col(c), TAG_PATTERN, " ")
    out = F.regexp_replace(out, NEWLINE_ONLY + DISCLAIMER_PATTERN, "")
    out = F.regexp_replace(out, PAGE_MARK_PATTERN, "")
    return F.regexp_replace(out, NEWLINE_ONLY + LAST_UPDATED_PATTERN, "")


def unique_lines(c: Column | str) -> Column:
    """Each distinct non-blank line once, first occurrence kept, order kept."""
    return F.array_join(F.array_distinct(lines(c)), "\n")


def clean_text(c: Column | str) -> Column:
    """Noise removal followed by line deduplication."""
    return unique_lines(remove_noise(c))


def scrub_flat_text(c: Column | str) -> Column:
    """The light scrub after flattening: page marks out, blank runs collapsed."""
    out = F.regexp_replace(_col(c), r"(?i)Page \d+ of \d+", "")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def normalized(c: Column | str) -> Column:
    """Lower case, whitespace runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


def ngrams(items: Column, n: int) -> Column:
    """Blank-joined runs of ``n`` neighbouring array elements."""
    if n == 1:
        return items

    def grams(array: Column) -> Column:
        last = F.size(array) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(array, i + 1, n), " "))

    return let(items, grams)


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """True when any literal occurs in the text (case-sensitive)."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(_col(c), F.lit(needle))
    return found


def substitute(c: Column | str, pairs: dict[str, str]) -> Column:
    """Literal replacements applied one after the other."""
    out = _col(c)
    for old, new in pairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def content_key(*parts: Column | str) -> Column:
    """Deterministic SHA-256 id of parts joined by ``::``."""
    return F.sha2(F.concat_ws("::", *[_col(p).cast("string") for p in parts]), 256)


def hash_fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts; the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
