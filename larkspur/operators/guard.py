"""Input checks, redaction, masking policy, toxicity and licence rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.skew import join_hot_keys

# Markers in the order they are tested, and the length limits.
INJECTION_MARKERS = [
    "ignore your instructions", "ignore previous instructions", "ignore all previous",
    "disregard the above", "system prompt", "reveal your prompt",
    "list every passenger", "dump all bookings", "all passengers flying",
]
MIN_LEN, MAX_LEN = 3, 2000

# Redaction rules in the order they apply; later rules see the
# output of earlier ones.  Classes are Unicode-aware.
PII_RULES = {
    "email": (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
    "phone": (r"\+?\d[\d\s().-]{7,}\d", "[PHONE]"),
    "passport": (r"\b[A-Z]\d{7,8}\b", "[PASSPORT]"),
    "pnr": (r"\b[A-Z0-9]{6}\b", "[PNR]"),
}
UNICODE = "(?U)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def validate_input(c: Column | str, markers: list[str] | None = None) -> Column:
    """``ok`` or the first reason to refuse; NULL counts as empty."""

    def verdict(text: Column) -> Column:
        low = F.lower(text)
        out = F.when(F.length(text) < MIN_LEN, "too_short").when(F.length(text) > MAX_LEN, "too_long")
        for marker in INJECTION_MARKERS if markers is None else markers:
            out = out.when(F.contains(low, F.lit(marker)), f"prompt_injection_marker:{marker}")
        return out.otherwise("ok")

    return tx.let(tx.strip(F.coalesce(_col(c), F.lit(""))), verdict)


def redact(c: Column | str, types: list[str] | None = None) -> Column:
    """Replace sensitive spans by typed placeholders, rule by rule; NULL gives ''."""
    out = F.coalesce(_col(c), F.lit(""))
    for name, (pattern, placeholder) in PII_RULES.items():
        if types is None or name in types:
            out = F.regexp_replace(out, UNICODE + pattern, placeholder.replace("[", r"\[").replace("]", r"\]"))
    return out


def guard_prompt(df: DataFrame, text: str) -> DataFrame:
    """Add send_to_model, reason and safe_text (NULL when blocked)."""
    checked = df.withColumn("reason", validate_input(text))
    allowed = F.col("reason") == "ok"
    return checked.withColumn("send_to_model", allowed).withColumn("safe_text", F.when(allowed, redact(text)))


def mask_entities(c: Column | str, types: list[str], names: list[str] | None = None) -> Column:
    """Replace entities of the listed types by ``[MASKED]``.

    ``person`` and ``address`` only mask the literals passed in ``names``.
    """
    known = {*PII_RULES, "person", "address"}
    unknown = set(types) - known
    if unknown:
        raise ValueError(f"unknown entity types: {sorted(unknown)}")
    out = _col(c)
    for name, (pattern, _placeholder) in PII_RULES.items():
        if name in types:
            out = F.regexp_replace(out, UNICODE + pattern, "[MASKED]")
    if {"person", "address"} & set(types):
        for name in names or []:
            out = F.replace(out, F.lit(name), F.lit("[MASKED]"))
    return out


def mask_placeholder(c: Column | str, placeholder: str) -> Column:
    return F.when(_col(c).isNotNull(), F.lit(placeholder))


def mask_shape(c: Column | str) -> Column:
    """Keep the shape: letters become X or x, digits n, the rest stays."""
    return F.mask(_col(c))


def mask_token(c: Column | str, salt: str) -> Column:
    """A salted hash: equal values stay equal, so masked columns still join."""
    return F.sha2(F.concat(F.lit(salt), _col(c).cast("string")), 256)


def mask_email_domain(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "^.*@", "****@")


MASKS = {
    "domain": mask_email_domain,
    "stars": lambda c: mask_placeholder(c, "***"),
    "shape": mask_shape,
    "redact": redact,
}


def masked_view(df: DataFrame, policy: dict[str, str], member: bool) -> DataFrame:
    """Columns under a policy (column -> mask name); members see the values."""
    unknown = [c for c in policy if c not in df.columns] + [m for m in policy.values() if m not in MASKS]
    if unknown:
        raise ValueError(f"unknown policy entries: {unknown}")
    if member:
        return df
    return df.select(*[MASKS[policy[c]](c).alias(c) if c in policy else F.col(c) for c in df.columns])


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar SQL function ``mask_email(email)`` for use in SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_email(email STRING) RETURNS STRING "
        "RETURN regexp_replace(email, '^.*@', '****@')"
    )


def register_status_function(spark: SparkSession, records_view: str, key: str, day: str, columns: dict[str, str]) -> None:
    """The SQL table function ``get_status(number, on_day)`` over a view of status records.

    ``columns`` maps the returned column names to their SQL types.
    """
    returned = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    picked = ", ".join(f"r.{name}" for name in columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION get_status(number STRING, on_day STRING) RETURNS TABLE({returned}) "
        f"RETURN SELECT {picked} FROM {records_view} r WHERE r.{key} = get_status.number AND r.{day} = get_status.on_day"
    )


def lookup_status(parameters: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The same lookup for a whole table of parameters: one join, not one call per row."""
    return parameters.select(*keys).distinct().join(records, keys)


def keyword_block(c: Column | str, invalid_keywords: list[str], topics: dict[str, list[str]] | None = None) -> Column:
    """``blocked_keyword``, ``off_topic`` or ``ok``.

    A text is off topic when a topic list is given and no topic keyword occurs.
    """

    def decide(token_array: Column) -> Column:
        bad = F.arrays_overlap(token_array, F.array(*[F.lit(k.lower()) for k in invalid_keywords]))
        out = F.when(bad, "blocked_keyword")
        if topics:
            allowed = sorted({w.lower() for words in topics.values() for w in words})
            on_topic = F.arrays_overlap(token_array, F.array(*[F.lit(w) for w in allowed]))
            out = out.when(~on_topic, "off_topic")
        return out.otherwise("ok")

    return tx.let(tx.tokens(F.coalesce(_col(c), F.lit(""))), decide)


@dataclass(frozen=True)
class Policy:
    """What to do on one side of a conversation: PII BLOCK, MASK or NONE, and keywords."""

    pii: str = "NONE"
    invalid_keywords: tuple[str, ...] = ()

    def __post_init__(self):
        if self.pii not in ("BLOCK", "MASK", "NONE"):
            raise ValueError("pii must be BLOCK, MASK or NONE")


def apply_policy(df: DataFrame, text: str, policy: Policy) -> DataFrame:
    """Add ``verdict`` (blocked_keyword, blocked_pii, masked or passed) and ``safe_text``."""
    redacted = redact(text)
    staged = df.withColumn("_redacted", redacted)
    has_pii = F.col("_redacted") != F.coalesce(F.col(text), F.lit(""))
    blocked = F.lit(False)
    if policy.invalid_keywords:
        blocked = keyword_block(text, list(policy.invalid_keywords)) == "blocked_keyword"
    verdict = F.when(blocked, "blocked_keyword")
    if policy.pii == "BLOCK":
        verdict = verdict.when(has_pii, "blocked_pii")
    elif policy.pii == "MASK":
        verdict = verdict.when(has_pii, "masked")
    staged = staged.withColumn("verdict", verdict.otherwise("passed"))
    safe = F.when(F.col("verdict") == "masked", F.col("_redacted")).when(F.col("verdict") == "passed", F.col(text))
    return staged.withColumn("safe_text", safe).drop("_redacted")


def moderate(c: Column | str, lexicon: list[str], action: str, approved: str = "[removed]") -> Column:
    """Toxic texts are rejected (NULL), redacted word by word, or substituted whole."""
    text = _col(c)
    pattern = UNICODE + r"(?i)\b(" + "|".join(lexicon) + r")\b"
    toxic = F.regexp_like(text, F.lit(pattern))
    if action == "reject":
        return F.when(~toxic, text)
    if action == "redact":
        return F.regexp_replace(text, pattern, "***")
    if action == "substitute":
        return F.when(toxic, F.lit(approved)).otherwise(text)
    raise ValueError("action must be reject, redact or substitute")


def toxic_words(c: Column | str, lexicon: list[str]) -> Column:
    """How many tokens of the text are in the lexicon."""
    return F.size(F.filter(tx.tokens(c), lambda t: t.isin(lexicon)))


# Licence lines by pattern, with uses and restriction rank.
LICENCES = [
    # licence, pattern, allowed uses, disallowed uses, rank (higher is stricter), what must be given with copies
    ("cc-by-nc", r"CC BY-NC", "research", "commercial", 3, "name the author"),
    ("gpl-3", r"GNU General Public License", "any", "closed redistribution", 2, "licence and source"),
    ("apache-2", r"Apache License", "any", "", 1, "licence and notices"),
    ("mit", r"MIT License", "any", "", 1, "licence text"),
]
UNKNOWN_RANK = 4


def licence_of(c: Column | str) -> Column:
    """The strictest licence named in the text, ``unknown`` if none."""
    matched = [F.when(F.regexp_like(_col(c), F.lit(p)), F.lit(name)) for name, p, *_ in LICENCES]
    return F.coalesce(*matched, F.lit("unknown"))


def licence_intake(df: DataFrame, text: str, reviewed_by: str | None = None) -> DataFrame:
    """Add license_type, allowed_uses, disallowed_uses, attribution, reviewer, restriction rank and route.

    Restricted (non-commercial) and unknown licences go to quarantine.  With
    ``reviewed_by``, the column that names the reviewer, so do rows without one.
    """
    name = licence_of(text)
    staged = df.withColumn("license_type", name)

    def pick(column: int, default) -> Column:
        pairs = [F.lit(x) for row in LICENCES for x in (row[0], row[column])]
        return F.coalesce(F.create_map(*pairs)[F.col("license_type")], F.lit(default))

    staged = (
        staged.withColumn("allowed_uses", pick(2, "none"))
        .withColumn("disallowed_uses", pick(3, "all"))
        .withColumn("license_rank", pick(4, UNKNOWN_RANK))
        .withColumn("attribution", pick(5, "unknown"))
        .withColumn("reviewed_by", F.col(reviewed_by) if reviewed_by else F.lit(None).cast("string"))
    )
    held = F.col("license_rank") >= 3
    if reviewed_by:
        held = held | F.col("reviewed_by").isNull()
    return staged.withColumn("route", F.when(held, "quarantine").otherwise("accepted"))


def propagate_licence(lineage: DataFrame, sources: DataFrame, derived: str, source: str) -> DataFrame:
    """Each derived item with the strictest licence among its sources.

    A source that very many items derive from is spread over tasks.
    """
    uses = lineage.groupBy(source).agg(F.count("*").alias("_uses"))
    rated = uses.join(sources.select(source, "license_rank", "license_type"), source)
    joined = join_hot_keys(lineage.select(derived, source), rated, source, "_uses", [F.col(derived)], weights=uses)
    strict = F.max(F.struct("license_rank", "license_type"))
    return joined.groupBy(derived).agg(strict.alias("_s")).select(derived, "_s.license_type", "_s.license_rank")


def pseudonymous_feedback(df: DataFrame, session: str, comment: str, codes: dict[str, list[str]], salt: str) -> DataFrame:
    """Hashed session id and category code in place of the raw comment."""
    from larkspur.operators.enrichment import classify

    rest = [c for c in df.columns if c not in (session, comment)]
    return df.select(
        mask_token(session, salt).alias("session_hash"), classify(comment, codes).alias("category"), *rest
    )


def output_guard(c: Column | str) -> Column:
    """struct<answer, grounded>: booking references hidden, policy mention tested."""
    answer = F.regexp_replace(
        tx.strip(F.coalesce(_col(c), F.lit(""))), UNICODE + PII_RULES["pnr"][0], r"\[REDACTED-PNR\]"
    )
    return F.struct(answer.alias("answer"), F.contains(F.lower(answer), F.lit("policy")).alias("grounded"))


def guard_report(checked: DataFrame, day: Column, reason: str = "reason") -> DataFrame:
    """Hits per day and rule."""
    return checked.groupBy(day.alias("day"), F.col(reason).alias("rule")).agg(F.count("*").alias("hits"))
