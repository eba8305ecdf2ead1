"""Secrets in source and configuration text, found by assignment-aware lexing.

Three fixed patterns give the base spans.  On top of them the text is lexed into
name-literal pairs (``name = "x"``, ``"name": "x"``, ``NAME=x``, ``--name x``,
``<name>x</name>``); constants are followed through later assignments and
concatenations, and a literal is scored by the most sensitive name it reaches.

A value is a graph of the pieces it is summed from; a constant is a reference to
its value, not a copy.  What scoring needs of a value is a summary of fixed size,
made from the summaries of its pieces when the value is read, and literals are
marked by one walk from the sensitive names.  So time and memory are linear in
the length of the text, however often constants are used again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import text_slices

KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
LITERAL_LENGTH = 8
LITERAL_SCORE = 1.0  # least score of a reported literal
MASK = "[secret]"

# fixed values: the base patterns and the words that name secrets
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = {
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "credential", "credentials",
}
KEY_OWNERS = {"api", "access", "private", "secret", "auth", "signing", "encryption", "master", "account", "client"}
HARMLESS_ENDS = {
    "length", "count", "name", "path", "file", "url", "uri", "id", "type", "field", "label", "policy", "limit",
    "expiry", "ttl", "hint", "column",
}
STEMS = ("pass", "pwd", "secret", "token", "key", "cred")
PLACEHOLDERS = {"changeme", "change_me", "example", "placeholder", "undefined", "required", "redacted", "your_key_here"}

_HEX_BYTES = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_HEX_RUN = b"h" * HEX_LENGTH
_NAME = r"[A-Za-z_$][\w$.-]*+"
_PAIR = re.compile(rf"""(?<![\w$.-])["']?({_NAME})["']?[ \t]*+(?:=>|:=|=(?!=)|:(?!:))[ \t]*+""")
_FLAG = re.compile(r"(?<!\S)--([A-Za-z][\w-]*+)[ \t]++(?=[^\s-])")
_TAG = re.compile(r"<([A-Za-z][\w.-]*+)>(?=[^<\s]++</)")
_QUOTED = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`''')
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>&+]++""")
_JOIN = re.compile(r"[ \t]*+\+[ \t]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int  # code points
    end: int  # exclusive
    score: float


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern, short ones dropped."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        spans += [
            Span("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH
        ]
    if "AKIA" in text:
        spans += [
            Span("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH
        ]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        spans += [Span("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text) if len(m[0]) >= HEX_LENGTH]
    return spans


def name_weight(name: str) -> float:
    """How sensitive a target name is: 1.5 for secrets, 0 for others and for names of their properties."""
    parts = [part.lower() for part in _PARTS.findall(name.rpartition(".")[2] or name)]
    if not parts or parts[-1] in HARMLESS_ENDS:
        return 0.0
    if SENSITIVE & set(parts):
        return 1.5
    if any(a in KEY_OWNERS and b in ("key", "keys") for a, b in zip(parts, parts[1:])):
        return 1.5
    return 0.0


class Summary(NamedTuple):
    """What scoring needs of a value.

    ``counts`` are characters by code point modulo 128; ``start`` and ``end`` are
    the ends of the value.  Sums that double over and over keep their proportions.
    """

    length: float
    counts: np.ndarray
    start: str
    end: str
    kinds: int  # bits: lower, upper, digit, other, white space
    address: bool  # "://" inside

    @classmethod
    def of(cls, text: str) -> Summary:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = sum(bit for bit, test in _KINDS if any(map(test, text)))
        counts = np.bincount(points & 127, minlength=128).astype(np.float32)
        return cls(float(len(text)), counts, text[:_START], text[-2:], kinds, "://" in text)

    def plus(self, other: Summary) -> Summary:
        length, counts = self.length + other.length, self.counts + other.counts
        if length > 1e12:
            length, counts = length / 1024, counts / 1024
        return Summary(
            length, counts, (self.start + other.start)[:_START], (self.end + other.end)[-2:], self.kinds | other.kinds,
            self.address or other.address or "://" in self.end + other.start[:2],
        )


_START = max(map(len, PLACEHOLDERS)) + 1
_LOWER, _UPPER, _DIGIT, _OTHER, _SPACE = 1, 2, 4, 8, 16
_KINDS = [
    (_LOWER, str.islower), (_UPPER, str.isupper), (_DIGIT, str.isdigit), (_OTHER, lambda c: not c.isalnum()), (_SPACE, str.isspace),
]


def value_weight(value: Summary, quoted: bool) -> float:
    """From -2 (surely no secret) to 0.5 (looks random)."""
    if value.length < LITERAL_LENGTH or value.kinds & _SPACE or (value.length < _START and value.start.lower() in PLACEHOLDERS):
        return -2.0
    present = value.counts[value.counts > 0]
    if value.start[0] in "$<%{" or len(present) <= 3 or value.address:
        return -2.0  # references to other stores, fillers and addresses
    kinds = bin(value.kinds & ~_SPACE).count("1")
    if not quoted and kinds < 2:
        return -2.0  # a plain word
    share = present / present.sum()
    entropy = -float((share * np.log2(share)).sum())
    return 0.5 if entropy >= 3.0 - 1e-9 and kinds >= 2 else -0.25


class Value:
    """The sum of some pieces: spans of literals and other values."""

    __slots__ = ("pieces", "quoted", "summary", "seen")

    def __init__(self, pieces: list, quoted: bool, text: str):
        own = [p.summary if isinstance(p, Value) else Summary.of(text[p[0]:p[1]]) for p in pieces]
        self.pieces, self.quoted, self.summary, self.seen = pieces, quoted, reduce(Summary.plus, own), False

    def unseen_literals(self) -> Iterator[tuple[int, int]]:
        """Spans that the value is made of, without those of values that were walked before."""
        stack = [self]
        while stack:
            value = stack.pop()
            if not value.seen:
                value.seen = True
                for piece in value.pieces:
                    if isinstance(piece, Value):
                        stack.append(piece)
                    else:
                        yield piece


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """Names with their values in order; a name on the right stands for its latest value before."""
    known: dict[str, Value] = {}
    found = sorted(
        (m.end(), m[1]) for pattern in (_PAIR, _FLAG, _TAG) for m in pattern.finditer(text)
    )
    bare_end = 0
    for at, name in found:
        if at < bare_end:
            continue  # inside an unquoted value
        pieces, quoted = [], False
        while True:
            term = _QUOTED.match(text, at)
            if term:
                pieces.append(term.span(term.lastindex))
                quoted = True
            else:
                term = _BARE.match(text, at)
                if not term:
                    break
                if term[0] in known:
                    pieces.append(known[term[0]])
                    quoted |= known[term[0]].quoted
                else:
                    pieces.append(term.span())
                bare_end = term.end()
            join = _JOIN.match(text, term.end())
            if not join:
                break
            at = join.end()
        if pieces:
            value = Value(pieces, quoted, text)
            yield name, value
            if name in known:
                known[name].summary = None  # no later value refers to it
            known[name] = value


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, with their best score."""
    lower = text.lower()
    if not any(stem in lower for stem in STEMS):
        return []
    reached, weights = [], {}
    for name, value in pairs(text):
        if name not in weights:
            weights[name] = name_weight(name)
        if weights[name] and (score := weights[name] + value_weight(value.summary, value.quoted)) >= LITERAL_SCORE:
            reached.append((score, value))
    best: dict[tuple[int, int], float] = {}
    for score, value in sorted(reached, key=lambda r: -r[0]):  # the best score comes first
        for span in value.unseen_literals():
            if span[1] > span[0]:
                best[span] = max(score, best.get(span, 0.0))
    return [Span("literal", a, b, score) for (a, b), score in best.items()]


def spans_of(text: str) -> list[Span]:
    """All spans by start, then kind; literals only where no base span overlaps them."""
    base = base_spans(text)
    more = literal_spans(text)
    if more and base:
        starts = sorted(s.start for s in base)
        reach = list(accumulate((s.end for s in sorted(base, key=lambda s: s.start)), max))
        more = [s for s in more if not _overlaps(s, starts, reach)]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _overlaps(span: Span, starts: list[int], reach: list[int]) -> bool:
    """``reach``: the farthest end among the spans up to each start."""
    before = bisect_left(starts, span.end)
    return before > 0 and reach[before - 1] > span.start


def masked(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by one mask."""
    pieces, at = [], 0
    for span in sorted(spans, key=lambda s: s.start):
        if span.start >= at:
            pieces += [text[at:span.start], MASK]
        at = max(at, span.end)
    return "".join([*pieces, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of kind, start, end, score) of every row.

    NULL text counts as empty.  Repeated rows and NULL keys come out as often as
    they went in; other columns are not read.
    """
    id_name = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [[s._asdict() for s in spans_of(text or "")] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "spans"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(scanned, f"id {id_name}, spans array<struct<kind:string,start:int,end:int,score:double>>")
        .withColumnRenamed("id", id_col)
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked; other rows and columns stay.

    ``length_col`` names a column with the number of characters, kept right for
    changed rows.  NULL text stays NULL.  The schema is that of ``docs``.
    """

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                if text and (spans := spans_of(text)):
                    changed[i] = texts[i] = masked(text, spans)
            if changed:
                names = batch.schema.names
                field = batch.schema.field(text_col)
                batch = batch.set_column(names.index(text_col), field, pa.array(texts, field.type))
                if length_col in names:
                    field = batch.schema.field(length_col)
                    lengths = batch.column(length_col).to_pylist()
                    for i, text in changed.items():
                        lengths[i] = None if lengths[i] is None else len(text)
                    batch = batch.set_column(names.index(length_col), field, pa.array(lengths, field.type))
            yield batch

    return docs.mapInArrow(mask, docs.schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans as text."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        id_col,
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("literal").alias("n_literal"),
    )
