"""Token counts with a whole-token shortcut.

Proved beforehand, by running the vocabulary through its own tokenizer: which
strings encode alone as exactly one token.  A pre-token that is such a string
counts 1; only the others are merged, once per distinct string of a slice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import text_slices, texts_of
from larkspur.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, Pretokenizer, class_runs

KEPT_WORDS = 200_000  # merged strings a task remembers


def byte_alphabet() -> dict[int, str]:
    """Byte to letter, as byte-level vocabularies write it: printable Latin-1 stays, the rest moves up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def tokenizer_classes(tokenizer) -> list[tuple[int, int]]:
    """Class runs as the tokenizer's own splitter sees them, so Unicode versions agree."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    kinds = np.zeros(0x110000, np.uint8)
    for _mapped, (start, end) in split(every):
        start += every[start] == " " and end - start > 1  # a blank joins what follows
        char = every[start]
        kind = next(
            (k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + char)) == 1), SPACE
        )
        kinds[points[start]:points[end - 1] + 1] = kind
    kinds[0x20] = SPACE
    return class_runs(kinds)


def special_strings(tokenizer) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else."""
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("added tokens with strip or word rules are not supported")
    return [t.content for t in added]


def whole_tokens(tokenizer) -> list[str]:
    """Vocabulary strings that encode alone as one token."""
    back = {letter: byte for byte, letter in byte_alphabet().items()}
    special = set(special_strings(tokenizer))
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(back[letter] for letter in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # not a text of its own: it never is a whole pre-token
    strings = [s for s in strings if s not in special]
    return [
        s for s, encoded in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False))
        if len(encoded.ids) == 1
    ]


class WordCounts(dict):
    """Tokens of a pre-token; whole tokens are known from the start, others are merged when first asked for."""

    def __init__(self, tokenizer, whole: list[str]):
        self._whole = dict.fromkeys(whole, 1)
        super().__init__(self._whole)
        self._merge = tokenizer.model.tokenize
        self._letters = byte_alphabet()

    def __missing__(self, word: str) -> int:
        count = len(self._merge(word.encode().decode("latin-1").translate(self._letters)))
        if len(self) > len(self._whole) + KEPT_WORDS:
            self.clear()
            self.update(self._whole)
        self[word] = count
        return count


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs``.

    The numbers are those of the ``tokenizers`` library for a byte-level BPE
    file, no begin or end tokens added.  NULL text counts as empty: 0 and 0.
    Repeated rows and NULL keys come out as often as they went in; other columns
    are not read.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    check_supported(json.loads(source))
    tokenizer = Tokenizer.from_str(source)
    classes, whole, special = tokenizer_classes(tokenizer), whole_tokens(tokenizer), special_strings(tokenizer)
    id_name = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Pretokenizer(classes)
        known = WordCounts(Tokenizer.from_str(source), whole)
        cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in text_slices(batches, "text"):
            counts = _counts(texts_of(batch, "text"), split, known, cut)
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(counted, f"id {id_name}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", id_col)
    )


def _counts(texts: list[str], split: Pretokenizer, known: WordCounts, cut: re.Pattern | None) -> np.ndarray:
    pieces, owner = [], []
    total = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = cut.split(text) if cut else [text]
        total[i] = len(parts) - 1  # each special string is one token
        pieces += parts
        owner += [i] * len(parts)
    tokens = split.split(pieces)
    each = np.fromiter((known[word] for word in tokens.words), np.int64, len(tokens.words))
    if len(tokens.codes):
        text_at = np.repeat(np.array(owner), tokens.per_text)
        total += np.bincount(text_at, each[tokens.codes], len(texts)).astype(np.int64)
    return total


def check_supported(source: dict) -> None:
    """Raise unless the file is plain byte-level BPE."""
    before, model = source.get("pre_tokenizer") or {}, source["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or source.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE files are supported")
