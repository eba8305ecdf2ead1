"""Split texts into the pre-tokens of byte-level BPE vocabularies, a slice of texts at a time.

The rule is the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  A text is turned into code points, each
code point into a class (letter, number, white space, other), and token starts
follow from the places where the class changes.  Equal pre-tokens of a slice
get one number, so callers do their work once per distinct string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
_BREAK = "\ud800"  # between texts; a lone surrogate is never part of a text
_SAFE_CUT = re.compile("[a-z](?= [a-z])")  # a pre-token always starts at that space
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PIECE_CHARS = 1 << 20


def pattern_classes() -> list[tuple[int, int]]:
    """(first code point, class) of each run of equal class, by the pattern's own properties."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for match in regex.finditer(pattern, every):
            kinds[[ord(c) for c in match.group()]] = kind
    return class_runs(kinds)


def class_runs(kinds: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    return [(int(s), int(kinds[s])) for s in starts]


@dataclass
class Pretokens:
    """Distinct strings of a slice, the number of the string at each position, and tokens per text."""

    words: list[str]
    codes: np.ndarray
    per_text: np.ndarray


class Pretokenizer:
    """Built from class runs, which are small and can be sent to every task."""

    def __init__(self, runs: list[tuple[int, int]]):
        starts = np.array([start for start, _kind in runs] + [0x110000])
        self.kinds = np.repeat(np.array([kind for _start, kind in runs], np.uint8), np.diff(starts))
        self.kinds[ord(_BREAK)] = BREAK

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Flags of token starts; ``points`` begins and ends with a break."""
        kind = self.kinds[points]
        start = np.r_[True, kind[1:] != kind[:-1]] | (kind == BREAK)
        # the last white space before other text: a blank joins it, any other stands alone
        follows = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] < SPACE)) + 1
        start[follows - 1] = True
        start[follows[points[follows - 1] == 0x20]] = False
        # contractions: an apostrophe that starts a token and has the right letters after it
        quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER))
        if len(quote):
            one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | (
                (one == ord("l")) & (two == ord("l"))
            )
            hit = quote[single | double]
            after = hit + np.where(single, 2, 3)[single | double]
            start[hit + 1] = False
            start[after[kind[after] == LETTER]] = True
        return start

    def split(self, texts: list[str]) -> Pretokens:
        owner, pieces = [], []
        for i, text in enumerate(texts):
            for piece in safe_pieces(text):
                owner.append(i)
                pieces.append(piece)
        joined = _BREAK + _BREAK.join(pieces) + _BREAK
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.flatnonzero(self.starts(points)).astype(np.int64)
        length = np.diff(np.r_[first, len(points)])
        breaks = points[first] == ord(_BREAK)
        text_at = np.cumsum(breaks)[~breaks] - 1
        per_text = np.bincount(
            np.array(owner, np.int64)[text_at] if len(text_at) else text_at, minlength=len(texts)
        )
        codes, chosen = _number(points, first, length, ~breaks)
        words = [joined[a:b] for a, b in zip(first[chosen].tolist(), (first + length)[chosen].tolist())]
        return Pretokens(words, codes, per_text)


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cut a very long text where a pre-token starts whatever stands around it."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        pieces.append(text[at:cut.end()])
        at = cut.end()
    return [*pieces, text[at:]]


def _number(
    points: np.ndarray, first: np.ndarray, length: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Number equal tokens; also the token that stands for each number."""
    at = np.arange(len(points), dtype=np.int64) - np.repeat(first, length)
    power = np.full(int(length.max(initial=1)), _MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    values = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[at], first)
    values = (values ^ (values >> np.uint64(29))) * _MULTIPLIER + length.astype(np.uint64)
    tokens = np.flatnonzero(wanted)
    codes, _values = pd.factorize(values[tokens])
    if not len(codes):
        return codes, tokens
    chosen = np.empty(codes.max() + 1, np.int64)
    chosen[codes[::-1]] = tokens[::-1]  # the first of each number
    stands = np.arange(len(first))
    stands[tokens] = chosen[codes]
    same = length[stands] == length
    if same.all():
        same = points[np.repeat(first[stands], length) + at] == points
    if not same.all():  # two strings share a hash value: number the strings themselves
        strings = [points[a:a + n].tobytes() for a, n in zip(first[tokens], length[tokens])]
        codes, _strings = pd.factorize(np.array(strings, dtype=object))
        chosen = np.empty(codes.max() + 1, np.int64)
        chosen[codes[::-1]] = tokens[::-1]
    return codes, chosen
