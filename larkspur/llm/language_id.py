"""Language identification with interpolated Kneser-Ney character models.

Each language has a character 5-gram model.  All n-grams of an order, of all
languages, stand in one sorted array of 64-bit hashes with a column of values
per language; contexts have arrays of their own.  A text is scored by its cross
entropy per character under each model, the lowest wins, and a text that even
the best model explains far worse than texts of its language is rejected.

Letters are lower-cased, every run of other characters is one blank, so digits,
punctuation and markup weigh little.  Equal 5-grams of a slice of texts are
scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import text_slices, texts_of
from larkspur.llm.pretokens import LETTER, pattern_classes
from larkspur.llm.sampling import distinct_texts

ORDER = 5
SAMPLE_DOCS = 300  # labelled rows per language that models and calibration are fitted on, at most
CALIBRATION_EVERY = 5  # every fifth of them calibrates
LEAST_Z, MOST_Z = 8.0, 12.0  # how far from its language, in deviations, a text must be to be rejected
UNKNOWN = "und"
KEPT_GRAMS = 500_000  # scored n-grams a task remembers
SLICE_BYTES = 1 << 19  # text scored at once: some 150 bytes of arrays per character
_BREAK = "\ud800"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Letters:
    """Texts as one array of normalised code points: letters, single blanks, 0 between texts."""

    def __init__(self, runs: list[tuple[int, int]]):
        starts = np.array([start for start, _kind in runs] + [0x110000])
        kinds = np.repeat(np.array([kind for _start, kind in runs], np.uint8), np.diff(starts))
        self.table = np.where(kinds == LETTER, np.arange(0x110000), 0x20).astype(np.uint32)
        self.table[ord(_BREAK)] = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Points and the text that each belongs to; every text starts after a 0."""
        joined = (_BREAK + _BREAK.join(texts)).lower()
        points = self.table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = points == 0x20
        blank[1:] &= points[:-1] <= 0x20  # after a blank or a text's start
        points = points[~blank]
        return points, np.cumsum(points == 0) - 1


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each point; nothing stands before a text's start."""
    start = np.maximum.accumulate(np.where(points == 0, np.arange(len(points)), 0))
    hashes, value = [], np.zeros(len(points), np.uint64)
    for back in range(ORDER):
        before = np.zeros(len(points), np.uint64)
        if back < len(points):
            shifted = points[:len(points) - back].astype(np.uint64)
            inside = np.arange(back, len(points)) - back >= start[back:]
            before[back:] = np.where(inside, shifted, 0)
        value = (value ^ (before + np.uint64(back + 1))) * _M1
        value = (value ^ (value >> np.uint64(31))) * _M2
        hashes.append(value)
    return hashes


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_hashes, wanted)
    at[at == len(sorted_hashes)] = 0
    return at, (sorted_hashes[at] == wanted) if len(sorted_hashes) else np.zeros(len(wanted), bool)


@dataclass
class Models:
    """Kneser-Ney models of all languages in sorted hash arrays, and their calibration."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    mass: list[np.ndarray] = field(default_factory=list)  # discounted probability, a column per language
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)  # weight of the lower order; 1 if unseen
    characters: int = 1
    mean: np.ndarray | None = None  # bits per character of texts in the language
    deviation: np.ndarray | None = None  # of one character
    spread: np.ndarray | None = None  # of texts, however long
    slack: np.ndarray | None = None  # bits allowed besides where no text could be held back
    z: float = LEAST_Z
    sharpness: float = 1.0

    def log2_probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 P(last character | context) per n-gram and language; ``contexts[n]`` belongs to order n + 1."""
        p = np.full((len(grams[0]), len(self.languages)), 1.0 / self.characters)
        for n in range(ORDER):
            at, hit = _find(self.contexts[n], contexts[n])
            weight = np.where(hit[:, None], self.backoff[n][at], 1.0)
            at, hit = _find(self.grams[n], grams[n])
            p = np.where(hit[:, None], self.mass[n][at], 0.0) + weight * p
        return np.log2(p)

    def distance(self, bits: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far above its language the entropy of a text of n characters is, in deviations of such texts."""
        deviation = np.sqrt(self.spread[lang] ** 2 + self.deviation[lang] ** 2 / np.maximum(n, 1))
        return (bits - self.mean[lang] - self.slack[lang]) / deviation


def fit_models(counts: pd.DataFrame) -> Models:
    """Models from ``lang``, ``gram`` (ORDER code points, as bytes) and ``n``."""
    languages = sorted(counts["lang"].unique())
    models = Models(languages)
    models.characters = 1
    chars = np.frombuffer(b"".join(counts["gram"]), np.uint32).reshape(len(counts), ORDER)
    lang = np.searchsorted(languages, counts["lang"].to_numpy())
    models.characters = len(np.unique(chars[:, -1])) + 1
    value = [np.zeros(len(chars), np.uint64)]
    context = [np.zeros(len(chars), np.uint64)]
    for back in range(ORDER):  # suffixes of growing length, and the same without the last character
        value.append(_step(value[-1], chars[:, ORDER - 1 - back], back))
        if back:
            context.append(_step(context[-1], chars[:, ORDER - 1 - back], back - 1))
    frame = pd.DataFrame({"lang": lang, "n": counts["n"].to_numpy(np.int64)})
    tables = {}
    for n in range(ORDER, 0, -1):
        rows = pd.DataFrame({"lang": lang, "gram": value[n], "context": context[n - 1]})
        if n == ORDER:
            table = rows.assign(n=frame["n"]).groupby(["lang", "gram", "context"], as_index=False)["n"].sum()
        else:  # distinct characters seen before it
            longer = rows.assign(longer=value[n + 1]).drop_duplicates(["lang", "longer"])
            table = longer.groupby(["lang", "gram", "context"], as_index=False)["longer"].size().rename(
                columns={"size": "n"}
            )
        tables[n] = table
    for n in range(1, ORDER + 1):
        table = tables[n]
        singles = np.bincount(table["lang"][table["n"] == 1], minlength=len(languages))
        doubles = np.bincount(table["lang"][table["n"] == 2], minlength=len(languages))
        discount = np.clip((singles + 0.5) / (singles + 2 * doubles + 1.0), 0.1, 0.9)
        own = discount[table["lang"]]
        total = table.groupby(["lang", "context"])["n"].agg(["sum", "size"])
        sums = total["sum"].reindex(pd.MultiIndex.from_frame(table[["lang", "context"]])).to_numpy()
        grams, at = np.unique(table["gram"].to_numpy(np.uint64), return_inverse=True)
        mass = np.zeros((len(grams), len(languages)))
        mass[at, table["lang"]] = (table["n"] - own).to_numpy() / sums
        owner = total.index.get_level_values(0).to_numpy()
        contexts, at = np.unique(total.index.get_level_values(1).to_numpy(np.uint64), return_inverse=True)
        backoff = np.ones((len(contexts), len(languages)))
        backoff[at, owner] = discount[owner] * total["size"].to_numpy() / total["sum"].to_numpy()
        models.grams.append(grams)
        models.mass.append(mass)
        models.contexts.append(contexts)
        models.backoff.append(backoff)
    return models


def _step(value: np.ndarray, chars: np.ndarray, back: int) -> np.ndarray:
    value = (value ^ (chars.astype(np.uint64) + np.uint64(back + 1))) * _M1
    return (value ^ (value >> np.uint64(31))) * _M2


class Scorer:
    """Scores texts; n-grams that came before are remembered."""

    def __init__(self, models: Models, runs: list[tuple[int, int]]):
        self.models, self.letters = models, Letters(runs)
        self.known = np.empty(0, np.uint64)
        self.scores = np.empty((0, len(models.languages)), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character (texts x languages), characters scored, and letters among them."""
        points, owner = self.letters(texts)
        hashes = gram_hashes(points)
        kept = np.flatnonzero(points)
        codes, distinct = pd.factorize(hashes[-1][kept])
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = kept[::-1]
        logs = self._scored(distinct, first, hashes)
        n = np.bincount(owner[kept], minlength=len(texts))
        letters = np.bincount(owner[points > 0x20], minlength=len(texts))
        bits = np.stack(
            [np.bincount(owner[kept], -logs[codes, k], len(texts)) for k in range(logs.shape[1])], axis=1
        )
        return bits / np.maximum(n, 1)[:, None], n, letters

    def _scored(self, distinct: np.ndarray, first: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        at, hit = _find(self.known, distinct)
        logs = np.empty((len(distinct), self.scores.shape[1]), np.float32)
        logs[hit] = self.scores[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            where = first[new]
            empty = np.zeros(len(new), np.uint64)
            logs[new] = self.models.log2_probability(
                [h[where] for h in hashes], [empty, *[h[where - 1] for h in hashes[:-1]]]
            )
            if len(self.known) + len(new) <= KEPT_GRAMS:
                order = np.argsort(distinct[new])
                place = np.searchsorted(self.known, distinct[new][order])
                self.known = np.insert(self.known, place, distinct[new][order])
                self.scores = np.insert(self.scores, place, logs[new][order], axis=0)
        return logs

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, bits per character, and whether the text is accepted."""
        models = self.models
        none = np.zeros(len(texts))
        if not models.languages:
            return [UNKNOWN] * len(texts), none, none, none > 0
        bits, n, letters = self.entropies(texts)
        best = bits.argmin(axis=1)
        lowest = bits.min(axis=1)
        odds = np.exp2(-np.minimum((bits - lowest[:, None]) * n[:, None] * models.sharpness, 1000.0))
        score = np.where(letters > 0, 1.0 / odds.sum(axis=1), 0.0)
        accepted = (letters > 0) & (models.distance(lowest, n, best) <= models.z)
        names = [models.languages[k] if has else UNKNOWN for k, has in zip(best.tolist(), letters.tolist())]
        return names, score, lowest, accepted


def learned_rows(id_col: Column) -> Column:
    """The rows that may be learned from: CRC-32 of the key as text, modulo 3, is not 1."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) != 1


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
) -> Models:
    """Fit and calibrate on at most ``sample_docs`` labelled texts per language, those with the smallest hashes.

    Learns from rows with a key, a text and a language whose key is not held out
    (``learned_rows``).  A text counts once per language however often it is repeated;
    whole texts are used.  Without any such row there is no language and every text
    is ``und``.
    """
    labelled = docs.where(learned_rows(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = distinct_texts(labelled, "text", sample_docs, "lang")
    runs = pattern_classes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(runs)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            points, owner = letters(texts_of(batch, "text"))
            names, lang = np.unique(np.array(batch.column("lang").to_pylist())[owner], return_inverse=True)
            yield from _gram_batches(points, names, lang)

    grams = (
        sample.where(F.col("turn") % CALIBRATION_EVERY != 0)
        .mapInArrow(counted, "lang string, gram binary, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    )
    if not len(grams):
        return Models([])
    models = fit_models(grams)
    _calibrate(models, sample.where(F.col("turn") % CALIBRATION_EVERY == 0), sample, runs)
    return models


def _gram_batches(points: np.ndarray, names: np.ndarray, lang: np.ndarray) -> Iterator[pa.RecordBatch]:
    start = np.maximum.accumulate(np.where(points == 0, np.arange(len(points)), 0))
    window = np.zeros((len(points), ORDER), np.uint32)
    for back in range(min(ORDER, len(points))):
        inside = np.arange(back, len(points)) - back >= start[back:]
        window[back:, ORDER - 1 - back] = np.where(inside, points[:len(points) - back], 0)
    kept = np.flatnonzero(points)
    codes, _values = pd.factorize(gram_hashes(points)[-1][kept] ^ (lang[kept].astype(np.uint64) * _M1))
    first = np.empty(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = kept[::-1]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(names[lang[first]].tolist(), pa.string()),
            pa.array([row.tobytes() for row in window[first]], pa.binary()),
            pa.array(np.bincount(codes), pa.int64()),
        ],
        ["lang", "gram", "n"],
    )


def _calibrate(models: Models, held: DataFrame, sample: DataFrame, runs: list[tuple[int, int]]) -> None:
    """Centre and spread of cross entropies per language, the rejection level and the sharpness of scores.

    Medians, so that a few odd or mislabelled texts do not count.  The rejection
    level lies between the distances of held-back texts from their language and
    their distances from the best other one, which is where they would go had
    their language not been learned.  A language of which nothing could be held
    back accepts texts up to midway to the bits of an even guess.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models, runs)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            bits, n, letters = scorer.entropies(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(letters)],
                ["lang", "bits", "n", "letters"],
            )

    schema = "lang string, bits array<double>, n long, letters long"
    rows = held.mapInArrow(scored, schema).toPandas()  # bounded by the sample
    rows = rows[(rows["letters"] > 0) & rows["lang"].isin(models.languages)]
    blind = not len(rows)
    if blind:  # too few labelled rows to hold any back
        rows = sample.mapInArrow(scored, schema).toPandas()
        rows = rows[(rows["letters"] > 0) & rows["lang"].isin(models.languages)]
    bits, n = np.stack(rows["bits"]), rows["n"].to_numpy(np.float64)
    own = np.searchsorted(models.languages, rows["lang"].to_numpy())
    value = bits[np.arange(len(own)), own]
    size = len(models.languages)
    pooled = _median(value, n)
    models.mean = np.array([_median(value[own == k], n[own == k]) if (own == k).any() else pooled for k in range(size)])
    off = np.abs(value - models.mean[own])

    def widest(values: np.ndarray) -> np.ndarray:  # median deviations of few texts are often too small
        every = 1.4826 * float(np.median(values))
        return np.array([max(every, 1.4826 * float(np.median(values[own == k]))) if (own == k).any() else every
                         for k in range(size)])

    models.deviation = np.maximum(widest(off * np.sqrt(n)), 1.0)
    texts, characters = np.bincount(own, minlength=size), np.bincount(own, n, size)
    unsure = 1 / np.maximum(texts, 1)  # of the centre itself
    models.spread = np.sqrt(widest(off) ** 2 * (1 + unsure) + models.deviation ** 2 / np.maximum(characters, 1))
    models.slack = np.where((texts == 0) | blind, max(np.log2(models.characters) - pooled, 0.0) / 2, 0.0)
    models.z = LEAST_Z
    if size > 1:
        others = bits.copy()
        others[np.arange(len(own)), own] = np.inf
        other = others.argmin(axis=1)
        inside = np.quantile(models.distance(value, n, own), 0.99)
        outside = np.quantile(models.distance(others.min(axis=1), n, other), 0.05)
        models.z = float(np.clip((inside + outside) / 2, LEAST_Z, MOST_Z))
    gap = (bits - value[:, None]) * n[:, None]
    losses = {
        s: np.log2(np.exp2(-np.clip(gap * s, -500, 500)).sum(axis=1)).mean() for s in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
    }
    models.sharpness = min(losses, key=losses.get)


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``bits_per_char`` and ``accepted`` of every row.

    ``und`` with score 0, not accepted, if the text is NULL or has no letter.
    Equal entropies go to the language that sorts first.  Only the text is used;
    repeated rows and NULL keys come out as often as they went in.
    """
    id_name = docs.schema[id_col].dataType.simpleString()
    runs = pattern_classes()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models, runs)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            names, score, bits, accepted = scorer.decide(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(accepted)],
                ["id", "lang_pred", "score", "bits_per_char", "accepted"],
            )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(
            decided, f"id {id_name}, lang_pred string, score double, bits_per_char double, accepted boolean"
        )
        .withColumnRenamed("id", id_col)
    )


def keep_accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, unchanged and with all their columns."""
    runs = pattern_classes()

    def accepted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models, runs)
        for batch in text_slices(batches, text_col, SLICE_BYTES):
            *_rest, accepted = scorer.decide(texts_of(batch, text_col))
            yield batch.filter(pa.array(accepted))

    return docs.mapInArrow(accepted_rows, docs.schema)


