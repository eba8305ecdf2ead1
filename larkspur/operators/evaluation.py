"""Evaluation: scorers as columns, text metrics, run comparison and gates."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.operators.skew import BROADCAST_BYTES, join_hot_keys
from larkspur.operators.windows import latest_by_key
from larkspur.session import cut_lineage

# Case-sensitive citation markers.
CITATION_MARKERS = ["Fare Rules", "fare rules", "policy", "source", "§"]
# Scorecard targets.
TARGETS = {"correctness": 0.85, "groundedness": 0.90, "p95_ms": 3000.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def feedback(value: Column, rationale: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), rationale.alias("rationale"))


def response_length(c: Column | str) -> Column:
    """0 below 5 words, 0.5 above 120, else 1, with the reason."""

    def score(n: Column) -> Column:
        count = F.concat(F.lit("("), n.cast("string"), F.lit(" words)"))
        value = F.when(n < 5, 0.0).when(n > 120, 0.5).otherwise(1.0)
        reason = F.when(n < 5, "Response too short ").when(n > 120, "Response quite long ").otherwise("Appropriate length ")
        return feedback(value, F.concat(reason, count))

    return tx.let(tx.word_count(F.coalesce(_col(c), F.lit(""))), score)


def cites(c: Column | str, markers: list[str] | None = None) -> Column:
    """1 when any marker occurs, with the reason."""
    hit = F.coalesce(tx.contains_any(c, CITATION_MARKERS if markers is None else markers), F.lit(False))
    reason = F.when(hit, "cites a policy / source reference").otherwise("no policy citation found")
    return feedback(hit.cast("double"), reason)


def fact_coverage(answer: Column | str, facts: Column | str) -> Column:
    """Share of facts of which enough longer words occur in the answer; NULL without facts.

    A fact counts when at least max(1, n // 2) of its n words of more than
    three letters are substrings of the lower-cased answer.
    """
    facts = _col(facts)

    def covered(low: Column, fact: Column) -> Column:
        def enough(long_words: Column) -> Column:
            hits = F.size(F.filter(long_words, lambda w: F.contains(low, w)))
            return hits >= F.greatest(F.lit(1), F.floor(F.size(long_words) / 2))

        return tx.let(F.filter(tx.words(F.lower(fact)), lambda w: F.length(w) > 3), enough)

    count = tx.let(F.lower(_col(answer)), lambda low: F.size(F.filter(facts, lambda f: covered(low, f))))
    return F.when(F.size(facts) > 0, count / F.size(facts))


def skip_without(expectation: Column | str, score: Column) -> Column:
    """Reference-based scores are NULL on rows without the expectation."""
    return F.when(_col(expectation).isNotNull(), score)


def token_support(claim: Column | str, context: Column | str) -> Column:
    """Share of the distinct claim tokens that occur in the context; NULL for an empty claim."""
    claimed = F.array_distinct(tx.tokens(claim))
    return tx.let(
        claimed,
        lambda c: F.size(F.array_intersect(c, tx.tokens(context))) / F.nullif(F.size(c), F.lit(0)),
    )


def exact_match(a: Column | str, b: Column | str) -> Column:
    """1 when the normalized texts are equal; NULL when the reference is missing."""
    return F.when(_col(b).isNotNull(), (tx.normalized(a) == tx.normalized(b)).cast("double"))


def clipped_counts(hypothesis: list[str], reference: list[str], n: int) -> tuple[int, int, int]:
    """N-grams in common (each as often as in the side that has fewer), in the hypothesis, in the reference."""
    mine = Counter(zip(*(hypothesis[k:] for k in range(n))))
    other = Counter(zip(*(reference[k:] for k in range(n))))
    return (mine & other).total(), mine.total(), other.total()


def _clipped(orders: tuple[int, ...]):
    """Per row, the three counts of every order, as one array: nothing is exploded or shuffled."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = (([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b))
        return pd.Series([[c for n in orders for c in clipped_counts(x, y, n)] for x, y in sides])

    return count


def rouge_n(pairs: DataFrame, key: str, hypothesis: str, reference: str, n: int) -> DataFrame:
    """ROUGE-N recall, precision and F1 per pair, from clipped n-gram counts; 0 without any n-gram."""
    counted = pairs.select(key, _clipped((n,))(tx.tokens(hypothesis), tx.tokens(reference)).alias("_c"))
    o, h, r = (F.col("_c")[i] for i in range(3))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    return counted.select(
        key, share(o, r).alias("recall"), share(o, h).alias("precision"), share(2.0 * o, h + r).alias("f1")
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every  # a zero bit is a step up in the row
    for x in a:
        hits = row & places.get(x, 0)
        row = ((row + hits) | (row - hits)) & every
    return len(b) - row.bit_count()


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """ROUGE-L F1 per pair from the longest common token subsequence."""
    staged = pairs.select(key, tx.tokens(hypothesis).alias("_h"), tx.tokens(reference).alias("_r"))
    total = F.size("_h") + F.size("_r")
    score = F.coalesce(2.0 * F.col("_l") / F.nullif(total, F.lit(0)), F.lit(0.0))
    return staged.withColumn("_l", _lcs("_h", "_r")).select(key, score.alias("rouge_l"))


def bleu(pairs: DataFrame, key: str, hypothesis: str, reference: str, orders: int = 4) -> DataFrame:
    """Corpus BLEU: clipped precisions of order 1 to 4 over all pairs and the brevity penalty.

    One pass: the counts of all orders are taken inside the row, only their
    sums leave it.  0 if an order has no n-gram in common.
    """
    counts = _clipped(tuple(range(1, orders + 1)))(tx.tokens(hypothesis), tx.tokens(reference))
    sums = pairs.select(counts.alias("_c")).agg(
        *[F.sum(F.col("_c")[3 * n]).alias(f"clipped{n}") for n in range(orders)],
        *[F.sum(F.col("_c")[3 * n + 1]).alias(f"total{n}") for n in range(orders)],
        F.sum(F.col("_c")[2]).alias("reference"),
    )
    logs = [F.log(F.col(f"clipped{n}") / F.col(f"total{n}")) for n in range(orders)]
    least = F.least(*[F.col(f"clipped{n}") for n in range(orders)]) if orders > 1 else F.col("clipped0")
    penalty = F.least(F.lit(0.0), 1.0 - F.col("reference") / F.nullif("total0", F.lit(0)))
    mean_log = reduce(lambda a, b: a + b, logs) / orders
    return sums.select(F.when(least > 0, F.exp(penalty + mean_log)).otherwise(0.0).alias("bleu"))


ENTRY_BYTES = 48  # of one vocabulary entry in a broadcast, besides its term


def unigram_perplexity(documents: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Perplexity of each document under an add-one unigram model of the corpus.

    The term counts are stored first; their measured size decides the way back.  The
    most frequent terms, as many as a checked broadcast holds, are looked up token
    by token and nothing but one sum per document is shuffled.  Tokens of the other
    terms, which are few because those terms are rare, are stored and
    joined by term; terms that very many of them have are spread by the hot-key join.
    """
    tokens = F.explode(tx.tokens(text)).alias("term")
    model = cut_lineage(corpus.select(tokens).groupBy("term").agg(F.count("*").alias("cf")))
    level = F.floor(F.log2("cf")).cast("int")
    sizes = model.groupBy(level.alias("level")).agg(
        F.sum("cf").alias("n"), F.count("*").alias("v"), F.sum(F.octet_length("term") + ENTRY_BYTES).alias("bytes")
    ).collect()  # at most 64 rows
    total = sum(r["n"] + r["v"] for r in sizes) + 1
    surprise = -F.log((F.coalesce("cf", F.lit(0)) + 1) / F.lit(total))
    least, held = 64, 0  # terms of this level and above are broadcast
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["bytes"]
        if held > BROADCAST_BYTES:
            break
        least = r["level"]
    every = documents.select(key, tokens)
    if held <= BROADCAST_BYTES:
        found = every.join(F.broadcast(model), "term", "left")
        return found.groupBy(key).agg(F.exp(F.avg(surprise)).alias("perplexity"))
    parts = [F.sum(surprise).alias("s"), F.count("*").alias("n")]
    frequent = F.broadcast(model.where(level >= least))
    known = every.join(frequent, "term").groupBy(key).agg(*parts)
    rest = cut_lineage(every.join(frequent.select("term"), "term", "left_anti"))
    times = rest.groupBy("term").agg(F.count("*").alias("times"))
    rare = cut_lineage(times.join(model.where(level < least), "term", "left"))
    joined = join_hot_keys(rest, rare, "term", "times", [F.col(key), F.monotonically_increasing_id()]).groupBy(key).agg(*parts)
    return known.unionAll(joined).groupBy(key).agg(F.exp(F.sum("s") / F.sum("n")).alias("perplexity"))


def run_means(scores: DataFrame, run: str, scorers: list[str]) -> DataFrame:
    """Mean of each scorer per run, as rows (run, scorer, mean)."""
    means = scores.groupBy(run).agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in scorers])
    return means.unpivot([run], scorers, "scorer", "mean").where(F.col("mean").isNotNull())


def choose_winner(means: DataFrame, run: str, base: str, candidate: str) -> DataFrame:
    """Base or candidate: higher (correctness, groundedness) wins unless safety fell.

    A missing correctness on either side counts as better for the candidate.
    """
    wide = means.groupBy().agg(
        *[
            F.max(F.when((F.col(run) == r) & (F.col("scorer") == s), F.col("mean"))).alias(f"{s}_{n}")
            for r, n in ((base, 1), (candidate, 2))
            for s in ("correctness", "groundedness", "safety")
        ]
    )
    safe = F.coalesce(F.col("safety_2") >= F.col("safety_1") - 1e-9, F.lit(True))
    c1, c2 = F.col("correctness_1"), F.col("correctness_2")
    tie = (c2 == c1) & F.coalesce(F.col("groundedness_2") > F.col("groundedness_1"), F.lit(False))
    better = F.when(c1.isNull() | c2.isNull(), True).otherwise((c2 > c1) | tie)
    return wide.withColumn("safety_ok", safe).withColumn(
        "winner", F.when(F.col("safety_ok") & better, candidate).otherwise(base)
    )


def promotion_gate(means: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Passed only when there are metrics and every mean reaches the threshold."""
    return means.agg(
        F.count("*").alias("metrics"),
        F.coalesce(F.bool_and(F.col("mean") >= threshold), F.lit(False)).alias("passed"),
    )


def calibration(rows: DataFrame, judge: str, human: str, slices: list[str]) -> DataFrame:
    """Agreement and confusion counts of a judge against human labels, per slice."""
    j, h = F.col(judge), F.col(human)
    return rows.groupBy(*slices).agg(
        F.count("*").alias("n"),
        F.avg((j == h).cast("double")).alias("agreement"),
        F.count_if(j & h).alias("true_pos"),
        F.count_if(j & ~h).alias("false_pos"),
        F.count_if(~j & h).alias("false_neg"),
        F.count_if(~j & ~h).alias("true_neg"),
    )


def length_band(words: Column) -> Column:
    """pass for 40-110 words, review for 25-39 and 111-140, else fail."""
    return F.when(words.between(40, 110), "pass").when(words.between(25, 140), "review").otherwise("fail")


def slice_report(rows: DataFrame, band: str, before: str, after: str, tolerance: float = 0.0) -> DataFrame:
    """Means per band of two versions, with a flag where a band got worse."""
    means = rows.groupBy(band).agg(
        F.count("*").alias("n"), F.avg(before).alias("before"), F.avg(after).alias("after")
    )
    return means.withColumn("regressed", F.col("after") < F.col("before") - tolerance)


# Cumulative probabilities of a Poisson(1) count of 0, 1, 2, ...
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def bootstrap_interval(rows: DataFrame, key: str, score: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean from Poisson(1) replicates, seeded by the row key.

    Each replicate keeps two sums, combined on the map side; only one row per
    replicate and task is shuffled.
    """
    drawn = rows.where(F.col(score).isNotNull()).select(
        key, F.col(score).cast("double").alias("_y"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_b")
    )
    u = tx.hash_fraction(key, "_b")
    weight = reduce(lambda acc, p: acc + (F.col("_u") >= p).cast("int"), POISSON_ONE, F.lit(0))
    weighted = drawn.withColumn("_u", u).withColumn("_w", weight)
    means = weighted.groupBy("_b").agg((F.sum(F.col("_w") * F.col("_y")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    tail = (1 - level) / 2
    return means.agg(
        F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high")
    ).withColumn("mean", rows.agg(F.avg(F.col(score).cast("double"))).scalar())


def worst_rows(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """Lowest scores first, unscored rows last, ties by key."""
    return rows.orderBy(F.col(score).asc_nulls_last(), key).limit(n)


def flipped_rows(before: DataFrame, after: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Rows whose pass or fail changed between two runs."""
    a = before.select(key, (F.col(score) >= threshold).alias("passed_before"))
    b = after.select(key, (F.col(score) >= threshold).alias("passed_after"))
    return a.join(b, key).where(F.col("passed_before") != F.col("passed_after"))


def recheck_failures(failures: DataFrame, scores: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Past failures scored again: still failing or fixed."""
    known = failures.select(key).distinct()
    again = scores.join(known, key, "left_semi")
    return again.select(key, score, F.when(F.col(score) >= threshold, "fixed").otherwise("failing").alias("state"))


def traffic_arm(user: Column | str, challenger_percent: int = 10, salt: str = "split") -> Column:
    """A fixed arm per user: challenger for the given share of hash space."""
    return F.when(
        tx.hash_fraction(F.lit(salt), user) < challenger_percent / 100.0, "challenger"
    ).otherwise("champion")


def sampled(ids: Column | str, scorer: str, rate: float) -> Column:
    """Whether a row is scored: a fixed share of hash space per scorer."""
    return tx.hash_fraction(F.lit(scorer), ids) < rate


def child_runs(runs: DataFrame, run: str = "run_id", parent: str = "parent_id") -> DataFrame:
    """Child runs and their best score per parent run."""
    return runs.where(F.col(parent).isNotNull()).groupBy(parent).agg(
        F.count(run).alias("children"), F.max("score").alias("best"), F.max_by(run, F.struct("score", run)).alias("best_run")
    )


def scorecard(values: DataFrame, targets: dict[str, float] | None = None, lower_is_better: tuple[str, ...] = ("p95_ms",)) -> DataFrame:
    """Measured values (metric, value) against targets, with a pass flag.

    A metric without a measured value fails.
    """
    targets = TARGETS if targets is None else targets
    spark = values.sparkSession
    wanted = spark.createDataFrame(
        [(m, float(t), m in lower_is_better) for m, t in targets.items()], "metric string, target double, _lower boolean"
    )
    joined = wanted.join(values, "metric", "left")
    met = F.when(F.col("_lower"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return joined.withColumn("passed", F.coalesce(met, F.lit(False))).drop("_lower")


# Format rules tested on normalized text.
FORMAT_RULES = {
    "contact_present": r"(?:\+?\d[\d .()-]{7,}\d|[\w.+-]+@[\w-]+\.[\w.-]+)",
    "date_present": r"\b\d{4}-\d{2}-\d{2}\b",
    "flight_code": r"\b[A-Z]{2}\d{3,4}\b",
}


def format_score(c: Column | str, rule: str) -> Column:
    """1 when the rule's pattern occurs in the text with whitespace runs collapsed."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " ")
    hit = F.regexp_like(text, F.lit(FORMAT_RULES[rule]))
    return feedback(hit.cast("double"), F.when(hit, f"{rule}: found").otherwise(f"{rule}: not found"))


def limit_score(value: Column, limit: float) -> Column:
    """1 when a number stays within its business limit; NULL stays NULL."""
    hit = value <= limit
    return F.when(value.isNotNull(), feedback(hit.cast("double"), F.when(hit, "within limit").otherwise("over limit")))


def label_summary(labels: DataFrame, label: str) -> DataFrame:
    """Count per expert label."""
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def review_queue(feedback_rows: DataFrame, positive: str, newest: str, key: str, n: int = 20) -> DataFrame:
    """The newest rows with negative feedback."""
    latest = latest_by_key(feedback_rows, [key], [F.col(newest)])
    return latest.where(~F.col(positive)).orderBy(F.col(newest).desc(), key).limit(n)
