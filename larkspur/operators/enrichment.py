"""Rule- and statistics-based text enrichment with the batch-function contract.

Each function keeps the shape of its hosted counterpart: one column in, one
column out, NULL in gives NULL out, one bad row never fails the job.  Results
come from the rules passed in, not from a language model.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as tx
from larkspur.functions.similarity import cosine
from larkspur.operators.guard import mask_entities
from larkspur.operators.skew import join_hot_keys
from larkspur.operators.vectors import TextEmbedder
from larkspur.session import cut_lineage, work_dir

OTHER = "other"


def _hits(token_array: Column, keywords: list[str]) -> Column:
    return F.size(F.filter(token_array, lambda t: t.isin([k.lower() for k in keywords])))


def label_scores(text: Column | str, rules: dict[str, list[str]], token_array: Column | None = None) -> Column:
    """Array of (label, score) in label order: how many tokens are keywords of it."""

    def scores(token_array: Column) -> Column:
        return F.array(
            *[F.struct(F.lit(label).alias("label"), _hits(token_array, words).alias("score")) for label, words in rules.items()]
        )

    return tx.let(tx.tokens(text) if token_array is None else token_array, scores)


def classify(
    text: Column | str, rules: dict[str, list[str]], other: str = OTHER, token_array: Column | None = None
) -> Column:
    """The label with the most keyword hits; the earlier label wins a tie; none gives ``other``.

    Pass ``token_array`` when several functions read the same text, so that it is
    split only once.
    """
    text = F.col(text) if isinstance(text, str) else text

    def best(scored: Column) -> Column:
        # the earliest of the best: structs compare by score, then by negated place
        placed = F.transform(scored, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("place"), s["label"].alias("label")))
        top = F.array_max(placed)
        return F.when(top["score"] > 0, top["label"]).otherwise(other)

    return F.when(text.isNotNull(), tx.let(label_scores(text, rules, token_array), best))


def rules_from_descriptions(descriptions: dict[str, str], other: str = OTHER) -> dict[str, list[str]]:
    """Keyword rules from labels with a short description each, for ``classify``.

    Keywords are the label's own words and the description's, words of fewer
    than four letters left out; the catch-all label has none.
    """
    rules = {}
    for label, text in descriptions.items():
        if label != other:
            words = re.findall(r"\w+", f"{label} {text}".lower())
            rules[label] = list(dict.fromkeys(w for w in words if len(w) >= 4))
    return rules


def classify_many(text: Column | str, rules: dict[str, list[str]], threshold: int = 0) -> Column:
    """Every label with more hits than the threshold, sorted."""
    text = F.col(text) if isinstance(text, str) else text
    over = F.filter(label_scores(text, rules), lambda s: s["score"] > threshold)
    return F.when(text.isNotNull(), F.sort_array(F.transform(over, lambda s: s["label"])))


def sentiment(
    text: Column | str, positive: list[str], negative: list[str], threshold: int = 0, token_array: Column | None = None
) -> Column:
    """positive, negative, mixed (both above the threshold) or neutral."""
    text = F.col(text) if isinstance(text, str) else text

    def decide(found: Column) -> Column:
        good, bad = _hits(found, positive) > threshold, _hits(found, negative) > threshold
        return F.when(good & bad, "mixed").when(good, "positive").when(bad, "negative").otherwise("neutral")

    token_array = tx.tokens(text) if token_array is None else token_array
    return F.when(text.isNotNull(), tx.let(token_array, decide))


def summary_of(text: str, max_words: int) -> str:
    """Leading sentences by mean word frequency, in text order, cut at the word limit."""
    sentences = [s.strip() for s in re.findall(r"[^.!?]*[.!?]+|[^.!?]+", text) if s.strip()]
    bags = [re.findall(r"\w+", s.lower()) for s in sentences]
    counts = Counter(word for bag in bags for word in bag)
    ranked = sorted(
        range(len(sentences)),
        key=lambda i: (-(sum(counts[w] for w in bags[i]) / len(bags[i]) if bags[i] else 0.0), i),
    )
    chosen, used = [], 0
    for i in ranked:
        size = len(sentences[i].split())
        if max_words and chosen and used + size > max_words:
            continue
        chosen.append(i)
        used += size
    words = " ".join(sentences[i] for i in sorted(chosen)).split()
    return " ".join(words[:max_words] if max_words else words)


def summarize(max_words: int = 50) -> Callable[[Column], Column]:
    """Extractive summary of at most ``max_words`` words (0 keeps every sentence)."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else summary_of(s, max_words))

    return run


def similarity(model: TextEmbedder, df: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Cosine of the vectors of two text columns under one model."""
    both = model.embed(model.embed(df, left, "_a"), right, "_b")
    return both.withColumn(out, cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def batch_infer(
    df: DataFrame, key: str, text: str, fn: Callable[[str], str], fail_on_error: bool = False
) -> DataFrame:
    """Apply ``fn`` to every non-NULL text: (key, struct<response, errorMessage>).

    With ``fail_on_error`` off an exception fills ``errorMessage`` of its own
    row and the job goes on.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField(
                "result", T.StructType([T.StructField("response", T.StringType()), T.StructField("errorMessage", T.StringType())])
            ),
        ]
    )

    def one(value: str) -> dict:
        try:
            return {"response": fn(value), "errorMessage": None}
        except Exception as error:  # noqa: BLE001 - any failure belongs to its row
            if fail_on_error:
                raise
            return {"response": None, "errorMessage": f"{type(error).__name__}: {error}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "result": [one(v) for v in batch[text]]})

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)


def parse_results(results: DataFrame, key: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, failed rows): JSON responses as typed fields, errors as a sidecar.

    A response that is no valid JSON object counts as failed too.
    """
    typed = results.select(
        key, F.from_json("result.response", ddl).alias("fields"), F.col("result.errorMessage").alias("error"),
        F.json_object_keys("result.response").isNull().alias("_bad"),
    )
    ok = F.col("error").isNull() & ~F.col("_bad")
    failed = typed.where(~ok).select(key, F.coalesce("error", F.lit("response is not a JSON object")).alias("error"))
    return typed.where(ok).select(key, "fields.*"), failed


def infer_distinct(df: DataFrame, key: str, text: str, fn: Callable[[str], str]) -> DataFrame:
    """Score each distinct normalized text once and give every row its answer.

    Copies collapse before the function runs and its answers are stored in the
    shared folder, so no plan step calls it again.  The way back spreads the
    rows of a text that very many rows share.
    """
    digest, given = F.sha2(tx.normalized(text), 256).alias("_h"), df.where(F.col(text).isNotNull())
    keyed = cut_lineage(given.select(key, digest))
    copies = cut_lineage(keyed.groupBy("_h").agg(F.count("*").alias("_copies")))
    once = given.select(digest, tx.normalized(text).alias("_text")).groupBy("_h").agg(F.first("_text").alias("_text"))
    answers = cut_lineage(batch_infer(once, "_h", "_text", fn))
    weighted = answers.join(copies, "_h")
    return join_hot_keys(keyed, weighted, "_h", "_copies", [F.col(key)], weights=copies).select(key, "result")


def check_contract(c: Column | str, keys: list[str]) -> Column:
    """struct<ok, error>: valid JSON with exactly the expected keys."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.array_sort(F.json_object_keys(c))
    expected = F.array(*[F.lit(k) for k in sorted(keys)])
    error = F.when(found.isNull(), "not valid JSON").when(
        found != expected, F.concat(F.lit("unexpected keys: "), F.array_join(found, ","))
    )
    return F.struct(error.isNull().alias("ok"), error.alias("error"))


def render_template(template: str, variables: dict[str, Column | str]) -> Column:
    """struct<prompt, error>: ``{{name}}`` replaced by columns; a leftover is an error."""
    out = F.lit(template)
    for name, value in variables.items():
        column = F.col(value) if isinstance(value, str) else value
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(column.cast("string"), F.lit("None")))
    unfilled = F.contains(out, F.lit("{{"))
    return F.struct(
        F.when(~unfilled, out).alias("prompt"), F.when(unfilled, "unfilled placeholder").alias("error")
    )


def enrich(
    df: DataFrame, text: str, intents: dict[str, list[str]], positive: list[str], negative: list[str],
    summary_words: int = 20, mask: tuple[str, ...] = ("email", "phone"),
) -> DataFrame:
    """Route, mood, one-liner and masked text in one pass over the rows."""
    staged = df.where(F.col(text).isNotNull()).withColumn("_tokens", tx.tokens(text))
    return staged.withColumns(
        {
            "intent": classify(text, intents, token_array=F.col("_tokens")),
            "sentiment": sentiment(text, positive, negative, token_array=F.col("_tokens")),
            "one_liner": summarize(summary_words)(F.col(text)),
            "safe_text": mask_entities(text, list(mask)),
        }
    ).drop("_tokens")


def enrichment_report(enriched: DataFrame) -> DataFrame:
    """Counts per intent and sentiment, largest first."""
    counts = enriched.groupBy("intent", "sentiment").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "intent", "sentiment")


def route_foreign(df: DataFrame, language: str = "language", home: str = "en") -> DataFrame:
    """Only rows in another language; unknown language does not pass."""
    return df.where(F.col(language) != home)


# Example prices per 1,000 tokens.
PRICE_IN, PRICE_OUT = 0.003, 0.015


def token_cost(rows: Column, input_tokens: Column, output_tokens: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    """Batch cost from a row count and mean tokens per row, rounded to cents."""
    thousands = rows.cast("double") / 1000
    return F.round(thousands * input_tokens * price_in + thousands * output_tokens * price_out, 2)


def cost_report(df: DataFrame, text: str, output_tokens: int, lean_share: float) -> DataFrame:
    """Cost of sending whole texts, of a leaner input share, and the saving."""
    stats = df.agg(F.count(text).alias("rows"), F.avg(tx.word_count(text)).alias("tokens"))
    fat = token_cost(F.col("rows"), F.col("tokens"), F.lit(output_tokens))
    lean = token_cost(F.col("rows"), F.col("tokens") * lean_share, F.lit(output_tokens))
    priced = stats.select("rows", F.round("tokens", 4).alias("mean_tokens"), fat.alias("fat_usd"), lean.alias("lean_usd"))
    saving = F.when(F.col("fat_usd") > 0, 100 * (F.col("fat_usd") - F.col("lean_usd")) / F.col("fat_usd"))
    return priced.withColumn("saving_pct", F.round(saving, 2))


def train_classifier(labelled: DataFrame, text: str, label: str, features: int = 4096) -> PipelineModel:
    """Hashed TF-IDF and logistic regression; apply the model with ``predict``.

    The model is stored in the shared folder and read back: the stored form
    holds the weights only, without the training frame that a fitted model
    keeps a hold of and would send to every task.
    """
    staged = labelled.select(tx.tokens(text).alias("_tokens"), F.col(label).cast("double").alias("label"))
    fitted = Pipeline(
        stages=[
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(maxIter=20, regParam=0.01),
        ]
    ).fit(staged)
    path = work_dir(labelled.sparkSession, "classifier")
    fitted.save(path)
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """Add the predicted label."""
    scored = model.transform(df.withColumn("_tokens", tx.tokens(text)))
    return scored.drop("_tokens", "_tf", "features", "rawPrediction", "probability")


def forecast(daily: DataFrame, series: str, day: str, value: str, horizon: int) -> DataFrame:
    """Per series: linear trend plus weekday effect, with a 95% residual band.

    The input is a daily aggregate, so all steps work on days.  Missing days
    inside the observed range count as 0.  A NULL series is a series like any other.
    """
    name, series = series, "_series"  # a struct, so that NULL equals NULL in the joins
    daily = daily.select(F.struct(F.col(name).alias("name")).alias(series), day, value)
    span = daily.groupBy(series).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    calendar = span.select(
        series, "_first", "_last", F.explode(F.sequence("_first", F.date_add("_last", horizon))).alias(day)
    )
    x = F.datediff(day, "_first").cast("double")
    dense = calendar.join(daily.select(series, day, value), [series, day], "left").withColumn("_x", x)
    known = dense.where(F.col(day) <= F.col("_last")).withColumn("_y", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    line = known.groupBy(series).agg(
        F.regr_slope("_y", "_x").alias("_slope"), F.regr_intercept("_y", "_x").alias("_start")
    )
    base = F.col("_start") + F.col("_slope") * F.col("_x")
    weekday = F.dayofweek(day).alias("_weekday")
    effect = known.join(line, series).groupBy(series, weekday).agg(F.avg(F.col("_y") - base).alias("_effect"))
    fitted = (
        dense.withColumn("_weekday", weekday)
        .join(line, series)
        .join(effect, [series, "_weekday"], "left")
        .withColumn("forecast", base + F.coalesce("_effect", F.lit(0.0)))
    )
    residual = (
        fitted.where(F.col(day) <= F.col("_last"))
        .groupBy(series)
        .agg(F.stddev_samp(F.coalesce(F.col(value).cast("double"), F.lit(0.0)) - F.col("forecast")).alias("_sd"))
    )
    future = fitted.where(F.col(day) > F.col("_last")).join(residual, series)
    band = 1.96 * F.coalesce(F.col("_sd"), F.lit(0.0))
    return future.select(
        F.col(f"{series}.name").alias(name), day, "forecast", (F.col("forecast") - band).alias("lower"), (F.col("forecast") + band).alias("upper")
    )


def json_reply(**fields) -> str:
    """A JSON object as a batch function would return it."""
    return json.dumps(fields, sort_keys=True)
