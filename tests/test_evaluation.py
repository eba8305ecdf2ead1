import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluation as ev


def pairs(spark, *rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "id int, h string, r string")


def test_length_and_citation_scores(spark):
    df = spark.createDataFrame([("a b c",), ("w " * 130,), ("w " * 20,), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(ev.response_length("t")).collect()]
    assert got == [
        (0.0, "Response too short (3 words)"), (0.5, "Response quite long (130 words)"),
        (1.0, "Appropriate length (20 words)"), (0.0, "Response too short (0 words)"),
    ]
    cited = spark.createDataFrame([("see the policy",), ("see the Policy",), (None,)], "t string")
    assert [r[0]["value"] for r in cited.select(ev.cites("t")).collect()] == [1.0, 0.0, 0.0]


def test_fact_coverage(spark):
    df = spark.createDataFrame(
        [("Refunds take seven days for Flex", ["refund within seven days", "bags are free"]), ("x", []), ("x", None)],
        "a string, f array<string>",
    )
    # three long words need one hit; "bags free" needs one and has none
    assert [r[0] for r in df.select(ev.fact_coverage("a", "f")).collect()] == [0.5, None, None]


def test_rouge_by_hand(spark):
    df = pairs(spark, ("the cat sat on the mat", "the cat is on the mat"), ("", "a b"))
    got = {r["id"]: r for r in ev.rouge_n(df, "id", "h", "r", 1).collect()}
    assert got[0]["recall"] == pytest.approx(5 / 6) and got[0]["precision"] == pytest.approx(5 / 6)
    assert got[1]["f1"] == 0.0
    long = {r["id"]: r["rouge_l"] for r in ev.rouge_l(df, "id", "h", "r").collect()}
    assert long[0] == pytest.approx(5 / 6) and long[1] == 0.0
    assert ev.lcs_length(list("abcbdab"), list("bdcaba")) == 4


def test_bleu_by_hand(spark):
    same = pairs(spark, ("a b c d e", "a b c d e"))
    assert ev.bleu(same, "id", "h", "r").first()["bleu"] == pytest.approx(1.0)
    short = pairs(spark, ("a b c d", "a b c d e f g h"))
    assert ev.bleu(short, "id", "h", "r").first()["bleu"] == pytest.approx(2.718281828 ** (1 - 8 / 4))
    assert ev.bleu(pairs(spark, ("x y", "a b")), "id", "h", "r").first()["bleu"] == 0.0


def test_perplexity_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "c")], "id int, t string")
    got = {r["id"]: r["perplexity"] for r in ev.unigram_perplexity(df, df, "id", "t").collect()}
    a, b, c = 3 / 8, 2 / 8, 2 / 8
    assert got[1] == pytest.approx((a * a * b) ** (-1 / 3)) and got[2] == pytest.approx(1 / c)


def test_perplexity_paths_agree(spark, tables, monkeypatch):
    def run():
        out = ev.unigram_perplexity(tables.documents, tables.documents, "doc_id", "text")
        return {r["doc_id"]: r["perplexity"] for r in out.collect()}

    small = run()
    monkeypatch.setattr(ev, "BROADCAST_BYTES", 0)
    assert run() == pytest.approx(small)


def test_perplexity_joins_only_tokens_of_rare_terms(spark, monkeypatch):
    """Frequent terms are looked up, whatever the size of the vocabulary; words that the corpus lacks count too."""
    rows = [(i, " ".join(["the", "of"] * 20 + [f"own{i}", f"pair{i // 2}"])) for i in range(200)] + [(200, ""), (201, None)]
    corpus = spark.createDataFrame(rows, "id int, t string")
    asked = corpus.unionAll(spark.createDataFrame([(202, "the unseen unseen own1"), (203, "unseen")], corpus.schema))
    wanted = {r["id"]: r["perplexity"] for r in ev.unigram_perplexity(asked, corpus, "id", "t").collect()}
    joined = []
    real = ev.join_hot_keys
    monkeypatch.setattr(ev, "join_hot_keys", lambda left, *a, **b: joined.append(left.count()) or real(left, *a, **b))
    monkeypatch.setattr(ev, "BROADCAST_BYTES", 200)  # two words
    got = {r["id"]: r["perplexity"] for r in ev.unigram_perplexity(asked, corpus, "id", "t").collect()}
    assert got == pytest.approx(wanted) and set(got) == {*range(200), 202, 203}
    assert joined == [404]  # of 8,405 tokens; all (document, term) pairs are 804


def means(spark, **scores):
    rows = [(run, scorer, value) for scorer, pair in scores.items() for run, value in zip(("v1", "v2"), pair) if value is not None]
    return spark.createDataFrame(rows, "run string, scorer string, mean double")


@pytest.mark.parametrize(
    "scores, winner",
    [
        ({"correctness": (0.7, 0.8), "groundedness": (0.9, 0.1), "safety": (1.0, 1.0)}, "v2"),
        ({"correctness": (0.8, 0.8), "groundedness": (0.5, 0.6), "safety": (1.0, 1.0)}, "v2"),
        ({"correctness": (0.8, 0.8), "groundedness": (0.6, 0.6), "safety": (1.0, 1.0)}, "v1"),
        ({"correctness": (0.7, 0.9), "groundedness": (0.5, 0.6), "safety": (1.0, 0.9)}, "v1"),
        ({"correctness": (0.7, None), "safety": (1.0, 1.0)}, "v2"),
    ],
)
def test_winner_rules(spark, scores, winner):
    assert ev.choose_winner(means(spark, **scores), "run", "v1", "v2").first()["winner"] == winner


def test_gate_needs_metrics(spark):
    good = spark.createDataFrame([("a", 0.8), ("b", 0.95)], "scorer string, mean double")
    assert ev.promotion_gate(good).first()["passed"]
    assert not ev.promotion_gate(good.withColumn("mean", F.col("mean") - 0.01)).first()["passed"]
    assert not ev.promotion_gate(good.limit(0)).first()["passed"]


def test_bands_and_formats(spark):
    bands = spark.createDataFrame([(n,) for n in (24, 25, 39, 40, 110, 111, 140, 141)], "n int").select(ev.length_band(F.col("n")))
    assert [r[0] for r in bands.collect()] == ["fail", "review", "review", "pass", "pass", "review", "review", "fail"]
    df = spark.createDataFrame([("call 1 800\n555 0100", "fly UA482 on 2026-07-01")], "a string, b string")
    row = df.select(
        ev.format_score("a", "contact_present")["value"], ev.format_score("b", "flight_code")["value"],
        ev.format_score("b", "date_present")["value"], ev.format_score("a", "date_present")["value"],
    ).first()
    assert tuple(row) == (1.0, 1.0, 1.0, 0.0)


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("double").alias("s"))
    row = ev.bootstrap_interval(rows, "id", "s", 100).first()
    assert row["low"] < row["mean"] == 0.25 < row["high"] and row["high"] - row["low"] < 0.15
    assert tuple(ev.bootstrap_interval(rows, "id", "s", 100).first()) == tuple(row)


def test_traffic_split_is_stable(spark):
    users = spark.range(5000).withColumn("arm", ev.traffic_arm("id"))
    share = users.where("arm = 'challenger'").count() / 5000
    assert 0.08 < share < 0.12
    assert users.exceptAll(spark.range(5000).withColumn("arm", ev.traffic_arm("id"))).isEmpty()


def test_scorecard_missing_metric_fails(spark):
    values = spark.createDataFrame([("correctness", 0.9), ("p95_ms", 2500.0)], "metric string, value double")
    got = {r["metric"]: r["passed"] for r in ev.scorecard(values).collect()}
    assert got == {"correctness": True, "groundedness": False, "p95_ms": True}


def test_slices_show_hidden_regressions(spark):
    rows = spark.createDataFrame([("easy", 0.5, 1.0), ("easy", 0.5, 1.0), ("hard", 0.9, 0.6)], "band string, a double, b double")
    got = {r["band"]: r["regressed"] for r in ev.slice_report(rows, "band", "a", "b").collect()}
    assert got == {"easy": False, "hard": True}


def test_common_subsequences_equal_the_table_method():
    import random

    rand = random.Random(4)
    for _case in range(200):
        a, b = ([rand.choice("abcd") for _ in range(rand.randint(0, 12))] for _side in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert ev.lcs_length(a, b) == table[-1][-1]


def test_clipped_counts_by_hand():
    assert ev.clipped_counts("a b a b".split(), "a b c a".split(), 1) == (3, 4, 4)
    assert ev.clipped_counts("a b a b".split(), "a b c a".split(), 2) == (1, 3, 3)
    assert ev.clipped_counts([], "a".split(), 2) == (0, 0, 0)
