import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.batches import RUN_BYTES
from larkspur.operators import chunking as ch
from larkspur.operators import documents as dc
from larkspur.operators.relational import expect_or_drop, split_quarantine
from larkspur.queries import ORACLES, QUERIES
from larkspur.queries.documents import BLANKS

NOISY = """<html><nav>Home | Book | Manage | Help</nav>
Last updated: 2026-03-01
Q: How do I add a bag?
A: In Manage Booking.
A: In Manage Booking.
Page 1 of 1
This document is confidential and proprietary to the airline."""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_noisy_document(spark):
    assert one(spark, NOISY, tx.clean_text) == "Home | Book | Manage | Help\nQ: How do I add a bag?\nA: In Manage Booking."


def test_case_and_blank_runs(spark):
    assert one(spark, "a\nPAGE 3 OF 4\n\n\n\nb", tx.scrub_flat_text) == "a\n\n\nb".replace("\n\n\n", "\n\n")


def test_parse_elements_and_errors(spark):
    html = (
        "<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav><a>Home</a></nav><h1>Head</h1>"
        "<p>First</p><script>var t='</p>'</script><p>Second <b>bold</b></p><footer>foot</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, html), (2, "<html><body><p>x"), (3, None)], "page_id int, html string")
    parsed = dc.parse_pages(pages)
    elements = parsed.where("page_id = 1").select("parsed.document.elements").first()[0]
    assert [(e["type"], e["content"]) for e in elements] == [
        ("title", "T & U"), ("page_header", "Home"), ("section_header", "Head"), ("text", "First"),
        ("text", "Second bold"), ("page_footer", "foot"),
    ]
    assert dc.document_text(parsed).first()["doc_text"] == "T & U\nHead\nFirst\nSecond bold"
    errors = {r["page_id"]: r["error_message"] for r in dc.quarantined(parsed, "page_id").collect()}
    assert errors == {2: "document is not closed", 3: "document has no body"}
    as_variant = dc.to_variant(parsed.where("page_id = 1"))
    assert as_variant.select(dc.flatten_variant()).first()[0] == "T & U\nHead\nFirst\nSecond bold"


def test_error_rows_filled_empty_absent(spark):
    df = spark.createDataFrame([(1, [("bad", 0)]), (2, []), (3, None)], "id int, e array<struct<m:string,p:int>>")
    clean, failed = split_quarantine(df, "e")
    assert sorted(r["id"] for r in clean.collect()) == [2, 3]
    assert [r["id"] for r in failed.collect()] == [1]


def test_expectations_drop_and_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, t string")
    kept, seen = expect_or_drop(df, {"non_empty": F.length("t") > 0})
    assert [r["id"] for r in kept.collect()] == [1]
    assert seen.get == {"rows_in": 3, "dropped_non_empty": 2}


def test_boilerplate_paths_agree(spark, tables, monkeypatch):
    more = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "only\nonly")], "doc_id long, text string")
    common = spark.createDataFrame([(20_000 + i, "only\nown %d" % i) for i in range(20)], "doc_id long, text string")
    rows = tables.documents.select("doc_id", "text").unionAll(more).unionAll(common)
    inline = dc.drop_boilerplate(rows, "doc_id", "text", 0.02).collect()
    monkeypatch.setattr(dc, "INLINE_BYTES", -1)
    joined = dc.drop_boilerplate(rows, "doc_id", "text", 0.02).collect()
    assert sorted(map(tuple, inline), key=lambda r: r[0]) == sorted(map(tuple, joined), key=lambda r: r[0])
    got = {r.doc_id: r.text for r in inline}
    assert (got[10_000], got[10_001], got[10_002], got[20_003]) == (None, "", "", "own 3")


def test_rows_without_text_are_no_copies(spark):
    rows = [(1, "A  b"), (2, "a b"), (3, None), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert sorted((r.id, r.canonical_id, r.copies) for r in dc.label_copies(df, "id", "t").collect() if r.id) == [
        (1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)
    ]
    assert dc.label_copies(df, "id", "t").count() == 5
    assert sorted(r.id for r in dc.dedup_exact(df.where("id IS NOT NULL"), "id", "t").collect()) == [1, 3, 4]


def test_paragraph_copies_leave_every_document(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, "B\n\nc\nd"), (3, "a\n\n\nb"), (4, None)], "id int, t string")
    assert sorted(map(tuple, dc.dedup_paragraphs(df, "id", "t").collect())) == [(1, "a\n\nb"), (2, "c\nd"), (3, ""), (4, None)]


def test_similar_hits_keep_the_best_rank(spark):
    rows = [(1, 1, "a b c d"), (1, 2, "a b c d e"), (1, 3, "x y z"), (1, 4, "x y z a b c d e f"), (2, 1, "x y z")]
    hits = spark.createDataFrame(rows, "q int, rank int, content string")
    kept = dc.drop_similar_hits(hits, "q", "rank", "content", 0.75)
    assert sorted((r["q"], r["rank"]) for r in kept.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def random_text(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) + f"{i:03d}" for i in range(rng.randint(0, 400))]
    return "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for w in words) + "".join(
        str(i) for i in range(1000, 1000 + rng.choice([0, 0, 90]))  # a long run without any boundary
    )


@pytest.mark.parametrize("seed", range(30))
def test_recursive_splitter_bounds(seed):
    text, size, overlap = random_text(seed), 120, 25
    chunks = ch.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert all(c == c.strip() for c in chunks)
    # chunks are runs of the text in order; only whitespace lies between them
    covered = 0
    for chunk in chunks:
        rest = text[covered:]
        latest_start = covered + len(rest) - len(rest.lstrip())
        at = text.rfind(chunk, 0, latest_start + len(chunk))
        assert 0 <= at <= latest_start
        assert covered - at <= overlap
        covered = at + len(chunk)
    assert not text[covered:].strip()


def test_recursive_splitter_prefers_coarse_boundaries():
    text = "aaaa bbbb\n\ncccc dddd"
    assert ch.split_recursively(text, 12, 0) == ["aaaa bbbb", "cccc dddd"]
    assert ch.split_recursively(text, 6, 0) == ["aaaa", "bbbb", "cccc", "dddd"]
    assert ch.split_recursively("abcdefgh", 4, 2) == ["abcd", "cdef", "efgh"]


def test_recursive_overlap_repeats_tail():
    chunks = ch.split_recursively("one two six ten fly sky", 11, 4)
    assert chunks == ["one two six", "six ten", "ten fly", "fly sky"]


def test_fixed_and_token_windows(spark):
    got = one(spark, "abcdefghij", lambda c: ch.fixed_chunks(c, 4, 1))
    assert got == ["abcd", "defg", "ghij"]
    assert one(spark, "a b c d e", lambda c: ch.token_chunks(c, 3, 1)) == ["a b c", "c d e"]
    assert one(spark, "", lambda c: ch.token_chunks(c, 3, 1)) == []
    assert one(spark, "a b", lambda c: ch.token_chunks(c, 3, 1)) == ["a b"]
    with pytest.raises(ValueError):
        ch.token_chunks("t", 3, 3)


def test_sentences_paragraphs_and_windows(spark):
    text = "One. Two! Three? Four"
    assert one(spark, text, lambda c: ch.sentence_chunks(c, 3)) == ["One. Two! Three?", "Four"]
    assert one(spark, "p1\n\n\np2\n\np3", ch.paragraph_chunks) == ["p1", "p2", "p3"]
    assert one(spark, "p1\n\np2\n\np3", lambda c: ch.sliding_paragraphs(c, 2, 1)) == ["p1\n\np2", "p2\n\np3"]


def test_semantic_break_at_the_topic_change(spark):
    text = "red fox runs fast. red fox jumps fast. red fox sleeps fast. tax form due soon. tax form sent soon."
    chunks = one(spark, text, lambda c: ch.semantic_chunks(c, 0.75))
    assert chunks == ["red fox runs fast. red fox jumps fast. red fox sleeps fast.", "tax form due soon. tax form sent soon."]
    assert one(spark, "only one.", ch.semantic_chunks) == ["only one."]
    assert one(spark, "", ch.semantic_chunks) == [] and one(spark, None, ch.semantic_chunks) == []


def test_strategy_per_kind(spark):
    df = spark.createDataFrame([(1, "faq", "a " * 200), (2, "policy", "b " * 200), (3, "new", "c")], "id int, kind string, t string")
    out = ch.chunk_by_strategy(df, "t", "kind", {"faq": "token", "policy": "recursive"}, 100, 10)
    got = {r["id"]: (r["strategy"], len(r["chunks"])) for r in out.collect()}
    assert got[1] == ("token", 2) and got[2][0] == "recursive" and got[2][1] > 3 and got[3] == ("recursive", 1)


def test_typed_extraction(spark):
    fields = [
        dc.Field("title", r"Title: (.+)"), dc.Field("days", r"within (\w+) days", "integer"),
        dc.Field("fare", r"Class: (\w+)", "enum", ("Economy", "First")), dc.Field("fee", r"Fee: ([\d.]+)", "number"),
        dc.Field("day", r"Effective (\S+)", "date"),
    ]
    rows = [
        (1, "Title: Refunds\nwithin 14 days. Class: economy Fee: 12.5 Effective 2026-02-14"),
        (2, "within ten days Class: Cargo Effective 2026-99-99"), (3, None),
    ]
    df = spark.createDataFrame(rows, "id int, t string")
    out = dc.typed_columns(dc.extract_fields(df, "t", fields), fields).orderBy("id").collect()
    assert (out[0]["title"], out[0]["days"], out[0]["fare"], out[0]["fee"], str(out[0]["day"])) == ("Refunds", 14, "Economy", 12.5, "2026-02-14")
    assert out[1]["days"] is None and out[1]["fare"] is None and out[1]["extract_error"] == "no field found"
    assert out[2]["extract_error"] is None


def test_context_stops_at_the_budget(spark):
    rows = [(1, 1, "a b c"), (1, 2, "d e"), (1, 3, "f g h i"), (1, 4, "j"), (2, 1, "k l m n o p q")]
    ranked = spark.createDataFrame(rows, "q int, rank int, content string")
    got = {r["q"]: (r["context"], r["tokens_used"]) for r in dc.assemble_context(ranked, "q", "rank", "content", 6).collect()}
    assert got == {1: ("a b c\n\nd e", 5)}


def test_expand_terms(spark):
    rules = {"BE fare": "Basic Economy fare"}
    text = " my BE fare, BE fares "
    assert one(spark, text, lambda c: dc.expand_terms(c, rules)) == "my Basic Economy fare, Basic Economy fares"
    assert one(spark, text, lambda c: dc.expand_terms(c, rules, True)) == "my Basic Economy fare, BE fares"


def test_noise_rules_with_carriage_returns(spark):
    text = "Last updated: 2026-03-01\r\nkeep\r\nThis document is confidential, all of it\r\nalso\r\nlast updated: x"
    assert one(spark, text, tx.clean_text) == "keep\nalso"


def test_recursive_splitter_gives_chunks_back_in_runs_of_bytes(spark):
    texts = [("word " * (i % 700)).strip() or None for i in range(4_000)] + ["x" * (3 * RUN_BYTES), ""]
    runs = list(ch.recursive_chunks(900, 150).func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [c for run in runs for c in run.to_pylist()] == [ch.split_recursively(s, 900, 150) if s else [] for s in texts]
    assert max(run.nbytes for run in runs[:-3]) < 2 * RUN_BYTES and len(runs) >= 4
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts[:900])], "id int, t string").coalesce(1)
    got = {r["id"]: r["c"] for r in df.select("id", ch.recursive_chunks(900, 150)(F.col("t")).alias("c")).collect()}
    assert got == {i: ch.split_recursively(s, 900, 150) if s else [] for i, s in enumerate(texts[:900])}


def test_chunk_facts_of_texts_without_chunks(spark, tmp_path):
    texts = [
        "", None, " \n\t ", "\u00a0\u3000", "\x1c\x1d", " " * 1500, "<p></p><br>", "Last updated: 2026-03-01",
        "abc" + " " * 2000, "\x1ca b\x1f", "\x85" + "a b " * 300, "x" * 5000, "\U0001f600 " * 700, "One. Two.",
    ]
    rows = [(i, s, "en", "s", len(s or "")) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("k8_recursive_chunks", "j1_chunk_function"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLES[name])
        assert got.columns == [d[0] for d in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


def test_blanks_are_those_that_the_splitter_strips():
    assert sorted(BLANKS) == [chr(c) for c in range(0x110000) if chr(c).isspace()]
