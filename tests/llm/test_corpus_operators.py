"""Near-duplicate groups, mixing, and the pipeline that uses them."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import components, mixing, simhash, stages
from larkspur.llm.queries import QUERIES

from .conftest import SF


# ------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    """(key, fingerprint) -> smallest key of the connected component, by comparing all."""
    prints = np.array(sorted({f for _k, f in rows}), np.uint64)
    group = {int(f): {int(f)} for f in prints}
    for f in prints:
        for g in prints[np.bitwise_count(prints ^ f) <= radius]:
            a, b = group[int(f)], group[int(g)]
            if a is not b:
                a |= b
                for x in b:
                    group[x] = a
    least = {}
    for key, f in rows:
        root = min(group[f])
        if key is not None:
            least[root] = min(key, least.get(root, key))
    return [(key, f, least.get(min(group[f]))) for key, f in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_groups_equal_brute_force(spark, documents, odd_documents):
    for docs in (documents, odd_documents.withColumn("component", F.lit("x")).withColumn("fingerprint", F.lit("x"))):
        rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
        got = [(k, f & (2 ** 64 - 1), c) for k, f, c in map(tuple, simhash.near_duplicate_groups(docs).collect())]
        assert ordered(got) == ordered(plain_groups(rows))
    assert simhash.near_duplicate_groups(documents.limit(0)).collect() == []


def test_query_shows_hexadecimal_digits(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for row in QUERIES["op9_simhash_groups"](spark, SF).collect():
        assert row.fingerprint == format(plain_fingerprint(texts[row.doc_id]), "016x")


def test_links_connect_all_near_fingerprints(spark, monkeypatch):
    """Random fingerprints and dense clusters, with small shards, so that trees branch and parts are dealt."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    rand = random.Random(3)
    prints = {rand.getrandbits(64) for _ in range(2_500)}
    for _cluster in range(4):
        centre = rand.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rand.sample(range(64), rand.randint(1, 4))) for _ in range(150)}
    centre = rand.getrandbits(64)  # one third in common, so a single leaf holds them
    prints |= {centre ^ (rand.getrandbits(40) << 22) for _ in range(900)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    distinct = spark.createDataFrame(signed, "fingerprint long").repartition(3)
    links = simhash.linked_pairs(distinct).collect()
    mask = 2 ** 64 - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in links)
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[find(r.a & mask)] = find(r.b & mask)
    expected = collections.defaultdict(set)
    for key, f, component in plain_groups([(f, f) for f in prints]):
        expected[component].add(f)
    got = collections.defaultdict(set)
    for f in prints:
        got[find(f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (301, 300)]
    got = {r.node: r.root for r in components.connected_components(
        spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert got == {
        **{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300,
    }


# ------------------------------------------------------------ mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_sources, budget = list(order), 1.5 * sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if budget * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: budget * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            open_sources.remove(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixture_meets_its_targets(documents, odd_documents):
    for docs in (documents, odd_documents.withColumn("size", F.lit("x")).withColumn("target", F.lit("x"))):
        rows = docs.collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += words(r.text)
        targets = plain_targets(sizes)
        got = mixing.mix(docs).collect()
        assert ordered((r.doc_id, r["size"]) for r in got) == ordered((r.doc_id, words(r.text)) for r in rows)
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
        by_target = collections.defaultdict(int)
        for r in got:
            by_target[r.source_size, round(r.target, 6)] += r.taken
        expected = collections.defaultdict(float)
        for s, target in targets.items():
            expected[sizes[s], round(target, 6)] += target
        assert by_target.keys() == expected.keys()
        assert all(abs(by_target[k] - expected[k]) <= 1 * len(sizes) for k in expected)
        assert ordered(map(tuple, got)) == ordered(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(documents.limit(0)).collect() == []


def test_targets_of_sources_that_tie(spark):
    """Equal sizes, empty sources and full ones; most of them share a ratio of limit and weight."""
    draw = random.Random(3)
    cases = [[100] * 6, [0, 0, 0], [5, 2, 1] * 4, [10, 4, 2, 10, 4, 2, 500], [7]]
    cases += [[draw.choice((0, 1, 5, 10, 50)) for _s in range(draw.randint(1, 14))] for _case in range(12)]
    for case in cases:
        sizes = {None if i == 3 else f"s{i:02d}": n for i, n in enumerate(case)}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        wanted = plain_targets(sizes)
        assert got.keys() == wanted.keys()
        assert all(abs(got[s] - wanted[s]) < 1e-6 for s in wanted), (case, got, wanted)
    equal = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([(f"s{i}", 100) for i in range(6)], "source string, size long")).collect()}
    assert [round(equal[f"s{i}"], 2) for i in range(6)] == [200, 166.67, 83.33] * 2


def test_tied_sources_in_the_mixture_and_the_stage(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 4), f"s{i % 6}") for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _i, text, source in rows:
        sizes[source] += words(text)
    targets = plain_targets(sizes)
    for limit in (mixing.BROADCAST_BYTES, 0):  # few sources, and as if there were very many
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
        source_of = {i: s for i, _t, s in rows}
        taken = collections.Counter()
        for r in mixing.mix(docs).collect():
            taken[source_of[r.doc_id]] += r.taken
        assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    repeated = collections.Counter()
    for r in mixing.repeat_to_weights(docs).collect():
        repeated[r.source] += words(r.text)
    assert all(abs(repeated[s] - targets[s]) <= 4 for s in targets)


def test_equal_rows_take_turns(spark):
    rows = [(7, "w w w", "a")] * 25_000 + [(8, "v", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    counts = {r.taken: r["count"] for r in got.where("doc_id = 7").groupBy("taken").count().collect()}
    size, target = 75_000, plain_targets({"a": 75_000, "b": 1})["a"]
    assert sum(t * n for t, n in counts.items()) == round(target) and sum(counts.values()) == 25_000 and size < target


def test_repeated_documents_come_near_the_targets(documents, odd_documents):
    for docs in (documents, odd_documents.withColumn("_times", F.lit(1)).withColumn("key", F.lit(2))):
        out = mixing.repeat_to_weights(docs)
        assert out.columns == docs.columns
        taken, longest, sizes = collections.Counter(), collections.Counter(), collections.Counter()
        for r in out.collect():
            taken[r.source] += words(r.text)
        for r in docs.collect():
            sizes[r.source] += words(r.text)
            longest[r.source] = max(longest[r.source], words(r.text))
        for s, target in plain_targets(sizes).items():
            assert abs(taken[s] - target) <= 2 * longest[s] + 1
    assert mixing.repeat_to_weights(documents.limit(0)).collect() == []


def test_equal_rows_are_repeated_to_the_cut(spark, monkeypatch):
    """Equal rows of several runs, of one run, and without a key; each source comes out to half a row."""
    rows = (
        [(7, "w w w", "a", i) for i in range(25_000)] + [(8, "v", "b", 0)]
        + [(None, "n n", "c", i) for i in range(900)] + [(i, "x y z x", "c", i) for i in range(300)]
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    targets = plain_targets({"a": 75_000, "b": 1, "c": 3_000})
    two = spark.createDataFrame(rows[:25_001], docs.schema)
    for own, wanted in ((docs, targets), (two, plain_targets({"a": 75_000, "b": 1}))):
        for run in (10_000, 300):
            monkeypatch.setattr(mixing, "RUN_COPIES", run)
            out = mixing.repeat_to_weights(own).collect()
            taken = collections.Counter()
            for r in out:
                taken[r.source] += words(r.text)
            assert all(abs(taken[s] - target) <= {"a": 1.5, "b": 0.5, "c": 2}[s] + 0.5 for s, target in wanted.items())
            assert max(collections.Counter(out).values()) <= 2


# ------------------------------------------------------------ pipeline


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for i, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        n.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            prints = {r.doc_id: plain_fingerprint(r.text or "") for r in before.collect()}
            expected = {c for _k, _f, c in plain_groups(list(prints.items()))}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(expected)
        if i == 2:
            assert n[-1] == n[-2] and not docs.where(F.col("text").rlike("AKIA[A-Z0-9]{14}")).count()
    assert n[1] >= n[0] - 2 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert n[5] == n[4]


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", [stage for _name, stage in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_with_odd_and_empty_tables(spark, odd_documents, documents, stage, tmp_path):
    clash = odd_documents
    for name in ("row", "_row", "size", "key", "fingerprint", "ids", "spans", "split", "accepted"):
        clash = clash.withColumn(name, F.lit("own"))
    for i, docs in enumerate((clash, clash.limit(0), documents.limit(0))):
        docs.write.parquet(str(tmp_path / str(i)))
        stored = spark.read.parquet(str(tmp_path / str(i)))
        out = stage(spark, stored, SF)
        if stage is not stages.encode_texts:
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows if not i and stage is not stages.keep_known_language else True
        assert not rows if i else True


def test_one_row_of_each_group_stays(spark, odd_documents, tmp_path):
    odd_documents.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    kept = stages.keep_one_of_each_group(spark, stored, SF).collect()
    prints = [plain_fingerprint(r.text or "") for r in kept]
    assert len(prints) == len(set(prints)) and len(kept) == 5
    assert {r.doc_id for r in kept} == {1, 4, 6, 7, 8}


def test_kept_rows_do_not_depend_on_how_files_are_read(spark, documents, tmp_path):
    documents.repartition(24).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    wanted = sorted(r.doc_id for r in stages.keep_one_of_each_group(spark, stored, SF).collect())
    kept = stages.keep_one_of_each_group(spark, stored, SF)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # as if executors had been lost since
    try:
        assert sorted(r.doc_id for r in kept.collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
