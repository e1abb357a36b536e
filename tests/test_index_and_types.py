"""The kept inverted index against scoring everything, and the type rules of nested records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardstream.operators import inverted, reference, retrieval, soc, suites
from wardstream.plans.soc_queries import _variant


def corpus(rng, n):
    """Texts over words of very unequal frequency."""
    vocabulary = [f"w{i}x{i * 7 % 90}" for i in range(300)]
    return [" ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randrange(1, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(corpus(rng, 700))] + [(9000, None), (9001, " . "), (9002, "w1x7 " * 40)]
    return spark.createDataFrame(rows, "k bigint, t string").persist()


def asked(spark):
    rows = ["w1x7", "w0x0 w250x40", "w120x30 w3x21 w5x35", " ", "1x7 w3x2", "X14", "w9x63 zzz w1x7 w2x14 w7x49", "nothing", "w0x0 w0x0 w1x7", "w2  w3", "x63 w1"]
    return spark.createDataFrame(list(enumerate(rows)), "query_id int, query string")


def test_index_finds_what_scoring_everything_finds(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_POSTINGS", 8)
    q, index = asked(spark), inverted.Index(spark, str(tmp_path / "index"), "bigint")
    assert index.search(q).count() == 0 and index.count() == 0
    index.add(texts.filter("k % 3 = 0"), "k", "t").add(texts.filter("k % 2 = 0"), "k", "t").add(texts, "k", "t")
    assert index.count() == texts.count() and index.segments().count() == 3
    want = sorted(map(tuple, retrieval.bm25(texts, "k", "t", q, k=4).select("query_id", "k", "score", "rank").collect()))
    loaded = inverted.Index(spark, str(tmp_path / "index"), "bigint")
    assert sorted(map(tuple, loaded.search(q, k=4).collect())) == want and len(want) > 20
    # Only the asked buckets' files are opened, and blocks below the floor are passed over.
    one = q.filter("query_id = 0")
    none = spark.createDataFrame([], "query_id int, key bigint, part double")
    avg = loaded.segments().agg(F.sum("total") / F.sum("n")).first()[0]
    blocks, held = loaded.chosen(one, none, 3, avg)
    marks = [r["read"] for r in blocks.collect()]
    assert 0 < sum(marks) < len(marks) / 2
    opened = held.select(F.input_file_name()).distinct().count()
    assert opened <= 3 < loaded.postings().select(F.input_file_name()).distinct().count()
    (tmp_path / "index" / "texts" / "segment=lost").mkdir()  # of an add that did not end
    assert loaded.texts().count() == texts.count()
    loaded.clear()
    assert loaded.count() == 0 and loaded.search(q).count() == 0


def test_library_is_kept_with_its_index(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"Title {i}", t) for i, t in enumerate(corpus(random.Random(8), 60))], "doc_id string, title string, content string")
    q, whole = asked(spark), reference.Library.build(docs)
    reference.Library.build(docs.filter("doc_id < 'd3'")).save(str(tmp_path / "lib"))
    kept = reference.Library.load(spark, str(tmp_path / "lib")).add(docs)
    assert kept.count() == whole.count() == kept.chunks.count()
    rows = lambda lib: sorted(map(tuple, lib.search(q).select("query_id", "rank", "chunk_id", "title", "content", "score").collect()))
    assert rows(kept) == rows(whole)
    first = lambda chunks, key, text, queries, k, threshold: queries.select("query_id", F.lit("d1-0").alias(key), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    assert {r.chunk_id for r in reference.Library(whole.chunks, scorer=first).search(q).collect()} == {"d1-0"}


def test_wrong_types_are_issues_of_their_own(spark):
    cases = [
        ([("id", 7)], ["id"]), ([("input", "text")], ["input"]), ([("output", [1])], ["output"]), ([("metadata", 3)], ["metadata"]), ([("input.evidence", "none")], ["input.evidence"]),
        ([("input.evidence.0", "x")], ["input.evidence[0]"]), ([("output.findings.0", 5)], ["output.findings[0]"]), ([("output.confidence", "high")], ["output.confidence"]),
        ([("output.confidence", True)], []), ([("input.alert", "a"), ("input.context", [])], ["input.alert", "input.context"]), ([], []),
    ]
    rows = [(i, json.dumps(_variant(c)).replace("{n}", f"{i:06d}")) for i, (c, _) in enumerate(cases)]
    out = {r.i: r for r in soc.validate(soc.parse(spark.createDataFrame(rows, "i int, raw string"))).collect()}
    for i, (changes, paths) in enumerate(cases):
        assert [x.at for x in out[i].issues if x.code == "wrong_type"] == paths, changes
        assert not any(x.code == "missing_field" for x in out[i].issues), changes
    assert [e.id for e in out[5].input.evidence if e] == ["EVT-002"] and {x.code for x in out[5].issues} == {"wrong_type", "unknown_evidence_ref"}
    assert out[8].output.confidence == 1.0 and out[8].valid and out[10].valid


def test_shares_in_rows(spark):
    weights = {"a": 1, "b": 1, "c": 1, "d": 4}
    got = suites.allocate_rows(spark.createDataFrame(list(weights.items()), "k string, w int"), "k", "w", 1000).collect()
    assert {r.k: r.n for r in got} == suites.allocate(1000, weights)
