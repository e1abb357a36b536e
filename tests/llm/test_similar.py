"""The pipeline's near-copy stage against brute force over all pairs of shingle sets."""

import random

import corpus_pipeline
from test_operators import docs, words
from wardstream.llm import _common, _similar, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, least=0.8):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= least:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(texts))]


def planted(n=40):
    """Clean texts, and for each copies with 1 to 6 changed words: similarities on both sides of 0.8."""
    rng = random.Random(11)
    clean = [words(rng, rng.randrange(60, 200)) for _ in range(n)]
    out = list(clean)
    for t in clean:
        for changes in range(1, 7):
            w = t.split()
            for at in rng.sample(range(len(w)), changes):
                w[at] = f"z{rng.randrange(1000)}"
            out.append(" ".join(w))
    return out + ["a b", "A  b", "", " \n", None, " ".join(clean[0].split()[:-1])], n


def test_stage_drops_near_copies_and_keeps_clean(spark):
    texts, n = planted()
    want = [i for i, r in enumerate(brute(texts)) if i == r]
    assert set(range(n)) <= set(want) and len(want) < len(texts) - n
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    got = sorted(r.doc_id for r in stage(spark, docs(spark, texts), "").collect())
    assert got == want


def test_grid_of_cells_and_frequent_copies(spark, monkeypatch):
    texts, _ = planted(12)
    texts += texts[:1] * 30
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 10)
    d = docs(spark, texts)
    groups = lambda pairs: {frozenset(i for i, c in pairs if c == x) for _, x in pairs}
    got = groups([(r.doc_id, r.component) for r in _similar.components(d, cell_rows=3).collect()])
    assert got == groups(list(enumerate(brute(texts))))


def test_bands_of_a_chain_are_its_tiles(spark, monkeypatch):
    """Texts of which each shares most with the next: one coarse group, cells that grow with its length and not its square."""
    rng = random.Random(5)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    sent, stream = {}, [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    for n in (1250, 5000):
        texts = [" ".join(stream[9 * i : 9 * i + 130]) for i in range(n)]
        d = docs(spark, texts)
        rows = _similar.sketches(d)
        nodes, _ = _common.connected_components(_similar.proposals(rows), "lo", "fp")
        members = rows.join(nodes, rows.fp == nodes.node).select("node", "root", "n", "bands").persist()
        size = members.groupBy("root").count().agg({"count": "max"}).first()[0]
        cells = _similar.placed(members, 100).persist()
        assert size > n // 3 and cells.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 100
        sent[n] = cells.count()
        if n == 1250:
            groups = lambda pairs: {frozenset(i for i, c in pairs if c == x) for x in {c for _, c in pairs}}
            got = [(r.doc_id, r.component) for r in _similar.components(d, cell_rows=100).collect()]
            want, last = [], 0
            sets = [shingles(t) for t in texts]
            for i in range(n):  # a window is as near to the next as any pair is
                last = last if i and len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) >= 0.8 else i
                want.append((i, last))
            assert groups(got) == groups(want)
    assert sent[5000] < 5 * sent[1250]


def test_rows_are_decided_one_by_one(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "p q r s t"), (3, "a b c d e"), (3, "u v w x y"), (None, "k l m n o"), (None, "k l m n o"), (3, "i j k l m")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(1, "a b c d e"), (2, "p q r s t"), (3, "i j k l m"), (3, "u v w x y"), (None, "k l m n o")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    assert simhash.deduplicate(docs(spark, [])).count() == 0
