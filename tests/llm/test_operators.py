"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardstream.llm import _common, decontaminate, langid, linededup, lmscore, media, mixing, sharding, simhash, substring, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **cols):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 80)) for _ in range(40)]
    passage = words(rng, 30)
    out = base + base[:6] + [f"{words(rng, 9)} {passage} {words(rng, 7)}" for _ in range(6)]
    long = " ".join(f"q{i}" for i in range(3000))
    out += ["a " * 60, "a " * 55 + "b", f"{passage} {words(rng, 5)} {passage}", long, "x " + long, None, "", " \t\n", "A", "One two three  FOUR five\x0bsix"]
    near = base[3].split()
    for i in range(5):
        near[i * 3 % len(near)] = f"z{i}"
        out.append(" ".join(near))
    return out


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 sharding
def test_sharding_sizes_slots_and_permutation(spark, texts):
    d = docs(spark, texts * 3).withColumn("shard", F.lit("mine")).withColumn("Slot", F.lit(1))
    out = sharding.shard(d, 7, partition_rows=25, block_rows=8).collect()
    assert len(out) == len(texts) * 3
    assert Counter(r.text for r in out) == Counter(texts * 3)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("shards,per,block", [(4, 25, 8), (7, 9, 1000), (16, 40, 3)])
def test_sharding_against_a_plain_deal(spark, texts, shards, per, block):
    """The whole deal by hand: rows in files of ``per``, counts by the matrix, a permutation a file, an order of keys a shard."""
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(d, shards, 7, block, per, 1 << 40).collect()}
    parts = [rows[i : i + per] for i in range(0, len(rows), per)]
    matrix = sharding.communication_matrix([len(x) for x in parts], shards, 7)
    assert matrix.sum(axis=1).tolist() == [len(x) for x in parts] and np.ptp(matrix.sum(axis=0)) <= 1
    keys = {(r.p, r.i): r.k for r in spark.createDataFrame([(p, i) for p, x in enumerate(parts) for i in range(len(x))], "p bigint, i bigint").select("p", "i", F.xxhash64(F.lit(7), "p", "i").alias("k")).collect()}
    blocks, held = max(1, -(-len(rows) // shards // block), int(np.ceil(len(rows) / shards / block))), defaultdict(list)
    for p, part in enumerate(parts):
        dest = np.random.default_rng([7, p]).permutation(np.repeat(np.arange(shards), matrix[p]))
        for i, (doc, _) in enumerate(part):
            k = keys[p, i]
            held[int(dest[i])].append(((k & (2**64 - 1)) // 2**33 * blocks // 2**31, k, p, i, doc))
    want = {x[-1]: (s, n) for s, mine in held.items() for n, x in enumerate(sorted(mine))}
    assert got == want


def test_sharding_digest_and_empty(spark, texts):
    rows = sharding.shard_digest(docs(spark, texts)).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sharding.shard_digest(empty(spark)).count() == 0
    assert sorted(r.shard for r in sharding.shard(docs(spark, ["a", "b"]), 5).collect()) == [0, 1]


def test_sharding_is_the_same_on_a_rerun(spark, texts):
    d = docs(spark, texts)
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(d, 4).collect()) for _ in range(2))
    assert a == b and len(a) == len(texts)


def test_sharding_blocks_by_bytes_and_null_ids(spark, texts):
    d = docs(spark, texts).withColumn("doc_id", F.expr("if(doc_id % 7 = 0, null, doc_id)")).withColumn("a.b", F.lit(1)).withColumn("__start", F.lit(2))
    out = sharding.shard(d, 3, block_bytes=500).collect()
    assert sum(r.doc_id is None for r in out) == len(range(0, len(texts), 7)) and "a.b" in out[0].asDict()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_communication_matrix_margins_and_law():
    m = sharding.communication_matrix([5, 0, 17, 1], 3, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 1] and sorted(m.sum(axis=0).tolist()) == [7, 8, 8]
    draws = [sharding.communication_matrix([10, 10], 2, s)[0, 0] for s in range(2000)]
    assert abs(np.mean(draws) - 5) < 0.1 and abs(np.var(draws) - 10 * 0.25 * 10 / 19) < 0.15


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(3)
    d = [sharding.draw_hypergeometric(rng, 3 * 10**9, 9 * 10**9, 1000) for _ in range(800)]
    assert abs(np.mean(d) - 250) < 2 and abs(np.std(d) - (1000 * 0.25 * 0.75) ** 0.5) < 1.2


# 2 substring dedup
def brute_repeats(rows, width):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if seen.setdefault(k, (i, s)) != (i, s):
                gone.update(range(s, s + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width", [20, 5, 7])
def test_substring_against_brute_force(spark, texts, width):
    want = brute_repeats(list(enumerate(texts)), width)
    for hot in (2_000, 1):
        got = substring.remove_repeats(docs(spark, texts).repartition(5), width, True, hot).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_many_copies_without_broadcast(spark, texts, monkeypatch):
    long = " ".join(f"c{i}" for i in range(50))
    rows = texts + [long] * 60 + [f"{long} tail {i}" for i in range(20)]
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 20)
    d = docs(spark, rows).withColumn("a.b", F.lit(1)).withColumn("T", F.lit(2)).withColumn("sig", F.lit(3))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats_digest(d).collect()}
    assert got == brute_repeats(list(enumerate(rows)), 20)


def test_substring_later_windows_over_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows, at = [], 0
    for key in range(12):
        for _ in range(rng.randrange(1, 9)):
            rows.append((key, at, 0, at, n := rng.randrange(0, 5) or 3, [rng.randrange(6) for _ in range(n)] if rng.random() < 0.8 else []))
            at += 10
    seen, want = set(), set()
    for key, d, _, start, n, hashes in rows:
        for j in range(n):
            if not hashes or (key, hashes[j]) in seen:
                want.add((d, start + j))
            if hashes:
                seen.add((key, hashes[j]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for step in (1, 2, 7, 1000):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p), kinds)], ["key", "d", "t", "start", "n", "hashes"]) for p in parts]
        out = [r for b in substring._later(iter(batches)) for r in b.to_pylist()]
        assert {(r["d"], r["start"] + j) for r in out for j in range(r["n"])} == want


def test_substring_small_vocabulary_and_periods(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)] + ["x y " * 40, "y x " * 40, "a b a c " * 25]
    got = substring.repeats_digest(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(list(enumerate(texts)), 20)


def test_substring_slices(spark, texts, monkeypatch):
    monkeypatch.setattr(substring, "SLICE", 64)
    w = np.array(list(range(300)) * 2, np.uint64)
    parts = list(substring.groups([b" ".join(b"%d" % x for x in w)], 20))
    starts = np.concatenate([g.windows(20)[3] for g in parts])
    assert starts.tolist() == list(range(581))
    names = [n for g in parts for n in substring.anchors(*(lambda s: (s[0], s[4], s[1]))(g.windows(20)), 20)[0].tolist()]
    assert names[:281] == names[300:]


def test_substring_repeated_ids_nulls_and_empty(spark):
    t = " ".join(f"k{i}" for i in range(25))
    rows = [(1, t), (1, t), (1, t + " more"), (None, t), (2, None)]
    got = substring.repeats_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in got if r.n_words != 26)[0:2] == [(False, 1, 25, x) for x in sorted(r.n_removed for r in got if r.doc_id == 1 and r.n_words == 25)]
    assert [r.n_removed for r in got if r.doc_id is None] == [25]
    assert len(got) == 5 and substring.repeats_digest(empty(spark)).count() == 0


# 3 mixing
def test_mixing_law_weights_and_order(spark):
    d = spark.createDataFrame([(i, "x" * 9, "en", "a" if i % 3 else "b", 9) for i in range(3000)], DOCS).withColumn("copies", F.lit("mine"))
    out = mixing.mix(d, weights={"a": 0.25, "b": 0.75})
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    n = Counter(r.source for r in rows)
    assert abs(n["a"] - 750) < 100 and abs(n["b"] - 2250) < 160
    b = Counter(r.doc_id for r in rows if r.source == "b")
    counts = [b[i] for i in range(0, 3000, 3)]
    assert abs(np.mean(counts) - 2.25) < 0.15 and abs(np.var(counts) - 2.25) < 0.35
    assert all(r.copies == b[r.doc_id] for r in rows if r.source == "b")


def test_mixing_large_rates_nulls_and_empty(spark):
    rows = [(i, None if i % 2 else "", "en", None, 0) for i in range(400)] + [(1000 + i, "y" * 99, "en", "big", 99) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(d, alpha=0.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n[None] / 400 - 50.5) < 2 and abs(n["big"] / 400 - 0.505) < 0.15
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(d, weights={"big": 1.0}).filter("source is null").count() == 0
    assert mixing.mix(d, weights={"absent": 1.0}).count() == 0 and mixing.mix(d, weights={}).count() == 0
    assert mixing.mix(d, weights={"big": 0}).count() == 0


def test_mixing_repeats_long_texts_and_names(spark):
    rows = [(1, "x", "en", "a", 1)] * 5 + [(2, "long " * 40_000, "en", "b", 0), (None, None, "en", "a", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("a.b", F.lit(1)).withColumn("Copy", F.lit(2)).withColumn("__tag", F.lit(3))
    out = mixing.mix(d, alpha=1.0, epochs=3.0)
    got = out.collect()
    assert {"a.b", "copy", "copies", "rate"} <= set(out.columns)
    n = Counter(r.doc_id for r in got)
    assert n[1] % 5 == 0 and all(r.copies == n[r.doc_id] for r in got if r.doc_id == 2)


# 4 LM scoring
def brute_lm(texts, targets, copies=False):
    rows = [Counter((t, i in targets) for i, t in enumerate(texts))[t, k] if copies else 0 for t in texts for k in (False, True)]
    split = [(t or "").encode().lower().split() for t in texts]
    uni, pair, starts = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, c in enumerate(split):
        k = int(i in targets)
        starts[k] += bool(c)
        uni[k].update(c)
        pair[k].update(zip([None, *c], c))
    total = [sum(u.values()) for u in uni]
    scale = [total[1] / total[0], 1.0]
    v = len(set(uni[0]) | set(uni[1]))
    out = []
    for i, c in enumerate(split):
        if not c:
            out.append(None)
            continue
        loss, own, own_pair = [0.0, 0.0], Counter(c), Counter(zip([None, *c], c))
        for k in (0, 1):
            mine = rows[2 * i + k] if copies else int(k == (i in targets))
            for before, w in zip([None, *c], c):
                p = ((uni[k][w] - mine * own[w]) * scale[k] + 1) / ((total[k] - mine * len(c)) * scale[k] + v)
                context = (starts[k] - mine if before is None else uni[k][before] - mine * own[before]) * scale[k]
                loss[k] -= np.log(((pair[k][before, w] - mine * own_pair[before, w]) * scale[k] + lmscore.PRIOR * p) / (context + lmscore.PRIOR))
        out.append((loss[1] - loss[0]) / len(c))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "bucket_words": 700}])
def test_lm_scores(spark, texts, sizes):
    d, targets = docs(spark, texts), set(range(0, 30, 2))
    ids = spark.createDataFrame([(i,) for i in [*targets, 0, 0, None]], "doc_id bigint")
    got = {r.doc_id: r.score for r in lmscore.score(d, ids, **sizes).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_lm(texts, targets)):
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-9
    assert np.mean([got[i] for i in targets]) < np.mean([got[i] for i in range(1, 30, 2)])


@pytest.mark.parametrize("limit", [_common.BROADCAST_ROWS, 0])
def test_lm_without_copies(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_ROWS", limit)
    rows = [*texts, *[texts[0]] * 9, *texts[:5], None]
    targets = {*range(0, 30, 2), len(texts), len(texts) + 1}
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id bigint")
    got = {r.doc_id: r.score for r in lmscore.score(docs(spark, rows), ids, block_bytes=3000, leave_out_copies=True).collect()}
    for i, want in enumerate(brute_lm(rows, targets, True)):
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-9
    assert len({got[i] for i, t in enumerate(rows) if t == texts[0]}) == 1


def test_lm_without_targets_or_rows(spark, texts):
    none = spark.createDataFrame([], "doc_id bigint")
    assert lmscore.score(docs(spark, texts), none).filter("score is null").count() == 3
    assert lmscore.score(empty(spark), none).count() == 0


def test_lm_copies_ties_and_names(spark, texts):
    d = docs(spark, [*texts, texts[0]]).withColumn("Target", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("block", F.lit(3))
    got = {r.doc_id: r for r in lmscore.score(d, spark.createDataFrame([(1,)], "doc_id bigint")).collect()}
    assert (got[0].score, got[0].background_loss) == (got[len(texts)].score, got[len(texts)].background_loss)
    # What stands a second time in the background is known to it; a document's own words do not count.
    assert got[0].background_loss < min(got[i].background_loss for i in range(6, 20)) - 0.2


# 5 WARC
PAGES = "page_id bigint, url string, html string"


def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", f"<p>{words(rng, 40)}é</p>") for i in range(30)]
    rows += [(100, "http://h/a", rows[3][2]), (90, "http://h/b", rows[3][2]), (40, None, None), (41, "u\r\nX: y", ""), (42, "http://h/l", "z\r\n\r\n" * 200_000)]
    return spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)), rows


@pytest.mark.parametrize("given,asked", [("s3a://b/k", "s3://b/k"), ("s3n://b/k", "s3://b/k"), ("abfss://c@h/k", "abfss://c@h/k"), ("wasb://c@h/k", "abfs://c@h/k"), ("hdfs://n/k", "hdfs://n/k"), ("file:/a/b", "file:///a/b"), ("file:///a/b", "file:///a/b")])
def test_warc_addresses_of_stores(monkeypatch, given, asked):
    seen = []
    monkeypatch.setattr(warc.fs, "FileSystem", type("Stub", (), {"from_uri": staticmethod(lambda uri: seen.append(uri) or (None, "k"))}))
    warc.opened(given)
    assert seen == [asked]


def test_warc_round_trip(spark):
    d, rows = pages(spark)
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in warc.archive_digest(d).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        r, raw = got[i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.sha1_base32(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.archive_digest(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_filters_and_payload(spark, tmp_path):
    d, rows = pages(spark)
    warc.register(spark)
    warc.as_records(d).write.format("warc").mode("append").save(str(tmp_path / "w"))
    read = spark.read.format("warc").option("payload", "full").load(str(tmp_path / "w"))
    assert read.filter("record_type = 'revisit'").count() == 3
    one = read.filter("record_id = 'urn:page:5'").collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == rows[5][2]
    assert read.filter("target_uri like 'http://h/1%'").count() == 11
    none = spark.read.format("warc").option("payload", "none").load(str(tmp_path / "w"))
    assert none.filter("payload is not null").count() == 0 and none.count() == len(rows)
    reader = warc.WarcReader(str(tmp_path / "w"), "none")
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit")])) == [] and reader.tests


def test_warc_repeats_null_ids_and_names(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (5, "u", "same"), (5, "v", "other"), (None, None, None)]
    d = spark.createDataFrame(rows, PAGES).withColumn("Payload", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("sha", F.lit("x"))
    for limit in (1_000_000, 0):
        monkeypatch.setattr(_common, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(_common, "HOT_ROWS", 2)
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_digest(d).collect())
        assert got == {(1, 4, "response", None): 2, (None, 4, "response", None): 1, (5, 4, "revisit", 1): 1, (5, 5, "response", None): 1, (None, 0, "response", None): 1}
    warc.write_archives(warc.as_records(d), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w"), "full").count() == 6 and warc.qualified(spark, "/x").startswith("file:")


def test_warc_plain_and_foreign_gzip(spark, tmp_path):
    import gzip

    records = [warc.record_bytes(f"urn:page:{i}", "response", f"http://h/{i}", b"body %d" % i, None) for i in range(5)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc").write_bytes(b"".join(records))
    (tmp_path / "a/y.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    warc.register(spark)
    out = spark.read.format("warc").option("payload", "full").load(str(tmp_path / "a")).collect()
    assert Counter(bytes(r.payload) for r in out) == Counter({b"body %d" % i: 2 for i in range(5)})


# 6 decontamination
def brute_leaks(items, corpus):
    want = set()
    for d, t in enumerate(corpus):
        w = (t or "").lower().encode().split()
        for i, x in enumerate(items):
            v = (x or "").lower().encode().split()
            if not v:
                continue
            k = min(5, len(v))
            s = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            n = len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
            if n >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(s), n))
    return want


def test_decontamination(spark, texts):
    rng = random.Random(4)
    items = [words(rng, n) for n in (3, 5, 8, 30, 60)] + ["only", None, "", words(rng, 12)]
    items.append(items[3])
    leak = items[3].upper().split()
    leak[2] = "changed"
    corpus = texts + [f"{words(rng, 500)} {items[4]} {words(rng, 900)}", f"{words(rng, 20)} {items[3]}", " ".join(leak), f"{items[2]} {items[1]}", items[0], "an only child"]
    want = brute_leaks(items, corpus)
    t = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs(spark, corpus), t).collect()}
    assert got == want and len(want) > 5
    kept = {r.doc_id for r in decontaminate.decontaminate(docs(spark, corpus), t).collect()}
    assert kept == set(range(len(corpus))) - {x[0] for x in want}


def test_decontamination_full_filter_slices_and_empty(spark, texts, monkeypatch):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts[:20])], "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contained_items(docs(spark, texts), t).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 8)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    assert sorted(map(tuple, decontaminate.contained_items(docs(spark, texts), t).collect())) == whole
    assert decontaminate.contained_items(docs(spark, texts), t.limit(0)).count() == 0
    assert decontaminate.contained_items(empty(spark), t).count() == 0
    assert decontaminate.decontaminate(docs(spark, texts), t.limit(0)).count() == len(texts)


def test_decontamination_repeats_ids_and_names(spark):
    leak = "p q r s t u v w x y"
    rows = [("a", leak), ("a", leak), ("a", "clean words only here for once"), (None, leak), (None, None), ("b", "z " * 50_000 + leak)]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("i", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("N_Shared", F.lit(3))
    t = spark.createDataFrame([("x", leak), ("x", leak), (None, "no")], "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(d, t).collect())
    assert got == {("a", "x", 6): 4, (None, "x", 6): 2, ("b", "x", 6): 2}
    out = decontaminate.decontaminate(d, t)
    assert out.columns == d.columns and sorted((r.doc_id or "", r.text or "") for r in out.collect()) == [("", ""), ("a", rows[2][1])]


def test_decontamination_sizes(spark, texts):
    items = spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(n))) for i, n in enumerate((1, 5, 9, 40, 300))], "item_id bigint, text string")
    held = {r.item_id: r for r in decontaminate.sketched(items, 0.8, 5).collect()}
    assert [(held[i].n_shingles, held[i].size_class, held[i].sketch) for i in range(5)] == [(1, 0, 1), (1, 0, 1), (5, 2, 2), (36, 5, 8), (296, 8, 60)]
    assert all([x.h & (2**64 - 1) for x in r.shingles] == sorted(x.h & (2**64 - 1) for x in r.shingles) for r in held.values())


def test_decontamination_by_size_classes(spark):
    """A document asks the classes that it can contain an item of and no other, and finds what asking all of them finds."""
    rng = random.Random(9)
    items = [words(rng, n) for n in (1, 2, 6, 8, 11, 30, 33, 70, 200, 900)] * 2
    corpus = [f"{words(rng, rng.randrange(3))} {t} {words(rng, rng.randrange(3))}" for t in items[:10]] + [words(rng, n) for n in (0, 1, 4, 7, 30, 100, 2000)]
    t = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs(spark, corpus), t).collect()}
    assert found == brute_leaks(items, corpus) and {x[1] for x in found} == set(range(20))
    held = decontaminate.sketched(t, 0.8, 5).groupBy("width", "size_class").agg(F.min("n_shingles").alias("n")).collect()
    classes = [decontaminate.SizeClass(r.width << 6 | r.size_class, r.width, int(np.ceil(0.8 * r.n - 1e-9)), 1) for r in held]
    asked = [len(decontaminate.askable(len(x.split()), classes)) for x in corpus]
    assert len(classes) > 6 and min(asked) == 0 and max(asked) == len(classes) and len(set(asked)) > 5


# 7 line dedup
def test_line_dedup(spark):
    rows = [(i, f"head {i}\n  shared line \n\nbody {i}\r\nrare" + ("\nfew" if i < 8 else ""), "en", f"s{i % 7}", 0) for i in range(40)]
    rows += [(100, None, "en", "s1", 0), (101, "", "en", None, 0), (102, "shared line", "en", None, 0), (103, "\n\n", "en", "s2", 0), (1, "shared line", "en", "s0", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("cut", F.lit(3)).withColumn("N_Lines", F.lit("mine")).withColumn("a.b", F.lit(4)).withColumn("h1", F.lit(5)).withColumn("i", F.lit(6))
    for least in (2, 5, 7, 8, 9):
        sites = defaultdict(set)
        for _, t, _, s, _ in rows:
            for x in (t or "").split("\n"):
                if x.strip(" \t\r\x0b\x0c"):
                    sites[x.strip(" \t\r\x0b\x0c")].add(s)
        gone = {x for x, s in sites.items() if len(s) >= least}
        want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c") not in gone)) for i, t, _, _, _ in rows)
        got = sorted((r.doc_id, r.kept_text) for r in linededup.remove_boilerplate(d, least).collect())
        assert [(a, b or "") for a, b in got] == [(a, b or "") for a, b in want]
    assert linededup.remove_boilerplate(d).columns == ["doc_id", "text", "lang", "source", "n_chars", "cut", "a.b", "h1", "i", "n_lines", "n_removed", "kept_text"]
    assert linededup.remove_boilerplate(empty(spark)).count() == 0


# 8 media
def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), bytes(640), rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), b"\xff" * 128, (b"a" + bytes(40)) * 64, b"text and more " * 3200]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    for p, got in zip(payloads, media.read_jpegs(media.write_jpegs(payloads))):
        assert media.payload_of(*got) == p
    assert media.read_jpegs([None, b"", b"no jpeg", media.write_jpegs([bytes(64)])[0][:40]]) == [None] * 4


def test_jpeg_slices(monkeypatch):
    p = np.random.default_rng(2).integers(0, 200, 64 * 300, dtype=np.uint8).tobytes()
    whole = media.write_jpegs([p, p])
    monkeypatch.setattr(media, "CODED", 1024)
    assert media.write_jpegs([p, p]) == whole and whole[0] == whole[1]


def test_jpeg_colour_without_restarts():
    """A three-component 2x2 subsampled file built bit by bit decodes to the coefficients put in."""
    rng, bits, want, pred = random.Random(3), [], [], [0, 0, 0]
    dc, ac = media.canonical(media.DC_LENGTHS)[2], media.canonical(media.AC_LENGTHS)[2]

    def put(code, n):
        bits.extend((code >> (n - 1 - i)) & 1 for i in range(n))

    def value(v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    for _ in range(2 * 3):
        for c in (0, 0, 0, 0, 1, 2):
            block = [rng.randrange(-300, 300)] + [rng.choice([0, 0, 0, rng.randrange(-90, 90)]) for _ in range(63)]
            size, extra = value(block[0] - pred[c])
            pred[c] = block[0]
            put(*dc[size])
            put(extra, size)
            run = 0
            for v in block[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                size, extra = value(v)
                put(*ac[run << 4 | size])
                put(extra, size)
                run = 0
            if run:
                put(*ac[0])
            want.append(block)
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    import struct

    frame = media._segment(0xC0, struct.pack(">BHHB9B", 8, 40, 30, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    tables = media._TABLES[: media._TABLES.index(b"\xff\xdd")]
    jpeg = b"\xff\xd8" + tables + frame + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    p, got = media.read_jpegs([jpeg])[0]
    assert got.tolist() == want
    t = media.thumbnail(p, got)
    assert t.shape == (6, 4) and t[1, 0] == min(255, max(0, (want[2][0] + 4 >> 3) + 128))


def plain_jpeg(data):
    """Width, height and DC differences' sums times the quantizer, block by block, of a one-component baseline JPEG, bit by bit."""
    at, codes, tables = 2, {}, {}
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            tables[body[0] & 15] = body[1]
        elif marker == 0xC0:
            high, wide, n, quantizer = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5], body[8]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xC4:
            while body:
                counts, symbols, code, table = body[1:17], iter(body[17:]), 0, {}
                for length, k in enumerate(counts, 1):
                    for _ in range(k):
                        table[length, code] = next(symbols)
                        code += 1
                    code <<= 1
                codes[body[0]], body = table, body[17 + sum(counts) :]
        elif marker == 0xDA:
            dc_table, ac_table = codes[body[2] >> 4], codes[0x10 | body[2] & 15]
            break
    assert n == 1 and data[-2:] == b"\xff\xd9"
    runs, run = [], bytearray()
    i = at
    while i < len(data) - 2:
        if data[i] == 0xFF and data[i + 1]:
            runs.append(bytes(run))
            run = bytearray()
            i += 2
            continue
        run.append(data[i])
        i += 2 if data[i] == 0xFF else 1
    out = []
    for run in [*runs, bytes(run)]:
        bits, place, last, left = "".join(f"{b:08b}" for b in run), 0, 0, -(-wide // 8) * -(-high // 8) - len(out)

        def symbol(table):
            nonlocal place
            code = length = 0
            while (length, code) not in table or not length:
                code, length, place = code << 1 | int(bits[place]), length + 1, place + 1
            return table[length, code]

        def number(size):
            nonlocal place
            v, place = int(bits[place : place + size] or "0", 2), place + size
            return v if not size or v >> size - 1 else v - (1 << size) + 1

        for _ in range(min(interval or left, left)):
            last += number(symbol(dc_table))
            out.append(last * tables[quantizer])
            k = 1
            while k < 64:
                x = symbol(ac_table)
                if not x:
                    break
                k += (x >> 4) + 1
                number(x & 15)
    return wide, high, out


def plain_feature(data):
    wide, high, dc = plain_jpeg(data)
    across, down = -(-wide // 8), -(-high // 8)
    t = [[min(255, max(0, (dc[y * across + x] + 4) // 8 + 128)) for x in range(across)] for y in range(down)]
    cut = lambda n: [range(i * n // 8, max(i * n // 8 + 1, (i + 1) * n // 8)) for i in range(8)]
    mean = [[sum(t[y][x] for y in ys for x in xs) / len(xs) for xs in cut(across)] for ys in cut(down)]
    bits = "".join(str(int(row[j] > row[(j + 1) % 8])) for row in mean for j in range(8))
    return f"{wide}x{high}x1:{across}x{down}:{int(bits, 2):016x}"


def test_media_against_a_plain_decoder(spark, texts):
    """Every column of the digest from the stored files themselves, decoded bit by bit."""
    short = [t for t in texts if t is None or len(t) < 6000]
    stored = {r.doc_id: bytes(r.media) for r in media.store_texts(docs(spark, short)).collect()}
    for r in media.media_digest(docs(spark, short)).collect():
        data = stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(data), hashlib.sha256(data).hexdigest(), plain_feature(data)), r.doc_id


def test_media_digest(spark, texts):
    rows = {r.doc_id: r for r in media.media_digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert rows[0][6:] == rows[40][6:]
    assert media.media_digest(empty(spark)).count() == 0
    odd = docs(spark, texts[:9] + texts[:2]).withColumn("media", F.lit("mine")).withColumn("Feature", F.lit(1)).withColumn("a.b", F.lit(2))
    more = {r.doc_id: r for r in media.media_digest(odd).collect()}
    assert more[0][1:] == more[9][1:] == rows[0][1:] and len(more) == 11
    made = media.jpeg_features(media.store_texts(docs(spark, texts)), "doc_id", "media").collect()
    assert all(len(r.thumb) == r.thumb_width * r.thumb_height for r in made)


# 9 language ID
def brute_bits(train, text):
    """PPM code length by direct counts."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        d = b"   " + langid.normalize(t)
        for i in range(3, len(d)):
            for k in range(4):
                counts[k][d[i - k : i]][d[i]] += 1
    d, total = b"   " + langid.normalize(text), 0.0
    for i in range(3, len(d)):
        for k in (3, 2, 1, 0):
            c = counts[k].get(d[i - k : i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if c[d[i]]:
                total -= np.log2(c[d[i]] / (n + q))
                break
            total -= np.log2(q / (n + q))
        else:
            total += 8
    return total


def test_language_code_lengths(spark):
    rng = random.Random(6)
    pools = {"en": "the and ing tion of ly wh er", "fr": "que les é aux ment oi è tion", "de": "der ung sch ü keit ein ß tion"}
    rows = [(i, " ".join("".join(rng.choices(pools[k].split(), k=3)) for _ in range(rng.randrange(1, 30))), k, "s", 0) for i, k in enumerate(list(pools) * 60)]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !!", "fr", "s", 0), (1002, "x", None, "s", 0), (1003, "日本語 \U0001f600", "en", "s", 0), (1004, "\U0001f600 42", "de", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine"))
    model = langid.load(langid.train(d)[0].value)
    learned = {k: [r[1] for r in rows if r[2] == k and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2] for k in pools}
    probes = ["The thing", "über ßé zzz", "q", rows[0][1] * 50, "日本"]
    got = model.lengths([langid.normalize(p) for p in probes])
    for j, k in enumerate(sorted(pools)):
        for i, p in enumerate(probes):
            assert abs(got[i, j] - brute_bits(learned[k], p)) < 1e-3 * max(1, got[i, j])
    out = {r.doc_id: r for r in langid.language_digest(d).collect()}
    held = [r for r in rows if r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert [out[i].lang_pred for i in (1000, 1001, 1004)] == ["und"] * 3 and out[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out.values()) and all(out[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    kept = langid.keep_known(d)
    assert kept.columns == d.columns and not {1000, 1001, 1004} & {r.doc_id for r in kept.collect()}


def test_many_languages_in_groups(spark, monkeypatch):
    """500 languages of their own syllables: the best code over all groups, the same as from one table of all languages."""
    rng = random.Random(12)
    syllables = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for _ in range(500)]
    text = lambda k: " ".join("".join(rng.choices(syllables[k], k=2)) for _ in range(12))
    rows = [(i, text(i % 500), f"l{i % 500:03}", "s", 0) for i in range(4000)]
    d = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(langid, "ENTRIES_HELD", 100_000)
    got = {r.doc_id: r for r in langid.language_digest(d).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 900 and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    one = langid.train(d, group_languages=1000)
    assert len(one) == 1 and len(langid.train(d)) == 32
    probes = [r[1] for r in rows[:300]]
    names, scores, rates = langid.judge(probes, [one[0].value])
    assert names == [got[i].lang_pred for i in range(300)] and np.allclose(scores, [got[i].score for i in range(300)])


def test_language_empty_long_and_few_texts(spark):
    rng = random.Random(4)
    en = [(i, words(rng, 20).replace("w", "the ") + " and the thing", "en", "s", 0) for i in range(20)]
    fr = [(100 + i, " ".join(rng.choices("que les été aux nation voilà".split(), k=30_000)), "fr", "s", 0) for i in range(12)]
    rest = [(200 + i, "", "de", "s", 0) for i in range(4)] + [(None, "uno dos tres cuatro cinco", "es", "s", 0)] * 3
    d = spark.createDataFrame(en + fr + rest, DOCS)
    groups = langid.train(d, bytes_each=300_000, group_languages=2)
    assert [g.value["languages"] for g in groups] == [["en", "es"], ["fr"]]
    assert sum(r.room for r in langid.training_sample(d, bytes_each=300_000).filter("lang = 'fr'").collect()) == 300_000
    out = {r.doc_id: r.lang_pred for r in langid.language_digest(d).collect()}
    assert [out[i] for i in (0, 100, 200, None)] == ["en", "fr", "und", "es"]


def test_language_long_texts_and_nothing_learned(spark, monkeypatch):
    d = docs(spark, ["the cat sat " * 3000, "la vie est belle " * 20])
    packed = langid.train(d)[0].value
    whole = langid.load(packed).lengths([langid.normalize("the cat " * 500), b"a"])
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(langid.load(packed).lengths([langid.normalize("the cat " * 500), b"a"]), whole)
    assert [r.lang_pred for r in langid.language_digest(d.withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 2
    assert langid.language_digest(empty(spark)).count() == 0


# 10 SimHash
def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [4, 12])
def test_simhash_components(spark, texts, radius):
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, radius)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(spark, texts).withColumn("fp", F.lit(1)), radius=radius).collect()}
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, want))}


def test_simhash_tiles(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:20]:  # chains of neighbours, and a dense group
        for _ in range(6):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(f)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    want = brute_components(fps, 4)
    for n, rows in ((len(fps), 20_000), (10**9, 20_000), (len(fps), 30)):
        nodes, _ = _common.connected_components(simhash.links(d, n, 4, rows), "a", "b")
        root = {r.node: r.root for r in nodes.collect()}
        groups = defaultdict(set)
        for s, c in zip(signed, want):
            groups[c].add(s)
        for g in groups.values():
            assert {root.get(s, s) for s in g} == {min(g)}


def test_simhash_dedup_repeats_nulls_and_empty(spark, texts):
    out = simhash.deduplicate(docs(spark, texts), width=4, radius=4)
    want = {i for i, c in enumerate(brute_components([brute_fingerprint(t) for t in texts], 4)) if i == c}
    assert {r.doc_id for r in out.collect()} == want
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "p q r s t"), (3, "a b c d e")]
    for how in ({}, {"radius": 4}):
        kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), **how).collect()
        assert sorted((r.doc_id or 0) for r in kept) == [1, 2]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_simhash_skips_by_population_count():
    rng = np.random.default_rng(5)
    bits = rng.random((3000, 64)) < rng.random((3000, 1))  # population counts from 0 to 64
    v = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel())
    v = v[np.argsort(np.bitwise_count(v), kind="stable")]
    pop, edge = np.bitwise_count(v).astype(np.int64), simhash.SQUARE
    compared = list(simhash.squares(pop, 4))
    tiles = -(-len(v) // edge)
    skipped = tiles * (tiles + 1) // 2 - len(compared)
    assert skipped > 0
    near = {(i, j) for i in range(len(v)) for j in (np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 4) + i + 1).tolist()}
    assert len(near) > 50 and all((i // edge * edge, j // edge * edge) in compared for i, j in near)
    tile = np.arange(len(v)) // 64  # small tiles: every pair within the radius, and rows that are done early
    hits = {(int(i), int(i) + d) for at, d in simhash.small_hits(tile, v, np.arange(len(v)), 4) for i in at}
    assert hits == {(i, j) for i, j in near if tile[i] == tile[j]}


def test_connected_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in _common.connected_components(edges, "a", "b")[0].collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000}
