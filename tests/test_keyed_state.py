"""Deduplication with state kept entry by entry, against a plain loop, over restarts and evictions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from test_records import flows
from wardstream.operators import records
from wardstream.streaming import streams


def loop(rows, limit):
    """(record_id, duplicate_of, evictions) of rows (record_id, fingerprint) of one shard in order."""
    seen, gone, out = collections.OrderedDict(), 0, []
    for rid, fp in rows:
        first = seen.get(fp)
        if first is None:
            seen[fp] = rid
            if len(seen) > limit:
                seen.popitem(last=False)
                gone += 1
        out.append((rid, first, gone))
    return out


@pytest.fixture(scope="module")
def stream_rows(spark):
    """Some 150 rows of 25 fingerprints, in three files' worth, with their order."""
    rng = random.Random(2)
    base = flows(spark, 25).drop("record_id", "record_index").withColumn("i", F.monotonically_increasing_id()).toPandas()
    base["i"] = range(len(base))
    picks = [(n, rng.randrange(25)) for n in range(150)]
    one = spark.createDataFrame(base)
    return spark.createDataFrame(picks, "record_index bigint, i bigint").join(one, "i").drop("i").withColumn("record_id", F.format_string("r%03d", "record_index")).persist()


def start(spark, d, tmp_path, name, make, **trigger):
    stream = make(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    assert run.awaitTermination(120)


def test_fifo_state_over_restarts(spark, stream_rows, tmp_path):
    d = stream_rows
    part = lambda k: d.filter(F.col("record_index").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in range(3):  # each start goes on from the state that the one before left
        part(k)
        start(spark, d, tmp_path, "out", lambda s: streams.unique_fifo(s, 24, 4))
    got = {r.record_id: (r.duplicate_of, r.evictions) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = streams.prepare(d).withColumn("shard", F.pmod(F.xxhash64("fingerprint"), F.lit(4))).select("shard", "record_id", "fingerprint").orderBy("record_index").collect()
    want = {}
    for shard in range(4):
        want |= {rid: (first, gone) for rid, first, gone in loop([(r.record_id, r.fingerprint) for r in rows if r.shard == shard], 6)}
    assert got == want and len(got) == 150 and max(g for _, g in got.values()) > 3
    assert any(f is None for f, _ in list(got.values())[40:])


def test_recent_state_is_forgotten(spark, stream_rows, tmp_path):
    d = stream_rows.filter("record_index < 40").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    start(spark, d, tmp_path, "long", lambda s: streams.unique_recent(s, 3600, 4), once=True)
    long = spark.read.parquet(str(tmp_path / "long"))
    n = streams.prepare(d).select("fingerprint").distinct().count()
    assert long.count() == 40 and long.filter("duplicate_of is null").count() == n
    d.withColumn("record_id", F.concat(F.lit("x"), "record_id")).write.mode("append").parquet(str(tmp_path / "in"))
    start(spark, d, tmp_path, "long", lambda s: streams.unique_recent(s, 3600, 4), once=True)
    assert spark.read.parquet(str(tmp_path / "long")).filter("duplicate_of is null").count() == n


def test_fifo_shards_in_batch(spark):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(30)}") for i in range(400)]
    d = spark.createDataFrame(rows, "record_id bigint, k string").withColumn("record_index", F.col("record_id")).repartition(5)
    got = {r.record_id: (r.duplicate_of, r.evictions) for r in records.fifo_deduplicate(d, ["k"], 24, shards=3).collect()}
    keyed = d.withColumn("f", records.fingerprint(["k"])).select("record_id", "f", F.pmod(F.xxhash64("f"), F.lit(3)).alias("s")).orderBy("record_id").collect()
    want = {}
    for s in range(3):
        want |= {rid: (first, gone) for rid, first, gone in loop([(r.record_id, r.f) for r in keyed if r.s == s], 8)}
    assert got == want and len(got) == 400
