"""What the third round found: joins through the driver, expressions evaluated for every use, numbers that begin again."""

from pyspark.sql import functions as F
from wardstream.operators import events, records
from wardstream.session import small


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_joined_by_a_shuffle(spark):
    """A few rows, which the planner would broadcast: so it does with many, on the size of a compressed file."""
    rows = spark.createDataFrame([(i, f"r{i}", f"t{i % 3}") for i in range(9)], "record_index bigint, record_id string, t string")
    out = records.deduplicate(rows, ["t"])
    assert "Broadcast" not in plan(out)
    assert {r.record_id: r.duplicate_of for r in out.collect()} == {f"r{i}": f"r{i % 3}" if i > 2 else None for i in range(9)}
    raw = rows.select(F.col("record_id").alias("event_id"), F.lit("f").alias("source_name"), F.lit("jsonl").alias("source_format"), "record_index", F.lit('{"host":"a"}').alias("raw"))
    out = events.process(raw, False)
    assert "Broadcast" not in plan(out)
    assert [r.duplicate_of for r in out.orderBy("record_index").collect()] == [None] + ["r0"] * 8


def test_what_is_not_small_is_joined_by_a_shuffle(spark):
    left, right = spark.range(100), spark.range(50)
    assert "Broadcast" in plan(left.join(small(right), "id"))
    assert "Broadcast" not in plan(left.join(small(right, 49), "id"))


def test_log_lines_are_searched_once(spark):
    from wardstream.sources.readers import log_fields

    df = spark.createDataFrame([("2024-01-01 10:00:00 a=1 b='x y' a=2 done",), ("none",), (None,)], "line string").select(log_fields(F.col("line")).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    first, second, third = (r.m for r in df.collect())
    assert first == {"timestamp": "2024-01-01T10:00:00Z", "10": "00:00", "a": "2", "b": "x y", "message": "a= b= a= done", "_raw_line": "2024-01-01 10:00:00 a=1 b='x y' a=2 done"}
    assert second == {"message": "none", "_raw_line": "none"} and not third


def test_records_are_parsed_once(spark):
    from wardstream.operators import soc
    from wardstream.operators.retrieval import techniques

    raw = '{"id":"SOC-000001","output":{"mitre_techniques":[{"technique_id":"T9999"}]},"metadata":{"template_id":"t1"}}'
    out = soc.template_checks(soc.parse(spark.createDataFrame([(raw,), ("no JSON",)], "raw string")), techniques(spark))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1
    assert [tuple(r) for r in out.collect()] == [("t1", "T9999", "unknown technique")]


def test_held_out_ids_beyond_a_million(spark, tmp_path):
    from wardstream.plans.soc_queries import soc_held_out

    spark.createDataFrame([(0,), (31_000_000,), (1,)], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    assert sum(r.n for r in soc_held_out(spark, str(tmp_path)).collect()) == 3


def test_files_of_lines_begin_with_a_sound_one(spark, tmp_path):
    from wardstream.plans import source_queries

    ids = [10 * i + 3 for i in range(18)] + [180, 181]
    rows = spark.createDataFrame([(i, 1, "a", "2024-01-01 00:00:00") for i in ids], "event_id bigint, user_id bigint, event_type string, ts string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    files = spark.read.text(f"{source_queries.folder(spark, str(tmp_path))}/lines", wholetext=True).collect()
    assert len(files) == 2 and all(r.value.startswith('{"id"') for r in files)


def test_rejected_rows_of_a_stream_need_no_state(spark, tmp_path):
    from test_records import flows
    from wardstream.streaming import streams

    d = flows(spark, 4)
    d.write.parquet(f"{tmp_path}/in")
    out = streams.outcomes(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"))
    said = out._jdf.queryExecution().analyzed().toString()
    assert "Union" in said and "rejected/" not in said


def test_a_fingerprint_is_read_once_a_batch():
    """Against a plain loop with a memory of two, over three batches; looks in the state are counted."""
    import collections
    import random

    import pandas as pd
    from wardstream.streaming import streams

    looks = collections.Counter()

    class State(dict):
        def getValue(self, key):
            looks[id(self)] += 1
            return self.get(key)

        updateValue, removeKey = dict.__setitem__, dict.pop

    class Counters:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    for limit, most in ((2, 120), (9, 15)):
        looks.clear()
        p = streams.FifoProcessor(limit)
        p.firsts, p.order, p.counters = State(), State(), Counters()  # a new one may get the id of one that is gone
        rng = random.Random(limit)
        rows = [(i, f"r{i}", f"f{rng.randrange(5)}") for i in range(120)]
        batches = [pd.DataFrame(rows[at : at + 40], columns=["record_index", "record_id", "fingerprint"]) for at in (0, 40, 80)]
        got = [tuple(r) for b in p.handleInputRows((0,), iter(batches), None) for r in b.astype(object).where(b.notna(), None).itertuples(index=False)]
        seen, gone, want = collections.OrderedDict(), 0, []
        for _, rid, fp in rows:
            first = seen.get(fp)
            if first is None:
                seen[fp] = rid
                if len(seen) > limit:
                    seen.popitem(last=False)
                    gone += 1
            want.append((rid, fp, first, gone))
        assert got == want and looks[id(p.firsts)] <= most


def test_columns_of_a_stream_are_computed_once(spark):
    from test_records import flows
    from wardstream.functions import vocab
    from wardstream.streaming import streams

    d = flows(spark, 4)
    plain = records.as_records(d).transform(records.normalize).transform(records.validate).withColumn("fingerprint", records.fingerprint(vocab.EXACT_FIELDS))
    size = lambda df: len(df.filter("status <> 'rejected'").select("record_id", "fingerprint", "status")._jdf.queryExecution().optimizedPlan().toString())
    assert size(streams.prepare(d)) < size(plain) / 2
    assert sorted(streams.prepare(d).select("record_id", "fingerprint", "status").collect()) == sorted(plain.select("record_id", "fingerprint", "status").collect())
