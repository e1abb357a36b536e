"""Events are read, searched for fields and split in one step of the tasks."""

from wardstream.functions import scalars as S
from wardstream.functions import vocab
from wardstream.operators import events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_are_found_where_the_text_is_read(spark):
    raws = ['{"User Name":"","user-name":"b","USERNAME":"c","x":{"y":[1,{"z":"w"}]},"n":null,"e":""}', "no json", None, "null"]
    rows = spark.createDataFrame([(f"e{i}", "s", "jsonl", i, r) for i, r in enumerate(raws)], "event_id string, source_name string, source_format string, record_index bigint, raw string")
    out = events.canonicalize(rows)
    got = {r.record_index: (r.username, r.attributes) for r in out.collect()}
    assert got == {0: ("b", {"x.y.0": "1", "x.y.1.z": "w"}), 1: (None, None), 2: (None, None), 3: (None, {})}
    held = rows.select(S.event_entries("raw").alias("e")).collect()
    assert all(len(r.e.known) == len(vocab.FIELD_ALIASES) for r in held)
    assert "map_entries" not in plan(out) and plan(out).count("ArrowEvalPython") == 1
