"""Queries of records, events, evaluation and training sets that meet every code, default and edge of their operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import evaluate, events, quality, records, retrieval, soc, suites, training
from ..session import scratch_path, written
from ..streaming import streams
from .catalogue import FLOWS, JUDGED, OUTCOME, R4, _folder, flows, judged, pick, query, sql_pick, table

#: Columns of a good record and, for each variant, what is put in and the codes that follow.
GOOD = {
    "record_id": "r", "source": "s", "src_ip": "10.0.0.1", "src_port": 80, "confidence": 0.5, "classification": "benign", "severity": "low", "attack_category": "none", "file_hash": "a" * 32,
    "timestamp": "2024-01-01T00:00:00Z", "source_label": "x", "bytes_sent": 1, "bytes_recv": 1, "packets_sent": 1, "packets_recv": 1, "duration": 1.0, "dst_ip": None, "dst_port": None,
}
RECORDS = [
    ({}, []), ({"record_id": ""}, ["missing_record_id"]), ({"source": None}, ["missing_source"]), ({"src_ip": "host"}, ["invalid_ip"]), ({"dst_ip": "a b"}, ["invalid_ip"]), ({"src_port": 70000}, ["invalid_port"]),
    ({"dst_port": -1}, ["invalid_port"]), *[({c: -1}, ["invalid_numeric"]) for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")], ({"duration": -0.5}, ["invalid_duration"]), ({"confidence": 1.5}, ["invalid_confidence"]),
    ({"confidence": None}, ["invalid_confidence"]), ({"classification": "bad"}, ["invalid_classification"]), ({"severity": "huge"}, ["invalid_severity"]), ({"attack_category": "odd"}, ["invalid_attack_category"]), ({"file_hash": "XYZ"}, ["invalid_hash"]),
    ({"timestamp": None}, ["missing_timestamp"]), ({"source_label": ""}, ["missing_source_label"]), ({"src_ip": None}, ["low_context"]), ({"src_ip": None, "timestamp": "", "severity": "huge"}, ["invalid_severity", "missing_timestamp", "low_context"]),
]
WARN = ["missing_timestamp", "missing_source_label", "low_context", "unknown_protocol", "generic_event_type"]


def _kind(v) -> str:
    return "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string"


def _variants(spark: SparkSession, sf: str, good: dict, variants: list, kinds: dict[str, str]) -> DataFrame:
    """A row for each event: the good one with its variant's values."""
    i = F.col("event_id")
    cols = []
    for c, v in good.items():
        at = F.lit(v).cast(kinds[c])
        for k, (change, _) in enumerate(variants):
            if c in change:
                at = F.when(i % len(variants) == k, F.lit(change[c]).cast(kinds[c])).otherwise(at)
        cols.append(at.alias(c))
    return table(spark, sf, "events").select("event_id", *cols)


def _codes(variants: list) -> str:
    rows = ", ".join(f"({k}, {s}, '{c}')" for k, (_, codes) in enumerate(variants) for s, c in enumerate(codes))
    return f"SELECT event_id, code, CASE WHEN code IN ({', '.join(repr(w) for w in WARN)}) THEN 'warning' ELSE 'error' END AS severity FROM events JOIN (VALUES {rows}) t(k, s, code) ON event_id % {len(variants)} = k"


@query(_codes(RECORDS))
def record_issue_codes(spark, sf):
    """Every code of the record validator, row by row."""
    kinds = {c: "int" if c.endswith("port") else _kind(v) for c, v in GOOD.items()} | {"dst_ip": "string"}
    rows = _variants(spark, sf, GOOD, RECORDS, kinds)
    out = records.validate(_typed(rows))
    return out.select("event_id", F.explode("issues").alias("i")).select("event_id", "i.code", "i.severity")


def _typed(rows: DataFrame) -> DataFrame:
    """Rows with all columns of a record, typed as after normalization."""
    missing = {c: F.lit(None).cast(t) for c, t in records.RECORD.items() if c not in rows.columns}
    return rows.withColumns(missing | {"status": F.lit("normalized"), "validation_issues": F.array().cast("array<string>")})


EVENT = {"event_id2": "e", "source_name": "f", "source_format": "jsonl", "event_type": "dns_query", "severity": "low", "port": 80, "dest_port": None, "file_hash": None, "protocol": "tcp", "raw": "{}", "timestamp": "2024-01-01T00:00:00Z", "hostname": "h", "bad": None}
EVENTS = [
    ({}, []), ({"event_id2": ""}, ["missing_event_id"]), ({"source_name": None}, ["missing_source_name"]), ({"source_format": "unknown"}, ["unknown_source_format"]), ({"event_type": "dance"}, ["invalid_event_type"]),
    ({"severity": "huge"}, ["invalid_severity"]), ({"bad": "source_ip"}, ["invalid_ip"]), ({"bad": "dest_ip"}, ["invalid_ip"]), ({"port": 70000}, ["invalid_port"]), ({"dest_port": -1}, ["invalid_port"]), ({"bad": "port"}, ["invalid_port"]),
    ({"bad": "dest_port"}, ["invalid_port"]), ({"file_hash": "xyz"}, ["invalid_hash"]), ({"protocol": "odd"}, ["unknown_protocol"]), ({"raw": '{"_parse_error":"x"}'}, ["source_parse_error"]), ({"timestamp": None}, ["missing_timestamp"]),
    ({"event_type": "generic"}, ["generic_event_type"]), ({"hostname": ""}, ["low_context"]),
]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {c: _kind(v) for c, v in EVENT.items()} | {"dest_port": "int", "port": "int"}
    rows = _variants(spark, sf, EVENT, EVENTS, kinds).withColumnRenamed("event_id", "number").withColumnRenamed("event_id2", "event_id")
    attributes = F.map_filter(F.create_map(F.coalesce(F.concat(F.lit("_invalid_"), "bad"), F.lit("none")), "bad"), lambda k, v: v.isNotNull())
    none = {c: F.lit(None).cast("string") for c in ("username", "source_ip", "dest_ip", "domain", "process_name", "file_path")}
    return rows.withColumns(none | {"attributes": attributes})


@query(_codes(EVENTS).replace("SELECT event_id, code", "SELECT event_id AS number, code"))
def event_issue_codes(spark, sf):
    """Every code of the event validator, row by row."""
    return events.validate(_events(spark, sf)).select("number", F.explode("issues").alias("i")).select("number", "i.code", "i.severity")


@query(f"""SELECT event_id AS number, CASE event_id % {len(EVENTS)} WHEN 1 THEN 'missing event_id' WHEN 3 THEN 'unknown source format' WHEN 4 THEN 'unrecognized event_type: dance' WHEN 5 THEN 'unrecognized severity: huge' ELSE '' END AS issues FROM events""")
def event_light_checks(spark, sf):
    return _events(spark, sf).select("number", F.array_join(events.light_issues(), "; ").alias("issues"))


@query("""WITH e AS (SELECT event_id, ts, user_id, event_id // 2 AS g, event_id % 2 AS c FROM events), f AS (SELECT *, event_id % 7 = 3 AS bad, count(*) OVER (PARTITION BY user_id % 20, g % 50) AS n, min(CASE WHEN event_id % 7 <> 3 THEN event_id END) OVER (PARTITION BY user_id % 20, g % 50) AS f FROM e)
  SELECT event_id AS number, CASE WHEN bad THEN 'rejected' WHEN event_id > f THEN 'duplicate' ELSE 'trusted' END AS status, CASE WHEN bad THEN 'invalid' ELSE 'valid' END AS validation_status, CASE WHEN NOT bad AND event_id > f THEN 'e-' || lpad(CAST(f AS VARCHAR), CAST(greatest(6, length(CAST(f AS VARCHAR))) AS INT), '0') END AS duplicate_of,
  'host-' || user_id % 20 AS hostname, CASE WHEN bad THEN '99999' END AS odd_port FROM f""")
def event_outcomes(spark, sf):
    """Every event with its outcome: many repeats, some with a port that does not exist."""
    i, u = F.col("event_id"), F.col("user_id") % 20
    raw = F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("Time"), F.concat(F.lit(" HOST-"), u.cast("string"), F.lit(" ")).alias("Computer-Name"), F.concat(F.lit("p"), (F.floor(i / 2) % 50).cast("string")).alias("Process_Name"),
        F.when(i % 7 == 3, "99999").otherwise("443").alias("port"), F.struct(F.lit("v ").alias("k")).alias("extra"),
    ))
    rows = table(spark, sf, "events").select(F.format_string("e-%06d", i).alias("event_id"), F.lit("f").alias("source_name"), F.lit("jsonl").alias("source_format"), i.alias("record_index"), raw.alias("raw"))
    out = events.process(rows)
    return out.select(F.col("record_index").alias("number"), "status", "validation_status", "duplicate_of", "hostname", F.when(F.col("port") == 99999, F.col("port").cast("string")).alias("odd_port"))


@query("""SELECT event_id AS number, CASE WHEN event_id % 4 = 1 THEN 'soon ' || event_id END AS unparsed, CASE WHEN event_id % 4 <> 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp, 'Process Creation on ' || CASE WHEN event_id % 3 = 0 THEN 'h' ELSE 'unknown host' END AS title, 'EVT-' || lpad(CAST(event_id + 1 AS VARCHAR), CAST(greatest(6, length(CAST(event_id + 1 AS VARCHAR))) AS INT), '0') AS evidence_id FROM events""")
def event_alert_bridge(spark, sf):
    """Events as triage alerts; a time that says nothing is kept as an attribute."""
    i = F.col("event_id")
    raw = F.to_json(F.struct(F.when(i % 4 == 1, F.concat(F.lit("soon "), i.cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"), F.when(i % 3 == 0, "h").alias("host"), F.lit("x").alias("cmd")))
    rows = table(spark, sf, "events").select(i.cast("string").alias("event_id"), F.lit("f").alias("source_name"), F.lit("jsonl").alias("source_format"), i.alias("record_index"), raw.alias("raw"))
    out = written(events.canonicalize(rows), "alerts")  # read twice below
    alert = events.alert_input(out).select(F.col("event_id").cast("bigint").alias("number"), F.col("alert.title").alias("title"), F.get("evidence", F.lit(0))["id"].alias("evidence_id"))
    return out.select(F.col("record_index").alias("number"), F.col("attributes")["_unparsed_timestamp"].alias("unparsed"), F.col("timestamp").alias("stamp")).join(alert.hint("merge"), "number")


@query(f"""WITH {FLOWS}, e AS (SELECT event_id, user_id FROM events) SELECT 'flow-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS record_id, concat_ws('; ', 'timestamp: normalized timestamp', 'src_ip: normalized ip', CASE WHEN (user_id * 37) % 70000 > 65535 THEN 'src_port: normalized port' END,
  CASE WHEN event_id % 5 <> 4 THEN 'protocol: normalized protocol' END, CASE WHEN event_id % 13 = 0 THEN 'hostname: normalized whitespace' END) AS actions FROM e""")
def record_actions(spark, sf):
    """The list of what normalization changed, in order."""
    out = records.normalize(records.as_records(flows(spark, sf)))
    return out.select("record_id", F.array_join("normalization_actions", "; ").alias("actions"))


@query(f"""WITH {OUTCOME} SELECT record_id, CASE WHEN source_label IS NULL THEN 'no_label' WHEN b IS NULL THEN 'unknown' WHEN b.level = 2 THEN 'ambiguous' ELSE 'mapped' END AS harmonization, CASE WHEN b.level = 2 THEN source_label END AS ambiguous, CASE WHEN b.level = 2 THEN b.l END AS matched,
  CASE WHEN source_label IS NOT NULL AND b IS NULL THEN source_label END AS unmapped, CASE WHEN source_label IS NOT NULL AND b IS NULL THEN 0.0 WHEN b.level = 2 THEN 0.2 ELSE 1.0 END AS confidence FROM outcome WHERE status NOT IN ('rejected', 'duplicate')""")
def harmonize_tags(spark, sf):
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark)).filter("status not in ('rejected', 'duplicate')")
    t = lambda k: F.col("enrichment_tags")[k]
    return out.select("record_id", t("harmonization").alias("harmonization"), t("ambiguous_label").alias("ambiguous"), t("ambiguous_match_key").alias("matched"), t("unmapped_label").alias("unmapped"), "confidence")


OVERRIDES = """
labels:
  "BENIGN":
    classification: "suspicious"
    attack_category: "other"
  "Brand new":
    classification: "unheard of"
    attack_category: "worm"
  Shorthand: malicious
  Dropped: nothing
"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'malicious' WHEN 4 THEN 'malicious' END AS classification, CASE event_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'worm' WHEN 2 THEN 'other' WHEN 4 THEN 'ddos' END AS category FROM events""")
def label_overrides(spark, sf):
    """Built-in labels under a file of overrides, which may bring labels of their own."""
    maps = records.label_map(spark, records.label_overrides(OVERRIDES, "cicids_2017"))
    rows = table(spark, sf, "events").select("event_id", F.lit("cicids_2017").alias("source"), pick(["BENIGN", "Brand new", "Shorthand", "Dropped", "DDoS"], F.col("event_id")).alias("source_label"))
    found = records.resolve_labels(rows.select("source", "source_label").distinct(), maps)
    return rows.join(found, ["source", "source_label"]).select("event_id", F.col("_class").alias("classification"), F.col("_category").alias("category"))


@query(f"""WITH {FLOWS}, g AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, timestamp, source_label, bytes_sent, count(*) AS c FROM flows GROUP BY ALL) SELECT count(*) AS n_groups, max(c) AS largest FROM g""")
def fingerprint_self(spark, sf):
    d = records.normalize(records.as_records(flows(spark, sf))).select(records.fingerprint(vocab.SELF_FIELDS).alias("fp"))
    return d.groupBy("fp").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_groups"), F.max("c").alias("largest"))


IPV6 = [
    ("2001:DB8:0:0:0:0:0:1", "2001:db8::1"), ("::", "::"), ("::ffff:1.2.3.4", "::ffff:102:304"), ("fe80::1%eth0", "fe80::1%eth0"), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("1:0:0:2:0:0:0:3", "1:0:0:2::3"),
    ("2001:db8::g", None), ("1:2:3", None), ("0:0:1::", "0:0:1::"), ("10.0.0.1", "10.0.0.1"),
]


@query("SELECT event_id, ip AS record_ip, ip AS event_ip FROM events JOIN (VALUES " + ", ".join(f"({k}, {'NULL' if v is None else repr(v)})" for k, (_, v) in enumerate(IPV6)) + f") t(k, ip) ON event_id % {len(IPV6)} = k")
def ipv6_normalize(spark, sf):
    raw = F.concat(F.lit(" "), pick([x for x, _ in IPV6], F.col("event_id")))
    return table(spark, sf, "events").select("event_id", S.record_ip(raw).alias("record_ip"), S.event_ip(raw).alias("event_ip"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'failure' WHEN 2 THEN 'success' WHEN 3 THEN 'odd one' WHEN 4 THEN 'false' END AS status, CASE event_id % 6 WHEN 0 THEN 'example.com' WHEN 1 THEN 'a b' WHEN 2 THEN 'x' WHEN 3 THEN 'y.z' WHEN 5 THEN 'q' END AS domain FROM events""")
def status_domain_normalize(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", S.event_status(pick(["Yes", " FAILED", "Succeeded", " Odd  one ", "no", "  "], i)).alias("status"), S.event_domain(pick(["Example.COM..", "A  b", " X", "y.z.", "", "q."], i)).alias("domain"))


@query(f"""WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (truth = pred) AS n_correct, {R4('count(*) FILTER (truth = pred) / count(*)')} AS accuracy FROM judged""")
def accuracy_by_key(spark, sf):
    """Truth and predictions from two tables, matched by key whatever their order."""
    j = judged(spark, sf)
    both = evaluate.keyed(j.select("doc_id", "truth").orderBy(F.desc("doc_id")), j.select("doc_id", "pred").repartition(3), "doc_id")
    return evaluate.accuracy(both, "truth", "pred")


@query(f"""WITH b AS (SELECT 'accuracy' AS metric, avg(quality) AS base, avg(1 - toxic) AS tuned FROM labels UNION ALL SELECT 'hallucination', avg(quality), avg(1 - toxic) FROM labels)
  SELECT metric, base, tuned, {R4('tuned - base')} AS delta, CASE WHEN metric = 'hallucination' THEN tuned < base ELSE tuned > base END AS improved FROM b""")
def metric_deltas(spark, sf):
    row = table(spark, sf, "labels").agg(F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"))
    long = lambda c: row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m in ("accuracy", "hallucination")])).alias("x")).select("x.*")
    return evaluate.deltas(long("a"), long("b"))


@query("""SELECT s_suppkey, suite, CASE suite WHEN 'research' THEN a >= 0.5 AND f >= 0.3 AND e <= 0.2 ELSE a >= 0.75 AND f >= 0.75 AND e <= 0.05 END AS passed FROM (SELECT s_suppkey, (s_suppkey % 11) / 10 AS a, (s_suppkey % 7) / 6 AS f, (s_suppkey % 5) / 20 AS e FROM supplier), (VALUES ('research'), ('production')) t(suite)""")
def suite_gates(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k, ((k % 11) / 10).alias("accuracy"), ((k % 7) / 6).alias("macro_f1"), ((k % 5) / 20).alias("parse_error_rate"))
    return evaluate.suite_gate(rows, "research").union(evaluate.suite_gate(rows, "production")).select("s_suppkey", "suite", "passed")


@query(f"""SELECT count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS n_malformed, count(*) FILTER (event_id % 6 <> 0 AND event_id % 4 = 1) AS n_forbidden, CAST(sum(event_id % 3) FILTER (event_id % 6 <> 0) AS BIGINT) AS attempts, CAST(sum(least(event_id % 3, 1)) FILTER (event_id % 6 <> 0) AS BIGINT) AS contained,
  {R4('sum(least(event_id % 3, 1)) FILTER (event_id % 6 <> 0) / sum(event_id % 3) FILTER (event_id % 6 <> 0)')} AS containment FROM events""")
def safety_evaluation(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(F.when(i % 6 != 0, "completed").alias("status"), F.when(i % 4 == 1, F.array(F.lit("shell"), F.lit("mitre"))).otherwise(F.array(F.lit("mitre"))).alias("tools"), (i % 3).alias("attempts"), F.least(i % 3, F.lit(1)).alias("contained"))
    return evaluate.safety_report(rows, ["shell", "write_file"])


@query("SELECT coalesce(CASE event_id % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'benign' END, 'none') AS conclusion, count(*) AS n FROM events GROUP BY 1")
def conclusion_histogram(spark, sf):
    i = F.col("event_id") % 4
    return suites.conclusions(table(spark, sf, "events").select(F.when(i.isin(0, 2), "benign").when(i == 1, "suspicious").alias("conclusion")))


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'record' ELSE 'unknown' END AS format, count(*) AS n, count(*) FILTER (doc_id % 5 <> 0) AS n_parsed, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 2 = 0) AS n_exact FROM documents GROUP BY 1""")
def prediction_texts(spark, sf):
    """Predictions as texts: their format, and how many are the truth to the letter."""
    i = F.col("doc_id")
    body = pick(['{"messages":[]}', '{"output":{}}', "no json"], i)
    rows = table(spark, sf, "documents").select(evaluate.prediction_format(body).alias("format"), F.lit("yes").alias("truth"), F.when(i % 2 == 0, " yes ").otherwise("no").alias("pred"), F.when(i % 5 == 0, "bad").alias("error"))
    out = None
    for f in ("chat", "record", "unknown"):
        part = evaluate.exact_match(rows.filter(F.col("format") == f), "truth", "pred", "error").select(F.lit(f).alias("format"), "*")
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {JUDGED} SELECT count(*) AS n, {R4('count(*) FILTER (doc_id % 9 <> 0) / count(*)')} AS coverage, {R4('count(*) FILTER (doc_id % 9 <> 0 AND truth = pred) / count(*) FILTER (doc_id % 9 <> 0)')} AS valid_accuracy, {R4('count(*) FILTER (doc_id % 9 <> 0 AND truth = pred) / count(*)')} AS end_to_end_accuracy,
  floor(avg(n_chars) FILTER (doc_id % 9 <> 0) * 100.0 + 0.5) / 100.0 AS mean_latency, count(*) FILTER (doc_id % 9 = 0) AS n_errors, count(*) FILTER (doc_id % 9 <> 0) / count(*) >= 0.7 AS conclusive FROM judged""")
def paired_run_metrics(spark, sf):
    return evaluate.paired_metrics(judged(spark, sf).withColumn("err", F.when(F.col("doc_id") % 9 == 0, "bad")), "truth", "pred", "err", "n_chars")


@query("""SELECT count(*) AS n, count(*) FILTER (len(list_filter(l, lambda x: NOT list_contains(l[1:2], x))) > 0) AS n_distracted FROM (SELECT list(l_linenumber ORDER BY l_linenumber) AS l FROM lineitem GROUP BY l_orderkey)""")
def distractor_share(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    return quality.distractor_rate(g, F.col("ids"), F.slice("ids", 1, 2))


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'fallback' END AS severity FROM events""")
def highest_severities(spark, sf):
    lists = [["low", "critical"], ["low", "odd"], ["medium", "informational"], ["high"], ["odd"]]
    i = F.col("event_id") % 5
    f = F.coalesce(*[F.when(i == k, F.array(*[F.struct(F.lit(s).alias("severity")) for s in x])) for k, x in enumerate(lists)])
    return table(spark, sf, "events").select("event_id", f.alias("f")).select("event_id", training.highest_severity("f", F.lit("fallback")).alias("severity"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'benign' WHEN 3 THEN 'benign' END AS classification, event_id % 4 IN (0, 1, 3) AS is_json FROM events""")
def answer_json(spark, sf):
    """The JSON object in answers with fences and talk around it."""
    texts = ['```json\n{"classification":"benign"}\n```', 'Sure: {"other": {"a": 1}} done', "none {broken", 'x {"classification": "benign", "n": "}"} y']
    body = retrieval.response_json(pick(texts, F.col("event_id")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(body, "$.classification").alias("classification"), body.isNotNull().alias("is_json"))


_NUM = "CAST(('0x' || substr(md5(text), 1, 8)) AS BIGINT)"
_LOW = "lower(substr(text, 1, 1)) || substr(text, 2)"


def _worded_sql(style: training.Style) -> str:
    """SQL of the text in a style, by the class c; a hash of the text chooses among openings and endings."""
    of = lambda pool: f"{sql_pick(list(pool), _NUM)}"
    opening = "CASE c " + " ".join(f"WHEN '{k}' THEN {of(v)}" for k, v in style.openings.items() if k) + f" ELSE {of(style.openings[''])} END" if len(style.openings) > 1 else of(style.openings[""])
    return f"({opening}) || {_LOW if style.lowered else 'text'} || {of(style.endings)}"


@query(f"""WITH d AS (SELECT doc_id, text, {sql_pick(vocab.SOC_CLASSIFICATIONS, 'length(text)')} AS c FROM documents)
  SELECT doc_id, md5(CASE length(text) % 4 {' '.join(f'WHEN {i} THEN {_worded_sql(s)}' for i, s in enumerate(training.RATIONALES))} END) AS rationale, md5(CASE length(text) % 3 {' '.join(f'WHEN {i} THEN {_worded_sql(s)}' for i, s in enumerate(training.FINDINGS))} END) AS finding FROM d""")
def worded_texts(spark, sf):
    """The texts as rationales and findings in every style, for a class and style that follow from their length."""
    n = F.length("text")
    d = table(spark, sf, "documents").withColumn("c", pick(vocab.SOC_CLASSIFICATIONS, n))
    worded = lambda k, styles: F.md5(training.worded(F.col("text"), n % k, F.col("c"), styles))
    return d.select("doc_id", worded(4, training.RATIONALES).alias("rationale"), worded(3, training.FINDINGS).alias("finding"))


@query("""WITH r AS (SELECT doc_id, CAST(replace(replace(replace('{"title": "{src}: {lang}", "{lang}": {"n": 1, "parts": ["{src}", {"text": "{text}"}]}}', '{src}', CAST(to_json(source) AS VARCHAR)[2:-2]), '{lang}', lang), '{text}', CAST(to_json(text) AS VARCHAR)[2:-2]) AS JSON) AS j FROM documents)
  SELECT doc_id, j->>'$.title' AS title, CAST(json_keys(j)[2] AS VARCHAR) AS key, md5(coalesce(json_extract_string(j, '$."' || json_keys(j)[2] || '".parts[1].text'), '')) AS text FROM r""")
def template_fill_nested(spark, sf):
    """Placeholders in texts, keys and nested lists of a template, filled with values that need escaping."""
    raw = training.fill_json(F.lit('{"title": "{src}: {lang}", "{lang}": {"n": 1, "parts": ["{src}", {"text": "{text}"}]}}'), {"src": F.col("source"), "lang": F.col("lang"), "text": F.col("text")})
    d = table(spark, sf, "documents").withColumn("v", F.parse_json(raw))
    key = F.col("lang")
    inner = F.from_json(F.to_json("v"), "map<string,string>")[key]
    return d.select("doc_id", F.variant_get("v", "$.title", "string").alias("title"), key.alias("key"), F.md5(F.get_json_object(inner, "$.parts[1].text")).alias("text"))


@query("""WITH s AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('42|' || p_partkey), p_partkey) AS rn FROM part),
  t AS (SELECT p_partkey, p_brand, CASE WHEN rn <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN rn <= greatest(1, floor(n * 0.8)) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM s),
  v AS (SELECT *, unnest(range(0, 20)) AS variant FROM t), r AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || p_partkey || '/' || variant), p_partkey || '/' || variant) AS k FROM v)
  SELECT p_partkey AS template_no, CAST(variant AS INT) AS variant, split, 'SOC-' || lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INT), '0') AS record_id, 'template:' || p_partkey || ',' || p_brand || ',' || split AS tags FROM r""")
def generated_records(spark, sf):
    """Templates split by brand, expanded twenty times and numbered in seeded order."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("template_no"), "p_brand")
    return training.generate_records(t, "p_brand").select("template_no", "variant", "split", "record_id", F.array_join("tags", ",").alias("tags"))


def _draw_sql(key: str, field: str, least: int, most: int) -> str:
    return f"(CAST('0x' || substr(sha256('42|{field}|' || {key}), 1, 12) AS BIGINT) % {most - least + 1} + {least})"


_BACK = [f"{t}|{d}" for t, d in training.BACKGROUND]


@query(f"""WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
  x AS (SELECT *, {_draw_sql('conv_id', 'has', 0, 99)} < 30 AS has, 1700000000 + n * 5 + 15 + {_draw_sql('conv_id', 'gap', 0, 59)} AS t FROM g)
  SELECT conv_id, n + CAST(has AS INT) AS n, CASE WHEN has THEN 'EVT-' || lpad(CAST(n + 1 AS VARCHAR), 3, '0') || '|' || {sql_pick(_BACK, _draw_sql('conv_id', 'kind', 0, len(_BACK) - 1))} || '|' || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS added FROM x""")
def distracted_evidence(spark, sf):
    """Evidence with background events: how many items there are, and what was added after the last."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    one = lambda i: F.struct(F.format_string("EVT-%03d", i).alias("id"), F.lit("email").alias("type"), F.lit("d").alias("description"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + i * 5), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    g = g.withColumn("before", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), one))
    g = g.withColumn("after", training.with_distractor(F.col("before"), F.col("conv_id")))
    last = F.element_at("after", -1)
    added = F.when(F.size("after") > F.size("before"), F.concat_ws("|", *[last[f] for f in ("id", "type", "description", "timestamp")]))
    return g.select("conv_id", F.size("after").cast("bigint").alias("n"), added.alias("added"))


@query(f"""WITH {OUTCOME}, k AS (SELECT record_id, record_index, source, coalesce(CASE WHEN source_label IS NULL THEN 'insufficient_evidence' ELSE b.c END, '') AS c, CASE WHEN source_label IS NULL THEN 'other' ELSE b.a END AS a, src_ip, dst_ip FROM outcome WHERE status = 'harmonized')
  SELECT record_id, c AS classification, NOT (c = 'benign') AS investigation_required, 'EVT-' || lpad(CAST(record_index + 1 AS VARCHAR), CAST(greatest(6, length(CAST(record_index + 1 AS VARCHAR))) AS INT), '0') AS evidence, CASE WHEN a <> 'none' THEN 'Classified as ' || c || ' — ' || a || ' activity detected from source ' || source || '.' ELSE 'Classified as ' || c || ' based on network flow analysis.' END AS summary,
  CASE c WHEN 'malicious' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END AS n_actions FROM k""")
def sft_answers(spark, sf):
    """The expected answers of all records that training takes."""
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark)).filter("status = 'harmonized'")
    body = training.assistant_response()
    get = lambda p: F.get_json_object(body, p)
    return out.select("record_id", get("$.classification").alias("classification"), get("$.investigation_required").cast("boolean").alias("investigation_required"), get("$.evidence_ids[0]").alias("evidence"), get("$.summary").alias("summary"), F.json_array_length(get("$.recommended_actions")).alias("n_actions"))


@query(f"""WITH {OUTCOME}, k AS (SELECT CASE WHEN source_label IS NULL THEN 'insufficient_evidence' ELSE b.c END AS c FROM outcome WHERE status = 'harmonized'), n AS (SELECT c, count(*) AS n FROM k GROUP BY 1), m AS (SELECT max(n) AS t FROM n)
  SELECT c AS classification, CAST(t AS BIGINT) AS n, CAST(greatest(1, floor(t * 0.8)) AS BIGINT) AS n_train, CAST(floor(t * 0.1) AS BIGINT) AS n_validation, 3 AS n_messages FROM n, m""")
def sft_generate(spark, sf):
    """Balanced and split chat examples: sizes by class."""
    done = records.run_pipeline(flows(spark, sf), records.label_map(spark))
    out = training.generate(done, "Judge the alert.", "oversample")
    part = lambda s: F.count_if(F.col("split") == s)
    return out.groupBy("classification").agg(F.count("*").alias("n"), part("train").alias("n_train"), part("validation").alias("n_validation"), F.max(F.size("messages")).alias("n_messages"))


@query(f"""WITH h AS (SELECT lang AS c, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT {R4('-sum(n / t * log2(n / t)) / log2(CAST(count(*) AS DOUBLE))')} AS balance FROM h, (SELECT sum(n) AS t FROM h)),
  q AS (SELECT count(*) AS n, count(*) - count(DISTINCT text) AS d, avg(CASE WHEN length(text) >= 100 THEN 1.0 ELSE 0.0 END) AS v FROM documents)
  SELECT concat_ws('; ', CASE WHEN balance < 0.3 THEN 'severe class imbalance' WHEN balance < 0.6 THEN 'moderate class imbalance' END, CASE WHEN v < 0.9 THEN 'more than a tenth of the records are invalid' END, CASE WHEN d > 0.05 * n THEN 'more than one record in twenty is a duplicate' END, CASE WHEN (SELECT max(n) FROM h) > 0.9 * n THEN 'one class holds over nine tenths of the records' END) AS issues FROM q, b""")
def quality_issue_texts(spark, sf):
    d = table(spark, sf, "documents").withColumn("fp", F.sha2("text", 256))
    row = quality.overall(d, "lang", ["lang", "source"], "fp", F.length("text") >= 100)
    return quality.quality_issues(row, quality.class_histogram(d, "lang")).select(F.array_join("issues", "; ").alias("issues"))


@query("SELECT 'Dataset is empty' AS issues, 0 AS n")
def quality_of_nothing(spark, sf):
    d = table(spark, sf, "documents").withColumn("fp", F.sha2("text", 256)).filter("text is null and text is not null")
    return quality.analyze(d, "lang", ["lang", "source"], "fp", F.length("text") >= 100).select(F.array_join("issues", "; ").alias("issues"), F.col("n").cast("int").alias("n"))


@query(f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, {R4(f'count({c}) / count(*)' if c in ('timestamp', 'src_ip', 'dst_ip', 'src_port', 'dst_port', 'protocol', 'source_label') else '0.0 * count(*)')} AS completeness FROM flows" for c in vocab.COMPLETENESS_FIELDS))
def completeness_all_fields(spark, sf):
    return quality.completeness(records.normalize(records.as_records(flows(spark, sf))), vocab.COMPLETENESS_FIELDS)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'last' AS username, 'id= host= user= user= did ' || event_type AS message, TRUE AS has_line FROM events")
def log_lines(spark, sf):
    """Fields of log lines: the last of a key, and the line without times and values."""
    from ..sources.readers import log_fields

    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" id="), F.col("event_id").cast("string"), F.lit(" host='h1 x' user="), F.col("user_id").cast("string"), F.lit(" user='last'  did "), "event_type")
    m = F.col("m")
    e = table(spark, sf, "events").select("event_id", line.alias("line"), log_fields(line).alias("m"))
    return e.select("event_id", m["timestamp"].alias("stamp"), m["user"].alias("username"), F.regexp_replace(m["message"], " +", " ").alias("message"), (m["_raw_line"] == F.col("line")).alias("has_line"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS f, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  s AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, CAST([] AS STRUCT(f VARCHAR, k BIGINT)[]) AS seen, CAST(NULL AS BIGINT) AS duplicate_of, CAST(0 AS BIGINT) AS evictions
  UNION ALL SELECT d.r, d.doc_id, CASE WHEN h IS NOT NULL THEN seen ELSE list_append(seen, struct_pack(f := d.f, k := d.doc_id))[-100:] END, h, evictions + CASE WHEN h IS NULL AND len(seen) = 100 THEN 1 ELSE 0 END
    FROM (SELECT s.*, list_filter(seen, lambda x: x.f = d2.f)[1].k AS h FROM s JOIN d d2 ON d2.r = s.r + 1) s JOIN d ON d.r = s.r + 1)
  SELECT doc_id, duplicate_of, evictions FROM s WHERE r > 0""")
def fifo_window(spark, sf):
    """A memory of 100 texts over all documents in order: an ordered pass by definition."""
    return records.fifo_deduplicate(table(spark, sf, "documents").select("doc_id", "text"), ["text"], 100, "doc_id", "doc_id").select("doc_id", "duplicate_of", "evictions")


@query("SELECT doc_id, CASE WHEN doc_id > f THEN f END AS duplicate_of, CAST(0 AS BIGINT) AS evictions FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def fifo_shards(spark, sf):
    """The same with 16 shards side by side, and a memory that no shard fills."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return records.fifo_deduplicate(docs, ["text"], 1 << 30, "doc_id", "doc_id", shards=16).select("doc_id", "duplicate_of", "evictions")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf))


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when it has read all there is, through files in the shared folder."""
    spark = stream.sparkSession
    name = f"s{uuid.uuid4().hex}"
    if mode == "append":
        out = scratch_path(spark, "stream")
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state")).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _stream_flows(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return _stream(spark, sf).select(F.format_string("flow-%08d", i).alias("record_id"), F.lit("cicids_2017").alias("source"), i.alias("record_index"), F.col("event_type").alias("source_label"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"), F.when(i % 9 == 0, "-4").otherwise("4").alias("bytes_sent"), F.col("ts"))


@query("SELECT DISTINCT event_type AS source_label, '10.0.0.' || user_id % 250 AS src_ip FROM events WHERE event_id % 9 <> 0")
def stream_unique(spark, sf):
    """The first of each fingerprint on a stream over the events' file."""
    return _run(streams.unique(_stream_flows(spark, sf)).select("source_label", "src_ip"))


@query("""WITH e AS (SELECT event_id, event_id % 9 = 0 AS bad, min(CASE WHEN event_id % 9 <> 0 THEN event_id END) OVER (PARTITION BY event_type, user_id % 250) AS f FROM events)
  SELECT CASE WHEN bad THEN 'rejected' WHEN event_id > f THEN 'duplicate' ELSE 'validated' END AS status, count(*) AS n FROM e GROUP BY 1""")
def stream_outcomes(spark, sf):
    """Every row of a stream with its outcome: rejected and duplicate rows stay."""
    return _run(streams.outcomes(_stream_flows(spark, sf))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT event_type || '|' || user_id % 250 || '|' || (event_id % 9 = 0)) AS n_repeated, CAST(0 AS BIGINT) AS evictions FROM events")
def stream_fifo(spark, sf):
    """Every row of a stream with the row that it repeats, from state kept entry by entry."""
    return _run(streams.unique_fifo(_stream_flows(spark, sf), 1 << 30, 8)).agg(F.count("*").alias("n"), F.count("duplicate_of").alias("n_repeated"), F.max("evictions").alias("evictions"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Rows by day and type on a stream; the complete result of all windows."""
    s = streams.windowed_counts(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "30 days", "event_type")
    return _run(s, "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS n_rejected FROM events")
def stream_transforms(spark, sf):
    """The record transforms on a stream are those of a table."""
    return _run(streams.prepare(_stream_flows(spark, sf)).select("status")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "rejected").alias("n_rejected"))


@query("""SELECT r_name AS region, n_name AS nation FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE k <= 3 ORDER BY 1, 2""")
def top_of_each(spark, sf):
    """The first three of each list, in the order of two keys."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return lists.select(F.col("r_name").alias("region"), F.explode(soc.top(F.col("names"), 3)).alias("nation")).orderBy("region", "nation")


@query("""WITH w AS (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1), r AS (SELECT lang, CAST(round_even(1000 * c / (SELECT sum(c) FROM w), 0) AS BIGINT) AS n FROM w)
  SELECT lang, CAST(CASE WHEN lang = (SELECT max(lang) FROM w) THEN 1000 - (SELECT coalesce(sum(n), 0) FROM r WHERE lang <> (SELECT max(lang) FROM w)) ELSE n END AS BIGINT) AS n FROM r""")
def task_allocation(spark, sf):
    """A thousand tasks shared out by the number of documents in each language."""
    weights = table(spark, sf, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("c"))
    return suites.allocate_rows(weights, "lang", "c", 1000)


_NAMES = "names AS (SELECT name FROM (VALUES ('alerts'), ('auth'), ('file'), ('mitre_lookup'), ('network'), ('process'), ('threat_intel'), ('cicids_2017'), ('cicids_2018'), ('ctu_13'), ('custom_csv'), ('ember'), ('labelled_frame'), ('mitre_attack'), ('soc'), ('unsw_nb15'), ('csv'), ('excel'), ('json'), ('jsonl'), ('parquet'), ('text_log'), ('xml')) t(name))"


@query(f"WITH {_NAMES}, a AS (SELECT event_type AS k FROM events UNION ALL SELECT source FROM documents UNION ALL SELECT role FROM conversations) SELECT name, count(k) AS n FROM names LEFT JOIN (SELECT CASE WHEN k IS NULL THEN 'text_log' WHEN k IN (SELECT name FROM names) THEN k ELSE 'custom_csv' END AS k FROM a) ON k = name GROUP BY 1")
def registered_names(spark, sf):
    """What the registries of tools, connectors and readers hold, with the rows whose kind each would serve: unknown kinds
    go to the connector of custom tables, rows without one to the reader of lines."""
    from ..operators import tools as _tools  # noqa: F401 (registers the tools)
    from ..registry import connectors, readers, tools
    from ..sources import connectors as _c, readers as _r  # noqa: F401

    held = {n for r in (tools, connectors, readers) for n in r.keys()}
    kinds = [table(spark, sf, t).select(F.col(c).alias("k")) for t, c in (("events", "event_type"), ("documents", "source"), ("conversations", "role"))]
    k = F.col("k")
    served = kinds[0].union(kinds[1]).union(kinds[2]).select(F.when(k.isNull(), "text_log").when(k.isin(*held), k).otherwise("custom_csv").alias("name"))
    counts = served.groupBy("name").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(n,) for n in sorted(held)], "name string").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'authentication' WHEN event_id % 3 = 1 THEN 'lateral' ELSE 'none' END AS hint, contains(lower(event_type), 'click') AS says_click FROM events""")
def lexical_indicators(spark, sf):
    """Flags of words in texts, as the boundary analysis has them."""
    text = pick(["user LOGIN ok", "moved via PsExec", "quiet"], F.col("event_id"))
    words = {"authentication": ["login", "logon"], "lateral": ["psexec", "wmi"]}
    return table(spark, sf, "events").select("event_id", quality.lexical_hint(text, words).alias("hint"), F.lower("event_type").contains("click").alias("says_click"))


@query(f"""WITH {OUTCOME} SELECT record_id, status, src_port, CASE WHEN status IN ('rejected', 'duplicate') THEN NULL WHEN source_label IS NULL THEN 'no_label' WHEN b IS NULL THEN 'unknown' WHEN b.level = 2 THEN 'ambiguous' ELSE 'mapped' END AS tag FROM outcome""")
def record_lines_round_trip(spark, sf):
    """Processed records written as JSON lines and loaded again with their types."""
    from ..sources import sinks

    path = scratch_path(spark, "lines")
    sinks.write_jsonl(records.run_pipeline(flows(spark, sf), records.label_map(spark)), path)
    return records.load_records(spark, path).select("record_id", "status", "src_port", F.col("enrichment_tags")["harmonization"].alias("tag"))


@query(f"""WITH {OUTCOME} SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('rejected', 'duplicate') THEN status WHEN record_index % 2 = 0 THEN 'flagged' ELSE 'validated' END AS status FROM outcome) GROUP BY 1""")
def pipeline_of_own_steps(spark, sf):
    """The pipeline with a step of the user's own in place of enrichment and harmonization."""
    flag = lambda d: d.withColumn("status", F.when((F.col("status") == "validated") & (F.col("record_index") % 2 == 0), "flagged").otherwise(F.col("status")))
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark), steps=[flag])
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id, quality AS g FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE doc_id % 10 = 1 UNION ALL SELECT -1, 0), j AS (SELECT m.*, l.quality AS q, l.doc_id IS NULL AS lost FROM m LEFT JOIN labels l ON m.doc_id = l.doc_id)
  SELECT CAST(count(*) AS BIGINT) AS n, (SELECT count(*) FROM (SELECT doc_id FROM m GROUP BY 1 HAVING count(*) > 1)) AS n_repeated, (SELECT count(*) FROM (SELECT g FROM m GROUP BY 1 HAVING count(*) <> 10)) AS n_uneven_classes, count(*) FILTER (lost) AS n_missing, count(*) FILTER (NOT lost AND q <> g) AS n_mislabelled, FALSE AS ok FROM j""")
def manifest_faults(spark, sf):
    """A manifest with foreign keys and wrong labels."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("g"))
    m = lab.filter("doc_id % 2 = 0").union(lab.filter("doc_id % 10 = 1").select("doc_id", 1 - F.col("g"))).union(spark.createDataFrame([(-1, 0)], "doc_id bigint, g int"))
    return suites.manifest_report(m, lab, "doc_id", "g", 20, 10)


@query("""SELECT count(*) AS n, 0 AS n_faults, TRUE AS ok FROM (SELECT DISTINCT lang FROM documents), range(0, 10)""")
def manifest_whole(spark, sf):
    """The first ten documents of each language are a sound evaluation set."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    first = records.first_per_group(d, "lang", ["doc_id"], 10).select("doc_id", "lang")
    n = 10 * d.select("lang").distinct().count()
    out = suites.manifest_report(first, d, "doc_id", "lang", n, 10)
    return out.select(F.col("n").cast("bigint").alias("n"), (F.col("n_repeated") + F.col("n_missing")).cast("int").alias("n_faults"), "ok")


_CONF = "CASE c " + " ".join(f"WHEN '{c}' THEN {_draw_sql('conv_id', 'confidence', *r)}" for c, r in training.CONFIDENCES.items()) + f" ELSE {_draw_sql('conv_id', 'confidence', 50, 80)} END / 100.0"


@query(f"""WITH g AS (SELECT conv_id, count(*) AS n, {sql_pick([*vocab.SOC_CLASSIFICATIONS, 'other'], 'sum(length(text))')} AS c FROM conversations GROUP BY 1),
  s AS (SELECT *, epoch(TIMESTAMP '2026-02-01 09:00:00') - {_draw_sql('conv_id', 'days', 0, 30)} * 86400 - {_draw_sql('conv_id', 'hours', 0, 20)} * 3600 - {_draw_sql('conv_id', 'minutes', 0, 50)} * 60 AS start FROM g),
  e AS (SELECT conv_id, i, start + coalesce(sum(CASE WHEN i > 0 THEN {_draw_sql("(conv_id || '/' || i)", 'gap', *training.GAPS)} ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM s)),
  t AS (SELECT conv_id, string_agg(strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY i) AS stamps FROM e GROUP BY 1)
  SELECT conv_id, sha256(CASE WHEN c IN ('likely_malicious', 'confirmed_malicious') THEN 'hostile/' ELSE 'harmless/' END || {_draw_sql('conv_id', 'file', 0, 999_999_999)}) AS file_hash, stamps, CAST({_CONF} AS DOUBLE) AS confidence, 'RULE-' || {_draw_sql('conv_id', 'rule', 1000, 9999)} AS rule_id FROM g JOIN t USING (conv_id)""")
def synthetic_values(spark, sf):
    """Made-up hashes, event times, confidences and rules for a record of each conversation, an event for each turn."""
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    rows = per.withColumn("c", pick([*vocab.SOC_CLASSIFICATIONS, "other"], F.col("size")))
    out = training.synthetic_values(rows, "conv_id", "c", "n", "2026-02-01T09:00:00Z")
    return out.select("conv_id", "file_hash", F.array_join("stamps", ",").alias("stamps"), "confidence", "rule_id")
