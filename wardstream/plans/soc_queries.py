"""Queries over nested triage records: one for each event, from a base record with one rule of validation broken at a time.

The SQL states which rule each variant breaks, and reads everything else from the JSON text itself.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import sorted_json
from ..operators import soc, training
from ..session import scratch_path
from ..sources import connectors, sinks
from .catalogue import pick, query, sql_pick, table

BASE = {
    "id": "SOC-{n}", "task": "alert_triage",
    "input": {
        "alert": {"title": "Logon burst", "severity": "medium", "source": "sensor", "timestamp": "2024-01-01T10:00:00Z", "rule_id": "R-7"},
        "context": {"hostname": "host-1", "username": "ana", "os": "Windows 11"},
        "evidence": [
            {"id": "EVT-001", "type": "authentication", "description": "ten failed logons", "timestamp": "2024-01-01T09:59:00Z", "raw_data": {"count": 10}},
            {"id": "EVT-002", "type": "process_creation", "description": "shell started", "timestamp": "2024-01-01T10:00:00Z"},
        ],
    },
    "output": {
        "classification": "suspicious", "confidence": 0.8, "rationale": "burst before a shell",
        "findings": [{"description": "password guessing", "evidence_refs": ["EVT-002", "EVT-001"], "severity": "high"}, {"description": "shell", "evidence_refs": ["EVT-002"], "severity": "low"}],
        "mitre_techniques": [{"technique_id": "T1110.001", "technique_name": "Password Guessing", "tactic": "Credential Access", "evidence_refs": ["EVT-001"]}],
        "recommended_actions": [{"action": "reset the password", "priority": "high"}],
    },
    "metadata": {"source": "synthetic", "generator": "rules", "review_status": "pending", "dataset_version": "1", "quality_score": 90, "template_id": "t1", "split": "train"},
}

#: What each variant changes (path, value; None takes the key away) and the issues that follow.
E, W = "error", "warning"
VARIANTS: list[tuple[list, list[tuple[str, str]]]] = [
    ([], []),
    ([("metadata.split", "test"), ("input.context.os", "Ubuntu 22")], []),
    ([("id", "X-{n}")], [("invalid_id", E)]),
    ([("task", "other")], [("invalid_task", E)]),
    ([("task", None)], [("missing_field", E)]),
    ([("input.alert.title", " ")], [("empty_field", E)]),
    ([("input.alert.source", None)], [("missing_field", E)]),
    ([("input.alert.severity", "odd"), ("output.findings.0.severity", None), ("output.findings.1.severity", None)], [("invalid_alert_severity", E)]),
    ([("input.evidence", [])], [("empty_evidence", E), *[("unknown_evidence_ref", E)] * 3]),
    ([("input.evidence.0.id", "E1")], [("invalid_evidence_id", E), *[("unknown_evidence_ref", E)] * 2]),
    ([("input.evidence.1.id", "EVT-001")], [("duplicate_evidence_id", E), *[("unknown_evidence_ref", E)] * 2]),
    ([("input.evidence.0.type", "magic")], [("invalid_evidence_type", E)]),
    ([("input.evidence.0.description", None)], [("missing_field", E)]),
    ([("output.classification", "maybe")], [("invalid_classification", E)]),
    ([("output.confidence", 1.5)], [("confidence_out_of_range", E)]),
    ([("output.findings", [])], [("empty_findings", E)]),
    ([("output.findings.1.evidence_refs", [])], [("empty_evidence_refs", E)]),
    ([("output.findings.1.evidence_refs", ["EVT-009"])], [("unknown_evidence_ref", E)]),
    ([("output.findings.0.description", None)], [("missing_field", E)]),
    ([("output.mitre_techniques.0.technique_id", "1110")], [("invalid_technique_id", E), ("technique_not_in_reference", W)]),
    ([("output.mitre_techniques.0.technique_id", "T9999")], [("technique_not_in_reference", W)]),
    ([("metadata.source", "field")], [("invalid_source", E)]),
    ([("metadata.review_status", "done")], [("invalid_review_status", E)]),
    ([("metadata.generator", None), ("metadata.borderline_category", "benign_vs_suspicious")], [("missing_field", E)]),
    ([("input.evidence.0.timestamp", "2024-01-01T11:00:00Z")], [("evidence_out_of_order", W)]),
    ([("output.classification", "confirmed_malicious"), ("output.confidence", 0.6)], [("low_confidence", W)]),
    ([("output.classification", "benign"), ("output.confidence", 0.5), ("input.alert.severity", "critical")], [("low_confidence", W), ("critical_but_benign", W)]),
    ([("output.classification", "benign"), ("metadata.quality_score", 60), ("metadata.split", "validation")], [("low_quality_score", W)]),
    ([("output.recommended_actions.0.priority", "soon"), ("output.mitre_techniques.0.tactic", "Other")], []),
    ([("output", None)], [("missing_field", E)]),
    ([], []),  # bears the id of the row before
]
K = len(VARIANTS)


def _variant(changes: list) -> dict:
    out = copy.deepcopy(BASE)
    for path, value in changes:
        *above, last = path.split(".")
        at = out
        for p in above:
            at = at[int(p)] if isinstance(at, list) else at[p]
        last = int(last) if isinstance(at, list) else last
        if value is None:
            del at[last]
        else:
            at[last] = value
    return out


def _texts(sort: bool) -> list[str]:
    return [json.dumps(_variant(c), sort_keys=sort, separators=(",", ":")) for c, _ in VARIANTS]


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    number = F.lpad((F.when(i % K == K - 1, i - 1).otherwise(i) % 1_000_000).cast("string"), 6, "0")
    return table(spark, sf, "events").select("event_id", (i % K).alias("k"), F.replace(pick(_texts(False), i), F.lit("{n}"), number).alias("raw"))


def _raw_sql(sort: bool = False) -> str:
    number = f"lpad(CAST((CASE WHEN event_id % {K} = {K - 1} THEN event_id - 1 ELSE event_id END) % 1000000 AS VARCHAR), 6, '0')"
    return f"raw AS (SELECT event_id, event_id % {K} AS k, replace({sql_pick(_texts(sort), 'event_id')}, '{{n}}', {number}) AS j FROM events)"


RAW = _raw_sql()
BROKEN = "broken AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', '{s}')" for k, (_, found) in enumerate(VARIANTS) for c, s in found) + ") t(k, code, severity))"
SEEN = f"""again AS (SELECT event_id FROM raw WHERE j->>'$.id' IN (SELECT j->>'$.id' FROM raw GROUP BY 1 HAVING count(*) > 1)),
  seen AS (SELECT event_id, code, severity FROM raw JOIN broken USING (k) UNION ALL SELECT event_id, 'duplicate_id', 'error' FROM again)"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return soc.parse(raw_records(spark, sf))


@query(f"WITH {RAW}, {BROKEN}, {SEEN} SELECT code, severity, count(*) AS n FROM seen GROUP BY 1, 2")
def soc_issues(spark, sf):
    return soc.summary(soc.validate(parsed(spark, sf)))


@query(f"""WITH {RAW}, {BROKEN}, {SEEN} SELECT r.event_id, count(code) FILTER (severity = 'error') = 0 AS valid, count(code) = 0 AS strictly_valid, count(code) AS n_issues FROM raw r LEFT JOIN seen USING (event_id) GROUP BY 1""")
def soc_validity(spark, sf):
    rows = parsed(spark, sf).withColumn("id2", F.col("id"))
    loose = soc.validate(rows).select("event_id", "valid", F.size("issues").cast("bigint").alias("n_issues"))
    return loose.join(soc.validate(rows, strict=True).select("event_id", F.col("valid").alias("strictly_valid")), "event_id")


@query(f"""WITH {RAW}, {BROKEN}, {SEEN} SELECT code, count(*) AS n FROM (SELECT CASE WHEN severity = 'warning' THEN '[strict] ' || code ELSE code END AS code FROM seen) GROUP BY 1""")
def soc_strict_issues(spark, sf):
    return soc.summary(soc.validate(parsed(spark, sf), strict=True)).select("code", "n")


_CHAT = f"""{RAW}, p AS (SELECT event_id, k, j, j->>'$.output.classification' AS cls, CAST(j->>'$.output.confidence' AS DOUBLE) AS conf, j->>'$.input.alert.severity' AS alert,
    from_json(coalesce(j->'$.output.findings', '[]'), '[{{"description": "VARCHAR", "evidence_refs": ["VARCHAR"], "severity": "VARCHAR"}}]') AS f,
    from_json(coalesce(j->'$.input.evidence', '[]'), '[{{"id": "VARCHAR", "type": "VARCHAR", "description": "VARCHAR", "timestamp": "VARCHAR", "raw_data": "JSON"}}]') AS e FROM raw),
  q AS (SELECT *, flatten(list_transform(f, lambda x: x.evidence_refs)) AS cited, list_transform(e, lambda x: x.id) AS ids,
    list_max(list_transform(f, lambda x: list_position({vocab.SEVERITIES}, x.severity))) AS top FROM p),
  a AS (SELECT *, coalesce(({vocab.SEVERITIES})[top], alert, 'medium') AS severity, NOT coalesce(cls = 'benign' AND coalesce(conf, 0.5) >= 0.75, FALSE) AS inv FROM q),
  r AS (SELECT *, CASE WHEN (j->'$.output') IS NULL THEN 'missing output' WHEN cls IS NULL OR cls NOT IN ({', '.join(repr(x) for x in vocab.SOC_CLASSIFICATIONS)}) THEN 'invalid classification'
    WHEN severity NOT IN ({', '.join(repr(x) for x in vocab.SEVERITIES)}) THEN 'invalid severity' WHEN conf NOT BETWEEN 0 AND 1 THEN 'invalid confidence'
    WHEN len(list_filter(cited, lambda x: NOT list_contains(ids, x))) > 0 THEN 'finding cites unknown evidence'
    WHEN j->>'$.output.recommended_actions[0].priority' NOT IN ({', '.join(repr(x) for x in vocab.ACTION_PRIORITIES)}) THEN 'invalid action priority' END AS reason FROM a)"""


@query(f"""WITH {_CHAT} SELECT event_id, reason, CASE WHEN reason IS NULL THEN severity END AS severity, CASE WHEN reason IS NULL THEN CAST(inv AS VARCHAR) END AS investigation_required,
  CASE WHEN reason IS NULL THEN array_to_string(list_sort(list_distinct(cited)), ',') END AS cited, CASE WHEN reason IS NULL THEN len(f) END AS n_findings, CASE WHEN reason IS NULL THEN 3 END AS n_messages FROM r""")
def soc_to_chat(spark, sf):
    out = soc.to_chat(parsed(spark, sf), "Judge the alert.")
    body = F.get(F.col("messages"), F.lit(2))["content"]
    got = lambda p: F.get_json_object(body, p)
    return out.select(
        "event_id", "reason", got("$.severity").alias("severity"), got("$.investigation_required").alias("investigation_required"),
        F.array_join(F.from_json(got("$.evidence_ids"), "array<string>"), ",").alias("cited"), F.json_array_length(got("$.findings")).cast("bigint").alias("n_findings"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"),
    )


@query(f"""WITH {_CHAT} SELECT j->>'$.metadata.split' AS split, count(*) AS source_count, count(*) FILTER (reason IS NULL) AS converted_count, count(reason) AS rejected_count FROM r WHERE j->>'$.metadata.split' <> 'test' GROUP BY 1""")
def soc_conversion_counts(spark, sf):
    return soc.conversion_counts(soc.to_chat(parsed(spark, sf), "Judge the alert."), "metadata.split")


_NA = lambda path: f"coalesce(j->>'$.input.{path}', 'N/A')"
_PROMPT = "|| chr(10) ||".join([
    "'Please analyze the following security alert and provide your triage decision in JSON format.'", "''", "'=== ALERT DETAILS ==='",
    *[f"'{n}: ' || {_NA('alert.' + f)}" for n, f in (("Title", "title"), ("Severity", "severity"), ("Source", "source"), ("Rule ID", "rule_id"), ("Rule Name", "rule_name"), ("Timestamp", "timestamp"))],
    "''", "'=== HOST & USER CONTEXT ==='",
    *[f"'{n}: ' || {_NA('context.' + f)}" for n, f in (("Hostname", "hostname"), ("Username", "username"), ("Department", "department"), ("OS", "os"), ("Environment", "environment"), ("Asset Criticality", "asset_criticality"), ("IP Address", "ip_address"))],
    "''", "'=== EVIDENCE ITEMS ==='",
])
_ITEMS = "array_to_string(list_transform(e, lambda x: '[' || coalesce(x.id, 'UNKNOWN') || '] Type: ' || coalesce(x.type, 'unknown') || ' | Time: ' || coalesce(x.timestamp, '') || ' | Description: ' || coalesce(x.description, '') || ' | Raw: ' || coalesce(CAST(x.raw_data AS VARCHAR), '{}') || chr(10)), '')"


@query(f"WITH {_CHAT} SELECT event_id, {_PROMPT} || chr(10) || {_ITEMS} AS question FROM p")
def soc_prompt_texts(spark, sf):
    """The question of every record down to its evidence; the fixed lines after it are cut off."""
    text = F.split_part(soc.user_prompt(), F.lit("\n=== REQUIRED OUTPUT"), F.lit(1))
    return parsed(spark, sf).select("event_id", text.alias("question"))


@query(f"""WITH {RAW}, n AS (SELECT (j->>'$.input.alert.title') || '||' || coalesce(j->>'$.input.evidence[0].description', '') AS near, CAST(j->'$.input' AS VARCHAR) AS exact FROM raw)
  SELECT 'exact' AS kind, count(*) AS n, count(*) - count(DISTINCT exact) AS n_repeats FROM n UNION ALL SELECT 'near', count(*), count(*) - count(DISTINCT near) FROM n""")
def soc_duplicates(spark, sf):
    return soc.duplicate_counts(parsed(spark, sf))


@query(f"WITH {_raw_sql(True)} SELECT event_id, upper(sha256(j)) AS record_hash FROM raw")
def soc_record_hash(spark, sf):
    return raw_records(spark, sf).select("event_id", soc.record_hash().alias("record_hash"))


@query(f"""WITH {RAW} SELECT count(*) AS n, count(*) FILTER (contains(j->>'$.input.context.os', 'Windows')) AS n_windows, count(*) FILTER (NOT contains(j->>'$.input.context.os', 'Windows')) AS n_linux, count(j->>'$.metadata.borderline_category') AS n_borderline,
  {', '.join(f"count(*) FILTER (j->>'$.metadata.split' = '{s}') AS n_{s}" for s in ('train', 'validation', 'test'))} FROM raw""")
def soc_shares(spark, sf):
    return soc.shares(parsed(spark, sf))


@query("""SELECT 't1' AS template_id, * FROM (VALUES ('1110', 'unknown technique'), ('T9999', 'unknown technique'), ('T1110.001', 'other tactic')) t(technique_id, problem)""")
def soc_template_checks(spark, sf):
    from ..operators.retrieval import techniques

    return soc.template_checks(parsed(spark, sf), techniques(spark))


@query(f"""WITH {RAW} SELECT j->>'$.output.classification' AS classification, count(*) AS n FROM raw WHERE k IN (0, 1, 24, 25, 26, 27) GROUP BY 1""")
def soc_held_out(spark, sf):
    """The strict loader over the variants that keep its rules, with the number of records it must find.

    raw_records numbers its records up to a million and begins again; the loader takes no id twice, so here the number is
    the event's, whole.
    """
    rows = raw_records(spark, sf).filter("k in (0, 1, 24, 25, 26, 27)")
    whole = F.concat(F.lit('"id":"SOC-'), F.lpad(F.col("event_id").cast("string"), F.greatest(F.length(F.col("event_id").cast("string")), F.lit(6)), F.lit("0")), F.lit('"'))
    rows = rows.withColumn("raw", F.regexp_replace(F.col("raw"), F.lit('"id":"SOC-[0-9]{6}"'), whole))
    return soc.load_held_out(rows, expected=rows.count()).groupBy(F.col("output.classification").alias("classification")).agg(F.count("*").alias("n"))


@query(f"""WITH {RAW} SELECT event_id, j->>'$.id' AS record_id, CASE WHEN j->>'$.output.classification' IN ({', '.join(repr(x) for x in vocab.CLASSIFICATIONS)}) THEN j->>'$.output.classification' END AS classification,
  coalesce(CAST(j->>'$.output.confidence' AS DOUBLE), 1.0) AS confidence, j->>'$.input.context.hostname' AS hostname, j->>'$.input.alert.timestamp' AS timestamp, j->>'$.task' AS task FROM raw""")
def soc_adapter(spark, sf):
    """Records of nested triage records; every third one bears its input and output as JSON text."""
    text = lambda p: F.get_json_object("raw", p)
    nested = F.to_json(F.struct(text("$.id").alias("id"), text("$.task").alias("task"), text("$.input").alias("input"), text("$.output").alias("output"), text("$.metadata").alias("metadata")))
    rows = raw_records(spark, sf).withColumn("record_index", F.col("event_id")).withColumn("raw", F.when(F.col("event_id") % 3 == 0, nested).otherwise(F.col("raw")))
    return connectors.soc(rows).select(F.col("record_index").alias("event_id"), "record_id", "classification", "confidence", "hostname", "timestamp", F.col("enrichment_tags")["soc_task"].alias("task"))


@query(f"WITH {RAW}, {BROKEN}, {SEEN} SELECT CASE WHEN e.event_id IS NOT NULL OR coalesce(CAST(j->>'$.metadata.quality_score' AS INT), 100) < 70 THEN 'rejected' ELSE 'validated' END AS outcome, count(*) AS n FROM raw r LEFT JOIN (SELECT DISTINCT event_id FROM seen WHERE severity = 'error') e USING (event_id) GROUP BY 1")
def soc_validated_sink(spark, sf):
    """Validated and rejected records written as JSON lines into their folders and counted from there."""
    path = scratch_path(spark, "validated")
    rows = soc.validate(parsed(spark, sf)).select("event_id", "issues", F.col("metadata.quality_score").alias("quality_score"))
    sinks.write_valid(rows, path)
    return spark.read.schema("event_id bigint, outcome string").json(path).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {RAW} SELECT event_id FROM raw WHERE event_id % 4 <> 0")
def firewall_json_lines(spark, sf):
    """Rows whose JSON line is not among the protected lines, which bear their keys in another order and with blanks."""
    rows = raw_records(spark, sf).withColumn("raw", F.concat(F.lit('{"e":'), F.col("event_id").cast("string"), F.lit(',"r":'), "raw", F.lit("}")))
    held = rows.filter("event_id % 4 = 0").select(F.concat(F.lit('{ "r" : '), F.get_json_object("raw", "$.r"), F.lit(' , "e":'), F.col("event_id").cast("string"), F.lit("}")).alias("raw"))
    return training.without_protected(rows.withColumn("line", sorted_json(F.col("raw"))), held.withColumn("line", sorted_json(F.col("raw"))), ["line"]).select("event_id")



# Records made of documents, in which the row's own values decide which fields have the wrong type: the same text in both
# engines, so the SQL judges the types by reading the JSON itself.
def _typed_record(text: str) -> str:
    """SQL for a record's JSON of a row of documents; text: SQL for the text as a JSON string."""
    whole = "concat('{\"id\": \"EVT-', lpad(cast(doc_id % 900 as STRING), 3, '0'), '\", \"type\": \"authentication\", \"description\": ', " + text + ", '}')"
    src = "concat('\"', coalesce(source, ''), '\"')"
    pick = lambda expr, of, other: f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in of.items()) + f" ELSE {other} END"
    ident = pick("lang", {"'en'": "concat('\"SOC-', lpad(cast(doc_id % 1000000 as STRING), 6, '0'), '\"')", "'fr'": "'null'"}, "cast(doc_id as STRING)")
    evidence = pick("n_chars % 7", {0: src, 1: f"concat('[', {text}, ', 3, null, ', {whole}, ']')", 2: "'{}'"}, f"concat('[', {whole}, ']')")
    alert = pick("n_chars % 5", {0: src}, f"concat('{{\"title\": ', {text}, ', \"severity\": \"low\", \"source\": ', {src}, '}}')")
    context = pick("n_chars % 6", {0: "'17'"}, "'{}'")
    inner = pick("n_chars % 11", {0: text, 1: "'[1]'"}, f"concat('{{\"alert\": ', {alert}, ', \"context\": ', {context}, ', \"evidence\": ', {evidence}, '}}')")
    sure = pick("n_chars % 8", {0: text, 1: "'true'", 2: "'[]'", 3: "'1'"}, "'0.75'")
    finding = "concat('{\"description\": ', " + text + ", ', \"evidence_refs\": [\"EVT-', lpad(cast(doc_id % 900 as STRING), 3, '0'), '\"]}')"
    findings = pick("n_chars % 9", {0: "'7'", 1: f"concat('[', {finding}, ', ', {text}, ']')"}, f"concat('[', {finding}, ']')")
    output = pick("n_chars % 13", {0: "'[]'", 1: "'0'"}, f"concat('{{\"classification\": \"suspicious\", \"confidence\": ', {sure}, ', \"findings\": ', {findings}, '}}')")
    meta = pick("n_chars % 10", {0: src}, "'{\"source\": \"synthetic\", \"generator\": \"g\", \"review_status\": \"pending\", \"dataset_version\": \"1\"}'")
    return f"concat('{{\"id\": ', {ident}, ', \"task\": \"alert_triage\", \"input\": ', {inner}, ', \"output\": ', {output}, ', \"metadata\": ', {meta}, '}}')"


_KINDS = {"id": "VARCHAR", "input": "OBJECT", "input.alert": "OBJECT", "input.context": "OBJECT", "input.evidence": "ARRAY", "output": "OBJECT", "output.confidence": "number", "output.findings": "ARRAY", "metadata": "OBJECT"}
_KIND = "CASE json_type(j, '$.{p}') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'number' ELSE json_type(j, '$.{p}') END"


@query(f"""WITH r AS (SELECT doc_id, CAST({_typed_record("CAST(to_json(coalesce(text, '')) AS VARCHAR)")} AS JSON) AS j FROM documents),
  w AS (SELECT doc_id, j, [x for x in [{', '.join(f"CASE WHEN ({_KIND.format(p=p)}) NOT IN ('{k if p != 'output.confidence' else 'number'}', 'NULL') AND ('{p}' <> 'id' OR json_type(j, '$.id') <> 'VARCHAR') THEN '{p}' END" for p, k in _KINDS.items())}] if x IS NOT NULL] AS fields,
    CASE WHEN json_type(j, '$.input.evidence') = 'ARRAY' THEN [i for i in range(0, CAST(json_array_length(j, '$.input.evidence') AS BIGINT)) if json_type(j, '$.input.evidence[' || i || ']') <> 'OBJECT'] ELSE [] END AS e,
    CASE WHEN json_type(j, '$.output.findings') = 'ARRAY' THEN [i for i in range(0, CAST(json_array_length(j, '$.output.findings') AS BIGINT)) if json_type(j, '$.output.findings[' || i || ']') <> 'OBJECT'] ELSE [] END AS f FROM r)
  SELECT doc_id, array_to_string(list_concat(fields, list_transform(e, lambda i: 'input.evidence[' || i || ']'), list_transform(f, lambda i: 'output.findings[' || i || ']')), ',') AS wrong,
    CASE WHEN list_contains(fields, 'output') OR list_contains(fields, 'output.confidence') THEN NULL WHEN json_type(j, '$.output.confidence') = 'BOOLEAN' THEN 1.0 ELSE CAST(j->>'$.output.confidence' AS DOUBLE) END AS confidence,
    CASE WHEN json_type(j, '$.input.evidence') = 'ARRAY' THEN json_array_length(j, '$.input.evidence') END AS n_evidence FROM w""")
def soc_wrong_types(spark, sf):
    """Where documents' records have values of the wrong type, and what their neighbours still hold."""
    text = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    rows = table(spark, sf, "documents").withColumn("_t", text).select("doc_id", F.expr(_typed_record("_t")).alias("raw"))
    out = soc.validate(soc.parse(rows))
    found = F.transform(F.filter("issues", lambda i: i["code"] == "wrong_type"), lambda i: i["at"])
    return out.select("doc_id", F.array_join(found, ",").alias("wrong"), F.col("output.confidence").alias("confidence"), F.when(F.col("input.evidence").isNotNull(), F.size("input.evidence").cast("bigint")).alias("n_evidence"))
