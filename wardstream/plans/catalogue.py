"""Queries over the driver's tables, one for each operator or group of operators, with the SQL that gives the same rows.

Roles of the tables: events are flow records and canonical events, documents joined with labels are classified
records, benchmark is the protected set, conversations are chat examples, pages are hostile text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import evaluate, events, quality, records, retrieval, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_case(expr: str, pairs: dict[str, str], other: str = "NULL") -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


def pick(pool: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (index % len(pool)).cast("int") + 1)


def sql_pick(pool: list[str], index: str) -> str:
    return "([" + ", ".join("'" + p.replace("'", "''") + "'" for p in pool) + f"])[CAST({index} % {len(pool)} AS INT) + 1]"


# Flow records made from events: the same rule in both languages.
LABELS = ["BENIGN", "ddos", "DoS Hulk", "portscan", "FTP-Patator", "Web Attack", "Zeta", "Bot", "infiltration"]
SOURCES = ["cicids_2017", "unsw_nb15", "ctu_13", "ember"]


def flows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        F.format_string("flow-%08d", i).alias("record_id"), pick(SOURCES, i).alias("source"), i.alias("record_index"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("192.168.001."), (F.col("user_id") % 300).cast("string")).alias("src_ip"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("dst_ip"),
        ((F.col("user_id") * 37) % 70000).cast("string").alias("src_port"), F.lit("443").alias("dst_port"), pick(["TCP", "6", "17", " udp ", "gre"], i).alias("protocol"),
        F.when(i % 50 == 7, "-5").otherwise((i % 3).cast("string")).alias("bytes_sent"),
        F.when(i % 11 == 3, F.lit(None)).otherwise(pick(LABELS, F.col("user_id"))).alias("source_label"), F.when(i % 13 == 0, "").otherwise(F.lit(None)).alias("hostname"),
    )


FLOWS = f"""flows AS (SELECT 'flow-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS record_id, {sql_pick(SOURCES, 'event_id')} AS source, event_id AS record_index,
  strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp,
  CASE WHEN user_id % 300 <= 255 THEN '192.168.1.' || CAST(user_id % 300 AS VARCHAR) END AS src_ip, '10.0.0.' || CAST(user_id % 7 AS VARCHAR) AS dst_ip,
  CASE WHEN (user_id * 37) % 70000 <= 65535 THEN CAST((user_id * 37) % 70000 AS INT) END AS src_port, 443 AS dst_port,
  {sql_pick(['tcp', 'tcp', 'udp', 'udp', 'gre'], 'event_id')} AS protocol,
  CASE WHEN event_id % 50 = 7 THEN -5 ELSE event_id % 3 END AS bytes_sent,
  CASE WHEN event_id % 11 = 3 THEN NULL ELSE {sql_pick(LABELS, 'user_id')} END AS source_label FROM events)"""
VALID = "bytes_sent >= 0"
KEY = "src_ip, dst_ip, src_port, dst_port, protocol, timestamp, source_label, bytes_sent"
NEAR = "src_ip, dst_ip, src_port, dst_port, protocol, source_label"
MAPS = "maps AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (s, *r)) + f", {n})" for n, (s, r) in enumerate((s, r) for s, m in vocab.LABEL_MAPS.items() for r in m)) + ") t(source, label, classification, attack_category, ord))"
RESOLVED = f"""{MAPS}, best AS (SELECT s.source, s.source_label, min(struct_pack(level := CASE WHEN s.source_label = m.label THEN 0 WHEN lower(s.source_label) = lower(m.label) THEN 1 ELSE 2 END, ord := m.ord, c := m.classification, a := m.attack_category, l := m.label)) AS b
  FROM (SELECT DISTINCT source, source_label FROM flows WHERE source_label IS NOT NULL) s JOIN maps m ON s.source = m.source AND (contains(lower(s.source_label), lower(m.label)) OR contains(lower(m.label), lower(s.source_label))) GROUP BY 1, 2)"""
OUTCOME = f"""{FLOWS}, {RESOLVED},
ranked AS (SELECT *, CASE WHEN NOT ({VALID}) THEN 0 ELSE row_number() OVER (PARTITION BY {KEY}, ({VALID}) ORDER BY record_index, record_id) END AS r FROM flows),
outcome AS (SELECT f.*, b, CASE WHEN r = 0 THEN 'rejected' WHEN r > 1 THEN 'duplicate' WHEN f.source_label IS NULL THEN 'harmonized' WHEN b IS NULL OR b.level = 2 THEN 'review_required' ELSE 'harmonized' END AS status
  FROM ranked f LEFT JOIN best ON f.source = best.source AND f.source_label = best.source_label)"""

# Classified records: documents with labels, and a predictor that errs by a fixed rule.
CLASSES = ["benign", "suspicious", "confirmed_malicious", "insufficient_evidence"]


def judged(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    j = d.join(table(spark, sf, "labels"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "confirmed_malicious").when(F.col("quality") == 1, "benign").otherwise("suspicious")
    k = F.col("doc_id") % 7
    pred = F.when(k == 0, "benign").when(k == 1, "suspicious").when(k == 2, "insufficient_evidence").otherwise(F.col("truth"))
    return j.withColumn("truth", truth).withColumn("pred", pred)


JUDGED = """judged AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'benign' WHEN doc_id % 7 = 1 THEN 'suspicious' WHEN doc_id % 7 = 2 THEN 'insufficient_evidence' ELSE truth END AS pred
  FROM (SELECT d.doc_id, text, lang, source, n_chars, CASE WHEN toxic = 1 THEN 'confirmed_malicious' WHEN quality = 1 THEN 'benign' ELSE 'suspicious' END AS truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""
LABEL_LIST = "(SELECT unnest(['" + "', '".join(CLASSES) + "']) AS label)"
R4 = lambda x: f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def scan_limit_ordered(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value").orderBy("event_id").limit(1000)


def raw_events(spark, sf):
    e = table(spark, sf, "events")
    raw = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("EventTime"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("User-Name"), F.col("event_type").alias("Action"),
        F.concat(F.lit("10.1."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 300).cast("string")).alias("Src_IP"), F.from_json("props", "k bigint").alias("props"),
    ))
    return e.select(F.format_string("events-%06d", "event_id").alias("event_id"), F.lit("events").alias("source_name"), F.lit("jsonl").alias("source_format"), F.col("event_id").alias("record_index"), raw.alias("raw"))


@query("""SELECT 'events-' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(6, length(CAST(event_id AS VARCHAR))) AS INT), '0') AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'user_' || user_id AS username,
  CASE WHEN event_id % 300 <= 255 THEN '10.1.' || (user_id % 256) || '.' || (event_id % 300) END AS source_ip, 'network_connection' AS event_type,
  CASE WHEN event_id % 300 > 255 THEN '10.1.' || (user_id % 256) || '.' || (event_id % 300) END AS invalid_ip, json_extract_string(props, '$.k') AS k FROM events""")  # fmt: skip
def canonicalize_events(spark, sf):
    out = events.canonicalize(raw_events(spark, sf))
    return out.select("event_id", "timestamp", "username", "source_ip", "event_type", F.col("attributes")["_invalid_source_ip"].alias("invalid_ip"), F.col("attributes")["props.k"].alias("k"))


@query("""SELECT CASE WHEN event_id % 300 > 255 THEN 'rejected' ELSE 'trusted' END AS status, CASE WHEN event_id % 300 > 255 THEN 'invalid' ELSE 'valid' END AS validation_status, count(*) AS n FROM events GROUP BY 1, 2""")
def process_events(spark, sf):
    return events.process(raw_events(spark, sf)).groupBy("status", "validation_status").agg(F.count("*").alias("n"))


_SAYS = lambda words: "(" + " OR ".join(f"contains(w, '{x}')" for x in words) + ")"


@query(f"""SELECT t AS event_type, count(*) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'process_creation' WHEN doc_id % 17 = 1 THEN 'network_connection' WHEN doc_id % 17 = 2 THEN 'dns_query'
  WHEN {_SAYS(vocab.AUTH_TOKENS)} THEN 'authentication' WHEN {_SAYS(vocab.REGISTRY_TOKENS)} THEN 'registry_modification' WHEN {_SAYS(vocab.FILE_TOKENS)} THEN 'file_modification'
  WHEN {_SAYS(vocab.WEB_TOKENS)} THEN 'web_request' ELSE 'generic' END AS t FROM (SELECT doc_id, lower(text) AS w FROM documents)) GROUP BY t""")
def event_type_inference(spark, sf):
    d = table(spark, sf, "documents")
    k, none = F.col("doc_id") % 17, F.lit(None).cast("string")
    mapped = {f: none for f in vocab.FIELD_ALIASES} | {"command_line": F.when(k == 0, "x"), "source_ip": F.when(k == 1, "10.0.0.1"), "domain": F.when(k == 2, "d"), "status": F.col("text")}
    return d.select(events.event_type(mapped).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id, strftime(CASE WHEN event_id % 8 = 3 AND day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE))
  WHEN event_id % 8 = 6 THEN date_trunc('minute', ts) WHEN event_id % 8 = 7 THEN date_trunc('day', ts) ELSE ts END, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS record_ts,
  CASE WHEN event_id % 8 = 7 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN event_id % 8 IN (2, 6) AND (event_id % 8 = 6 OR day(ts) > 12) THEN NULL
  WHEN event_id % 8 = 2 THEN strftime(make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS event_ts FROM events""")
def normalize_timestamp_formats(spark, sf):
    e = table(spark, sf, "events")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", None, "dd/MM/yyyy HH:mm", "yyyy-MM-dd"]
    text = F.coalesce(*[F.when(F.col("event_id") % 8 == i, F.date_format("ts", f) if f else F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")) for i, f in enumerate(forms)])
    return e.select("event_id", S.record_timestamp(text).alias("record_ts"), S.event_timestamp(text).alias("event_ts"))


SEVERITY_WORDS = [*vocab.RECORD_SEVERITY, *[w for w in vocab.EVENT_SEVERITY if w not in vocab.RECORD_SEVERITY], "odd"]


@query(f"""SELECT event_id, {sql_case('w', vocab.RECORD_SEVERITY)} AS record_severity, {sql_case('w', vocab.EVENT_SEVERITY)} AS event_severity FROM (SELECT event_id, {sql_pick(SEVERITY_WORDS, 'event_id')} AS w FROM events)""")
def normalize_severity_map(spark, sf):
    w = F.concat(F.lit(" "), F.upper(pick(SEVERITY_WORDS, F.col("event_id"))), F.lit("\t"))
    return table(spark, sf, "events").select("event_id", S.record_severity(w).alias("record_severity"), S.event_severity(w).alias("event_severity"))


PROTOCOLS = ["TCP", " udp", "6", "17", "1", "0", "HTTP ", "gre"]


@query(f"""SELECT o_orderkey, {sql_case('p', vocab.PROTOCOL_NUMBERS, 'p')} AS record_protocol, p AS event_protocol FROM (SELECT o_orderkey, lower(trim({sql_pick(PROTOCOLS, 'o_orderkey')})) AS p FROM orders)""")
def normalize_protocol_map(spark, sf):
    p = pick(PROTOCOLS, F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", S.record_protocol(p).alias("record_protocol"), S.event_lower(p).alias("event_protocol"))


_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"


@query(rf"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '^{_WHITE}|{_WHITE}$', '', 'g'), '{_WHITE}', ' ', 'g'), '') AS t FROM documents)""")
def normalize_whitespace_text(spark, sf):
    t = S.collapse(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 400 <= 255 THEN '10.0.' || (user_id % 200) || '.' || (event_id % 400) END AS record_ip,
  CASE WHEN event_id % 5 <> 4 AND event_id % 400 BETWEEN 100 AND 255 AND user_id % 200 >= 100 THEN '10.0.' || (user_id % 200) || '.' || (event_id % 400) END AS event_ip,
  CASE WHEN event_id * 31 % 90000 <= 65535 THEN CAST(event_id * 31 % 90000 AS INT) END AS port FROM events""")
def ip_port_normalize(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    ip = F.when(i % 5 == 4, "N/A").otherwise(F.concat(F.lit(" 10.0."), F.lpad((u % 200).cast("string"), 3, "0"), F.lit("."), F.lpad((i % 400).cast("string"), 3, "0"), F.lit(" ")))
    return table(spark, sf, "events").select("event_id", S.record_ip(ip, False).alias("record_ip"), S.event_ip(ip, False).alias("event_ip"), S.record_port(F.concat((i * 31 % 90000).cast("string"), F.lit(".0"))).alias("port"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(t) WHEN 1 THEN sha1(t) WHEN 2 THEN sha256(t) END AS record_hash, CASE doc_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' END AS algorithm FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t FROM documents)""")
def hash_normalize_algo(spark, sf):
    t, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    h = F.upper(F.when(k == 0, F.md5(t)).when(k == 1, F.sha1(t)).when(k == 2, F.sha2(t, 256)).otherwise("abc123"))
    return table(spark, sf, "documents").select("doc_id", S.record_hash(h).alias("record_hash"), S.hash_algorithm(h).alias("algorithm"))


@query(f"""WITH {FLOWS} SELECT code, severity, count(*) AS n FROM (SELECT 'invalid_numeric' AS code, 'error' AS severity FROM flows WHERE NOT ({VALID})
  UNION ALL SELECT 'missing_source_label', 'warning' FROM flows WHERE source_label IS NULL) GROUP BY 1, 2""")
def validate_issues_exploded(spark, sf):
    out = records.validate(records.normalize(records.as_records(flows(spark, sf)), False))
    return out.select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN l_linenumber > 5 OR l_discount > 0.09 THEN 'rejected' ELSE 'validated' END AS status, count(*) AS n FROM lineitem GROUP BY 1""")
def validation_status_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), F.lit("lineitem").alias("source"), F.lit("10.0.0.1").alias("src_ip"), F.when(F.col("l_linenumber") > 5, "-1").otherwise("1").alias("packets_sent"), F.when(F.col("l_discount") > 0.09, 1.5).otherwise(F.col("l_discount")).alias("confidence"))
    return records.validate(records.normalize(records.as_records(rows), False)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {FLOWS}, g AS (SELECT {KEY}, count(*) AS c FROM flows GROUP BY ALL) SELECT count(*) AS n_groups, CAST(sum(c - 1) AS BIGINT) AS n_repeats, max(c) AS largest FROM g""")
def fingerprint_exact(spark, sf):
    d = records.normalize(records.as_records(flows(spark, sf)), False).select(records.fingerprint(vocab.EXACT_FIELDS).alias("fp"))
    return d.groupBy("fp").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_groups"), F.sum(F.col("c") - 1).alias("n_repeats"), F.max("c").alias("largest"))


@query(f"""WITH {FLOWS}, g AS (SELECT {NEAR}, count(*) AS c FROM flows GROUP BY ALL) SELECT count(*) AS n_groups, CAST(sum(c - 1) AS BIGINT) AS n_repeats, max(c) AS largest FROM g""")
def fingerprint_near(spark, sf):
    d = records.normalize(records.as_records(flows(spark, sf)), False).select(records.fingerprint(vocab.NEAR_FIELDS).alias("fp"))
    return d.groupBy("fp").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_groups"), F.sum(F.col("c") - 1).alias("n_repeats"), F.max("c").alias("largest"))


@query("""SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS f FROM documents)""")
def dedup_exact_first(spark, sf):
    return records.deduplicate(table(spark, sf, "documents"), ["text", "lang"], "doc_id", "doc_id").select("doc_id", "duplicate_of")


@query(f"""WITH {FLOWS} SELECT record_id, CASE WHEN r > 1 THEN f END AS duplicate_of FROM (SELECT record_id, first_value(record_id) OVER w AS f, row_number() OVER w AS r FROM flows WINDOW w AS (PARTITION BY {NEAR} ORDER BY record_index))""")
def dedup_near_first(spark, sf):
    return records.deduplicate(records.normalize(records.as_records(flows(spark, sf)), False), vocab.NEAR_FIELDS).select("record_id", "duplicate_of")


@query("""SELECT count(*) AS n, count(DISTINCT struct_pack(t := text, l := lang)) AS n_unique, count(*) - count(DISTINCT struct_pack(t := text, l := lang)) AS n_duplicates FROM documents""")
def dedup_stats(spark, sf):
    d = records.deduplicate(table(spark, sf, "documents"), ["text", "lang"], "doc_id", "doc_id")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("duplicate_of").isNull()).alias("n_unique"), F.count("duplicate_of").alias("n_duplicates"))


@query(f"""WITH {FLOWS}, {RESOLVED} SELECT record_id, CASE WHEN b.level < 2 THEN b.c END AS classification, CASE WHEN b.level < 2 THEN b.a END AS attack_category FROM flows LEFT JOIN best USING (source, source_label) WHERE flows.source_label IS NOT NULL""")
def label_harmonize_exact_ci(spark, sf):
    f = flows(spark, sf).filter("source_label is not null")
    found = records.resolve_labels(f.select("source", "source_label").distinct(), records.label_map(spark))
    sure = F.col("match_kind") == "mapped"
    return f.join(found, ["source", "source_label"]).select("record_id", F.when(sure, F.col("_class")).alias("classification"), F.when(sure, F.col("_category")).alias("attack_category"))


@query(f"""WITH {FLOWS}, {RESOLVED} SELECT s.source, s.source_label, CASE WHEN b IS NULL THEN 'unknown' WHEN b.level < 2 THEN 'mapped' ELSE 'ambiguous' END AS match_kind, b.l AS matched FROM (SELECT DISTINCT source, source_label FROM flows WHERE source_label IS NOT NULL) s LEFT JOIN best USING (source, source_label)""")
def label_harmonize_partial(spark, sf):
    found = records.resolve_labels(flows(spark, sf).filter("source_label is not null").select("source", "source_label").distinct(), records.label_map(spark))
    return found.select("source", "source_label", "match_kind", F.col("_label").alias("matched"))


@query(f"""SELECT event_id, {sql_case('c', vocab.CATEGORY_TECHNIQUE)} AS technique, coalesce({sql_case('c', vocab.CATEGORY_SEVERITY)}, 'medium') AS severity, {sql_case('c', vocab.CATEGORY_PHASE)} AS phase,
  CASE WHEN {sql_case('c', vocab.CATEGORY_TECHNIQUE)} IS NOT NULL THEN coalesce({sql_case(sql_case('c', vocab.CATEGORY_TECHNIQUE), {t: n for t, n, _ in vocab.TECHNIQUES})}, '') END AS technique_name
  FROM (SELECT event_id, {sql_pick(vocab.ATTACK_CATEGORIES, 'event_id')} AS c FROM events)""")
def enrich_category_dims(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id"), pick(vocab.ATTACK_CATEGORIES, F.col("event_id")).alias("attack_category"), F.lit("validated").alias("status"))
    out = records.enrich(records.as_records(e))
    return out.select("event_id", F.col("mitre_technique_id").alias("technique"), "severity", F.col("enrichment_tags")["kill_chain_phase"].alias("phase"), F.col("mitre_technique_name").alias("technique_name"))


@query(f"""WITH {OUTCOME} SELECT count(*) AS input_records, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status NOT IN ('rejected', 'duplicate')) AS output_records,
  count(*) FILTER (NOT ({VALID})) AS errors, count(*) FILTER (source_label IS NULL) AS warnings, count(*) FILTER (status NOT IN ('rejected', 'duplicate')) AS enriched,
  count(*) FILTER (status = 'harmonized') AS harmonized, count(*) FILTER (status = 'review_required') AS review_required FROM outcome""")
def pipeline_report(spark, sf):
    return records.pipeline_report(records.run_pipeline(flows(spark, sf), records.label_map(spark)))


@query(f"""WITH {OUTCOME} SELECT record_id, status, CASE WHEN status IN ('rejected', 'duplicate') THEN NULL WHEN source_label IS NULL THEN 'insufficient_evidence' WHEN status = 'review_required' THEN 'review_required' ELSE b.c END AS classification FROM outcome""")
def pipeline_outcomes(spark, sf):
    return records.run_pipeline(flows(spark, sf), records.label_map(spark)).select("record_id", "status", "classification")


CLASS_ROWS = "c AS (SELECT CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'malicious' WHEN quality = 1 THEN 'benign' ELSE 'suspicious' END AS classification, d.text, d.lang, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def classed(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.withColumn("classification", F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 1, "benign").when(F.col("quality").isNotNull(), "suspicious"))


H = "h AS (SELECT coalesce(classification, 'unlabeled') AS classification, count(*) AS n FROM c GROUP BY 1)"


@query(f"WITH {CLASS_ROWS}, {H} SELECT * FROM h")
def quality_class_distribution(spark, sf):
    return quality.class_histogram(classed(spark, sf))


BALANCE = f"bal AS (SELECT count(*) AS n_classes, {R4('-sum(n / t * log2(n / t)) / log2(CAST(count(*) AS DOUBLE))')} AS balance FROM h, (SELECT sum(n) AS t FROM h))"


@query(f"WITH {CLASS_ROWS}, {H}, {BALANCE} SELECT * FROM bal")
def quality_balance_score(spark, sf):
    return quality.balance_score(classed(spark, sf))


_COMPLETE = ["timestamp", "src_ip", "dst_ip", "src_port", "protocol", "source_label"]


@query(f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, {R4(f'count({c}) / count(*)')} AS completeness FROM flows" for c in _COMPLETE))
def quality_completeness(spark, sf):
    return quality.completeness(records.normalize(records.as_records(flows(spark, sf)), False), _COMPLETE)


@query(f"""WITH {CLASS_ROWS}, {H}, {BALANCE}, b AS (SELECT count(*) AS n, avg(CASE WHEN length(text) >= 100 THEN 1.0 ELSE 0.0 END) AS v, avg(CASE WHEN classification IS NOT NULL THEN 1.0 ELSE 0.0 END) AS lc,
  ({R4('count(classification) / count(*)')} + {R4('count(source) / count(*)')}) / 2 AS comp, count(*) - count(DISTINCT text) AS d FROM c)
  SELECT n, balance, {R4('comp')} AS completeness, d AS duplicates, {R4('v')} AS validity, {R4('lc')} AS label_coverage, {R4('v * 0.30 + balance * 0.20 + comp * 0.25 + (1.0 - d / n) * 0.15 + lc * 0.10')} AS score FROM b, bal""")
def quality_overall(spark, sf):
    return quality.overall(classed(spark, sf).withColumn("fp", F.sha2("text", 256)), "classification", ["classification", "source"], "fp", F.length("text") >= 100)


@query("SELECT lang, source, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def ingestion_summary_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"))


@query(f"WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (truth = pred) AS n_correct, {R4('count(*) FILTER (truth = pred) / count(*)')} AS accuracy FROM judged")
def accuracy_overall(spark, sf):
    return evaluate.accuracy(judged(spark, sf), "truth", "pred")


@query(f"WITH {JUDGED} SELECT a.label AS actual, b.label AS predicted, count(doc_id) AS n FROM {LABEL_LIST} a CROSS JOIN {LABEL_LIST} b LEFT JOIN judged ON truth = a.label AND pred = b.label GROUP BY 1, 2")
def confusion_long(spark, sf):
    return evaluate.confusion(judged(spark, sf), "truth", "pred", CLASSES)


@query(f"WITH {JUDGED} SELECT truth AS actual, " + ", ".join(f"count(*) FILTER (pred = '{c}') AS {c}" for c in CLASSES) + " FROM judged GROUP BY 1")
def confusion_pivot(spark, sf):
    return evaluate.confusion_pivot(judged(spark, sf), "truth", "pred", CLASSES)


PRF = f"""prf AS (SELECT label, tp + fn AS support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (SELECT label, tp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
  FROM (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn FROM judged, {LABEL_LIST} GROUP BY label))),
  rnd AS (SELECT label, support, {R4('p')} AS precision, {R4('r')} AS recall, {R4('f')} AS f1 FROM prf)"""


@query(f"WITH {JUDGED}, {PRF} SELECT * FROM rnd")
def per_class_prf(spark, sf):
    return evaluate.per_class(judged(spark, sf), "truth", "pred", CLASSES)


@query(f"WITH {JUDGED}, {PRF} SELECT {R4('avg(precision)')} AS macro_precision, {R4('avg(recall)')} AS macro_recall, {R4('avg(f1)')} AS macro_f1 FROM rnd")
def macro_prf(spark, sf):
    return evaluate.macro(judged(spark, sf), "truth", "pred", CLASSES)


@query(f"WITH {JUDGED}, {PRF} SELECT {R4('avg(precision)')} AS macro_precision, {R4('avg(recall)')} AS macro_recall, {R4('avg(f1)')} AS macro_f1 FROM rnd WHERE support > 0")
def macro_prf_supported(spark, sf):
    return evaluate.macro(judged(spark, sf), "truth", "pred", CLASSES, skip_empty=True)


@query("""SELECT count(*) AS n, floor(avg(value) * 100.0 + 0.5) / 100.0 AS mean, floor(median(value) * 100.0 + 0.5) / 100.0 AS median, floor(max(value) FILTER (r = least(CAST(floor(0.95 * t) AS BIGINT) + 1, t)) * 100.0 + 0.5) / 100.0 AS p95,
  floor(min(value) * 100.0 + 0.5) / 100.0 AS min, floor(max(value) * 100.0 + 0.5) / 100.0 AS max FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS t FROM events WHERE value IS NOT NULL)""")
def latency_stats(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "value")


def findings(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("refs"), F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 5, F.col("l_linenumber")))).alias("valid"))


@query(f"""WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 5), g AS (SELECT l.l_orderkey, count(*) AS c, count(*) FILTER (v.l_orderkey IS NULL) AS w FROM lineitem l LEFT JOIN v ON l.l_orderkey = v.l_orderkey AND l.l_linenumber = v.l_linenumber GROUP BY 1)
  SELECT count(*) AS n, count(*) FILTER (w = 0) AS n_grounded, CAST(sum(w) AS BIGINT) AS n_hallucinated, {R4('count(*) FILTER (w = 0) / count(*)')} AS grounding, {R4('sum(w) / count(*)')} AS hallucination FROM g""")
def grounding_stats(spark, sf):
    return evaluate.grounding(findings(spark, sf), "refs", "valid")


@query(f"""WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ret, list(l_linenumber) FILTER (l_quantity > 30) AS want FROM lineitem GROUP BY 1)
  SELECT count(*) AS n, {', '.join(R4(f'avg(CASE WHEN len(list_intersect(ret[1:{k}], want)) > 0 THEN 1.0 ELSE 0.0 END)') + f' AS hit_at_{k}' for k in (1, 3, 5))} FROM g WHERE len(want) > 0""")
def hit_at_k(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ret"), F.collect_list(F.when(F.col("l_quantity") > 30, F.col("l_linenumber"))).alias("want"))
    return evaluate.hit_at_k(g, "ret", "want")


@query("""WITH p AS (SELECT quality AS t, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS a, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 0 ELSE quality END AS b FROM labels),
  s AS (SELECT CASE WHEN a IS NULL THEN 0 WHEN a = t THEN 2 ELSE 1 END AS x, CASE WHEN b IS NULL THEN 0 WHEN b = t THEN 2 ELSE 1 END AS y FROM p)
  SELECT (['invalid', 'wrong', 'correct'])[x + 1] || '->' || (['invalid', 'wrong', 'correct'])[y + 1] AS transition, CASE WHEN y > x THEN 'win' WHEN y < x THEN 'loss' ELSE 'tie' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2""")
def paired_experiment(spark, sf):
    lab, i = table(spark, sf, "labels"), F.col("doc_id")
    a = F.when(i % 5 == 0, None).when(i % 3 == 0, 1).otherwise(F.col("quality"))
    b = F.when(i % 7 == 0, None).when(i % 4 == 0, 0).otherwise(F.col("quality"))
    return evaluate.paired(lab.withColumns({"a": a, "b": b}), "quality", "a", "b")


ERRORS = ["HTTP 400: invalid json body", "429 too many", "402 payment", "Read timed out", "connection reset", "quota exceeded"]


@query(f"""SELECT {sql_pick(['INVALID_JSON', 'RATE_LIMIT', 'QUOTA', 'TIMEOUT', 'API_FAILURE', 'QUOTA'], 'event_id')} AS error_type, count(*) AS n FROM events GROUP BY 1""")
def prediction_error_types(spark, sf):
    e = table(spark, sf, "events").select(evaluate.error_type(pick(ERRORS, F.col("event_id"))).alias("error_type"))
    return e.groupBy("error_type").agg(F.count("*").alias("n"))


KEYWORDS = ["the", "der", "que", "ou", "http", "token", "@"]


@query(f"""WITH {JUDGED}, k AS (SELECT keyword, truth, count(*) AS n FROM judged, (SELECT unnest(['{"', '".join(KEYWORDS)}']) AS keyword) WHERE contains(lower(text), keyword) GROUP BY 1, 2)
  SELECT keyword, CAST(sum(n) AS BIGINT) AS n, {R4('sum(-n / t * log2(n / t))')} AS entropy FROM k JOIN (SELECT keyword, sum(n) AS t FROM k GROUP BY 1) USING (keyword) GROUP BY keyword""")
def keyword_class_entropy(spark, sf):
    return quality.keyword_entropy(judged(spark, sf), KEYWORDS, "text", "truth")


@query("""WITH a AS (SELECT DISTINCT source, n_chars % 50 AS t FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source, n_chars % 50 AS t FROM documents WHERE lang = 'de')
  SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_common""")
def split_overlap_counts(spark, sf):
    d = table(spark, sf, "documents").withColumn("k", F.concat_ws("|", "source", (F.col("n_chars") % 50).cast("string")))
    return quality.set_overlap(d.filter("lang = 'en'"), d.filter("lang = 'de'"), "k")


@query("SELECT source, count(DISTINCT lang) AS n_labels, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def template_overlap(spark, sf):
    return quality.many_labelled(table(spark, sf, "documents"), "source", "lang")


def soc_records(spark, sf):
    """A nested record for each conversation: its turns are the evidence."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    g = c.groupBy("conv_id").agg(turns.alias("t"))
    ids = F.transform("t", lambda x: F.format_string("EVT-%06d", x["turn"]))
    evidence = F.transform("t", lambda x: F.struct(F.format_string("EVT-%06d", x["turn"]).alias("id"), F.format_string("2024-01-01T00:00:%02d", F.when(F.col("conv_id") % 5 == 0, 59 - x["turn"]).otherwise(x["turn"])).alias("timestamp")))
    k = F.col("conv_id") % 5
    cls = F.element_at(F.array(*[F.lit(x) for x in vocab.SOC_CLASSIFICATIONS]), (k + 1).cast("int"))
    refs = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("EVT-999999"))).otherwise(F.slice(ids, 1, 1))
    return g.select(
        "conv_id", F.format_string("SOC-%06d", "conv_id").alias("id"), F.lit("triage").alias("task"),
        F.struct(F.struct(F.lit("medium").alias("severity")).alias("alert"), F.struct(F.when(F.col("conv_id") % 2 == 0, "h").alias("hostname"), F.lit("u").alias("username")).alias("context"), evidence.alias("evidence")).alias("input"),
        F.struct(cls.alias("classification"), F.lit(0.9).alias("confidence"), F.array(F.struct(refs.alias("evidence_refs"))).alias("findings"), F.array(F.struct(F.lit("T1059.001").alias("technique_id"), refs.alias("evidence_refs"))).alias("mitre_techniques"),
                 F.array(F.lit("act")).alias("recommended_actions"), F.array().cast("array<string>").alias("investigation_steps"), F.lit("r").alias("rationale"), F.lit("").alias("summary")).alias("output"),
        F.struct(F.lit("x").alias("source")).alias("metadata"),
    )


@query("""SELECT conv_id, CAST(10 + CASE WHEN c >= 2 THEN 10 ELSE 5 END + CASE WHEN conv_id % 3 <> 0 THEN 10 ELSE 0 END + CASE WHEN conv_id % 5 <> 0 OR c = 1 THEN 10 ELSE 0 END + CASE WHEN conv_id % 2 = 0 THEN 10 ELSE 0 END
  + CASE WHEN conv_id % 5 IN (0, 3) THEN 10 ELSE 0 END + 10 + CASE WHEN conv_id % 3 <> 0 THEN 10 ELSE 0 END + 10 + 10 AS INT) AS score FROM (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1)""")
def quality_score_10(spark, sf):
    return soc_records(spark, sf).select("conv_id", quality.record_score().alias("score"))


@query("""SELECT conv_id, conv_id % 3 <> 0 AS grounded, CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_invalid FROM (SELECT DISTINCT conv_id FROM conversations)""")
def evidence_refs_membership(spark, sf):
    s = soc_records(spark, sf).select("conv_id", F.transform("input.evidence", lambda e: e["id"]).alias("valid"), F.flatten(F.transform("output.findings", lambda f: f["evidence_refs"])).alias("refs"))
    out = retrieval.ground(s, "refs", "valid")
    return out.select("conv_id", (F.size("invalid_refs") == 0).alias("grounded"), F.size("invalid_refs").alias("n_invalid"))


RANKED = """SELECT *, row_number() OVER (PARTITION BY g ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS g FROM labels)"""
SPLIT = f"sp AS (SELECT doc_id, g, CASE WHEN rn <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN rn <= greatest(1, floor(n * 0.8)) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM ({RANKED}))"


def graded(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("g"))


@query(f"WITH {SPLIT} SELECT doc_id, g, split FROM sp")
def stratified_split(spark, sf):
    return training.split(graded(spark, sf), "g", "doc_id").select("doc_id", "g", "split")


@query(f"WITH {SPLIT} SELECT g, split, count(*) AS n FROM sp GROUP BY 1, 2")
def split_class_counts(spark, sf):
    return training.split(graded(spark, sf), "g", "doc_id").groupBy("g", "split").agg(F.count("*").alias("n"))


@query(f"WITH r AS ({RANKED}), m AS (SELECT max(n) AS t FROM r) SELECT doc_id, g, CAST(unnest(range(0, CAST(floor((t - rn) / n) AS BIGINT) + 1)) AS INT) AS copy FROM r, m WHERE rn <= t")
def balance_over(spark, sf):
    return training.balance(graded(spark, sf), "g", "doc_id").select("doc_id", "g", "copy")


@query(f"WITH r AS ({RANKED}), m AS (SELECT min(n) AS t FROM r) SELECT doc_id, g, CAST(0 AS INT) AS copy FROM r, m WHERE rn <= t")
def balance_under(spark, sf):
    return training.balance(graded(spark, sf), "g", "doc_id", "undersample").select("doc_id", "g", "copy")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 10 = 0) p WHERE p.text = d.text)")
def firewall_anti_join(spark, sf):
    d = table(spark, sf, "documents")
    held = table(spark, sf, "benchmark").select("text").union(d.filter("doc_id % 10 = 0").select("text"))
    return training.without_protected(d.select("doc_id", "text"), held, ["text"]).select("doc_id")


@query("""WITH g AS (SELECT conv_id, max(text) FILTER (role = 'system') AS s, min(text) FILTER (role = 'user') AS u, min(text) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
  SELECT conv_id, md5(concat_ws('|', coalesce(s, 'none'), coalesce(u, 'none'), coalesce(a, 'none'))) AS digest, CASE WHEN trim(coalesce(s, 'none')) = '' OR trim(coalesce(u, 'none')) = '' OR trim(coalesce(a, 'none')) = '' THEN 'blank content' ELSE 'assistant content is not JSON' END AS reason FROM g""")
def sft_messages_json(spark, sf):
    c = table(spark, sf, "conversations")
    of = lambda r, f: F.coalesce(f(F.when(F.col("role") == r, F.col("text"))), F.lit("none"))
    g = c.groupBy("conv_id").agg(of("system", F.max).alias("s"), of("user", F.min).alias("u"), of("assistant", F.min).alias("a"))
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.col(k).alias("content")) for r, k in (("system", "s"), ("user", "u"), ("assistant", "a"))])
    g = g.withColumn("messages", m)
    text = F.array_join(F.transform("messages", lambda x: x["content"]), "|")
    return g.select("conv_id", F.md5(text).alias("digest"), training.example_reason().alias("reason"))


_TITLES = {c: f"{c.replace('_', ' ').title()} Activity Detected" for c in vocab.ATTACK_CATEGORIES if c != "none"}
_CATEGORY = "CASE WHEN status IN ('rejected', 'duplicate') THEN NULL WHEN source_label IS NULL OR status = 'review_required' THEN 'other' ELSE b.a END"


@query(f"""WITH {OUTCOME} SELECT record_id, '## Security Alert for Triage' || chr(10) || chr(10) || '**Alert**: ' || coalesce({sql_case(_CATEGORY, _TITLES)}, CASE WHEN src_ip IS NOT NULL THEN 'Network Activity: ' || src_ip || ' → ' || dst_ip ELSE 'Security Event Detected' END)
  || chr(10) || '**Severity**: medium' || chr(10) || '**Source**: ' || source || chr(10) || '**Timestamp**: ' || timestamp || chr(10) || chr(10) || '### Context' || CASE WHEN src_ip IS NOT NULL THEN chr(10) || '- **Source IP**: ' || src_ip ELSE '' END
  || chr(10) || '- **Destination IP**: ' || dst_ip || chr(10) || chr(10) || '### Evidence' || chr(10) || '**[EVT-' || lpad(CAST(record_index + 1 AS VARCHAR), CAST(greatest(6, length(CAST(record_index + 1 AS VARCHAR))) AS INT), '0') || ']** Network flow record:'
  || CASE WHEN src_ip IS NOT NULL THEN chr(10) || '  Source: ' || src_ip || CASE WHEN src_port > 0 THEN ':' || src_port ELSE '' END ELSE '' END || chr(10) || '  Destination: ' || dst_ip || ':443' || chr(10) || '  Protocol: ' || protocol || chr(10) || '  Bytes sent: ' || bytes_sent AS prompt FROM outcome""")
def prompt_rendering(spark, sf):
    """The whole prompt of every record, whatever its outcome."""
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark))
    return out.select("record_id", training.user_prompt().alias("prompt"))


@query()
def prompt_texts(spark, sf):
    """The whole prompt of every record that the generator keeps; tests/test_prompts.py holds it against brute force."""
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark), harmonize_first=True)
    return out.filter("classification IS NOT NULL AND classification <> 'review_required'").select("record_id", training.user_prompt().alias("prompt"))


@query("SELECT doc_id, lang, CAST(rn AS INT) AS rn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def first_n_per_class(spark, sf):
    return records.first_per_group(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 10)


_STRIP = rf"regexp_replace(%s, '^{_WHITE}|{_WHITE}$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {_STRIP % 'text'} AS t FROM documents), s AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 400 THEN [0] ELSE list_filter(range(0, length(t), 350), lambda x: x = 0 OR x + 50 < length(t)) END) AS s FROM t),
  c AS (SELECT doc_id, s, {_STRIP % "substr(t, s + 1, 400)"} AS content FROM s)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, length(content) AS n, md5(content) AS digest FROM c WHERE content <> ''""")
def chunk_documents(spark, sf):
    c = retrieval.chunk(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9_.\\-]+'), lambda x: length(x) > 1 AND NOT list_contains(['" + "', '".join(vocab.STOP_WORDS) + "'], x))"
TOK = f"tok AS (SELECT doc_id, {_TOK} AS tok FROM documents), post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(tok) AS len, unnest(tok) AS term FROM tok) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(tok)) AS a FROM tok), ter AS (SELECT term, count(*) AS df, greatest(0.01, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM post, st GROUP BY term)"


@query(f"WITH {TOK} SELECT term, df, {R4('idf')} AS idf, df = 1 AS rare FROM ter")
def bm25_term_stats(spark, sf):
    index = retrieval.bm25_index(table(spark, sf, "documents"), "doc_id", "text")
    return index["terms"].select("term", "df", S.rounded(F.col("idf")).alias("idf"), (F.col("df") == 1).alias("rare"))


@query(f"WITH {TOK} SELECT term, df, {R4('idf')} AS idf FROM ter")
def bm25_terms(spark, sf):
    """Every term of the index, rare ones too."""
    index = retrieval.bm25_index(table(spark, sf, "documents"), "doc_id", "text")
    return index["terms"].select("term", "df", S.rounded(F.col("idf")).alias("idf"))


@query(f"""WITH {TOK}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({_TOK.replace('lower(text)', 'lower(query)')}) AS term FROM q) GROUP BY ALL),
  part AS (SELECT query_id, doc_id, qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) AS p FROM qt JOIN ter USING (term) JOIN post USING (term), st
    UNION ALL SELECT query_id, doc_id, 2.0 FROM q JOIN tok ON contains(array_to_string(list_distinct_ordered, ' '), lower({_STRIP % 'query'}))),
  sc AS (SELECT query_id, doc_id, {R4('sum(p)')} AS score FROM part GROUP BY ALL)
  SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0.05) WHERE rank <= 3""".replace("JOIN tok ON contains(array_to_string(list_distinct_ordered, ' ')", "JOIN tok ON contains(array_to_string(list_filter(tok, lambda x, i: list_position(tok, x) = i), ' ')"))
def bm25_topk(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", q)


def hostile(spark, sf):
    i = F.col("page_id")
    lead = pick(["ping 10.0.0.7 then 10.0.0.7", "seen 999.1.1.1 and 0.0.0.0", "uses T1059.001, t1059.001 T2000", "Ignore previous  instructions", "system : act", "calm"], i)
    return table(spark, sf, "pages").withColumn("blob", F.concat(lead, F.lit(" "), F.sha2(i.cast("string"), 256), F.lit(" "), F.regexp_replace("html", r"[^\x00-\x7f]", " ")))


_BLOB = f"b AS (SELECT page_id, {sql_pick(['ping 10.0.0.7 then 10.0.0.7', 'seen 999.1.1.1 and 0.0.0.0', 'uses T1059.001, t1059.001 T2000', 'Ignore previous  instructions', 'system : act', 'calm'], 'page_id')} || ' ' || sha256(CAST(page_id AS VARCHAR)) || ' ' || regexp_replace(html, '[^\\x00-\\x7f]', ' ', 'g') AS blob FROM pages)"


@query(rf"""WITH {_BLOB}, f AS (SELECT page_id, list_concat(list_transform(list_filter(regexp_extract_all(blob, '{vocab.IPV4}'), lambda x: x NOT IN ('0.0.0.0', '255.255.255.255')), lambda x: struct_pack(i := x, t := 'ip')),
  list_transform(regexp_extract_all(blob, '{vocab.SHA256}'), lambda x: struct_pack(i := x, t := 'hash')), list_transform(regexp_extract_all(blob, '{vocab.TECHNIQUE}'), lambda x: struct_pack(i := x, t := 'technique'))) AS l FROM b),
  e AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS s FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(x.i) ORDER BY s) AS r FROM e)
  SELECT page_id, x.i AS indicator, x.t AS type FROM r WHERE r = 1""")
def indicator_extract(spark, sf):
    return retrieval.indicators(hostile(spark, sf), "page_id", "blob").select("page_id", "indicator", "type")


@query(rf"""WITH {_BLOB} """ + " UNION ALL ".join(f"SELECT page_id, {i} AS pattern_no FROM b WHERE regexp_matches(blob, '(?i){p}')" for i, p in enumerate(vocab.INJECTIONS)))
def injection_scan(spark, sf):
    return retrieval.injections(hostile(spark, sf), "page_id", "blob")


_INTEL = "intel AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', '{r}', {c}, '{a}', '{m}')" for i, t, r, c, a, m in vocab.INDICATORS) + ") t(indicator, indicator_type, reputation, confidence, threat_actor, malware_family))"
_ASKED = [i for i, *_ in vocab.INDICATORS] + ["8.8.8.8", "nowhere"]


@query(f"WITH {_INTEL}, a AS (SELECT event_id, {sql_pick(_ASKED, 'event_id')} AS ask FROM events) SELECT event_id, reputation, malware_family, i.indicator IS NOT NULL AS found FROM a LEFT JOIN intel i ON i.indicator = a.ask")
def intel_lookup(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit(" "), F.upper(pick(_ASKED, F.col("event_id")))).alias("ask"))
    return retrieval.intel_lookup(e, "ask").select("event_id", "reputation", "malware_family", "found")


_TECH = "tech AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n}', '{t}')" for i, n, t in vocab.TECHNIQUES) + ") t(technique_id, technique_name, tactic))"


@query(f"""WITH {_TECH}, k AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'script' ELSE lower(split_part(trim(text), ' ', 1)) END AS w FROM conversations)
  SELECT conv_id, turn, technique_id, tactic FROM k JOIN tech ON w <> '' AND contains(lower(technique_id || ' ' || technique_name || ' ' || tactic), w)""")
def mitre_search(spark, sf):
    """The techniques that have the first word of a turn in their names."""
    word = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.lit("Script ")).otherwise(F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))
    asked = table(spark, sf, "conversations").select("conv_id", "turn", word.alias("word"))
    return retrieval.technique_matches(asked, "word").select("conv_id", "turn", "technique_id", "tactic")


@query("SELECT event_id, user_id FROM events WHERE contains(lower(event_type), 'click') AND user_id = 7 UNION ALL SELECT event_id, user_id FROM events WHERE contains(event_type, 'err') AND user_id <> 7")
def telemetry_filter(spark, sf):
    e = table(spark, sf, "events")
    a = retrieval.telemetry(e, contains={"event_type": "CLICK"}, equals={"user_id": 7})
    return a.union(retrieval.telemetry(e.filter("user_id <> 7"), within={"event_type": "err"})).select("event_id", "user_id")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0) AS added, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 = 0 AND doc_id % 5 <> 0) AS removed, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 5 = 0 AND FALSE)) AS common")
def version_diff(spark, sf):
    from ..sources.sinks import diff_versions

    d = table(spark, sf, "documents").select("doc_id")
    old = d.filter("doc_id % 3 = 0 or (doc_id % 3 <> 0 and doc_id % 7 = 0 and doc_id % 5 <> 0)")
    new = d.filter("doc_id % 3 = 0 or (doc_id % 3 <> 0 and doc_id % 5 = 0)")
    return diff_versions(old, new, "doc_id")


@query("SELECT n_nationkey AS model_id, CASE WHEN n_nationkey = 7 THEN 'promoted' WHEN n_nationkey = 3 THEN 'evaluated' WHEN n_nationkey % 2 = 0 THEN 'trained' ELSE 'evaluated' END AS lifecycle FROM nation")
def promote_model(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("model_id"), F.when(F.col("n_nationkey") == 3, "promoted").when(F.col("n_nationkey") % 2 == 0, "trained").otherwise("evaluated").alias("lifecycle"))
    return training.promote(n, "model_id", 7)


@query("SELECT p_partkey * 20 + v + 1 AS number, 'SOC-' || lpad(CAST(p_partkey * 20 + v + 1 AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey * 20 + v + 1 AS VARCHAR))) AS INT), '0') AS record_id, p_brand || '/' || v AS title FROM part, range(0, 20) t(v)")
def template_expand(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("template_no"), "p_brand")
    out = training.expand_templates(t)
    return out.select((F.col("template_no") * 20 + F.col("variant") + 1).alias("number"), "record_id", training.fill(F.lit("{brand}/{v}"), {"brand": F.col("p_brand"), "v": F.col("variant")}).alias("title"))


@query("SELECT arg_max(n_nationkey, n_regionkey * 1000 - n_nationkey) AS run, max(n_regionkey) AS best FROM nation")
def best_run(spark, sf):
    return evaluate.best_run(table(spark, sf, "nation"), "n_nationkey", "n_nationkey", "n_regionkey")


@query(f"WITH {JUDGED} SELECT count(*) AS n, {R4('count(*) FILTER (doc_id % 9 <> 0) / count(*)')} AS coverage, {R4('count(*) FILTER (doc_id % 9 <> 0 AND truth = pred) / count(*) FILTER (doc_id % 9 <> 0)')} AS valid_accuracy, {R4('count(*) FILTER (doc_id % 9 <> 0 AND truth = pred) / count(*)')} AS end_to_end_accuracy, {R4('count(*) FILTER (doc_id % 9 = 0) / count(*)')} AS parse_error_rate FROM judged")
def prediction_evaluation(spark, sf):
    return evaluate.predictions(judged(spark, sf).withColumn("err", F.when(F.col("doc_id") % 9 == 0, "bad")), "truth", "pred", "err")


@query("SELECT event_id, 'hash' || CAST(event_id % 4 AS VARCHAR) AS shard_name FROM events WHERE event_id < 0")
def empty_scan(spark, sf):
    return table(spark, sf, "events").filter("event_id < 0").select("event_id", F.concat(F.lit("hash"), (F.col("event_id") % 4).cast("string")).alias("shard_name"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, sha256('{"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS f, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  s AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS f, CAST([] AS STRUCT(f VARCHAR, k BIGINT)[]) AS seen, CAST(NULL AS BIGINT) AS duplicate_of, CAST(0 AS BIGINT) AS evictions
  UNION ALL SELECT d.r, d.doc_id, d.f, CASE WHEN h IS NOT NULL THEN seen ELSE list_append(seen, struct_pack(f := d.f, k := d.doc_id))[-100:] END, h, evictions + CASE WHEN h IS NULL AND len(seen) = 100 THEN 1 ELSE 0 END
    FROM (SELECT s.*, list_filter(seen, lambda x: x.f = d2.f)[1].k AS h FROM s JOIN d d2 ON d2.r = s.r + 1) s JOIN d ON d.r = s.r + 1)
  SELECT doc_id, f AS fingerprint, duplicate_of, evictions FROM s WHERE r > 0""")
def fifo_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return records.fifo_deduplicate(d, ["text"], 100, "doc_id", "doc_id")


@query("""SELECT CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'csv' WHEN 3 THEN 'jsonl' WHEN 4 THEN 'text_log' ELSE 'parquet' END AS format, CASE WHEN doc_id % 6 = 4 THEN 1.0 ELSE 0.75 END AS confidence, count(*) AS n FROM documents GROUP BY 1, 2""")
def format_sniff(spark, sf):
    from ..sources.readers import detect

    d = table(spark, sf, "documents")
    forms = [F.to_json(F.struct("doc_id", "lang")), F.concat(F.lit("<a><b>"), F.col("lang"), F.lit("</b></a>")), F.lit("a,b,c\n1,2,3"), F.concat(F.to_json(F.struct("doc_id")), F.lit("\n{}")), F.lit("plain words"), F.lit("PAR1xx")]
    text = F.coalesce(*[F.when(F.col("doc_id") % len(forms) == i, f) for i, f in enumerate(forms)])
    kind = detect(F.encode(text, "UTF-8"), F.lit("log"))
    return d.select(kind["format"].alias("format"), kind["confidence"].alias("confidence")).groupBy("format", "confidence").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'last' AS username, 'host= user= user= did ' || event_type AS message FROM events")
def log_parse(spark, sf):
    from ..sources.readers import log_fields

    e = table(spark, sf, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" host=h1 user="), F.col("user_id").cast("string"), F.lit(" user=last did "), "event_type")
    m = F.col("m")
    return e.select("event_id", log_fields(line).alias("m")).select("event_id", m["timestamp"].alias("timestamp"), m["user"].alias("username"), m["message"].alias("message"))


_FP = "'{" + ",".join(f'"{f}":' + {"source_label": """' || CAST(to_json(event_type) AS VARCHAR) || '""", "src_ip": """"10.0.0.' || user_id % 250 || '\""""}.get(f, "null") for f in sorted(vocab.EXACT_FIELDS)) + "}'"


@query(f"SELECT DISTINCT sha256({_FP}) AS fingerprint, event_type AS source_label, '10.0.0.' || user_id % 250 AS src_ip FROM events")
def streaming_dedup(spark, sf):
    """The distinct fingerprints that a stream over the events' file gives, through the memory sink."""
    import uuid

    from ..streaming.streams import unique

    name = f"s{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf))
    rows = stream.select(F.format_string("flow-%08d", "event_id").alias("record_id"), F.lit("cicids_2017").alias("source"), F.col("event_type").alias("source_label"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"))
    run = unique(rows).select("fingerprint", "source_label", "src_ip").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _folder(spark, sf: str) -> str:
    """The table's path as a folder pattern: a stream's source is a folder or a pattern."""
    return f"{sf}/events*.parquet" if "events.parquet" in {s.rsplit("/", 1)[-1] for s in spark.read.parquet(f"{sf}/events.parquet").inputFiles()} else f"{sf}/events.parquet"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Class distribution of the processed events with the balance of the whole."""
    out = records.run_pipeline(flows(spark, sf), records.label_map(spark), harmonize_first=True).filter("status not in ('rejected', 'duplicate')")
    return quality.class_histogram(out).crossJoin(F.broadcast(quality.balance_score(out))).orderBy("classification")


__all__ = ["ORACLE", "QUERIES", "flagship"]
