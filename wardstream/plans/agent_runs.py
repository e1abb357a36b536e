"""Queries of the agent evaluations, over runs made from the events by the same rule in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import suites
from .catalogue import R4, pick, query, sql_pick, table

CLASSES = [*vocab.SOC_CLASSIFICATIONS, "other"]
SEVERITIES = [*vocab.SEVERITIES, "none"]
STATES = ["completed", "failed", "insufficient_evidence"]
TOOLS = ["threat_intel", "mitre_lookup", "shell"]
CATEGORIES = ["exact_ip", "exact_hash", "mitre_technique", "unknown_indicator", "general"]


def _upto(n) -> F.Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    ids = lambda j: F.when((i + j) % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array((i + j) % 6, j))
    return table(spark, sf, "events").select(
        i.alias("i"), pick(CLASSES, i).alias("classification"), pick(CLASSES, i % 4).alias("expected_classification"), pick(SEVERITIES, i).alias("severity"),
        pick(SEVERITIES, i % 3).alias("expected_severity"), ((i % 8) / 8).alias("confidence"), (i % 3 > 0).alias("investigation_required"),
        F.sequence(F.lit(0).cast("bigint"), i % 4).alias("evidence_ids"), F.transform(_upto(i % 3), ids).alias("findings"), pick(STATES, i).alias("status"),
        pick(CLASSES, i).alias("conclusion"), pick(CLASSES, i % 4).alias("expected_conclusion"), _upto(i % 8).alias("steps"), _upto(i % 2).alias("attempts"),
        F.transform(_upto(i % 8), lambda j: pick(TOOLS, i + j)).alias("tools"), _upto(i % 4).alias("candidates"),
        pick(CATEGORIES, i).alias("category"), _upto(i % 7).alias("retrieved"), F.array(i % 5, i % 9).alias("expected"), (i % 5 != 3).alias("expect_hit"),
        F.when(i % 7 > 0, (i % 4) / 2).alias("top_score"),
    )


def _list(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


RUNS = f"""WITH r AS (SELECT event_id AS i, {sql_pick(CLASSES, 'event_id')} AS c, {sql_pick(CLASSES, '(event_id % 4)')} AS ec, {sql_pick(SEVERITIES, 'event_id')} AS s, {sql_pick(SEVERITIES, '(event_id % 3)')} AS es,
  {sql_pick(STATES, 'event_id')} AS st, range(0, event_id % 4 + 1) AS ev FROM events),
f AS (SELECT i, ev, unnest(list_transform(range(1, i % 3 + 1), lambda j: CASE WHEN (i + j) % 5 = 0 THEN [] ELSE [(i + j) % 6, j] END)) AS ids FROM r),
fs AS (SELECT count(*) AS n_findings, count(*) FILTER (len(ids) > 0) AS cited, count(*) FILTER (len(ids) > 0 AND len(list_filter(ids, lambda x: NOT list_contains(ev, x))) = 0) AS good,
  CAST(sum(len(list_filter(ids, lambda x: NOT list_contains(ev, x)))) AS BIGINT) AS invented FROM f)"""
AGENT = f"""count(*) AS n, any_value(n_findings) AS n_findings, {R4('sum(i % 8) / count(*)')} AS mean_steps, count(*) FILTER (i % 8 > {suites.STEP_LIMIT}) AS n_over_limit,
  CAST(sum(i % 2) AS BIGINT) AS n_attempts, {R4('any_value(cited) / any_value(n_findings)')} AS grounding, {R4('sum(i % 2) / any_value(n_findings)')} AS hallucination"""


@query(f"""{RUNS} SELECT count(*) AS n, {R4('count(*) FILTER (c = ec) / count(*)')} AS accuracy, {R4('count(*) FILTER (s = es) / count(*)')} AS severity_accuracy,
  {R4("count(*) FILTER ((i % 3 > 0) = (ec <> 'benign')) / count(*)")} AS investigation_agreement, {R4('avg((i % 8) / 8)')} AS mean_confidence,
  {R4(f"count(*) FILTER (c IN ({_list(vocab.SOC_CLASSIFICATIONS)}) AND s IN ({_list(vocab.SEVERITIES)})) / count(*)")} AS validity, any_value(n_findings) AS n_findings, any_value(invented) AS n_hallucinated,
  {R4('any_value(good) / any_value(n_findings)')} AS grounding, {R4('any_value(invented) / any_value(n_findings)')} AS hallucination FROM r, fs""")
def triage_evaluation(spark, sf):
    return suites.triage(runs(spark, sf))


@query(f"""{RUNS} SELECT {AGENT}, {R4("count(*) FILTER (st = 'completed') / count(*)")} AS completion, {R4('count(*) FILTER (c = ec) / count(*)')} AS conclusion_accuracy FROM r, fs""")
def investigation_evaluation(spark, sf):
    return suites.investigation(runs(spark, sf))


@query(f"""{RUNS}, t AS (SELECT {', '.join(f"count(*) FILTER ((i + j) % 3 = {k}) AS t{k}" for k in range(3))} FROM (SELECT i, unnest(range(1, i % 8 + 1)) AS j FROM r))
  SELECT {AGENT}, {R4("count(*) FILTER (st <> 'failed') / count(*)")} AS completion, any_value(t0) AS n_intel_queries, any_value(t1) AS n_technique_queries, any_value(t2) AS n_unauthorized, CAST(sum(i % 4) AS BIGINT) AS n_candidates FROM r, fs, t""")
def threat_intel_evaluation(spark, sf):
    return suites.threat_intel(runs(spark, sf))


@query(f"""WITH q AS (SELECT {sql_pick(CATEGORIES, 'event_id')} AS c, range(1, event_id % 7 + 1) AS ret, [event_id % 5, event_id % 9] AS want, event_id % 5 <> 3 AS e, event_id % 7 = 0 OR (event_id % 4) / 2 < {suites.REJECT_BELOW} AS low FROM events),
  h AS (SELECT *, CASE WHEN e THEN len(list_intersect(ret, want)) > 0 ELSE low END AS hit FROM q)
  SELECT count(*) AS n, {', '.join(R4(f'avg(CASE WHEN len(list_intersect(ret[1:{k}], want)) > 0 THEN 1.0 ELSE 0.0 END) FILTER (e)') + f' AS hit_at_{k}' for k in (1, 3, 5))},
  {R4("count(*) FILTER (hit AND c IN ('exact_ip', 'exact_hash')) / count(*) FILTER (c IN ('exact_ip', 'exact_hash'))")} AS exact_rate,
  {R4("count(*) FILTER (hit AND c = 'mitre_technique') / count(*) FILTER (c = 'mitre_technique')")} AS technique_rate, {R4("count(*) FILTER (hit AND c = 'unknown_indicator') / count(*) FILTER (c = 'unknown_indicator')")} AS rejection_rate FROM h""")
def retrieval_evaluation(spark, sf):
    return suites.retrieval_suite(runs(spark, sf))


@query("""SELECT b.item_id, CASE WHEN b.item_id % 3 = 0 THEN 'missing' WHEN b.item_id % 2 = 0 OR b.text IS NULL THEN 'changed' ELSE 'ok' END AS state FROM benchmark b""")
def manifest_check(spark, sf):
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    manifest = b.select(i, F.sha2(F.when(i % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("record_hash"))
    return suites.check_manifest(manifest, b.filter(i % 3 != 0), "item_id", "text")


@query(f"""SELECT count(n_chars) AS n, {R4('avg(n_chars)')} AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents""")
def score_distribution(spark, sf):
    return suites.score_stats(table(spark, sf, "documents"), "n_chars")


@query("""SELECT doc_id, CASE WHEN n_chars >= 500 THEN 'approved' ELSE 'pending' END AS review_status FROM documents""")
def batch_approval(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.lit("pending").alias("review_status"))
    return suites.approve(docs, "n_chars", 500).select("doc_id", "review_status")
