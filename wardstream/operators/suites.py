"""Evaluation of agent runs, each as one aggregation; manifests of evaluation sets; review states and task shares.

Findings are arrays of arrays: the evidence ids that each finding cites. Ratios over no rows are 0; grounding over no
findings is 1. Null arrays count as empty. Confusion, per-class and macro figures are in ``evaluate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import rounded
from .evaluate import ratio

#: Steps an agent may take.
STEP_LIMIT = 5
#: Best score below which an unknown indicator counts as not found.
REJECT_BELOW = 1.0


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def _share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return rounded(ratio(part, whole, empty))


def _cited(findings: Column) -> Column:
    return _size(F.filter(findings, lambda f: F.size(f) > 0))


def triage(df: DataFrame) -> DataFrame:
    """One row. Needs classification, severity, confidence, investigation_required, expected_classification,
    expected_severity, findings and evidence_ids; everything but a benign case is expected to need an investigation."""
    ids = F.coalesce("evidence_ids", F.array())
    wrong = lambda f: F.size(F.filter(f, lambda x: ~F.array_contains(ids, x)))
    n, found = F.count("*"), _total(_size(F.col("findings")))
    grounded = _total(_size(F.filter("findings", lambda f: (F.size(f) > 0) & (wrong(f) == 0))))
    invented = _total(F.aggregate(F.coalesce("findings", F.array()), F.lit(0), lambda a, f: a + wrong(f)))
    agrees = F.col("investigation_required") == (F.col("expected_classification") != "benign")
    valid = F.col("classification").isin(vocab.SOC_CLASSIFICATIONS) & F.col("severity").isin(vocab.SEVERITIES)
    return df.agg(
        n.alias("n"), _share(F.count_if(F.col("classification") == F.col("expected_classification")), n).alias("accuracy"),
        _share(F.count_if(F.col("severity") == F.col("expected_severity")), n).alias("severity_accuracy"), _share(F.count_if(agrees), n).alias("investigation_agreement"),
        rounded(F.coalesce(F.avg("confidence"), F.lit(0.0))).alias("mean_confidence"), _share(F.count_if(valid), n).alias("validity"),
        found.alias("n_findings"), invented.alias("n_hallucinated"), _share(grounded, found, 1.0).alias("grounding"), _share(invented, found).alias("hallucination"),
    )


def _agent(df: DataFrame, done: Column, steps: str, others: list[Column]) -> DataFrame:
    n, found, tried = F.count("*"), _total(_size(F.col("findings"))), _total(_size(F.col("attempts")))
    return df.agg(
        n.alias("n"), _share(F.count_if(done), n).alias("completion"), _share(_total(_size(F.col(steps))), n).alias("mean_steps"),
        F.count_if(F.size(steps) > STEP_LIMIT).alias("n_over_limit"), found.alias("n_findings"), tried.alias("n_attempts"),
        _share(_total(_cited(F.col("findings"))), found, 1.0).alias("grounding"), _share(tried, found).alias("hallucination"), *others,
    )


def investigation(df: DataFrame) -> DataFrame:
    """One row. Needs status, conclusion, expected_conclusion, steps, findings and attempts (ids the agent made up)."""
    right = F.count_if(F.col("conclusion").eqNullSafe(F.col("expected_conclusion")))
    return _agent(df, F.col("status") == "completed", "steps", [_share(right, F.count("*")).alias("conclusion_accuracy")])


def conclusions(df: DataFrame) -> DataFrame:
    """(conclusion, n) of the investigations; none for those without."""
    return df.groupBy(F.coalesce("conclusion", F.lit("none")).alias("conclusion")).agg(F.count("*").alias("n"))


def threat_intel(df: DataFrame) -> DataFrame:
    """One row. Needs status, tools (the tool of each step), findings, attempts and candidates (indicators found)."""
    used = lambda keep: _total(_size(F.filter("tools", keep)))
    return _agent(df, F.col("status").isin("completed", "insufficient_evidence"), "tools", [
        used(lambda t: t.eqNullSafe(F.lit("threat_intel"))).alias("n_intel_queries"), used(lambda t: t.eqNullSafe(F.lit("mitre_lookup"))).alias("n_technique_queries"),
        used(lambda t: ~F.coalesce(t.isin("threat_intel", "mitre_lookup"), F.lit(False))).alias("n_unauthorized"), _total(_size(F.col("candidates"))).alias("n_candidates"),
    ])


def retrieval_suite(df: DataFrame) -> DataFrame:
    """One row. Needs category, retrieved and expected (arrays of ids, best first), expect_hit and top_score (null: nothing)."""
    hit = F.when(F.col("expect_hit"), F.arrays_overlap("retrieved", "expected")).otherwise(F.col("top_score").isNull() | (F.col("top_score") < REJECT_BELOW))
    rate = lambda *names: _share(F.count_if(F.col("category").isin(*names) & hit), F.count_if(F.col("category").isin(*names)), 1.0)
    first = lambda k: F.when(F.col("expect_hit"), F.coalesce(F.arrays_overlap(F.slice("retrieved", 1, k), "expected"), F.lit(False)).cast("double"))
    return df.agg(
        F.count("*").alias("n"), *[rounded(F.coalesce(F.avg(first(k)), F.lit(0.0))).alias(f"hit_at_{k}") for k in (1, 3, 5)],
        rate("exact_ip", "exact_hash").alias("exact_rate"), rate("mitre_technique").alias("technique_rate"), rate("unknown_indicator").alias("rejection_rate"),
    )


def check_manifest(manifest: DataFrame, rows: DataFrame, key: str, body: str) -> DataFrame:
    """Each entry (key, record_hash) of a manifest with its state: ok, changed (another SHA-256 of body) or missing."""
    held = rows.select(key, F.upper(F.sha2(body, 256)).alias("_h"), F.lit(True).alias("_is"))
    state = F.when(F.col("_is").isNull(), "missing").when(F.col("_h").eqNullSafe(F.upper("record_hash")), "ok").otherwise("changed")
    return manifest.join(held, key, "left").select(key, state.alias("state"))


def manifest_report(manifest: DataFrame, rows: DataFrame, key: str, label: str, expected: int, per_class: int) -> DataFrame:
    """One row: what keeps a manifest (key, label) from being an evaluation set of ``expected`` rows, ``per_class`` of each class.

    Counts repeated keys, keys that no row has, and labels other than the row's; ``ok`` if all is as it should be.
    """
    held = rows.select(key, F.col(label).alias("_label"), F.lit(True).alias("_is"))
    both = manifest.join(held, key, "left")
    classes = manifest.groupBy(label).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") != per_class).alias("n_uneven_classes"))
    keys = manifest.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 1).alias("n_repeated"))
    found = both.agg(F.count_if(F.col("_is").isNull()).alias("n_missing"), F.count_if(F.col("_is").isNotNull() & ~F.col("_label").eqNullSafe(F.col(label))).alias("n_mislabelled"))
    row = keys.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(found))  # one row each
    good = (F.col("n") == expected) & (F.col("n_repeated") + F.col("n_uneven_classes") + F.col("n_missing") + F.col("n_mislabelled") == 0)
    return row.withColumn("ok", good)


def approve(df: DataFrame, score: str = "quality_score", least: int = 90, status: str = "review_status") -> DataFrame:
    """Approves the rows whose score is at least ``least``; the others keep their status."""
    return df.withColumn(status, F.when(F.col(score) >= least, "approved").otherwise(F.col(status)))


def score_stats(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count(score).alias("n"), rounded(F.avg(score)).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))


def allocate_rows(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, n) of a table of weights: whole shares of total as in ``allocate``, the last key taking what is left over."""
    sums = weights.agg(F.sum(weight).alias("_all"), F.max(key).alias("_last"))  # one row
    rows = weights.crossJoin(F.broadcast(sums)).withColumn("_n", F.bround(F.lit(total) * F.col(weight) / F.col("_all"), 0).cast("bigint"))
    others = rows.filter(F.col(key) != F.col("_last")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_others"))  # one row
    return rows.crossJoin(F.broadcast(others)).select(key, F.when(F.col(key) == F.col("_last"), F.lit(total) - F.col("_others")).otherwise(F.col("_n")).alias("n"))


def allocate(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole shares of total in proportion to the weights; the last one takes what rounding leaves over."""
    *others, last = weights
    out = {k: round(total * weights[k] / sum(weights.values())) for k in others}
    return out | {last: total - sum(out.values())}
