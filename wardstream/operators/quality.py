"""Data-set quality: histograms, balance, completeness, duplicates, overall score, record score, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import entropy_bits, rounded


def class_histogram(df: DataFrame, label: str = "classification") -> DataFrame:
    return df.groupBy(F.coalesce(label, F.lit("unlabeled")).alias("classification")).agg(F.count("*").alias("n"))


def balance_score(df: DataFrame, label: str = "classification") -> DataFrame:
    """n_classes and balance: entropy of the class shares over its largest value; 0 for one class."""
    per = class_histogram(df, label)
    total = per.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    one = per.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_classes"), F.sum(entropy_bits(p)).alias("h"))  # total is one row
    score = F.when(F.col("n_classes") <= 1, 0.0).otherwise(rounded(F.col("h") / F.log2(F.col("n_classes").cast("double"))))
    return one.select("n_classes", score.alias("balance"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, completeness): share of rows in which the field is not null, from one aggregation."""
    one = df.agg(*[rounded(F.count(f) / F.greatest(F.count("*"), F.lit(1))).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("completeness")) for f in fields])).alias("x")).select("x.*")


def duplicate_count(df: DataFrame, fp: str = "fingerprint") -> DataFrame:
    """Rows that repeat a fingerprint; counted by two-level aggregation."""
    some = df.filter(F.col(fp).isNotNull() & (F.col(fp) != "")).groupBy(fp).agg(F.count("*").alias("n"))
    return some.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def overall(df: DataFrame, label: str, fields: list[str], fp: str, valid: Column) -> DataFrame:
    """One row: n, balance, completeness, duplicates, validity, label coverage and the weighted score."""
    base = df.agg(
        F.count("*").alias("n"), F.avg(valid.cast("double")).alias("validity"), F.avg(F.col(label).isNotNull().cast("double")).alias("label_coverage"),
        *[F.try_divide(F.count(f), F.count("*")).alias(f"c_{i}") for i, f in enumerate(fields)],
    )
    row = base.crossJoin(F.broadcast(balance_score(df, label))).crossJoin(F.broadcast(duplicate_count(df, fp)))  # one row each
    complete = reduce(lambda a, b: a + b, [rounded(F.col(f"c_{i}")) for i in range(len(fields))]) / len(fields)
    unique = 1.0 - F.try_divide(F.col("duplicates"), F.col("n"))
    # Weights of the score.
    score = F.col("validity") * 0.30 + F.col("balance") * 0.20 + complete * 0.25 + unique * 0.15 + F.col("label_coverage") * 0.10
    return row.select("n", "balance", rounded(complete).alias("completeness"), "duplicates", rounded(F.col("validity")).alias("validity"), rounded(F.col("label_coverage")).alias("label_coverage"), rounded(score).alias("score"))


def quality_issues(row: DataFrame, histogram: DataFrame | None = None) -> DataFrame:
    """The report row with the issues and recommendations its figures call for; a histogram tells of a dominant class."""
    c = F.col
    if histogram is None:
        row = row.withColumn("_largest", F.lit(None).cast("bigint"))
    else:
        row = row.crossJoin(F.broadcast(histogram.agg(F.max("n").alias("_largest"))))  # one row
    # Thresholds of the report.
    issues = [
        F.when(c("balance") < 0.3, "severe class imbalance").when(c("balance") < 0.6, "moderate class imbalance"),
        F.when(c("validity") < 0.9, "more than a tenth of the records are invalid"),
        F.when(c("duplicates") > 0.05 * c("n"), "more than one record in twenty is a duplicate"),
        F.when(c("label_coverage") < 0.5, "fewer than half of the records have a label"),
        F.when(c("_largest") > 0.9 * c("n"), "one class holds over nine tenths of the records"),
    ]
    advice = [
        F.when(c("balance") < 0.5, "balance the classes"), F.when(c("label_coverage") < 0.9, "label the unlabeled records"),
        F.when(c("duplicates") > 0, "remove duplicates"), F.when(c("score") < 0.5, "improve the data before training").when(c("score") >= 0.8, "ready for training"),
    ]
    return row.withColumns({"issues": F.array_compact(F.array(*issues)), "recommendations": F.array_compact(F.array(*advice))}).drop("_largest")


def analyze(df: DataFrame, label: str, fields: list[str], fp: str, valid: Column) -> DataFrame:
    """The whole report as one row; a data set without rows has zeros and says that it is empty."""
    row = overall(df, label, fields, fp, valid)
    row = row.na.fill(0.0, ["balance", "completeness", "validity", "label_coverage", "score"]).na.fill(0, ["duplicates"])
    out = quality_issues(row, class_histogram(df, label))
    empty = F.col("n") == 0
    return out.withColumns({"issues": F.when(empty, F.array(F.lit("Dataset is empty"))).otherwise(F.col("issues")), "recommendations": F.when(empty, F.array().cast("array<string>")).otherwise(F.col("recommendations"))})


def lexical_hint(text: Column, words: dict[str, list[str]]) -> Column:
    """The first group of which the text holds a word, in any case; else none."""
    low = F.lower(text)
    says = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
    return F.coalesce(*[F.when(says(ws), F.lit(k)) for k, ws in words.items()], F.lit("none"))


def record_score() -> Column:
    """Ten criteria of ten points over a nested record (id, task, input, output, metadata)."""
    c = F.col
    ids = F.transform("input.evidence", lambda e: e["id"])
    stamps = F.filter(F.transform("input.evidence", lambda e: e["timestamp"]), lambda t: t.isNotNull())
    cls, sev, conf = c("output.classification"), c("input.alert.severity"), c("output.confidence")
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    full = lambda x: F.coalesce(c(x) != "", F.lit(False))
    in_range = reduce(lambda a, b: a | b, [(cls == k) & conf.between(lo, hi) for k, (lo, hi) in vocab.CONFIDENCE_RANGES.items()])
    coherent = ((cls == "benign") & sev.isin("informational", "low", "medium")) | (cls.isin("likely_malicious", "confirmed_malicious") & sev.isin("medium", "high", "critical")) | cls.isin("suspicious", "insufficient_evidence")
    within = lambda refs: F.size(F.array_except(refs, ids)) == 0
    points = [
        F.when(c("id").isNotNull() & c("task").isNotNull() & c("input").isNotNull() & c("output").isNotNull() & c("metadata").isNotNull(), 10),
        F.when(F.size(ids) >= 2, 10).when(F.size(ids) == 1, 5),
        F.when(some("output.findings") & F.forall("output.findings", lambda f: (F.size(f["evidence_refs"]) > 0) & within(f["evidence_refs"])), 10),
        F.when(some(stamps) & (stamps == F.array_sort(stamps)), 10),
        F.when(full("input.context.hostname") & full("input.context.username"), 10),
        F.when(in_range, 10),
        F.when(coherent, 10),
        F.when(~some("output.mitre_techniques") | F.forall("output.mitre_techniques", lambda m: m["evidence_refs"].isNull() | within(m["evidence_refs"])), 10),
        F.when(some("output.recommended_actions") | some("output.investigation_steps"), 10),
        F.when(full("output.rationale") | full("output.summary"), 10),
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points])


def keyword_entropy(df: DataFrame, keywords: list[str], text: str, label: str) -> DataFrame:
    """(keyword, n, entropy): entropy in bits of the classes of the records that contain the keyword."""
    words = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.lower(text).contains(k))
    per = df.select(F.explode(words).alias("keyword"), F.col(label).alias("c")).groupBy("keyword", "c").agg(F.count("*").alias("n"))
    total = per.groupBy("keyword").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return per.join(total, "keyword").groupBy("keyword").agg(F.sum("n").alias("n"), rounded(F.sum(entropy_bits(p))).alias("entropy"))


def many_labelled(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups whose rows have more than one label."""
    return df.groupBy(group).agg(F.count_distinct(label).alias("n_labels"), F.count("*").alias("n")).filter("n_labels > 1")


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on each side and common."""
    x, y = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    return x.join(y, key, "full").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_common"))


def distractor_rate(df: DataFrame, ids: Column, cited: Column) -> DataFrame:
    """Share of records with evidence that no finding cites."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.size(F.array_except(ids, cited)) > 0).alias("n_distracted"))
