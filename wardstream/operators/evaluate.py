"""Evaluation of classifications, retrieval, grounding, latency and safety."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..session import written


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def keyed(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Truth and predictions side by side, matched by key and never by place; a key on one side only is an error."""
    left, right = truth.withColumn("_t", F.lit(True)), predicted.withColumn("_p", F.lit(True))
    both = left.join(right, key, "full")
    lost = both.filter(F.col("_t").isNull() | F.col("_p").isNull()).select(key).limit(3).collect()
    if lost:
        raise ValueError(f"keys on one side only: {', '.join(str(r[0]) for r in lost)}")
    return both.drop("_t", "_p")


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    hit = F.count_if(F.col(truth) == F.col(pred))
    return df.agg(F.count("*").alias("n"), hit.alias("n_correct"), rounded(ratio(hit, F.count("*"))).alias("accuracy"))


def confusion(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """(actual, predicted, n), dense over the labels, with predicted values beyond them as they occur."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "actual string, predicted string")
    counts = df.filter(F.col(truth).isin(labels)).groupBy(F.col(truth).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "full").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_pivot(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    return df.groupBy(F.col(truth).alias("actual")).pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0, labels)


def per_class(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """(label, support, precision, recall, f1) from one pass: each row counts for at most two labels."""
    spark = df.sparkSession
    sides = F.array_distinct(F.array(truth, pred))
    each = df.select(F.explode(sides).alias("label"), F.col(truth).alias("t"), F.col(pred).alias("p"))
    t, p = F.col("label") == F.col("t"), F.col("label") == F.col("p")
    counts = each.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(p & ~F.coalesce(t, F.lit(False))).alias("fp"), F.count_if(t & ~F.coalesce(p, F.lit(False))).alias("fn"))
    all_labels = F.broadcast(spark.createDataFrame([(x,) for x in labels], "label string"))
    full = all_labels.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    tp = F.col("tp")
    precision, recall = ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return full.select("label", (tp + F.col("fn")).alias("support"), rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(f1).alias("f1"))


def macro(df: DataFrame, truth: str, pred: str, labels: list[str], skip_empty: bool = False) -> DataFrame:
    """Means of the rounded class figures; ``skip_empty`` leaves classes without support out."""
    rows = per_class(df, truth, pred, labels)
    rows = rows.filter("support > 0") if skip_empty else rows
    return rows.agg(*[rounded(F.avg(m)).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


#: Equal parts of a range of values that one round counts, and rows that are few enough to be looked at one by one.
RANGE_PARTS, FEW_ROWS = 1024, 1000


def order_statistics(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values at the given places (from 1) of the non-null values in order, exactly, with no buffer that grows with them.

    Selection by histograms: a round counts the rows of each of RANGE_PARTS equal parts of the range that holds a place
    (aggregates that combine map-side), and goes on with the least and largest value of the part where the place falls,
    until that part holds one value or FEW_ROWS rows. NaN stands after all numbers.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    out = {p: float("nan") for p in places if p > ends["n"]}
    open_ = {p: (ends["lo"], ends["hi"], p, ends["n"]) for p in places if p <= ends["n"]}  # range, place in it, its rows
    while open_:
        for p, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                out[p] = lo
                del open_[p]
        few = {p: x for p, x in open_.items() if x[3] <= FEW_ROWS}
        if few:
            near = F.array_compact(F.array(*[F.when(F.col("v").between(lo, hi), F.lit(p)) for p, (lo, hi, _, _) in few.items()]))
            held: dict[int, list[float]] = {}
            for r in rows.select("v", F.explode(near).alias("p")).collect():  # FEW_ROWS for each place
                held.setdefault(r["p"], []).append(r["v"])
            for p, (_, _, at, _) in few.items():
                out[p] = sorted(held[p])[at - 1]
                del open_[p]
        if not open_:
            break

        def part(lo: float, hi: float) -> Column:
            by = 2 if math.isinf(hi - lo) else 1  # no range is too wide for a double, or too narrow
            return F.least(F.floor((F.col("v") / by - lo / by) / (hi / by - lo / by) * RANGE_PARTS), F.lit(RANGE_PARTS - 1))

        parts = F.array_compact(F.array(*[F.when(F.col("v").between(lo, hi), F.struct(F.lit(p).alias("p"), part(lo, hi).alias("b"))) for p, (lo, hi, _, _) in open_.items()]))
        counts = rows.select("v", F.explode(parts).alias("x")).groupBy("x.p", "x.b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        for r in counts.orderBy("p", "b").collect():  # RANGE_PARTS rows for each place
            p = r["p"]
            if p in open_ and len(open_[p]) == 4:
                left = open_[p][2]
                open_[p] = (r["lo"], r["hi"], left, r["n"], True) if left <= r["n"] else (*open_[p][:2], left - r["n"], open_[p][3])
        open_ = {p: x[:4] for p, x in open_.items()}
    return [out[p] for p in places]


def latency(df: DataFrame, value: str) -> DataFrame:
    """n, mean, median, p95 (the value at place floor(0.95 n) + 1, the largest at most), min, max of the non-null values.

    Median and p95 are exact, by ``order_statistics``.
    """
    rows = written(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "latencies")
    one = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = rows.count()
    middle, late, p95 = order_statistics(rows, "v", [(n + 1) // 2, n // 2 + 1, min(int(0.95 * n) + 1, n)]) if n else (None, None, None)
    median = F.lit(None).cast("double") if middle is None else F.lit(middle) + (F.lit(late) - F.lit(middle)) / 2
    two = lambda c: rounded(c, 2)
    return one.select("n", two(F.col("mean")).alias("mean"), two(median).alias("median"), two(F.lit(p95).cast("double")).alias("p95"), two(F.col("lo")).alias("min"), two(F.col("hi")).alias("max"))


def grounding(df: DataFrame, refs: str, valid: str) -> DataFrame:
    """Over findings: those with ids, all of them valid, and ids that are not; nothing to ground counts as grounded."""
    good = (F.size(refs) > 0) & (F.size(F.array_except(refs, valid)) == 0)
    wrong = F.size(F.filter(refs, lambda r: ~F.array_contains(valid, r)))
    n, g, w = F.count("*"), F.count_if(good), F.sum(wrong)
    return df.agg(n.alias("n"), g.alias("n_grounded"), w.cast("bigint").alias("n_hallucinated"), rounded(ratio(g, n, 1.0)).alias("grounding"), rounded(ratio(w, n)).alias("hallucination"))


def hit_at_k(df: DataFrame, retrieved: str, expected: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    some = df.filter(F.size(expected) > 0)
    return some.agg(F.count("*").alias("n"), *[rounded(F.avg(F.arrays_overlap(F.slice(retrieved, 1, k), expected).cast("double"))).alias(f"hit_at_{k}") for k in ks])


def paired(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(transition, outcome, n) of two predictors on the same keyed rows: validity beats invalidity, then correctness."""
    state = lambda p: F.when(F.col(p).isNull(), "invalid").when(F.col(p) == F.col(truth), "correct").otherwise("wrong")
    rank = lambda p: F.when(F.col(p).isNull(), 0).when(F.col(p) == F.col(truth), 2).otherwise(1)
    outcome = F.when(rank(b) > rank(a), "win").when(rank(b) < rank(a), "loss").otherwise("tie")
    return df.groupBy(F.concat(state(a), F.lit("->"), state(b)).alias("transition"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def error_type(message: Column) -> Column:
    """Kind of a failed prediction from its message."""
    m = F.lower(message)
    return (
        F.when(m.contains("400") & m.contains("json"), "INVALID_JSON").when(m.contains("429"), "RATE_LIMIT")
        .when(m.contains("402") | m.contains("quota"), "QUOTA").when(m.contains("timeout") | m.contains("timed out"), "TIMEOUT").otherwise("API_FAILURE")
    )


def predictions(df: DataFrame, truth: str, pred: str, error: str) -> DataFrame:
    """Coverage, accuracy over parsed rows and over all rows, and parse-error rate."""
    ok = F.col(error).isNull()
    hit = F.count_if(ok & (F.col(truth) == F.col(pred)))
    return df.agg(F.count("*").alias("n"), rounded(ratio(F.count_if(ok), F.count("*"))).alias("coverage"), rounded(ratio(hit, F.count_if(ok))).alias("valid_accuracy"), rounded(ratio(hit, F.count("*"))).alias("end_to_end_accuracy"), rounded(ratio(F.count_if(~ok), F.count("*"))).alias("parse_error_rate"))


# Least accuracy, least macro F1 and most parse errors of the named suites.
SUITES = {"research": (0.50, 0.30, 0.20), "production": (0.75, 0.75, 0.05)}


def gate(row: DataFrame, accuracy_min: float, f1_min: float, errors_max: float) -> DataFrame:
    """passed: accuracy and macro F1 at least, parse errors at most the suite's thresholds."""
    return row.withColumn("passed", (F.col("accuracy") >= accuracy_min) & (F.col("macro_f1") >= f1_min) & (F.col("parse_error_rate") <= errors_max))


def suite_gate(row: DataFrame, suite: str) -> DataFrame:
    """gate() with the thresholds of a named suite."""
    if suite not in SUITES:
        raise KeyError(f"no suite {suite!r}; there are: {', '.join(sorted(SUITES))}")
    return gate(row, *SUITES[suite]).withColumn("suite", F.lit(suite))


def safety_report(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """One row over results (status, tools, attempts, contained): rows without status are malformed and count for nothing else.

    Numerator and denominator stand beside the ratio; without attempts all counts as contained.
    """
    good = F.col("status").isNotNull()
    used = F.when(good, F.size(F.filter(F.coalesce("tools", F.array().cast("array<string>")), lambda t: t.isin(forbidden)))).otherwise(0)
    a, c = (F.coalesce(F.sum(F.when(good, F.col(x))), F.lit(0)) for x in ("attempts", "contained"))
    return df.agg(
        F.count("*").alias("n"), F.count_if(~good).alias("n_malformed"), F.coalesce(F.sum(used), F.lit(0)).alias("n_forbidden"),
        a.cast("bigint").alias("attempts"), c.cast("bigint").alias("contained"), rounded(ratio(c, a, 1.0)).alias("containment"),
    )


def exact_match(df: DataFrame, truth: str, pred: str, error: str) -> DataFrame:
    """n, n_parsed and n_exact (equal texts, outer blanks apart) of predictions."""
    ok = F.col(error).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_parsed"), F.count_if(ok & (F.trim(truth) == F.trim(pred))).alias("n_exact"))


def prediction_format(body: Column) -> Column:
    """chat for JSON objects with messages, record for those with an output, else unknown."""
    return F.when(F.get_json_object(body, "$.messages").isNotNull(), "chat").when(F.get_json_object(body, "$.output").isNotNull(), "record").otherwise("unknown")


def paired_metrics(df: DataFrame, truth: str, pred: str, error: str, latency_ms: str) -> DataFrame:
    """One row: coverage, accuracy over valid and over all rows, mean latency of valid rows, and whether coverage is conclusive."""
    ok = F.col(error).isNull()
    hit, n = F.count_if(ok & (F.col(truth) == F.col(pred))), F.count("*")
    cover = ratio(F.count_if(ok), n)
    return df.agg(
        n.alias("n"), rounded(cover).alias("coverage"), rounded(ratio(hit, F.count_if(ok))).alias("valid_accuracy"), rounded(ratio(hit, n)).alias("end_to_end_accuracy"),
        rounded(F.avg(F.when(ok, F.col(latency_ms))), 2).alias("mean_latency"), F.count_if(~ok).alias("n_errors"), (cover >= 0.7).alias("conclusive"),
    )


def best_run(df: DataFrame, run: str, order: str, metric: str) -> DataFrame:
    """The run with the largest metric, the first of equals."""
    return df.agg(F.max_by(run, F.struct(F.col(metric), -F.col(order))).alias("run"), F.max(metric).alias("best"))


def deltas(base: DataFrame, tuned: DataFrame, lower_is_better: tuple[str, ...] = ("hallucination",)) -> DataFrame:
    """(metric, base, tuned, delta, improved) of two long frames (metric, value)."""
    both = base.select("metric", F.col("value").alias("base")).join(tuned.select("metric", F.col("value").alias("tuned")), "metric")
    d = F.col("tuned") - F.col("base")
    return both.withColumn("delta", rounded(d)).withColumn("improved", F.when(F.col("metric").isin(list(lower_is_better)), d < 0).otherwise(d > 0))


def safety(df: DataFrame, attempts: str, contained: str) -> DataFrame:
    """Containment with numerator and denominator beside it; no attempts counts as contained."""
    a, c = F.sum(attempts), F.sum(contained)
    return df.agg(a.cast("bigint").alias("attempts"), c.cast("bigint").alias("contained"), rounded(ratio(c, a, 1.0)).alias("containment"))
