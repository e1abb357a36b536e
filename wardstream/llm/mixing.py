"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's repetition rate is its target share of the total size over its size. Each document's number of copies is a
Poisson draw with that mean: a uniform number seeded by a hash of the document inverts the distribution's steps. The
copies are exploded and shuffled globally into the order of a hashed key: each partition takes an equal range of keys, so
no group meets in a task.

Defined cases: null source is a source of its own; null text has size 1 like empty text; rows alike in every hashed
column (doc_id, text) draw the same count; an empty table gives an empty result; a source without a target weight gets
share 0 and goes, so without any weight above 0 the result is empty; input columns named like one that ``mix`` makes give way
to it, ``replicate`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import by_place, keep_columns, small_or_plain

SEED = "mix-1"
#: Largest Poisson mean drawn at once; a larger rate is the sum of equal parts, each with a seed of its own.
PART_MEAN = 16.0
#: Steps of the inverted distribution: beyond mean 16 + 12 standard deviations the rest is below 1e-15.
STEPS = 80
#: Sources (under 1 KB each) whose steps may be broadcast; with more of them the join shuffles and splits hot sources.
BROADCAST_SOURCES = 20_000


def _unit(tag: F.Column) -> F.Column:
    """A uniform number in [0, 1) with 52 bits from an MD5 digest."""
    return F.conv(F.substring(F.md5(tag), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of each source's documents. Target shares are ``weights``, or size**alpha if None."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    per = docs.groupBy("source").agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        per = per.withColumn("weight", F.pow("size", F.lit(float(alpha))))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        per = per.withColumn("weight", F.coalesce(F.element_at(table, F.col("source")), F.lit(0.0)))
    total = lambda c: per.agg(F.sum(c)).scalar()
    share = F.coalesce(F.try_divide(F.col("weight"), total("weight")), F.lit(0.0))
    rate = F.lit(float(epochs)) * total("size") * share / F.col("size")
    return per.select("source", rate.alias("rate"))


def with_steps(rates: DataFrame) -> DataFrame:
    """Adds parts (how many draws make a count) and steps (the distribution function of one draw at 0, 1, 2, ...)."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.lit(STEPS)))
    each = rates.filter("rate > 0").select("source", "rate", parts.alias("parts"), k.alias("k"))
    log_fact = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0.0), lambda a, i: a + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    mean = F.col("rate") / F.col("parts")
    each = each.withColumn("p", F.exp(F.col("k") * F.log(mean) - mean - log_fact))
    up_to = F.sum("p").over(Window.partitionBy("source").orderBy("k"))
    pairs = F.array_sort(F.collect_list(F.struct("k", "c")))
    return each.withColumn("c", up_to).groupBy("source", "rate", "parts").agg(F.transform(pairs, lambda x: x["c"]).alias("steps"))


def _copied(docs: DataFrame, alpha: float, weights: dict[str, float] | None, epochs: float, seed: str) -> DataFrame:
    """The columns of docs named by place, then rate, copies, copy (from 1) and shuffle_key of every copy, in order of that key."""
    plain, at = by_place(docs)
    steps = with_steps(source_rates(docs, alpha, weights, epochs))
    steps = small_or_plain(steps, docs.select("source").distinct().count(), BROADCAST_SOURCES)
    tag = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), F.md5(F.coalesce(at["text"], F.lit(""))))
    rows = plain.withColumn("tag", tag).join(steps, F.col(at["source"]).eqNullSafe(F.col("source")))
    draw = lambda i: F.size(F.filter("steps", lambda c: c <= _unit(F.concat_ws("|", "tag", i.cast("string")))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, i: a + draw(i))
    rows = rows.withColumn("copies", copies).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws("|", "tag", F.lit("place"), F.col("copy").cast("string")))
    rows = rows.select(*plain.columns, "rate", "copies", "copy", key.alias("shuffle_key"))
    # The keys are uniform, so equal ranges need no sampling pass, which would draw all counts a second time.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n
    return rows.repartitionById(n, F.shiftright(place, 32).cast("int")).sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every copy of every document: its columns, rate, copies, copy (from 1) and shuffle_key, in order of that key."""
    made = ["rate", "copies", "copy", "shuffle_key"]
    kept = keep_columns(docs, made)
    return _copied(kept, alpha, weights, epochs, seed).toDF(*kept.columns, *made)


def replicate(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every copy of every document with the columns of docs alone, whatever their names, in shuffled order."""
    return _copied(docs, alpha, weights, epochs, seed).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
                  '{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS tag FROM documents),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size, pow(CAST(sum(size) AS DOUBLE), 0.5) AS weight FROM d GROUP BY source),
rates AS (SELECT source, (SELECT sum(size) FROM per) * weight / (SELECT sum(weight) FROM per) / size AS rate FROM per),
parted AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {PART_MEAN})) AS INT) AS parts FROM rates),
step AS (SELECT source, parts, k, sum(exp(k * ln(rate / parts) - rate / parts - lf)) OVER (PARTITION BY source ORDER BY k) AS c
         FROM parted, (SELECT k, sum(CASE WHEN k > 1 THEN ln(CAST(k AS DOUBLE)) ELSE 0 END) OVER (ORDER BY k) AS lf FROM range(0, {STEPS + 1}) t(k))),
steps AS (SELECT source, parts, list(c ORDER BY k) AS steps FROM step GROUP BY source, parts),
drawn AS (SELECT doc_id, d.source, d.size, tag, CAST(list_sum(list_transform(range(1, parts + 1),
            lambda i: len(list_filter(steps, lambda c: c <= CAST(CAST('0x' || substr(md5(tag || '|' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS INT) AS copies
          FROM d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, source, size, copies, CAST(copy AS INT) AS copy, md5(tag || '|place|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) WHERE copies > 0
"""


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, copies, copy and shuffle_key of every copy, in shuffled order."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return mix(docs.withColumn("size", size)).select("doc_id", "source", "size", "copies", "copy", "shuffle_key")
