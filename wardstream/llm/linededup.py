"""Boilerplate lines by the spread of distinct sites, in DataFrame operations only.

A line (trimmed, not blank) that stands in documents of ``min_sites`` or more distinct sources is boilerplate and goes
from every document. Per line hash a HyperLogLog sketch of the sources is aggregated straight from the lines (sketches
merge map-side). An estimate far below or above the threshold decides; only lines near it get their exact distinct
count. Lines are known by two 64-bit hashes.

Defined cases: null text has no lines and stays null; a null source is a site of its own; blank lines are never
boilerplate; repeated rows count their source once; an empty table gives an empty result; a line in every document is
counted by partial aggregates, its rows joined by a shuffle that splits hot keys; input columns named n_lines,
n_removed or kept_text (in any case) give way to those made, and all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, keep_columns, materialise, small_or_plain

MIN_SITES = 5
#: log2 of the sketch's buckets: a relative standard error near 5 %.
LG_BUCKETS = 9
#: Estimates within this factor of the threshold are counted exactly: over ten standard errors.
BAND = 2.0
WHITE = " \t\r\x0b\x0c"


def _line_keys(docs: DataFrame) -> DataFrame:
    """(h1, h2, site) of every line that is not blank, once per document."""
    bare = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    keyed = F.transform(F.array_distinct(bare), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    lines = docs.select(F.explode(keyed).alias("k"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("site"))
    return lines.select("k.h1", "k.h2", "site")


def line_spread(docs: DataFrame) -> DataFrame:
    """(h1, h2, est): estimated number of distinct sites of every line that is on more than one.

    Most lines are on one site, which the least and the largest site of a line tell; they get no sketch.
    """
    lines = _line_keys(docs)
    several = lines.groupBy("h1", "h2").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a <> b").select("h1", "h2")
    several, _ = materialise(several, "line-several")
    several = small_or_plain(several, several.count(), BROADCAST_ROWS // 4)
    sketch = lines.join(several, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_BUCKETS)).alias("s"))
    return sketch.select("h1", "h2", F.hll_sketch_estimate("s").alias("est"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines found on min_sites or more distinct sources."""
    spread, _ = materialise(line_spread(docs).filter(F.col("est") >= min_sites / BAND), "line-spread")
    sure = spread.filter(F.col("est") > min_sites * BAND).select("h1", "h2")
    near = spread.filter(F.col("est") <= min_sites * BAND).select("h1", "h2")
    near = small_or_plain(near, near.count(), BROADCAST_ROWS // 4)
    exact = _line_keys(docs).join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n"))
    return sure.union(exact.filter(F.col("n") >= min_sites).select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with n_lines, n_removed and kept_text in place of boilerplate lines."""
    found, _ = materialise(boilerplate_lines(docs, min_sites), "boilerplate")
    found = small_or_plain(found, found.count(), BROADCAST_ROWS // 4)
    kept = keep_columns(docs, ["n_lines", "n_removed", "kept_text", "__id", "__key", "__cut"])
    bare = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    keyed = F.transform(bare, lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), (x == "").alias("blank")))
    lines = docs.filter("text is not null").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), F.explode(keyed).alias("k"))
    hits = lines.filter(~F.col("k.blank")).select("__id", "__key", "k.i", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    hits = hits.join(found, ["h1", "h2"], "left_semi")
    cut = hits.groupBy("__id", "__key").agg(F.collect_set("i").alias("__cut"))
    both = kept.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    none = F.array().cast("array<int>")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("__cut", none), i))
    return both.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(left, "\n").alias("kept_text"),
    )


def line_dedup_digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the kept text of every document."""
    out = remove_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
           FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
b AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, 'null')) >= {MIN_SITES}),
m AS (SELECT t.*, b.bare IS NOT NULL AS gone FROM t LEFT JOIN b ON t.bare = b.bare)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""

__all__ = ["boilerplate_lines", "line_dedup_digest", "remove_boilerplate"]
