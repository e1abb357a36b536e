"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in partitions (files of a scratch table). How many rows of each partition go to each shard is drawn from
the multivariate hypergeometric law with the shards' exact sizes as column sums, so the matrix is distributed as that
of a uniform shuffle. Each partition then permutes its rows and deals them out by its row of the matrix; the rows are
exchanged, and permuted again within their shard. Shard sizes differ by at most one (law ``rows``).

A partition's permutation is a function of (seed, ordinal of the partition, row index), so a task that is run again after
the loss of an executor deals out the same rows, and a rerun over the same files gives the same slots. No task holds a
shard: a shard is ordered in blocks of random keys, bounded in rows and in bytes.

Defined cases: null text counts no bytes; repeated rows are rows of their own; an empty table gives an empty result;
with fewer rows than shards the last shards stay empty; input columns named like a made one give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import keep_columns, map_arrow, materialise

#: Rows of one partition of the matrix, which one task permutes.
PARTITION_ROWS = 1_000_000
#: Rows of a shard, and bytes of its part of the scratch table (compressed), that are ordered together.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 32_000_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn without replacement; numpy's draw, and inversion from the mode beyond its range."""
    if max(good, bad) < 10**9 and good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good else 0
    lo, hi = max(0, sample - bad), min(sample, good)
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    ln = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return ln(n + 1) - ln(k + 1) - ln(n - k + 1)

    at_mode = math.exp(log_choose(sample, mode) + _log_falling(good, mode) + _log_falling(bad, sample - mode) - _log_falling(good + bad, sample))
    left, right, p_left, p_right, u = mode, mode, at_mode, at_mode, rng.random() - at_mode
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) / (right + 1) * (sample - right) / (bad - sample + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left / (good - left + 1) * (bad - sample + left) / (sample - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def _log_falling(n: int, k: int) -> float:
    """log(n (n-1) ... (n-k+1)), accurate for k far below n."""
    if not k:
        return 0.0
    if n < 10**6:
        return math.lgamma(n + 1) - math.lgamma(n - k + 1)
    i = np.arange(k, dtype=np.float64)
    return float(k * math.log(n) + np.log1p(-i / n).sum())


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each partition (by its size) for each shard; column sums differ by at most one."""
    total, rng = sum(sizes), np.random.default_rng(seed)
    left = [total // shards + (k < total % shards) for k in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for p, n in enumerate(sizes):
        rest = sum(left)
        for k in range(shards):
            rest -= left[k]
            out[p, k] = draw_hypergeometric(rng, left[k], rest, n)
            n -= out[p, k]
        left = [a - int(b) for a, b in zip(left, out[p])]
    return out


def shard(
    df: DataFrame, shards: int = 16, seed: int = 11, block_rows: int = BLOCK_ROWS, partition_rows: int = PARTITION_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All rows and columns of df with ``shard`` (0 to shards-1) and ``slot`` (place in the shard, gapless from 0)."""
    spark = df.sparkSession
    kept = keep_columns(df, ["shard", "slot", "__file", "__row", "__key", "__block", "__start"])
    table, _ = materialise(kept, "shard", partition_rows)
    rows = table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    found = table.groupBy("_metadata.file_name").agg(F.count("*"), F.first("_metadata.file_size")).collect()  # two numbers per partition
    sizes, n_bytes = {r[0]: r[1] for r in found}, sum(r[2] for r in found)
    names = sorted(sizes)  # in the order of Spark's partitions
    matrix = communication_matrix([sizes[n] for n in names], shards, seed)
    plan = spark.sparkContext.broadcast({n: (p, matrix[p].astype(np.int64)) for p, n in enumerate(names)})
    at = len(kept.columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, dest = None, None
        for b in batches:
            files, index = b.column(at), b.column(at + 1).to_numpy(zero_copy_only=False)
            made = np.empty(b.num_rows, np.int32)
            distinct = files.unique().to_pylist()
            each = None if len(distinct) == 1 else np.array(files.to_pylist(), dtype=object)
            for f in distinct:
                if f != name:
                    p, counts = plan.value[f]
                    dest = np.random.default_rng([seed, p]).permutation(np.repeat(np.arange(shards, dtype=np.int32), counts))
                    name = f
                mine = slice(None) if each is None else each == f
                made[mine] = dest[index[mine]]
            place = pa.array(np.full(b.num_rows, plan.value[distinct[0]][0], np.int64) if each is None else [plan.value[f][0] for f in each.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], place, b.column(at + 1), pa.array(made)], [*b.schema.names, "shard"])

    def dealt(frame: DataFrame) -> DataFrame:
        ordinal = T.StructField("__file", T.LongType())
        out = map_arrow(frame, deal, T.StructType([*frame.schema.fields[:at], ordinal, frame.schema.fields[at + 1], T.StructField("shard", T.IntegerType())]))
        key = F.xxhash64(F.lit(seed), "__file", "__row")
        blocks = max(1, math.ceil(sum(sizes.values()) / shards / block_rows), math.ceil(n_bytes / shards / block_bytes))
        return out.withColumn("__key", key).withColumn("__block", F.expr(f"cast(floor(shiftrightunsigned(__key, 33) / 2147483648D * {blocks}) as int)"))

    def counted() -> DataFrame:
        nonlocal at
        return dealt(rows.select(*[F.lit(None).cast("int").alias(f"__{i}") for i in range(at)], "__file", "__row"))

    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted().groupBy("shard", "__block").count().select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    order = Window.partitionBy("shard", "__block").orderBy("__key", "__file", "__row")
    placed = dealt(rows).withColumn("slot", F.row_number().over(order).cast("long") - 1)
    slot = (F.col("slot") + F.col("__start")).alias("slot")
    return placed.join(starts, ["shard", "__block"]).select(*[f"`{c}`" for c in kept.columns], "shard", slot)


def utf8_size(text: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; null text has the CRC of no bytes."""
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    narrow = docs.select("doc_id", utf8_size().alias("size"), crc.alias("text_crc32"))
    out = shard(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["communication_matrix", "draw_hypergeometric", "shard", "shard_digest"]
