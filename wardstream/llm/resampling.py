"""Target-distribution importance resampling over hashed word n-grams, by an external sort-count.

Documents are tokenized once. Their features (runs of one to three words) are hashed to buckets, and the buckets are
written as packed uint16 streams, about ``BLOCK_FEATURES`` to a row, with the offset of every document. Counting sorts each
stream and run-length encodes it; the (bucket, count) pairs of all streams are added up by a map-side combined aggregation
of ``BUCKETS`` rows, the only thing the driver takes. The gain of a bucket is its scaled log ratio of target to source
frequency. Weights come from the streams again: gains are gathered by bucket and added up between document offsets with
``np.add.reduceat``. A Gumbel draw that follows from the document's id is added, and the highest scores are drawn: sampling
without replacement in proportion to the importance weights.

Ranks need no task that holds them all: eligible rows are dealt to tasks by ranges of (score, id) and sorted there, and a
row's rank is its place plus the sizes of the ranges before.

Defined cases: null or wordless text has no features and weight 0; without a target every gain rests on the added ones; a
null id draws by the text ``42:``, and is placed after all ids in a tie; rows alike in score and id are ranked in the order
of their blocks; repeated rows are counted and drawn as often as they stand; an empty table gives an empty result; further
columns are ignored. Words are lower-cased in A-Z only and end at every ASCII character that is no letter or digit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Features are hashed to so many buckets (fixed: they fit 16 bits).
BUCKETS = 10_000
#: Features of one stream (a longer document is a stream of its own).
BLOCK_FEATURES = 2_000_000
#: Rows of one range of the ranking.
RANGE_ROWS = 2_000_000
#: Fewest words of a document that can be drawn, and how many of them in a hundred are.
LEAST_WORDS, PERCENT = 20, 5

#: Lower case, and a space for every byte that ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets_of(text: bytes | None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to three words (checksums go on from word to word)."""
    words = (text or b"").translate(_FOLD).split()
    after = [b" " + w for w in words]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, after[1:], one))
    three = list(map(zlib.crc32, after[2:], two))
    every = one + two + three
    return len(words), (np.fromiter(every, np.uint32, len(every)) % BUCKETS).astype("<u2")


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_features: int = BLOCK_FEATURES) -> DataFrame:
    """Rows (block, ids, n_words, ends, stream): the bucket streams of consecutive documents and where each document ends."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, ends, parts, size, made = [], [], [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            id_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, stream = buckets_of(text)
                if ids and (size + len(stream) > block_features or len(ids) >= block_features):
                    yield row(id_type, made, ids, words, ends, parts)
                    ids, words, ends, parts, size, made = [], [], [], [], 0, made + 1
                size += len(stream)
                ids.append(key)
                words.append(n)
                ends.append(size)
                parts.append(stream)
        if ids:
            yield row(id_type, made, ids, words, ends, parts)

    def row(id_type: pa.DataType, block: int, ids: list, words: list, ends: list, parts: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        values = [block, ids, words, ends, np.concatenate(parts).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "ids", "n_words", "ends", "stream"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.encode(f"`{text_col}`", "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, n_words array<int>, ends array<bigint>, stream binary")


def bucket_counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket stands in all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                x = np.sort(np.frombuffer(raw, "<u2"))
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[first].astype(np.int32)), pa.array(np.diff(np.r_[first, len(x)]).astype(np.int64))], ["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        total[r["bucket"]] = r["n"]
    return total


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source frequency of each bucket, one added to every count, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight (sum of its features' gains), block and place of every document."""
    kind = streams.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, ids, words, ends, raw = (b.column(k).slice(i, 1) for k in range(5))
                stop = ends.flatten().to_numpy()
                start = np.r_[0, stop[:-1]]
                some, total = start < stop, np.zeros(len(stop), np.int64)
                if some.any():  # starts of the others would repeat; what lies between the rest is theirs
                    total[some] = np.add.reduceat(gains[np.frombuffer(raw[0].as_py(), "<u2")], start[some])
                yield pa.RecordBatch.from_arrays(
                    [ids.flatten(), words.flatten(), pa.array(stop - start), pa.array(total), pa.array(np.full(len(stop), block[0].as_py())), pa.array(np.arange(len(stop)))],
                    ["id", "n_words", "n_features", "weight", "block", "place"],
                )

    return streams.select("block", "ids", "n_words", "ends", "stream").mapInArrow(run, f"id {kind}, n_words int, n_features bigint, weight bigint, block bigint, place bigint")


def with_scores(rows: DataFrame, seed: int) -> DataFrame:
    """rows with score: the weight plus a Gumbel draw, in thousandths, that follows from seed and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def with_ranks(rows: DataFrame, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The n rows with place_in_all (from 1) by falling score, then id, then block and place."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("block"), F.asc("place")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed, _ = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "resampling-ranges")  # range << 33 | place in it
    before, sizes = [], 0
    for r in placed.groupBy(F.shiftright("at", 33).alias("range")).count().orderBy("range").collect():  # a row for each range
        before.append((r["range"], sizes))
        sizes += r["count"]
    opens = F.broadcast(spark.createDataFrame(before, "range bigint, before bigint"))
    placed = placed.join(opens, F.shiftright("at", 33) == F.col("range"))
    return placed.withColumn("place_in_all", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("range", "before", "at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document; the drawn have ranks from 1, the others null.

    Drawn are percent in a hundred (rounded down) of the documents with at least least_words words.
    """
    streams, _ = materialise(packed(docs, id_col, text_col, block_features), "resampling-streams")
    wanted = packed(target.withColumn(id_col, F.lit(0)).select(id_col, F.col(f"`{target_text}`").alias(text_col)), id_col, text_col, block_features)
    scored, _ = materialise(with_scores(weights(streams, gains_of(bucket_counts(streams), bucket_counts(wanted))), seed), "resampling-scores")
    eligible = scored.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    out = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    if n:
        rank = F.when(F.col("place_in_all") <= percent * n // 100, F.col("place_in_all"))
        out = out.unionByName(with_ranks(eligible, n).withColumn("rank", rank).drop("place_in_all"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def resampling_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the texts of the benchmark."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
