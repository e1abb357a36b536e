"""Cross-entropy difference: target and background n-gram models over one vocabulary.

Both models are interpolated bigrams with the same smoothing. The shared vocabulary is every distinct word of all
documents, and every word pair has a count of its own: what is gathered grows with the corpus and nothing is capped.
All documents are counted: those of the target class in the target model, the others in the background model; the
background's counts are scaled to the target's number of words, so that smoothing weighs the same in both (matched
models). A document is judged by what all other rows teach: its own words and pairs are taken off the counts of the model
that it was counted in, and with ``leave_out_copies`` those of all its exact copies too. Without it a text that stands
twice is told by its losses, as the corpus does know it; with it copies are scored like texts that stand once. Its score is the mean over its words of the target loss minus the background loss, in nats:
lower is closer to the target.

The models are never held in one place. Documents are packed into blocks of about ``BLOCK_BYTES``. Each block sends the
words and pairs that occur in it, once each, as sorted 64-bit keys with their counts to buckets of the key space; a
bucket (about ``BUCKET_WORDS`` words' worth) adds up the counts of all blocks and answers each with the totals, in the
order it asked; the block then scores its documents. A word found everywhere costs a bucket one entry a block, so
frequent words and large groups of copies make no hot task.

Defined cases: null or wordless text has n_words 0 and null losses; with no target (or no background) documents that
model is uniform over the vocabulary; repeated rows are counted as often as they stand; a document named several times
among the targets counts once; an empty table gives an empty result; further columns are ignored. Two n-grams share a
count only where their 64-bit keys collide (for 10^11 n-grams about 300 pairs of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, small_or_plain, spread_join
from .substring import mix

#: Weight of the unigram estimate in a bigram estimate, in words.
PRIOR = 20.0
#: Text of one block (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Words of the corpus for each bucket of the key space; there are as many buckets as the corpus needs.
BUCKET_WORDS = 2_000_000
#: Stands before the first word of a document.
START = np.uint64(0x5354415254)

BLOCKS = "block bigint, doc_id array<{}>, target array<boolean>, hashes array<bigint>, length array<int>, texts binary, words0 bigint, words1 bigint, docs0 bigint, docs1 bigint"
COUNTS = "bucket int, block bigint, n_keys int, keys binary, counts binary"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def pack(column: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small numbers and small differences cost little."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, n).T).view("<u8").ravel()


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents (doc_id, text as bytes, target, hash of the text) packed into rows of about block_bytes, with their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held, size, made = [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, texts, target, hashes = zip(*held)
            words, full = [0, 0], [0, 0]
            for t, k in zip(texts, target):
                n = len((t or b"").split())
                words[k] += n
                full[k] += n > 0
            row = [first + made, list(ids), list(target), list(hashes), [len(t or b"") for t in texts], zstandard.compress(b"".join(t or b"" for t in texts), 3), *words, *full]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for b in batches:
            id_type = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and size + len(row[1] or b"") > block_bytes:
                    yield flush()
                    held, size, made = [], 0, made + 1
                held.append(row)
                size += len(row[1] or b"")
        if held:
            yield flush()

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return docs.mapInArrow(run, BLOCKS.format(docs.schema["doc_id"].dataType.simpleString()))


def block_keys(length: list[int], texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document of a block, and for each word its key (even) and that of its pair with the one before (odd)."""
    import xxhash
    import zstandard

    raw, at, known = zstandard.decompress(texts), 0, {}
    n, parts = np.zeros(len(length), np.int64), [np.zeros(0, np.uint64)]
    for i, size in enumerate(length):
        words = tokens(raw[at : at + size])
        at += size
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        n[i] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    word = np.concatenate(parts) & ~np.uint64(1)
    before = np.r_[START, word[:-1]][: len(word)]
    before[(np.cumsum(n) - n)[n > 0]] = START
    return n, word, mix(mix(before) + word) | np.uint64(1)


def requests(packed: DataFrame, n_buckets: int) -> DataFrame:
    """For each block and bucket: its keys, sorted, as differences, and the counts under background and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, word, pair = block_keys(r["length"], r["texts"])
                keys, place = np.unique(np.r_[word, pair], return_inverse=True)
                kind = np.tile(np.repeat(np.array(r["target"], bool), n), 2)
                counts = [np.bincount(place[kind == k], minlength=len(keys)) for k in (False, True)]
                bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)  # rises with the key
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist()):
                    if hi > lo:
                        row = [int(bucket[lo]), r["block"], hi - lo, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(np.r_[counts[0][lo:hi], counts[1][lo:hi]])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    names = [c.split()[0] for c in COUNTS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return packed.select("block", "target", "length", "texts").mapInArrow(run, COUNTS)


def answers(asked: DataFrame) -> DataFrame:
    """For each request the totals over all blocks, and (once a bucket) the number of distinct words in the bucket."""

    def run(table: pa.Table) -> pa.Table:
        size = table["n_keys"].to_pylist()
        keys, place = np.unique(np.concatenate([np.cumsum(unpack(k, n), dtype=np.uint64) for k, n in zip(table["keys"].to_pylist(), size)]), return_inverse=True)
        total, at = np.zeros((2, len(keys)), np.int64), 0
        for c, n in zip(table["counts"].to_pylist(), size):
            total[:, place[at : at + n]] += unpack(c, 2 * n).astype(np.int64).reshape(2, n)  # a request names a key once
            at += n
        ends = np.cumsum(size).tolist()
        found = [pack(total[:, place[e - n : e]].ravel()) for e, n in zip(ends, size)]
        words = [int((keys & np.uint64(1) == 0).sum())] + [0] * (len(size) - 1)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "n_keys": table["n_keys"], "totals": pa.array(found, pa.binary()), "n_words": pa.array(words, pa.int64())})

    return asked.groupBy("bucket").applyInArrow(run, "block bigint, bucket int, n_keys int, totals binary, n_words bigint")


def own_counts(doc: np.ndarray, at: np.ndarray, n_keys: int) -> np.ndarray:
    """For each word, how often its key stands in its own document."""
    _, place, count = np.unique(doc * n_keys + at, return_inverse=True, return_counts=True)
    return count[place]


def repeated(packed: DataFrame) -> DataFrame:
    """(block, again): for each block the places of its documents whose text stands several times, with the number of rows
    under background and target."""
    each = packed.select("block", F.posexplode(F.arrays_zip("hashes", "target", "length")).alias("place", "d")).filter("d.length > 0")
    each = each.select("block", "place", F.col("d.hashes").alias("h"), F.col("d.target").alias("target"))
    many = each.groupBy("h").agg(F.count_if(~F.col("target")).alias("m0"), F.count_if("target").alias("m1")).filter("m0 + m1 > 1")
    many, _ = materialise(many, "lm-copies")
    met = spread_join(each.select("block", "place", "h"), many, "h", many.count())
    return met.groupBy("block").agg(F.collect_list(F.struct("place", "m0", "m1")).alias("again"))  # the documents of one block


def scored(packed: DataFrame, totals: DataFrame, words: tuple[int, int], starts: tuple[int, int], vocabulary: int, id_type: str, leave_out_copies: bool) -> DataFrame:
    """Scores of the documents of each block by the totals sent back to it."""
    scale = (words[1] / words[0] if words[0] and words[1] else 1.0, 1.0)

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        n, word, pair = block_keys(r["length"], r["texts"])
        keys = np.unique(np.r_[word, pair])
        parts = [unpack(t, 2 * m).reshape(2, m) for _, t, m in sorted(zip(back["bucket"].to_pylist(), back["totals"].to_pylist(), back["n_keys"].to_pylist()))]
        total = np.concatenate([np.zeros((2, 0)), *parts], axis=1)  # in the order of keys
        at_word, at_pair = np.searchsorted(keys, word), np.searchsorted(keys, pair)
        doc = np.repeat(np.arange(len(n)), n)
        opens = (np.cumsum(n) - n)[n > 0]
        own_word, own_pair = (own_counts(doc, at, len(keys)) for at in (at_word, at_pair))
        target, loss = np.array(r["target"], bool), []
        rows = np.stack([~target, target]).astype(np.int64)  # how often each model holds a document's text
        for x in r.get("again") or ():
            rows[:, x["place"]] = x["m0"], x["m1"]
        for m in (0, 1):
            mine = rows[m][doc]
            count_word = (total[m][at_word] - mine * own_word) * scale[m]
            count_pair = (total[m][at_pair] - mine * own_pair) * scale[m]
            uni = (count_word + 1.0) / ((words[m] - mine * n[doc]) * scale[m] + vocabulary)
            context = np.r_[0.0, count_word[:-1]][: len(word)]
            context[opens] = (starts[m] - mine[opens]) * scale[m]
            each = -np.log((count_pair + PRIOR * uni) / (context + PRIOR))
            loss.append(np.bincount(doc, each, len(n)) / np.maximum(n, 1))
        none = n == 0
        return pa.table({
            "doc_id": block["doc_id"].combine_chunks().flatten(), "n_words": pa.array(n, pa.int64()),
            "target_loss": pa.array(loss[1], pa.float64(), mask=none), "background_loss": pa.array(loss[0], pa.float64(), mask=none),
        })

    asking = packed.select("block", "doc_id", "target", "length", "texts")
    if leave_out_copies:
        asking = asking.join(repeated(packed), "block", "left")
    out = asking.groupBy("block").cogroup(totals.select("block", "bucket", "n_keys", "totals").groupBy("block")).applyInArrow(run, f"doc_id {id_type}, n_words bigint, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def score(docs: DataFrame, targets: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS, leave_out_copies: bool = False) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of every document; targets has the doc_id of the target documents.

    leave_out_copies also takes the words of a document's exact copies off the counts that it is scored by.
    """
    named = targets.select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct()
    flag = small_or_plain(named, named.count())
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("text"), F.xxhash64("text").alias("h")).join(flag, F.col("doc_id") == F.col("__id"), "left")
    packed, _ = materialise(blocks(rows.select("doc_id", "text", F.col("__id").isNotNull().alias("target"), "h"), block_bytes), "lm-blocks")
    names = ("words0", "words1", "docs0", "docs1")
    words0, words1, docs0, docs1 = (int(v or 0) for v in packed.agg(*[F.sum(c) for c in names]).first())
    asked = requests(packed, max(1, -(-(words0 + words1) // bucket_words)))
    totals, _ = materialise(answers(asked), "lm-totals")
    vocabulary = int(totals.agg(F.sum("n_words")).first()[0] or 0)
    return scored(packed, totals, (words0, words1), (docs0, docs1), vocabulary, docs.schema["doc_id"].dataType.simpleString(), leave_out_copies)


def score_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; the target is what the labels call good (quality 1)."""
    return score(docs, labels.filter("quality = 1"))
