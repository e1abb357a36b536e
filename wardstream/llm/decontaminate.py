"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least ``threshold`` of the item's distinct five-word shingles occur in
it (lower-case words, blanks apart; an item of fewer words is one shingle). Items are partitioned by size: an item of n
shingles is in class floor(log2 n), and its MinHash sketch has the length its size needs, its floor((1 - threshold) n)
+ 1 least shingle hashes. A document that contains the item misses at most floor((1 - threshold) n) shingles, so it must
hold one of the sketch's: the search over whole, long documents loses nothing, however small the item is beside the
document.

Classes are apart from end to end. Each has a bit filter of bounded size over its own items' shingles, which goes to the
executors. A document asks only the filters of the classes that it can contain an item of: those whose least item does not
need more shingles than the document has words for. What it shares with a class is written to the shared folder as rows of
that class; joins on class and sketch hash give the candidates, and joins on class and shingle count exactly what a
candidate holds of its item. The documents are read once.

Defined cases: null or wordless items match nothing and null texts contain nothing; repeated items and documents are
matched each; a document with several items gives a row for each; ids keep their types and may be null; empty tables give
empty results; columns other than the ids and texts are ignored (``decontaminate`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bit_filters, by_place, in_filter, materialise, small_or_plain
from .substring import mix, pair_name, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: Words hashed at once.
SLICE = 1 << 17
#: A class's filter has 2**FILTER_BITS bits at most (16 MB); there is a class for each doubling of the items' size.
FILTER_BITS = 27
#: Shingles of items that may be broadcast in a join.
BROADCAST_SHINGLES = 400_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    out = mix(words + np.uint64(k))
    for _ in range(k - 1):
        out = pair_name(out[:-1], words[len(words) - len(out) + 1 :])
    return out


def sketched(items: DataFrame, threshold: float, k: int) -> DataFrame:
    """One row for each item with words: i (its number), item_id, width, n_shingles, size_class, and its distinct shingles
    in the order of their hashes (shingles.h, shingles.g), of which the first ``sketch`` are the MinHash sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                if not words:
                    continue
                width = min(k, len(words))
                h = shingle_hashes(word_hashes(words), width).view(np.int64).tolist()
                found = {b" ".join(words[j : j + width]): x for j, x in enumerate(h)}
                order = sorted((x & (2**64 - 1), g) for g, x in found.items())
                n = len(order)
                signed = [{"h": x - (x >> 63 << 64), "g": g} for x, g in order]
                rows.append((i, item_id, width, n, n.bit_length() - 1, int((1 - threshold) * n + 1e-9) + 1, signed))
                i += 1
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), b.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("g", pa.binary())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["i", "item_id", "width", "n_shingles", "size_class", "sketch", "shingles"])

    made = f"i bigint, item_id {items.schema['item_id'].dataType.simpleString()}, width int, n_shingles bigint, size_class int, sketch bigint, shingles array<struct<h: bigint, g: binary>>"
    return items.select("item_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, made)


@dataclass(frozen=True)
class SizeClass:
    """Items of one width whose numbers of shingles lie between two powers of two; ``need`` is what the least of them needs."""

    c: int
    width: int
    need: int
    n: int


def askable(n_words: int, classes: Sequence[SizeClass]) -> list[SizeClass]:
    """The classes of which a document of n_words words can contain an item."""
    return [k for k in classes if n_words - k.width + 1 >= k.need]


def shared_shingles(docs: DataFrame, filters: dict[int, np.ndarray], classes: Sequence[SizeClass]) -> DataFrame:
    """(d, doc_id, t, n_words, c, h, g): each document's distinct shingles that the filter of class c lets through, for the
    classes that it can contain; d numbers the rows."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)  # at most 2**FILTER_BITS bits for each class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        d = TaskContext.get().partitionId() << 33
        for b in batches:
            row, size, of, names, texts = [], [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                words, found = tokens(text), {}
                asked = askable(len(words), classes)
                widths = sorted({k.width for k in asked})
                for at in range(0, len(words) if widths else 0, SLICE):
                    part = word_hashes(words[at : at + SLICE + widths[-1] - 1])
                    for w in widths:
                        if len(part) < w:
                            continue
                        h = shingle_hashes(part, w)
                        for k in asked:
                            if k.width == w:
                                for j in np.flatnonzero(in_filter(known[k.c], h)).tolist():
                                    found[k.c, b" ".join(words[at + j : at + j + w])] = h[j]
                row += [i] * len(found)
                size += [len(words)] * len(found)
                names += found.values()
                of += [c for c, _ in found]
                texts += [g for _, g in found]
            at = pa.array(row, pa.int64())
            h = pa.array(np.array(names, np.uint64).view(np.int64))
            made = [pa.array(np.array(row, np.int64) + d), b.column(0).take(at), b.column(1).take(at), pa.array(size, pa.int64()), pa.array(of, pa.int32()), h, pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["d", "doc_id", "t", "n_words", "c", "h", "g"])
            d += b.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"d bigint, doc_id {kind}, t bigint, n_words bigint, c int, h bigint, g binary")


def _matches(docs: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame | None:
    """(d, doc_id, t, item_id, n_shingles, n_shared) of every item contained in a document's row; None without items."""
    c = F.shiftleft("width", 6).bitwiseOR(F.col("size_class")).alias("c")
    held, _ = materialise(sketched(items, threshold, k).select("*", c), "leak-items")
    sized = held.groupBy("c", "width").agg(F.min("n_shingles").alias("least"), F.sum("n_shingles").alias("n")).collect()  # a row for each class
    if not sized:
        return None
    classes = [SizeClass(r["c"], r["width"], math.ceil(threshold * r["least"] - 1e-9), r["n"]) for r in sized]
    n = sum(x.n for x in classes)
    each = held.select("i", "item_id", "c", "n_shingles", F.explode("shingles").alias("s")).select("i", "item_id", "c", "n_shingles", "s.h", "s.g")
    # 128 bits a shingle: what passes by chance is under a hundredth.
    filters = bit_filters(each, "h", "c", {x.c: x.n << 4 for x in classes}, FILTER_BITS)
    hits, _ = materialise(shared_shingles(docs, filters, classes), "leak-hits")
    sketch = held.select("i", "n_shingles", "width", "c", F.explode(F.slice("shingles", F.lit(1), F.col("sketch").cast("int"))).alias("s"))
    sketch = small_or_plain(sketch.select("i", "c", "width", "n_shingles", "s.h"), n, BROADCAST_SHINGLES)
    need = F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))
    pairs = hits.join(sketch, ["c", "h"]).filter(F.col("n_words") - F.col("width") + 1 >= need).select("d", "i").distinct()
    pairs, _ = materialise(pairs, "leak-pairs")
    # A candidate's shingles, each met again in what its document shares with the item's class, are counted.
    wanted = pairs.join(small_or_plain(each, n, BROADCAST_SHINGLES), "i").select("d", "i", "item_id", "n_shingles", "c", "g")
    found = wanted.join(hits.select("d", "doc_id", "t", "c", "g"), ["d", "c", "g"])
    counted = found.groupBy("d", "i").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t"), F.first("item_id").alias("item_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_shared"))
    return counted.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every item contained in a document."""
    out = _matches(docs, items, threshold, k)
    if out is None:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id"))]
        out = docs.sparkSession.createDataFrame([], "doc_id {}, item_id {}, n_shingles bigint, n_shared bigint".format(*kinds))
    return out.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """The documents in which no item is contained, with their columns."""
    out = _matches(docs, items, threshold, k)
    if out is None:
        return docs
    gone, _ = materialise(out.select("doc_id", "t").distinct(), "leak-documents")
    gone = small_or_plain(gone, gone.count())
    plain, at = by_place(docs)
    kept = plain.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(at["text"]) == F.col("t")), "left_anti")
    return kept.toDF(*docs.columns)


#: Whole words as in tokens(); containment as counts, for items of five words or more and of fewer.
ORACLE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, least({WORDS}, len(w)) AS k FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
ks AS (SELECT DISTINCT k FROM n),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
c AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM si JOIN sd USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM m JOIN c USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles - 1e-9
"""
