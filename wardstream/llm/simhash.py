"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared exactly: numpy exclusive-or and bit counts over tiles sorted by population count, and a
tile pair is skipped when the population counts in it differ by more than the radius. So that the work does not grow
with the square of the corpus, tiles are first formed by the pigeonhole rule: of ``radius + c`` segments of the
fingerprint at least ``c`` must agree between two linked fingerprints, so every linked pair meets in a tile of equal
segments. No link is lost: each tile is compared in full, and an oversized one is dealt out as a grid of tile pairs.
Where links are by a similarity of word shingles instead of a radius (``deduplicate``), ``_similar`` forms the tiles.

Defined cases: null or wordless text has fingerprint zero, linked like any other; a null doc_id keeps its row and
never names a component; repeated rows all come back; an empty table gives an empty result; columns other than the
id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _similar
from ._common import by_place, connected_components, materialise, spread_join

SEED = 42
#: Rows of one tile that a single task compares; a larger tile becomes a grid of tile pairs.
TILE_ROWS = 20_000
#: Edge of the numpy comparison square.
SQUARE = 512
#: Shingles hashed at once, which bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint_bytes(data: bytes | None, width: int) -> int:
    """64-bit SimHash of the word shingles of data (UTF-8), as a signed integer."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        s, e = starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()
        h = np.array([digest(line[i:j], SEED) for i, j in zip(s, e)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the signed 64-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint_bytes(x, width) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


def segment_masks(radius: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` among ``radius + agree`` near-equal segments of 64 bits, signed."""
    cuts = [round(64 * i / (radius + agree)) for i in range(radius + agree + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(parts, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def segments_for(n: int, radius: int) -> int:
    """Fewest agreeing segments whose tiles hold a few thousand of n evenly spread fingerprints."""
    agree = 1
    while n >> (64 * agree // (radius + agree)) > 4096 and agree < 4:
        agree += 1
    return agree


class Forest:
    """Union-find over positions, smallest value as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, pairs) -> None:
        for i, j in pairs:
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def squares(pop: np.ndarray, radius: int, edge: int = SQUARE) -> Iterator[tuple[int, int]]:
    """Corners of the tile pairs to compare, for population counts in order; the rest differ beyond the radius."""
    for a in range(0, len(pop), edge):
        for b in range(a, len(pop), edge):
            if pop[b] - pop[min(a + edge, len(pop)) - 1] > radius:
                break  # later tiles differ even more
            yield a, b


def link_tile(v: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct fingerprint of one tile, sorted by population count, the position of its group's root."""
    n, forest, label = len(v), Forest(len(v)), np.arange(len(v))
    for a, b in squares(np.bitwise_count(v).astype(np.int64), radius):
        near = np.bitwise_count(v[a : a + SQUARE, None] ^ v[None, b : b + SQUARE]) <= radius
        i, j = np.nonzero(near)
        i, j = i + a, j + b
        first = np.unique(i, return_index=True)[1]
        forest.join(zip(i[first].tolist(), j[first].tolist()))
        label = np.fromiter(map(forest.find, range(n)), np.int64, n) if len(i) > len(first) + SQUARE else label
        rest = label[i] != label[j]
        forest.join(zip(i[rest].tolist(), j[rest].tolist()))
    return np.fromiter(map(forest.find, range(n)), np.int64, n)


def small_hits(tile: np.ndarray, values: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places, d) of rows within the radius of the d-th row after them in their tile, all small tiles side by side.

    Rows of a tile are sorted by population count: a row is done when the next one's differs beyond the radius.
    """
    pop, d = np.bitwise_count(values).astype(np.int64), 1
    while len(at):
        at = at[at + d < len(values)]
        at = at[(tile[at] == tile[at + d]) & (pop[at + d] - pop[at] <= radius)]
        yield at[np.bitwise_count(values[at] ^ values[at + d]) <= radius], d
        d += 1


def link_tiles(tile: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of all linked groups, for rows sorted by tile and population count."""
    values = fp.view(np.uint64)
    cut = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
    sizes = np.diff(cut)
    small = np.repeat(sizes <= 64, sizes)
    forest, left, right = Forest(len(fp)), [], []
    for hit, d in small_hits(tile, values, np.flatnonzero(small), radius):
        forest.join(zip(hit.tolist(), (hit + d).tolist()))
    for i in np.flatnonzero(sizes > 64):
        lo, hi = cut[i], cut[i + 1]
        root = link_tile(values[lo:hi], radius)
        far = np.flatnonzero(root != np.arange(hi - lo))
        left.append(fp[lo:hi][far])
        right.append(fp[lo:hi][root[far]])
    moved = [(i, forest.find(i)) for i in np.flatnonzero(small).tolist() if forest.up[i] != i]
    left.append(fp[[i for i, _ in moved]] if moved else fp[:0])
    right.append(fp[[r for _, r in moved]] if moved else fp[:0])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, n: int, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that span every group of distinct fingerprints within the radius of each other."""
    masks = segment_masks(radius, segments_for(n, radius))
    keys = F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("tile"))
    # An oversized tile becomes a grid of g cells by hash; each pair of cells is a tile of its own.
    grid = rows.groupBy("tile").count().filter(F.col("count") > tile_rows)
    grid = grid.select("tile", F.ceil(2 * F.col("count") / tile_rows).cast("int").alias("g"))
    x = F.expr("cast(pmod(xxhash64(fp), g) as int)")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("g") - 1), lambda y: F.xxhash64("tile", F.least(x, y), F.greatest(x, y))
    )
    tiles = F.when(F.col("g").isNull(), F.array("tile")).otherwise(pairs)
    dealt = rows.join(grid, "tile", "left").select(F.explode(tiles).alias("tile"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held_t = np.concatenate([held_t, b.column(0).to_numpy(zero_copy_only=False)])
                held_f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False)])
                if not len(held_t):
                    continue
                cut = int(np.searchsorted(held_t, held_t[-1], "left"))  # the last tile may go on
            else:
                cut = len(held_t)
            if cut:
                left, right = link_tiles(held_t[:cut], held_f[:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])
                held_t, held_f = held_t[cut:], held_f[cut:]

    return dealt.repartition("tile").sortWithinPartitions("tile", F.bit_count("fp")).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of at most radius bits)."""
    fps, _ = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct, _ = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    nodes, _ = connected_components(links(distinct.select("fp"), distinct.count(), radius), "a", "b")
    named = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    best = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps.join(named.join(best, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The documents with one row kept of each group of near copies: that of the smallest doc_id, null ids last.

    Links are by the similarity of word shingles, or by the radius of fingerprints if one is given. Decided for each row
    by its doc_id and text: rows that only share a doc_id are different documents; of rows alike in both one stays.
    """
    plain, at = by_place(docs)
    named = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    if radius is None:
        groups = _similar.components(named, similarity=similarity, width=width)
    else:
        fps, _ = materialise(fingerprints(named.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h"))), width=width), "simhash")
        distinct, _ = materialise(fps.select("fp").distinct(), "simhash-distinct")
        nodes, _ = connected_components(links(distinct, distinct.count(), radius), "a", "b")
        groups = fps.join(nodes, F.col("fp") == F.col("node"), "left").select("doc_id.doc_id", "doc_id.h", F.coalesce("root", "fp").alias("component"))
    found, _ = materialise(groups, "simhash-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")
    best = found.groupBy("component").agg(F.min(rank).alias("best"), F.count("*").alias("m")).filter("m > 1").select("component", "best")
    best, _ = materialise(best, "simhash-best")
    gone = spread_join(found, best, "component", best.count()).filter(~rank.eqNullSafe(F.col("best"))).select("doc_id", "h").distinct()
    h = F.xxhash64(at["text"])
    kept = plain.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (h == F.col("h")), "left_anti")
    if found.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("h", h).dropDuplicates([at["doc_id"], "h"]).drop("h")
    return kept.toDF(*docs.columns)
