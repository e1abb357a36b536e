"""Removal of long repeated word sequences by recompression.

Rounds of naming shorten each document: runs of one word get a name, then, round by round, adjacent pairs whose left
member falls in the round's left class and whose right member falls in the right class. Names are hashes of what they
stand for, so they agree across documents without coordination, and whether two symbols merge depends on them alone:
equal word sequences therefore get the same symbols inside, whatever surrounds them. Each symbol carries the span of
words its existence depends on. A window of ``width`` words takes as its anchor the symbol of least hash among the
highest-level symbols whose span lies in the window: a function of the window's words alone, so equal windows have
equal anchors, and only windows whose anchor occurs again can be repeats. These few are named in full (a hash over
their words, beside the 64-bit anchor) and the earliest place of each name is found; later ones are removed.

Whole copies of a document are set aside first. The shuffles carry one anchor for about eight words, the windows with
repeated anchors, and the text once. Repeats within a batch are settled there, and anchors in very many places are
dealt out by window, so no task gathers a frequent passage.

Defined cases: null text has no words; a document under ``width`` words loses nothing; rows with equal doc_id and text
are one document and get equal results; rows with one doc_id and different texts are ordered by a hash of the text; a
null doc_id (and the id 2**63 - 1, which is reserved) comes after all others and is returned as null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, small_or_plain, spread_join

WIDTH = 20
#: Rounds of pair naming after the naming of runs.
ROUNDS = 3
#: Words parsed at once; a longer document is parsed in slices that overlap by width - 1 words.
SLICE = 1 << 17
#: Places of an anchor beyond which its windows are dealt out one by one.
HOT = 2_000
LAST = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _A + mix(y + _B))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def parse(sym: np.ndarray, fence: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels, highest first, of (name, lo, hi): symbols and the places their existence depends on.

    ``fence`` marks places between documents, whose symbols merge with nothing; the first and last place are fences.
    """
    n = len(sym)
    first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | fence[1:] | fence[:-1]])
    count = np.diff(np.r_[first, n])
    name = np.where(count > 1, pair_name(sym[first], count.astype(np.uint64)), sym[first])
    lo, hi, fence = np.maximum(first - 1, 0), np.minimum(first + count, n - 1), fence[first]
    levels = []
    for r in range(ROUNDS):
        left = (mix(name + np.uint64((r + 1) * int(_B) % 2**64)) & np.uint64(1)).astype(bool)
        merge = left[:-1] & ~left[1:] & ~fence[:-1] & ~fence[1:]
        begins, ends = np.r_[merge, False], np.r_[False, merge]
        # A single left symbol depends on what follows it, a single right symbol on what precedes it.
        lo2 = np.where(~left & ~ends, np.r_[lo[:1], lo[:-1]], lo)
        hi2 = np.where(left & ~begins, np.r_[hi[1:], hi[-1:]], hi)
        at = np.flatnonzero(begins)
        fresh = name.copy()
        fresh[at] = pair_name(name[at], name[at + 1])
        lo2[at], hi2[at] = lo[at], hi[at + 1]
        stay = ~ends
        name, lo, hi, fence = fresh[stay], lo2[stay], hi2[stay], fence[stay]
        levels.append((name, lo, hi))
    return levels[::-1]


def window_names(sym: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` symbols from each place on, built from names of pairs of blocks of doubling length."""
    n, out, at, block, size = len(sym), None, 0, sym, 1
    while size <= width:
        if width & size:
            part = block[at : at + n - width + 1]
            out = part if out is None else pair_name(out, part)
            at += size
        if size * 2 <= width:
            block = pair_name(block[:-size], block[size:])
        size *= 2
    return out


_BASE = int(_A)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_names(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words from lo to hi, both included."""
    up_to = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sym) * _powers(_BASE, len(sym)), dtype=np.uint64)])
    return pair_name((up_to[hi + 1] - up_to[lo]) * _powers(_INVERSE, len(sym))[lo], (hi - lo).astype(np.uint64))


def anchors(sym: np.ndarray, fence: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Name and place (an identity of the occurrence) of the anchor of the window at each of the sorted starts.

    The name stands for all words of the anchor's span, not the symbol's alone, so that few anchors recur by chance.
    """
    name, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for level, (names, lo, hi) in enumerate(parse(sym, fence)):
        if not len(todo):
            break
        a = np.searchsorted(lo, starts[todo], "left")
        b = np.searchsorted(hi, starts[todo] + width - 1, "right")
        good = b > a
        a, b, mine = a[good], b[good], todo[good]
        todo = todo[~good]
        if not len(mine):
            continue
        power = np.frexp((b - a).astype(np.float64))[1] - 1
        best, span = np.arange(len(names)), span_names(sym, lo, hi)
        for k in range(int(power.max()) + 1):
            use = power == k
            x, y = best[a[use]], best[b[use] - (1 << k)]
            pick = np.where(names[x] <= names[y], x, y)
            name[mine[use]], place[mine[use]] = span[pick], (level << 40) + pick
            x, y = best[: len(best) - (1 << k)], best[1 << k :]
            best = np.where(names[x] <= names[y], x, y)
    if len(todo):  # no symbol lies inside: the window is its own anchor
        whole = window_names(sym, width)
        name[todo], place[todo] = mix(whole[starts[todo]] + _A), (99 << 40) + starts[todo]
    return name, place


class Group:
    """Word arrays of several documents (or slices of them) side by side, with a fence around each."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.doc: list[int] = []
        self.base: list[int] = []
        self.size = 0

    def add(self, doc: int, base: int, h: np.ndarray) -> None:
        self.parts.append(h)
        self.doc.append(doc)
        self.base.append(base)
        self.size += len(h)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sym, starts (places in sym), doc, start in the document, and fence."""
        sizes = np.array([len(p) for p in self.parts])
        begin = np.cumsum(sizes + 1) - sizes
        sym = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.uint64)
        fence = np.ones(len(sym), bool)
        for p, at in zip(self.parts, begin.tolist()):
            sym[at : at + len(p)] = p
            fence[at : at + len(p)] = False
        n = np.maximum(sizes - width + 1, 0)
        which = np.repeat(np.arange(len(n)), n)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return sym, begin[which] + off, np.array(self.doc)[which], np.array(self.base)[which] + off, fence


def groups(texts: list[bytes | None], width: int) -> Iterator[Group]:
    out = Group()
    for i, t in enumerate(texts):
        words = (t or b"").split()
        if len(words) < width:
            continue
        for at in range(0, len(words) - width + 1, SLICE):
            out.add(i, at, word_hashes(words[at : at + SLICE + width - 1]))
            if out.size >= SLICE:
                yield out
                out = Group()
    if out.parts:
        yield out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where any column differs from the one before (the first included)."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """List array of n lists; values are sorted by owner."""
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _survey(width: int):
    """Per document: words, signature of all words, anchors met once and anchors met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            texts = b.column(2).to_pylist()
            names, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for g in groups(texts, width):
                sym, starts, doc, _, fence = g.windows(width)
                name, place = anchors(sym, fence, starts, width)
                at = _changes(doc, place)
                names.append(name[at])
                owners.append(doc[at])
            name, owner = np.concatenate(names), np.concatenate(owners)
            order = np.lexsort((name, owner))
            name, owner = name[order], owner[order]
            at = _changes(owner, name)
            twice = np.diff(np.r_[at, len(name)]) > 1
            split = [(t or b"").split() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array([xxh3_128_digest(b" ".join(w)) for w in split], pa.binary()),
                    _lists(name[at[~twice]], owner[at[~twice]], len(texts)), _lists(name[at[twice]], owner[at[twice]], len(texts)),
                ],
                ["d", "t", "n_words", "sig", "once", "again"],
            )

    return run


def _candidates(width: int):
    """Windows with repeated anchors: rows (key, d, t, start, n, hashes); without hashes, n starts known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts, named, hot = b.column(2).to_pylist(), b.column(3), b.column(4)
            rank = np.empty(len(d), np.int64)
            rank[np.lexsort((t, d))] = np.arange(len(d))
            for g in groups(texts, width):
                sym, starts, doc, start, fence = g.windows(width)
                name, place = anchors(sym, fence, starts, width)
                mine = np.unique(g.doc)
                known, many = (pa.concat_arrays([c.take(pa.array(mine)).flatten()]).to_numpy(zero_copy_only=False).view(np.uint64) for c in (named, hot))
                on = np.isin(name, known)
                if not on.any():
                    continue
                whole = window_names(sym, width)[starts[on]]
                name, place, doc, start = name[on], place[on], doc[on], start[on]
                order = np.lexsort((start, rank[doc], name, whole))
                later = np.ones(len(order), bool)
                later[order[_changes(whole[order], name[order])]] = False
                single = np.isin(name, many)
                # Runs of windows of one anchor place; windows of a frequent anchor stand alone.
                lone = np.where(single & ~later, np.arange(len(name)), -1)
                at = _changes(doc, place, later, start - np.arange(len(start)), lone)
                n = np.diff(np.r_[at, len(name)])
                gone = later[at]
                key = np.where(single[at], mix(name[at] + whole[at] * _A), name[at])
                key = np.where(gone, mix(doc[at].astype(np.uint64) + start[at].astype(np.uint64) * _B), key)
                sent = np.repeat(~gone, n)
                owner = np.repeat(np.arange(len(at)), n)[sent]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(d[doc[at]]), pa.array(t[doc[at]]), pa.array(start[at].astype(np.int32)), pa.array(n.astype(np.int32)), _lists(whole[sent], owner, len(at))],
                    ["key", "d", "t", "start", "n", "hashes"],
                )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and place: (d, t, start, n), the runs of windows that came before."""
    last, seen = None, np.empty(0, np.int64)  # the key at the end of the batch before, and its windows so far
    for b in batches:
        if not b.num_rows:
            continue
        key, start, count, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5)
        size = np.diff(lists.offsets.to_numpy())
        window = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(key)), size)
        order = np.lexsort((window, key[row]))  # stable: places stay in order
        later = np.ones(len(window), bool)
        later[order[_changes(key[row][order], window[order])]] = False
        if last == key[0]:
            later |= (key[row] == last) & np.isin(window, seen)
        ends = window[key[row] == key[-1]]
        seen = np.union1d(seen, ends) if last == key[-1] else np.unique(ends)
        last = key[-1]
        spot = np.flatnonzero(later)
        at = _changes(row[spot], spot - np.arange(len(spot)))
        first = spot[at]
        known = np.flatnonzero(size == 0)  # without hashes: repeats already
        source = np.r_[row[first], known]
        begin = np.r_[start[row[first]] + first - (np.cumsum(size) - size)[row[first]], start[known]]
        n = np.r_[np.diff(np.r_[at, len(spot)]), count[known]]
        take = pa.array(source)
        yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))], ["d", "t", "start", "n"])


def covered(n_words: int, runs: list[tuple[int, int]], width: int) -> np.ndarray:
    """Mask of the words in windows that start in the runs (start, count)."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, count in runs:
        edge[start] += 1
        edge[min(start + count - 1 + width, n_words)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for text, copy, runs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or b"").split()
                total = len(words)
                if copy and total >= width:
                    words = []
                elif runs:
                    mask = covered(total, [(r["start"], r["n"]) for r in runs], width)
                    words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                kept = b" ".join(words)
                counts.append(total), removed.append(total - len(words)), digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace") if with_text else None)
            made = [b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(made[: 5 if with_text else 4], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (words joined by one space) of every document."""
    unique = not docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    rows = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("d"),
        (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("t"),
        F.encode("text", "UTF-8").alias("text"),
    )
    survey = "d bigint, t bigint, n_words bigint, sig binary, once array<bigint>, again array<bigint>"
    found, _ = materialise(rows.mapInArrow(_survey(width), survey), "substring")
    long = found.filter(F.col("n_words") >= width)
    first = long.groupBy("sig").agg(F.min(F.struct("d", "t")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("sig", "f")
    first, _ = materialise(first, "substring-first")
    copies = spread_join(long.select("d", "t", "sig"), first, "sig", first.count()).filter(F.struct("d", "t") != F.col("f")).select("d", "t").distinct()
    copies, _ = materialise(copies, "substring-copies")
    alone = found.join(small_or_plain(copies, copies.count()), ["d", "t"], "left_anti")
    if not unique:
        alone = alone.dropDuplicates(["d", "t"])
    once = alone.select("d", "t", F.explode("once").alias("name"), F.lit(1).alias("m"))
    again = alone.select("d", "t", F.explode("again").alias("name"), F.lit(2).alias("m"))
    places = once.union(again)
    often = places.groupBy("name").agg(F.sum("m").alias("places")).filter("places > 1")
    named = places.select("d", "t", "name").join(often, "name")
    frequent = F.collect_list(F.when(F.col("places") > hot, F.col("name"))).alias("hot")
    named = named.groupBy("d", "t").agg(F.collect_list("name").alias("names"), frequent)
    text = rows if unique else rows.dropDuplicates(["d", "t"])
    windows = text.join(named, ["d", "t"]).select("d", "t", "text", "names", "hot")
    windows = windows.mapInArrow(_candidates(width), "key bigint, d bigint, t bigint, start int, n int, hashes array<bigint>")
    later = windows.repartition("key").sortWithinPartitions("key", "d", "t", "start").mapInArrow(_later, "d bigint, t bigint, start int, n int")
    runs = later.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    whole = copies.select("d", "t", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"), F.lit(True).alias("copy"))
    info = runs.withColumn("copy", F.lit(False)).unionByName(whole)
    doc_id = F.when(F.col("d") < LAST, F.col("d")).alias("doc_id")
    made = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(info, ["d", "t"], "left").select(doc_id, "text", "copy", "runs").mapInArrow(_cut(width, with_text), made)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(docs, with_text=False)


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - {WIDTH} + 2)) AS s, words FROM w WHERE len(words) >= {WIDTH}),
named AS (SELECT doc_id, s, md5(array_to_string(words[s:s + {WIDTH - 1}], ' ')) AS k FROM win),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM named) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM later, range(0, {WIDTH}) t(o)),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
