"""Periodic run detection: harmonic grid probing.

A run is a stretch of consecutive words whose smallest period is p (words p apart are identical), at least
``max(6, 4 p)`` words long, which no neighbouring word extends. Whatever its start, it covers four neighbouring points
jp, (j+1)p, (j+2)p, (j+3)p of the grid of its period. So for every period the words at jp and (j+1)p are tested for
equality, for all periods of a chunk at once (n + n/2 + n/3 + ... tests), and a grid point goes on only if the next two
tests hold too, and then those at a few places in between, which a run must pass as well. Each survivor is extended to
both sides by comparing growing chunks of the words with themselves shifted by p. Periods rise: grid points whose four
places lie within a run already found are skipped, as two runs with periods p and q share fewer than p + q words; that
also leaves out the multiples of a run's period.

A document is one row of one task, of any length: the memory needed is a few numbers for each word, besides chunks of
fixed size. Nothing is shuffled.

Defined cases: null or wordless text has no runs and collapses to the empty text; ids may be null, of any type and
repeated (each row is judged by itself); empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid points tested at a time.
GRID_CHUNK = 1 << 20
#: Places between the first and the third grid point, in 16ths, that are probed before a survivor is extended.
PROBES = (8, 4, 12, 1, 15, 6, 10)
#: First and largest number of words compared at a time when a survivor is extended.
FIRST_CHUNK, LARGEST_CHUNK = 64, 1 << 16
#: Results of a batch are handed on in slices of so many rows.
SLICE_ROWS = 512


def grid(n: int, chunk: int = GRID_CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, places): every place jp with (j+3)p < n for every period up to n/4, periods rising, some chunk points at a time."""
    p = 1
    while p <= n // 4:
        count = (n - 1) // p - 2
        if count >= chunk:
            for j in range(0, count, chunk):
                at = np.arange(j, min(j + chunk, count)) * p
                yield np.full(len(at), p), at
            p += 1
            continue
        periods = np.arange(p, min(n // 4, p + chunk // count - 1) + 1)  # later periods have fewer points
        counts = (n - 1) // periods - 2
        each = np.repeat(periods, counts)
        yield each, (np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)) * each
        p = int(periods[-1]) + 1


def right_end(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from that p later (or lacks one)."""
    size, last = FIRST_CHUNK, len(w) - p
    while i < last:
        stop = min(i + size, last)
        differs = w[i:stop] != w[i + p : stop + p]
        k = int(differs.argmax())
        if differs[k]:
            return i + k
        i, size = stop, min(2 * size, LARGEST_CHUNK)
    return last


def left_end(w: np.ndarray, i: int, p: int) -> int:
    """The first of the places before i that all equal the word p later (i if none does)."""
    size = FIRST_CHUNK
    while i > 0:
        begin = max(i - size, 0)
        differs = (w[begin:i] != w[begin + p : i + p])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return i - k
        i, size = begin, min(2 * size, LARGEST_CHUNK)
    return 0


def find_runs(w: np.ndarray, chunk: int = GRID_CHUNK) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbered words, by start and period."""
    n, runs = len(w), []
    covered = np.zeros(n, np.int64)  # at each place, how far the runs found there reach
    last_period = stretch = 0
    for period, at in grid(n, chunk):
        for k in range(3):
            same = w[at + k * period] == w[at + (k + 1) * period]
            period, at = period[same], at[same]
        for f in PROBES:
            place = at + (2 * period * f >> 4)
            same = w[place] == w[place + period]
            period, at = period[same], at[same]
        new = covered[at] <= at + 3 * period
        for p, i in zip(period[new].tolist(), at[new].tolist()):
            if covered[i] > i + 3 * p or (p == last_period and i < stretch):
                continue
            last_period, stretch = p, right_end(w, i, p)
            start = left_end(w, i, p)
            length = stretch + p - start
            if stretch > i + 2 * p and length >= max(6, 4 * p):  # the four points lie in it: else it may be a smaller period's
                runs.append((start, length, p))
                np.maximum(covered[start : start + length], start + length, out=covered[start : start + length])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def numbered(words: list) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), np.int32, len(words))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [x for x, d in zip(words, np.cumsum(depth).tolist()) if not d]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length, period by start and period) and collapsed (the kept words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for lo in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(lo, SLICE_ROWS)
                n, found, kept = [], [], []
                for text in part.column(1).to_pylist():
                    words = (text or b"").split()
                    runs = find_runs(numbered(words))
                    n.append(len(words))
                    found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                    kept.append(b" ".join(collapse(words, runs)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(found, run_type), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.encode(f"`{text_col}`", "UTF-8").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by the checksum of its id has its tail replaced by repetitions of its words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    rows = rows.withColumn("a", F.col("g") % F.nullif(F.size("w"), F.lit(0)))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    tail = F.expr("array_join(transform(w, (x, i) -> if(i >= a, w[cast(a + (i - a) % p as int)], x)), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNull() | (F.size("w") == 0), F.col("text")).otherwise(tail).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """For every document the number of runs, the longest run, and digests of all runs and of the collapsed words."""
    found = periodic_runs(with_tails(docs))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
