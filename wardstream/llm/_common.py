"""Scratch tables, size-checked broadcasts and connected components shared by the operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

#: Rows that may be broadcast; beyond it the caller joins by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of one key beyond which its join is by broadcast, whatever the number of keys.
HOT_ROWS = 1_000_000

#: Scratch paths made inside each open scope, innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh path below the application's scratch folder, which goes when the scope (not with keep) or the application ends."""
    path = session.scratch_path(spark, tag)
    for scope in _SCOPES[-1:] if not keep else ():
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside when it ends: write the results within."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop_scratch(spark, *_SCOPES.pop())


def materialise(df: DataFrame, tag: str, rows_per_file: int = 0, keep: bool = False) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: the lineage ends at files any executor can read."""
    path = scratch_path(df.sparkSession, tag, keep)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def small_or_plain(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit, else df as it is (shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(rows: DataFrame, keys: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """rows joined with one row for each of n keys, so that the rows of a frequent key meet in no task.

    By broadcast while the keys are few; else the keys with over HOT_ROWS rows are (there is at most one in HOT_ROWS rows),
    and the others shuffle.
    """
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    hot = rows.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).filter(F.col(on).isNotNull()).select(on)
    hot, _ = materialise(hot, "hot-keys")
    hot = F.broadcast(hot)
    few = rows.join(hot, on, "left_semi").join(F.broadcast(keys.join(hot, on, "left_semi")), on, how)
    return few.unionByName(rows.join(hot, on, "left_anti").join(keys, on, how))


def bit_filters(hashes: DataFrame, column: str, of: str, n: dict[int, int], most: int) -> dict[int, np.ndarray]:
    """For each value of ``of`` (n has its number of hashes) bits at the places that the leading bits of its 64-bit hashes
    name, as bytes: at least 8 bits for each hash, 2**most at most.

    The tasks put the bits together in blocks of 64 KB; the driver gets these, the whole filters once.
    """
    sizes = {k: min(most, max(16, x.bit_length() + 3)) for k, x in n.items()}
    deep = {k: min(x, 19) for k, x in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            of, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k in np.unique(of).tolist():
                mine, block = np.unique(place[of == k]), deep[k]
                cut = np.flatnonzero(np.diff(mine >> block)) + 1
                for part in np.split(mine, cut):
                    held.setdefault((k, int(part[0]) >> block), np.zeros(1 << block, bool))[part & ((1 << block) - 1)] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        cols = [pa.array([k for k, _ in held], pa.int32()), pa.array([x for _, x in held], pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["of", "block", "bits"])

    by = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("of"))
    rows = hashes.select(F.col(of).cast("int").alias("of"), F.col(column).alias("h"))
    place = rows.select("of", F.call_function("shiftrightunsigned", "h", F.lit(64) - by(sizes)).alias("p"), by(deep).alias("deep"))
    place = place.select("of", "p", F.call_function("shiftright", "p", F.col("deep")).alias("block")).repartition("of", "block").select("of", "p")
    out = {k: np.zeros(1 << x - 3, np.uint8) for k, x in sizes.items()}
    for r in place.mapInArrow(run, "of int, block bigint, bits binary").collect():  # 2**(size - 3) bytes for each value
        at = r["block"] << deep[r["of"]] - 3
        out[r["of"]][at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be among those of the filter; none that is gets lost."""
    place = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def keep_columns(df: DataFrame, made: list[str]) -> DataFrame:
    """df without input columns that bear the name of a column the operator makes (case-insensitively)."""
    taken = {m.lower() for m in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place (c0, c1, ...), so that none clashes with a column made on the way, and the name
    that each column (in lower case) has there. ``toDF(*df.columns)`` gives the names back."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, {c.lower(): f"c{i}" for i, c in enumerate(df.columns)}


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any name (a dot in a name stops mapInArrow): inside, columns go by their place."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)])

    plain, _ = by_place(df)
    out = plain.mapInArrow(placed, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]))
    return out.toDF(*schema.names)


def connected_components(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, str | None]:
    """(node, root) for every node of the undirected edges (longs); root is the component's smallest node.

    Alternates large-star and small-star rounds; every round is one min-aggregation (combined map-side) and one
    join per star, never a collected neighbourhood, and is written to the shared folder. Returns the frame and the
    scratch path it reads.
    """
    spark = edges.sparkSession
    now, path = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc"
    )
    total = _checksum(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # There are two nodes an edge at most; a node with many neighbours has as many rows here.
        large = spread_join(both.filter("v > u"), low, "u", 2 * total[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, mid = materialise(large.filter("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", 2 * total[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new, nxt = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_scratch(spark, mid, path)
        now, path = new, nxt
        fresh = _checksum(now)
        if fresh == total:
            break
        total = fresh
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), path


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20)))")).first())
