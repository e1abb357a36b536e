"""What lies in files, read by the tasks: listings, heads and digests, without a byte passing through the driver.

Files are listed by Spark. A task opens each of its files by itself and reads as much of it as is asked for. Stores that only
Spark's own readers can open (by their scheme) are read by those, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes that the tasks open themselves, and the names that their libraries know them by.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "wasb": "abfs", "wasbs": "abfss"}
#: Bytes hashed at a time.
CHUNK = 8 << 20


def scheme_of(path: str) -> str:
    return path.split(":", 1)[0].lower() if ":" in path.split("/", 1)[0] else "file"


def opened(path: str, seek: bool = False) -> pa.NativeFile:
    """A file of any store with a scheme of SCHEMES, open for reading in order, or at any place with ``seek``."""
    scheme = scheme_of(path)
    if scheme == "file":
        system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    else:
        system, at = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{path.split(':', 1)[1]}")
    return system.open_input_file(at) if seek else system.open_input_stream(at, compression=None)


def created(path: str) -> pa.NativeFile:
    """A new file, open for writing in order; its folder is made if it is not there."""
    scheme = scheme_of(path)
    if scheme == "file":
        system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    else:
        system, at = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{path.split(':', 1)[1]}")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def listed(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(path, size) of the files of a path or paths, which Spark lists (empty ones it leaves out); none is opened."""
    reader = spark.read.format("binaryFile")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path).select("path", F.col("length").alias("size"))


def _by_tasks(spark: SparkSession, paths: str | list[str], options: dict, made: str, of_file: Callable[[str], object], of_content: F.Column) -> DataFrame:
    """(path, size, made) of the files: of_file in the tasks, or of_content where only Spark opens the store."""
    one = paths if isinstance(paths, str) else (paths[0] if paths else "")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(one or "/")
    scheme = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()  # that of a path without one, too
    if scheme not in SCHEMES:
        reader = spark.read.format("binaryFile")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(paths).select("path", F.col("length").alias("size"), of_content.alias(made.split()[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"binary": pa.binary(), "string": pa.string()}[made.split()[1]]
        for b in batches:
            for i in range(b.num_rows):  # a file's bytes are handed on before the next is opened
                part = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([of_file(part.column(0)[0].as_py())], kind)], ["path", "size", made.split()[0]])

    files = listed(spark, paths, **options)
    return files.mapInArrow(run, f"path string, size bigint, {made}")


def heads(spark: SparkSession, paths: str | list[str], n: int, **options) -> DataFrame:
    """(path, size, head) of the files: of each the first n bytes."""

    def of_file(path: str) -> bytes:
        with opened(path) as f:
            return f.read(n)

    return _by_tasks(spark, paths, options, "head binary", of_file, F.substring(F.col("content"), 1, n))


def digests(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """(path, size, sha256) of the files, each hashed in one pass over chunks of fixed size."""

    def of_file(path: str) -> str:
        held = hashlib.sha256()
        with opened(path) as f:
            while part := f.read(CHUNK):
                held.update(part)
        return held.hexdigest()

    return _by_tasks(spark, paths, options, "sha256 string", of_file, F.sha2("content", 256))


def alike(spark: SparkSession, paths: list[str], n: int, judge: Callable[[bytes], tuple[str, str]]) -> dict[tuple[str, str], list[str]]:
    """The paths by what the tasks judge from the first n bytes of each (two texts); names alone come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]], ["path", "a", "b"])

    out: dict[tuple[str, str], list[str]] = {}
    for r in heads(spark, paths, n).select("path", "head").mapInArrow(run, "path string, a string, b string").orderBy("path").collect():  # a row for each file
        out.setdefault((r["a"], r["b"]), []).append(r["path"])
    return out


__all__ = ["alike", "created", "digests", "heads", "listed", "opened", "scheme_of"]
