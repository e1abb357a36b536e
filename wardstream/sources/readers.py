"""File discovery, format detection and readers; each reader gives rows of (source_name, record_index, raw JSON text)."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_timestamp, let
from ..registry import readers
from ..session import small, written
from . import files, workbooks

# What discovery takes and leaves, and wrapper keys of JSON documents.
EXTENSIONS = ["csv", "tsv", "json", "jsonl", "ndjson", "xml", "log", "txt", "parquet", "xlsx", "xls"]
SKIPPED = [".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv", "venv", ".idea", ".vscode", "dist", "build"]
WRAPPERS = ["records", "events", "data", "items", "results", "logs", "alerts", "hits"]
SAMPLE = 65536


Paths = str | list[str]


def discover(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS, skip: list[str] = SKIPPED, max_depth: int | None = None) -> DataFrame:
    """(path, size, extension, format, confidence) of the files below path, by path; a missing path gives no rows.

    Files are listed by Spark, and the tasks read the head of each; nothing is collected.
    """
    schema = "path string, size bigint, extension string, format string, confidence double"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    names = F.split(F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit("")), "/")
    rows = files.heads(spark, path, SAMPLE, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(_any_case(e) for e in extensions) + "}")
    rows = rows.withColumns({"extension": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), "_parts": F.filter(names, lambda p: p != "")})
    rows = rows.filter(~F.exists(F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda p: p.isin(skip)))
    if max_depth is not None:
        rows = rows.filter(F.size("_parts") <= max_depth + 1)
    kind = detect(F.col("head"), F.col("extension"))
    return rows.select("path", "size", "extension", kind.alias("_k")).select("path", "size", "extension", "_k.*").orderBy("path")


def _any_case(extension: str) -> str:
    """A file pattern for an extension in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def detect(head: Column, extension: Column) -> Column:
    """struct(format, confidence): what the bytes say before what the name says.

    Magic bytes come first. Agreement gives 1.0, content alone or against the name 0.75, the name alone 0.9, neither 0.
    """
    magic = F.when(F.hex(F.substring(head, 1, 4)) == "50415231", "parquet").when(F.hex(F.substring(head, 1, 2)) == "504B", "excel")
    text = F.regexp_replace(F.regexp_replace(F.decode(head, "UTF-8"), "^﻿", ""), r"^\s+", "")
    line = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    braced = text.rlike(r"^[\[{]")
    delimited = F.greatest(*[F.regexp_count(line, F.lit(d)) for d in (",", "\t", ";")]) >= 2
    said = (
        F.when(magic.isNotNull(), magic)
        .when(text == "", None)
        .when(text.startswith("<") & ~text.rlike(r"^<\d+>"), "xml")
        .when(braced & F.try_parse_json(line).isNotNull() & text.rlike(r"^[^\r\n]*[\r\n]+\s*\S"), "jsonl")
        .when(braced & (F.try_parse_json(text).isNotNull() | (F.length(head) >= SAMPLE)), "json")  # a document longer than the sample
        .when(delimited, "csv")
        .otherwise("text_log")
    )
    # Format by extension.
    named = F.element_at(F.create_map(*[F.lit(x) for kv in {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "log": "text_log", "txt": "text_log", "parquet": "parquet", "xlsx": "excel", "xls": "excel"}.items() for x in kv]), extension)
    sure = F.when(said == named, 1.0).when(said.isNotNull(), 0.75).when(named.isNotNull(), 0.9).otherwise(0.0)
    return F.struct(F.coalesce(said, named, F.lit("unknown")).alias("format"), sure.alias("confidence"))


def _numbered(df: DataFrame, raw: Column, keep: Column | None = None) -> DataFrame:
    """(source_name, record_index, raw) of the kept rows, record_index from 0 in file order; ``raw`` may use ``_line``, the
    row's number in the file from 1.

    A block of a file is read by one task in order, so an id that grows in steps of one within the task numbers its rows
    when the block's first id is taken off. Only the blocks' first ids and sizes are gathered; no file meets in one task.
    """
    fixed = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    rows = df.select("*", *fixed, F.monotonically_increasing_id().alias("_p"))
    kept = (rows if keep is None else rows.filter(keep)).withColumn("_i", F.monotonically_increasing_id())
    starts = _starts(kept, "_i", "_r").join(_starts(rows, "_p", "_l"), ["_f", "_b"])
    starts = written(starts, "blocks")
    out = kept.join(small(starts), ["_f", "_b"])
    out = out.withColumns({"record_index": F.col("_i") + F.col("_r"), "_line": F.col("_p") + F.col("_l") + 1})
    return out.select(F.regexp_extract("_f", r"([^/]+)$", 1).alias("source_name"), "record_index", raw.alias("raw"))


def _starts(rows: DataFrame, number: str, made: str) -> DataFrame:
    """(_f, _b, made) of each block: what turns an id of one of its rows into the row's number in the file."""
    per = rows.groupBy("_f", "_b").agg(F.min(number).alias("_m"), F.count("*").alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_m")).alias(made))


def with_event_ids(df: DataFrame, source_format: str) -> DataFrame:
    """Adds source_format and event_id: the file's stem and the row's number from 0."""
    stem = F.regexp_replace("source_name", r"\.[^.]*$", "")
    return df.withColumns({"source_format": F.lit(source_format), "event_id": F.format_string("%s-%06d", stem, "record_index")})


def dialect(sample: str) -> tuple[str, str]:
    """(delimiter, header line): of comma, tab, semicolon and bar the one that every line of the sample has most of."""
    lines = [x for x in sample.splitlines() if x.strip()]
    whole = lines[:-1] if len(lines) > 1 and not sample.endswith(("\n", "\r")) else lines
    if not whole:
        return ",", ""
    return max([",", "\t", ";", "|"], key=lambda d: (min(x.count(d) for x in whole), whole[0].count(d))), lines[0]


def _may_span_lines(spark: SparkSession, paths: list[str], encoding: str) -> bool:
    """Whether a line of the files has an odd number of quotes; of encodings in which lines cannot be told, always."""
    if encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        return True
    return spark.read.text(paths).filter(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count() > 0


@readers.register("csv")
def read_csv(spark: SparkSession, path: Paths, sep: str | None = None, encoding: str = "UTF-8", multiline: bool | None = None) -> DataFrame:
    """Header row, all text, empty cells null, quotes doubled inside quotes; files are read together where delimiter and header agree.

    The delimiter is judged for each file from its first 4,096 characters. Files in which a line has an odd number of quotes
    may have line ends inside quotes, and are then read whole, a task each; others are split. ``multiline`` says so unjudged.
    """
    paths = [path] if isinstance(path, str) else path

    def judge(h: bytes) -> tuple[str, str]:
        found, header = dialect(h.decode(encoding, "replace"))
        return sep or found, header

    alike = files.alike(spark, paths, 4096, judge)
    out = None
    for (d, _), same in alike.items():
        whole = multiline if multiline is not None else _may_span_lines(spark, same, encoding)
        reader = spark.read.option("header", True).option("sep", d).option("nullValue", "").option("multiLine", whole).option("escape", '"').option("encoding", encoding).option("inferSchema", False)
        rows = reader.csv(same)
        rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns})
        rows = _numbered(rows, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
        out = rows if out is None else out.union(rows)
    return out if out is not None else spark.createDataFrame([], "source_name string, record_index bigint, raw string")


@readers.register("json")
def read_json(spark: SparkSession, path: Paths) -> DataFrame:
    """Documents: arrays give rows; objects the rows of their first wrapper key, or one row; list items _row, scalars value."""
    docs = spark.read.option("wholetext", True).text(path).select("*", F.col("_metadata.file_path").alias("_f"))
    body = F.regexp_replace("value", "^﻿", "")
    item = "array<variant>"
    doc = F.try_parse_json(body)
    array = lambda v: F.try_variant_get(v, "$", item)
    wrapped = F.coalesce(*[F.when(F.size(F.try_variant_get(doc, f"$.{k}", item)) > 0, F.try_variant_get(doc, f"$.{k}", item)) for k in WRAPPERS])
    is_object = F.trim(body).startswith("{")
    parts = F.when(F.trim(body).startswith("["), array(doc)).when(is_object, F.coalesce(wrapped, F.array(doc)))
    rows = docs.select("_f", F.posexplode(parts).alias("record_index", "v")).withColumn("t", F.to_json("v"))
    raw = F.when(F.col("t").startswith("{"), F.col("t")).when(F.col("t").startswith("["), F.concat(F.lit('{"_row":'), "t", F.lit("}"))).otherwise(F.concat(F.lit('{"value":'), "t", F.lit("}")))
    return rows.select(F.regexp_extract("_f", r"([^/]+)$", 1).alias("source_name"), "record_index", raw.alias("raw"))


@readers.register("jsonl")
def read_jsonl(spark: SparkSession, path: Paths) -> DataFrame:
    """One row a line; blank lines are skipped, a malformed line is kept as _raw_line with _parse_error and its number."""
    lines = spark.read.text(path)
    ok = F.try_parse_json("value").isNotNull()
    body = F.trim("value")
    bad = F.to_json(F.struct(body.alias("_raw_line"), F.concat(F.lit("JSONL line "), F.col("_line").cast("string"), F.lit(": no JSON")).alias("_parse_error")))
    raw = F.when(~ok, bad).when(body.startswith("{"), body).otherwise(F.concat(F.lit('{"value":'), body, F.lit("}")))
    return _numbered(lines, raw, body != "")


@readers.register("xml")
def read_xml(spark: SparkSession, path: Paths, row_tag: str | None = None) -> DataFrame:
    """Children of the root with the first child's tag; attributes @name; of repeated tags the last value.

    Files are read together where that tag agrees; fields that a file lacks are left out of its rows.
    """
    paths = [path] if isinstance(path, str) else path

    def judge(h: bytes) -> tuple[str, str]:
        first = re.match(r"(?s)\s*(?:<\?.*?\?>\s*|<!.*?>\s*)*<[^>]+>\s*(?:<!--.*?-->\s*)*<([^\s/>]+)", h.decode("utf-8", "replace").lstrip("\ufeff"))
        return row_tag or (first[1] if first else "row"), ""

    alike = files.alike(spark, paths, SAMPLE, judge)
    out = None
    for (tag, _), same in alike.items():
        rows = spark.read.option("rowTag", tag).option("attributePrefix", "@").option("valueTag", "#text").option("inferSchema", False).xml(same)
        last = [F.element_at(F.col(f"`{f.name}`"), -1).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in rows.schema.fields]
        rows = _numbered(rows, F.to_json(F.struct(*last)))
        out = rows if out is None else out.union(rows)
    return out if out is not None else spark.createDataFrame([], "source_name string, record_index bigint, raw string")


# Timestamps of log lines in search order, and key=value pairs.
LOG_TIMES = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?",
    r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"\d{2}-[A-Za-z]{3}-\d{4}\s+\d{2}:\d{2}:\d{2}",
    r"\[\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\]",
]
LOG_PAIR = r"(\w[\w.\-]*)\s*[=:]\s*(\"[^\"]*\"|'[^']*'|\[[^\]]*\]|\S+)"


def log_fields(line: Column) -> Column:
    """Map of a log line: timestamp, its key=value pairs (the last of a key), message, and the line itself.

    The message is the line without its timestamps and without each pair's value, once; keys stay.
    """
    without = lambda text, v: F.when(F.position(v, text) > 0, F.concat(F.substring(text, F.lit(1), F.position(v, text) - 1), F.substring(text, F.position(v, text) + F.length(v), F.length(text)))).otherwise(text)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))

    def entries(x: Column) -> Column:
        times = [F.nullif(F.btrim(F.regexp_extract(x["line"], p, 0), F.lit("[]")), F.lit("")) for p in LOG_TIMES]
        stamp = F.coalesce(*[event_timestamp(t) for t in times])
        values = F.transform(x["values"], lambda v: F.btrim(F.btrim(F.trim(v), F.lit('"')), F.lit("'")))
        rest = x["line"]
        for p in LOG_TIMES:
            rest = F.regexp_replace(rest, p, "")
        rest = F.aggregate(x["values"], rest, without)
        message = F.nullif(F.trim(F.regexp_replace(rest, r"\s{2,}", " ")), F.lit(""))
        both = F.concat(F.array(entry("timestamp", stamp)), F.arrays_zip(x["keys"].alias("key"), values.alias("value")), F.array(entry("message", message), entry("_raw_line", x["line"])))
        return F.filter(both, lambda e: e["value"].isNotNull())

    def last(both: Column) -> Column:
        """The last entry of a key stands."""
        return F.map_from_entries(F.filter(F.transform(both, lambda e, i: F.when(~F.exists(F.slice(both, i + 2, F.size(both)), lambda x: x["key"] == e["key"]), e)), lambda e: e.isNotNull()))

    # The searches and the entries are bound once: every use of an expression, as for each entry in last(), evaluates it anew.
    pairs = lambda i: F.regexp_extract_all(line, F.lit(LOG_PAIR), F.lit(i))
    found = F.struct(line.alias("line"), pairs(1).alias("keys"), pairs(2).alias("values"))
    return let(let(found, entries), last)


@readers.register("text_log")
def read_log(spark: SparkSession, path: Paths) -> DataFrame:
    return _numbered(spark.read.text(path), F.to_json(log_fields(F.col("value"))), F.trim("value") != "")


@readers.register("parquet")
def read_parquet(spark: SparkSession, path: Paths) -> DataFrame:
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _numbered(rows, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))


@readers.register("excel")
def read_excel(spark: SparkSession, path: Paths) -> DataFrame:
    """The rows of every sheet of xlsx workbooks under the names in its first row, a task for each sheet."""
    return workbooks.read_sheets(spark, path)


def ingest(spark: SparkSession, path: str, limit: int | None = None, limit_per_file: int | None = None) -> DataFrame:
    """Raw rows of all files below path whose format has a reader; ``limit`` counts rows over all files, in file order.

    The files of a format are read together, so the plan grows with the formats and not with the files.
    """
    alike = defaultdict(list)
    for f in discover(spark, path).select("path", "format").collect():  # one row a file
        alike[f["format"]].append(f["path"])
    out = None
    for kind, paths in sorted(alike.items()):
        reader = readers.get(kind)
        if reader:
            rows = with_event_ids(reader(spark, paths).withColumn("record_index", F.col("record_index").cast("bigint")), kind)
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "source_name string, record_index bigint, raw string, source_format string, event_id string")
    if limit_per_file and limit_per_file > 0:
        out = out.filter(F.col("record_index") < limit_per_file)
    return out.orderBy("source_name", "record_index").limit(limit) if limit and limit > 0 else out


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files that no reader takes."""
    found = discover(spark, path)
    return found.filter(~F.col("format").isin(readers.keys())).select("path", F.concat(F.lit("no parser for format "), "format").alias("reason"))


def ingest_summary(events: DataFrame) -> DataFrame:
    """Rows and errors by format and file, by format, and in all."""
    error = F.count_if(F.get_json_object("raw", "$._parse_error").isNotNull())
    return events.rollup("source_format", "source_name").agg(F.count("*").alias("records"), error.alias("errors"))


__all__ = ["detect", "dialect", "discover", "ingest", "ingest_summary", "log_fields", "skipped_files", "with_event_ids"]
