"""Sinks: JSON lines, audit output, versioned snapshots, registries, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written, text as it is."""
    df.write.option("ignoreNullFields", False).json(path)


def write_by(df: DataFrame, path: str, column: str = "status") -> None:
    """All rows, in a folder for each value: trusted, rejected and duplicate rows, or training splits."""
    df.write.partitionBy(column).option("ignoreNullFields", False).json(path)


def write_audit(df: DataFrame, path: str, column: str = "status") -> dict:
    """All rows by status below path/data, and their counts in path/audit.json, which is returned."""
    write_by(df, f"{path}/data", column)
    counts = {r[0]: r[1] for r in df.groupBy(column).count().collect()}  # a row for each status
    report = {"records": sum(counts.values()), "status": counts}
    write_text(df.sparkSession, f"{path}/audit.json", json.dumps(report, indent=2, sort_keys=True))
    return report


def write_splits(df: DataFrame, path: str, column: str = "split") -> dict:
    """Training splits as JSON lines in a folder each below path/data, and path/metadata.json: counts and file hashes."""
    write_by(df, f"{path}/data", column)
    counts = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    splits = {s: {"count": n, "sha256": file_hashes(df.sparkSession, f"{path}/data/{column}={s}")} for s, n in counts.items()}
    meta = {"schema_version": "sft-chat-v1", "splits": splits}
    write_text(df.sparkSession, f"{path}/metadata.json", json.dumps(meta, indent=2, sort_keys=True))
    return meta


def write_valid(df: DataFrame, path: str, errors: str = "issues", score: str = "quality_score", least: int = 70) -> None:
    """Rows without errors and with the least score under validated, the others under rejected."""
    bad = F.exists(errors, lambda i: i["severity"] == "error") | (F.coalesce(F.col(score), F.lit(100)) < least)
    write_by(df.withColumn("outcome", F.when(bad, "rejected").otherwise("validated")), path, "outcome")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark reaches."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_json_file(spark: SparkSession, path: str) -> dict | None:
    fs, p = _hadoop(spark, path)
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect())) if fs.exists(p) else None


def create_version(df: DataFrame, base: str, version: str, description: str = "", created_at: str = "") -> dict:
    """An immutable snapshot base/v<version>: data, and a manifest with row count, class histogram and file hashes."""
    spark, root = df.sparkSession, f"{base.rstrip('/')}/v{version}"
    df.write.mode("errorifexists").parquet(f"{root}/data")
    data = spark.read.parquet(f"{root}/data")
    classes = {r[0]: r[1] for r in data.groupBy(F.coalesce("classification", F.lit("unlabeled"))).count().collect()} if "classification" in df.columns else {}
    manifest = {"schema_version": "1.0", "version": version, "description": description, "created_at": created_at, "record_count": data.count(), "class_distribution": classes, "files": file_hashes(spark, f"{root}/data")}
    write_text(spark, f"{root}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def file_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file, hashed by the tasks in chunks."""
    rows = files.digests(spark, path, pathGlobFilter="part-*").select(F.regexp_extract("path", r"([^/]+)$", 1), "sha256")
    return {r[0]: r[1] for r in rows.collect()}  # a row for each file


def checksum_matches(spark: SparkSession, path: str, expected: str) -> bool:
    """Whether the SHA-256 of a file is the expected one, in any case."""
    held = files.digests(spark, path).first()
    return bool(held) and held["sha256"] == expected.strip().lower()


def load_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/v{version}/data")


def verify_version(spark: SparkSession, base: str, version: str) -> bool:
    """Whether the data files are those of the manifest."""
    root = f"{base.rstrip('/')}/v{version}"
    manifest = read_json_file(spark, f"{root}/manifest.json")
    return bool(manifest) and manifest["files"] == file_hashes(spark, f"{root}/data")


def list_versions(spark: SparkSession, base: str) -> list[dict]:
    """Manifests, oldest first (by creation, then version)."""
    fs, p = _hadoop(spark, base)
    if not fs.exists(p):
        return []
    found = [read_json_file(spark, f"{s.getPath()}/manifest.json") for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v")]
    return sorted((m for m in found if m), key=lambda m: (m["created_at"], m["version"]))


def diff_versions(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: added, removed, common distinct keys."""
    a, b = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("common"))


class JsonStore:
    """Small mutable records (runs, models, artifacts) as JSON files; read back as a frame."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def put(self, key: str, record: dict) -> dict:
        write_text(self.spark, f"{self.base}/{key}.json", json.dumps(record, sort_keys=True))
        return record

    def get(self, key: str) -> dict | None:
        return read_json_file(self.spark, f"{self.base}/{key}.json")

    def update(self, key: str, **changes) -> dict:
        held = self.get(key)
        if held is None:
            raise KeyError(key)
        return self.put(key, held | changes)

    def frame(self) -> DataFrame:
        return self.spark.read.json(f"{self.base}/*.json")

    def promote(self, key: str) -> None:
        """One record promoted; the one before goes back to evaluated."""
        if self.get(key) is None:
            raise KeyError(key)
        fs, p = _hadoop(self.spark, self.base)
        for s in fs.listStatus(p):
            other = s.getPath().getName().removesuffix(".json")
            held = self.get(other)
            if other == key:
                self.update(other, lifecycle="promoted")
            elif held.get("lifecycle") == "promoted":
                self.update(other, lifecycle="evaluated")


def report_markdown(row: dict, classes: list[tuple[str, int]], complete: list[tuple[str, float]]) -> str:
    """A quality report: figures, classes by size, completeness bars."""
    lines = ["# Data quality", "", *[f"- {k}: {v}" for k, v in row.items()], "", "| class | rows |", "| --- | --- |"]
    lines += [f"| {c} | {n} |" for c, n in sorted(classes, key=lambda x: -x[1])]
    lines += ["", *[f"{'█' * round(v * 20):<20} {v:.2%} {f}" for f, v in sorted(complete, key=lambda x: -x[1])]]
    return "\n".join(lines)


def benchmark_markdown(rows: list[tuple[str, float, float]]) -> str:
    """A comparison of two runs: (metric, base, tuned) with the difference."""
    lines = ["# Benchmark", "", "| metric | base | tuned | delta |", "| --- | --- | --- | --- |"]
    return "\n".join([*lines, *[f"| {m} | {a:.4f} | {b:.4f} | {b - a:+.4f} |" for m, a, b in rows]])
