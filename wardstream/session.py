"""Session settings that the transforms rely on, and scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC for all time text; last value wins for repeated keys in log lines; adaptive execution for skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a session that exists."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def build(app: str = "wardstream", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Used only where a local session (tests, a laptop) names no shared folder.
FALLBACK_SHARED = "/tmp/checkpoints"
#: Scratch roots that the JVM already removes when it ends.
_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may do without."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (conf or f"{FALLBACK_SHARED}/{context.applicationId}").rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the application's scratch folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
        _ROOTS.add(root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again, so that what reads it twice does not compute it twice."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit, else the hint of a shuffle join, which keeps the
    planner from sending them through the driver on the size of a compressed file."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")
