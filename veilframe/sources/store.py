"""Tables kept between steps, and the job table."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_SCHEMA = "job_id string, upload_id string, content_fp string, config_hash string, input_path string, output_path string, status string, qc_status string, error string, created_at timestamp, updated_at timestamp, metrics_json string"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are kept within, at its end: write or collect what reads them before.

    Tables kept with lasting=n belong to the nth scope around this one, or to the caller if there is none.
    """
    _scopes.__dict__.setdefault("stack", []).append([])
    try:
        yield
    finally:
        for path in _scopes.stack.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept_folder(spark: SparkSession, lasting: int = 0) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    Where that is unset, below the folder of setCheckpointDir; else, in local mode alone, below a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("veilframe.local.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("veilframe.local.dir", root)
    path = f"{root}/veilframe-{uuid.uuid4().hex}"
    stack = getattr(_scopes, "stack", [])
    if len(stack) > lasting:
        stack[-1 - lasting].append(path)
    return path


def kept(df: DataFrame, codec: str = "zstd", lasting: int = 0, by: str | None = None) -> DataFrame:
    """Write df to a kept_folder and read it back: cuts lineage, survives lost executors, is computed once. See scratch.

    by: its last column, whose values become folders, so that a filter on it reads its part alone.
    """
    path = kept_folder(df.sparkSession, lasting)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_by(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df in partitions by keys, for a map over partitions that takes the rows of a key together.

    Of rows that joins have dealt by these keys already, Spark leaves out a plain repartition, and as a map asks for no
    partitioning, it may then cut or merge the partitions of each joined side on its own. A hash of the keys is dealt anew.
    """
    by = F.xxhash64(*keys)
    return df.repartition(by) if parts is None else df.repartition(parts, by)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_SCHEMA).parquet(path)


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Replace the job table at path; jobs may not be read from there lazily (keep it first)."""
    jobs.select(*(f.split()[0] for f in JOB_SCHEMA.split(", "))).write.mode("overwrite").parquet(path)


def write_reports(report: DataFrame, path: str) -> None:
    """A score report as JSON records."""
    report.write.mode("overwrite").json(path)


def merged_config(base: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """base with overrides; nested sections are merged one level deep, base is left as it is."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for key, value in overrides.items():
        out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def config_key(config: dict[str, Any]) -> str:
    """16 hexadecimal digits that name a configuration, without its keys that start with an underscore."""
    shown = {k: v for k, v in config.items() if not k.startswith("_")}
    return hashlib.sha256(json.dumps(shown, sort_keys=True).encode()).hexdigest()[:16]
