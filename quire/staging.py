"""Intermediate tables in the cluster's shared folder.

They go to the folder that ``spark.checkpoint.dir`` names (every executor sees it). Only a local
session that names none gets a temporary folder; on a cluster that is an error. All tables of an
application lie in one folder below, which goes when the driver ends; ``release`` drops a table
earlier.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local sessions that name none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{master}: set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quire-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_ENDING: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        _remove(spark, path)


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name in the application's part of the shared folder; nothing is created yet."""
    own = f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}"
    if own not in _ENDING:
        _ENDING.add(own)
        atexit.register(_remove_at_end, spark, own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread of the table, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            _remove(df.sparkSession, path)
