"""What the operators share: word rules, bounded batches and worker caches, staged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.batches import mapped
from quire.staging import fresh_dir, release, shared_dir, staged

__all__ = ["fresh_dir", "mapped", "own_name", "release", "shared_dir", "staged", "table", "tasks_for", "word_count", "worker_state"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


_STATE: dict = {}


def worker_state(key: tuple, make: Callable):
    """What a worker keeps between its tasks: one operator's caches at a time, to bound its memory."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def tasks_for(df: DataFrame, bytes_each: int) -> int:
    """Tasks for an exchange of ``df``: the session's shuffle partitions, or more where the tables that
    it reads are estimated at more than ``bytes_each`` a task.

    Estimates of joins are products of both sides and say nothing, nor do those of unknown sources.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return least if size >= 1 << 58 or "Join" in plan.toString() else max(least, -(-size // bytes_each))


def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null. Two linear passes, no array of words."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), ASCII_SPACE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that ``df`` does not have, in the order asked for."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
