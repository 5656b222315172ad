"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 63-bit hash of its identifier and text. Per source, token sizes are summed
by the leading hash bits; the budget's threshold falls into one bucket, and only the documents of
that boundary bucket are summed again by their next bits, until the bucket holds one document (or
copies that share a hash). Documents are then taken by comparing hashes: nothing is sorted and no
document list is collected. A rerun gives the same mix.

Defined cases: a null text has size 0; null sources form one source, ordered last; sources without
any word have target 0; rows that repeat a whole document share a hash and are taken or left
together; documents without a word get no copy beyond the full ones; no document is taken more
than ``max_repeat`` times; an empty table gives an empty result; only the named columns are read, so extra columns
never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import own_name, staged, word_count

HASH_BITS = 63
STEP_BITS = 12


def _hash(doc_id: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)


def source_targets(totals: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """``totals(source, source_size)`` -> with ``target``.

    Sources weigh ``weights`` in turn by code point (null last) and share all sizes; no target is
    above ``max_repeat`` times its source. Sharing the excess again until none is above has the
    closed form min(cap, weight * rate): by rising cap/weight, the first source that its rate does
    not fill fixes the rate. One row per source passes through the windows.
    """
    n = len(weights)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(turn - 1, F.lit(n)) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    out = totals.withColumn("w", w).withColumn("cap", cap)
    out = out.withColumn("total", F.sum("source_size").over(every).cast("double"))
    rate = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    out = out.withColumn("rate", rate)
    unfilled = F.when(F.col("cap") / F.col("w") >= F.col("rate"), F.col("rate"))
    out = out.withColumn("rate", F.min(F.struct(F.isnull(unfilled), F.col("cap") / F.col("w"), unfilled.alias("r"))).over(every)["r"])
    target = F.least(F.col("cap"), F.col("w") * F.coalesce(F.col("rate"), F.lit(float("inf"))))
    return out.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized(source, size, h)`` and targets -> per source the copies of all and the hash limit.

    Documents with ``h < below`` are taken once more than ``full`` times. Each round sums at most
    2**STEP_BITS buckets a source, map side first, so a hot source costs no more than another.
    """
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = targets.withColumn("full", full)
    state = state.withColumn("left", F.col("target") - F.col("full") * size)
    state = staged(state.withColumn("low", F.lit(0).cast("long")), "mix-state")
    bits = HASH_BITS
    while True:
        step = min(STEP_BITS, bits)
        shift = bits - step
        rows = sized
        if bits < HASH_BITS:
            inside = state.select(F.col("source").alias("s"), F.col("low").alias("at"))
            same = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", bits) == F.shiftright("at", bits))
            rows = sized.join(inside, same).drop("s", "at")
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("here"), F.count(F.lit(1)).alias("docs")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("here").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        keyed = sums.select(F.col("source").alias("s"), "bucket", "here", "docs", "upto")
        now = state.select("source", "source_size", "target", "full", "left")
        found = now.join(keyed, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("left")), "left")
        edge = found.groupBy("source", "source_size", "target", "full", "left").agg(
            F.min(F.struct("bucket", "here", "docs", "upto")).alias("e")
        )
        state = staged(
            edge.select(
                "source", "source_size", "target", "full",
                (F.col("left") - F.coalesce(F.col("e.upto") - F.col("e.here"), F.lit(0))).alias("left"),
                F.coalesce(F.shiftleft(F.col("e.bucket"), shift), F.lit(0)).cast("long").alias("low"),
                F.coalesce(F.col("e.here"), F.lit(0)).alias("here"),
                F.coalesce(F.col("e.docs"), F.lit(0)).alias("docs"),
            ),
            "mix-state",
        )
        bits = shift
        most = state.agg(F.max("docs")).first()[0]
        if not bits or most is None or most <= 1:
            break
    width = F.lit(1 << bits).cast("long")
    near = (F.col("here") > 0) & (F.col("left") * 2 >= F.col("here"))
    below = F.col("low") + F.when(near, width).otherwise(F.lit(0))
    return staged(state.select("source", "source_size", "target", "full", below.alias("below")), "mix-limits")


def mix_plan(
    documents: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sized documents ``doc_id, source, size, h``; limits by source), both staged."""
    sized = staged(
        documents.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            _hash(F.col(doc_id), F.col(text), seed).alias("h"),
        ),
        "mix-sized",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, source_targets(totals, weights, max_repeat))


def _copies(full: Column, below: Column, size: Column, h: Column, max_repeat: float) -> Column:
    """How often a document is taken: ``full`` times, and once more below the threshold."""
    more = (h < below) & (size > 0) & (full < F.lit(max_repeat))
    return full + more.cast("long")


def mix_report(documents: DataFrame, *, max_repeat: int = 3, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized, limits = mix_plan(documents, max_repeat=max_repeat, **options)
    to = limits.withColumnRenamed("source", "s")
    copies = _copies(F.col("full"), F.col("below"), F.col("size"), F.col("h"), max_repeat)
    return sized.join(to, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mix(
    documents: DataFrame,
    *,
    max_repeat: int = 3,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    **options,
) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with its own columns."""
    _, limits = mix_plan(documents, max_repeat=max_repeat, seed=seed, doc_id=doc_id, text=text, source=source, **options)
    s, full, below, copy = own_name(documents, "mix_source", "mix_full", "mix_below", "mix_copy")
    to = limits.select(F.col("source").alias(s), F.col("full").alias(full), F.col("below").alias(below))
    copies = _copies(F.col(full), F.col(below), word_count(F.col(text)), _hash(F.col(doc_id), F.col(text), seed), max_repeat)
    joined = documents.join(to, F.col(source).eqNullSafe(F.col(s)))
    out = joined.withColumn(copy, copies).where(F.col(copy) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    return out.select(*documents.columns)
