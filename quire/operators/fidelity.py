"""Text and image fidelity: overlap, recall, precision, word order, ink agreement, grades."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

from quire.functions.scalars import grade, word_tokens


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, and every hyphen as the plain one."""
    hyphens = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(hyphens))


def _multiset_hit(a: Column, b: Column) -> Column:
    """Sum over all words of the lesser count: half of both sizes less the differences of counts.

    Both lists are sorted as one, so a word's entries follow each other and one pass counts them.
    """
    sign = lambda words, n: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(n).cast("long").alias("n")))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("string").alias("w"), zero.alias("n"), zero.alias("apart"))

    def count(s: Column, x: Column) -> Column:
        same = s["w"] == x["w"]
        return F.struct(
            x["w"].alias("w"), F.when(same, s["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            F.when(same, s["apart"]).otherwise(s["apart"] + F.abs(s["n"])).alias("apart"),
        )

    apart = F.aggregate(F.sort_array(F.concat(sign(a, 1), sign(b, -1))), start, count, lambda s: s["apart"] + F.abs(s["n"]))
    return ((F.size(a) + F.size(b) - apart) / 2).cast("long")


def overlap(source: DataFrame, extracted: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, source_words, extracted_words, hit): words as a multiset, the lesser count of each.

    Both sides are dealt by key once, as texts; words are counted inside the row.
    """
    keys = list(keys)
    none = F.lit(None).cast("string")
    sides = source.select(*keys, F.col(text).alias("a"), none.alias("b")).unionByName(extracted.select(*keys, none.alias("a"), F.col(text).alias("b")))
    every = sides.groupBy(*keys).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    words = every.withColumns({side: F.flatten(F.transform(side, word_tokens)) for side in "ab"})
    return words.select(*keys, F.size("a").cast("long").alias("source_words"), F.size("b").cast("long").alias("extracted_words"), _multiset_hit(F.col("a"), F.col("b")).alias("hit"))


def recall_precision(source: DataFrame, extracted: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Overlap with recall and precision; a side without words scores 1."""
    out = overlap(source, extracted, keys, text)
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("hit") / F.when(F.col(n) > 0, F.col(n)))
    return out.withColumn("recall", share("source_words")).withColumn("precision", share("extracted_words"))


def _lcs(a: Sequence, b: Sequence, block: int = 1 << 14) -> int:
    """Length of the longest common subsequence: a bit row over a, updated for each word of b.

    The row is cut into blocks, so that the bits of a block's words fit in memory however long a is;
    what a block's addition carries over goes into the next block's.
    """
    carry, total = bytearray(len(b)), 0
    for at in range(0, len(a), block):
        part = a[at : at + block]
        where: dict = {}
        for k, w in enumerate(part):
            where[w] = where.get(w, 0) | 1 << k
        full = row = (1 << len(part)) - 1
        for j, w in enumerate(b):
            same = where.get(w, 0) & row
            grown = row + same + carry[j]
            carry[j] = grown >> len(part)
            row = (grown | (row - same)) & full
        total += len(part) - row.bit_count()
    return total


@pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of the longest common subsequence of two lists, of any length; null if one is null."""
    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def order_score(a: Column, b: Column) -> Column:
    """Words in common order as a share of the shorter text's; 1 if one has none."""
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, 1.0).otherwise(lcs_length(a, b) / F.when(shorter > 0, shorter))


def ink(a: Column, b: Column, dark: int = 160) -> Column:
    """struct(iou, similarity) of two grey pixel arrays of one size (0 black, 255 white)."""
    weight = lambda p: F.when(p < dark, 255 - p).otherwise(0).cast("long")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.least(weight(x), weight(y)).alias("i"), F.greatest(weight(x), weight(y)).alias("u"), F.abs(x - y).cast("long").alias("d")))
    zero = F.lit(0).cast("long")
    total = F.aggregate(pairs, F.struct(zero.alias("i"), zero.alias("u"), zero.alias("d")), lambda s, p: F.struct((s["i"] + p["i"]).alias("i"), (s["u"] + p["u"]).alias("u"), (s["d"] + p["d"]).alias("d")))
    iou = F.when(total["u"] == 0, 1.0).otherwise(F.try_divide(total["i"], total["u"]))
    return F.struct(iou.alias("iou"), (1.0 - F.try_divide(total["d"], F.size(a) * 255.0)).alias("similarity"))


def report(df: DataFrame, keys: Sequence[str], score: str, warm: str) -> DataFrame:
    """Mean score, its grade, and the median of warm times, by key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.median(warm).alias("median_ms"), F.sum(warm).alias("total_ms"))
    return out.withColumn("grade", grade(F.col("mean_score")))


def with_previous(now: DataFrame, before: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value of the run before beside this one's (the first, by value, if there are several)."""
    old = before.groupBy(*keys).agg(F.min(value).alias(f"previous_{value}"))
    return now.join(old, list(keys), "left")


