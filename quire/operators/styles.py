"""Style cascades: the nearest style of a chain that sets a property gives it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import release, staged

#: Chains are read up to 2**ROUNDS styles long, so a circle ends.
ROUNDS = 5


def style_chain(styles: DataFrame, keys: Sequence[str], style: str = "style_id", parent: str = "parent_id", rounds: int = ROUNDS) -> DataFrame:
    """(keys, style, ancestor, depth): each style with itself (0) and its ancestors, up to
    ``2**rounds`` styles long.

    Doubling: each round joins chains with jumps of the length so far. Rounds are staged, so each
    reads two tables.
    """
    keys = list(keys)
    base = styles.select(*keys, F.col(style), F.col(parent).alias("_up"))
    chain = base.select(*keys, style, F.col(style).alias("ancestor"), F.lit(0).alias("depth"))
    jump = base.where("_up is not null")
    for k in range(rounds):
        to = jump.withColumnsRenamed({style: "ancestor", "_up": "_to"})
        further = chain.join(to, [*keys, "ancestor"]).select(*keys, style, F.col("_to").alias("ancestor"), (F.col("depth") + (1 << k)).alias("depth"))
        longer = staged(chain.unionByName(further), "chain")
        if k + 1 < rounds:
            to = jump.withColumnsRenamed({style: "_up", "_up": "_to"})
            twice = staged(jump.join(to, [*keys, "_up"]).select(*keys, style, F.col("_to").alias("_up")), "jump")
            release(jump)
            jump = twice
        release(chain)
        chain = longer
    return chain


def cascade(styles: DataFrame, keys: Sequence[str], properties: Sequence[str], style: str = "style_id", parent: str = "parent_id", rounds: int = ROUNDS) -> DataFrame:
    """Each style with its effective properties: of itself and its ancestors, the nearest that sets one.

    Pointers double: a style that has the properties of its next n styles takes those of the n
    behind them from the style it points to. Rounds are staged, so each is one join of a table as
    large as the styles, and they end when no style points further.
    """
    keys = list(keys)
    now = styles.select(*keys, style, F.col(parent).alias("_up"), *properties)
    for _ in range(rounds):
        up = now.select(*keys, F.col(style).alias("_up"), F.col("_up").alias("_far"), *[F.col(p).alias(f"_{p}") for p in properties])
        joined = now.join(up, [*keys, "_up"], "left")
        further = staged(joined.select(*keys, style, F.col("_far").alias("_up"), *[F.coalesce(p, f"_{p}").alias(p) for p in properties]), "cascade")
        release(now)
        now = further
        if now.where("_up is not null").isEmpty():
            break
    return now.drop("_up")


def merge(*layers: Column) -> Column:
    """Layers from the weakest to the strongest: set values replace, unset ones inherit."""
    return F.coalesce(*reversed(layers))


def merge_structs(weak: Column, strong: Column, fields: Sequence[str]) -> Column:
    """Field by field; null members are unset."""
    return F.struct(*[F.coalesce(strong[f], weak[f]).alias(f) for f in fields])


def merge_tabs(weak: Column, strong: Column) -> Column:
    """Tab stops add up; a stop at one place is replaced, a cleared one goes; sorted by place."""
    kept = F.filter(weak, lambda t: ~F.exists(strong, lambda s: F.abs(s["at"] - t["at"]) < 0.01))
    return F.sort_array(F.filter(F.concat(kept, strong), lambda t: ~t["clear"]))


def merge_border(weak: Column, strong: Column) -> Column:
    """An unset side (null) inherits; 'none' is a value of its own."""
    return F.coalesce(strong, weak)


def merge_border_space(weak: Column, strong: Column) -> Column:
    """The space of a border: only one above 0 replaces it."""
    return F.when(F.coalesce(strong, F.lit(0.0)) > 0, strong).otherwise(weak)


def table_border(own: Column, at_edge: Column, outer: Column, inside: Column) -> Column:
    """A side of a table's cell: its own, where it is unset the table's outer side at the edge, else
    the inner line. 'none' is a side of its own."""
    return F.coalesce(own, F.when(at_edge, outer).otherwise(inside))


def table_borders(cells: DataFrame, keys: Sequence[str], table: Column) -> DataFrame:
    """``cells`` (keys, r, c, span, top, right, bottom, left) with the sides that are drawn; ``table``:
    struct(top, right, bottom, left, inside_h, inside_v) of the table's own lines."""
    whole = Window.partitionBy(*keys)
    last_row, end = F.max("r").over(whole), F.max(F.col("c") + F.col("span")).over(whole)
    out = cells.withColumns({"_t": table, "_last": last_row, "_end": end})
    t = F.col("_t")
    sides = {
        "top": table_border(F.col("top"), F.col("r") == 0, t["top"], t["inside_h"]), "bottom": table_border(F.col("bottom"), F.col("r") == F.col("_last"), t["bottom"], t["inside_h"]),
        "left": table_border(F.col("left"), F.col("c") == 0, t["left"], t["inside_v"]), "right": table_border(F.col("right"), F.col("c") + F.col("span") >= F.col("_end"), t["right"], t["inside_v"]),
    }
    return out.withColumns(sides).drop("_t", "_last", "_end")


def relative_size(chain: Column, base: Column) -> Column:
    """Font size along a chain from the root: numbers replace, percentages scale."""
    return F.aggregate(chain, base, lambda a, s: F.when(s["percent"].isNotNull(), a * s["percent"] / 100.0).otherwise(F.coalesce(s["size"], a)))


def toggle(base: Column, code: Column) -> Column:
    """Toggle codes of binary documents: 0 off, 1 on, 128 as the style, 129 its opposite."""
    return F.when(code == 0, False).when(code == 1, True).when(code == 129, ~F.coalesce(base, F.lit(False))).otherwise(base)
