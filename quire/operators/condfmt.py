"""Conditional formats: the first rule by priority that hits a cell gives its format.

With the rules known to the driver (a sheet's own few), the choice is one projection: every rule
becomes a column expression, and the least (priority, ordinal) that hits wins. References to fixed
columns of a cell's row share one window; any other offset is one equi-join. Ranges of more than
LISTED cells, and ranges with one end fixed, are one grouped join each: absolute ones are read once
a sheet, relative ones once for each row, column or cell that they move with. With rules in a table,
``match_rectangles`` joins by column instead of comparing every cell with every rectangle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.formula import Area, FormulaError, Node, Ref, Val, _compile, _first, cell_value, kind_letter, parse
from quire.functions.numfmt import general
from quire.functions.scalars import let
from quire.operators import aggregates


@dataclass(frozen=True)
class Rule:
    """``area``: r1, c1, r2, c2; ``origin``: the cell that relative references start from."""

    area: tuple[int, int, int, int]
    priority: int
    dxf: int
    kind: str
    operator: str = ""
    formulas: tuple[str, ...] = ()
    text: str | None = None
    origin: tuple[int, int] | None = None

    @property
    def start(self) -> tuple[int, int]:
        return self.origin or self.area[:2]


KEYS = ("doc_id", "sheet_idx")
#: Cells of a range that are read one by one.
LISTED = 16


def _grouped(a: Ref, b: Ref) -> bool:
    """Whether the range is read by a grouped join."""
    size = (abs(a.row - b.row) + 1) * (abs(a.col - b.col) + 1)
    return size > LISTED or (a.abs_row, a.abs_col) != (b.abs_row, b.abs_col)


def _ranges(node: Node) -> set[tuple[Ref, Ref]]:
    if node.op == "range":
        return {node.value} if _grouped(*node.value) else set()
    return set().union(*map(_ranges, node.args)) if node.args else set()


def _refs(node: Node) -> set[Ref]:
    """Single references, and the cells of ranges that are read one by one."""
    if node.op == "ref":
        return {node.value}
    if node.op == "range":
        a, b = node.value
        if _grouped(a, b):
            return set()
        rows, cols = sorted((a.row, b.row)), sorted((a.col, b.col))
        return {Ref(c, r, a.abs_col, a.abs_row) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)}
    return set().union(*map(_refs, node.args)) if node.args else set()


def _place(rule: Rule, ref: Ref) -> tuple[str, int, str, int]:
    """Where a reference of a rule lies: absolute, or at an offset from the cell."""
    row = ("at", ref.row) if ref.abs_row else ("by", ref.row - rule.start[0])
    col = ("at", ref.col) if ref.abs_col else ("by", ref.col - rule.start[1])
    return (*row, *col)


def _trees(rules: Sequence[Rule]) -> list[list[Node | None]]:
    out = []
    for rule in rules:
        trees: list[Node | None] = []
        for text in rule.formulas:
            try:
                trees.append(parse(text))
            except FormulaError:
                trees.append(None)
        out.append(trees)
    return out


TEXT_KINDS = ("containsText", "notContainsText", "beginsWith", "endsWith")


def lower_text(cell: Val) -> Column:
    """A cell's text as the text rules see it."""
    return F.coalesce(cell.pick(s=F.lower(cell.s), n=general(cell.n), b=F.lit(""), e=F.lit("")), F.lit(""))


def rule_hits(rule: Rule, operands: list[Val | None], cell: Val, kind: Column, text: Column) -> Column:
    """Whether the rule hits; never null. ``text`` is the cell's ``lower_text``."""
    no = F.lit(False)

    def operand(k: int) -> Column:
        """A numeric operand, null if it failed or is no number."""
        v = operands[k] if k < len(operands) else None
        return F.lit(None).cast("double") if v is None else v.pick(n=v.n, s=F.lit(None).cast("double"), b=F.lit(None).cast("double"), e=F.lit(None).cast("double"))

    if rule.kind == "cellIs":
        v, a, b = cell.n, operand(0), operand(1)
        tests = {
            "lessThan": v < a, "lessThanOrEqual": v <= a, "greaterThan": v > a, "greaterThanOrEqual": v >= a,
            "equal": F.abs(v - a) < 1e-9, "notEqual": F.abs(v - a) >= 1e-9,
            "between": (v >= F.least(a, b)) & (v <= F.greatest(a, b)) & a.isNotNull() & b.isNotNull(),
            "notBetween": ((v < F.least(a, b)) | (v > F.greatest(a, b))) & a.isNotNull() & b.isNotNull(),
        }
        hit = kind.isin("number", "shown") & tests.get(rule.operator, no)
    elif rule.kind == "expression":
        hit = operands[0].truthy() if operands and operands[0] is not None else no
    elif rule.kind in TEXT_KINDS:
        if rule.text is not None:
            needle = F.lit(rule.text.lower())
        elif operands and operands[0] is not None:
            v = operands[0]
            truth = F.when(v.truthy(), "true").otherwise("false")
            needle = F.when(~v.failed, v.pick(s=F.lower(v.s), n=truth, b=truth, e=truth))
        else:
            needle = F.lit(None).cast("string")
        hit = {
            "containsText": (needle != "") & text.contains(needle),
            "notContainsText": ~text.contains(needle),
            "beginsWith": text.startswith(needle),
            "endsWith": text.endswith(needle),
        }[rule.kind]
    elif rule.kind in ("containsBlanks", "notContainsBlanks"):
        blank = cell.pick(e=F.lit(True), n=no, s=no, b=no)
        hit = blank if rule.kind == "containsBlanks" else ~blank
    else:  # data bars, colour scales and the like give no format
        hit = no
    return F.coalesce(hit, no)


def _range_figures(cells: DataFrame, targets: DataFrame, keys: Sequence[str], ends: tuple, r: str, c: str, k: int) -> DataFrame:
    """``targets`` (keys, and ``r``, ``c`` if the range moves with them) with figures over the range's cells."""
    r1, r2, c1, c2 = ends
    last = cells.groupBy(*keys).agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    areas = targets.withColumns({"r1": r1, "r2": r2, "c1": c1, "c2": c2}).join(last, [*keys])
    areas = areas.withColumns({"r2": F.least("r2", "last_r"), "c2": F.least("c2", "last_c")}).where("r1 between 1 and r2 and c1 between 1 and c2")
    body = cells.where(F.col("kind").isin("number", "shown", "text", "bool")).select(*keys, "r", "c", "kind", "num", "txt", "flag")
    x = aggregates.numeric(F.col("kind"), F.col("num"), F.col("flag"))
    true = cell_value(F.col("kind"), F.col("num"), F.col("txt"), F.col("flag")).truthy()
    first = F.max(F.when((F.col("r") == F.col("r1")) & (F.col("c") == F.col("c1")), F.struct("kind", "num", "txt", "flag")))
    found = match_rectangles(body, areas, keys=keys).groupBy(*keys, *[n for n in (r, c) if n in targets.columns]).agg(
        first.alias("first"), aggregates.sheet_sum(x).alias("total"), aggregates.sheet_count(x).cast("double").alias("count"), aggregates.sheet_min(x).alias("least"),
        aggregates.sheet_max(x).alias("most"), F.count(F.lit(1)).cast("double").alias("filled"), F.count_if(true).cast("double").alias("true"), F.count_if(true.isNull()).cast("double").alias("unknown"),
    )
    own = [n for n in (*keys, r, c) if n in found.columns]
    return found.select(*[F.col(n).alias(n if n in (r, c) else f"area{k}_{n}") for n in own], F.struct(*[n for n in found.columns if n not in own]).alias(f"area{k}"))


def apply_rules(cells: DataFrame, rules: Sequence[Rule], *, name: str = "dxf", keys: Sequence[str] = KEYS) -> DataFrame:
    """``cells`` (keys, r, c, kind, num, txt, flag) with the format of the first rule that hits."""
    trees = _trees(rules)
    places: dict[tuple, int] = {}
    for rule, own in zip(rules, trees, strict=True):
        for tree in own:
            for ref in _refs(tree) if tree else ():
                places.setdefault(_place(rule, ref), len(places))
    spans: dict[tuple, list[Rule]] = {}
    for rule, own in zip(rules, trees, strict=True):
        for tree in own:
            for a, b in _ranges(tree) if tree else ():
                spans.setdefault((_place(rule, a), _place(rule, b)), []).append(rule)
    numbers = {ends: k for k, ends in enumerate(spans)}
    out = cells
    # References to a column of the cell's own row are one window for all; others are equi-joins.
    whole_row = Window.partitionBy(*keys, "r")
    here = F.struct("kind", "num", "txt", "flag")
    for (how_r, row, how_c, col), k in places.items():
        if (how_r, row, how_c) == ("by", 0, "at"):
            out = out.withColumn(f"ref{k}", F.max(F.when(F.col("c") == col, here)).over(whole_row))
            out = out.select("*", *[F.col(f"ref{k}.{x}").alias(f"ref{k}_{x}") for x in ("kind", "num", "txt", "flag")]).drop(f"ref{k}")
            continue
        to_r = F.lit(row) if how_r == "at" else F.col("r") + row
        to_c = F.lit(col) if how_c == "at" else F.col("c") + col
        other = cells.select(
            *[F.col(x).alias(f"ref{k}_{x}") for x in keys], F.col("r").alias(f"ref{k}_r"), F.col("c").alias(f"ref{k}_c"),
            *[F.col(x).alias(f"ref{k}_{x}") for x in ("kind", "num", "txt", "flag")],
        )
        same = (to_r == F.col(f"ref{k}_r")) & (to_c == F.col(f"ref{k}_c"))
        for x in keys:
            same = same & (F.col(x) == F.col(f"ref{k}_{x}"))
        out = out.join(other, same, "left")

    def edges(ends: tuple, r: str, c: str) -> tuple[Column, Column, Column, Column]:
        """First and last row and column of a range as read from the cell at ``r``, ``c``."""
        rows = [F.lit(p[1]) if p[0] == "at" else F.col(r) + p[1] for p in ends]
        cols = [F.lit(p[3]) if p[2] == "at" else F.col(c) + p[3] for p in ends]
        return F.least(*rows), F.greatest(*rows), F.least(*cols), F.greatest(*cols)

    for ends, k in numbers.items():
        r, c = f"area{k}_r", f"area{k}_c"
        moves = [(n, x) for n, x, at in (("r", r, 0), ("c", c, 2)) if any(p[at] == "by" for p in ends)]
        read = F.lit(False)
        for rule in spans[ends]:
            read = read | (F.col("r").between(rule.area[0], rule.area[2]) & F.col("c").between(rule.area[1], rule.area[3]))
        targets = cells.where(read).select(*keys, *[F.col(n).alias(x) for n, x in moves]).distinct()
        figures = _range_figures(cells, targets, keys, edges(ends, r, c), r, c, k)
        same = F.lit(True)
        for n, x in [*((x, f"area{k}_{x}") for x in keys), *moves]:
            same = same & (F.col(n) == F.col(x))
        out = out.join(figures, same, "left")

    def resolver(rule: Rule):
        def find(ref: Ref) -> Val:
            k = places[_place(rule, ref)]
            return Val(F.col(f"ref{k}_letter"), F.col(f"ref{k}_num"), F.col(f"ref{k}_txt"), F.col(f"ref{k}_flag"))

        def area(a: Ref, b: Ref) -> Area | None:
            if not _grouped(a, b):
                return None
            ends = (_place(rule, a), _place(rule, b))
            k, (r1, r2, c1, c2) = numbers[ends], edges(ends, "r", "c")
            get = lambda n, none=0.0: F.coalesce(F.col(f"area{k}.{n}"), F.lit(none))
            part = lambda n: F.col(f"area{k}.first.{n}")
            first = cell_value(F.coalesce(part("kind"), F.lit("empty")), part("num"), part("txt"), part("flag"))
            size = (r2 - r1 + 1).cast("double") * (c2 - c1 + 1)
            return Area(first, size, get("total"), get("count"), get("least", float("inf")), get("most", float("-inf")), get("filled"), get("true"), get("unknown"))

        find.area = area
        return find

    # Kinds are columns of a projection below the rules, so each is worked out once a cell. Texts are
    # not: only cells that a text rule gets to see need theirs.
    letters = {f"ref{k}_letter": kind_letter(F.col(f"ref{k}_kind")) for k in places.values()}
    out = out.withColumns({"cell_letter": kind_letter(F.col("kind")), **letters})
    kind = F.col("kind")
    cell = Val(F.col("cell_letter"), F.col("num"), F.col("txt"), F.col("flag"))
    tests = []
    for ordinal in sorted(range(len(rules)), key=lambda k: (rules[k].priority, k)):
        rule, own = rules[ordinal], []
        for tree in trees[ordinal]:
            try:
                own.append(None if tree is None else _first(_compile(tree, resolver(rule))))
            except FormulaError:
                own.append(None)
        r1, c1, r2, c2 = rule.area
        inside = F.col("r").between(r1, r2) & F.col("c").between(c1, c2)
        # References above or left of the sheet fail the rule.
        for tree in trees[ordinal]:
            for ref in _refs(tree).union(*_ranges(tree)) if tree else ():
                how_r, row, how_c, col = _place(rule, ref)
                inside = inside & (F.lit(True) if how_r == "at" else F.col("r") + row >= 1) & (F.lit(True) if how_c == "at" else F.col("c") + col >= 1)
        tests.append(F.when(inside & rule_hits(rule, own, cell, kind, lower_text(cell)), F.lit(rule.dxf)))
    chosen = F.coalesce(*tests) if tests else F.lit(None).cast("int")
    # As a lambda's value the choice stays out of the row loop's generated method, which grows too large
    # for the JVM to compile with a few rules.
    return out.select(*cells.columns, let(F.lit(0), lambda _: chosen).alias(name))


def match_rectangles(cells: DataFrame, areas: DataFrame, *, keys: Sequence[str] = KEYS, bucket: int = 64) -> DataFrame:
    """Cells joined with the rectangles (keys, r1, c1, r2, c2, ...) that hold them.

    Each rectangle is listed once for each bucket of columns and of ``16 * bucket`` rows that it
    meets, so the join is by key and bucket; the exact test follows.
    """
    tall = 16 * bucket
    spread = areas.withColumn("bc", F.explode(F.sequence(F.floor(F.col("c1") / bucket), F.floor(F.col("c2") / bucket))))
    spread = spread.withColumn("br", F.explode(F.sequence(F.floor(F.col("r1") / tall), F.floor(F.col("r2") / tall))))
    near = cells.withColumn("bc", F.floor(F.col("c") / bucket)).withColumn("br", F.floor(F.col("r") / tall))
    inside = F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2"))
    return near.join(spread, [*keys, "bc", "br"]).where(inside).drop("bc", "br")


def odf_condition(text: str) -> tuple[str, str, tuple[str, ...], str | None] | None:
    """(kind, operator, formulas, text) of an OpenDocument condition; None if it is not known."""
    import re

    t = text.strip()
    if m := re.fullmatch(r"(?:is-true-formula|formula-is)\((.*)\)", t, re.S):
        return "expression", "", (odf_formula(m[1]),), None
    t = re.sub(r"^cell-content\(\)\s*", "", t)
    if m := re.fullmatch(r"(?:cell-content-)?(is-)?(not-)?between\((.*)\)", t, re.S):
        a, b = _split_arguments(m[3])[:2]
        return "cellIs", "notBetween" if m[2] else "between", (odf_formula(a), odf_formula(b)), None
    for word, kind in (("begins-with", "beginsWith"), ("ends-with", "endsWith"), ("not-contains-text", "notContainsText"), ("contains-text", "containsText")):
        if m := re.fullmatch(rf"{word}\((.*)\)", t, re.S):
            return kind, "", (), m[1].strip().strip('"')
    for sign, operator in (("!=", "notEqual"), ("<>", "notEqual"), ("<=", "lessThanOrEqual"), (">=", "greaterThanOrEqual"), ("=", "equal"), ("<", "lessThan"), (">", "greaterThan")):
        if t.startswith(sign):
            return "cellIs", operator, (odf_formula(t[len(sign) :].strip()),), None
    return None


def _split_arguments(text: str) -> list[str]:
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == '"'
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c in ",;" and not quoted and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def odf_formula(text: str) -> str:
    """An OpenDocument formula in A1 style: [.A1:.B2] -> A1:B2, ; -> , and sheet names dropped."""
    import re

    t = re.sub(r"^(?:of:|oooc:)?=?", "", text.strip())
    t = re.sub(r"\[([^\]]*)\]", lambda m: ":".join(p.rpartition(".")[2] for p in m[1].split(":")), t)
    out, quoted = "", False
    for c in t:
        quoted ^= c == '"'
        out += "," if c == ";" and not quoted else c
    return out
