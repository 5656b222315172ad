"""Spreadsheet formulas compiled to Spark columns.

A formula text is read once on the driver into a small tree, and the tree becomes column
expressions, so a rule over a billion cells is ordinary generated code. A value is a kind
(``n`` number, ``s`` text, ``b`` logical, ``e`` empty) with a payload; a null kind or payload means
that the formula failed, and failure spreads to everything that uses the value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.numfmt import general

NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: Cells of a range that a resolver without areas lists one by one.
MAX_RANGE = 10_000


class FormulaError(ValueError):
    """The text is not a formula of this language; its value is null for every cell."""


# Reading -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Ref:
    col: int
    row: int
    abs_col: bool = False
    abs_row: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    value: object = None


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<str>"(?:[^"]|"")*")
    | (?P<sheet>'(?:[^']|'')*'!|[A-Za-z_][A-Za-z0-9_.]*!)
    | (?P<ref>\$?[A-Za-z]{1,3}\$?[0-9]+(?![A-Za-z0-9_(.]))
    | (?P<name>[A-Za-z_][A-Za-z0-9_.]*)
    | (?P<op><>|<=|>=|[-+*/^&=<>%])
    | (?P<mark>[(),;:])
    )""",
    re.VERBOSE,
)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def tokens(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    text, at = text.lstrip("=").rstrip(), 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unknown character at {at}: {text!r}")
        at, kind, raw = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "num":
            out.append(("num", float(raw)))
        elif kind == "str":
            out.append(("str", raw[1:-1].replace('""', '"')))
        elif kind == "ref":
            a, b, c, d = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)([0-9]+)", raw).groups()
            out.append(("ref", Ref(column_number(b), int(d), bool(a), bool(c))))
        elif kind == "name":
            out.append(("name", raw.upper()))
        elif kind != "sheet":  # a sheet's name is read and dropped
            out.append((kind, "," if raw == ";" else raw))
    return out


_BINARY = [("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",)]


class _Reader:
    """Precedence climbing; a sign binds tighter than a power, a percent sign tighter still."""

    def __init__(self, text: str) -> None:
        self.rest = tokens(text)

    def take(self, *wanted: tuple[str, object]) -> object:
        if self.rest and self.rest[0] in wanted:
            return self.rest.pop(0)[1]
        return None

    def whole(self) -> Node:
        out = self.level(0)
        if self.rest:
            raise FormulaError(f"left over: {self.rest}")
        return out

    def level(self, k: int) -> Node:
        if k == len(_BINARY):
            return self.signed()
        left = self.level(k + 1)
        while op := self.take(*[("op", x) for x in _BINARY[k]]):
            left = Node("binary", (left, self.level(k + 1)), op)
        return left

    def signed(self) -> Node:
        if op := self.take(("op", "-"), ("op", "+")):
            return Node("sign", (self.signed(),), op)
        out = self.single()
        while self.take(("op", "%")):
            out = Node("percent", (out,))
        return out

    def single(self) -> Node:
        if not self.rest:
            raise FormulaError("ends too early")
        kind, value = self.rest.pop(0)
        if kind in ("num", "str"):
            return Node(kind, (), value)
        if (kind, value) == ("mark", "("):
            out = self.level(0)
            if not self.take(("mark", ")")):
                raise FormulaError("a parenthesis is open")
            return out
        if kind == "ref":
            if self.take(("mark", ":")):
                if not self.rest or self.rest[0][0] != "ref":
                    raise FormulaError("half a range")
                return Node("range", (), (value, self.rest.pop(0)[1]))
            return Node("ref", (), value)
        if kind == "name":
            if self.take(("mark", "(")):
                args: list[Node] = []
                if not self.take(("mark", ")")):
                    while True:
                        args.append(self.level(0))
                        if self.take(("mark", ")")):
                            break
                        if not self.take(("mark", ",")):
                            raise FormulaError("an argument list is open")
                return Node("call", tuple(args), value)
            if value in ("TRUE", "FALSE"):
                return Node("bool", (), value == "TRUE")
        raise FormulaError(f"unexpected {value!r}")


def parse(text: str) -> Node:
    return _Reader(text).whole()


# Values ------------------------------------------------------------------------------------------

def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Val:
    """``kind`` is a letter if it is known when compiling, else a column."""

    kind: str | Column
    n: Column = field(default_factory=lambda: _null("double"))
    s: Column = field(default_factory=lambda: _null("string"))
    b: Column = field(default_factory=lambda: _null("boolean"))

    def pick(self, **by_kind: Column) -> Column:
        """The column for the value's kind; null for a failed value."""
        if isinstance(self.kind, str):
            return by_kind[self.kind]
        out = None
        for k, c in by_kind.items():
            out = F.when(self.kind == k, c) if out is None else out.when(self.kind == k, c)
        return out

    @property
    def failed(self) -> Column:
        if isinstance(self.kind, str):
            return {"n": self.n.isNull(), "s": self.s.isNull(), "b": self.b.isNull(), "e": F.lit(False)}[self.kind]
        return self.kind.isNull()

    def number(self) -> Column:
        trimmed = F.trim(self.s)
        read = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
        return self.pick(n=self.n, b=F.when(self.b, 1.0).when(~self.b, 0.0), e=F.lit(0.0), s=read)

    def text(self) -> Column:
        return self.pick(n=general(self.n), b=F.when(self.b, "TRUE").when(~self.b, "FALSE"), e=F.lit(""), s=self.s)

    def truthy(self) -> Column:
        return self.pick(n=self.n != 0.0, b=self.b, e=F.lit(False), s=self.s != "")


def num(c: Column | float) -> Val:
    return Val("n", n=c if isinstance(c, Column) else F.lit(float(c)))


def txt(c: Column | str) -> Val:
    return Val("s", s=c if isinstance(c, Column) else F.lit(c))


def flag(c: Column | bool) -> Val:
    return Val("b", b=c if isinstance(c, Column) else F.lit(c))


EMPTY = "e"


@dataclass
class Area:
    """A range of cells, none of which can fail, as its first cell and figures over all; no column is null."""

    first: Val
    size: Column  # cells, filled or not
    total: Column
    count: Column  # numbers and logicals
    least: Column  # plus infinity without numbers
    most: Column
    filled: Column
    true: Column  # cells that are true, and cells whose truth is null
    unknown: Column


def kind_letter(kind: Column) -> Column:
    """A kind of the ``cells`` table as that of a value: number, shown, text, bool; else empty."""
    return F.when(kind.isin("number", "shown"), "n").when(kind == "text", "s").when(kind == "bool", "b").otherwise("e")


def cell_value(kind: Column, n: Column, s: Column, b: Column) -> Val:
    """A cell of the ``cells`` table."""
    return Val(kind_letter(kind), n, s, b)


def _either(yes: Column, a: Val, b: Val) -> Val:
    """a where ``yes``, else b; failed where the condition or either branch failed."""
    bad = yes.isNull() | a.failed | b.failed
    if isinstance(a.kind, str) and isinstance(b.kind, str) and a.kind == b.kind:
        pick = lambda x, y: F.when(~bad, F.when(yes, x).otherwise(y))
        return Val(a.kind, pick(a.n, b.n), pick(a.s, b.s), pick(a.b, b.b))
    of = lambda v: F.lit(v.kind) if isinstance(v.kind, str) else v.kind
    pick = lambda x, y: F.when(yes, x).otherwise(y)
    return Val(F.when(~bad, pick(of(a), of(b))), pick(a.n, b.n), pick(a.s, b.s), pick(a.b, b.b))


# Compiling ---------------------------------------------------------------------------------------

#: A resolver may also have ``area(a, b)``: the range as an Area, or None if its cells are to be listed.
Resolver = Callable[[Ref], "Val | None"]


def _scalars(args: list) -> list[Val]:
    return [v for a in args if not isinstance(a, Area) for v in (a if isinstance(a, list) else [a])]


def _first(a) -> Val:
    if isinstance(a, Area):
        return a.first
    return (a[0] if a else Val(EMPTY)) if isinstance(a, list) else a


def _any_failed(vals: list[Val]) -> Column:
    out = F.lit(False)
    for v in vals:
        if not (isinstance(v.kind, str) and v.kind == EMPTY):
            out = out | v.failed
    return out


def _unless(bad: Column, c: Column) -> Column:
    return F.when(~bad, c)


def _compare(op: str, a: Val, b: Val) -> Column:
    fits = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    as_text = fits(F.lower(a.text()), F.lower(b.text()))
    as_number = fits(a.number(), b.number())
    if any(isinstance(v.kind, str) and v.kind == "s" for v in (a, b)):
        return as_text
    if isinstance(a.kind, str) and isinstance(b.kind, str):
        return as_number
    text = F.lit(False)
    for v in (a, b):
        if not isinstance(v.kind, str):
            text = text | (v.kind == "s")
    return F.when(text, as_text).otherwise(as_number)


def round_half_away(x: Column, digits: Column) -> Column:
    f = F.pow(F.lit(10.0), digits)
    return F.signum(x * f) * F.floor(F.abs(x * f) + 0.5).cast("double") / f


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a divisor of 0."""
    return a - b * F.floor(F.try_divide(a, b)).cast("double")


def _numbers(vals: list[Val]) -> Column:
    """The numbers and logicals among scalars, as an array."""
    items = [v.pick(n=v.n, b=F.when(v.b, 1.0).when(~v.b, 0.0), s=_null("double"), e=_null("double")) for v in vals]
    if not items:
        return F.array().cast("array<double>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _whole(c: Column) -> Column:
    """A count: towards zero, not below zero."""
    return F.greatest(F.lit(0), c.cast("int"))


def _call(name: str, args: list) -> Val:
    vals = _scalars(args)
    areas = [a for a in args if isinstance(a, Area)]
    bad = _any_failed(vals)
    first = _first(args[0]) if args else Val(EMPTY)

    def arg(k: int, default: float) -> Column:
        return F.coalesce(_first(args[k]).number(), F.lit(default)) if len(args) > k else F.lit(default)

    if name in ("SUM", "AVERAGE", "MIN", "MAX", "COUNT"):
        xs = _numbers(vals)
        total = sum((a.total for a in areas), F.aggregate(xs, F.lit(0.0), lambda a, x: a + x))
        count = sum((a.count for a in areas), F.size(xs).cast("double"))
        out = {
            "SUM": total,
            "AVERAGE": F.try_divide(total, count),
            "MIN": F.coalesce(F.array_min(F.concat(xs, F.array(*[a.least for a in areas])) if areas else xs), F.lit(float("inf"))),
            "MAX": F.coalesce(F.array_max(F.concat(xs, F.array(*[a.most for a in areas])) if areas else xs), F.lit(float("-inf"))),
            "COUNT": count,
        }[name]
        return num(_unless(bad, out))
    if name in ("COUNTA", "COUNTBLANK"):
        empty = sum((F.when(v.pick(n=F.lit(False), s=F.lit(False), b=F.lit(False), e=F.lit(True)), 1.0).otherwise(0.0) for v in vals), F.lit(0.0))
        blank = sum((a.size - a.filled for a in areas), empty)
        filled = sum((a.filled for a in areas), F.lit(float(len(vals))) - empty)
        return num(_unless(bad, blank if name == "COUNTBLANK" else filled))
    if name in ("AND", "OR"):
        out = F.lit(name == "AND")
        for v in vals:
            out = out & v.truthy() if name == "AND" else out | v.truthy()
        for a in areas:
            false = a.size - a.true - a.unknown
            if name == "AND":
                out = out & F.when(false > 0, False).when(a.unknown == 0, True)
            else:
                out = out | F.when(a.true > 0, True).when(a.unknown == 0, False)
        return flag(_unless(bad, out))
    if name == "NOT":
        return flag(_unless(bad, ~first.truthy()))
    if name == "IF":
        branches = [_first(a) for a in args[1:3]] + [flag(True), flag(False)][len(args[1:3]) :]
        return _either(_unless(bad, first.truthy()), branches[0], branches[1])
    if name == "IFERROR":
        if isinstance(first.kind, str):
            return Val(first.kind, _unless(bad, first.n), _unless(bad, first.s), _unless(bad, first.b)) if len(args) > 1 else first
        return Val(_unless(bad, first.kind), first.n, first.s, first.b)
    if name in ("ISBLANK", "ISNUMBER", "ISTEXT"):
        wanted = {"ISBLANK": "e", "ISNUMBER": "n", "ISTEXT": "s"}[name]
        return flag(_unless(bad, first.pick(**{k: F.lit(k == wanted) for k in "nsbe"})))
    if name in ("ABS", "INT", "VALUE", "N", "ROUND", "MOD", "ISEVEN", "ISODD"):
        x = first.number()
        if name in ("ISEVEN", "ISODD"):
            even = F.abs(F.signum(x) * F.floor(F.abs(x))) % 2 == 0
            return flag(_unless(bad, even if name == "ISEVEN" else ~even))
        if name == "MOD":
            if len(args) < 2:
                raise FormulaError("MOD takes two values")
            return num(_unless(bad, floor_mod(x, _first(args[1]).number())))
        out = {"ABS": F.abs(x), "INT": F.floor(x).cast("double"), "VALUE": x, "N": x, "ROUND": round_half_away(x, arg(1, 0.0))}[name]
        return num(_unless(bad, out))
    t = first.text()
    if name == "LEN":
        return num(_unless(bad, F.char_length(t).cast("double")))
    if name == "EXACT":
        if len(args) < 2:
            raise FormulaError("EXACT takes two values")
        return flag(_unless(bad, t == _first(args[1]).text()))
    if name in ("UPPER", "LOWER", "TRIM", "LEFT", "RIGHT", "MID"):
        n = _whole(arg(1, 1.0))
        out = {
            "UPPER": F.upper(t),
            "LOWER": F.lower(t),
            "TRIM": F.trim(F.regexp_replace(t, r"(?U)\s+", " ")),
            "LEFT": F.substring(t, F.lit(1), n),
            "RIGHT": F.substring(t, F.greatest(F.char_length(t) - n, F.lit(0)) + 1, n),
            "MID": F.substring(t, F.greatest(F.lit(1), arg(1, 1.0).cast("int")), _whole(arg(2, 0.0))),
        }[name]
        return txt(_unless(bad, out))
    raise FormulaError(f"unknown function {name}")


def _compile(node: Node, cell: Resolver):
    if node.op == "num":
        return num(node.value)
    if node.op == "str":
        return txt(node.value)
    if node.op == "bool":
        return flag(node.value)
    if node.op == "ref":
        found = cell(node.value)
        if found is None:
            raise FormulaError("a reference leaves the sheet")
        return found
    if node.op == "range":
        a, b = node.value
        whole = cell.area(a, b) if hasattr(cell, "area") else None
        if whole is not None:
            return whole
        rows, cols = sorted((a.row, b.row)), sorted((a.col, b.col))
        if (rows[1] - rows[0] + 1) * (cols[1] - cols[0] + 1) > MAX_RANGE:
            raise FormulaError("a range this large needs a resolver with areas")
        found = [cell(Ref(c, r, a.abs_col, a.abs_row)) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)]
        if None in found:
            raise FormulaError("a reference leaves the sheet")
        return found
    if node.op == "call":
        return _call(node.value, [_compile(a, cell) for a in node.args])
    args = [_first(_compile(a, cell)) for a in node.args]
    if node.op == "percent":
        return num(args[0].number() / 100.0)
    if node.op == "sign":
        return num(-args[0].number() if node.value == "-" else args[0].number())
    a, b = args
    if node.value == "&":
        return txt(F.concat(a.text(), b.text()))
    if node.value in ("+", "-", "*", "/", "^"):
        x, y = a.number(), b.number()
        return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "^": lambda: F.pow(x, y)}[node.value]())
    return flag(_unless(a.failed | b.failed, _compare(node.value, a, b)))


def compile_formula(text: str, cell: Resolver) -> Val | None:
    """The formula's value as columns; None if it is no formula (its value is null everywhere)."""
    try:
        return _first(_compile(parse(text), cell))
    except FormulaError:
        return None


def columns_as_cells(by_column: dict[str, Val]) -> Resolver:
    """References read the current row: A1, B1, ... are the named columns, whatever the row number."""
    numbered = {column_number(k): v for k, v in by_column.items()}
    return lambda ref: numbered.get(ref.col, Val(EMPTY)) if ref.col >= 1 and ref.row >= 1 else None
