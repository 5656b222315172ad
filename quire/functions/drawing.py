"""Drawings as data: shape equations, colour modifiers, nested transforms, header codes, names."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from quire.functions.scalars import _from_hsl, _to_hsl, colour_hex, colour_parts, let

# Equations ---------------------------------------------------------------------------------------

DEPTH = 64
_PART = re.compile(r"\s*(?:([0-9.][0-9.eE]*)|([^\W\d]\w*|[?$]\w*)|(\S))")
_CALLS: dict[str, Callable[..., float]] = {
    "abs": lambda a, b, c: abs(a), "sqrt": lambda a, b, c: math.sqrt(max(a, 0.0)), "sin": lambda a, b, c: math.sin(a), "cos": lambda a, b, c: math.cos(a),
    "tan": lambda a, b, c: math.tan(a), "atan": lambda a, b, c: math.atan(a), "atan2": lambda a, b, c: math.atan2(a, b),
    "min": lambda a, b, c: min(a, b), "max": lambda a, b, c: max(a, b), "if": lambda a, b, c: b if a > 0 else c, "pi": lambda a, b, c: math.pi,
}


@lru_cache(maxsize=4096)
def _parts(formula: str) -> tuple[tuple[str | None, ...], ...]:
    """Numbers, words and marks of a formula in turn; sheets of shapes repeat their formulas."""
    return tuple(m.groups() for m in _PART.finditer(formula))


def equation_value(text: str, equations: Mapping[str, str] = {}, modifiers: Sequence[float] = (), names: Mapping[str, float] = {}) -> float:  # noqa: B006
    """Value of a shape formula. ``?name`` is another equation, ``$n`` a modifier; what is missing,
    a division by 0 and a circle of equations over 64 deep are 0."""
    known: dict[str, float] = {}

    def lookup(word: str, depth: int) -> float:
        if word[0] == "$":
            return modifiers[int(word[1:])] if word[1:].isdigit() and int(word[1:]) < len(modifiers) else 0.0
        name = word[1:]
        if name not in known:
            if depth > DEPTH or name not in equations:
                return 0.0
            known[name] = run(equations[name], depth + 1)
        return known[name]

    def run(formula: str, depth: int) -> float:
        parts = _parts(formula)
        at = 0

        def sign() -> str | None:
            return parts[at][2] if at < len(parts) else None

        def chain(signs: str, below: Callable[[], float]) -> float:
            nonlocal at
            out = below()
            while (s := sign()) and s in signs:
                at += 1
                right = below()
                out = {"+": lambda: out + right, "-": lambda: out - right, "*": lambda: out * right, "/": lambda: out / right if right else 0.0}[s]()  # noqa: B023
            return out

        def total() -> float:
            return chain("+-", lambda: chain("*/", single))

        def single() -> float:
            nonlocal at
            if at >= len(parts):
                return 0.0
            number, word, mark = parts[at]
            at += 1
            if number is not None:
                try:
                    return float(number)
                except ValueError:
                    return 0.0
            if mark is not None:
                if mark in "+-":
                    return -single() if mark == "-" else single()
                if mark == "(":
                    out = total()
                    at += sign() == ")"
                    return out
                return 0.0
            if word[0] in "?$":
                return lookup(word, depth)
            args: list[float] = []
            if sign() == "(":
                at += 1
                while sign() != ")" and at < len(parts):
                    args.append(total())
                    if sign() != ",":
                        break
                    at += 1
                at += sign() == ")"
            return _CALLS[word](*(args + [0.0] * 3)[:3]) if word in _CALLS else names.get(word, 0.0)

        return total()

    return run(text, 0)


@pandas_udf(DoubleType())
def equation(text: pd.Series, equations: pd.Series, modifiers: pd.Series, names: pd.Series) -> pd.Series:
    """``equation_value`` of columns: text, map<string,string>, array<double>, map<string,double>."""
    return pd.Series([None if t is None else equation_value(t, dict(e or {}), [] if m is None else list(m), dict(n or {})) for t, e, m, n in zip(text, equations, modifiers, names, strict=True)], dtype="float64")


# Colours -----------------------------------------------------------------------------------------

#: Colours by name.
PRESETS = {
    "black": "#000000", "windowtext": "#000000", "white": "#ffffff", "window": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00",
    "gray": "#808080", "grey": "#808080", "ltgray": "#d3d3d3", "lightgray": "#d3d3d3", "dkgray": "#a9a9a9", "darkgray": "#a9a9a9", "orange": "#ffa500", "purple": "#800080",
}


def preset_colour(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRESETS.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def _linear(x: Column) -> Column:
    c = x / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _gamma(v: Column) -> Column:
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    c = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.floor(c * 255 + 0.5).cast("int")


def modified_colour(hexed: Column, modifiers: Column) -> Column:
    """A colour under modifiers (array<struct<name, val>>, val a share) in their order.

    lumMod, lumOff, satMod and hueMod change lightness, saturation and hue; tint and shade mix with
    white and black in linear light, and once one has done so the others have no part.
    """
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    def state(h, s, l, rgb):  # noqa: E741
        return F.struct(h.alias("h"), s.alias("s"), l.alias("l"), rgb.alias("rgb"))

    def step(a: Column, m: Column) -> Column:
        name, v = m["name"], m["val"]
        now = F.coalesce(a["rgb"], _from_hsl(F.struct(a["h"].alias("h"), a["s"].alias("s"), a["l"].alias("l"))))

        def mixed(f: Callable[[Column], Column]) -> Column:
            return let(colour_parts(now), lambda p: colour_hex(*[_gamma(f(_linear(p[k]))) for k in "rgb"]))

        light = F.when(name == "lumMod", unit(a["l"] * v)).when(name == "lumOff", unit(a["l"] + v)).otherwise(a["l"])
        rgb = F.when(name == "tint", mixed(lambda x: 1.0 - (1.0 - x) * v)).when(name == "shade", mixed(lambda x: x * v)).otherwise(a["rgb"])
        return state(F.when(name == "hueMod", F.pmod(a["h"] * v, F.lit(1.0))).otherwise(a["h"]), F.when(name == "satMod", unit(a["s"] * v)).otherwise(a["s"]), light, rgb)

    def whole(hsl: Column) -> Column:
        start = state(hsl["h"], hsl["s"], hsl["l"], F.lit(None).cast("string"))
        return F.aggregate(F.filter(modifiers, lambda m: m["val"].isNotNull()), start, step, lambda a: F.coalesce(a["rgb"], _from_hsl(F.struct(a["h"].alias("h"), a["s"].alias("s"), a["l"].alias("l")))))

    return let(colour_parts(hexed), lambda p: F.when(p.isNotNull(), let(_to_hsl(p), whole)))


# Transforms --------------------------------------------------------------------------------------

def placed(box: Column, groups: Column) -> Column:
    """A box struct(x, y, w, h) in slide points, through the groups around it, outermost first.

    A group is struct(x, y, w, h, cx, cy, cw, ch): its place, and the coordinates inside it.
    """
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("ox", 0.0), ("oy", 0.0), ("cx", 0.0), ("cy", 0.0), ("sx", 1.0), ("sy", 1.0))])

    def into(t: Column, g: Column) -> Column:
        sx, sy = F.coalesce(F.try_divide(g["w"], g["cw"]), F.lit(1.0)), F.coalesce(F.try_divide(g["h"], g["ch"]), F.lit(1.0))
        return F.struct(
            (t["ox"] + (g["x"] - t["cx"]) * t["sx"]).alias("ox"), (t["oy"] + (g["y"] - t["cy"]) * t["sy"]).alias("oy"),
            g["cx"].alias("cx"), g["cy"].alias("cy"), (t["sx"] * sx).alias("sx"), (t["sy"] * sy).alias("sy"),
        )

    def put(t: Column) -> Column:
        return F.struct((t["ox"] + (box["x"] - t["cx"]) * t["sx"]).alias("x"), (t["oy"] + (box["y"] - t["cy"]) * t["sy"]).alias("y"), (box["w"] * t["sx"]).alias("w"), (box["h"] * t["sy"]).alias("h"))

    return F.aggregate(groups, start, into, put)


# Headers and names -------------------------------------------------------------------------------

HEADER = ArrayType(StructType([
    StructField("zone", StringType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("bold", BooleanType()),
    StructField("italic", BooleanType()), StructField("underline", BooleanType()), StructField("font", StringType()), StructField("size", DoubleType()),
]))
_CODE = re.compile(r'&(?:"(?P<font>[^"]*)"?|(?P<size>[0-9]+)|(?P<one>.))|(?P<text>[^&]+)|&$', re.S)


def header_parts(code: str | None, sheet: str = "", size: float = 10.0, scale: float = 1.0) -> list[dict]:
    """Pieces of a header or footer: zone left, center or right; kind text, page or pages."""
    look = {"bold": None, "italic": None, "underline": None, "font": None, "size": size * scale}
    zone, held, out = "center", {"left": "", "center": "", "right": ""}, []

    def flush() -> None:
        if held[zone]:
            out.append({"zone": zone, "kind": "text", "text": held[zone], **look})
            held[zone] = ""

    for m in _CODE.finditer(code or ""):
        one = m["one"]
        if m["text"] is not None:
            held[zone] += m["text"]
        elif m["font"] is not None:
            flush()
            font, _, style = m["font"].partition(",")
            if font not in ("", "-"):
                look["font"] = font
            look["bold"], look["italic"] = "bold" in style.lower(), "italic" in style.lower()
        elif m["size"] is not None:
            flush()
            look["size"] = float(m["size"]) * scale
        elif one in ("A", "&"):
            held[zone] += sheet if one == "A" else "&"
        elif one is not None and one in "LCRPNBIU":
            flush()
            if one in "LCR":
                zone = {"L": "left", "C": "center", "R": "right"}[one]
            elif one in "PN":
                out.append({"zone": zone, "kind": "page" if one == "P" else "pages", "text": None, **look})
            else:
                key = {"B": "bold", "I": "italic", "U": "underline"}[one]
                look[key] = look[key] is not True
    flush()
    order = ("left", "center", "right")
    return sorted(out, key=lambda p: order.index(p["zone"]))


@pandas_udf(HEADER)
def header_runs(code: pd.Series, sheet: pd.Series) -> pd.Series:
    return pd.Series([header_parts(c, s or "") for c, s in zip(code, sheet, strict=True)])


def encode_style_name(name: Column) -> Column:
    """Letters, digits, - and . as they are; other characters as _hex_."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    coded = F.transform(chars, lambda c: F.when(c.rlike(r"^[A-Za-z0-9.-]$"), c).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.ascii(c))), F.lit("_"))))
    return F.array_join(coded, "")


def vml_style(text: Column) -> Column:
    """A style attribute as a map; later entries win, names and values are trimmed."""
    pairs = F.filter(F.split(text, ";"), lambda p: p.contains(":"))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)
