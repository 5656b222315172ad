"""Scalar functions of documents and sheets as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell references ---------------------------------------------------------------------------------

MAX_ROWS, MAX_COLS = 1_048_576, 16_384


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters, null below 1."""
    a = n - 1
    two, three = F.floor((a - 26) / 26), F.floor((a - 702) / 676)
    letter = lambda k: F.char(k + 65)
    last = letter(F.pmod(a, F.lit(26)))
    middle = letter(F.pmod(two, F.lit(26)))
    return (
        F.when(n < 1, F.lit(None).cast("string"))
        .when(n <= 26, last)
        .when(n <= 702, F.concat(middle, last))
        .otherwise(F.concat(letter(three), middle, last))
    )


def column_number(letters: Column) -> Column:
    """A -> 1, AA -> 27, by a fold over the letters."""
    chars = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Za-z]+$"), F.aggregate(chars, F.lit(0), lambda a, x: a * 26 + x))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def parse_a1(ref: Column) -> Column:
    """struct(row, col) of a reference; a sheet prefix and $ signs are dropped. Null if it is none."""
    bare = F.replace(F.regexp_replace(ref, r"^.*!", ""), F.lit("$"), F.lit(""))
    letters = F.regexp_extract(bare, r"^([A-Za-z]+)[0-9]+$", 1)
    row = F.regexp_extract(bare, r"^[A-Za-z]+([0-9]+)$", 1).try_cast("int")
    return F.when(bare.rlike(r"^[A-Za-z]{1,3}[0-9]{1,7}$") & (row >= 1), F.struct(row.alias("row"), column_number(letters).alias("col")))


def parse_range(ref: Column) -> Column:
    """struct(r1, c1, r2, c2) of A1 or A1:B2, corners in order."""
    bare = F.regexp_replace(ref, r"^.*!", "")
    parts = F.split(bare, ":")
    a, b = parse_a1(parts[0]), parse_a1(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(parts[0]))
    return F.when(
        a.isNotNull() & b.isNotNull() & (F.size(parts) <= 2),
        F.struct(
            F.least(a["row"], b["row"]).alias("r1"), F.least(a["col"], b["col"]).alias("c1"),
            F.greatest(a["row"], b["row"]).alias("r2"), F.greatest(a["col"], b["col"]).alias("c2"),
        ),
    )


# Numerals ----------------------------------------------------------------------------------------

#: Parts of roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Upper-case roman numeral; plain digits for 0 and below."""
    out, rest = F.lit(""), n
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n <= 0, n.cast("string")).otherwise(out)


def letters(n: Column) -> Column:
    """A..Z, then AA, BB, ...: the letter repeats. Empty for 0 and below."""
    letter = F.char(F.pmod(n - 1, F.lit(26)) + 65)
    return F.when(n <= 0, "").otherwise(F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int")))


def ordinal(n: Column) -> Column:
    last, two = n % 10, n % 100
    end = F.when((last == 1) & (two != 11), "st").when((last == 2) & (two != 12), "nd").when((last == 3) & (two != 13), "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def numeral(n: Column, form: str) -> Column:
    """A counter in one of the list formats."""
    made = {
        "none": lambda: F.lit(""),
        "lowerLetter": lambda: F.lower(letters(n)),
        "upperLetter": lambda: letters(n),
        "lowerRoman": lambda: F.lower(roman(n)),
        "upperRoman": lambda: roman(n),
        "decimalZero": lambda: F.when(F.abs(n) < 10, F.format_string("%02d", n)).otherwise(n.cast("string")),
        "ordinal": lambda: ordinal(n),
    }
    return made.get(form, lambda: n.cast("string"))()


def page_pattern(form: str | None) -> str:
    """Numbering pattern of page numbers by their format's name."""
    return {"lowerRoman": "i", "upperRoman": "I", "lowerLetter": "a", "upperLetter": "A"}.get(form or "", "1")


def page_number(n: Column, pattern: str) -> Column:
    return numeral(n, {"i": "lowerRoman", "I": "upperRoman", "a": "lowerLetter", "A": "upperLetter"}.get(pattern, "decimal"))


#: Private-use symbols of bullets.
BULLETS = {0xF0B7: "•", 0xF0FC: "•", 0xF0A8: "•", 0xF0A7: "▪", 0xF0A0: "▪", 0xF0D8: "➢", 0xF076: "❖", 0xF0B2: "□", 0xF071: "□", 0xF06E: "■", 0xF0DE: "⇨"}


def bullet_text(t: Column) -> Column:
    """Private-use bullet symbols as their public ones; others of that block are a plain bullet."""
    known = F.translate(t, "".join(map(chr, BULLETS)), "".join(BULLETS.values()))
    return F.regexp_replace(known, "[\\uF000-\\uF0FF]", "•")


# Colours -----------------------------------------------------------------------------------------

def colour_parts(hexed: Column) -> Column:
    """struct(r, g, b) of #rrggbb or rrggbb; null for anything else."""
    h = F.regexp_replace(hexed, "^#", "")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("int")), 2, "0")) for x in (r, g, b)])


def _byte(x: Column) -> Column:
    """Rounded half up and kept in 0..255."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _to_hsl(p: Column) -> Column:
    r, g, b = (p[k] / 255.0 for k in "rgb")
    ends = F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("most"), F.least(r, g, b).alias("least"))

    def made(e: Column) -> Column:
        d, total = e["most"] - e["least"], e["most"] + e["least"]
        sat = F.when(d == 0, 0.0).when(total > 1.0, F.try_divide(d, 2 - total)).otherwise(F.try_divide(d, total))
        hue = (
            F.when(d == 0, 0.0)
            .when(e["most"] == e["r"], F.try_divide(e["g"] - e["b"], d) + F.when(e["g"] < e["b"], 6.0).otherwise(0.0))
            .when(e["most"] == e["g"], F.try_divide(e["b"] - e["r"], d) + 2)
            .otherwise(F.try_divide(e["r"] - e["g"], d) + 4)
        )
        return F.struct((hue / 6).alias("h"), sat.alias("s"), (total / 2).alias("l"))

    return let(ends, made)


def _from_hsl(x: Column) -> Column:
    q = F.when(x["l"] < 0.5, x["l"] * (1 + x["s"])).otherwise(x["l"] + x["s"] - x["l"] * x["s"])

    def channel(e: Column, shift: float) -> Column:
        base = 2 * e["l"] - e["q"]
        turned = let(F.pmod(e["h"] + shift, F.lit(1.0)), lambda t: (
            F.when(t < 1 / 6, base + (e["q"] - base) * 6 * t)
            .when(t < 1 / 2, e["q"])
            .when(t < 2 / 3, base + (e["q"] - base) * (2 / 3 - t) * 6)
            .otherwise(base)
        ))
        return _byte(F.when(e["s"] == 0, e["l"]).otherwise(turned) * 255)

    whole = F.struct(x["h"].alias("h"), x["s"].alias("s"), x["l"].alias("l"), q.alias("q"))
    return let(whole, lambda e: colour_hex(channel(e, 1 / 3), channel(e, 0.0), channel(e, -1 / 3)))


def tint(hexed: Column, amount: Column) -> Column:
    """Lightness moved towards white (amount above 0) or black (below), hue and saturation kept."""

    def moved(x: Column) -> Column:
        light = F.when(amount < 0, x["l"] * (1 + amount)).otherwise(x["l"] * (1 - amount) + amount)
        return F.struct(x["h"].alias("h"), x["s"].alias("s"), light.alias("l"))

    return let(colour_parts(hexed), lambda p: F.when(p.isNotNull(), let(let(_to_hsl(p), moved), _from_hsl)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey value: weights 299, 587, 114 of a thousand, cut to a whole number."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


# Lengths -----------------------------------------------------------------------------------------

#: Points for one unit.
POINTS = {"pt": 1.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pc": 12.0, "px": 0.75}


def length_points(t: Column) -> Column:
    """A length with its unit in points; null for other text."""
    value = F.regexp_extract(F.trim(t), r"^([+-]?[0-9]*\.?[0-9]+)\s*[a-z]+$", 1).try_cast("double")
    unit = F.regexp_extract(F.trim(t), r"([a-z]+)$", 1)
    out = F.lit(None).cast("double")
    for name, points in POINTS.items():
        out = F.when(unit == name, value * points).otherwise(out)
    return out


def percent_share(t: Column) -> Column:
    return F.regexp_extract(F.trim(t), r"^([+-]?[0-9]*\.?[0-9]+)\s*%$", 1).try_cast("double") / 100.0


def clamped_size(width: Column, height: Column, most: Column) -> Column:
    """struct(width, height) of a picture no wider than ``most``, its shape kept."""
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(most, width), F.lit(1.0)))
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"))


def emu_points(n: Column) -> Column:
    return n / 12700.0


def twip_points(n: Column) -> Column:
    return n / 20.0


def half_points(n: Column) -> Column:
    return n / 2.0


# Text --------------------------------------------------------------------------------------------

def strip_tags(html: Column) -> Column:
    """Tags go (an unclosed one takes the rest), white space collapses."""
    return collapse_space(F.regexp_replace(html, r"<[^>]*(?:>|$)", ""))


def collapse_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: The five predefined entities, ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def unescape(t: Column) -> Column:
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return t


def collect_tags(t: Column, tag: str) -> Column:
    """Texts between <tag ...> and </tag>, in order."""
    return F.regexp_extract_all(t, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def word_tokens(t: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def unmappable(t: Column) -> Column:
    """Replacement characters in a text."""
    return F.char_length(t) - F.char_length(F.replace(t, F.lit("�"), F.lit("")))


def small_caps(t: Column) -> Column:
    """Stretches struct(text, scale): lower-case ones upper-cased at 0.8 of the size."""
    parts = F.regexp_extract_all(t, F.lit(r"\p{Ll}+|[^\p{Ll}]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.upper(p).alias("text"), F.when(p.rlike(r"^\p{Ll}"), 0.8).otherwise(1.0).alias("scale")))


def nice_axis(low: Column, high: Column) -> Column:
    """struct(low, high, step) of an axis that shows 0: steps of 1, 2, 5 or 10 times a power of ten."""
    lo = F.least(low, F.lit(0.0))
    hi = F.when(high > lo, high).otherwise(lo + 1.0)
    raw = (hi - lo) / 9.0
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    lead = raw / power
    step = power * F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)
    top = F.floor(hi / step + 1e-9).cast("double") * step + step
    return F.struct((F.floor(lo / step).cast("double") * step).alias("low"), top.alias("high"), step.alias("step"))


def axis_ticks(axis: Column) -> Column:
    """Places of an axis' ticks, from its low to its high end."""
    n = F.floor((axis["high"] - axis["low"]) / axis["step"] + 0.01).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: axis["low"] + k * axis["step"])


def next_tab(stops: Column, x: Column, left: Column, hanging: Column, grid: Column, by_indent: bool = False) -> Column:
    """The nearest tab stop behind x, the indent among them if it hangs, else the next grid line."""
    stop = F.array_min(F.filter(stops, lambda s: s > x + 0.01))
    indent = F.when(((hanging > 0.01) | F.lit(by_indent)) & (left > x + 0.01), left)
    origin = left if by_indent else F.lit(0.0)
    line = origin + (F.floor(F.try_divide(x - origin, grid)).cast("double") + 1.0) * grid
    return F.coalesce(F.least(stop, indent), F.when(grid <= 0.01, x + 36.0).otherwise(line))


def digit_width(size: Column, family: Column) -> Column:
    """Points of a digit in a font: a share of its size by family."""
    name = F.lower(family)
    narrow = name.contains("calibri") | name.contains("carlito")
    serif = name.contains("times") | name.contains("serif") | name.contains("cambria") | name.contains("caladea")
    return F.coalesce(size, F.lit(10.0)) * F.when(narrow, 0.507).when(serif, 0.5).otherwise(0.556)


def column_points(chars: Column, size: Column, family: Column, hidden: Column | None = None) -> Column:
    """Points of a column that is so many characters wide; a hidden one has none."""
    width = chars * digit_width(size, family)
    return width if hidden is None else F.when(hidden, 0.0).otherwise(width)


#: Widths of border styles in points; a style not listed is 0.5.
BORDERS = {"medium": 1.0, "mediumDashed": 1.0, "mediumDashDot": 1.0, "mediumDashDotDot": 1.0, "thick": 1.5, "double": 1.5, "hair": 0.25}


def border_width(style: Column) -> Column:
    """Points of a border; null for no border."""
    out = F.lit(0.5)
    for name, width in BORDERS.items():
        out = F.when(style == name, width).otherwise(out)
    return F.when(~F.coalesce(style, F.lit("")).isin("", "none"), out)


#: Paper sizes in points by code; others are letter paper.
PAPER = {5: (612.0, 1008.0), 3: (792.0, 1224.0), 7: (522.0, 756.0), 8: (841.9, 1190.6), 9: (595.3, 841.9), 11: (419.5, 595.3), 12: (1031.8, 1459.8), 13: (515.9, 728.5), 14: (612.0, 936.0)}


def paper_size(code: Column) -> Column:
    width, height = F.lit(612.0), F.lit(792.0)
    for k, (w, h) in PAPER.items():
        width, height = F.when(code == k, w).otherwise(width), F.when(code == k, h).otherwise(height)
    return F.struct(width.alias("width"), height.alias("height"))


#: The indexed colours of sheets.
PALETTE = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333"
).split()


def indexed_colour(index: Column) -> Column:
    """#rrggbb of a palette index; 64 is black and 65 white, null beyond."""
    table = F.array(*[F.lit(f"#{x.lower()}") for x in [*PALETTE, "000000", "FFFFFF"]])
    return F.get(table, index)


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "good").when(score >= 0.6, "fair").otherwise("weak")
