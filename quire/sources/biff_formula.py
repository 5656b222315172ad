"""Parsed formulas of BIFF rules back to text: a stack machine over their tokens."""

from __future__ import annotations

import struct

from quire.functions.numfmt import general_text

#: Operators by token, and functions by id with their number of arguments (None: any).
OPERATORS = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>"}
FUNCTIONS = {
    0: ("COUNT", None), 1: ("IF", None), 4: ("SUM", None), 5: ("AVERAGE", None), 6: ("MIN", None), 7: ("MAX", None), 24: ("ABS", 1), 25: ("INT", 1), 27: ("ROUND", 2),
    31: ("MID", 3), 32: ("LEN", 1), 33: ("VALUE", 1), 34: ("TRUE", 0), 35: ("FALSE", 0), 36: ("AND", None), 37: ("OR", None), 38: ("NOT", 1), 39: ("MOD", 2),
    112: ("LOWER", 1), 113: ("UPPER", 1), 115: ("LEFT", None), 116: ("RIGHT", None), 117: ("EXACT", 2), 118: ("TRIM", 1), 127: ("ISTEXT", 1), 128: ("ISNUMBER", 1),
    129: ("ISBLANK", 1), 131: ("N", 1), 169: ("COUNTA", None), 347: ("COUNTBLANK", 1),
}
#: Rule operators by number.
COMPARISONS = ("", "between", "notBetween", "equal", "notEqual", "greaterThan", "lessThan", "greaterThanOrEqual", "lessThanOrEqual")


def _letters(col: int) -> str:
    out, n = "", col + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _named(row: int, col: int, loose_row: bool, loose_col: bool) -> str:
    return f"{'' if loose_col else '$'}{_letters(col)}{'' if loose_row else '$'}{row + 1}"


def _fixed(row: int, col: int) -> str:
    return _named(row, col & 0x3FFF, bool(col & 0x8000), bool(col & 0x4000))


def _shared(row: int, col: int, origin: tuple[int, int]) -> str:
    """A reference by offset from the rule's first cell (1-based), as signed 16 and 8 bits."""
    loose_row, loose_col = bool(col & 0x8000), bool(col & 0x4000)
    if loose_row:
        row = max(0, origin[0] - 1 + (row - 0x10000 if row & 0x8000 else row))
    step = col & 0xFF
    column = max(0, origin[1] - 1 + (step - 0x100 if step & 0x80 else step)) if loose_col else col & 0x3FFF
    return _named(row, column, loose_row, loose_col)


def decompile(tokens: bytes, origin: tuple[int, int]) -> str | None:
    """The formula's text; None for tokens that rules do not need."""
    try:
        return _decompile(tokens, origin)
    except (struct.error, IndexError, KeyError):
        return None


def _decompile(tokens: bytes, origin: tuple[int, int]) -> str | None:
    stack: list[str] = []
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from(f"<{form}", tokens, at)
        at += struct.calcsize(f"<{form}")
        return got

    def call(name: str, n: int) -> None:
        if len(stack) < n:
            raise IndexError
        args = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        stack.append(f"{name}({','.join(args)})")

    while at < len(tokens):
        (token,) = take("B")
        base = (token & 0x1F) | 0x20 if token >= 0x20 else token
        if base in OPERATORS:
            right = stack.pop()
            stack[-1] += OPERATORS[base] + right
        elif base in (0x13, 0x14, 0x15):
            stack[-1] = {0x13: "-{}", 0x14: "{}/100", 0x15: "({})"}[base].format(stack[-1])
        elif base == 0x16:
            stack.append("")
        elif base == 0x17:
            n, wide = take("BB")
            size = n * 2 if wide & 1 else n
            text = tokens[at : at + size].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            at += size
            stack.append('"' + text.replace('"', '""') + '"')
        elif base == 0x19:
            flags, value = take("BH")
            at += (value + 1) * 2 if flags & 4 else 0
            if flags & 0x10:
                call("SUM", 1)
        elif base == 0x1C:
            take("B")
            stack.append("NA()")
        elif base == 0x1D:
            stack.append("TRUE" if take("B")[0] else "FALSE")
        elif base == 0x1E:
            stack.append(str(take("H")[0]))
        elif base == 0x1F:
            stack.append(general_text(take("d")[0]))
        elif base == 0x21:
            name, n = FUNCTIONS[take("H")[0]]
            if n is None:
                return None
            call(name, n)
        elif base == 0x22:
            n, code = take("BH")
            call(FUNCTIONS[code & 0x7FFF][0], n & 0x7F)
        elif base == 0x24:
            stack.append(_fixed(*take("HH")))
        elif base == 0x25:
            r1, r2, c1, c2 = take("HHHH")
            stack.append(f"{_fixed(r1, c1)}:{_fixed(r2, c2)}")
        elif base == 0x2C:
            stack.append(_shared(*take("HH"), origin))
        elif base == 0x2D:
            r1, r2, c1, c2 = take("HHHH")
            stack.append(f"{_shared(r1, c1, origin)}:{_shared(r2, c2, origin)}")
        elif base != 0x12:
            return None
    return stack[0] if len(stack) == 1 else None
