"""Java regex classes that hold exactly the code points of a Python string property.

The classes come from the running interpreter's tables, so a lowered expression
agrees with the Python function it stands for, whatever Unicode version the JVM has.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

PROPERTIES = ("isalnum", "isalpha", "isdecimal", "isdigit", "isnumeric", "isspace")
#: Where a class is cut into tiers, so that common text is decided by few ranges.
TIERS = (0x80, 0x250, 0x800, 0x3000, 0x10000, 0x110000)


@cache
def ranges(prop: str) -> tuple[tuple[int, int], ...]:
    """Inclusive code point ranges for which ``str.<prop>`` holds."""
    if prop not in PROPERTIES:
        raise KeyError(prop)
    test = getattr(str, prop)
    out: list[tuple[int, int]] = []
    start = None
    for c in range(sys.maxunicode + 2):
        holds = c <= sys.maxunicode and not 0xD800 <= c <= 0xDFFF and test(chr(c))
        if holds and start is None:
            start = c
        elif not holds and start is not None:
            out.append((start, c - 1))
            start = None
    return tuple(out)


def body(spans) -> str:
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


@cache
def char_class(prop: str, negated: bool = False) -> str:
    """One character with (or without) the property, as a plain class."""
    return f"[{'^' if negated else ''}{body(ranges(prop))}]"


def _tier(low: int, high: int) -> str:
    return f"[\\x{{{low:x}}}-\\x{{{high - 1:x}}}]"


def _own(prop: str, low: int, high: int) -> list[tuple[int, int]]:
    return [(max(a, low), min(b, high - 1)) for a, b in ranges(prop) if a < high and b >= low]


@cache
def tiered(prop: str) -> str:
    """One character with the property, tested tier by tier of the code space."""
    parts, low = [], 0
    for high in TIERS:
        if own := _own(prop, low, high):
            parts.append(f"(?={_tier(low, high)})[{body(own)}]")
        low = high
    return f"(?:{'|'.join(parts)})"


@cache
def ascii_others(prop: str) -> str:
    """The ASCII characters without the property, NUL aside."""
    test = getattr(str, prop)
    return "".join(chr(c) for c in range(1, 0x80) if not test(chr(c)))


@cache
def wide_own(prop: str) -> str:
    """Pattern of one character beyond ASCII with the property.

    Matched character by character: the JVM recurses for a repeated alternative,
    and would run out of stack on long runs.
    """
    parts, low = [], 0x80
    for high in TIERS[1:]:
        if own := _own(prop, low, high):
            parts.append(f"(?={_tier(low, high)})[{body(own)}]")
        low = high
    return f"(?:{'|'.join(parts)})"


@cache
def case_table(method: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """``str.lower`` or ``str.upper`` of single characters: from, to, and the pairs whose result is longer."""
    src, dst, longer = [], [], []
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF and (put := getattr(chr(c), method)()) != chr(c):
            if len(put) == 1:
                src.append(chr(c))
                dst.append(put)
            else:
                longer.append((chr(c), put))
    return "".join(src), "".join(dst), tuple(longer)


@cache
def unassigned() -> str:
    """Class of the code points that the interpreter's tables do not know."""
    spans: list[tuple[int, int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1] = (spans[-1][0], c)
            else:
                spans.append((c, c))
    return f"[{body(spans)}]"


def members(chars) -> str:
    """Class of the given characters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"


SPACES = "".join(chr(c) for a, b in ranges("isspace") for c in range(a, b + 1))
SPACE = char_class("isspace")
NOT_SPACE = char_class("isspace", negated=True)
#: ASCII space characters other than the blank.
ASCII_SPACE = f"[{body([(a, min(b, 0x1F)) for a, b in _own('isspace', 0, 0x80)])}]"
