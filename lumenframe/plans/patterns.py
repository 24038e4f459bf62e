"""Regular expressions that mean the same to Python and to the JVM.

A small common language is accepted as it is; a few patterns outside it have been
proven one by one and have a switch each.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import unicode_sets as U
from .policy import Policy
from .source import NotLowerable

# The patterns and the six profile classes that are qualified.
LINKS = r"https?://\S+|www\.\S+"
COPYRIGHT = r"(?i)(copyright\s*\(?c\)?|©|\(c\)|all rights reserved)[^\n.]*\.?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SENTENCE_END = r"(?<=[.!?])\s+"
PROFILES = {
    "[a-zA-Z]": "[a-zA-Z]",
    "[\u4e00-\u9fff]": "[\\x{4e00}-\\x{9fff}]",
    "[\u3040-\u309f\u30a0-\u30ff]": "[\\x{3040}-\\x{30ff}]",
    "[\uac00-\ud7af]": "[\\x{ac00}-\\x{d7af}]",
    "[\u0600-\u06ff]": "[\\x{600}-\\x{6ff}]",
    "[\u0400-\u04ff]": "[\\x{400}-\\x{4ff}]",
}
OUTSIDE = set("()|{}.^$*?")
PLAIN_FLAGS = int(re.UNICODE)
FOLD_FLAGS = PLAIN_FLAGS | int(re.IGNORECASE)


def links_pattern() -> str:
    return f"(?iu)https?://{U.NOT_SPACE}+|www\\.{U.NOT_SPACE}+"


def copyright_pattern() -> str:
    return f"(?iu)(copyright{U.SPACE}*\\(?c\\)?|©|\\(c\\)|all rights reserved)[^\\n.]*\\.?"


def replacement(text: str) -> str:
    """Replacement text that stands for itself in Java."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def common(pattern: str) -> bool:
    """In the common language: ASCII, no operators but ``+`` outside a class, one-level classes, escaped punctuation."""
    i, inside, start, seen = 0, False, 0, False
    while i < len(pattern):
        c = pattern[i]
        if ord(c) > 126 or ord(c) < 32:
            return False
        if c == "\\":
            if i + 1 >= len(pattern) or pattern[i + 1] not in string.punctuation:
                return False
            i, seen = i + 2, True
            continue
        if inside:
            if c == "[" or pattern[i : i + 2] in ("&&", "--", "||", "~~"):
                return False
            if c == "]" and i > start:
                inside, seen = False, True
            i += 1
            continue
        if c == "[":
            inside = True
            start = i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1
            if pattern[start : start + 1] == "]":
                return False
            i = start
            continue
        if c in OUTSIDE or c in "]#" or c == "+" and (not seen or pattern[i - 1] == "+" and pattern[i - 2 : i - 1] != "\\"):
            return False
        seen = True
        i += 1
    return not inside and bool(pattern)


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also under conditions, where Catalyst would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_runs(c: Column) -> Column:
    """Runs of space characters as one blank: by table each as a blank, then runs of that, where a literal search finds any."""
    flat = F.translate(c, U.SPACES, " " * len(U.SPACES))
    return let(flat, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def mails(c: Column, lit: str) -> Column:
    """Few texts hold the sign without which the pattern can't match; ASCII classes and a bounded repeat mean the same to the JVM."""
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, lit)).otherwise(c)


def class_count(c: Column, cls: str) -> Column:
    """Characters of a class: what a text loses when its runs of them are cut out."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{cls}+", ""))


def lower_sub(pattern: re.Pattern, put: str, policy: Policy) -> tuple[str, Callable[[Column], Column]]:
    """(label, builder) for ``pattern.sub(put, text)``; the replacement is literal."""
    if "\\" in put:
        raise NotLowerable("replacement_escape")
    if not isinstance(pattern.pattern, str):
        raise NotLowerable("bytes_pattern")
    src, flags = pattern.pattern, int(pattern.flags)
    lit = replacement(put)
    if src == r"\s+" and flags == PLAIN_FLAGS:
        if put == " ":
            return "whitespace", blank_runs
        return "whitespace", lambda c: F.regexp_replace(c, U.SPACE + "+", lit)
    if src == LINKS and flags == FOLD_FLAGS:
        if "links" not in policy.qualified:
            raise NotLowerable("switched_off", "links")
        return "links", lambda c: F.regexp_replace(c, links_pattern(), lit)
    if src == COPYRIGHT and flags == FOLD_FLAGS:
        if "copyright" not in policy.qualified:
            raise NotLowerable("switched_off", "copyright")
        return "copyright", lambda c: F.regexp_replace(c, copyright_pattern(), lit)
    if src == EMAIL and flags == PLAIN_FLAGS:
        if "email" not in policy.qualified:
            raise NotLowerable("switched_off", "email")
        return "email", lambda c: mails(c, lit)
    if flags != PLAIN_FLAGS:
        raise NotLowerable("pattern_flags")
    if not common(src):
        raise NotLowerable("pattern_language")
    return "regex", lambda c: F.regexp_replace(c, src, lit)


def single_class(pattern: re.Pattern, policy: Policy) -> str:
    """A qualified one-character class, in the JVM's spelling."""
    if "language_id" not in policy.qualified:
        raise NotLowerable("switched_off", "language_id")
    spelled = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), pattern.pattern)
    if int(pattern.flags) != PLAIN_FLAGS or spelled not in PROFILES:
        raise NotLowerable("pattern_language")
    return PROFILES[spelled]


def splitter(pattern: re.Pattern, policy: Policy) -> tuple[str, Callable[[Column], Column]]:
    """(label, builder) for ``pattern.split(text)`` of a qualified pattern."""
    if pattern.pattern == SENTENCE_END and int(pattern.flags) == PLAIN_FLAGS:
        if "sentences" not in policy.qualified:
            raise NotLowerable("switched_off", "sentences")

        def at_ends(c: Column) -> Column:
            # a mark put in the place of the spaces, so that no position has to look back; unless the mark is taken
            mark = "\uffff"
            narrow, wide = (F.regexp_replace(c, f"([.!?]){s}+", f"$1{mark}") for s in (f"[ {U.ASCII_SPACE[1:]}", U.SPACE))
            marked = F.split(F.when(ascii_only(c), narrow).otherwise(wide), mark)
            return F.when(F.contains(c, F.lit(mark)), F.split(c, f"(?<=[.!?]){U.SPACE}+")).otherwise(marked)

        return "sentences", at_ends
    raise NotLowerable("pattern_language")
