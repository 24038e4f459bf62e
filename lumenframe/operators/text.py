"""Text cleaning: thirteen operators as Python functions, each with the Column that it lowers to.

The functions say what the operators mean and serve as fallback and as oracle in
tests; the Columns come from capturing them, but for those marked as batch
functions.  Parameters follow the usual web-text recipe.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import LowerableUdf
from ..plans import patterns as P
from .relational import drop_duplicates, settle, where, with_columns

TAG_RE = re.compile(r"<[^>]+>")
LINK_RE = re.compile(P.LINKS, re.IGNORECASE)
COPYRIGHT_RE = re.compile(P.COPYRIGHT)
SPACE_RE = re.compile(r"\s+")
EMAIL_RE = re.compile(P.EMAIL)
SENTENCE_RE = re.compile(P.SENTENCE_END)
# The six punctuation marks, and the characters that whitespace normalisation turns into a blank each.
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}
BLANKS = frozenset("\t             ​  　﻿")
PROFILE = dict(zip(("en", "zh", "ja", "ko", "ar", "ru"), map(re.compile, P.PROFILES), strict=True))


def clean_html(text: str) -> str:
    return TAG_RE.sub(" ", text)


def clean_links(text: str) -> str:
    return LINK_RE.sub("", text)


def clean_copyright(text: str) -> str:
    return COPYRIGHT_RE.sub("", text)


def clean_email(text: str) -> str:
    return EMAIL_RE.sub("", text)


def fix_unicode(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def normalize_punctuation(text: str) -> str:
    return text.translate(str.maketrans(PUNCTUATION))


def normalize_whitespace(text: str) -> str:
    return SPACE_RE.sub(" ", text).strip()


def replace_blanks(text: str) -> str:
    return "".join(c if c not in BLANKS else " " for c in text.strip())


def text_length(text: str, low: int = 5, high: int = 100_000) -> bool:
    n = len(text)
    return low <= n <= high


def alphanumeric(text: str, least: float = 0.2) -> bool:
    if not text:
        return False
    return sum(1 for c in text if c.isalnum()) / len(text) >= least


def language_score(text: str, lang: str = "en", least: float = 0.1) -> bool:
    """Whether ``lang`` has the profile with the most characters (the first such), and enough of them."""
    found = {name: len(chars.findall(text)) for name, chars in PROFILE.items()}
    best = max(found, key=found.get)
    return text.strip() != "" and best == lang and found[best] / len(text) >= least


def split_chunks(text: str) -> str:
    return "\n\n".join(p.strip() for p in SENTENCE_RE.split(text) if p.strip())


def char_perplexity(text: str) -> float:
    """Stand-in scorer: perplexity of the text under its own character frequencies."""
    if not text:
        return 1.0
    n = len(text)
    return 2.0 ** -sum(c / n * math.log2(c / n) for c in Counter(text).values())


HTML, LINKS, COPYRIGHT, EMAIL, UNICODE, PUNCT, SPACES, JOINED, CHUNKS = (
    LowerableUdf(f, "string", fallback="arrow")
    for f in (clean_html, clean_links, clean_copyright, clean_email, fix_unicode, normalize_punctuation, normalize_whitespace, replace_blanks, split_chunks)
)
LENGTH, ALNUM, LANGUAGE = (LowerableUdf(f, "boolean", fallback="arrow") for f in (text_length, alphanumeric, language_score))
PERPLEXITY = LowerableUdf(char_perplexity, "double", fallback="arrow")

MAPPERS = {
    "clean_html_mapper": HTML, "clean_links_mapper": LINKS, "clean_email_mapper": EMAIL, "clean_copyright_mapper": COPYRIGHT,
    "fix_unicode_mapper": UNICODE, "punctuation_normalization_mapper": PUNCT, "whitespace_normalization_mapper": SPACES,
    "blank_normalization_mapper": JOINED, "text_chunk_mapper": CHUNKS,
}


def nfc_column(col: Column) -> Column:
    """``fix_unicode`` for batches; ASCII batches pass untouched."""
    import pyarrow.compute as pc

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        if pc.all(pc.fill_null(pc.string_is_ascii(texts), True)).as_py():
            return texts
        return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return nfc(col)


def perplexity_filter(df: DataFrame, column: str, most: float, make_scorer=lambda: char_perplexity) -> DataFrame:
    """Rows whose score is at most ``most``; the scorer is made once a task, as for a loaded model."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make_scorer()
        for batch in batches:
            yield pa.array([None if t is None else float(fn(t)) for t in batch.to_pylist()], pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.filter(F.arrow_udf(score, "double")(F.col(column)) <= most)


def map_text(df: DataFrame, mapper: str, column: str = "text") -> DataFrame:
    return with_columns(df, {column: MAPPERS[mapper](column)})


def document_deduplicator(df: DataFrame, column: str = "text") -> DataFrame:
    return drop_duplicates(df, column)


def clean_pipeline(df: DataFrame, column: str = "text", *, low: int = 5, high: int = 100_000, least_alnum: float = 0.2, lang: str = "en", least_score: float = 0.1) -> DataFrame:
    """The native stages in their usual order: seven mappers fused in one projection, then three filters, then dedup."""
    from functools import partial

    out = df
    for mapper in (
        "clean_html_mapper", "clean_links_mapper", "clean_email_mapper", "clean_copyright_mapper",
        "punctuation_normalization_mapper", "whitespace_normalization_mapper",
    ):
        out = map_text(out, mapper, column)
    out = settle(out, column)
    for fn in (partial(text_length, low=low, high=high), partial(alphanumeric, least=least_alnum), partial(language_score, lang=lang, least=least_score)):
        out = where(out, LowerableUdf(fn, "boolean", name=fn.func.__name__)(column))
    return document_deduplicator(out, column)
