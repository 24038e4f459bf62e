"""Site-relative line frequency: drop lines that stand on too large a part of a site's pages.

Built-in expressions only.  Lines travel as 96-bit keys.  While the lines to drop
are few they are broadcast by host; beyond that texts are shuffled once, to meet
the lists of their own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved
from .text import ascii_lower, row_key

BLANKS = " \t\r"
#: Bounds within which the lines to drop are broadcast: of one host, and of all.
HOST_LINES, BROADCAST_LINES = 256, 500_000


def url_host(url: Column) -> Column:
    """Host of a url, lower-cased A to Z; empty where there is no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def _line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float, min_pages: int) -> DataFrame:
    """Lines to drop: host, line key, pages that hold the line, pages of the host."""
    base = pages.select(host.alias("__lf_host"), F.split(text, "\n").alias("__lf_lines")).filter("__lf_host is not null")
    totals = base.groupBy("__lf_host").agg(F.count("*").alias("host_pages"))
    full = F.filter("__lf_lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    keys = base.select("__lf_host", F.explode(F.array_distinct(F.transform(full, _line_key))).alias("__lf_line"))
    counts = keys.groupBy("__lf_host", "__lf_line").agg(F.count("*").alias("line_pages")).filter(F.col("line_pages") >= min_pages)
    return counts.join(totals, "__lf_host").filter(F.col("line_pages") > max_ratio * F.col("host_pages"))


def drop_boilerplate(
    pages: DataFrame,
    *,
    host: Column | str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 10,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text, and ``n_lines``, ``n_dropped``.

    A line (blanks at its ends do not count) is boilerplate on its host if it
    stands on at least ``min_pages`` pages of the host and on more than
    ``max_ratio`` of them; a page counts once however often it repeats the line.
    Blank lines are neither counted nor dropped.

    Nulls: rows without a host are kept as they are, for they have no site; a
    null text stays null with 0 lines.  An empty text has one (blank) line.
    Repeated rows are pages of their own and count as such.  A page whose lines
    all go keeps an empty text.  Line order is kept.  Very long texts are read
    whole.  Clashing ``n_lines`` and ``n_dropped`` are replaced.
    """
    host = F.col(host) if isinstance(host, str) else host
    pages = pages.drop("n_lines", "n_dropped")
    text = F.col(text_col)
    bad = saved(boilerplate(pages, host, text, max_ratio, min_pages).select("__lf_host", "__lf_line"), "boilerplate")
    by_host = bad.groupBy("__lf_host").agg(F.collect_set("__lf_line").alias("__lf_drop"))
    size = bad.groupBy("__lf_host").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    row = pages.select(F.struct("*").alias("row"), text.alias("__lf_text"), host.alias("__lf_host"))
    text = F.col("__lf_text")
    if (size[0] or 0) <= HOST_LINES and (size[1] or 0) <= BROADCAST_LINES:
        # few lines on any host: they go to the pages
        out = row.join(F.broadcast(by_host), "__lf_host", "left")
    else:
        key = row_key(F.col("__lf_host"), text)
        # Equal texts on one host lose the same lines, so lists are kept once for each such text.
        full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        held = row.filter("__lf_host is not null").select("__lf_host", *key, F.explode(F.array_distinct(F.transform(full, _line_key))).alias("__lf_line"))
        lists = held.join(bad, ["__lf_host", "__lf_line"]).groupBy("__lf_k1", "__lf_k2").agg(F.collect_set("__lf_line").alias("__lf_drop"))
        out = row.select("*", *key).join(lists, ["__lf_k1", "__lf_k2"], "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__lf_drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains("__lf_drop", _line_key(x)))
    )
    out = out.withColumn("__lf_kept", kept)
    cleaned = F.when(F.col("__lf_drop").isNull(), text).otherwise(F.array_join("__lf_kept", "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    n_kept = F.coalesce(F.size("__lf_kept"), F.lit(0))
    columns = [cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in pages.columns]
    return out.select(
        *columns,
        F.when(text.isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(text.isNull(), 0).otherwise(n - n_kept).cast("long").alias("n_dropped"),
    )
