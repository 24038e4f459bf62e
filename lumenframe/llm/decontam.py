"""Benchmark decontamination with SimHash windows of the size of each item.

Built-in expressions only.  For every benchmark item, windows of as many words
slide over every document.  Windows that can't hold enough of the item's
five-word shingles are passed over before they are fingerprinted, by bounds that
lose nothing (see ``_starts``).  The others get a 64-bit SimHash; windows and
items that agree in at least one of ``radius + 1`` bit blocks meet, so that every
pair within the radius does; those within it are verified by the weighted
Jaccard similarity of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .text import ascii_lower, let, row_key, words

K = 5
BROADCAST_ROWS = 1_000_000
DOC = ["__lf_k1", "__lf_k2"]


def shingles(w: Column, k: int = K) -> Column:
    """64-bit hashes of the k-word shingles of a word array; fewer words: of the whole sequence."""
    def hashes(a):
        n = F.size(a)
        whole = F.when(n > 0, F.array(F.xxhash64(a))).otherwise(F.array().cast("array<bigint>"))
        def at(i):
            return F.xxhash64(*[F.get(a, i + j) for j in range(k)])
        return F.when(n < k, whole).otherwise(F.transform(F.sequence(F.lit(0), n - k), at))
    return let(w, hashes)


def simhash(h: Column) -> Column:
    """SimHash of an array of at most 2**15 hashes: a bit is set if set in over half of them.

    Each of sixteen longs holds four counters of 16 bits, so one addition counts
    four bits of a hash.
    """
    # bits q, q+16, q+32 and q+48 of a hash, one in every 16-bit lane
    parts = [(q, 1 | 1 << 16 | 1 << 32 | 1 << 48) for q in range(16)]
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{q}") for q, _ in parts])
    def add(acc, x):
        return F.struct(*[
            (acc[f"c{q}"] + F.shiftrightunsigned(x, q).bitwiseAND(F.lit(m).cast("long"))).alias(f"c{q}") for q, m in parts
        ])
    def finish(acc):
        n = F.size(h)
        bits = F.lit(0).cast("long")
        for q, _ in parts:
            for lane in range(4):
                count = F.shiftrightunsigned(acc[f"c{q}"], 16 * lane).bitwiseAND(F.lit(0xFFFF).cast("long"))
                bits = bits.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), q + 16 * lane)).otherwise(F.lit(0).cast("long")))
        return bits
    return F.aggregate(h, zero, add, finish)


def _edges(radius: int) -> list[tuple[int, int]]:
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _bits(fp: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))


def blocks(fp: Column, radius: int) -> Column:
    """(block number, bits) of radius + 1 blocks that cover all 64 bits."""
    return F.array(*[F.struct(F.lit(i).alias("b"), _bits(fp, lo, hi).alias("v")) for i, (lo, hi) in enumerate(_edges(radius))])


def first_equal_block(differ: Column, radius: int) -> Column:
    """Number of the first block without a differing bit, null if there is none."""
    return F.coalesce(*[F.when(_bits(differ, lo, hi) == 0, i) for i, (lo, hi) in enumerate(_edges(radius))])


def weighted_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short arrays."""
    def distinct(x):
        return F.size(F.array_distinct(x)) == F.size(x)
    counted = F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when(distinct(a) | distinct(b), F.size(F.array_intersect(a, b))).otherwise(counted)


def _sent(table: DataFrame) -> DataFrame:
    """The table as the small side of a join: broadcast if it has few enough rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _held(n: Column, k: int) -> Column:
    """Shingles of n words."""
    return F.greatest(n - k + 1, F.lit(1))


def _starts(base: DataFrame, items: DataFrame, similarity: float, k: int) -> DataFrame:
    """All windows that can reach the similarity: row keys, words of the item, and an array of (o, item).

    Multisets of m and m' shingles with similarity s share at least s(m+m')/(1+s)
    of them, and s*m in any case.  So a document with the item holds one of any
    m - s*m + 1 of its shingles: the rarest ones name the pairs of document and
    item, and no pair is named by a shingle that very many documents hold alone.
    Of a pair, the shared shingles of the whole document must reach the bound,
    and a window is wanted only if it has that many places with a shingle of the
    item.
    """
    index = items.select("__lf_item", "__lf_n", F.explode("__lf_s").alias("__lf_h")).groupBy("__lf_item", "__lf_n", "__lf_h").agg(F.count("*").alias("__lf_c"))
    index = saved(index, "item-shingles")
    lengths = [r[0] for r in items.filter(F.col("__lf_n") < k).select("__lf_n").distinct().collect()]

    def all_hashes(a):
        kind = "array<struct<p:int,h:bigint,w:int>>"
        def hashed(p, h):
            return F.struct(p.alias("p"), h.alias("h"), F.size(a).alias("w"))
        found = F.when(F.size(a) >= k, F.transform(shingles(a, k), lambda h, i: hashed(i, h)))
        found = F.coalesce(found, F.array().cast(kind))
        for n in lengths:  # items shorter than a shingle: their windows are whole sequences
            short = F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: hashed(i, F.xxhash64(F.slice(a, i + 1, n)))))
            found = F.concat(found, F.coalesce(short, F.array().cast(kind)))
        return found

    seen = base.select(*DOC, F.explode(let(words(ascii_lower(F.col("__lf_text"))), all_hashes)).alias("__lf_x")).select(
        *DOC, F.col("__lf_x.w").alias("__lf_words"), F.col("__lf_x.h").alias("__lf_h"), F.col("__lf_x.p").alias("__lf_p")
    )
    # one row for a document and a shingle, however often it comes and however many copies the document has
    met = seen.join(_sent(index.select("__lf_h").distinct()), "__lf_h", "left_semi").groupBy(*DOC, "__lf_words", "__lf_h").agg(F.collect_set("__lf_p").alias("__lf_ps"))
    met = saved(met, "met")

    common = met.groupBy("__lf_h").agg(F.count("*").alias("__lf_f"))
    order = Window.partitionBy("__lf_item").orderBy(F.coalesce("__lf_f", F.lit(0)), "__lf_h")
    before = F.coalesce(F.sum("__lf_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = _held(F.col("__lf_n"), k)
    rarest = index.join(common, "__lf_h", "left").withColumn("__lf_b", before).filter(F.col("__lf_b") <= held - F.ceil(F.lit(similarity) * held - 1e-9))
    named = met.join(_sent(rarest.select("__lf_h", "__lf_item", "__lf_n")), "__lf_h").select(*DOC, "__lf_words", "__lf_item", "__lf_n").distinct()
    both = named.join(_sent(index), ["__lf_item", "__lf_n"]).join(met.select(*DOC, "__lf_h", "__lf_ps"), [*DOC, "__lf_h"])
    window = _held(F.least("__lf_n", "__lf_words"), k)
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (held + window) - 1e-9).cast("int")
    pairs = both.groupBy(*DOC, "__lf_words", "__lf_item", "__lf_n").agg(
        F.sum(F.least(F.size("__lf_ps"), F.col("__lf_c"))).alias("__lf_c"), F.array_sort(F.flatten(F.collect_list("__lf_ps"))).alias("__lf_at")
    ).withColumn("__lf_need", need).filter("__lf_c >= __lf_need")

    def starts(at):
        # places i to i + need - 1 lie in the windows that start from lo(i) to hi(i); both ends only rise with i
        need, last = F.col("__lf_need"), F.greatest(F.col("__lf_words") - F.col("__lf_n"), F.lit(0))
        def hi(i):
            return F.least(F.get(at, i), last)
        def run(i):
            lo = F.greatest(F.get(at, i + need - 1) - window + 1, F.lit(0), F.when(i > 0, hi(i - 1) + 1))
            return F.when(lo <= hi(i), F.sequence(lo, hi(i))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), run))

    wanted = pairs.withColumn("__lf_o", let(F.col("__lf_at"), starts)).select(*DOC, "__lf_n", F.transform("__lf_o", lambda o: F.struct(o.alias("o"), F.col("__lf_item").alias("item"))).alias("__lf_at"))
    return saved(wanted.groupBy(*DOC, "__lf_n").agg(F.flatten(F.collect_list("__lf_at")).alias("__lf_at")), "windows")


def _found(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, similarity: float, radius: int, k: int) -> DataFrame:
    """Windows at the similarity: row keys, id, item, first word, distance and similarity."""
    text = F.col(text_col)
    items = (
        benchmark.select(F.col(item_col).alias("__lf_item"), words(ascii_lower(F.col("text"))).alias("__lf_w"))
        .select("__lf_item", F.size("__lf_w").alias("__lf_n"), shingles(F.col("__lf_w"), k).alias("__lf_s"))
        .filter("__lf_n > 0")
    )
    # items are told apart by id and words, so that one id may have several texts
    items = saved(items.withColumn("__lf_item", F.struct(F.col("__lf_item").alias("id"), F.xxhash64("__lf_s").alias("x"))).dropDuplicates(["__lf_item"]), "items")
    base = docs.select(*row_key(F.col(id_col), text), F.col(id_col).alias("__lf_id"), text.alias("__lf_text"))
    wanted = _starts(base, items, similarity, k)
    # the texts that hold wanted windows, once each
    texts = base.join(_sent(wanted), DOC).groupBy(*DOC, "__lf_n").agg(*[F.first(c).alias(c) for c in ("__lf_id", "__lf_text", "__lf_at")])

    def cut(a):
        def of(h):
            n = F.col("__lf_n")
            m = _held(n, k)
            short = F.when(n < k, F.transform("__lf_at", lambda x: F.array(F.xxhash64(F.slice(a, x["o"] + 1, n)))))
            longer = F.transform("__lf_at", lambda x: F.slice(h, x["o"] + 1, m))
            return F.arrays_zip(F.col("__lf_at").alias("at"), F.coalesce(short, longer).alias("s"))
        return let(shingles(a, k), of)

    windows = (
        texts.select(*DOC, "__lf_id", F.explode(let(words(ascii_lower(F.col("__lf_text"))), cut)).alias("__lf_x"))
        .select(*DOC, "__lf_id", F.col("__lf_x.at.item").alias("__lf_item"), F.col("__lf_x.at.o").alias("__lf_o"), F.col("__lf_x.s").alias("__lf_ws"))
        .withColumn("__lf_fp", simhash(F.col("__lf_ws")))
    )
    keyed = windows.withColumn("__lf_b", F.explode(blocks(F.col("__lf_fp"), radius)))
    indexed = items.withColumn("__lf_ifp", simhash(F.col("__lf_s"))).withColumn("__lf_b", F.explode(blocks(F.col("__lf_ifp"), radius)))
    differ = F.col("__lf_fp").bitwiseXOR(F.col("__lf_ifp"))
    near = (
        keyed.join(_sent(indexed), ["__lf_item", "__lf_b"])
        .withColumn("distance", F.bit_count(differ))
        # a pair meets in every block in which it agrees, and counts in the first of them
        .filter((F.col("distance") <= radius) & (first_equal_block(differ, radius) == F.col("__lf_b.b")))
    )
    sim = near.withColumn("__lf_i", weighted_overlap(F.col("__lf_s"), F.col("__lf_ws"))).withColumn(
        "similarity", F.col("__lf_i") / (F.size("__lf_s") + F.size("__lf_ws") - F.col("__lf_i"))
    )
    return sim.filter(F.col("similarity") >= similarity - 1e-12).select(*DOC, "__lf_id", F.col("__lf_item.id").alias("__lf_item"), "__lf_o", "distance", "similarity")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    similarity: float = 0.8,
    radius: int = 20,
    k: int = K,
) -> DataFrame:
    """Benchmark passages found: id, item, first word of the best window, windows, distance, similarity.

    One row per document (each id whose text holds the passage; equal rows once)
    and item.  Words are folded for A to Z; windows have as many words as the item
    and start at every word; a text shorter than the item is one smaller window.
    Items of fewer than ``k`` words are one shingle.  Equal items are found under
    each of their ids.

    Nulls: a null or empty text, or an item without words, has no window and no
    row; a null id or item id is a name like any other.  Very long texts are
    taken whole, windows of one text in one task.  Of equally similar windows the
    first is named, with its distance.  Other columns are not looked at, whatever
    their names.  Empty tables: no rows.
    """
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, similarity=similarity, radius=radius, k=k)
    best = F.max(F.struct(F.col("similarity"), (-F.col("__lf_o")).alias("o"), F.col("distance")))
    return (
        found.groupBy(F.col("__lf_id").alias(id_col), F.col("__lf_item").alias(item_col))
        .agg(best.alias("b"), F.countDistinct("__lf_o").alias("windows"))
        .select(id_col, item_col, (-F.col("b.o")).alias("first_word"), "windows", F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))
    )


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    similarity: float = 0.8,
    radius: int = 20,
    k: int = K,
) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no benchmark passage; columns as they are.

    Rows are told apart by id and text, so a clean row is kept even if it shares
    an id with a contaminated one.  All else as in ``leaks``: null and empty texts
    stay, equal rows stay or go together.
    """
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, similarity=similarity, radius=radius, k=k)
    bad = saved(found.select(*DOC).distinct(), "leaking")
    marked = docs.select(F.struct("*").alias("row"), *row_key(F.col(id_col), F.col(text_col)))
    return marked.join(_sent(bad), DOC, "left_anti").select("row.*")
