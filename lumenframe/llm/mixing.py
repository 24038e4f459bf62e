"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same sources form one *membership pattern*.  A
pattern with S words can give S words at each of ``max_repeat`` passes; the
c-th pass costs more than the one before, so repetition is convex.  The flow
runs from patterns to source quotas at the least cost, by successive shortest
paths in each connected part of the network.  Within a pattern, full passes take
every document; the rest of the flow takes documents in the order of a seeded
hash, up to the point where the words are used up, and one more that fits the
gap.  That point is found by descending a radix tree of hash sums, so no task
ever sorts or holds a source.  Flow and cut points have one row a pattern; they
go to the documents, which stay where they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved
from .text import WORD_CLASS

BITS, LEVELS = 10, 6
MAX_PATTERNS = 100_000
BROADCAST_ROWS = 200_000


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def quotas(sizes: Mapping, weights: Mapping, total: float, max_repeat: float) -> dict:
    """Share ``total`` by weight, no source above ``max_repeat`` times its size.

    What a source can't take is shared again by weight among those still below
    their limit.  If all are at the limit, the targets sum to less than total.
    """
    target: dict = {}
    left, open_ = float(total), sorted(sizes, key=lambda s: (s is None, s))
    while open_:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if w == 0 or max_repeat * sizes[s] * w <= left * weights[s]]
        if not full:
            target |= {s: left * weights[s] / w for s in open_}
            break
        for s in full:
            target[s] = float(max_repeat * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
        left = max(left, 0.0)
    return target


def _parts(patterns: Mapping[tuple, int]) -> list[list[tuple]]:
    """Patterns by connected part: those of two parts have no source in common, not even over others."""
    root: dict = {}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for p in patterns:
        for s in p:
            root.setdefault(s, s)
            root[find(s)] = find(p[0])
    parts: dict = {}
    for p in patterns:
        if p:
            parts.setdefault(find(p[0]), []).append(p)
    return list(parts.values())


def route(patterns: Mapping[tuple, int], target: Mapping, max_repeat: int) -> dict:
    """Min-cost flow: words from each pattern to each of its sources, {(pattern, source): words}.

    Arcs of a pattern: ``max_repeat`` arcs of capacity S with costs 0, 1, 3, 6, ...
    (convex).  Connected parts of the network are solved one by one.
    """
    flow: dict = {}
    for part in _parts({p: n for p, n in patterns.items() if n > 0}):
        flow |= _route_part({p: patterns[p] for p in part}, target, max_repeat)
    return flow


def _route_part(rest: Mapping[tuple, int], target: Mapping, max_repeat: int) -> dict:
    """Successive shortest augmenting paths; each saturates an arc, so their number is bounded by the arcs."""
    flow: dict = {}
    members: dict = {}
    for p in rest:
        for s in p:
            members.setdefault(s, []).append(p)
    cost = [c * (c + 1) / 2 for c in range(max_repeat)]
    used = dict.fromkeys(rest, 0.0)
    need = {s: target.get(s, 0.0) for p in rest for s in p}
    eps = 1e-6

    def step(p):
        """The cheapest pass of a pattern that still has room."""
        k = int((used[p] + eps) // rest[p])
        return (cost[k], (k + 1) * rest[p] - used[p]) if k < max_repeat else None

    while True:
        # From unfinished sources back to patterns: a pattern's room ends a path;
        # flow that it sends to another source may be turned over and replaced there.
        best: dict = {}
        came: dict = {}
        heap = [(0.0, i, "s", s) for i, s in enumerate(x for x in need if need[x] > eps)]
        for _, _, _, s in heap:
            best["s", s] = 0.0
        tick, end = len(heap), None
        while heap:
            d, _, kind, x = heapq.heappop(heap)
            if d > best[kind, x] + 1e-12:
                continue
            if kind == "end":
                end = x
                break
            if kind == "s":
                nexts = [("p", p, d) for p in members[x]]
            else:
                nexts = [("s", s, d) for s in x if flow.get((x, s), 0.0) > eps]
                if room := step(x):
                    nexts.append(("end", x, d + room[0]))
            for k2, y, d2 in nexts:
                if d2 < best.get((k2, y), float("inf")) - 1e-12:
                    best[k2, y] = d2
                    came[k2, y] = (kind, x)
                    tick += 1
                    heapq.heappush(heap, (d2, tick, k2, y))
        if end is None:
            return flow
        path = [("p", end)]
        while path[-1] in came:
            path.append(came[path[-1]])
        amount = min(step(end)[1], need[path[-1][1]])
        for a, b in zip(path[1::2], path[2::2], strict=False):  # source a was fed by pattern b
            amount = min(amount, flow[b[1], a[1]])
        for i in range(0, len(path) - 1, 2):
            p, s = path[i][1], path[i + 1][1]
            flow[p, s] = flow.get((p, s), 0.0) + amount
            if i + 2 < len(path):
                flow[path[i + 2][1], s] -= amount
        used[end] += amount
        need[path[-1][1]] -= amount


def _null_last(s):
    return (s is None, s or "")


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows of the recipe as a table; broadcast in joins while it is known to be small."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sources_col: str | None = None,
    weights: Mapping | None = None,
    share: float = 1.0,
    max_repeat: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per document with the words that the mix takes of it.

    Columns: all of ``docs``, then ``size`` (words), ``source_size`` and
    ``target`` (of its source; of the first one where it has several), ``taken``
    (words, repeats counted) and ``passes`` (how often the document is taken).

    ``sources_col``: an array of the sources a document belongs to, in place of
    ``source_col``.  ``weights``: by source; left out, sources by code point
    (null last) weigh 1, 2, 3, repeating.  ``share``: part of all words to take.
    The sources and up to ``MAX_PATTERNS`` patterns are the recipe, which the
    driver holds.  If there are more patterns of several sources, documents of
    the smaller ones count for one of their sources each, drawn by a hash: they
    are mixed like all others, but the flow is then the cheapest one of the
    narrowed memberships.

    Nulls: a null text has size 0 and is never taken; a null source is a source
    of its own.  The seed hash covers the id and the text, so ties are equal rows
    only; of these as many are taken once more as the words left allow.  Very
    long texts are only counted.  An empty table gives an empty result.  Names
    that clash with the added columns are replaced.
    """
    added = ["size", "source_size", "target", "taken", "passes"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    none = F.array(F.lit(None).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.col(sources_col).cast("array<string>"))) if sources_col else F.array(F.col(source_col).cast("string"))
    tick = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keyed = docs.select(
        F.struct("*").alias("row"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(pattern, none).alias("__lf_p"),
        F.shiftrightunsigned(tick, 64 - BITS * LEVELS).alias("__lf_h"),
    )
    if sources_col:
        keyed = _narrowed(keyed)
    keyed = keyed.withColumn("__lf_pk", F.to_json(F.struct("__lf_p")))
    slim = saved(keyed.select("__lf_p", "__lf_pk", "__lf_h", "size"), "mix")
    # one row a pattern: the recipe
    totals = slim.groupBy("__lf_pk").agg(F.sum("size").alias("n"), F.first("__lf_p").alias("p")).collect()
    slim = slim.select("__lf_pk", "__lf_h", "size").filter("size > 0")
    patterns = {tuple(r["p"]): int(r["n"]) for r in sorted(totals, key=lambda r: r["__lf_pk"])}
    size: dict = {}
    for p, n in patterns.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    names = sorted(size, key=_null_last)
    weigh = dict(weights) if weights is not None else {s: 1 + i % 3 for i, s in enumerate(names)}
    target = quotas(size, {s: float(weigh.get(s, 0)) for s in names}, share * sum(patterns.values()), max_repeat)
    flow = route(patterns, target, max_repeat)
    got: dict = dict.fromkeys(patterns, 0.0)
    for (p, _), words in flow.items():
        got[p] += words
    full, rest = {}, {}
    for r in totals:
        key, p = r["__lf_pk"], tuple(r["p"])
        n = patterns[p]
        full[key] = min(int(got[p] / n + 1e-9), max_repeat) if n else 0
        left = got[p] - full[key] * n
        if full[key] < max_repeat and left > 1e-6:
            rest[key] = left
    cut, once = _cut_points(spark, slim, rest)
    plan = []
    for r in totals:
        key, p = r["__lf_pk"], tuple(r["p"])
        tick_once, copies, have = once.get(key, (None, 0, 0))
        plan.append((key, int(size[p[0]]) if p else 0, float(target[p[0]]) if p else 0.0, full[key], cut.get(key, 0), tick_once, copies, copies < have))
    recipe = _table(spark, plan, "__lf_pk string, source_size long, target double, __lf_full int, __lf_cut long, __lf_once long, __lf_copies long, __lf_split boolean")
    out = keyed.join(recipe, "__lf_pk")
    at_once = F.coalesce(F.col("__lf_h") == F.col("__lf_once"), F.lit(False))
    more = (F.col("__lf_h") < F.col("__lf_cut")) | at_once
    if any(row[-1] for row in plan):
        split = at_once & F.col("__lf_split")
        ranked = _ranked(out.filter(split), ["__lf_pk", "__lf_h"]).withColumn("__lf_more", F.col("__lf_rank") <= F.col("__lf_copies")).drop("__lf_rank")
        out = out.filter(~split).withColumn("__lf_more", more).unionByName(ranked)
    else:
        out = out.withColumn("__lf_more", more)
    passes = F.col("__lf_full") + F.when(F.col("__lf_more"), 1).otherwise(0)
    out = out.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("int"))
    out = out.withColumn("taken", (F.col("size") * F.col("passes")).cast("long"))
    return out.select("row.*", "size", "source_size", "target", "taken", "passes")


def _narrowed(keyed: DataFrame) -> DataFrame:
    """Patterns as they are while they fit the recipe; beyond that the smaller ones shrink to one source a document."""
    counts = keyed.filter(F.size("__lf_p") > 1).groupBy("__lf_p").agg(F.sum("size").alias("__lf_n"))
    largest = counts.orderBy(F.desc("__lf_n"), "__lf_p").limit(MAX_PATTERNS + 1).select("__lf_p").collect()
    if len(largest) <= MAX_PATTERNS:
        return keyed
    whole = _table(keyed.sparkSession, [(r["__lf_p"], True) for r in largest[:-1]], "__lf_p array<string>, __lf_whole boolean")
    one = F.array(F.get("__lf_p", F.pmod(F.col("__lf_h"), F.size("__lf_p")).cast("int")))
    kept = F.col("__lf_whole").isNotNull() | (F.size("__lf_p") < 2)
    return keyed.join(whole, "__lf_p", "left").withColumn("__lf_p", F.when(kept, F.col("__lf_p")).otherwise(one)).drop("__lf_whole")


def _ranked(df: DataFrame, key: list[str]) -> DataFrame:
    """``__lf_rank`` from 1 among the rows of a key, counted partition by partition, however many rows a key has."""
    marked = saved(df.withColumn("__lf_at", F.monotonically_increasing_id()), "copies").withColumn("__lf_part", F.shiftright("__lf_at", 33))
    counts = marked.groupBy(*key, "__lf_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("__lf_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select(*key, "__lf_part", before.alias("__lf_before"))
    own = F.row_number().over(Window.partitionBy(*key, "__lf_part").orderBy("__lf_at"))
    return marked.withColumn("__lf_own", own).join(ahead, [*key, "__lf_part"]).withColumn(
        "__lf_rank", F.col("__lf_own") + F.col("__lf_before")
    ).drop("__lf_at", "__lf_part", "__lf_own", "__lf_before")


def _cut_points(spark: SparkSession, slim: DataFrame, rest: Mapping[str, float]) -> tuple[dict, dict]:
    """By pattern, where the words in ``rest`` are used up.

    First the hash below which all documents are taken once more, then (hash,
    copies to take, copies there are) of the one that fills the gap.  Each level
    sums the words of the at most 2**BITS branches below the branch where the rest
    runs out, before the shuffle; it ends with the branches that hold one document.
    """
    cut: dict = {}
    once: dict = {}
    gaps = []
    now = [(key, words, 0) for key, words in rest.items()]
    for level in range(1, LEVELS + 1):
        if not now:
            break
        shift = BITS * (LEVELS - level)
        at = _table(spark, now, "__lf_pk string, rest double, prefix long")
        inside = slim.join(at, "__lf_pk").filter(F.shiftright("__lf_h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("__lf_pk", "rest", F.shiftright("__lf_h", shift).alias("branch")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        walked = F.aggregate(
            F.array_sort(F.collect_list(F.struct("branch", "n", "m"))),
            F.struct(F.lit(0).cast("long").alias("branch"), F.col("rest").alias("left"), F.lit(0.0).alias("n"), F.lit(0).cast("long").alias("m")),
            lambda acc, x: F.when(acc["left"] - acc["n"] > 1e-6, F.struct(
                x["branch"].alias("branch"), (acc["left"] - acc["n"]).alias("left"), x["n"].cast("double").alias("n"), x["m"].alias("m")
            )).otherwise(acc),
        )
        found = sums.groupBy("__lf_pk", "rest").agg(walked.alias("w")).select("__lf_pk", "w.*").collect()
        now = []
        for key, branch, left, words, m in found:
            cut[key] = branch << shift
            if m > 1 and level < LEVELS:
                now.append((key, left, branch))
            elif m > 1:  # equal rows
                once[key] = (branch, min(m, round(left * m / words)), m)
            else:
                gaps.append((key, cut[key], left))
    # The one document of the branch is left out; the words still missing go to the one
    # document past the cut whose size comes nearest to them.
    if gaps:
        at = _table(spark, gaps, "__lf_pk string, cut long, gap double")
        past = slim.join(at, "__lf_pk").filter(F.col("__lf_h") >= F.col("cut"))
        best = past.groupBy("__lf_pk", "gap").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("__lf_h").alias("h"))).alias("b"))
        fill = [(r["__lf_pk"], r["h"]) for r in best.filter("b.off < gap").select("__lf_pk", "b.h").collect()]
        copies = slim.join(_table(spark, fill, "__lf_pk string, __lf_h long"), ["__lf_pk", "__lf_h"]).groupBy("__lf_pk", "__lf_h").count()
        once |= {key: (h, 1, n) for key, h, n in copies.collect()}
    return cut, once
