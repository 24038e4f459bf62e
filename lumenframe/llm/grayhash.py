"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are counted in numpy over Arrow batches of whole texts.  Distinct
fingerprints are cut into ``radius + 1`` bit blocks; two within the radius agree
in one of them at least, so they meet in a group of equal blocks.  In a group,
fingerprints stand in the order of their Gray rank, where neighbours differ in
few bits.  Runs of them become leaves, leaves become upper nodes, and every node
keeps the bit pattern that all below it share (a mask and the bits under it).
A join of the index with itself adds up the differences of two nodes under both
masks and leaves out the whole pair when they pass the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import saved
from .text import arrow_words, split_batch

FAN = 16
BROADCAST_ROWS = 1_000_000
TILE = 32_768
PIECE = 1 << 17
CHUNK = 512


def batch_fingerprints(texts: pa.Array, k: int, seed: int = 42) -> np.ndarray:
    """uint64 fingerprint of each whole text: bits set in over half of its k-word shingles."""
    flat, counts = arrow_words(texts)
    n = len(counts)
    if not len(flat):
        return np.zeros(n, np.uint64)
    spaced = pc.binary_join_element_wise(flat, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    buffer = spaced.buffers()[2].to_pybytes()
    first = np.cumsum(counts) - counts
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    m = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    owner = np.repeat(np.arange(n), m)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m) + first[owner]
    last = np.minimum(at + k - 1, (first + counts - 1)[owner])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, len(owner), PIECE):
        part = slice(lo, lo + PIECE)
        h = np.fromiter(
            (digest(buffer[s:e], seed) for s, e in zip(begin[at[part]].tolist(), end[last[part]].tolist(), strict=True)),
            np.uint64, len(owner[part]),
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[part]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones[who[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > m[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: Column, text_col: str, k: int) -> DataFrame:
    """(key, fp): fingerprint of every row as a long; a null text is empty and gets zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, "text"):
                fp = batch_fingerprints(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fp.view(np.int64))], ["key", "fp"])

    slim = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Index over fingerprints of several groups; groups are never joined with each other."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, turn: int):
        """``turn``: bits to rotate left by, so that the group's block leads."""
        turned = (fp << np.uint64(turn)) | (fp >> np.uint64((64 - turn) % 64)) if turn else fp
        order = np.lexsort((gray_rank(turned), group))
        self.order, self.fp = order, fp[order]
        group = group[order]
        self.levels = []
        ands, ors = self.fp, self.fp
        while True:
            new = np.r_[True, group[1:] != group[:-1]]
            place = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            starts = np.flatnonzero(place % FAN == 0)
            ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
            group = group[starts]
            count = np.diff(np.r_[starts, len(place)])
            self.levels.append((starts, count, ~(ands ^ ors), ands))
            if not (group[1:] == group[:-1]).any():
                break

    def pairs(self, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i, j) of places in ``self.fp``, i < j, of one group and within the radius, in pieces."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            starts, count, mask, value = self.levels[level]
            grown = np.cumsum(count[a] * count[b])
            if len(a) > 1 and grown[-1] > most:
                half = max(1, int(np.searchsorted(grown, grown[-1] // 2)))
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            n = count[a] * count[b]
            which = np.repeat(np.arange(len(a)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            width = count[b][which]
            i, j = starts[a][which] + inside // width, starts[b][which] + inside % width
            if level == 0:
                keep = (i < j) & (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= radius)
                if keep.any():
                    yield i[keep], j[keep]
                continue
            _, _, mask, value = self.levels[level - 1]
            keep = (i <= j) & (np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]) <= radius)
            if keep.any():
                stack.append((level - 1, i[keep], j[keep]))


    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (places) that join all that is joined within the radius."""
        root = np.arange(len(self.fp))
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in self.pairs(radius):
            _unite(root, a, b, kept)
        if not kept:
            return root[:0], root[:0]
        return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray, kept: list) -> None:
    """Join places a and b in ``root`` (each place's least known one); keep the links that did."""
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        # one link for each upper root, so that no circle is kept
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        root[high[first]] = low[first]
        kept.append((a[first], b[first]))
        while (root != root[root]).any():
            root[:] = root[root]


def _tables(radius: int, agree: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Choices of ``agree`` of ``radius + agree`` bit blocks, each with the turn that brings its last block to the top.

    Two words that differ in at most ``radius`` bits are equal in all blocks of one choice.
    """
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    cuts = list(zip(edges, edges[1:], strict=False))
    return [((64 - c[-1][1]) % 64, list(c)) for c in combinations(cuts, agree)]


def links(items: DataFrame, radius: int, *, agree: int = 1) -> DataFrame:
    """(a, b): links between the nodes of ``items`` (``node`` and ``fp``, longs, one row a node).

    Of each tile come as many links as join all that it joins, never all pairs.  A
    group of over ``TILE`` fingerprints is cut into chunks, and each two of its
    chunks meet in a tile of their own, so no task holds more than two chunks and
    a batch.
    """
    tables = _tables(radius, agree)

    def bits(lo: int, hi: int) -> Column:
        if hi - lo == 64:
            return F.col("fp")
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))

    def packed(cuts) -> Column:
        value = F.lit(0).cast("long")
        for lo, hi in cuts:
            value = F.shiftleft(value, hi - lo).bitwiseOR(bits(lo, hi))
        return value

    keyed = items.select("node", "fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("b"), packed(cuts).alias("v")) for i, (_, cuts) in enumerate(tables)
    ])).alias("x")).select("node", "fp", "x.b", "x.v")
    sizes = keyed.groupBy("b", "v").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    tiled = keyed.join(sizes, ["b", "v"]).select("node", "fp", "b", "v", F.explode(tiles).alias("t")).select("node", "fp", "b", "v", "t.i", "t.j")
    turns = [turn for turn, _ in tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table):
            cols = [t.column(c).to_numpy() for c in ("b", "v", "i", "j")]
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
            group, b = np.cumsum(new), cols[0]
            fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            for block in np.unique(b):
                own = b == block
                index = GrayIndex(group[own], fp[own], turns[block])
                x, y = index.forest(radius)
                if len(x):
                    at = node[own][index.order]
                    yield pa.RecordBatch.from_arrays([pa.array(at[x]), pa.array(at[y])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * TILE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t.column(c).to_numpy() for c in ("b", "v", "i", "j")]
            other = ~np.all([c == c[-1] for c in cols], axis=0)
            whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if whole:
                yield from solve(t.slice(0, whole))
                t = t.slice(whole)
            held, rows = t.to_batches(), t.num_rows
        if rows:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    key = ["b", "v", "i", "j"]
    return tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 3,
    radius: int = 2,
) -> DataFrame:
    """Each row's id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are linked at ``radius`` or fewer differing bits; the component
    id is the least id reachable over links, the row's own included.

    Nulls and empty texts have fingerprint zero and are linked like any other.
    A null id is ignored in the minimum; if a component has no other, its id is
    null.  Repeated rows come back as often as they came.  Very long texts are
    read whole, in pieces.  An empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, F.col(id_col), text_col, k), "fps")
    distinct = saved(fps.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    found = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def batch_keys(texts: pa.Array) -> np.ndarray:
    """A hash of the word sequence of each whole text."""
    flat, counts = arrow_words(texts)
    keys = np.full(len(counts), xxhash.xxh64_intdigest(b"", 42), np.uint64)
    if not len(flat):
        return keys
    spaced = pc.binary_join_element_wise(flat, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    buffer, ends = memoryview(spaced.buffers()[2]), np.r_[0, np.cumsum(size)]
    cut = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        keys[i] = xxhash.xxh64_intdigest(buffer[ends[cut[i] - counts[i]] : ends[cut[i]] - 1], 42)
    return keys


def shingle_jaccard(a: str, b: str, k: int) -> float:
    """Jaccard similarity of the sets of k-word shingles of two whole texts."""
    sets = []
    for x in (a, b):
        w, _ = arrow_words(pa.array([x]))
        w = w.to_pylist()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def batch_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of the k-word shingles of whole texts, in order, and their number in each text.

    A text of fewer words is one shingle.
    """
    flat, counts = arrow_words(texts)
    coded = flat.dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = np.r_[h[coded.indices.to_numpy()], np.zeros(k, np.uint64)]
    m = np.maximum(counts - k + 1, 1)
    owner = np.repeat(np.arange(len(counts)), m)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(counts) - counts - np.cumsum(m) + m, m)
    short = counts < k
    out = np.zeros(len(owner), np.uint64)
    for j in range(k):
        word = h[at + j]
        if short.any():
            word = np.where(j < counts[owner], word, np.uint64(0))
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, m


def batch_bands(texts: pa.Array, k: int, bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """Of each whole text ``bands`` uint64 keys, each of ``rows`` MinHashes of its k-word shingles."""
    h, m = batch_shingles(texts, k)
    mixers = np.random.default_rng(seed).integers(0, 1 << 64, (bands * rows, 2), np.uint64, endpoint=False)
    owner = np.repeat(np.arange(len(m)), m)
    out = np.zeros((len(m), bands), np.uint64)
    least = np.full((len(m), bands * rows), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), PIECE):
        part, who = h[lo : lo + PIECE], owner[lo : lo + PIECE]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        at = who[starts]
        for p, (flip, factor) in enumerate(mixers):
            least[at, p] = np.minimum(least[at, p], np.minimum.reduceat((part ^ flip) * (factor | np.uint64(1)), starts))
    for band in range(bands):
        key = np.full(len(m), band + 1, np.uint64)
        for r in range(rows):
            key = (key ^ least[:, band * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, band] = key
    return out


def joined(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (places) between similar sets that join all that any similar pair joins; equal labels are joined already."""
    size = np.array([len(x) for x in sets])
    if len(np.unique(label)) < 2:
        return []
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    number = np.bincount(code)
    start = np.cumsum(number) - number
    first = np.cumsum(size) - size
    waits = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not waits[seed]:
            continue
        ready = np.flatnonzero(waits & (label == label[seed])).tolist()
        waits[ready] = False
        while ready and waits.any():
            x = ready.pop()
            mine = code[first[x] : first[x] + size[x]]
            n = number[mine]
            places = np.arange(n.sum()) + np.repeat(start[mine] - np.cumsum(n) + n, n)
            same = np.bincount(posting[places], minlength=len(sets))
            for y in np.flatnonzero(waits & (same >= similarity * (size[x] + size - same))).tolist():
                if waits[y]:
                    out.append((x, y))
                    more = np.flatnonzero(waits & (label == label[y]))
                    waits[more] = False
                    ready += more.tolist()
    return out


def _sent(table: DataFrame) -> DataFrame:
    """The table as the small side of a join: broadcast if it has few enough rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _verified(tiled: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): links between similar texts in each tile (``root``, ``i``, ``j``) of (``node``, ``label``, ``text``)."""
    key = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, label, sets = None, [], [], []

        def solve() -> Iterator[pa.RecordBatch]:
            found = joined(sets, np.array(label), similarity) if len(node) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([node[e[side]] for e in found], pa.int64()) for side in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in split_batch(batch, "text"):
                h, m = batch_shingles(part.column("text"), k)
                ends = np.cumsum(m)
                rows = zip(*[part.column(c).to_pylist() for c in (*key, "node", "label")], (ends - m).tolist(), ends.tolist(), strict=True)
                for *tile, n, v, lo, hi in rows:
                    if tile != now:
                        yield from solve()
                        now, node, label, sets = tile, [], [], []
                    node.append(n)
                    label.append(v)
                    sets.append(np.unique(h[lo:hi]))
        yield from solve()

    return tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def similar(named: DataFrame, pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): links that join all nodes that similar pairs of one candidate component join.

    ``named`` has each node's candidate component (``root``), ``pairs`` the
    candidate links and ``texts`` the nodes' texts.  A component of up to
    ``CHUNK`` texts is one tile.  In a larger one, one link a node is verified
    first.  What that joins needs no further look; if some of the component stays
    apart from its largest part, chunks of the rest meet each other and those of
    the largest part in tiles.
    """
    big = _sent(named.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("root", F.lit(True).alias("big")))
    sized = saved(named.join(big, "root", "left"), "sized")
    large = sized.filter("big").select("node", "root")
    ahead = pairs.groupBy("a").agg(F.min("b").alias("b")).join(large.select(F.col("node").alias("a")), "a", "left_semi")
    both = ahead.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [shingle_jaccard(x, y, k) >= similarity for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    sure = saved(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "sure")
    parts = components(sure).withColumnRenamed("root", "label")
    labelled = saved(large.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    counts = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("root").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    main = saved(main.select("root", F.col("m.label").alias("main"), F.ceil(F.col("m.n") / CHUNK).cast("int").alias("p"), F.ceil((F.col("all") - F.col("m.n")) / CHUNK).cast("int").alias("q")), "main")
    split = labelled.join(_sent(main), "root").withColumn("own", F.col("label") == F.col("main"))
    at = F.when(F.col("own"), F.col("q") + F.pmod(F.xxhash64("node"), "p")).otherwise(F.pmod(F.xxhash64("node"), "q")).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("own"), F.col("q") - 1).otherwise(F.col("p") + F.col("q") - 1))
    split = split.withColumn("at", at).withColumn("with", F.explode(meets))
    split = split.select("root", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "node", "label")
    whole = sized.filter("big is null").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("label"))
    tiled = whole.unionByName(split).join(texts, "node").select("root", "i", "j", "node", "label", "text")
    return sure.union(_verified(tiled, k, similarity))


def representatives(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    similarity: float = 0.8,
    radius: int = 6,
    agree: int = 2,
    bands: int = 32,
    rows: int = 6,
) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id; columns as they are.

    Rows with the same words are copies.  Different texts are near-duplicates if
    their k-word shingles have at least this Jaccard similarity.  The Gray index
    names candidates: texts whose fingerprints of k-word shingles differ in at most
    ``radius`` bits.  At a similarity of 0.8 many lie further apart, so texts that
    agree in all ``rows`` MinHashes of one of ``bands`` bands are candidates as
    well, which at similarity s happens in 1 - (1 - s**rows)**bands of cases: all
    but one in ten thousand at 0.8, whatever the edits.  All pairs of texts that
    candidates of both kinds join, over however many links, are compared (see
    ``similar``).

    Nulls: a null text is an empty one, and all empty texts are copies; null ids
    lose to others.  Of repeated rows one stays, and of rows that share an id the
    one whose text has the least hash.  Very long texts are read whole.  Columns may
    have any names, those of steps in between too.  An empty table stays empty.
    """

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, "text"):
                keys = batch_keys(part.column("text")).view(np.int64)
                found = batch_bands(part.column("text"), k, bands, rows).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), bands).cast(pa.list_(pa.int64()))
                fp = pa.array(batch_fingerprints(part.column("text"), k).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("raw"), pa.array(keys), fp, lists], ["id", "raw", "node", "fp", "bands"])

    # A row is named by its id and a hash of its text; a node is a word sequence.
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("raw"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = saved(slim.mapInArrow(banded, f"id {id_type}, raw long, node long, fp long, bands array<long>"), "bands")
    # Equal texts have equal keys and are one node; null ids lose to others.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw"))
    items = saved(marks.groupBy("node").agg(least.alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "items")
    # One node stands for all of a fingerprint in the Gray index.
    heads = saved(items.groupBy("fp").agg(F.min("node").alias("node"), F.max("node").alias("top")), "heads")
    shared = items.select("node", "fp").join(heads.filter("node != top").select("fp", F.col("node").alias("b")), "fp")
    close = links(heads.select("node", "fp"), radius, agree=agree).union(shared.filter("node != b").select("node", "b"))
    # A band key that several nodes have links them to the least.
    keyed_bands = items.select("node", F.explode("bands").alias("band"))
    buckets = keyed_bands.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b != top")
    banded_pairs = keyed_bands.join(buckets.select("band", "b"), "band").filter("node != b").select(F.col("node").alias("a"), "b")
    pairs = saved(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(banded_pairs).distinct(), "pairs")

    named = saved(components(pairs), "named")

    def same_row(left: DataFrame, right: DataFrame) -> Column:
        return left["id"].eqNullSafe(right["id"]) & (left["raw"] == right["raw"])

    # Texts of the candidates: one copy each.
    ends = saved(named.join(items, "node").select("node", "low.id", "low.raw"), "ends")
    sent = _sent(ends)
    texts = slim.join(sent, same_row(slim, sent)).groupBy("node").agg(F.min("text").alias("text"))
    texts = saved(texts, "texts")

    found = components(similar(named, pairs, texts, k, similarity))
    rooted = items.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winner = rooted.groupBy("root").agg(F.min("low").alias("low")).select("low.id", "low.raw", F.lit(True).alias("won"))
    # all but the winners go, and of a winner's repeated rows all but one
    kinds = marks.groupBy("id", "raw").agg(F.count("*").alias("n"))
    judged = kinds.join(winner, same_row(kinds, winner), "left").select(kinds["id"], kinds["raw"], "n", "won")
    rest = saved(judged.filter("won is null or n > 1"), "losers")
    more = _sent(rest.filter("won"))
    rest = _sent(rest)

    full = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("raw"))
    once = full.join(rest, same_row(full, rest), "left_anti")
    again = full.join(more, same_row(full, more), "left_semi").dropDuplicates(["id", "raw"])
    return once.unionByName(again).select("row.*")
