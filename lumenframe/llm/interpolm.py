"""Deleted interpolation of n-gram estimates (bigram, unigram, uniform).

    P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

where b is the bucket of the context's frequency c(v).  The weights of a bucket
are learnt by expectation-maximisation on held-out counts: one fold of the
training documents is deleted from the counts and predicted from the rest.
Scores then use the counts of all training documents.

Counting is a join on packed arrays.  Texts become blocks of about a million
tokens.  A block asks for each of its distinct words and bigrams once; requests
go to ranges of the hash space, are summed there, and the totals go back to the
block.  So a very frequent word is one entry a block, the volume follows the
input, and no table of n-grams is ever sent to the driver or broadcast.  Blocks
and totals meet twice, once for the held-out histogram and once for the scores:
that costs processor time, but no joined copy of the tokens is ever stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved
from .text import arrow_words, split_batch

BLOCK_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 21
FREQUENCY_BUCKETS = 40
STEPS = 16  # bins of the held-out histogram for each doubling of a probability
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
BASE_ADD = 0.1


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, in the least width that holds them, compressed."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = x.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], decompressed_size=n * width, codec="zstd", asbytes=True), f"<u{width}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, byte planes apart, since the high planes hardly change."""
    raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_keys(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56-bit keys of pairs of word hashes, in the high bits."""
    with np.errstate(over="ignore"):
        x = v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x7F4A7C159E3779B9))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFF00)


class Block:
    """Tokens of whole documents as places in a sorted list of word hashes."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, counts: np.ndarray, folds: np.ndarray):
        self.words, self.tokens, self.counts, self.folds = words, tokens, counts, folds
        start = np.cumsum(counts) - counts
        end = int(np.searchsorted(words, END))
        self.before = np.r_[0, tokens[:-1]] if len(tokens) else tokens
        self.before[start] = end  # a text starts where the one before ended
        self.fold = np.repeat(folds, counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct bigrams, sorted, and the place of each token's bigram among them."""
        code, back = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)
        keys, place = np.unique(pair_keys(self.words[code // len(self.words)], self.words[code % len(self.words)]), return_inverse=True)
        return keys, place[back]


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds).cast("int").alias("fold"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal made, held, size
            flat = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            coded = flat.dictionary_encode()
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            words, place = np.unique(np.r_[h, END], return_inverse=True)
            tokens = np.full(len(flat) + len(counts), place[-1], np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            tokens[np.arange(len(flat)) + doc] = place[:-1][coded.indices.to_numpy()]
            keys = pa.concat_arrays([h[2] for h in held])
            row = [pa.array([home << 24 | made]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            row += [pa.array([pack(x)], pa.binary()) for x in (np.concatenate([h[3] for h in held]), counts + 1, tokens)]
            row += [pa.array([pack_keys(words)], pa.binary()), pa.array([len(tokens)])]
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays(row, ["block", "keys", "folds", "counts", "tokens", "words", "n"])

        for batch in batches:
            for part in split_batch(batch, "text"):
                flat, counts = arrow_words(part.column("text"))
                held.append((flat, counts, part.column("key"), part.column("fold").to_numpy()))
                size += len(flat) + len(counts)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return slim.mapInArrow(run, f"block long, keys array<{id_type}>, folds binary, counts binary, tokens binary, words binary, n long")


def _load(row: dict) -> Block:
    return Block(unpack_keys(row["words"]), unpack(row["tokens"]), unpack(row["counts"]), unpack(row["folds"]))


def _counted(place: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    return np.bincount(place[chosen], minlength=n)


def requests(made: DataFrame, bits: int, held_fold: int) -> DataFrame:
    """Of each block, kind (1 words, 2 bigrams) and hash range: keys and their counts in the block.

    ``t``: in training documents; ``h``: in those of the held-out fold among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "folds", "counts", "tokens", "words"]).to_pylist():
                b = _load(row)
                train, held = b.fold != 0, b.fold == held_fold
                pair, at = b.pairs()
                for kind, keys, place in ((1, b.words, b.tokens), (2, pair, at)):
                    t, h = _counted(place, len(keys), train), _counted(place, len(keys), held)
                    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    full = np.flatnonzero(cuts[1:] > cuts[:-1])
                    out = [[], [], []]
                    for r in full:
                        s = slice(cuts[r], cuts[r + 1])
                        for o, v in zip(out, (pack_keys(keys[s]), pack(t[s]), pack(h[s])), strict=True):
                            o.append(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["block"], np.int64)), *(pa.array(o, pa.binary()) for o in out)],
                        ["kind", "place", "block", "keys", "t", "h"],
                    )

    return made.mapInArrow(run, "kind int, place int, block long, keys binary, t binary, h binary")


def replies(asked: DataFrame) -> DataFrame:
    """Totals for each request, in its order; ``distinct`` words of the range with training counts, once a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows):
            keys = [unpack_keys(r["keys"]) for r in rows]
            everything = np.concatenate(keys)
            uniq, back = np.unique(everything, return_inverse=True)
            sums = [np.bincount(back, weights=np.concatenate([unpack(r[c]) for r in rows]), minlength=len(uniq)).astype(np.int64) for c in ("t", "h")]
            ends = np.cumsum([len(k) for k in keys])
            kind = rows[0]["kind"]
            seen = [[int((s > 0).sum()) if kind == 1 else 0] + [0] * (len(rows) - 1) for s in (sums[0], sums[0] - sums[1])]
            own = [back[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(rows), pa.int32()), pa.array([rows[0]["place"]] * len(rows), pa.int32()), pa.array([r["block"] for r in rows], pa.int64()),
                    *(pa.array([pack(s[o]) for o in own], pa.binary()) for s in sums), *(pa.array(s, pa.int64()) for s in seen),
                ],
                ["kind", "place", "block", "t", "h", "vt", "va"],
            )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["kind"], row["place"]) != (held[0]["kind"], held[0]["place"]):
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return asked.repartition("kind", "place").sortWithinPartitions("kind", "place", "block").mapInArrow(
        run, "kind int, place int, block long, t binary, h binary, vt long, va long"
    )


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each doubling of the count."""
    return np.where(c > 0, np.minimum(np.frexp(np.maximum(c, 1))[1], FREQUENCY_BUCKETS - 1), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """Bin of a probability, 0 for zero."""
    return np.where(p > 0, 1 + np.minimum(np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), 999), 0).astype(np.int64)


def _unbin(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** (-(b - 1) / STEPS), 0.0)


def learn_weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """EM over held-out counts: (buckets, 3) weights of bigram, unigram and uniform estimates.

    ``cells``: (bucket, bigram bin, unigram bin) codes with ``n`` tokens each.  A
    bucket without held-out tokens takes the weights of the nearest one that has
    some; an unseen context has no bigram estimate, so its weight there is 0.
    """
    bucket, p2, p1 = cells // 1_000_000, _unbin(cells // 1000 % 1000), _unbin(cells % 1000)
    out = np.zeros((FREQUENCY_BUCKETS, 3))
    known = np.unique(bucket)
    for b in known:
        own = bucket == b
        p = np.column_stack([p2[own], p1[own], np.full(own.sum(), uniform)])
        c = n[own].astype(float)
        w = np.array([0.0 if b == 0 else 0.4, 0.5, 0.1])
        w /= w.sum()
        for _ in range(rounds):
            r = p * w
            r *= (c / r.sum(axis=1))[:, None]
            w = r.sum(axis=0) / c.sum()
            w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        out[b] = w
    for b in range(FREQUENCY_BUCKETS):
        if not out[b].any():
            near = known[np.argmin(np.abs(known - b))] if len(known) else None
            out[b] = out[near] if near is not None else [0.3, 0.6, 0.1]
            if b == 0:
                out[b] = out[b] * [0, 1, 1] / max(out[b][1:].sum(), 1e-9)
    return out


def _meet(made: DataFrame, answered: DataFrame, run, schema: str) -> DataFrame:
    """``run(block row, Block, place of each token's bigram, totals of words, of bigrams)`` for each block.

    Totals are a pair of arrays: over all training documents, and over the held-out fold.
    """

    def cogroup(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.sort_by([("kind", "ascending"), ("place", "ascending")]).to_pylist()
        totals = [tuple(np.concatenate([unpack(r[c]) for r in rows if r["kind"] == k]) for c in ("t", "h")) for k in (1, 2)]
        row = left.to_pylist()[0]
        b = _load(row)
        return run(left, b, b.pairs()[1], *totals)

    return made.drop("n").groupBy("block").cogroup(answered.select("kind", "place", "block", "t", "h").groupBy("block")).applyInArrow(cogroup, schema)


def histogram(made: DataFrame, answered: DataFrame, held_fold: int, n_a: int) -> DataFrame:
    """(cell, n): tokens of the held-out fold by context bucket and by the bins of their two estimates.

    The fold is deleted from the counts that make the estimates.
    """

    def run(_, b: Block, at: np.ndarray, words: tuple, pairs: tuple) -> pa.Table:
        test = np.flatnonzero(b.fold == held_fold)
        one, two = words[0] - words[1], pairs[0] - pairs[1]
        ctx = one[b.before[test]]
        code = frequency_bucket(ctx) * 1_000_000 + _bin(two[at[test]] / np.maximum(ctx, 1)) * 1000 + _bin(one[b.tokens[test]] / max(n_a, 1))
        cells, n = np.unique(code, return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    return _meet(made, answered, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 9) -> DataFrame:
    """Score of every row under the interpolated model, learnt from rows outside fold 0.

    Columns: id, ``held_out`` (fold 0), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-0.1 unigrams) and ``score``, both log10
    probabilities of the whole text with its end.

    Words and bigrams are told apart by hashes of 64 and 56 bits.  EM sees the
    held-out estimates rounded to sixteenths of an octave; scores use exact counts.

    Nulls: a null text is empty, its only token is the end; a null id has the
    fold of the empty string.  Repeated rows are scored, and counted, each, so
    equal texts of one fold have equal scores.  Very long texts are taken whole,
    one that is longer than a block is a block.  Other columns are not looked at,
    whatever their names.  An empty table gives an empty result; without training
    rows every estimate but the uniform one is zero.
    """
    made = saved(blocks(docs, id_col, text_col, folds), "blocks")
    total = made.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(total / RANGE_TOKENS, 1)))) + 1)
    answered = saved(replies(requests(made, bits, held_fold)), "replies")
    # The end of text is a token of every block, so its range is asked for by all; N is a sum over blocks.
    v_a, v_t = (x or 0 for x in answered.agg(F.sum("va"), F.sum("vt")).first())

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, f = unpack(row["counts"]), unpack(row["folds"])
                yield pa.RecordBatch.from_arrays([pa.array([int(c[(f != 0) & (f != held_fold)].sum())]), pa.array([int(c[f != 0].sum())])], ["a", "t"])

    n_a, n_t = (int(x or 0) for x in made.select("counts", "folds").mapInArrow(sizes, "a long, t long").agg(F.sum("a"), F.sum("t")).first())
    # bounded by the number of bins, whatever the input
    counted = saved(histogram(made, answered, held_fold, n_a), "histogram")
    found = sorted(counted.collect())
    weights = learn_weights(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), 1 / (v_a + 1))

    def score(left: pa.Table, b: Block, at: np.ndarray, words: tuple, pairs: tuple) -> pa.Table:
        ctx, own = words[0][b.before], words[0][b.tokens]
        w = weights[frequency_bucket(ctx)]
        p = w[:, 0] * (pairs[0][at] / np.maximum(ctx, 1)) + w[:, 1] * (own / max(n_t, 1)) + w[:, 2] / (v_t + 1)
        base = np.log10((own + BASE_ADD) / (n_t + BASE_ADD * (v_t + 1)))
        start = np.cumsum(b.counts) - b.counts
        return pa.Table.from_arrays(
            [left.column("keys").combine_chunks().flatten(), pa.array(b.folds == 0), pa.array(b.counts), pa.array(np.add.reduceat((own > 0).astype(np.int64), start)),
             pa.array(np.full(len(start), n_t)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(np.log10(p), start))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _meet(made, answered, score, schema).withColumnRenamed("id", id_col)
