"""Language identification as a mixture: which languages a document holds, and in what proportions.

Byte n-grams of words give each word a log-likelihood under every language.  A
document is a mixture: expectation-maximisation estimates its proportions, and
its language set is the one with the best likelihood less a penalty for each
language beyond the first.  All of a batch is worked out at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import arrow_words, split_batch

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 16
ADD = 0.5


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram of every byte position of each word between blanks, and the number of grams a word has."""
    spaced = pc.binary_join_element_wise(
        pa.scalar("", pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    )
    size = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    b = np.frombuffer(spaced.buffers()[2], np.uint8)[offset[0] : offset[-1]].astype(np.uint32)
    word = np.repeat(np.arange(len(size)), size)
    out, owner = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(0x01000193)
        inside = word[: len(h)] == word[n - 1 :]
        out.append(((h ^ (h >> np.uint32(15)))[inside] % np.uint32(SLOTS)).astype(np.int64) + (n - 1) * SLOTS)
        owner.append(word[: len(h)][inside])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Mixture:
    langs: list[str]
    table: np.ndarray  # (orders * SLOTS, languages) log-likelihoods
    penalty: float
    rounds: int

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """(words, languages): mean log-likelihood by order, summed as the length of the word asks."""
        g, owner = grams(words)
        out = np.zeros((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, weights=self.table[g, j], minlength=len(words))
        return out / len(ORDERS)

    def infer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents, languages) after selection, and each document's number of words."""
        flat, counts = arrow_words(texts)
        n, k = len(counts), len(self.langs)
        props = np.full((n, k), 1 / max(k, 1))
        full = np.flatnonzero(counts)
        if not len(full) or not k:
            return props, counts
        coded = flat.dictionary_encode()
        ll = self.word_scores(coded.dictionary)
        ll -= ll.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(ll, -50)).astype(np.float32)[coded.indices.to_numpy()]
        size = counts[full]
        starts = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(full)), size)

        def em(p, rounds):
            for _ in range(rounds):
                r = like * p[doc]
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
                p = (np.add.reduceat(r, starts, axis=0) / size[:, None]).astype(np.float32)
            return p

        def fit(p):
            return np.add.reduceat(np.log(np.maximum((like * p[doc]).sum(axis=1, dtype=np.float32), 1e-30)), starts)

        p = em(np.full((len(full), k), 1 / k, np.float32), self.rounds)
        order = np.argsort(-p, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        best, chosen = None, p
        # nested sets of the strongest languages; a further language must pay for itself
        for m in range(1, k + 1):
            q = np.where(place < m, p + np.float32(1e-6), 0).astype(np.float32)
            q /= q.sum(axis=1, keepdims=True)
            value = fit(q) - self.penalty * (m - 1) * np.log(size + 1)
            if best is None:
                best, chosen = value, q
            else:
                better = value > best
                best = np.where(better, value, best)
                chosen = np.where(better[:, None], q, chosen)
        props[full] = em(chosen, 2)
        return props, counts


def has_letter(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\p{L}"), F.lit(False))


def learnable(key: Column) -> Column:
    """True for rows that may be learnt from: crc32 of the id as text is not 2 modulo 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample: int, penalty: float, rounds: int) -> Mixture:
    """Count n-grams of about ``sample`` documents a language, drawn by a hash of the text.

    The bound is on documents; their texts are counted whole, on the executors,
    and only one table of counts of fixed size a task and language comes back.
    """
    rows = docs.filter(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("langmix"), id_col).alias("h")
    )
    # the hash alone decides who is drawn, so the texts are looked at in one pass only
    sizes = {r["lang"]: r["count"] for r in docs.filter(learnable(F.col(id_col)) & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Mixture([], np.zeros((len(ORDERS) * SLOTS, 0)), penalty, rounds)
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(rate)
    drawn = rows.filter(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < rate).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in split_batch(batch, "text"):
                names = part.column("lang")
                for name in names.unique().to_pylist():
                    flat, _ = arrow_words(part.column("text").filter(pc.equal(names, name)))
                    coded = flat.dictionary_encode()
                    g, owner = grams(coded.dictionary)
                    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    got = np.bincount(g, weights=n[owner], minlength=len(ORDERS) * SLOTS)
                    seen[name] = seen.get(name, 0) + got
        for name, counts in seen.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(counts[slot].astype(np.int64))], ["lang", "slot", "n"])

    found = drawn.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(ORDERS) * SLOTS, len(langs)))
    where = {name: i for i, name in enumerate(langs)}
    column = np.array([where[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("slot").to_numpy(), column] = found.column("n").to_numpy()
    table = np.empty_like(counts)
    for i in range(len(ORDERS)):
        s = slice(i * SLOTS, (i + 1) * SLOTS)
        used = max(1, int((counts[s].sum(axis=1) > 0).sum()))
        table[s] = np.log((counts[s] + ADD) / (counts[s].sum(axis=0) + ADD * used))
    return Mixture(langs, table.astype(np.float32), penalty, rounds)


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 4_000,
    penalty: float = 2.0,
    rounds: int = 8,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``langs`` (the selected set, strongest first) and ``proportions``.

    Nulls: a null text, or one without a letter, is ``und`` with score 0 and no
    languages.  A null language teaches nothing.  If nothing can be learnt, every
    row is ``und``.  Very long texts are read whole.  Ties go to the language that
    is first by name.  Repeated rows get equal results.  Clashing names among the
    added columns are replaced.  Only the text enters a prediction.
    """
    docs = docs.drop("lang_pred", "score", "langs", "proportions")
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample, penalty=penalty, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tagged = docs.withColumn("__lf_letter", has_letter(F.col(text_col)))
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in split_batch(batch, text_col, 4 << 20):
                props, counts = m.infer(part.column(text_col))
                good = part.column("__lf_letter").to_numpy(zero_copy_only=False) & (counts > 0) & bool(m.langs)
                order = np.argsort(-props, axis=1, kind="stable")
                top, score, sets, shares = [], [], [], []
                for i in range(len(counts)):
                    if not good[i]:
                        top.append("und")
                        score.append(0.0)
                        sets.append([])
                        shares.append([])
                        continue
                    keep = [j for j in order[i] if props[i, j] > 0] or [order[i][0]]
                    top.append(m.langs[keep[0]])
                    score.append(float(min(1.0, props[i, keep[0]])))
                    sets.append([m.langs[j] for j in keep])
                    shares.append([float(props[i, j]) for j in keep])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f) for f in fields), pa.array(top, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    [*fields, "lang_pred", "score", "langs", "proportions"],
                )

    added = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType())),
    ]
    return tagged.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
