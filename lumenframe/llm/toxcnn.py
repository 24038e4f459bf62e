"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of three rows of one hashed table: two rows under
independent hashes of the word and one under its first four letters.  Filters of
one, two and three words slide over the text, each is max-pooled over the whole
text, and a logistic layer scores the pooled values.  The driver starts with
Adagrad on a bounded sample; from there executors go on over all labelled
documents in blocks, and what the blocks changed is averaged.  The model (a few
MB, its size fixed by parameters) is broadcast and executors score Arrow batches
of whole texts.  Labels, language, source and id are never inputs of a score.

Thresholds are calibrated by language on all labelled documents held back from
training, a third.
"""

from __future__ import annotations

import copy
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import dropped, saved
from .text import arrow_words, split_batch

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
RATE = 0.15
BLOCK = 4_096
UNIT = 1 << 32
KNOWN_ROWS = 1_000_000


def word_rows(words: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Three table rows for each word; row 0 of the table is for padding and stays zero."""
    out = np.empty((len(words), 3), np.int64)
    for i, w in enumerate(words.to_pylist()):
        b = w.encode()
        out[i] = zlib.crc32(b), zlib.crc32(b, 0x5BD1E995), zlib.crc32(w[:4].encode(), 0x1B873593)
    return 1 + out % (buckets - 1)


def bare(words: pa.Array) -> pa.Array:
    """Words without ASCII punctuation at their ends; one that has nothing else stays."""
    cut = pc.ascii_trim(words, string.punctuation)
    return pc.if_else(pc.equal(pc.binary_length(cut), 0), words, cut)


def text_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) table rows of all whole texts, in order, and the number of words of each text."""
    flat, counts = arrow_words(texts)
    if not len(flat):
        return np.zeros((0, 3), np.int32), counts
    coded = bare(flat).dictionary_encode()
    return word_rows(coded.dictionary).astype(np.int32)[coded.indices.to_numpy()], counts


@dataclass
class Squares:
    """Adagrad's sums of squared gradients."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 1e-2


@dataclass
class Cnn:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict = field(default_factory=dict)
    default_threshold: float = 0.5
    squares: Squares | None = None  # only while it learns

    def scores(self, texts: pa.Array) -> np.ndarray:
        flat, counts = arrow_words(texts)
        if not len(counts):
            return np.zeros(0)
        lead = np.maximum(counts, 1)  # an empty text is one padding word
        coded = bare(flat).dictionary_encode()
        vectors = np.zeros((len(coded.dictionary) + 1, self.table.shape[1]), np.float32)
        if len(coded.dictionary):
            vectors[1:] = self.table[word_rows(coded.dictionary, len(self.table))].sum(axis=1)
        pad = max(WIDTHS) - 1
        starts = np.cumsum(lead + pad) - lead - pad
        ids = np.zeros(int((lead + pad).sum()) + pad, np.int64)
        if len(flat):
            place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            ids[place] = coded.indices.to_numpy().astype(np.int64) + 1
        edges = np.ravel(np.column_stack([starts, starts + lead]))
        pooled = []
        total = len(ids) - pad
        for w, b in zip(self.filters, self.bias, strict=True):
            conv = np.zeros((total, w.shape[2]), np.float32)
            for k in range(len(w)):
                conv += (vectors @ w[k])[ids[k : k + total]]
            pooled.append(np.maximum(np.maximum.reduceat(conv, edges, axis=0)[::2] + b, 0))
        z = np.concatenate(pooled, axis=1).astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_weight(share: float) -> float:
    """Weight of a toxic document where this share is toxic."""
    return min(0.5 / max(share, 1e-3), 5.0)


def train(docs: list[np.ndarray], labels: np.ndarray, *, epochs: int | None = None, rate: float = RATE, seed: int = 3, buckets: int = BUCKETS) -> Cnn:
    """Fit by Adagrad, one document at a time; ``docs`` holds (words, 3) table rows.

    About 20,000 steps, between 6 and 30 epochs, unless ``epochs`` says otherwise.
    """
    epochs = epochs or int(np.clip(20_000 // max(len(docs), 1), 6, 30))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (buckets, DIM)).astype(np.float32)
    table[0] = 0
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS))
    squares = Squares(np.full(buckets, 1e-2, np.float32), [np.full_like(w, 1e-2) for w in filters], [np.full_like(b, 1e-2) for b in bias], np.full_like(out, 1e-2))
    model = Cnn(table, filters, bias, out, 0.0, squares=squares)
    weight = np.where(labels > 0, class_weight(labels.mean() if len(labels) else 0.5), 1.0)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            step(model, docs[i], labels[i], weight[i], rate)
    return model


def step(model: Cnn, rows: np.ndarray, label: float, weight: float, rate: float = RATE) -> None:
    """One step of Adagrad on one document's (words, 3) table rows; nothing where the score is right already."""
    table, filters, bias, out, squares = model.table, model.filters, model.bias, model.out, model.squares
    rows = rows if len(rows) else np.zeros((1, 3), np.int64)
    x = table[rows].sum(axis=1)
    n = len(x)
    padded = np.vstack([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
    at, raw = [], []
    for w, b in zip(filters, bias, strict=True):
        conv = sum(padded[k : k + n] @ w[k] for k in range(len(w)))
        best = conv.argmax(axis=0)
        at.append(best)
        raw.append(conv[best, np.arange(FILTERS)] + b)
    values = np.maximum(np.concatenate(raw), 0)
    p = 1 / (1 + np.exp(-np.clip(values @ out + model.out_bias, -30, 30)))
    d = (p - label) * weight
    if abs(d) < 0.02:
        return
    d_values = d * out * (values > 0)
    d_out = d * values
    squares.out += d_out**2
    out -= rate * d_out / np.sqrt(squares.out)
    squares.out_bias += d * d
    model.out_bias -= float(rate * d / np.sqrt(squares.out_bias))
    for j, w in enumerate(filters):
        part = d_values[j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
        live = np.flatnonzero(part)
        if not len(live):
            continue
        for k in range(len(w)):
            spot = at[j][live] + k
            d_w = np.zeros_like(w[k])
            d_w[:, live] = padded[spot].T * part[live]
            inside = spot < n
            d_x = (w[k][:, live] * part[live]).T[inside]
            hit = rows[spot[inside]]
            squares.filters[j][k] += d_w**2
            w[k] -= rate * d_w / np.sqrt(squares.filters[j][k])
            for c in range(3):
                np.add.at(squares.table, hit[:, c], (d_x**2).mean(axis=1))
                np.add.at(table, hit[:, c], -rate * d_x / np.sqrt(squares.table[hit[:, c]])[:, None])
        table[0] = 0
        squares.bias[j][live] += part[live] ** 2
        bias[j][live] -= rate * part[live] / np.sqrt(squares.bias[j][live])


def _dense(model: Cnn) -> np.ndarray:
    """All values but the table's, in rows of ``DIM``."""
    flat = np.concatenate([*(w.ravel() for w in model.filters), *model.bias, model.out, [model.out_bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _add_dense(model: Cnn, change: np.ndarray) -> None:
    flat, at = change.ravel(), 0
    for values in (*model.filters, *model.bias, model.out):
        values += flat[at : at + values.size].reshape(values.shape)
        at += values.size
    model.out_bias += float(flat[at])


def go_on(model: Cnn, rows: DataFrame, n: int, share: float) -> None:
    """Teach ``model`` all ``n`` documents of ``rows`` (``id``, ``text``, ``y``), ``share`` of them toxic.

    Every block of about ``BLOCK`` documents, dealt and ordered by a hash of the id,
    goes on from the same model by itself.  A value moves by the mean change over
    the blocks that changed it; changes are summed as whole multiples of 1/``UNIT``,
    so neither the cluster nor the order of its tasks matters.  At most a model
    comes back, however many documents there are.
    """
    blocks, weight = max(1, round(n / BLOCK)), class_weight(share)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, net = shared.value, None, None

        def changes() -> Iterator[pa.RecordBatch]:
            moved = np.flatnonzero((net.table != first.table).any(axis=1))
            solid = _dense(net) - _dense(first)
            delta = np.vstack([net.table[moved].astype(np.float64) - first.table[moved], solid])
            place = np.r_[moved, len(first.table) + np.arange(len(solid))].astype(np.int32)
            whole = np.rint(delta * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(np.ascontiguousarray(whole[:, d])) for d in range(DIM))], ["place", *(f"v{d}" for d in range(DIM))])

        for batch in batches:
            for part in split_batch(batch, "text"):
                ids, counts = text_rows(part.column("text"))
                ends = np.cumsum(counts)
                for block, y, lo, hi in zip(part.column("block").to_pylist(), part.column("y").to_pylist(), ends - counts, ends, strict=True):
                    if block != now:
                        if net is not None:
                            yield from changes()
                        now, net = block, copy.deepcopy(first)
                    step(net, ids[lo:hi], y, weight if y else 1.0)
        if net is not None:
            yield from changes()

    dealt = rows.select(F.pmod(F.xxhash64(F.lit("toxblock"), "id"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit("toxorder"), "id").alias("at"), "id", "text", "y")
    dealt = dealt.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "at", "id").select("block", "text", "y")
    moved = dealt.mapInArrow(run, "place int, " + ", ".join(f"v{d} long" for d in range(DIM))).groupBy("place").agg(
        *((F.sum(f"v{d}") / F.count("*") / F.lit(float(UNIT))).alias(f"v{d}") for d in range(DIM))
    )
    moved = saved(moved.select("place", *(F.col(f"v{d}").cast("float") for d in range(DIM))), "toxic-step")
    got = moved.toArrow()
    place = got.column("place").to_numpy()
    change = np.column_stack([got.column(f"v{d}").to_numpy() for d in range(DIM)])
    inside = place < len(model.table)
    model.table[place[inside]] += change[inside]
    solid = np.zeros((len(_dense(model)), DIM))
    solid[place[~inside] - len(model.table)] = change[~inside]
    _add_dense(model, solid)
    dropped(moved)
    shared.destroy()


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1 among midpoints, the one nearest 0.5 on ties."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    cuts = np.append((s[:-1] + s[1:]) / 2, s[-1] / 2)
    ok = np.append(s[:-1] > s[1:], True) & (f1 >= f1.max() - 1e-12)
    return float(min(cuts[ok], key=lambda c: abs(c - 0.5)))


def cuts(scored: DataFrame) -> dict:
    """The cut that ``best_threshold`` finds for each ``key`` (null is one too) of all rows of (``key``, ``score``, ``y``).

    Rows of a key are counted by score, and scores stand in bins of their log odds;
    what lies above a bin is added to the counts in it, so no task holds a key's
    scores together.
    """
    odds = F.floor(64 * F.log(F.col("score") / (1 - F.col("score")))).cast("int")
    counted = saved(scored.groupBy("key", "score").agg(F.sum("y").alias("hit"), F.count("*").alias("n")).withColumn("bin", odds), "toxic-counts")
    above = Window.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("key", "bin").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"), F.max("score").alias("top"))
    bins = bins.select(
        F.col("key").alias("k"), F.col("bin").alias("b"), F.coalesce(F.sum("hit").over(above), F.lit(0.0)).alias("hit0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"),
        F.sum("hit").over(Window.partitionBy("key")).alias("toxic"), F.lead("top").over(Window.partitionBy("key").orderBy(F.desc("bin"))).alias("below"),
    )
    inner = Window.partitionBy("key", "bin").orderBy(F.desc("score"))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(F.broadcast(bins), F.col("key").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b")))
    f1 = 2 * (F.col("hit0") + F.sum("hit").over(upto)) / (F.col("n0") + F.sum("n").over(upto) + F.greatest("toxic", F.lit(1.0)))
    cut = (F.col("score") + F.coalesce(F.lead("score").over(inner), "below", F.lit(0.0))) / 2
    ranked = saved(ranked.select("key", f1.alias("f1"), cut.alias("cut")), "toxic-cuts")
    most = ranked.groupBy("key").agg(F.max("f1").alias("most")).withColumnRenamed("key", "k")
    best = ranked.join(F.broadcast(most), F.col("key").eqNullSafe(F.col("k"))).filter(F.col("f1") >= F.col("most") - 1e-12)
    near = best.groupBy("key").agg(F.min(F.struct(F.abs(F.col("cut") - 0.5).alias("off"), (-F.col("cut")).alias("low"))).alias("m"))
    found = {r["key"]: -r["low"] for r in near.select("key", "m.low").collect()}
    dropped(counted, ranked)
    return found


def learnable(key: Column) -> Column:
    """True for rows whose labels may be learnt: crc32 of the id as text is not 0 modulo 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    label_col: str = "toxic",
    sample: int = 5_000,
    sample_bytes: int = 64 << 20,
    least_positives: int = 30,
) -> Cnn:
    """Train on all labelled documents but a third, which is held back for the thresholds.

    The driver starts on at most about ``sample`` documents, a third of them toxic
    where there are enough; they are drawn by a hash of the id, at a rate set by the
    label counts.  Only word hashes of these texts (whole ones, 12 bytes a word)
    come to the driver, ``sample_bytes`` of them at most: in the order of the hash,
    documents that would pass it are left out of the start.  Unless the start has
    had them all, executors then go on over every document (see ``go_on``).  Of rows
    that share an id one is taken.  Who is held back a hash of the id decides, too;
    all of these are scored for the thresholds, and a language with fewer than
    ``least_positives`` toxic or other ones among them shares the common threshold.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    known = known.filter(learnable(F.col(id_col))).groupBy(id_col).agg((F.max("y") > 0).cast("double").alias("y"))
    known = known.select(F.col(id_col).alias("__lf_id"), "y")
    # ids and hashes go to the labels first; texts then only meet a list of rows
    kinds = docs.select(F.col(id_col).alias("__lf_id"), F.xxhash64(text_col).alias("h")).join(known, "__lf_id")
    kinds = kinds.groupBy("__lf_id", "h", "y").agg(F.count("*").alias("n")).groupBy("__lf_id").agg(F.min(F.struct("h", "n", "y")).alias("r"))
    back = F.pmod(F.xxhash64(F.lit("toxback"), "__lf_id"), F.lit(3)) == 2
    kinds = saved(kinds.select("__lf_id", "r.h", "r.n", "r.y", back.alias("back")), "toxic-known")
    n = {(r["back"], r["y"]): r["count"] for r in kinds.groupBy("back", "y").count().collect()}
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    full = docs.select(F.col(id_col).alias("__lf_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), lang.alias("lang"))

    def whole(wanted: DataFrame, rows: int) -> DataFrame:
        """(id, text, lang, y) of the wanted ids, one row each; only texts of repeated rows are shuffled for that."""
        sent = F.broadcast(wanted) if rows <= KNOWN_ROWS else wanted
        met = full.join(sent, ["__lf_id", "h"])
        once = met.filter("n = 1").select(F.col("__lf_id").alias("id"), "text", "lang", "y")
        again = met.filter("n > 1").groupBy("__lf_id").agg(F.min(F.struct("text", "lang", "y")).alias("r"))
        return once.unionByName(again.select(F.col("__lf_id").alias("id"), "r.text", "r.lang", "r.y"))

    want = {1.0: sample / 3, 0.0: 2 * sample / 3}
    count = {y: n.get((False, y), 0) for y in want}
    rate = F.lit(0.0)
    for y, c in count.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, want[y] / max(c, 1)))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("toxcnn"), "__lf_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = whole(kinds.filter(~F.col("back") & (draw < rate)), sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = text_rows(batch.column("text"))
            ends = np.cumsum(counts)
            blobs = [ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary()), batch.column("y")], ["id", "ids", "y"])

    id_type = rows.schema["id"].dataType.simpleString()
    drawn = saved(rows.select("id", "text", "y").mapInArrow(hashed, f"id {id_type}, ids binary, y double"), "toxic-sample")
    room, chosen = sample_bytes, []
    for name, size in sorted(drawn.select("id", F.octet_length("ids")).collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]))):
        if size <= room:
            room -= size
            chosen.append((name,))
    within = docs.sparkSession.createDataFrame(chosen, f"id {id_type}")
    got = drawn.join(F.broadcast(within), "id").select("id", "y", "ids").toArrow().combine_chunks()
    names = got.column("id").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (zlib.crc32(str(names[i]).encode()), str(names[i])))
    # views of the one buffer that came, without a copy a text
    blobs = got.column("ids")
    texts = [np.frombuffer(blobs[i].as_buffer() or b"", np.int32).reshape(-1, 3) for i in order]
    y = got.column("y").to_numpy()[order] if order else np.zeros(0)
    model = train(texts, y)
    total = sum(count.values())
    if len(texts) < total:
        go_on(model, whole(kinds.filter(~F.col("back")), total), total, count[1.0] / total)
    model.squares = None
    if n.get((True, 0.0)) and n.get((True, 1.0)):
        _calibrate(model, whole(kinds.filter("back"), n[True, 0.0] + n[True, 1.0]), least_positives)
    dropped(drawn, kinds)
    return model


def _calibrate(model: Cnn, held: DataFrame, least_positives: int) -> None:
    """Thresholds from all held-back documents (``text``, ``lang``, ``y``)."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(shared.value.scores(part.column("text"))), part.column("y")], ["key", "score", "y"])

    scored = saved(held.select("text", "lang", "y").mapInArrow(run, "key string, score double, y double"), "toxic-held")
    tally = scored.filter("key is not null").groupBy("key").agg(F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("rest"))
    enough = tally.filter((F.col("y") >= least_positives) & (F.col("rest") >= least_positives)).select("key")
    own = scored.join(F.broadcast(enough), "key", "left_semi")
    found = cuts(own.unionByName(scored.withColumn("key", F.lit(None).cast("string"))))
    model.default_threshold = found.pop(None)
    model.thresholds = dict(sorted(found.items()))
    dropped(scored)
    shared.destroy()


def _score_rows(model: Cnn, rows: np.ndarray) -> float:
    rows = rows if len(rows) else np.zeros((1, 3), np.int64)
    n, x = len(rows), model.table[rows].sum(axis=1)
    padded = np.vstack([x, np.zeros((max(WIDTHS) - 1, x.shape[1]), np.float32)])
    pooled = [np.maximum(sum(padded[k : k + n] @ w[k] for k in range(len(w))).max(axis=0) + b, 0) for w, b in zip(model.filters, model.bias, strict=True)]
    z = float(np.concatenate(pooled) @ model.out + model.out_bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def judge(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``flagged``.

    ``flagged``: the score reaches the threshold of the document's language; a
    language without a threshold of its own, or null, uses the common one.

    Nulls: a null text scores as an empty one; a null label or id teaches
    nothing.  Very long texts are read whole.  Equal texts score alike, so
    repeated rows do.  Without any label every score is the untrained model's.
    Clashing names among the added columns are replaced.
    """
    docs = docs.drop("score", "predicted", "flagged")
    model = fit(docs, labels, text_col=text_col, lang_col=lang_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in split_batch(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net.scores(part.column(text_col)))], [*fields, "score"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    cut = F.lit(model.default_threshold)
    if lang_col in docs.columns:
        for name, value in model.thresholds.items():
            cut = F.when(F.col(lang_col) == name, F.lit(value)).otherwise(cut)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("flagged", F.col("score") >= cut)
