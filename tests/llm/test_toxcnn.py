import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import toxcnn as C

SCHEMA = "doc_id bigint, text string, lang string, source string, score string"
BAD = ["grrbad", "zzvile", "qqfoul"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", "clash"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_leaves_clean_texts_alone(spark):
    rows, labels = corpus(800)
    rows += [(None, None, None, None, None), (5000, "", "en", "s", "c"), (5001, "word1 " * 30_000 + "grrbad zzvile", "en", "s", "c"), (3, rows[3][1], "en", "s", "c")]
    labels += [(None, 1, 1), (7, 1, None), (99999, 0, 1)]
    out = C.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), sample=600)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "predicted", "flagged"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    known = [r for r in got if r["doc_id"] in truth and r["doc_id"] < 800]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.97
    assert np.mean([r["flagged"] == bool(truth[r["doc_id"]]) for r in known]) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert len({r["score"] for r in got if not r["text"]}) == 1


def plain_score(model, text, buckets):
    """One word, filter and place at a time."""
    words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    vectors = []
    for w in words:
        rows = [1 + zlib.crc32(w.encode()) % (buckets - 1), 1 + zlib.crc32(w.encode(), 0x5BD1E995) % (buckets - 1), 1 + zlib.crc32(w[:4].encode(), 0x1B873593) % (buckets - 1)]
        vectors.append([sum(float(model.table[r][d]) for r in rows) for d in range(C.DIM)])
    vectors = (vectors or [[0.0] * C.DIM]) + [[0.0] * C.DIM] * 2
    z, at = model.out_bias, 0
    for w, b in zip(model.filters, model.bias, strict=True):
        for f in range(C.FILTERS):
            places = [sum(vectors[i + k][d] * float(w[k][d][f]) for k in range(len(w)) for d in range(C.DIM)) for i in range(len(vectors) - 2)]
            z += max(max(places) + float(b[f]), 0.0) * float(model.out[at])
            at += 1
    return 1 / (1 + math.exp(-z))


def test_scores_against_a_plain_convolution():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 1000, (n, 3)) for n in (0, 1, 5, 30, 2)]
    model = C.train(docs, np.array([0, 1, 0, 1, 0.0]), epochs=2, buckets=1 << 12)
    texts = ["", None, "a", "a b", "Word, word! x y z " * 9, "...", "\u00c9lan (\u00fcber)\n\nx"]
    got = model.scores(pa.array(["pad"] * 3 + texts).slice(3))
    for t, s in zip(texts, got, strict=True):
        assert s == pytest.approx(plain_score(model, t, 1 << 12), abs=1e-5)
    assert len(model.scores(pa.array([], pa.string()))) == 0


def test_a_step_follows_the_gradient():
    """One step of Adagrad from the start moves each value by rate g / sqrt(0.01 + g * g) for its gradient g."""
    doc, rate = np.array([[3, 5, 7], [11, 13, 17], [19, 23, 29], [31, 37, 41]]), 0.1
    start = C.train([], np.zeros(0), epochs=1, buckets=64)
    after = C.train([doc], np.array([1.0]), epochs=1, rate=rate, buckets=64)

    def loss(model):
        return -math.log(C._score_rows(model, doc))

    weight = 0.5  # a sample of one label
    tried = 0
    for name in ("filters", "bias", "out"):
        values, ends = getattr(start, name), getattr(after, name)
        for v, e in zip(values, ends, strict=True) if name != "out" else [(values, ends)]:
            for spot in np.ndindex(v.shape):
                old, eps = v[spot], 1e-3
                v[spot] = old + eps
                up = loss(start)
                v[spot] = old - eps
                down = loss(start)
                v[spot] = old
                g = weight * (up - down) / (2 * eps)
                assert e[spot] - old == pytest.approx(-rate * g / math.sqrt(0.01 + g * g), abs=2e-3), (name, spot)
                tried += abs(g) > 1e-3
    assert tried > 50
    moved = np.flatnonzero(np.abs(after.table - start.table).sum(axis=1))
    assert len(moved) and set(moved) <= set(doc.ravel().tolist())
    for r in moved:  # downhill
        g = []
        for d in range(C.DIM):
            old = start.table[r, d]
            start.table[r, d] = old + 1e-3
            up = loss(start)
            start.table[r, d] = old - 1e-3
            g.append((up - loss(start)) / 2e-3)
            start.table[r, d] = old
        assert np.dot(after.table[r] - start.table[r], g) < 0


def test_sample_is_bounded_when_ids_repeat_or_texts_are_long(spark, monkeypatch):
    seen = []
    train = C.train
    monkeypatch.setattr(C, "train", lambda docs, y, **o: seen.append(docs) or train(docs, y, **o))
    rows, labels = corpus(60)
    hot = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5)
    rows += [(hot, rows[hot][1], "en", "s", "c")] * 3000 + [(70, "word1 " * 50_000, "en", "s", "c"), (71, "word2 grrbad", "en", "s", "c")]
    labels += [(70, 1, 0), (71, 1, 1)]
    C.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), sample_bytes=300_000)
    assert 20 < len(seen[0]) < 62
    assert sum(len(d) for d in seen[0]) * 12 <= 300_000


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200).astype(float)
    s = np.clip(y * 0.3 + rng.random(200) * 0.7, 0, 1)
    f1 = lambda t: 2 * (y * (s >= t)).sum() / ((s >= t).sum() + y.sum())
    assert f1(C.best_threshold(s, y)) == pytest.approx(max(f1(t) for t in s))


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", "c")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert C.judge(df, none).count() == 1
    assert C.judge(df.limit(0), none).count() == 0


def test_every_labelled_document_teaches(spark):
    """Bad words too many for the start's sample are learnt from the documents outside it; repeats and clusters change nothing."""
    rng = random.Random(5)
    bad = [f"{a}{b}vile" for a in "bcdfghjklm" for b in "aeiou"]
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(2400):
        w = [rng.choice(vocab) for _ in range(20)]
        if i % 4 == 0:
            w[rng.randrange(20)] = w[rng.randrange(20)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", "c"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = C.fit(docs, marks, sample=60)
    held = [i for i in range(2400) if zlib.crc32(str(i).encode()) % 5 == 0]
    scores = model.scores(pa.array([rows[i][1] for i in held]))
    toxic = np.array([i % 4 == 0 for i in held])
    assert (scores[toxic][:, None] > scores[~toxic]).mean() > 0.97
    again = C.fit(docs.repartition(7), marks, sample=60)
    assert (model.scores(pa.array([r[1] for r in rows])) == again.scores(pa.array([r[1] for r in rows]))).all()
    assert model.thresholds == again.thresholds and model.default_threshold == again.default_threshold


def test_thresholds_come_from_all_documents_held_back(spark, monkeypatch):
    seen = {}
    cuts = C.cuts
    monkeypatch.setattr(C, "cuts", lambda scored: seen.setdefault("rows", scored.collect()) and cuts(scored))
    rows, labels = corpus(900)
    known = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    model = C.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), sample=40, least_positives=10)
    common = [r for r in seen["rows"] if r["key"] is None]
    assert len(known) / 4 < len(common) < len(known) / 2.4
    plain = {k: C.best_threshold(*(np.array([r[c] for r in seen["rows"] if r["key"] == k]) for c in ("score", "y"))) for k in (None, "de", "en")}
    assert {None: model.default_threshold, **model.thresholds} == pytest.approx(plain)


def test_cuts_equal_the_plain_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, n in ((None, 400), ("a", 150), ("b", 3), ("c", 1)):
        y = rng.integers(0, 2, n)
        s = 1 / (1 + np.exp(-rng.normal(3 * y - 2, 3, n)))
        rows += [(key, float(v), float(t)) for v, t in zip(s, y, strict=True)]
    got = C.cuts(spark.createDataFrame(rows, "key string, score double, y double"))
    want = {k: C.best_threshold(np.array([r[1] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])) for k in (None, "a", "b", "c")}
    assert got == pytest.approx(want, abs=1e-12)
    # equal scores are on one side of any cut
    assert C.cuts(spark.createDataFrame([("a", 0.7, 1.0), ("a", 0.7, 0.0), ("a", 0.2, 0.0)], "key string, score double, y double")) == {"a": pytest.approx(0.45)}
