import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import interpolm as I

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, key string, fold int, n int"


def rows(n=120, seed=2):
    rng = random.Random(seed)
    vocab = ["the", "of", "Élan", "x", "y", "rare"] + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rng.choice(vocab[: rng.choice([6, 66])]) for _ in range(rng.randint(0, 40))), "c", 1, 2) for i in range(n)]
    out += [(None, "the of", "c", 1, 2), (500, None, "c", 1, 2), (501, "", "c", 1, 2), (3, out[3][1], "c", 1, 2), (502, "the of THE " * 30_000, "c", 1, 2)]
    return out


def brute(data, weights):
    tok = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for _, t, *_ in data]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, *_ in data]
    one, two = Counter(), Counter()
    for t, f in zip(tok, fold, strict=True):
        if f:
            one.update(t)
            two.update(zip(["\n", *t], t))
    n, v = sum(one.values()), len(one)
    out = []
    for (i, *_), t, f in zip(data, tok, fold, strict=True):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for a, b in zip(["\n", *t], t):
            w = weights[int(I.frequency_bucket(np.array([one[a]]))[0])]
            score += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (v + 1))
        out.append((str(i), f == 0, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_TOKENS", 300)  # so that there are many blocks
    kept = []
    learn = I.learn_weights
    monkeypatch.setattr(I, "learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    data = rows()
    got = I.scores(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    want = brute(data, kept[0])
    got = sorted((str(r["doc_id"]), *list(r)[1:]) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_weights_rise_with_evidence():
    # bucket 5: bigrams predict; bucket 1: they never do
    cells = np.array([5_000_000 + 17_000 + 81, 1_000_000 + 0 + 81, 1_000_000 + 17_000 + 81])
    w = I.learn_weights(cells, np.array([100, 95, 5]), 1e-4)
    assert w[5][0] > 0.9 > 0.5 > w[1][0]
    assert np.allclose(w.sum(axis=1), 1)
    assert w[0][0] == 0
    assert np.allclose(w[30], w[5])


def test_weights_against_plain_em(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_TOKENS", 300)
    kept = []
    learn = I.learn_weights
    monkeypatch.setattr(I, "learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    data = [r for r in rows(400, 8) if r[0] != 502]
    I.scores(spark.createDataFrame(data, SCHEMA)).count()
    # one token at a time, with unrounded estimates
    tok = [["\n", *WORD.findall((t or "").lower()), "\n"] for _, t, *_ in data]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, *_ in data]
    one, two = Counter(), Counter()
    for t, f in zip(tok, fold, strict=True):
        if f not in (0, 9):
            one.update(t[1:])
            two.update(zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    seen = {}
    for t, f in zip(tok, fold, strict=True):
        if f == 9:
            for a, b in zip(t, t[1:]):
                bucket = one[a].bit_length()
                seen.setdefault(bucket, []).append((two[a, b] / max(one[a], 1), one[b] / n, 1 / (v + 1)))
    assert len(seen) >= 3
    for bucket, tokens in seen.items():
        w = [0.4, 0.5, 0.1] if bucket else [0.0, 0.5 / 0.6, 0.1 / 0.6]
        for _ in range(60):
            share = [0.0, 0.0, 0.0]
            for p in tokens:
                whole = sum(x * y for x, y in zip(w, p))
                for j in range(3):
                    share[j] += w[j] * p[j] / whole
            w = [x / len(tokens) for x in share]
        assert kept[0][bucket] == pytest.approx(w, abs=0.03)


def test_mixture_is_a_distribution():
    one, two, n, v = {"a": 6, "b": 4}, {("a", "a"): 2, ("a", "b"): 4}, 10, 2
    w = [0.5, 0.3, 0.2]
    p = sum(w[0] * two["a", x] / one["a"] + w[1] * one[x] / n + w[2] / (v + 1) for x in one) + w[2] / (v + 1)
    assert p == pytest.approx(1)


def test_packing():
    for x in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 3]), np.array([1 << 40, 1])):
        assert (I.unpack(I.pack(x)) == x).all()
    k = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (I.unpack_keys(I.pack_keys(k)) == k).all()


def test_empty(spark):
    assert I.scores(spark.createDataFrame([], SCHEMA)).count() == 0
