import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import langmix as L

SCHEMA = "doc_id bigint, text string, lang string, source string, score string"
SYLLABLES = {"aa": ["ka", "ta", "ma", "na"], "bb": ["sch", "ich", "ung", "er"], "cc": ["eau", "oux", "é", "ille"]}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_identifies_and_mixes(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang, "s", "clash") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    mixed = sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 30)
    rows += [(1000, mixed, None, "s", "c"), (1001, None, None, None, None), (1002, "123 ... 45", "aa", "s", "c"), (1003, "", "aa", "s", "c"), (None, "ka ta", None, "s", "c"), (1004, sentence(rng, "cc", 40_000), None, "s", "c"), (5, rows[5][1], rows[5][2], "s", "c")]
    out = L.identify(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "langs", "proportions"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert by[1000]["langs"] == ["aa", "bb"]
    assert abs(by[1000]["proportions"][0] - 2 / 3) < 0.1
    assert [by[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
    assert by[1004]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "ka", None, "s", "c")], SCHEMA)
    assert [r["lang_pred"] for r in L.identify(df).collect()] == ["und"]
    assert L.identify(df.limit(0)).count() == 0


def test_grams_stay_inside_words():
    g1, o1 = L.grams(pa.array(["ab", "c"]))
    g2, _ = L.grams(pa.array(["ab"]))
    assert sorted(g1[o1 == 0]) == sorted(g2)
    assert len(np.unique(o1)) == 2


def plain(model, text):
    """One document by scalar arithmetic: word likelihoods, EM, and the penalised choice of a set."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    k = len(model.langs)
    like = []
    for w in words:
        b = f" {w} ".encode()
        ll = [0.0] * k
        for n in L.ORDERS:
            for i in range(len(b) - n + 1):
                h = 0x811C9DC5 + n
                for x in b[i : i + n]:
                    h = (h ^ x) * 0x01000193 % 2**32
                slot = (h ^ (h >> 15)) % L.SLOTS + (n - 1) * L.SLOTS
                ll = [v + float(model.table[slot, j]) / len(L.ORDERS) for j, v in enumerate(ll)]
        like.append([math.exp(max(v - max(ll), -50)) for v in ll])

    def em(p, rounds):
        for _ in range(rounds):
            new = [0.0] * k
            for row in like:
                whole = sum(a * b for a, b in zip(row, p))
                new = [s + a * b / whole for s, a, b in zip(new, row, p)]
            p = [s / len(like) for s in new]
        return p

    p = em([1 / k] * k, model.rounds)
    order = sorted(range(k), key=lambda j: -p[j])
    best, chosen = None, None
    for m in range(1, k + 1):
        q = [p[j] + 1e-6 if j in order[:m] else 0.0 for j in range(k)]
        q = [x / sum(q) for x in q]
        value = sum(math.log(max(sum(a * b for a, b in zip(row, q)), 1e-30)) for row in like) - model.penalty * (m - 1) * math.log(len(like) + 1)
        if best is None or value > best:
            best, chosen = value, q
    return em(chosen, 2)


def test_inference_against_plain_em():
    rng = np.random.default_rng(5)
    table = np.log(rng.dirichlet(np.full(50, 0.3), size=3).T[rng.integers(0, 50, len(L.ORDERS) * L.SLOTS)] + 1e-4).astype(np.float32)
    model = L.Mixture(["aa", "bb", "cc"], table, 2.0, 8)
    texts = ["Ka ta MA", "x", "é ille oux " * 5, "".join(chr(97 + rng.integers(0, 6)) + (" " if i % 4 == 3 else "") for i in range(400))]
    props, counts = model.infer(pa.array(["pad pad", *texts]).slice(1))
    for row, n, t in zip(props, counts, texts, strict=True):
        assert n == len(t.split())
        assert row.tolist() == pytest.approx(plain(model, t), abs=2e-3)


def test_ties_go_to_the_first_language(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:80]  # all are learnt from, so both languages are alike
    rows = [(i, "ka ta ma na ka ta", lang, "s", "c") for i, lang in zip(ids, ["bb", "aa"] * 40, strict=True)]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["aa"]
