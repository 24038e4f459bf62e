import numpy as np
import pytest

from lumenframe.llm import anisoann as A

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, p int"


def brute(ids, x, every, k):
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % every:
            continue
        other = ids != i
        s = x[other] @ q
        o = np.lexsort((ids[other], -s))[:k]
        out += [(int(i), r + 1, int(ids[other][j]), s[j]) for r, j in enumerate(o)]
    return sorted(out)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0, "c", 1) for i, row in zip(ids, x, strict=True)], SCHEMA)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32)) * 0.7).astype(np.float32).astype(float)
    ids = np.arange(3000)
    want = brute(ids, x, 20, 20)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in A.search(frame(spark, ids, x)).collect()}
    assert len(got) == len(want)
    hits = [(q, v) for q, _, v, _ in want if (q, v) in got]
    assert len(hits) / len(want) >= 0.9
    assert all(got[q, v] == pytest.approx(s, rel=1e-12) for q, _, v, s in want if (q, v) in got)


def test_few_rows_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0], 0, "c", 1) for i in range(0, 60)] + [(100, [2.0, 2.0], 0, "c", 1)]
    bad = [(200, None, 0, "c", 1), (220, [0.0, 0.0], 0, "c", 1), (240, [1.0, None], 0, "c", 1), (260, [float("nan"), 1.0], 0, "c", 1), (280, [float("inf"), 1.0], 0, "c", 1), (300, [1.0], 0, "c", 1), (None, [1.0, 1.0], 0, "c", 1)]
    got = A.search(spark.createDataFrame(rows + bad, SCHEMA)).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 100}
    first = [r["vec_id"] for r in got if r["query_id"] == 0]
    assert first == [100, *range(1, 20)]
    assert [r["rank"] for r in got if r["query_id"] == 20] == list(range(1, 21))
    few = A.search(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert A.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loss_weighs_the_parallel_part():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))

    def parallel(weight):
        c = A.fit(x, 4, 2, weight)
        home = c.home(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (((x - c.decoded(c.encode(x, home), home)) * unit).sum(axis=1) ** 2).mean()

    assert parallel(6.0) < parallel(1.0)


def test_scan_is_the_product_with_the_decoded_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 7))
    c = A.fit(x, 2, 2, 4.0)
    home = c.home(x)
    codes = c.encode(x, home)
    got = A.scan(c.tables(x[:5]), np.arange(5), A.paired(codes)) + x[:5] @ c.centres[home].T
    assert np.allclose(got, x[:5] @ c.decoded(codes, home).T, atol=1e-4)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_without_looking_everywhere(spark, clusters):
    """Rows without any clusters are the hardest case; the probe is learnt on rows that took no part in fitting."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 24))
    if clusters:
        x = rng.normal(size=(clusters, 24))[rng.integers(0, clusters, len(x))] + 0.3 * x
    x = x.astype(np.float32).astype(float)
    ids = np.arange(len(x))
    c = A.fit(x[:6000], 700, 2, 4.0)
    c.probe = A.depth(c, x[6000:6500], x[6000:9000], 5, 0.93)
    size = np.bincount(c.home(x), minlength=700)
    share = size[c.order(x[:200])[:, : c.probe]].sum(axis=1).mean() / len(x)
    assert share < (0.12 if clusters else 0.6)
    got = {(r["query_id"], r["vec_id"]) for r in A.search(frame(spark, ids, x), every=200).collect()}
    want = brute(ids, x, 200, 20)
    assert len(got) == len(want)
    assert sum((q, v) in got for q, _, v, _ in want) >= 0.9 * len(want)


def test_equal_vectors_have_equal_scores_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 50)
    monkeypatch.setattr(A, "QUERIES", 7)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 9)).astype(np.float32).astype(float)
    x[::3] = x[0]  # a third of all rows are one vector
    ids = rng.permutation(600)
    got = A.search(frame(spark, ids, x)).collect()
    own = {int(i): row for i, row in zip(ids, x, strict=True)}
    hot = {i for i in own if (own[i] == x[0]).all()}
    for q in {r["query_id"] for r in got}:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        if q in hot:
            assert len({r["score"] for r in mine if r["vec_id"] in hot}) == 1
            assert [r["vec_id"] for r in mine] == sorted(hot - {q})[:20]
