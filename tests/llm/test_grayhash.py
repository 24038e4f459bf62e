import random
import re

import numpy as np
import pyarrow as pa
import xxhash
import pytest

from lumenframe.llm import grayhash as G
from lumenframe.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(t, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def texts(n, seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gämma", "x", "yy", "zzz", "漢字"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 30]))) for _ in range(n)]


def test_fingerprints_of_slices():
    t = texts(200) + [None, "a " * 20_000]
    whole = pa.array(t)
    for a, n in ((0, 202), (50, 70), (199, 3)):
        assert G.batch_fingerprints(whole.slice(a, n), 3).tolist() == [brute_print(x) for x in t[a : a + n]]


def near(rng, n, centres):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("radius", "agree"), [(0, 1), (1, 1), (2, 1), (3, 2), (6, 2)])
def test_links_join_what_brute_force_joins(spark, radius, agree, monkeypatch):
    monkeypatch.setattr(G, "TILE", 64)  # so that groups are cut into chunks
    fp = near(random.Random(radius), 900, 40)
    df = spark.createDataFrame([(i, int(np.int64(x))) for i, x in enumerate(fp.view(np.int64))], "node bigint, fp bigint")
    got = [(r["a"], r["b"]) for r in G.links(df, radius, agree=agree).collect()]
    assert all(bin(int(fp[a]) ^ int(fp[b])).count("1") <= radius for a, b in got)
    want = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= radius)]
    assert union(len(fp), got) == union(len(fp), want)


def test_index_finds_every_pair():
    fp = near(random.Random(9), 1500, 30)
    index = G.GrayIndex(np.zeros(len(fp), np.int64), fp, 5)
    got = {(int(min(index.fp[a], index.fp[b])), int(max(index.fp[a], index.fp[b]))) for x, y in index.pairs(4, most=1 << 12) for a, b in zip(x, y, strict=True)}
    want = {(int(fp[j]), int(fp[i])) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4)}
    assert got == want


def test_gray_rank_is_the_inverse():
    x = np.arange(1000, dtype=np.uint64)
    assert (G.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SCHEMA = "doc_id bigint, text string, fp string, node int, low int"


def test_groups(spark):
    t = texts(150, 3)
    rows = [(i, x, "c", 1, 2) for i, x in enumerate(t)] + [(None, None, "c", 1, 2), (3, t[3], "c", 1, 2), (400, "q " * 50_000, "c", 1, 2)]
    got = G.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fp = {r["fingerprint"] for r in got}
    assert fp == {f"{brute_print(x[1]):016x}" for x in rows}
    prints = [brute_print(x[1]) for x in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    root = union(len(rows), pairs)
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{p:016x}", least.get(r)) for (i, *_), p, r in zip(rows, prints, root, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert G.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(30)]
    rows, group = [], []
    for g, w in enumerate(base):
        rows.append((10 * g, " ".join(w), "c", 1, 2))
        group.append(g)
        for j in range(1, 4):
            v = list(w)
            v[50 * j] = "changed"
            rows.append((10 * g + j, " ".join(v), "c", 1, 2))
            group.append(g)
    rows += [(10, rows[4][1].upper(), "c", 1, 2), (900, "", "c", 1, 2), (901, None, "c", 1, 2), (None, "", "c", 1, 2), (0, rows[0][1], "c", 1, 2)]
    got = G.representatives(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == [10 * g for g in range(30)] + [900]
    assert got[0].asDict().keys() == {"doc_id", "text", "fp", "node", "low"}
    far = [(1, " ".join(base[0][:100] + base[1][:100]), "c", 1, 2), (2, " ".join(base[0]), "c", 1, 2)]
    assert G.representatives(spark.createDataFrame(far, SCHEMA)).count() == 2
    assert G.representatives(spark.createDataFrame([], SCHEMA)).count() == 0


def sets_of(rows, k=5):
    out = []
    for t in rows:
        w = WORD.findall(t.lower())
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return out


def kept_by_brute_force(rows):
    """Least id of each component of the pairs at a Jaccard similarity of 0.8 or more; ids are places."""
    s = sets_of(rows)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    return sorted(set(union(len(s), pairs)))


def family(rng, n, most, length=250):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        v = list(base)
        for at in rng.sample(range(length), rng.randint(2, most)):
            v[at] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("chunk", [512, 20])  # a component in one tile, and in many
def test_pairs_behind_a_refused_candidate(spark, chunk, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", chunk)
    rows = family(random.Random(3), 200, 6)
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r["doc_id"] for r in G.representatives(docs).collect()) == kept_by_brute_force(rows)


def test_joined_sets():
    rng = random.Random(5)
    rows = family(rng, 60, 8) + family(rng, 40, 4) + ["", "a b", "a b"]
    h, m = G.batch_shingles(pa.array(rows), 5)
    sets = [np.unique(x) for x in np.split(h, np.cumsum(m)[:-1])]
    assert [len(x) for x in sets] == [len(x) for x in sets_of(rows)]
    assert sorted(set(union(len(rows), G.joined(sets, np.arange(len(rows)), 0.8)))) == kept_by_brute_force(rows)
    label = np.arange(len(rows)) // 2
    s = sets_of(rows)
    known = [(2 * i, 2 * i + 1) for i in range(len(rows) // 2)]
    near = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    assert union(len(rows), G.joined(sets, label, 0.8) + known) == union(len(rows), near + known)


def test_candidates_of_cut_and_grown_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 600))]
        n = len(w)
        rows += [w, w[: -(n // 6)] if i % 2 else w + [f"e{rng.randrange(10**6)}" for _ in range(n // 6)]]
    for _ in range(20):  # the last word of a short text
        w = [f"w{rng.randrange(5000)}" for _ in range(30)]
        rows += [w, [*w[:-1], "last"]]
    rows = [" ".join(w) for w in rows]
    assert kept_by_brute_force(rows) == list(range(0, len(rows), 2))
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r["doc_id"] for r in G.representatives(docs).collect()) == kept_by_brute_force(rows)


def test_bands_of_slices():
    t = pa.array(texts(60, 4) + [None, "a b c " * 60_000])
    whole = G.batch_bands(t, 5, 4, 3)
    assert (G.batch_bands(t.slice(20, 42), 5, 4, 3) == whole[20:]).all()


def test_near_copies_without_an_id(spark):
    rng = random.Random(12)
    w = [f"w{rng.randrange(3000)}" for _ in range(200)]
    copies = [" ".join([*w[:at], "changed", *w[at + 1 :]]) for at in (50, 100, 150)]
    rows = [(None, t, "c", 1, 2) for t in copies]
    assert G.representatives(spark.createDataFrame(rows, SCHEMA)).count() == 1
    rows.append((5, " ".join(w), "c", 1, 2))
    assert [r["doc_id"] for r in G.representatives(spark.createDataFrame(rows, SCHEMA)).collect()] == [5]


def test_the_gray_index_names_candidates(spark):
    """Near copies that no MinHash band finds are found by their fingerprints, and a pair that only looks close is refused."""
    rng = random.Random(12)
    rows = []
    for i in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(100, "one two"), (101, "one two one two"), (102, None), (103, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in G.representatives(df, bands=1, rows=200).collect()}
    assert {2 * i for i in range(30)} | {100, 101, 102} <= got and 103 not in got
    assert len([i for i in got if i < 60]) <= 36
    assert {r["doc_id"] for r in G.representatives(df).collect()} == {2 * i for i in range(30)} | {100, 101, 102}
