import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lumenframe.llm import decontam as D

SCHEMA = "doc_id bigint, text string, item_id string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, least=0.8):
    found = {}
    for i, t, *_ in docs:
        w = WORD.findall((t or "").lower())
        for j, x in items:
            v = WORD.findall((x or "").lower())
            if not v or not w:
                continue
            a = shingles(v)
            for o in range(max(1, len(w) - len(v) + 1)):
                b = shingles(w[o : o + len(v)])
                same = sum((a & b).values())
                s = same / (sum(a.values()) + sum(b.values()) - same)
                if s >= least - 1e-12 and s > found.get((i, j), (0, 0))[0]:
                    found[i, j] = (s, o)
    return found


def data():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(200)]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 30, 55])))) for j in range(20)]
    items += [(50, items[0][1]), (51, None), (52, "")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 120))]
        if i % 2:
            v = items[i % 20][1].split()
            if i % 3 == 0 and len(v) > 40:
                v[-1] = "edited"
            if i % 5 == 0:
                v = v[: len(v) // 2]
            at = rng.choice([0, len(w) // 2, len(w)])
            w[at:at] = v
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w), "c", 1))
    docs += [(100, None, "c", 1), (101, "", "c", 1), (None, items[3][1], "c", 1), (1, docs[1][1], "c", 1), (102, items[5][1] + " pad" * 20_000, "c", 1), (103, items[2][1], "c", 1)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    found = D.leaks(df, bench).collect()
    want = {k: round(s, 9) for k, (s, _) in brute(docs, items).items()}
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == want
    text, item = {d[0]: d[1] for d in docs}, dict(items)
    for r in found:  # the window named has the similarity given
        v = WORD.findall(item[r["item_id"]].lower())
        w = WORD.findall(text[r["doc_id"]].lower())[r["first_word"] :][: len(v)]
        a, b = shingles(v), shingles(w)
        same = sum((a & b).values())
        assert abs(same / (sum(a.values()) + sum(b.values()) - same) - r["similarity"]) < 1e-9
    bad = {k[0] for k in want}
    kept = D.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_simhash_and_blocks(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (1, 2, 3, 40)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    got = [r[0] & (2**64 - 1) for r in df.select(D.simhash(F.col("h"))).collect()]
    assert got == [sum(1 << j for j in range(64) if 2 * sum((x >> j) & 1 for x in h) > len(h)) for (h,) in rows]
    fp = spark.createDataFrame([(-1,), (rng.randrange(2**63),)], "fp bigint")
    for r in fp.select("fp", D.blocks(F.col("fp"), 16).alias("b")).collect():
        assert len(r["b"]) == 17
        bits = "".join(f"{x['v']:b}".zfill(64 * (i + 1) // 17 - 64 * i // 17)[::-1] for i, x in enumerate(r["b"]))
        assert int(bits[::-1], 2) == r["fp"] & (2**64 - 1)


def test_empty(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b", "c", 1)], SCHEMA)
    assert D.leaks(none, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert D.leaks(docs, bench).count() == 0
    assert D.without_leaks(docs, bench).count() == 1


def test_document_shorter_than_the_item(spark):
    rng = random.Random(7)
    items, docs = [], []
    for j, n in enumerate([9, 10, 14, 24, 44, 64, 104]):
        v = [f"i{j}w{i}" for i in range(n)]
        items.append((j, " ".join(v)))
        for cut in range(n // 3):
            at = rng.choice([0, cut])  # cut at either end
            docs.append((len(docs), " ".join(v[at : at + n - cut]), "c", 1))
    docs += [(900, "i0w0 i0w1 i0w2", "c", 1), (901, "i0w0", "c", 1)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    want = {k: round(s, 9) for k, (s, _) in brute(docs, items).items()}
    assert any(s < 8 / 9 for s in want.values())
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.leaks(df, bench).collect()} == want
    assert D.without_leaks(df, bench).count() == len(docs) - len({k[0] for k in want})


def test_moved_interleaved_and_repeated_passages(spark):
    rng = random.Random(11)
    items, docs = [], []
    for j in range(12):
        v = [f"i{j}w{i}" for i in range(rng.randint(20, 60))]
        if j % 3 == 0:
            v[5:5] = v[:5]  # repeated shingles
        items.append((j, " ".join(v)))
        half = rng.randint(8, len(v) - 8)
        pad = [f"p{rng.randrange(40)}" for _ in range(60)]
        forms = [
            v[half:] + v[:half],  # rotated
            v[half:] + v + v[:half],
            v[:half] + ["x"] + v[half:],
            v[:half] + ["x", "y"] + v[half:],
            v + v,
            [w for i, w in enumerate(v) if i != half],
            v[:half] + v[half - 5 :],
            v[2:-2] + v[:2],
            items[max(0, j - 1)][1].split()[5:] + v,
        ]
        for f in forms:
            at = rng.choice([0, 20, 60])
            docs.append((len(docs), " ".join(pad[:at] + f + pad[at:]), "c", 1))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    want = {k: round(s, 9) for k, (s, _) in brute(docs, items).items()}
    assert len(want) > 50
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.leaks(df, bench).collect()} == want


def test_shingle_that_all_documents_and_items_hold(spark):
    hot = "of the people by the people"
    items = [(j, hot + "".join(f" i{j}w{i}" for i in range(12))) for j in range(30)] + [(99, "w " * 20)]
    docs = [(i, f"d{i} e{i} " + hot + f" f{i}", "c", 1) for i in range(500)]
    docs += [(600, items[7][1], "c", 1), (601, "w " * 8000, "c", 1), (602, "w " * 17, "c", 1)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["windows"], round(r["similarity"], 9)) for r in D.leaks(df, bench).collect()}
    assert got == {(600, 7): (0, 1, 1.0), (601, 99): (0, 7981, 1.0), (602, 99): (0, 1, 0.8125)}


def test_null_ids_ties_and_clashing_names(spark):
    items = [(None, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "q w e r t y u i")]
    docs = [(None, "a b c d e f g h", 1, 2), (5, "z a b c d e f g h z a b c d e f g h", 1, 2), (5, "q w e r t y u i", 1, 2), (5, "clean", 1, 2), (6, None, 1, 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, distance int, __lf_n int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"]) for r in D.leaks(df, bench).collect()}
    assert got == {(None, None, 0), (None, 1, 0), (5, None, 1), (5, 1, 0)}
    kept = D.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(5, "clean"), (6, None)}
