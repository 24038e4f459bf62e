import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenframe.llm import quotelink as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, mid string"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")


def parse(t):
    """Own lines and quoted passages (level, lines), as a plain loop."""
    lines = []
    for x in re.split(r"\r\n|\r|\n", t or ""):
        m = re.match(r"(?:[ \t]*>)+", x)
        lines.append((m[0].count(">") if m else 0, re.sub(r"^(?:[ \t]*>)+[ \t]?", "", x) if m else x))
    for i, (level, x) in enumerate(lines[:-1]):
        if level == 0 and lines[i + 1][0] > 0 and re.match(Q.ANNOUNCES, x):
            lines[i] = (-1, x)
    runs = []
    for level, x in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(x)
        else:
            runs.append((level, [x]))
    return runs


def brute(rows):
    msgs = {}
    for c, t, r, x, *_ in rows:
        msgs[c, t, r, x] = msgs.get((c, t, r, x), 0) + 1
    convs = {}
    for (c, t, r, x), n in msgs.items():
        convs.setdefault(c, []).append((t, r, x, n))
    out = []
    for c, items in convs.items():
        items.sort(key=lambda m: m[0])
        info, parent = {}, {}
        for t, _, x, _ in items:
            runs = parse(x)
            own = [b for level, b in ((lv, b) for lv, bs in runs for b in bs) if level == 0]
            keys = {norm(" ".join(own))} | {norm(" ".join(bs)) for lv, bs in runs if lv == 0} | {norm(b) for b in own}
            text = "\n".join(own)
            if any(lv for lv, _ in runs):
                text = text.strip()
            info[t] = (text, keys - {""}, [(lv, bs) for lv, bs in runs if lv > 0])
        for t, *_ in items:
            found = []
            for lv, bs in info[t][2]:
                before = sorted((u for u in info if u < t), reverse=True)
                whole = next((u for u in before if norm(" ".join(bs)) in info[u][1]), None)
                votes = {}
                for b in {norm(b) for b in bs} - {""}:
                    u = next((u for u in before if b in info[u][1]), None)
                    if u is not None:
                        votes[u] = votes.get(u, 0) + 1
                origin = whole if whole is not None and norm(" ".join(bs)) else max(votes, key=lambda u: (votes[u], u), default=None)
                if origin is not None:
                    found.append((lv, -origin))
            prev = max((u for u in info if u < t), default=None)
            parent[t] = (-min(found)[1], "quote") if found else (prev, "previous" if prev is not None else None)
            info[t] += (len(found),)
        order = []

        def walk(t, depth):
            order.append((t, depth))
            for u in sorted(u for u in parent if parent[u][0] == t):
                walk(u, depth + 1)

        for t in sorted(u for u in parent if parent[u][0] is None):
            walk(t, 0)
        place = {t: (i + 1, d) for i, (t, d) in enumerate(order)}
        for t, r, _, n in items:
            out.append((c, t, r, info[t][0], n, len(info[t][2]), info[t][3], parent[t][0], parent[t][1], place[t][1], place[t][0]))
    return sorted(map(repr, out))


def threads(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(25):
        said = []
        for t in range(rng.randint(1, 14)):
            own = [f"point {c} {t} {j}" for j in range(rng.randint(1, 3))]
            parts = []
            if said and rng.random() < 0.7:
                u = rng.choice(said)
                kind = rng.random()
                lines = u if kind < 0.5 else u[:1] if kind < 0.8 else ["never said"]
                if rng.random() < 0.5:
                    parts.append("On Monday, A. wrote:")
                parts += [f"> {x.upper()}" for x in lines]
                if rng.random() < 0.4:
                    parts += [f"> > {x}" for x in rng.choice(said)]
                parts.append("")
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(parts + own), 1, "clash"))
            said.append(own)
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 4)  # so that conversations span blocks
    rows = threads()
    got = Q.conversations(spark.createDataFrame(rows + rows[:5], SCHEMA)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows + rows[:5])
    assert sum(r["linked_by"] == "quote" for r in got) > 30


def test_levels(spark):
    df = spark.createDataFrame([("m", 1, 1, 0, "a\n> b\n>> c\n> > d\n\t>e")], "mid string, conv_id bigint, turn bigint, pos0 int, text string")
    got = Q.parse_lines(df).orderBy("pos").collect()
    assert [(r["level"], r["body"]) for r in got] == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e")]


def test_edges(spark):
    rows = [(None, 1, "user", "a", 1, "x"), (1, None, "user", "b", 1, "x"), (1, 0, None, None, 1, "x"), (1, 1, "user", "", 1, "x"), (1, 2, "user", "> \n>", 1, "x"), (1, 2, "user", "other", 1, "x"), (2, 0, "user", "z\n" * 3000, 1, "x")]
    got = Q.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    one = [r for r in got if r["conv_id"] == 1 and r["turn"] is not None]
    assert sorted(r["position"] for r in one) == [1, 2, 3, 4]
    assert [r["parent_turn"] for r in one if r["turn"] == 2] == [1, 1]
    assert [r["position"] for r in got if r["conv_id"] is None or r["turn"] is None] == [1, 1]
    assert Q.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert F is not None


def test_one_turn_with_very_many_messages(spark, monkeypatch):
    monkeypatch.setattr(Q, "CROWD", 40)
    rows = [(1, 3, "u", f"hello {i}") for i in range(3000)] + [(1, 1, "u", "first"), (1, 2, "a", "second"), (1, 4, "a", "last"), (2, 1, "u", "other")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = Q.conversations(messages).filter("conv_id = 1").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 3004))
    assert [r["turn"] for r in got[:2]] == [1, 2]
    assert {(r["parent_turn"], r["depth"]) for r in got if r["turn"] == 3} == {(2, 2)}
    nodes = spark.createDataFrame([(hashlib.md5(b"%d" % i).hexdigest(), 1, 5, "") for i in range(2000)], "mid string, conv_id bigint, turn bigint, parent string")
    blocks = Q._blocked(nodes).groupBy("block").count().collect()
    assert len(blocks) >= 16 and sum(r["count"] for r in blocks) == 2000
    following = dict(Q._next_sibling(nodes).collect())
    order = sorted(following)
    assert [following[m] for m in order] == [*order[1:], None]
