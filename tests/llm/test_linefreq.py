from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import linefreq
from lumenframe.llm.linefreq import drop_boilerplate, url_host

SCHEMA = "doc_id bigint, text string, source string, n_lines string"


def brute(rows, ratio, least):
    total, seen = Counter(), defaultdict(Counter)
    for _, t, s, _ in rows:
        if s is None:
            continue
        total[s] += 1
        if t is not None:
            for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
                seen[s][line] += 1
    bad = {(s, x) for s in seen for x, n in seen[s].items() if n >= least and n > ratio * total[s]}
    out = []
    for i, t, s, _ in rows:
        if t is None:
            out.append((i, None, s, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (s, x.strip(" \t\r")) not in bad or not x.strip(" \t\r")]
        out.append((i, "\n".join(kept), s, len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def rows():
    out = [(i, f"menu\nbody {i}\n\n  menu \ncopy{i % 4}", "a" if i % 3 else "b", "x") for i in range(60)]
    out += [(None, None, None, "x"), (7, "menu", None, "x"), (8, "", "a", "x"), (9, None, "a", "x"), (9, "menu", "a", "x"), (9, "menu", "a", "x"), (10, "menu\n" * 4000 + "end", "b", "x")]
    return out


@pytest.mark.parametrize("host_lines", [256, 0])  # broadcast by host, or joined by text
def test_against_brute_force(spark, monkeypatch, host_lines):
    monkeypatch.setattr(linefreq, "HOST_LINES", host_lines)
    for ratio, least in ((0.1, 10), (0.3, 2), (0.0, 1), (0.9, 3)):
        got = drop_boilerplate(spark.createDataFrame(rows(), SCHEMA), max_ratio=ratio, min_pages=least)
        assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows(), ratio, least)


def test_ratio_is_relative_to_the_site(spark):
    data = [(i, "nav\nx%d" % i, "big" if i < 80 else "small", None) for i in range(100)] + [(200 + i, f"y{i}", "big", None) for i in range(800)]
    got = drop_boilerplate(spark.createDataFrame(data, SCHEMA), max_ratio=0.5).filter("n_dropped > 0")
    assert {r["source"] for r in got.collect()} == {"small"}


def test_empty_and_hosts(spark):
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("http://A.b/c?d",), (None,), ("x",)], "u string")
    assert [r[0] for r in df.select(url_host(F.col("u"))).collect()] == ["a.b", "", ""]
