import re

from lumenframe.llm import urlrules as U

SCHEMA = "page_id bigint, url string, host string, bad int, token string"


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [
    "http://A.Example.COM/en/7x", "https://com/en/", "https://xcom/en/1", "http://b.com/en/9?x=/en/7", "http://example.net/de/81", "http://example.net/de/7#a", "http://net/de/8",
    "https://m.org/es/", "ftp://ÀB.org/es", "no scheme", "", None, "://", "http://a.com?p#/en/", "x://y://net/de/", "http://a\nb.net/de/8", "http://example.com.evil.org/en/7",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "c", 1, "t") for i, u in enumerate(URLS)], SCHEMA)
    got = U.judge(df, spark.createDataFrame([], "id bigint, bad boolean")).orderBy("page_id").collect()
    want = [plain(u) for u in URLS]
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [w[:3] for w in want]
    assert [r["verdict"] for r in got] == [w[3] or "allow" for w in want]


def test_mined_rules_match_brute_force(spark):
    rows, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        host = "cheap.shop.xyz" if spam or i % 10 == 1 else f"site{i % 7}.info"
        path = f"/buy/{i}" if spam else f"/read/{i}"
        rows.append((i, f"http://{host}{path}?utm={i}", "c", 1, "t"))
        labels.append((i, spam))
    rows += [(900, "http://cheap.shop.xyz/buy/zzz", "c", 1, "t"), (901, "http://cheap.shop.xyz/read/zzz", "c", 1, "t"), (0, rows[0][1], "c", 1, "t")]
    labels += [(None, True), (3, None)]
    pages, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "id bigint, bad boolean")
    got = {r["page_id"]: r for r in U.judge(pages, known, min_confidence=0.9).collect()}
    assert got[900]["verdict"] == "block" and got[900]["confidence"] >= 0.9
    assert got[901]["verdict"] == "allow"
    assert all(got[i]["verdict"] == ("block" if bad else "allow") for i, bad in labels[:400])
    # every mined rule has the confidence, support and lift that counting gives
    taught = pages.select("page_id", U.tokens(pages["url"]).alias("tokens")).join(known.withColumnRenamed("id", "page_id"), "page_id").filter("bad is not null").select("tokens", "bad")
    sets = [(set(r["tokens"]), r["bad"]) for r in taught.collect()]
    mined = U.mine(taught, 0.01, 0.8, 1.2, 5).collect()
    assert mined
    p_bad = sum(b for _, b in sets) / len(sets)
    for r in mined:
        hit = [b for s, b in sets if set(r["antecedent"]) <= s]
        assert abs(sum(hit) / len(hit) - r["confidence"]) < 1e-9
        assert abs(sum(hit) / len(sets) - r["support"]) < 1e-9
        assert r["confidence"] >= 0.8 and r["confidence"] / p_bad >= 1.2 - 1e-9
        assert r["token"] in r["antecedent"]


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, bad boolean")
    assert U.judge(spark.createDataFrame([], SCHEMA), none).count() == 0
