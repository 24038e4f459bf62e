import random

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, D).cache()
        if i < 4:
            assert after.columns == docs.columns, name
        if name != "line_dedup":
            assert after.count() <= before.count()
        else:
            assert after.count() == before.count()
        before = after
    assert before.filter("passes < 1 or passes > 3 or taken != size * passes").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, D).count() == 0


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(60)), "en", rng.choice("ab"), 1) for i in range(60)]
    rows += [(None, None, None, None, None), (100, None, "en", "a", 0), (101, "", None, "b", 0), (None, rows[5][1] + " x", "en", None, 1)]
    rows += [(102, "\n".join([rows[7][1]] * 500), "en", "a", 9), rows[3], rows[3], (rows[4][0], rows[9][1], "de", "b", 1)]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ["Score", "predicted", "flagged", "n_lines", "n_dropped", "node", "raw", "root", "__lf_p", "item_id", "w"]
    docs = base.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, D)
        got = after.collect()
        assert got, name
        if name != "mixture":
            assert after.columns == docs.columns, name
        for r in got:
            assert all(r[c] == f"{c}-{-1 if r['doc_id'] is None else r['doc_id']}" for c in clash), name
        if name == "line_dedup":
            assert len(got) == len(rows)
        if name == "near_dedup":  # 60 texts and an empty one; the long one has the shingles of the text it repeats
            assert len(got) == 61
        if name == "mixture":
            assert all(r["taken"] == r["size"] * r["passes"] > 0 for r in got)


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, D)
        cols = ", ".join(sorted(df.columns))
        got = sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
        assert got == sorted(map(repr, con.sql(f"SELECT {cols} FROM ({sql})").fetchall())), name
