import json
import math

import pytest

from lumenframe.operators import drive, relational as R
from lumenframe.sources import io
from lumenframe.functions.reuse import reuse_worth


@pytest.fixture
def df(spark):
    return io.from_pydict(spark, {"k": [1, 2, 3], "v": [1.0, None, math.nan]}, "k bigint, v double")


def test_rows(df):
    assert R.count_rows(R.drop_null(df, "v")) == 2
    assert [r["k"] for r in R.to_pylist(R.sort(R.drop_nan(df), "k"))] == [1, 2]
    assert R.to_pydict(R.sort(R.exclude(df, "v"), "k", desc=True)) == {"k": [3, 2, 1]}
    assert sum(len(p) for p in R.iter_partitions(df)) == 3
    assert sorted(r["k"] for r in R.iter_rows(df)) == [1, 2, 3]
    assert sum(b.num_rows for b in R.to_arrow_iter(df, 2)) == 3


def test_describe_and_summarize(df):
    assert [r["column_name"] for r in R.describe(df).collect()] == ["k", "v"]
    s = {r["column_name"]: r for r in R.summarize(df).collect()}
    assert (s["k"]["min"], s["k"]["max"], s["v"]["nulls"]) == ("1", "3", 1)


def test_settle_keeps_rows(df):
    assert R.settle(df, "v").columns == df.columns
    assert R.settle(df, "v").count() == 3


def test_explode_keeps_empty(spark):
    d = io.from_pydict(spark, {"k": [1, 2], "xs": [[1, 2], []]}, "k int, xs array<int>")
    assert R.explode(d, "xs").count() == 3
    assert R.explode(d, "xs", outer=False).count() == 2


def test_partitions(df):
    assert R.into_partitions(R.repartition(df, 4), 2).rdd.getNumPartitions() == 2
    assert R.into_partitions(df.coalesce(1), 3).rdd.getNumPartitions() == 3


def test_sinks(spark, df, tmp_path):
    for fmt in ("parquet", "json", "orc"):
        io.write(df, str(tmp_path / fmt), fmt, "overwrite")
        assert io.read(spark, str(tmp_path / fmt), fmt, df.schema).count() == 3
    (tmp_path / "none").mkdir()
    assert io.read_parquet(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_files_are_matched_by_listing(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.bin").write_bytes(b"12345")
    listing = drive.file_listing(spark, str(tmp_path))
    here = str(tmp_path / "deep" / "a.bin")
    assert [tuple(r) for r in listing.collect()] == [(here, 5)]
    rows = [(1, f'{{"path": "{here}"}}'), (2, '{"path": "/none"}'), (3, "{broken"), (4, None), (5, "[1]")]
    got = {r["i"]: r["matched"] and json.loads(r["matched"]) for r in drive.match_files(spark.createDataFrame(rows, "i int, p string"), "p", listing).collect()}
    assert got == {
        1: {"file": here, "json": True, "bytes": 5}, 2: {"file": "/none", "json": True, "bytes": None},
        3: {"file": None, "json": False, "bytes": None}, 4: None, 5: {"file": None, "json": True, "bytes": None},
    }


def test_reuse_rule():
    assert reuse_worth(10, 5, 0, 16)
    assert not reuse_worth(10, 6, 0, 16)
    assert not reuse_worth(10, 2, 1, 16)
    assert not reuse_worth(100, 20, 0, 16)
    assert not reuse_worth(0, 0, 0, 16)
