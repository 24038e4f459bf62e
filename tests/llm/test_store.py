import types

import pytest

from lumenframe.llm import store


def test_a_cluster_needs_a_shared_folder():
    none = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(none)


def test_saved_tables_come_and_go(spark):
    spark.conf.set(store.SHUFFLE_CLEANUP, "false")
    a = store.saved(spark.range(10).repartition(3), "a")
    b = store.saved(spark.range(5), "b")
    assert spark.conf.get(store.SHUFFLE_CLEANUP) == "false"
    assert (a.count(), b.count()) == (10, 5)
    held = len(store._written)
    store.dropped(a)
    assert len(store._written) == held - 1
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        spark.read.parquet(a._lf_path).count()
    assert b.count() == 5
    assert store.forget(spark) >= 1
    assert not store._written


def test_a_full_heap_is_collected(spark, monkeypatch):
    def full_collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    monkeypatch.setattr(store, "HEAP_SHARE", 1.0)
    before = full_collections()
    store.saved(spark.range(3), "c")
    assert full_collections() == before
    monkeypatch.setattr(store, "HEAP_SHARE", 0.0)
    store.saved(spark.range(3), "d")
    assert full_collections() > before
