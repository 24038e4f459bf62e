"""Tables written to the folder that the whole cluster shares.

An operator that needs a result twice, or wants its lineage cut, writes it
here.  The folder is ``spark.checkpoint.dir``.  Lost executors cost nothing but
the task at hand, since the next stage reads files rather than blocks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HEAP_SHARE = 0.4

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a local master gets a temporary folder; on a cluster that
    would be a folder of one machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended; its result is a table by then."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once it fills a share of the heap's limit.

    Plans of finished jobs and broadcast tables that nothing reads any more are
    garbage, but left to itself the heap grows to its limit before they go, and
    stays there.
    """
    jvm = spark.sparkContext._jvm.java.lang
    heap = jvm.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenframe-{name}-{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    _tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` has returned and nothing reads any more."""
    for table in tables:
        path = table._lf_path
        _written.remove(path)
        _delete(table.sparkSession, path)


def forget(spark: SparkSession) -> int:
    """Delete every table that ``saved`` has written and that is still there; call it when the results are out."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
