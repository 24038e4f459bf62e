"""Readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, sources_per_task: int | None = None) -> DataFrame:
    """Parquet files, folders or globs; a schema saves its inference and lets a folder be empty.

    ``sources_per_task``: about how many small files one task reads.
    """
    if sources_per_task:
        most = int(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728").rstrip("b"))
        spark.conf.set("spark.sql.files.openCostInBytes", str(max(1, most // sources_per_task)))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def from_pydict(spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType | str | None = None) -> DataFrame:
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    if schema is not None:
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(rows, names)


def from_pylist(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType | str) -> DataFrame:
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    """Any file sink Spark has; ``overwrite`` replaces what is there."""
    w = df.write.mode(mode).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)
