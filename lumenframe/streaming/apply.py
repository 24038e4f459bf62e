"""Lowered functions on streams: the same Columns work in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.relational import where, with_columns


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(stream: DataFrame, columns: dict, keep=None) -> DataFrame:
    """Projection and filter of calls over a stream; stateless, so append mode holds."""
    out = with_columns(stream, columns)
    return where(out, keep) if keep is not None else out


def run_available(stream: DataFrame, name: str):
    """Run what is there into an in-memory table; for tests and small jobs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
