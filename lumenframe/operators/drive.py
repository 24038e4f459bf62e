"""Driving-log metadata: records aligned by key, and logged files checked against a listing.

Both are joins: no function runs on a row, and no task looks at its own disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sensor_align(df: DataFrame, key: str, records: DataFrame, record_key: str, out: str = "aligned") -> DataFrame:
    """JSON of each row's record, looked up by key; the record is ``null`` where there is none.

    One equi-join in place of a per-row dictionary: ``records`` has unique keys,
    and Spark broadcasts it only when it is known to be small.
    """
    fields = [c for c in records.columns if c != record_key]
    side = records.select(F.col(record_key).alias("__lf_k"), F.struct(*fields).alias("__lf_r"))
    joined = df.join(side, F.col(key) == F.col("__lf_k"), "left")
    value = F.to_json(F.struct(F.col(key).cast("string").alias("row"), F.col("__lf_r").alias("record")), {"ignoreNullFields": "false"})
    return joined.withColumn(out, value).drop("__lf_k", "__lf_r")


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of all files below a folder that Spark can reach; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", r"^\w+:(//[^/]*)?", "").alias("file"), F.col("length").alias("bytes"))


def match_files(df: DataFrame, payload: str, listing: DataFrame, *, field: str = "path", out: str = "matched") -> DataFrame:
    """``out``: JSON with the file that a JSON payload names, whether the payload is JSON at all, and the file's size.

    ``listing`` has unique ``file`` names and their ``bytes`` (see ``file_listing``);
    the size is null for a file that is not in it.  A null payload gives null.
    """
    named = F.get_json_object(F.col(payload), f"$.{field}")
    side = listing.select(F.col("file").alias("__lf_f"), F.col("bytes").cast("long").alias("__lf_b"))
    joined = df.withColumn("__lf_n", named).join(side, F.col("__lf_n") == F.col("__lf_f"), "left")
    told = F.struct(F.col("__lf_n").alias("file"), F.try_parse_json(F.col(payload)).isNotNull().alias("json"), F.col("__lf_b").alias("bytes"))
    value = F.when(F.col(payload).isNotNull(), F.to_json(told, {"ignoreNullFields": "false"}))
    return joined.withColumn(out, value).drop("__lf_n", "__lf_f", "__lf_b")
