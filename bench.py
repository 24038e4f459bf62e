"""Headline timings: each operator as a plain Python UDF and as what it lowers to.

Prints one JSON line.  ``value`` is the sum of the native times; ``queries`` has
seconds by query, ``speedup`` the ratio of the Python UDF to the native form.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.reuse import row_udf
from lumenframe.operators import text as X
from lumenframe.operators.relational import where, with_columns
from lumenframe.plans import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))


def timed(df) -> float:
    best = float("inf")
    for _ in range(REPEAT):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t)
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").repartition(int(CPUS)).cache()
    docs.count()
    times, speedup = {}, {}
    operators = {
        "clean_html": X.HTML, "clean_links": X.LINKS, "clean_copyright": X.COPYRIGHT, "punctuation": X.PUNCT, "whitespace": X.SPACES,
        "text_length": X.LENGTH, "alphanumeric": X.ALNUM, "language_id": X.LANGUAGE,
    }
    for name, udf in operators.items():
        plain = row_udf(udf.fn, udf.return_type)
        if udf.return_type.simpleString() == "boolean":
            native, python = where(docs, udf("text")), docs.filter(plain("text"))
        else:
            native, python = with_columns(docs, {"text": udf("text")}), docs.withColumn("text", plain("text"))
        times[name] = timed(native)
        times[f"{name}_python"] = timed(python)
        speedup[name] = round(times[f"{name}_python"] / max(times[name], 1e-9), 2)
    times["clean_email"] = timed(with_columns(docs, {"text": X.EMAIL("text")}))
    times["fix_unicode"] = timed(docs.withColumn("text", X.nfc_column(F.col("text"))))
    times["text_pipeline"] = timed(X.clean_pipeline(docs))  # the file is one row group, so one task; here on the partitioned frame
    for name in ("tpch_q6_udf", "groupby_agg", "join_chain", "join_semi", "dedup_text", "emb_sum", "dict_reuse"):
        times[name] = timed(catalog.QUERIES[name](spark, SF))
    value = round(sum(t for n, t in times.items() if not n.endswith("_python")), 3)
    print(json.dumps({"metric": "headline queries, native form", "value": value, "unit": "sec", "queries": times, "speedup": speedup, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
