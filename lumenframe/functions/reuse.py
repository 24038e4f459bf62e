"""Fallback UDFs, and evaluating a function once for each distinct input."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _guarded(fn: Callable, null_ok: bool, on_error: str) -> Callable:
    def call(*args):
        if null_ok and any(a is None for a in args):
            return None
        if on_error == "raise":
            return fn(*args)
        try:
            return fn(*args)
        except Exception:  # noqa: BLE001  asked for by on_error
            return None

    return call


def row_udf(fn: Callable, return_type: T.DataType, null_ok: bool = False, on_error: str = "raise"):
    """Plain Python UDF, one call a row."""
    return F.udf(_guarded(fn, null_ok, on_error), return_type)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def arrow_batch(fn: Callable, return_type: T.DataType, null_ok: bool = False, on_error: str = "raise"):
    """One Arrow batch a call, values in row order; the first row that fails raises."""
    call, out = _guarded(fn, null_ok, on_error), _arrow_type(return_type)

    def batch(*columns: pa.Array) -> pa.Array:
        return pa.array([call(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], out)

    batch.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, return_type)


def reuse_worth(rows: int, unique: int, nulls: int, capacity: int) -> bool:
    """Whether a batch is evaluated by its distinct values: at least half of it repeats, and they fit."""
    return not nulls and 0 < unique <= capacity and 2 * unique <= rows


def dictionary_batch(fn: Callable, return_type: T.DataType, capacity: int, null_ok: bool = False, on_error: str = "raise"):
    """Arrow UDF of one argument that calls ``fn`` once for each distinct value of a batch."""
    call, out = _guarded(fn, null_ok, on_error), _arrow_type(return_type)

    def batch(column: pa.Array) -> pa.Array:
        if not column.null_count:
            coded = column if isinstance(column, pa.DictionaryArray) else pc.dictionary_encode(column)
            if reuse_worth(len(column), len(coded.dictionary), column.null_count, capacity):
                values = pa.array([call(v) for v in coded.dictionary.to_pylist()], out)
                return values.take(coded.indices)
        return pa.array([call(v) for v in column.to_pylist()], out)

    batch.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, return_type)


def distinct_apply(df: DataFrame, column: str, out: str, udf: Callable[[Column], Column]) -> DataFrame:
    """``out`` = ``udf(column)``, evaluated once for each distinct value of the whole table.

    Distinct values are found by a partial aggregation, so a hot value is one row
    before the shuffle; AQE chooses the join and splits a hot key.  Null inputs
    give a null.
    """
    values = df.select(F.col(column).alias("__lf_v")).filter("__lf_v is not null").distinct()
    answers = values.select("__lf_v", udf(F.col("__lf_v")).alias("__lf_out"))
    joined = df.join(answers, F.col(column) == F.col("__lf_v"), "left").drop("__lf_v")
    return joined.drop(out).withColumnRenamed("__lf_out", out) if out in df.columns else joined.withColumnRenamed("__lf_out", out)


def hoisted(fn: Callable, *args, **kwargs) -> Column:
    """A call whose arguments don't differ by row, made once on the driver."""
    return F.lit(fn(*args, **kwargs))


def lookup_join(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, default: str | None = None) -> DataFrame:
    """``out`` from a keyed table (unique keys), in place of a per-row dictionary look-up."""
    side = table.select(F.col(table_key).alias("__lf_k"), F.col(value).alias("__lf_o"))
    found = df.join(side, F.col(key) == F.col("__lf_k"), "left")
    filled = F.coalesce("__lf_o", F.lit(default)) if default is not None else F.col("__lf_o")
    return found.withColumn(out, filled).drop("__lf_k", "__lf_o")


def environment(name: str, default: str = "") -> str:
    """An environment setting, read on the driver."""
    return os.environ.get(name, default)
