"""The relational surface: the host's verbs by name, with calls bound to the frame they run on.

Most verbs are Spark's own; they are gathered here so that a job can be moved
over verb by verb.  Everything stays lazy and declarative but for the terminals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.udf import Call, resolve_columns

# -- operators that bind calls


def where(df: DataFrame, predicate: Call | Column | str) -> DataFrame:
    return df.filter(*resolve_columns(df, [predicate]))


filter = where  # noqa: A001


def select(df: DataFrame, *columns, **named) -> DataFrame:
    cols = resolve_columns(df, columns)
    return df.select(*cols, *(c.alias(n) for n, c in zip(named, resolve_columns(df, named.values()), strict=True)))


def with_columns(df: DataFrame, columns: dict) -> DataFrame:
    return df.withColumns(dict(zip(columns, resolve_columns(df, columns.values()), strict=True)))


def with_column(df: DataFrame, name: str, value) -> DataFrame:
    return with_columns(df, {name: value})


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Work the named columns out here, once a row.

    Catalyst moves filters below projections by repeating what they use; for a
    costly expression under several filters that repeats the work.  A generator
    of one element is a barrier to it, inside the same stage.
    """
    rest = [c for c in df.columns if c not in names]
    row = F.struct(*(F.col(n).alias(n) for n in names))
    return df.select(*rest, F.explode(F.array(row)).alias("__lf_s")).select(*(F.col(f"__lf_s.{c}").alias(c) if c in names else F.col(c) for c in df.columns))


# -- projections and rows


def getitem(df: DataFrame, item):
    return df.select(*item) if isinstance(item, (list, tuple)) else df[item]


def exclude(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def with_column_renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def with_columns_renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_null(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows with a null in one of the columns named (all by default); NaN stays, unlike with ``na.drop``."""
    for name in names or df.columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def drop_nan(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows with NaN in one of the float columns named (all of them by default); nulls stay."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (not names or f.name in names)]
    for name in floats:
        df = df.filter(F.col(name).isNull() | ~F.isnan(name))
    return df


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


unique = distinct


def drop_duplicates(df: DataFrame, *names: str) -> DataFrame:
    return df.dropDuplicates(list(names)) if names else df.dropDuplicates()


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def offset(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)


def sample(df: DataFrame, fraction: float, seed: int = 0, with_replacement: bool = False) -> DataFrame:
    return df.sample(with_replacement, fraction, seed)


def sort(df: DataFrame, *by, desc: bool | Sequence[bool] = False) -> DataFrame:
    flags = [desc] * len(by) if isinstance(desc, bool) else list(desc)
    cols = [F.col(b) if isinstance(b, str) else b for b in by]
    return df.orderBy(*(c.desc() if d else c.asc() for c, d in zip(cols, flags, strict=True)))


def explode(df: DataFrame, name: str, outer: bool = True) -> DataFrame:
    """One row an element; with ``outer`` an empty or null list keeps its row with null."""
    return df.withColumn(name, F.explode_outer(name) if outer else F.explode(name))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, variable, value)


melt = unpivot


def pivot(df: DataFrame, group: Sequence[str], on: str, value: str, agg: str = "sum", names: Sequence | None = None) -> DataFrame:
    """Long to wide; naming ``names`` saves the pass that finds them."""
    grouped = df.groupBy(*group)
    wide = grouped.pivot(on, list(names)) if names is not None else grouped.pivot(on)
    return wide.agg(getattr(F, agg)(value))


def repartition(df: DataFrame, n: int | None, *by) -> DataFrame:
    return df.repartition(n, *by) if n is not None else df.repartition(*by)


def into_partitions(df: DataFrame, n: int) -> DataFrame:
    """``n`` partitions; fewer than now are merged without a shuffle."""
    return df.coalesce(n) if n < df.rdd.getNumPartitions() else df.repartition(n)


def into_batches(spark: SparkSession, n: int) -> None:
    """Rows an Arrow batch hands to a Python function."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


# -- aggregates


def agg(df: DataFrame, *exprs: Column) -> DataFrame:
    return df.agg(*exprs)


def _one(fn: Callable[[str], Column]) -> Callable:
    def run(df: DataFrame, *names: str) -> DataFrame:
        return df.agg(*(fn(n).alias(n) for n in names))

    return run


sum = _one(F.sum)  # noqa: A001
mean = _one(F.avg)
min = _one(F.min)  # noqa: A001
max = _one(F.max)  # noqa: A001
count = _one(F.count)
any_value = _one(lambda n: F.any_value(n, True))
stddev = _one(F.stddev_pop)
agg_list = _one(F.collect_list)
agg_set = _one(F.collect_set)


def agg_concat(df: DataFrame, *names: str) -> DataFrame:
    """Lists end to end, or strings end to end, in no promised order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.agg(*(
        (F.flatten(F.collect_list(n)) if isinstance(kinds[n], T.ArrayType) else F.listagg(n)).alias(n) for n in names
    ))


def groupby(df: DataFrame, *by):
    return df.groupBy(*resolve_columns(df, by))


def describe(df: DataFrame) -> DataFrame:
    """Column names and types."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, type string, nullable boolean")


def summarize(df: DataFrame) -> DataFrame:
    """Per column: type, min, max, count, nulls and approximate distinct values, in one pass."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        flat = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        none = F.lit(None).cast("string")
        parts.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
            (F.min(c).cast("string") if flat else none).alias("min"), (F.max(c).cast("string") if flat else none).alias("max"),
            F.count(c).alias("count"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
            (F.approx_count_distinct(c) if flat else F.lit(None).cast("bigint")).alias("approx_distinct"),
        ))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


# -- joins and set operators


def join(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Catalyst picks the algorithm; ``semi`` and ``anti`` included."""
    return df.join(other, on, {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how))


def concat(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.union(other)


union_all = concat


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.union(other).distinct()


def union_all_by_name(df: DataFrame, other: DataFrame, missing: bool = False) -> DataFrame:
    return df.unionByName(other, missing)


def union_by_name(df: DataFrame, other: DataFrame, missing: bool = False) -> DataFrame:
    return df.unionByName(other, missing).distinct()


def intersect(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.intersect(other)


def intersect_all(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.intersectAll(other)


def except_distinct(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.subtract(other)


def except_all(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.exceptAll(other)


def transform(df: DataFrame, fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return df.transform(fn, *args, **kwargs)


pipe = transform

# -- terminals


def count_rows(df: DataFrame) -> int:
    return df.count()


length = count_rows


def collect(df: DataFrame) -> list:
    return df.collect()


def show(df: DataFrame, n: int = 8) -> None:
    df.show(n)


def to_pylist(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def to_pydict(df: DataFrame) -> dict[str, list]:
    table = df.toArrow()
    return {n: table.column(n).to_pylist() for n in table.column_names}


def to_pandas(df: DataFrame):
    return df.toPandas()


def to_arrow(df: DataFrame):
    return df.toArrow()


def iter_rows(df: DataFrame) -> Iterator[dict]:
    """Rows one partition at a time, so the driver never holds more."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))


def to_arrow_iter(df: DataFrame, rows: int = 10_000) -> Iterator:
    """Record batches, one partition at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, held = to_arrow_schema(df.schema), []
    for r in df.toLocalIterator():
        held.append(r.asDict(recursive=True))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def iter_partitions(df: DataFrame) -> Iterator[list]:
    """Lists of rows, one a partition."""
    tagged = df.withColumn("__lf_p", F.spark_partition_id())
    held, at = [], None
    for r in tagged.toLocalIterator():
        d = r.asDict(recursive=True)
        p = d.pop("__lf_p")
        if held and p != at:
            yield held
            held = []
        held.append(d)
        at = p
    if held:
        yield held


def to_torch_iter(df: DataFrame) -> Iterator[dict]:
    """Rows for an iterable dataset; any object with ``__iter__`` may wrap it."""
    return iter_rows(df)


def to_torch_map(df: DataFrame) -> list[dict]:
    """Rows for a map-style dataset, held on the driver."""
    return to_pylist(df)


def hand_off(df: DataFrame, path: str) -> str:
    """Parquet files for an engine that Spark can't hand rows to directly."""
    df.write.mode("overwrite").parquet(path)
    return path
