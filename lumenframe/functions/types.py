"""Logical types of function inputs and outputs, and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds that capture can reason about.
SPARK = {
    "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bytes": T.BinaryType(),
    "list[int]": T.ArrayType(T.LongType()), "list[float]": T.ArrayType(T.DoubleType()), "list[str]": T.ArrayType(T.StringType()),
}
_ALIASES = {"boolean": "bool", "utf8": "string", "str": "string", "long": "bigint", "int64": "bigint", "int32": "int", "integer": "int", "float64": "double", "float32": "float"}


def canonical(name: str) -> str:
    """Lower-cased name of a type with aliases resolved; names over 256 bytes are kept as they are."""
    if len(name.encode()) > 256:
        return name
    low = name.strip().lower()
    return _ALIASES.get(low, low)


_ATOMS = {
    "bool": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def spark_type(name: str | T.DataType) -> T.DataType:
    """Type of a name; atoms, and arrays and flat structs of them, need no session, other DDL does."""
    if isinstance(name, T.DataType):
        return name
    low = canonical(name)
    if low in _ATOMS:
        return _ATOMS[low]
    if low.startswith("array<") and low.endswith(">"):
        return T.ArrayType(spark_type(low[6:-1]))
    if low.startswith("struct<") and low.endswith(">") and "<" not in low[7:]:
        pairs = [f.partition(":") for f in name.strip()[7:-1].split(",")]
        return T.StructType([T.StructField(n.strip(), spark_type(t)) for n, _, t in pairs])
    return T._parse_datatype_string(name)


def kind_of(t: T.DataType) -> tuple[str, bool] | None:
    """(kind, exact): the kind of values Python would see; exact is False for narrow ints, widened first."""
    if isinstance(t, T.BooleanType):
        return "bool", True
    if isinstance(t, T.LongType):
        return "int", True
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return "int", False
    if isinstance(t, T.DoubleType):
        return "float", True
    if isinstance(t, T.FloatType):
        return "float", False
    if isinstance(t, T.StringType):
        return "str", True
    if isinstance(t, T.ArrayType):
        inner = kind_of(t.elementType)
        if inner and inner[0] in ("int", "float", "str"):
            return f"list[{inner[0]}]", inner[1]
    return None


def row_kind(t: T.DataType) -> tuple | None:
    """Kind of a struct as an input: ("row", ((field, (kind, Spark type name, fits a double)), ...)); fields of other kinds are left out."""
    if not isinstance(t, T.StructType):
        return None
    found = [(f.name, kind_of(f.dataType)) for f in t.fields]
    return "row", tuple((n, (k[0], SPARK[k[0]].simpleString(), k == ("int", False))) for n, k in found if k)


def tuple_kind(t: T.DataType) -> str | None:
    """Kind of a struct as a result: ``row(kind,...)``."""
    if not isinstance(t, T.StructType):
        return None
    kinds = [kind_of(f.dataType) for f in t.fields]
    return f"row({','.join(k[0] for k in kinds)})" if kinds and all(k and "[" not in k[0] for k in kinds) else None
