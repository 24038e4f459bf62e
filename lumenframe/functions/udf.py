"""Python functions in ``where``, ``select`` and ``with_columns`` that run as Columns where that is proven.

    @lowerable("string")
    def clean(text): return RE.sub(" ", text).strip()

    with_columns(df, {"clean": clean("text")})

A call is bound to the DataFrame that will run it, since the types of its inputs
decide whether it can be lowered.  What can't be proven runs as an Arrow-batched
or a plain Python UDF with the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.capture import PYTHON_REGION, capture
from ..plans.policy import Policy, from_session
from ..plans.source import NotLowerable
from .types import SPARK, kind_of, row_kind, spark_type, tuple_kind

STAGES = ("adapter", "policy", "layout", "capture", "lower", "execute")


@dataclass(frozen=True)
class Decision:
    """Why a call runs the way it does.  Holds names and reason codes, never values."""

    name: str
    route: str  # native, region (native but for one call), dictionary, arrow or row
    stage: str
    reason: str
    operators: tuple = ()


@dataclass(frozen=True)
class Call:
    """A function applied to columns, not yet bound to a DataFrame."""

    udf: LowerableUdf
    columns: tuple

    def bind(self, df: DataFrame) -> Column:
        return self.udf.bind(df, *self.columns)

    def decide(self, df: DataFrame) -> Decision:
        return self.udf.plan(df, *self.columns)[0]


class LowerableUdf:
    """A row function with a declared return type.

    ``null_policy``: ``raise`` (a null input that the function does not test for
    raises, as it does in Python) or ``propagate`` (it gives null).
    ``fallback``: ``row`` or ``arrow``; ``reuse``: evaluate once for each distinct
    input of a batch (the function must be deterministic).  ``deterministic``
    False keeps side effects to one call a row and turns lowering off.
    ``on_error``: ``raise`` or ``null``; only the former is lowered.
    """

    def __init__(
        self, fn: Callable, return_type: str | T.DataType, *, null_policy: str = "raise", fallback: str = "row", reuse: bool = False,
        deterministic: bool = True, on_error: str = "raise", policy: Policy | None = None, name: str | None = None,
    ):
        if null_policy not in ("raise", "propagate") or fallback not in ("row", "arrow") or on_error not in ("raise", "null"):
            raise ValueError("null_policy, fallback or on_error")
        self.fn, self.return_type = fn, spark_type(return_type)
        self.null_policy, self.fallback, self.reuse = null_policy, fallback, reuse
        self.deterministic, self.on_error, self.policy = deterministic, on_error, policy
        self.name = name or getattr(fn, "__name__", type(fn).__name__)
        self.__doc__ = getattr(fn, "__doc__", None)

    def __call__(self, *columns) -> Call:
        return Call(self, columns)

    def plan(self, df: DataFrame, *columns) -> tuple[Decision, Column]:
        """Decision for ``df``, and the Column that carries it out."""
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        spark = df.sparkSession
        policy = from_session(spark, self.policy or Policy())
        if policy.effective == "off":
            return self._fallback("policy", "mode_off", cols, policy)
        if not self.deterministic:
            return self._fallback("adapter", "nondeterministic", cols, policy)
        if self.on_error != "raise":
            return self._fallback("adapter", "on_error", cols, policy)
        fields = df.select(*cols).schema.fields if cols else []
        rows = [row_kind(f.dataType) for f in fields]
        kinds = [kind_of(f.dataType) or (r and (r, True)) for f, r in zip(fields, rows, strict=True)]
        if not kinds or None in kinds:
            return self._fallback("layout", "input_type", cols, policy)
        struct = tuple_kind(self.return_type)
        out = (struct, False) if struct else kind_of(self.return_type)
        if out is None:
            return self._fallback("layout", "return_type", cols, policy)
        if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
            return self._fallback("policy", "ansi_off", cols, policy)
        try:
            found = capture(self.fn, [k for k, _ in kinds], out[0], policy)
        except NotLowerable as e:
            return self._fallback("capture", e.reason, cols, policy)
        except RecursionError:
            return self._fallback("capture", "recursion", cols, policy)
        if policy.effective == "observe":
            _, column = self._fallback("policy", "mode_observe", cols, policy)
            return Decision(self.name, self._route(), "policy", "mode_observe", found.operators), column
        wide = [c.cast(SPARK[k]) if not exact else c for c, (k, exact) in zip(cols, kinds, strict=True)]
        column = found.column(*wide)
        if struct or not out[1] or self.return_type != SPARK[out[0]]:
            column = column.cast(self.return_type)  # narrow numbers: ANSI raises beyond the range
        column = self._guard(column, cols, fields, found)
        route = "region" if PYTHON_REGION in found.operators else "native"
        return Decision(self.name, route, "lower", "proven", found.operators), column.alias(self.name)

    def bind(self, df: DataFrame, *columns) -> Column:
        return self.plan(df, *columns)[1]

    def _guard(self, column: Column, cols, fields, found) -> Column:
        if found.strict:
            # a null can only come from a null input, so the input is named once and plans don't double
            if self.null_policy == "propagate" or not fields[0].nullable:
                return column
            told = F.raise_error(F.lit(f"TypeError: {self.name}: argument {found.parameters[0]} is None")).cast(self.return_type)
            return F.coalesce(column, told)
        open_ = [(c, p) for c, p, f in zip(cols, found.parameters, fields, strict=True) if f.nullable and p not in found.null_checked]
        for c, p in reversed(open_):
            if self.null_policy == "raise":
                told = F.raise_error(F.lit(f"TypeError: {self.name}: argument {p} is None")).cast(self.return_type)
            else:
                told = F.lit(None).cast(self.return_type)
            column = F.when(c.isNull(), told).otherwise(column)
        return column

    def _route(self) -> str:
        return "dictionary" if self.reuse and self.deterministic else self.fallback

    def _fallback(self, stage: str, reason: str, cols, policy: Policy) -> tuple[Decision, Column]:
        from .reuse import arrow_batch, dictionary_batch, row_udf

        route = self._route()
        if route == "dictionary" and len(cols) == 1:
            made = dictionary_batch(self.fn, self.return_type, policy.dictionary_capacity, self._null_ok(), self.on_error)
        elif route in ("arrow", "dictionary"):
            route = "arrow"
            made = arrow_batch(self.fn, self.return_type, self._null_ok(), self.on_error)
        else:
            made = row_udf(self.fn, self.return_type, self._null_ok(), self.on_error)
        if not self.deterministic:
            made = made.asNondeterministic()
        return Decision(self.name, route, stage, reason), made(*cols).alias(self.name)

    def _null_ok(self) -> bool:
        return self.null_policy == "propagate"


def lowerable(return_type: str | T.DataType, **options):
    """Decorator form of ``LowerableUdf``."""
    return lambda fn: LowerableUdf(fn, return_type, **options)


def resolve_columns(df: DataFrame, items) -> list:
    """Calls among ``items`` bound to ``df``; everything else as it is."""
    return [i.bind(df) if isinstance(i, Call) else i for i in items]


def active_policy(spark: SparkSession) -> Policy:
    return from_session(spark)
