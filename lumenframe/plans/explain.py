"""Value-free reports on how calls run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..functions.types import canonical


def explain_udf(df: DataFrame, *calls) -> list[dict]:
    """One row per call: name, route, stage, reason, operators, and a digest of the input types."""
    rows = []
    for call in calls:
        d = call.decide(df)
        types = [canonical(f.dataType.simpleString()) for f in df.select(*call.columns).schema.fields]
        rows.append(
            {
                "name": d.name, "route": d.route, "stage": d.stage, "reason": d.reason, "operators": list(d.operators),
                "layout": hashlib.sha256("|".join(types).encode()).hexdigest()[:16],
            }
        )
    return rows


def runs_python(df: DataFrame) -> bool:
    """Whether the optimised plan of ``df`` still calls Python."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(mark in plan for mark in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"))


def counters(df: DataFrame, *calls) -> dict[str, int]:
    """Number of calls by route and by reason."""
    out: dict[str, int] = {}
    for row in explain_udf(df, *calls):
        for key in (f"route.{row['route']}", f"reason.{row['reason']}"):
            out[key] = out.get(key, 0) + 1
    return out
