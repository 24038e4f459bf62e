"""Command line.

    python -m lumenframe explain package.module:function string bigint --returns string
    python -m lumenframe bench [folder]

``explain`` says, without running Spark, whether a function over row arguments of
the given types is lowered, and why not if it isn't; it exits with 1 in that case.
``bench`` runs the headline timings over a folder of tables.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import runpy
import sys
from pathlib import Path


def explain(name: str, inputs: list[str], returns: str) -> dict:
    """Decision for ``module:function``: route, reason and operators, or what was refused."""
    from .functions.types import kind_of, row_kind, spark_type, tuple_kind
    from .functions.udf import LowerableUdf
    from .plans.capture import capture
    from .plans.policy import Policy
    from .plans.source import NotLowerable

    module, _, attribute = name.partition(":")
    fn = getattr(importlib.import_module(module), attribute)
    udf = fn if isinstance(fn, LowerableUdf) else LowerableUdf(fn, returns)
    types = [spark_type(t) for t in inputs]
    kinds = [row_kind(t) or (kind_of(t) or (None,))[0] for t in types]
    out = tuple_kind(udf.return_type) or (kind_of(udf.return_type) or (None,))[0]
    found = {"name": udf.name, "inputs": inputs, "returns": udf.return_type.simpleString()}
    if None in (*kinds, out):
        return found | {"route": udf._route(), "stage": "layout", "reason": "return_type" if out is None else "input_type"}
    try:
        proven = capture(udf.fn, kinds, out, udf.policy or Policy())
    except NotLowerable as e:
        return found | {"route": udf._route(), "stage": "capture", "reason": e.reason, "detail": e.detail}
    return found | {"route": "native", "stage": "lower", "reason": "proven", "operators": list(proven.operators)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m lumenframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("explain")
    one.add_argument("function", help="package.module:function")
    one.add_argument("inputs", nargs="+", help="types of the row arguments")
    one.add_argument("--returns", default="string")
    two = commands.add_parser("bench")
    two.add_argument("folder", nargs="?")
    args = parser.parse_args(argv)
    if args.command == "explain":
        sys.path.insert(0, os.getcwd())
        told = explain(args.function, args.inputs, args.returns)
        print(json.dumps(told))
        return 0 if told["route"] == "native" else 1
    if args.folder:
        os.environ["BENCH_SF_DIR"] = args.folder
    runpy.run_path(str(Path(__file__).resolve().parent.parent / "bench.py"), run_name="__main__")
    return 0


if __name__ == "__main__":
    sys.exit(main())
