import functools
import math
import random
import struct

import functions_under_test as fut
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe.functions.udf import LowerableUdf, lowerable
from lumenframe.operators import relational as R
from lumenframe.operators import text as X
from lumenframe.plans.capture import capture
from lumenframe.plans.explain import counters, explain_udf, runs_python
from lumenframe.plans.policy import Policy
from lumenframe.plans.source import NotLowerable

TORTURE = [
    "", "  ", "\u001c\u001d a 　b\u001f", " httpſ://é.x/　c", "WWW.İ.com x", "Copyright (c) 2020 Foo.\nall rightſ reserved x", "“a” ‘b’ – —", "​a​",
    "$1 \\ <b>x</b><", "٣² Ⅷ１２ 漢字", "a😀b", "x" * 3000, "ab\tba", "prefix a[b", "русский", "éá",
] + [chr(c) + "a" for c in range(1, 0x2100, 5)]
FLOATS = [0.0, -0.0, 1.25, -1.25, 10.0, 12.5, math.nan, math.inf, -math.inf, 1.797e308, 5e-324]


def bits(x):
    return x if x is None or isinstance(x, (bool, int)) else struct.pack(">d", x) if not math.isnan(x) else "nan"


def run(spark, udf, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    call = udf("v")
    rows = R.select(df, "i", out=call).orderBy("i").collect()
    return call.decide(df), [r["out"] for r in rows]


@pytest.mark.parametrize("udf", [*X.MAPPERS.values(), X.LENGTH, X.ALNUM, X.LANGUAGE, X.PERPLEXITY], ids=lambda u: u.name)
def test_text_operators_match_python(spark, udf):
    _, got = run(spark, udf, TORTURE, "string")
    assert got == [udf.fn(t) for t in TORTURE]


@pytest.mark.parametrize(
    ("fn", "kind"),
    [(fut.provider_join, "string"), (fut.mirrored_join, "string"), (fut.em_space, "string"), (fut.dollars, "string"), (fut.expanding, "string"), (fut.swapped, "string"),
     (fut.two_sums, "bigint"), (fut.wrapped, "boolean"), (functools.partial(fut.wrapped, low=0, high=9), "boolean")],
    ids=str,
)
def test_string_functions_are_native_and_exact(spark, fn, kind):
    d, got = run(spark, LowerableUdf(fn, kind, name="f"), TORTURE, "string")
    assert d.route == "native"
    assert got == [fn(t) for t in TORTURE]


@pytest.mark.parametrize("fn", [fut.affine, fut.branchy, fut.nan_safe], ids=lambda f: f.__name__)
def test_float_functions_are_bit_exact(spark, fn):
    kind = "boolean" if fn is fut.nan_safe else "double"
    d, got = run(spark, LowerableUdf(fn, kind), FLOATS, "double")
    assert d.route == "native"
    assert [bits(g) for g in got] == [bits(fn(v)) for v in FLOATS]


def test_random_floats(spark):
    rng = random.Random(4)
    values = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(2000)]
    _, got = run(spark, LowerableUdf(fut.branchy, "double"), values, "double")
    assert [bits(g) for g in got] == [bits(fut.branchy(v)) for v in values]


def test_none_branch(spark):
    d, got = run(spark, LowerableUdf(fut.none_or, "double"), [None, 1.0], "double")
    assert d.route == "native"
    assert got == [-1.0, 2.0]


@pytest.mark.parametrize(("fn", "out", "kind"), [(fut.count_ints, "bigint", "array<bigint>"), (fut.total, "bigint", "array<bigint>"), (fut.total, "double", "array<double>")])
def test_lists(spark, fn, out, kind):
    values = [[], [1, 2, 3], [5]] if "bigint" in kind else [[0.5], [1.0, 2.5, 1e300], [0.1, 0.2, 0.3]]
    d, got = run(spark, LowerableUdf(fn, out), values, kind)
    assert d.route == "native"
    assert got == [fn(v) for v in values]


@pytest.mark.parametrize(
    ("fn", "kinds", "out", "reason"),
    [
        (fut.rounded, ["float"], "float", "call"), (fut.anchored, ["str"], "str", "pattern_language"), (fut.nested_class, ["str"], "str", "pattern_language"),
        (fut.noisy, ["list[int]"], "int", "loop_body"), (fut.filtered_join, ["str"], "str", "join_argument"), (fut.overlapping, ["str"], "str", "table_overlap"),
        (fut.needs_two, ["int"], "int", "arity"), (fut.int_div, ["int", "int"], "float", "inexact_integer"),
        (len, ["str"], "int", "not_a_function"), (fut.affine, ["str"], "float", "operand_kinds"), (fut.affine, ["float"], "str", "return_kind"),
    ],
)
def test_refusals(fn, kinds, out, reason):
    with pytest.raises(NotLowerable) as e:
        capture(fn, kinds, out)
    assert e.value.reason == reason


def test_changed_code_is_refused():
    def f(t):
        return len(t) > 2

    def g(t):
        return len(t) > 3

    f.__code__ = g.__code__.replace(co_name="f", co_firstlineno=f.__code__.co_firstlineno, co_qualname=f.__code__.co_qualname)
    with pytest.raises(NotLowerable) as e:
        capture(f, ["str"], "bool")
    assert e.value.reason == "source_differs"


def test_globals_are_read_when_planned(spark, monkeypatch):
    monkeypatch.setattr(fut, "SCALE", 3.0)
    _, got = run(spark, LowerableUdf(fut.affine, "double"), [2.0], "double")
    assert got == [7.25]


def test_null_policies(spark):
    with pytest.raises(PySparkException, match="TypeError: clean_html"):
        run(spark, X.HTML, ["a", None], "string")
    _, got = run(spark, LowerableUdf(X.clean_html, "string", null_policy="propagate"), ["<b>", None], "string")
    assert got == [" ", None]
    _, got = run(spark, LowerableUdf(fut.branchy, "double", null_policy="propagate"), [1.0, None], "double")
    assert got == [0.25, None]


def test_zero_division_raises(spark):
    with pytest.raises(PySparkException, match="DIVIDE_BY_ZERO"):
        run(spark, LowerableUdf(fut.loop_if, "boolean"), [""], "string")


@pytest.mark.parametrize(("mode", "route"), [("off", "row"), ("observe", "row"), ("auto", "native")])
def test_modes(spark, mode, route):
    d, got = run(spark, LowerableUdf(fut.affine, "double", policy=Policy(mode=mode)), [1.0], "double")
    assert (d.route, got) == (route, [2.75])


def test_policy_only_tightens():
    p = Policy().tighten(Policy(mode="observe", qualified=frozenset(["links"]), max_nodes=10))
    assert (p.mode, p.qualified, p.max_nodes) == ("observe", {"links"}, 10)
    assert p.tighten(Policy()).mode == "observe"
    with pytest.raises(ValueError, match="mode"):
        Policy(mode="fast")


def test_switches(spark):
    spark.conf.set("spark.lumenframe.links", "false")
    try:
        df = spark.createDataFrame([("www.a b",)], "t string")
        assert X.LINKS("t").decide(df).reason == "switched_off"
        assert df.select(X.LINKS("t").bind(df)).first()[0] == " b"
    finally:
        spark.conf.unset("spark.lumenframe.links")


def test_input_type_decides(spark):
    df = spark.createDataFrame([(1,)], "n bigint")
    d = X.PUNCT("n").decide(df)
    assert d.route == "arrow" and d.reason in ("operand_kinds", "method")


def test_float32_and_narrow_ints(spark):
    df = spark.createDataFrame([(1.1, 7)], "f float, n int")

    @lowerable("float")
    def half(v):
        return v * 0.5

    out = R.select(df, x=half("f")).first()["x"]
    assert out == pytest.approx(0.55, rel=1e-6)


def test_reuse_calls_once_for_each_value(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("t")).coalesce(1)

    def slow(t):
        return "<%s>" % t

    udf = LowerableUdf(slow, "string", reuse=True)
    assert udf("t").decide(df).route == "dictionary"
    assert R.select(df, x=udf("t")).distinct().count() == 3


def test_explain_has_no_values(spark):
    df = spark.createDataFrame([("secret",)], "t string")
    rows = explain_udf(df, X.HTML("t"), X.UNICODE("t"))
    assert "secret" not in str(rows)
    assert counters(df, X.HTML("t"), X.UNICODE("t"))["route.native"] == 1
    assert not runs_python(R.with_columns(df, {"t": X.HTML("t")}))
    assert runs_python(R.with_columns(df, {"t": X.UNICODE("t")}))


def test_on_error_null(spark):
    def bad(t):
        return 1 // len(t)

    _, got = run(spark, LowerableUdf(bad, "bigint", on_error="null"), ["", "a"], "string")
    assert got == [None, 1]


def test_stream_gives_the_same(spark, tmp_path):
    from lumenframe.streaming.apply import clean_stream, run_available, stream_parquet

    df = spark.createDataFrame([("<b>hi there</b>",), ("x",)], "t string")
    df.write.parquet(str(tmp_path / "in"))
    s = stream_parquet(spark, str(tmp_path / "in"), df.schema)
    out = run_available(clean_stream(s, {"t": X.HTML("t")}, X.LENGTH("t")), "cleaned")
    assert [r["t"] for r in out.collect()] == [" hi there "]


@pytest.mark.parametrize(
    ("fn", "kind"),
    [(fut.lowered, "string"), (fut.uppered, "string"), (fut.chunks, "string"), (fut.fields_joined, "string"), (fut.rejoined, "string"), (fut.counted, "bigint"),
     (fut.with_constants, "string"), (fut.through_cache, "bigint"), (fut.trimmed, "string"), (fut.grade_or, "bigint"), (fut.letters_of, "bigint")],
    ids=lambda x: getattr(x, "__name__", x),
)
def test_more_string_functions_are_native_and_exact(spark, fn, kind):
    values = [*TORTURE, "a. b!  c?\n d.", "aaa,b,,c", ",", "prex", "aXaaYaaaa", "b", "a", " . ", "ΑΣ ΟΔΥΣΣΕΥΣ Σ aΣ. Σb", "ŉßﬃİı", "Ǆǅǆ 𐐀𐐨"]
    d, got = run(spark, LowerableUdf(fn, kind, name="f"), values, "string")
    assert d.route == "native", d
    assert got == [fn(t) for t in values]


def test_case_mapping_of_every_character(spark):
    """Alone, and beside a capital sigma, the one letter whose mapping depends on its neighbours."""
    # U+1171E is a mark whose category differs between the versions of Unicode
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c != 0x1171E]
    sigma = "\u03a3"
    around = [x for c in chars if ord(c) < 0x1F000 or 0xE0000 <= ord(c) < 0xE0200 for x in (c + sigma, f"a{c}{sigma}", f"a{sigma}{c}a", f"a{sigma}{c}")]
    for fn, parts in ((fut.lowered, chars), (fut.uppered, chars), (fut.lowered, around)):
        values = [" ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)]
        _, got = run(spark, LowerableUdf(fn, "string", name="f"), values, "string")
        wrong = [(x, y) for g, v in zip(got, values, strict=True) if g != fn(v) for x, y in zip(g.split(" "), fn(v).split(" ")) if x != y]
        assert not wrong, (fn.__name__, len(wrong), wrong[:5])


def test_extremes(spark):
    d, got = run(spark, LowerableUdf(fut.clamp, "double"), FLOATS, "double")
    assert d.route == "native"
    assert [bits(g) for g in got] == [bits(fut.clamp(v)) for v in FLOATS]
    df = spark.createDataFrame([(1, 2), (5, 4), (-1, 0)], "a bigint, b bigint")
    assert [r[0] for r in R.select(df, out=LowerableUdf(fut.largest, "bigint")("a", "b")).collect()] == [3, 5, 3]


def test_lookups_and_formats(spark):
    d, got = run(spark, LowerableUdf(fut.name_or_none, "string"), [1, 2, 3], "bigint")
    assert (d.route, got) == ("native", ["one", "two", None])
    df = spark.createDataFrame([("k", 2), ("", -3)], "t string, n bigint")
    call = LowerableUdf(fut.labelled, "string")("t", "n")
    assert call.decide(df).route == "native"
    assert [r[0] for r in R.select(df, out=call).collect()] == ["k=2!", "=-3!"]


def test_lists_and_tuples_as_results(spark):
    d, got = run(spark, LowerableUdf(fut.pair, "array<double>"), [1.5, -0.0], "double")
    assert d.route == "native" and "list.make" in d.operators
    assert got == [[1.5, 3.0], [-0.0, -0.0]]
    df = spark.createDataFrame([("k", 2)], "t string, n bigint")
    call = LowerableUdf(fut.triple, "struct<a:string,b:int,c:boolean>")("t", "n")
    assert call.decide(df).route == "native"
    assert tuple(R.select(df, out=call).first()["out"]) == ("k", 2, True)


def test_fields_of_a_struct(spark):
    df = spark.createDataFrame([((True, 3, 0.5, "x", bytearray(b"y")),), ((False, 7, 1.5, "", bytearray()),)], "r struct<flag:boolean,small:int,ratio:double,label:string,payload:binary>")
    call = LowerableUdf(fut.of_record, "double")("r")
    d = call.decide(df)
    assert d.route == "native" and "field.load" in d.operators
    assert [r[0] for r in R.select(df, out=call).collect()] == [1.0, 7.0]
    empty = spark.createDataFrame([((True, 3, None, "x", None),)], df.schema)
    with pytest.raises(PySparkException, match="ratio is None"):
        R.select(empty, out=call).collect()


def test_mail_and_chunks_are_native(spark):
    df = spark.createDataFrame([("a",)], "text string")
    routes = {r["name"]: r["route"] for r in explain_udf(df, *(m("text") for m in X.MAPPERS.values()))}
    assert {n for n, r in routes.items() if r != "native"} == {"fix_unicode"}


def test_one_opaque_call_stays_python(spark):
    values = ["", " aé ", "xyz"]
    d, got = run(spark, LowerableUdf(fut.sandwich, "string"), values, "string")
    assert (d.route, d.reason) == ("region", "proven") and "str.replace" in d.operators
    assert got == [fut.sandwich(v) for v in values]
    with pytest.raises(PySparkException, match="TypeError"):
        run(spark, LowerableUdf(fut.sandwich, "string"), ["a", None], "string")
    d, got = run(spark, LowerableUdf(fut.sandwich, "string", null_policy="propagate"), ["a", None], "string")
    assert got == [fut.sandwich("a"), None]
    with pytest.raises(PySparkException, match="did not return int"):
        run(spark, LowerableUdf(fut.wrong_type, "bigint"), ["a"], "string")
    for fn in (fut.in_a_branch, fut.untyped):
        d, got = run(spark, LowerableUdf(fn, "string"), values, "string")
        assert d.route == "row"
        assert got == [fn(v) for v in values]
    assert run(spark, LowerableUdf(fut.sandwich, "string", policy=Policy(regions=False)), ["a"], "string")[0].route == "row"
