from urllib.parse import quote

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.errors import PlanError, UnsupportedPlanError
from graphloom.functions.iri import always_absolute, resolve, uri_encode
from graphloom.functions.terms import Compiler, Term, register_function

ABSOLUTE = ["http://example.com/Venus%20Williams", "mailto:a@b", "urn:a:b", "http:", "http://u:p@h:80/x", "http://[::1]/x", "http://ex.com/a?b#c"]
RELATIVE = ["foo", "a/b:c", "?q", "#f", "//h/p", "", "http%3A%2F%2Fexample.com%2Fp1"]
NEITHER = ["1:x", "a b", "é", "a|b", "%zz", "#a#b", "a\n", "<x>", "http://h/ "]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("v")).head()[0]


def test_uri_encode(spark):
    chars = [chr(c) for c in range(32, 127)] + ["é", "日", "😀", "\n", ""]
    df = spark.createDataFrame([(c,) for c in chars], ["c"])
    assert {r.c: r.v for r in df.select("c", uri_encode(F.col("c")).alias("v")).collect()} == {c: quote(c, safe="-._~") for c in chars}


def test_iri_classes(spark):
    rows = [(v,) for v in ABSOLUTE + RELATIVE + NEITHER]
    got = {r.v: r.o for r in spark.createDataFrame(rows, ["v"]).select("v", resolve(F.col("v"), None, "keep").alias("o")).collect()}
    assert got == {v: v for v in ABSOLUTE + RELATIVE} | {v: "INVALID" for v in NEITHER}


def test_iri_base_is_put_before_relative_values(spark):
    assert one(spark, resolve(F.col("v"), "http://b/", "keep"), v="x") == "http://b/x"
    assert one(spark, resolve(F.col("v"), "http://b/", "keep"), v="urn:x") == "urn:x"
    assert one(spark, resolve(F.col("v"), "http://b/", "drop"), v="a b") is None
    with pytest.raises(PySparkException, match="invalid IRI"):
        one(spark, resolve(F.col("v"), None, "fail"), v="a b")


def test_long_iri_does_not_overflow(spark):
    assert one(spark, resolve(F.col("v"), None, "keep"), v="http://h/" + "ab%20" * 40_000).startswith("http://h/ab")


def test_always_absolute():
    assert always_absolute(["http://h/", None, "/", None])
    assert not always_absolute([None, ":x"])
    assert not always_absolute(["http://h:", None, "/"])
    assert not always_absolute(["h/", None])
    assert not always_absolute(["http://h/ ", None])


def compiler(**more):
    return Compiler({n: Term(F.col(n)) for n in ("a", "b")}, **more)


def test_functions(spark):
    ref = {"type": "Reference", "value": "a"}
    enc = {"type": "UriEncode", "inner_function": ref}
    cases = {
        "k": ({"type": "Constant", "value": "k"}, "str"),
        "x y": (ref, "str"),
        "x y/z": ({"type": "TemplateString", "value": "{a}/{b}"}, "str"),
        "x%20y": (enc, "str"),
        "http://h/x%20y": ({"type": "Iri", "inner_function": {"type": "TemplateFunctionValue", "template": "http://h/{a}", "variable_function_pairs": [["a", enc]]}}, "iri"),
        "INVALID": ({"type": "Iri", "base_iri": "http://h/", "inner_function": ref}, "iri"),
        "X Y": ({"type": "Upper", "inner_function": ref}, "str"),
    }
    for want, (spec, kind) in cases.items():
        term = compiler().compile(spec)
        assert (one(spark, term.column, a="x y", b="z"), term.kind) == (want, kind)
    assert compiler().compile({"type": "Literal", "inner_function": ref}).kind == "lit"
    assert compiler().compile({"type": "BlankNode", "inner_function": ref}).kind == "blank"


def test_registered_function(spark):
    register_function("http://f/rev", F.reverse)
    spec = {"type": "FnO", "function": "http://f/rev", "arguments": [{"type": "Reference", "value": "a"}]}
    assert one(spark, compiler().compile(spec).column, a="abc", b="") == "cba"


@pytest.mark.parametrize(
    "spec, error",
    [
        ({"type": "Reference", "value": "nope"}, PlanError),
        ({"type": "Nope"}, UnsupportedPlanError),
        ({"type": "Constant"}, PlanError),
        ({"type": "FnO", "function": "http://f/none", "arguments": []}, UnsupportedPlanError),
        ({"type": "TemplateFunctionValue", "template": "{a}", "variable_function_pairs": []}, PlanError),
    ],
)
def test_bad_functions(spark, spec, error):
    with pytest.raises(error):
        compiler().compile(spec)


def test_unreserved_columns_are_not_encoded():
    scope = {"n": Term(F.col("n"), characters="unreserved"), "t": Term(F.col("t"))}
    made = lambda n: str(Compiler(scope).compile({"type": "UriEncode", "inner_function": {"type": "Reference", "value": n}}).column)
    assert "url_encode" in made("t") and "url_encode" not in made("n")
