import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.calc import calculate, evaluate, is_expression


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1+2*3", "7"), ("(1+2)*3", "9"), ("-2^2", "4"), ("2*3^2", "36"), ("2^3^2", "64"), ("8/2/2", "2"), ("1/3", "0.333333"),
        ("sqrt(16)", "4"), ("log(1000)", "3"), ("round(-2.5)", "-3"), ("sign(-4)", "-1"), ("PI", "3.14159"), ("5 apples", "5"),
        ("(1+2", "3"), ("abs(-3)+.5", "3.5"), ("--2", "2"), ("2e", "2"), ("inf", "inf"), ("1e3", "1"), ("10^20", "1e+20"),
    ],
)
def test_values(text, want):
    assert evaluate(text) == (True, pytest.approx(float(evaluate(text)[1])), want)


@pytest.mark.parametrize("text", [None, "", "1/0", "foo", "1+", "foo(2)", "*2", "."])
def test_invalid(text):
    assert evaluate(text) == (False, None, None)


def test_degrees_and_domains():
    assert evaluate("sin(90)", True)[1] == pytest.approx(1) and evaluate("asin(1)", True)[1] == pytest.approx(90)
    assert math.isnan(evaluate("sqrt(-1)")[1]) and evaluate("ln(0)")[1] == -math.inf


def test_expression_test():
    assert is_expression("1+1") and is_expression("5 apples") and not is_expression("42") and not is_expression(None)


def test_calculate_column(spark):
    df = spark.createDataFrame([("1+1",), (None,), ("x",)], "e string").select(calculate("e").alias("r"))
    assert [(r.r.valid, r.r.text) for r in df.collect()] == [(True, "2"), (False, None), (False, None)]


HTML = [
    ("<p>Hello</p><script>var x='<b>';</script>world", "Hello world"),
    ("a<style>x", "a"),
    ("a &amp;lt; b", "a < b"),
    ("&amp;amp;", "&"),
    ("tail <unclosed", "tail"), ("a<script>x</script>b", "ab"), ("<p t='<script>'>c", "'>c"),
    ("&nbsp;&quot;q&#39;", "\"q'"),
]


def test_html(spark):
    got = [r.t for r in spark.createDataFrame([(h,) for h, _ in HTML], "h string").select(T.strip_html(F.col("h")).alias("t")).collect()]
    assert [" ".join(g.split()) for g in got] == [w for _, w in HTML]
    assert [" ".join(T.strip_html_text(h).split()) for h, _ in HTML] == [w for _, w in HTML]


def test_xml():
    assert T.strip_xml_text("<a>x&amp;lt;</a>&#65;&#x42;&bogus;&#xD800;").strip() == "x&lt; AB&bogus;"


def test_columns(spark):
    rows = [("/a/b/.hidden",), ("/a/b/Report.PDF",), ("/a.b/noext",), ("x.tar.gz",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(T.extension(F.col("p")).alias("e"), T.badge(F.col("p")).alias("b"), T.depth(F.col("p")).alias("d"), T.basename(F.col("p")).alias("n"), T.dirname(F.col("p")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("", "FILE", 3, ".hidden", "/a/b"), ("pdf", "PDF", 3, "Report.PDF", "/a/b"), ("", "FILE", 2, "noext", "/a.b"), ("gz", "GZ", 0, "x.tar.gz", ""), (None, None, None, None, None)]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 30,)], "s long").select(T.human_size(F.col("s")).alias("t")).collect()
    assert [r.t for r in sizes] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 GB"]
    t = spark.createDataFrame([("ok text",), ("a\x00b",), ("\x01" * 5 + "a" * 50,), ("",), (None,)], "t string").select(T.looks_like_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in t] == [True, False, False, False, False]
    m = spark.createDataFrame([("1a",), ("42",)], "t string").select(T.monogram(F.col("t")).alias("x")).collect()
    assert [r.x for r in m] == ["A", "4"]


def test_paths(spark):
    df = spark.createDataFrame([("/h/u",), ("/h/u/x",), ("/h/user",), ("/q/node_modules/z",), ("/q/go/pkg/z",)], "p string")
    got = df.select(T.within(F.col("p"), "/h/u").alias("w"), T.excluded(F.col("p"), ["/h/user"], ["node_modules", "go/pkg", ""]).alias("x"), T.abbreviated(F.col("p"), "/h/u").alias("a")).collect()
    assert [tuple(r) for r in got] == [(True, False, "~"), (True, False, "~/x"), (False, True, "/h/user"), (False, True, "/q/node_modules/z"), (False, True, "/q/go/pkg/z")]
    enc = spark.createDataFrame([("/a b/ü+*~(1)",)], "p string").select(T.percent_encoded(F.col("p")).alias("e")).first().e
    assert enc == "/a%20b/%C3%BC%2B%2A~%281%29"
