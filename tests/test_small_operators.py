"""Definitions, imports by name, merged graphs, chosen results and text functions, with nulls, repeats and empty tables."""

import inspect

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codescout.functions import text as tx
from codescout.operators import graph as gr
from codescout.operators import hybrid as hy
from codescout.operators import resolve as rs

PARSED = (
    "file_path string, classes array<struct<name string, start_line int, end_line int>>, "
    "functions array<struct<name string, start_line int, end_line int, class_name string>>, "
    "imports array<struct<module string, names array<string>, is_from boolean, line int, level int, alias string>>"
)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_definitions_and_imports(spark):
    one = ("a.py", [("C", 1, 4)], [("m", 2, 3, "C"), ("f", 6, 7, None), (None, 8, 9, None)], [("os", [], False, 1, 0, None), ("x", ["*"], True, 2, None, None), ("y", ["p", "q"], True, 3, 1, None)])
    df = spark.createDataFrame([one, one, (None, None, None, None), ("b.py", None, None, None)], PARSED)
    assert rows(rs.definitions(df), "definition_id", "kind") == [("a.py::C", "class"), ("a.py::C::m", "function"), ("a.py::f", "function")]
    got = {(r.module, r.name, r.level, r.wildcard) for r in rs.import_names(df).collect()}
    assert got == {("os", None, 0, False), ("x", "*", 0, True), ("y", "p", 1, False), ("y", "q", 1, False)}
    assert rs.definitions(df.limit(0)).count() == 0 and rs.import_names(df.limit(0)).count() == 0


def test_merge_graphs(spark):
    kind = "graph string, src string, dst string, extra int"
    a = spark.createDataFrame([("call", "1", "2", 1), ("call", "1", "2", 2), ("call", "1", "1", 3), (None, None, None, None)], kind)
    b = spark.createDataFrame([("call", "1", "2", 9), ("dependency", "1", "2", 1)], kind)
    assert rows(gr.merge_graphs(a, b), "graph", "src", "dst") == [("call", "1", "2"), ("dependency", "1", "2")]


def test_merge_selected(spark):
    results = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 1.0), ("c", None), (None, 1.0)], "id string, score double")
    selected = spark.createDataFrame([("a",), ("d",), ("d",), ("b",)], "id string")
    assert rows(hy.merge_selected(results, selected), "id", F.round("score", 6)) == [("a", 1.04), ("b", 1.3), ("c", 0.0), ("d", 1.04)]
    assert rows(hy.merge_selected(results.limit(0), selected.limit(0)), "id") == []


def test_text_functions(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.token_estimate(F.col("t"))).collect()] == [1, 2, 0, 0]
    urls = spark.createDataFrame([("https://x.org/a/b.git",), ("git@x.org:a/b.git",), ("https://x.org/a/b/",), (None,)], "u string")
    assert [r[0] for r in urls.select(tx.repo_name_of_url(F.col("u"))).collect()] == ["b", "b", "b", None]


@pytest.mark.parametrize("lines", [["One.", "", "    Two.", "      Three.  ", ""], ["", "\tA", "\t\tB", "\tC"], ["only"], [""], ["  x", "   ", "y"]])
def test_dedent_like_cleandoc(spark, lines):
    doc = "\n".join(lines)
    got = spark.createDataFrame([(doc,)], "d string").select(tx.dedent(F.col("d"))).first()[0]
    want = "\n".join(x.rstrip() for x in inspect.cleandoc(doc.expandtabs(1)).split("\n")).strip("\n")
    assert got.replace("\t", " ") == want


@settings(max_examples=5, deadline=None)
@given(docs=st.lists(st.text(alphabet="ab \n", max_size=30), min_size=30, max_size=30))
def test_dedent_property(spark, docs):
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").coalesce(1).select(tx.dedent(F.col("d"))).collect()]
    want = ["\n".join(x.rstrip() for x in inspect.cleandoc(d).split("\n")).strip("\n") for d in docs]
    assert got == want


def test_patterns_and_levels(spark):
    from pyspark.sql import functions as F

    from codescout.operators import parse, search

    terms = {"a.b": False, r"a\.b": True, "f(x)": False, r"f\(": True, "": False}
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", search.is_pattern(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == terms
    files = spark.createDataFrame([("r", "/r/a.py", "a.py", "python", '"""Doc."""\nclass A:\n    def f(self):\n        return 1\n')], "repo_name string, path string, relative_path string, language string, content string")
    parsed = parse.parse_files(files)
    assert sorted(r["type"] for r in parse.build_elements(parsed).collect()) == ["class", "documentation", "file", "function"]
    assert sorted(r["type"] for r in parse.build_elements(parsed, ["file", "function"]).collect()) == ["file", "function"]
