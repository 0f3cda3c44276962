"""Overviews on a small repository, with null, repeated, empty and clashing rows."""

import pytest
from pyspark.sql import functions as F

from codescout.functions import query as q
from codescout.operators import overview as ov

FILES = "repo_name string, path string, relative_path string, content string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("r", "/x/r/src/main.py", "src/main.py", "import os\nclass A:\n    async def go(self):\n        pass\n"),
        ("r", "/x/r/src/main.py", "src/main.py", "import os\nclass A:\n    async def go(self):\n        pass\n"),
        ("r", "/x/r/docs/README.md", "docs/README.md", ""),
        ("r", "/x/r/Readme", "Readme", None),
        ("r", "/x/r/node_modules/lib/a.js", "node_modules/lib/a.js", "x"),
        ("r", "/x/r/package.json", "package.json", "{}"),
        ("s", "/x/s/lib/a.rs", "lib/a.rs", "use std::io;\npub use crate::b as c;\n// use none\n"),
        ("s", "/x/s/lib/b.c", "lib/b.c", "#include <stdio.h>\n  # include \"b.h\"\n"),
        (None, None, None, None),
    ]
    return spark.createDataFrame(rows, FILES).withColumn("n", F.lit(1))  # n clashes with a name that is computed


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_structure(files):
    assert rows(ov.key_files(files), "relative_path") == [("package.json",), ("src/main.py",)]
    assert rows(ov.readmes(files), "repo_name", "relative_path") == [("r", "Readme")]
    assert rows(ov.project_kinds(files), "repo_name", "kind") == [("r", "Node.js application"), ("s", "software project")]
    assert rows(ov.tree_lines(files), "dir", "line") == [("docs", "docs/"), ("lib", "lib/"), ("src", "src/")]
    assert rows(ov.largest_directories(files, 1), "repo_name", "dir", "n") == [("r", "", 2), ("s", "lib", 2)]
    total = {(r.repo_name, r.extension): r.n for r in ov.files_by_extension(files).collect()}
    assert total[(None, None)] == 7 and total[("r", None)] == 5 and total[("r", "py")] == 1


def test_outline_and_includes(files):
    assert rows(ov.outline(files).where("path like '%.py'"), "line_no", "kind", "name", "is_async") == [(1, "import", "import os", False), (2, "class", "A", False), (3, "function", "go", True)]
    assert rows(ov.outline(files, 1).where("path like '%.py'"), "line_no") == [(1,)]
    assert rows(ov.includes(files), "module", "kind") == [("b.h", "include"), ("crate::b as c", "use"), ("std::io", "use"), ("stdio.h", "include")]


def test_outline_has_all_lines(spark):
    f = spark.createDataFrame([("a.py", "\n" * 150 + "class Late:")], "path string, content string")
    assert rows(ov.outline(f), "line_no", "name") == [(151, "Late")]


def test_grep_any(files):
    assert rows(ov.grep_any(files, ["main", "OS"]), "relative_path", "match_type", "matches") == [("src/main.py", "both", 1)]
    assert rows(ov.grep_any(files, ["<stdio."]), "relative_path", "match_type") == [("lib/b.c", "content")]


def test_paths(spark):
    df = spark.createDataFrame([("/a/Repo/b/c.py", "repo"), ("b/c.py", "repo"), (None, "repo"), ("b\\repo\\d", "repo")], "path string, repo string")
    assert [r[0] for r in df.select(ov.strip_repository(F.col("path"), F.col("repo"))).collect()] == ["b/c.py", "b/c.py", None, "d"]
    df = spark.createDataFrame([("a/../b",), ("../b",), ("a/../../b/c",), ("/a",), ("C:/x",), ("./a",), (None,)], "p string")
    assert [r[0] for r in df.select(ov.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, True, False]


def test_answer_sources(spark):
    e = spark.createDataFrame([("1", "class", "A", "a.py", 1, 2), ("2", None, None, None, None, None)], "id string, type string, name string, relative_path string, start_line int, end_line int")
    assert rows(ov.answer_sources(e), "source") == [("[] (:L-)".replace("] (", "]  ("),), ("[class] A (a.py:L1-2)",)]


def test_empty(spark):
    none = spark.createDataFrame([], FILES)
    for df in (ov.key_files(none), ov.readmes(none), ov.project_kinds(none), ov.tree_lines(none), ov.largest_directories(none), ov.outline(none), ov.includes(none), ov.grep_any(none, ["a"])):
        assert df.count() == 0


def test_question_filters(spark):
    texts = ["how is it done in Python?", "go-kit is nice", "the golang package", "written using c++ today", "rusty code", None, "see 'src/a.py' there"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(q.language_filter(F.col("t")).alias("l"), q.path_filter(F.col("t")).alias("p"))
    got = df.collect()
    assert [r.l for r in got] == ["python", None, None, None, None, None, None]  # after c++ the pattern wants a letter
    assert got[-1].p == "src/a.py"
    many = spark.createDataFrame([(0.0, 0.5), (100.0, 2.0), (50.0, 1.0), (None, 1.0)], "c double, f double").select(q.rounds(F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in many][:3] == [3, 6, 4]
