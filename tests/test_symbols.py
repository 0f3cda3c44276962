"""Symbols, scopes and calls on a small repository whose answers are known, and on empty, null and repeated rows."""

import pytest

from codescout.operators import symbols as sy

FILES = "repo_name string, path string, relative_path string, content string"
PARSED = (
    "file_path string, classes array<struct<name string, start_line int, end_line int, bases array<string>>>, "
    "functions array<struct<name string, start_line int, end_line int, class_name string>>, "
    "imports array<struct<module string, names array<string>, is_from boolean, line int, level int, alias string>>"
)
ELEMENTS = "id string, type string, name string, file_path string, repo_name string, metadata map<string,string>"

A = "class Base:\n    def run(self):\n        return self.stop()\n    def stop(self):\n        return 1\n\ndef helper():\n    return 2\n"
B = (
    "from .a import Base, helper\nimport pkg.a as tools\nfrom .a import Base as Root\n\nclass Child(Base):\n    def go(self):\n        x = Root()\n"
    "        # helper()\n        print('helper()')\n        x.run()\n        return helper() + tools.helper()\n\nclass Other(tools.Base):\n    pass\n\nthing = Child()\nthing.go()\n"
)


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([("r", "/r/pkg/a.py", "pkg/a.py", A), ("r", "/r/pkg/b.py", "pkg/b.py", B), ("r", "/r/pkg/b.py", "pkg/b.py", B), ("r", None, None, None), ("r", "/r/x.py", "x.py", "")], FILES)
    parsed = spark.createDataFrame(
        [
            ("/r/pkg/a.py", [("Base", 1, 5, [])], [("run", 2, 3, "Base"), ("stop", 4, 5, "Base"), ("helper", 7, 8, None)], []),
            ("/r/pkg/b.py", [("Child", 5, 11, ["Base"]), ("Other", 13, 14, ["tools.Base"])], [("go", 6, 11, "Child")], [("a", ["Base", "helper"], True, 1, 1, None), ("pkg.a", [], False, 2, 0, "tools"), ("a", ["Base"], True, 3, 1, "Root"), ("gone", ["x"], True, 4, 0, None)]),
            (None, None, None, None),
        ],
        PARSED,
    )
    row = lambda i, t, n, f, c=None: (i, t, n, f, "r", {"class_name": c} if c else None)
    a, b = "/r/pkg/a.py", "/r/pkg/b.py"
    rows = [row("fa", "file", "a", a), row("fb", "file", "b", b), row("base", "class", "Base", a), row("run", "function", "run", a, "Base"), row("stop", "function", "stop", a, "Base"), row("help", "function", "helper", a), row("child", "class", "Child", b), row("other", "class", "Other", b), row("go", "function", "go", b, "Child")]
    elements = spark.createDataFrame([*rows, rows[2], row(None, None, None, None)], ELEMENTS)
    return elements, files, parsed


def test_bindings_of_names_aliases_and_modules(repo):
    _, files, parsed = repo
    got = {(r.bound, r.target_path, r.symbol) for r in sy.bindings(files, parsed).collect()}
    a = "/r/pkg/a.py"
    assert got == {("Base", a, "Base"), ("helper", a, "helper"), ("Root", a, "Base"), ("tools", a, None)}


def test_inheritance_by_resolved_symbols(repo):
    got = {tuple(r) for r in sy.resolved_inheritance(*repo).collect()}
    assert got == {("child", "base", "imported"), ("other", "base", "module")}


def test_calls_within_files_classes_variables_and_modules(repo):
    got = {(r.src, r.dst) for r in sy.resolve_calls(*repo).collect()}
    # self.stop(), Root(), x.run() through its class, helper(), and of the module Child() and thing.go()
    assert got == {("run", "stop"), ("go", "base"), ("go", "run"), ("go", "help"), ("fb", "child"), ("fb", "go")}


def test_innermost_scope_by_brute_force(repo):
    _, _, parsed = repo
    got = {(r.file_path, r.line_no): (r.scope_type, r.scope) for r in sy.scope_lines(parsed).collect()}
    spans = {"/r/pkg/a.py": [(1, 5, "class", "Base"), (2, 3, "function", "run"), (4, 5, "function", "stop"), (7, 8, "function", "helper")], "/r/pkg/b.py": [(5, 11, "class", "Child"), (13, 14, "class", "Other"), (6, 11, "function", "go")]}
    want = {(f, n): max((s, -e, t, name) for s, e, t, name in all_spans if s <= n <= e)[2:] for f, all_spans in spans.items() for n in range(1, 20) if any(s <= n <= e for s, e, *_ in all_spans)}
    assert got == want


def test_call_sites_leave_out_comments_and_literals(repo):
    _, files, _ = repo
    got = {(r.line_no, r.base, r.callee) for r in sy.call_sites(files).where("file_path = '/r/pkg/b.py'").collect()}
    assert got == {(7, "", "Root"), (10, "x", "run"), (11, "", "helper"), (11, "tools", "helper"), (16, "", "Child"), (17, "thing", "go")}


def test_missing_modules_and_coverage(repo):
    elements, files, parsed = repo
    assert [tuple(r) for r in sy.modules_without_files(files, parsed).collect()] == [("r", "gone", 1)]
    assert [tuple(r)[1:4] for r in sy.index_coverage(files, elements).collect()] == [(3, 3, 7)]


def test_empty_tables(spark):
    elements, files, parsed = (spark.createDataFrame([], s) for s in (ELEMENTS, FILES, PARSED))
    for df in (sy.exports(elements), sy.bindings(files, parsed), sy.resolved_inheritance(elements, files, parsed), sy.resolve_calls(elements, files, parsed), sy.call_sites(files), sy.index_coverage(files, elements)):
        assert df.count() == 0
