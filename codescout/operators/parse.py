"""From files to elements: a small parser for each file, and projections of its result."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.functions.text import element_id, line_slice, truncate

_FUNCTION = "name string, start_line int, end_line int, docstring string, parameters array<string>, return_type string, is_async boolean, class_name string, decorators array<string>, complexity int, calls array<string>"
SCHEMA = (
    "repo_name string, path string, relative_path string, language string, content string, total_lines int, module_docstring string, "
    "classes array<struct<name string, start_line int, end_line int, docstring string, bases array<string>, kind string>>, "
    f"functions array<struct<{_FUNCTION}>>, imports array<struct<module string, names array<string>, is_from boolean, line int, level int, alias string>>"
)
_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.BoolOp)


def _python(text: str) -> tuple[str | None, list, list, list]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    classes, functions, imports = [], [], []

    def function(node, owner: str | None) -> None:
        args = node.args
        names = [a.arg for a in (*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else []))]
        calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
        functions.append((node.name, node.lineno, node.end_lineno, ast.get_docstring(node), names, ast.unparse(node.returns) if node.returns else None, isinstance(node, ast.AsyncFunctionDef), owner, [ast.unparse(d) for d in node.decorator_list], 1 + sum(isinstance(n, _BRANCHES) for n in ast.walk(node)), sorted(calls)))

    def body(nodes, owner: str | None = None) -> None:
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(node, owner)
            elif isinstance(node, ast.ClassDef):
                classes.append((node.name, node.lineno, node.end_lineno, ast.get_docstring(node), [ast.unparse(b) for b in node.bases], "class"))
                body(node.body, node.name)
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                body([*node.body, *getattr(node, "orelse", []), *getattr(node, "finalbody", [])], owner)

    body(tree.body)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(a.name, [], False, node.lineno, 0, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append((node.module or "", [a.name for a in node.names], True, node.lineno, node.level, None))
    return ast.get_docstring(tree), classes, functions, imports


_TYPE = re.compile(r"^(?P<indent>[ \t]*)(?:(?:export|default|public|private|protected|abstract|final|static|pub|sealed)[ \t]+)*(?P<kind>class|interface|struct|trait|enum|impl|type)[ \t]+(?P<name>\w+)(?:[ \t]+struct)?(?:[ \t]*(?:extends|implements|for|:)[ \t]*(?P<bases>[\w., \t]+))?[^;\n]*\{", re.M)
_FN = re.compile(r"^(?P<indent>[ \t]*)(?:(?:export|default|public|private|protected|static|final|abstract|async|pub|const|unsafe|inline|extern|function|func|fn|get|set|override|synchronized)\*?[ \t]+)*(?:\([^)\n]*\)[ \t]*)?(?:[\w.<>\[\],*&]+[ \t*&]+)?(?!(?:if|for|while|switch|catch|return|else|match|loop|new|try|do)\b)(?P<name>[\w$]+)[ \t]*(?:<[^>\n]*>)?\((?P<params>[^)\n]*)\)[^;\n=]*\{[ \t]*\r?$", re.M)
_IMPORT = re.compile(r"^[ \t]*(?:import\b[^'\"\n]*?from[ \t]*['\"](?P<a>[^'\"]+)['\"]|import[ \t]+(?:static[ \t]+)?(?P<b>[\w.*]+);|use[ \t]+(?P<c>[^;]+);|#[ \t]*include[ \t]*[<\"](?P<d>[^>\"]+)[>\"]|(?:import[ \t]+)?\"(?P<e>[^\"\n]+)\"$)", re.M)
_QUIET = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,12}'|`(?:[^`\\]|\\.)*`")


def _block_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(rf"{_QUIET.pattern}|[{{}}]").finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


# Words that look like calls and are none, and what counts as a branch.
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "match", "sizeof", "typeof", "new", "func", "function", "fn", "else", "defer", "go", "await", "throw"}
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|loop)\b|&&|\|\||\?(?![.?:])")


def _doc_above(lines: list[str], line: int) -> str | None:
    """The text of the comment that ends directly above a line (from 1), with attributes and annotations between; null if there is none."""
    n = line - 1
    while n and re.match(r"\s*(?:@\w|#!?\[)", lines[n - 1]):
        n -= 1
    if not n:
        return None
    first, above = n, lines[n - 1].strip()
    if above.endswith("*/"):
        while first > 1 and "/*" not in lines[first - 1]:
            first -= 1
        if not lines[first - 1].lstrip().startswith("/*"):
            return None
    elif above.startswith("//"):
        while first > 1 and lines[first - 2].lstrip().startswith("//"):
            first -= 1
    else:
        return None
    bare = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*+|//+!?)\s?|\s*\*+/\s*$", "", x).strip() for x in lines[first - 1 : n]]
    return "\n".join(bare).strip() or None


def _braces(text: str) -> tuple[str | None, list, list, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    classes, functions, spans, lines = [], [], [], text.split("\n")
    for m in _TYPE.finditer(text):
        end = _block_end(text, m.end() - 1)
        bases = [b.strip() for b in (m["bases"] or "").split(",") if b.strip()]
        classes.append((m["name"], line(m.start("name")), line(end - 1), _doc_above(lines, line(m.start("name"))), bases, m["kind"]))
        spans.append((m.start(), end, m["name"]))
    for m in _FN.finditer(text):
        end = _block_end(text, m.end() - 1)
        owner = next((name for low, high, name in reversed(spans) if low < m.start() and end <= high), None)
        body = _QUIET.sub(" ", text[m.end() : end])
        calls = sorted(set(re.findall(r"\b([A-Za-z_]\w*)\s*\(", body)) - _NO_CALLS)
        functions.append((m["name"], line(m.start("name")), line(end - 1), _doc_above(lines, line(m.start("name"))), [p.strip() for p in m["params"].split(",") if p.strip()], None, "async" in m[0].split("(")[0], owner, [], 1 + len(_BRANCH.findall(body)), calls))
    imports = [(next(g for g in m.groups() if g), [], False, line(m.start()), 0, None) for m in _IMPORT.finditer(text)]
    return None, classes, functions, imports


def parse_files(files: DataFrame) -> DataFrame:
    """One row of SCHEMA for each file of (repo_name, path, relative_path, language, content).

    Python is parsed by its own grammar, languages with braces by signatures and blocks. Files that do not
    parse, and languages without a parser, keep their row with empty arrays. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                text = r.content or ""
                try:
                    found = _python(text) if r.language == "python" else _braces(text) if r.language in ("javascript", "typescript", "tsx", "java", "rust", "c", "cpp", "go", "csharp") else (None, [], [], [])
                except (SyntaxError, ValueError, RecursionError):
                    found = (None, [], [], [])
                lines = 0 if not text else text.count("\n") + (not text.endswith("\n"))
                rows.append((*r, lines, *found))
            yield pd.DataFrame(rows, columns=[*batch.columns, "total_lines", "module_docstring", "classes", "functions", "imports"])

    return files.select("repo_name", "path", "relative_path", "language", "content").mapInPandas(run, SCHEMA)


#: What elements are made of.
LEVELS = ("file", "class", "function", "documentation")


def build_elements(parsed: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Element rows (id, type, name, ..., code) of parsed files, on the levels asked for: the file, its classes, its functions and its documentation."""
    base = ["repo_name", F.col("path").alias("file_path"), "relative_path", "language"]
    text = lambda c, n: truncate(line_slice(F.col("content"), F.col(f"{c}.start_line"), F.col(f"{c}.end_line")), n)
    key = lambda kind, *parts: element_id(F.col("repo_name"), F.lit(kind), F.col("relative_path"), *parts).alias("id")
    file = parsed.select(key("file"), F.lit("file").alias("type"), F.col("relative_path").alias("name"), *base, F.lit(1).alias("start_line"), F.col("total_lines").alias("end_line"), truncate(F.col("content"), 4000).alias("code"), F.lit("").alias("signature"), F.coalesce("module_docstring", F.lit("")).alias("docstring"))
    classes = parsed.select("*", F.explode("classes").alias("c"))
    heading = F.concat_ws(" ", "c.kind", "c.name", F.when(F.size("c.bases") > 0, F.concat(F.lit("extends "), F.array_join("c.bases", ", "))))
    klass = classes.select(key("class", F.col("c.name")), F.lit("class").alias("type"), F.col("c.name").alias("name"), *base, "c.start_line", "c.end_line", text("c", 3000).alias("code"), heading.alias("signature"), F.coalesce("c.docstring", F.lit("")).alias("docstring"))
    functions = parsed.select("*", F.explode("functions").alias("f"))
    owner = F.coalesce("f.class_name", F.lit(""))
    call = F.concat(F.when(owner != "", F.concat(owner, F.lit("."))).otherwise(""), F.col("f.name"), F.lit("("), F.array_join("f.parameters", ", "), F.lit(")"), F.when(F.col("f.return_type").isNotNull(), F.concat(F.lit(" -> "), "f.return_type")).otherwise(""))
    function = functions.select(key("function", owner, F.col("f.name")), F.lit("function").alias("type"), F.col("f.name").alias("name"), *base, "f.start_line", "f.end_line", text("f", 2000).alias("code"), call.alias("signature"), F.coalesce("f.docstring", F.lit("")).alias("docstring"))
    told = parsed.where("module_docstring <> ''")
    doc = told.select(key("documentation"), F.lit("documentation").alias("type"), F.col("relative_path").alias("name"), *base, F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("module_docstring").alias("code"), F.lit("").alias("signature"), F.col("module_docstring").alias("docstring"))
    made = [df for level, df in zip(LEVELS, (file, klass, function, doc), strict=True) if level in levels]
    return reduce(DataFrame.unionByName, made)
