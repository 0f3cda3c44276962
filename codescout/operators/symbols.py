"""Symbols across files: what a name in a file is bound to, who calls whom, and which call belongs to which scope.

Every step is an equi-join on a file and a name or line, so no step pairs all rows of a file or repository.
Null names and paths join nothing. A symbol defined twice in one file is the one with the largest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.operators.resolve import bases_of, import_targets, module_files

#: Words before a parenthesis that call nothing of the program.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "match", "elif", "and", "or", "not", "in", "super", "print", "len", "range", "str", "int", "list", "dict", "set", "isinstance", "sorted", "make", "append", "panic", "sizeof", "require"]
#: Names by which a method calls its own object.
OWN = ["self", "cls", "this"]
CALL = r"(?:(?:def|class|function|func|fn|new)[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*\("
DEFINES = r"^(?:def|class|function|func|fn)[ \t]"
QUOTED = r"\"[^\"]*\"|'[^']*'"
COMMENT = r"^[ \t]*(?:#|//|/?\*)[\s\S]*"
MADE = r"^[ \t]*(?:(?:const|let|var)[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)[ \t]*:?=[ \t]*(?:new[ \t]+|&)?([A-Z][A-Za-z0-9_]*)[({]"


def exports(elements: DataFrame) -> DataFrame:
    """(file_path, symbol, id): classes and functions by name, methods as Class.method."""
    owner = F.nullif(F.col("metadata")["class_name"], F.lit(""))
    symbol = F.when(F.col("type") == "function", F.concat_ws(".", owner, F.col("name"))).otherwise(F.col("name"))
    named = elements.where("type in ('class', 'function') and name is not null").select("file_path", symbol.alias("symbol"), "id")
    return named.groupBy("file_path", "symbol").agg(F.max("id").alias("id"))


def bindings(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(file_path, bound, target_path, symbol): the local names that imports bind; symbol is null where a whole module is bound.

    Only imports of files of the same repository bind a name.
    """
    found = import_targets(files, parsed).join(module_files(files), ["repo_name", "target"]).where("src <> dst")
    alias = F.nullif("alias", F.lit(""))
    names = F.transform(F.coalesce("names", F.array()), lambda n: F.struct(n.alias("bound"), n.alias("symbol")))
    renamed = F.array(F.struct(alias.alias("bound"), F.try_element_at("names", F.lit(1)).alias("symbol")))
    whole = F.array(F.struct(F.coalesce(alias, F.col("module")).alias("bound"), F.lit(None).cast("string").alias("symbol")))
    made = F.when(~F.coalesce("is_from", F.lit(False)), whole).when(alias.isNotNull(), F.concat(names, renamed)).otherwise(names)
    each = found.select(F.col("src").alias("file_path"), F.col("dst").alias("target_path"), F.explode(made).alias("b"))
    return each.select("file_path", "b.bound", "target_path", "b.symbol").where("bound is not null").distinct()


def resolve_symbols(refs: DataFrame, bound: DataFrame, exported: DataFrame) -> DataFrame:
    """(file_path, ref, id, how) for refs (file_path, ref): local first, then imported names, members of imported names, members of modules.

    refs that nothing defines have no row; repeated refs give one. The least id breaks ties within the first way that finds any.
    """
    asked = refs.select("file_path", "ref").where("file_path is not null and ref <> ''").distinct()
    dotted = F.col("ref").contains(".")
    key = lambda way, name, rest: F.struct(F.lit(way).alias("way"), name.alias("bound"), rest.alias("rest"))
    head, tail = F.substring_index("ref", ".", 1), F.regexp_replace("ref", r"^[^.]*\.", "")
    front, last = F.regexp_replace("ref", r"\.[^.]*$", ""), F.substring_index("ref", ".", -1)
    none = F.lit(None).cast("string")
    keys = F.when(dotted, F.array(key(1, F.col("ref"), none), key(2, head, tail), key(3, front, last))).otherwise(F.array(key(1, F.col("ref"), none)))
    ways = asked.select("file_path", "ref", F.explode(keys).alias("k")).select("file_path", "ref", "k.*")
    fits = ((F.col("way") == 3) & F.col("symbol").isNull()) | ((F.col("way") < 3) & F.col("symbol").isNotNull())
    away = ways.join(bound, ["file_path", "bound"]).where(fits).select("file_path", "ref", "way", F.col("target_path").alias("at"), F.concat_ws(".", "symbol", "rest").alias("symbol"))
    here = asked.select("file_path", "ref", F.lit(0).alias("way"), F.col("file_path").alias("at"), F.col("ref").alias("symbol"))
    found = here.unionByName(away).join(exported.withColumnRenamed("file_path", "at"), ["at", "symbol"])
    best = found.groupBy("file_path", "ref").agg(F.min(F.struct("way", "id")).alias("b"))
    how = F.element_at(F.array(*(F.lit(x) for x in ("local", "imported", "member", "module"))), F.col("b.way") + 1)
    return best.select("file_path", "ref", "b.id", how.alias("how"))


def resolved_inheritance(elements: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst, how): class to base by resolved symbols; else the first class of that name in the same repository."""
    classes = elements.where("type = 'class'").select("repo_name", "file_path", "name", "id")
    sources = classes.select("repo_name", "file_path", F.col("name").alias("class_name"), F.col("id").alias("src"))
    asked = bases_of(parsed).join(sources, ["file_path", "class_name"]).select("repo_name", "file_path", "src", F.col("base").alias("ref"))
    known = resolve_symbols(asked, bindings(files, parsed), exports(elements)).withColumnRenamed("id", "near")
    same_repo = classes.groupBy("repo_name", F.col("name").alias("ref")).agg(F.min("id").alias("far"))
    found = asked.join(known, ["file_path", "ref"], "left").join(same_repo, ["repo_name", "ref"], "left")
    edges = found.select("src", F.coalesce("near", "far").alias("dst"), F.when(F.col("near").isNull(), "repository").otherwise(F.col("how")).alias("how"))
    return edges.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("how").alias("how"))


def _spans() -> Column:
    """The functions and classes of a parsed file as (s, e, t, n, c): lines, type, name and class."""
    func = F.transform(F.coalesce("functions", F.array()), lambda f: F.struct(f["start_line"].alias("s"), f["end_line"].alias("e"), F.lit("function").alias("t"), f["name"].alias("n"), F.nullif(f["class_name"], F.lit("")).alias("c")))
    klass = F.transform(F.coalesce("classes", F.array()), lambda c: F.struct(c["start_line"].alias("s"), c["end_line"].alias("e"), F.lit("class").alias("t"), c["name"].alias("n"), c["name"].alias("c")))
    return F.filter(F.concat(func, klass), lambda x: x["s"] <= x["e"])


def with_scopes(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """rows (file_path, line_no, ...) with scope_type, scope and class_name of the innermost function or class around the line; null where there is none.

    A file's scopes come as one array, in which each of its rows looks; nothing is made for the lines of the scopes.
    """
    spans = parsed.where("file_path is not null").groupBy("file_path").agg(F.array_distinct(F.flatten(F.collect_set(_spans()))).alias("__spans"))
    around = F.filter("__spans", lambda x: (x["s"] <= F.col("line_no")) & (F.col("line_no") <= x["e"]))
    inner = F.array_max(F.transform(around, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["t"].alias("t"), x["n"].alias("n"), x["c"].alias("c")))).alias("__b")
    found = rows.join(spans, "file_path", "left").select(*rows.columns, inner)
    return found.select(*rows.columns, F.col("__b.t").alias("scope_type"), F.col("__b.n").alias("scope"), F.col("__b.c").alias("class_name"))


def scope_lines(parsed: DataFrame) -> DataFrame:
    """(file_path, line_no, scope_type, scope, class_name): the innermost function or class around each line that has one.

    Each scope gives one row a line, so the work is the length of the scopes and not scopes times calls.
    """
    spans = parsed.select("file_path", F.explode(_spans()).alias("x")).distinct()
    lines = spans.select("file_path", "x", F.explode(F.sequence("x.s", "x.e")).alias("line_no"))
    inner = lines.groupBy("file_path", "line_no").agg(F.max(F.struct("x.s", (-F.col("x.e")).alias("e"), "x.t", "x.n", "x.c")).alias("b"))
    return inner.select("file_path", "line_no", F.col("b.t").alias("scope_type"), F.col("b.n").alias("scope"), F.col("b.c").alias("class_name"))


def _code_lines(files: DataFrame, mark: str) -> DataFrame:
    """(file_path, line_no, line) of the lines that hold `mark`, without the text of literals and lines of comments.

    Contents are read where they lie and never shuffled; repeated files give the same rows again.
    """
    lines = files.where("path is not null and content is not null").select(F.col("path").alias("file_path"), F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).where(F.col("line").contains(mark))
    return lines.select("file_path", (F.col("at") + 1).alias("line_no"), F.regexp_replace(F.regexp_replace("line", QUOTED, '""'), COMMENT, "").alias("line"))


def call_sites(files: DataFrame) -> DataFrame:
    """(file_path, line_no, base, callee, call_type): each distinct call of a line; base is empty for simple calls.

    Read line by line: calls within literals and comment lines are left out, words of the language and built-in names too.
    """
    each = _code_lines(files, "(").select("file_path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(0))).alias("c")).where(~F.col("c").rlike(DEFINES))
    name = F.regexp_replace(F.regexp_replace("c", r"^new[ \t]+", ""), r"\($", "")
    callee, base = F.substring_index(name, ".", -1), F.regexp_replace(F.regexp_replace(name, r"[^.]*$", ""), r"\.$", "")
    out = each.select("file_path", "line_no", base.alias("base"), callee.alias("callee")).where((F.col("callee") != "") & ~F.col("callee").isin(*NOT_CALLS))
    return out.withColumn("call_type", F.when(F.col("base") == "", "simple").otherwise("attribute")).distinct()


def instance_types(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(file_path, scope, variable, class_name): variables made by calling a class (`x = C()`, `self.x = C()`, `x = new C()`, `x := &C{`).

    scope is empty outside functions. A variable made in several ways in one scope has the first class by name.
    """
    made = F.regexp_extract("line", MADE, 2)
    found = _code_lines(files, "=").select("file_path", "line_no", F.regexp_extract("line", MADE, 1).alias("variable"), made.alias("made")).where("made <> ''")
    placed = with_scopes(found, parsed)
    scope = F.when(F.col("scope_type") == "function", F.col("scope")).otherwise("")
    return placed.groupBy("file_path", scope.alias("scope"), "variable").agg(F.min("made").alias("class_name"))


def _owned(base: Column) -> Column:
    return base.isin(*OWN)


def resolve_calls(elements: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst, how): caller element to called element.

    The caller is the innermost function or class of that name, else the file's element. A call is looked up, in this
    order, as a method of the own class, of the class that the variable was made from (in the scope, then in the file),
    or as a symbol: local, imported, member of a module.
    """
    placed = with_scopes(call_sites(files), parsed)
    scope = F.when(F.col("scope_type") == "function", F.col("scope")).otherwise("")
    calls = placed.select("file_path", F.coalesce("scope_type", F.lit("file")).alias("caller_type"), F.col("scope").alias("caller"), scope.alias("scope"), F.col("class_name").alias("own"), "base", "callee").distinct()
    types = instance_types(files, parsed)
    near = types.select("file_path", "scope", F.col("variable").alias("base"), F.col("class_name").alias("near"))
    anywhere = types.groupBy("file_path", F.col("variable").alias("base")).agg(F.min("class_name").alias("wide"))
    typed = calls.join(near, ["file_path", "scope", "base"], "left").join(anywhere, ["file_path", "base"], "left")
    known = F.coalesce("near", "wide")
    ref = (
        F.when(F.col("base") == "", F.col("callee"))
        .when(_owned(F.col("base")), F.concat_ws(".", "own", "callee"))
        .when(known.isNotNull(), F.concat_ws(".", known, F.col("callee")))
        .otherwise(F.concat_ws(".", "base", "callee"))
    )
    asked = typed.select("file_path", "caller_type", "caller", ref.alias("ref")).distinct()
    found = asked.join(resolve_symbols(asked, bindings(files, parsed), exports(elements)), ["file_path", "ref"]).withColumnRenamed("id", "dst")
    within = elements.where("type in ('class', 'function')").groupBy("file_path", F.col("type").alias("caller_type"), F.col("name").alias("caller")).agg(F.max("id").alias("inner"))
    outer = elements.where("type = 'file'").groupBy("file_path").agg(F.max("id").alias("outer"))
    ends = found.join(within, ["file_path", "caller_type", "caller"], "left").join(outer, "file_path", "left")
    edges = ends.select(F.coalesce("inner", "outer").alias("src"), "dst", "how").where("src is not null and src <> dst")
    return edges.groupBy("src", "dst").agg(F.min("how").alias("how"))


def modules_without_files(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(repo_name, target, n_files): Python modules that imports name and no file of the repository defines."""
    asked = import_targets(files, parsed).select("repo_name", "target", "src").where((F.col("target") != "") & F.col("src").rlike(r"(?i)\.pyx?$"))
    return asked.join(module_files(files), ["repo_name", "target"], "left_anti").groupBy("repo_name", "target").agg(F.count_distinct("src").alias("n_files"))


def index_coverage(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(repo_name, n_files, n_modules, n_symbols, coverage): how much of each repository the symbol tables cover."""
    paths = files.where("path is not null").select("repo_name", F.col("path").alias("file_path")).distinct()
    modules = module_files(files).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_modules"))
    symbols = exports(elements).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    per_repo = paths.join(symbols, "file_path", "left").groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_files"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_symbols"))
    out = per_repo.join(modules, "repo_name", "left")
    return out.select("repo_name", "n_files", F.coalesce("n_modules", F.lit(0)).alias("n_modules"), "n_symbols", F.round(F.col("covered") / F.col("n_files"), 6).alias("coverage"))
