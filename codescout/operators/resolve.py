"""Joins that resolve names: imports to files, base classes to classes, calls to functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.functions.text import module_path


def imports_of(parsed: DataFrame) -> DataFrame:
    """(file_path, module, names, is_from, level, line), one row for each distinct import."""
    each = parsed.select("file_path", F.explode("imports").alias("i"))
    return each.select("file_path", "i.module", "i.names", "i.is_from", "i.level", "i.line").distinct()


def bases_of(parsed: DataFrame) -> DataFrame:
    """(file_path, class_name, base)."""
    each = parsed.select("file_path", F.explode("classes").alias("c"))
    return each.select("file_path", F.col("c.name").alias("class_name"), F.explode("c.bases").alias("base")).distinct()


def calls_of(parsed: DataFrame) -> DataFrame:
    """(file_path, caller, class_name, callee)."""
    each = parsed.select("file_path", F.explode("functions").alias("f"))
    return each.select("file_path", F.col("f.name").alias("caller"), F.col("f.class_name").alias("class_name"), F.explode("f.calls").alias("callee")).distinct()


def last_definition(elements: DataFrame, kind: str) -> DataFrame:
    """(name, id): the definition that wins a name, the largest id."""
    return elements.where(F.col("type") == kind).groupBy("name").agg(F.max("id").alias("id"))


def inheritance_edges(elements: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst): class to base class by name; self-loops and unknown bases are dropped."""
    classes = elements.where("type = 'class'").select("file_path", F.col("name").alias("class_name"), F.col("id").alias("src"))
    named = bases_of(parsed).join(classes, ["file_path", "class_name"])
    target = last_definition(elements, "class").select(F.col("name").alias("base"), F.col("id").alias("dst"))
    return named.join(target, "base").where("src <> dst").select("src", "dst").distinct()


def call_edges(elements: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst): function to the function that it calls; a definition of the same file comes before any other."""
    functions = elements.where("type = 'function'").select("file_path", "name", "id")
    callers = functions.select("file_path", F.col("name").alias("caller"), F.col("id").alias("src"))
    calls = calls_of(parsed).join(callers, ["file_path", "caller"]).select("file_path", "src", "callee").distinct()
    near = functions.groupBy("file_path", F.col("name").alias("callee")).agg(F.max("id").alias("near"))
    far = last_definition(elements, "function").select(F.col("name").alias("callee"), F.col("id").alias("far"))
    found = calls.join(near, ["file_path", "callee"], "left").join(far, "callee", "left")
    return found.select("src", F.coalesce("near", "far").alias("dst")).where("dst is not null and src <> dst").distinct()


def module_files(files: DataFrame) -> DataFrame:
    """(repo_name, target, dst): the first file (by path) of each dotted module of a repository."""
    modules = files.select("repo_name", F.col("path").alias("dst"), module_path(F.col("relative_path")).alias("target")).where("target is not null")
    return modules.groupBy("repo_name", "target").agg(F.min("dst").alias("dst"))


def import_targets(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(repo_name, src, target, module, names, alias, is_from): imports with their absolute module; relative ones climb `level` packages."""
    paths = files.select("repo_name", F.col("path").alias("src"), "relative_path").distinct()
    each = parsed.select(F.col("file_path").alias("src"), F.explode("imports").alias("i")).select("src", "i.module", "i.names", "i.alias", "i.is_from", "i.level").distinct()
    asked = each.where("module is not null").join(paths, "src")
    folder = F.split(F.regexp_replace("relative_path", "/?[^/]*$", ""), "/")
    up = F.coalesce("level", F.lit(0))
    package = F.filter(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - up + 1, F.lit(0))), lambda p: p != "")
    bare = F.regexp_replace("module", r"^\.+", "")
    target = F.when(up > 0, F.array_join(F.concat(package, F.filter(F.array(bare), lambda m: m != "")), ".")).otherwise(F.col("module"))
    return asked.select("repo_name", "src", target.alias("target"), "module", "names", "alias", "is_from")


def import_edges(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst) paths: Python imports to files of the same repository by their absolute module.

    files: (repo_name, path, relative_path). Imports of modules without a file have no edge.
    """
    found = import_targets(files, parsed).join(module_files(files), ["repo_name", "target"])
    return found.where("src <> dst").select("src", "dst").distinct()


def loose_import_edges(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst) paths: an import to the first file (by path) of its repository whose name is the module's last part, in any language.

    The fallback where no module path fits. The equi-join on repository and name forms no other pairs.
    """
    paths = files.select("repo_name", "path").distinct()
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    named = paths.select("repo_name", stem.alias("stem"), "path").groupBy("repo_name", "stem").agg(F.min("path").alias("dst"))
    asked = imports_of(parsed).where("module is not null").select("file_path", F.regexp_extract(F.regexp_replace("module", r"\.\w+$", ""), r"[^./\\:]*$", 0).alias("a"), F.regexp_extract("module", r"[^./\\:]*$", 0).alias("b"))
    asked = asked.select("file_path", F.explode(F.array_distinct(F.array("a", "b"))).alias("stem")).where("stem <> ''").distinct()
    found = asked.join(paths.select("repo_name", F.col("path").alias("file_path")), "file_path").join(named, ["repo_name", "stem"])
    return found.where("file_path <> dst").select(F.col("file_path").alias("src"), "dst").distinct()


def fuzzy_names(names: DataFrame, wanted: str, threshold: float = 0.5) -> DataFrame:
    """(name, tier, score): exact (1), contained either way (2) or with enough shared words (3), without regard to case."""
    low, want = F.lower("name"), wanted.lower()
    words = F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != ""))
    import re

    other = F.array(*(F.lit(w) for w in dict.fromkeys(w for w in re.split("[^a-z0-9]+", want) if w)))
    score = F.size(F.array_intersect(words, other)) / F.greatest(F.size(F.array_union(words, other)), F.lit(1))
    tier = F.when(low == want, 1).when(low.contains(want) | F.instr(F.lit(want), low).cast("boolean"), 2).when(score >= threshold, 3)
    return names.select("name", tier.alias("tier"), F.round(score, 6).alias("score")).where("tier is not null")


def definitions(parsed: DataFrame) -> DataFrame:
    """(definition_id, file_path, kind, parent, name, start_line, end_line): classes, functions and methods of the files.

    definition_id is path::parent::name, without the parent for what stands alone. Repeated rows count once; rows without a name are left out.
    """
    part = lambda x, kind, parent: F.struct(F.lit(kind).alias("kind"), parent.alias("parent"), x["name"].alias("name"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))
    classes = F.transform(F.coalesce("classes", F.array()), lambda c: part(c, "class", F.lit("")))
    functions = F.transform(F.coalesce("functions", F.array()), lambda f: part(f, "function", F.coalesce(f["class_name"], F.lit(""))))
    each = parsed.select("file_path", F.explode(F.concat(classes, functions)).alias("d")).select("file_path", "d.*")
    key = F.concat_ws("::", "file_path", F.nullif("parent", F.lit("")), "name").alias("definition_id")
    return each.where("file_path is not null and name is not null").select(key, "file_path", "kind", "parent", "name", "start_line", "end_line").distinct()


def import_names(parsed: DataFrame) -> DataFrame:
    """(file_path, line, module, name, level, wildcard): a row for each imported name; an import of a whole module has one with a null name."""
    each = parsed.select("file_path", F.explode("imports").alias("i")).select("file_path", "i.line", "i.module", F.explode_outer("i.names").alias("name"), F.coalesce("i.level", F.lit(0)).alias("level"))
    return each.withColumn("wildcard", F.coalesce(F.col("name") == "*", F.lit(False))).distinct()
