"""Overviews of repositories and files: key files, readme, kind of project, trees, outlines, sources of an answer.

Repeated rows count once; null paths have no row. A repository's overview keeps only counts and bounded lists, so one
repository with a third of all files is pre-aggregated like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.functions.patterns import basename
from codescout.functions.text import extension
from codescout.operators.search import rank_within, searchable

#: Parts of the names of files that tell how a repository is built or started.
KEY_NAMES = ["main", "index", "app", "init", "config", "setup", "package.json", "requirements.txt", "go.mod", "cargo.toml", "dockerfile", "makefile", "cmakelists.txt"]
#: Directories that a tree leaves out, besides those that begin with a dot.
TREE_SKIPS = ["__pycache__", "node_modules", "venv", "dist", "build", "coverage", "target", "bin", "obj", "out"]
README = r"(?i)^readme(?:\.(?:md|rst|txt))?$"
OUTLINE = r"^[ \t]*(?:export[ \t]+)?(?:(class)[ \t]+(\w+)|(async[ \t]+)?(?:def|function)[ \t]+(\w+))"
IMPORT = r"^[ \t]*((?:import|from|use|#include)[ \t]+[^\r]*)"
INCLUDE = r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"]+)[>\"]"
USE = r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;{\r]+)"


def _paths(files: DataFrame) -> DataFrame:
    return files.where("relative_path is not null").select("repo_name", "relative_path").distinct()


def is_key_file(path: Column) -> Column:
    name = F.lower(basename(path))
    hit = F.lit(False)
    for part in KEY_NAMES:
        hit = hit | name.contains(part)
    return hit


def key_files(files: DataFrame) -> DataFrame:
    """(repo_name, relative_path): files whose name holds one of the key names."""
    return _paths(files).where(is_key_file(F.col("relative_path")))


def files_by_extension(files: DataFrame) -> DataFrame:
    """(repo_name, extension, n): by repository and extension, by repository (extension null) and over all (both null).

    One pass over the paths with grouping sets.
    """
    return _paths(files).select("repo_name", extension(F.col("relative_path")).alias("extension")).rollup("repo_name", "extension").agg(F.count(F.lit(1)).alias("n"))


def readmes(files: DataFrame) -> DataFrame:
    """(repo_name, relative_path): the readme of each repository that has one: the least deep, then the first by name."""
    named = _paths(files).where(basename(F.col("relative_path")).rlike(README))
    rank = F.struct(F.size(F.split("relative_path", "/")), F.lower("relative_path"), F.col("relative_path"))
    return named.groupBy("repo_name").agg(F.min_by("relative_path", rank).alias("relative_path"))


def project_kinds(files: DataFrame) -> DataFrame:
    """(repo_name, kind): what the files at hand make of a repository; the first rule that holds decides."""
    name = F.lower(basename(F.col("relative_path")))
    seen = _paths(files).groupBy("repo_name").agg(
        F.max(name.contains("package.json")).alias("node"),
        F.max(name.contains("requirements.txt") | name.contains("setup.py")).alias("python"),
        F.max(extension(F.col("relative_path")) == "tsx").alias("tsx"),
        F.max((extension(F.col("relative_path")) == "java") | name.contains("android")).alias("java"),
        F.max(name.contains("dockerfile")).alias("docker"),
    )
    kind = (
        F.when(F.col("node") & F.col("tsx"), "React web application")
        .when(F.col("node"), "Node.js application")
        .when(F.col("python"), "Python application")
        .when(F.col("java"), "Android application")
        .when(F.col("docker"), "containerized application")
        .otherwise("software project")
    )
    return seen.select("repo_name", kind.alias("kind"))


def tree_lines(files: DataFrame, depth: int = 5) -> DataFrame:
    """(repo_name, dir, depth, line): the directory tree, one indented line for each directory; order by repo_name and dir to print it.

    Skipped and hidden directories are left out with all below them.
    """
    parts = F.split("relative_path", "/")
    above = _paths(files).select("repo_name", F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))).alias("p")).where(F.size("p") > 0).distinct()
    each = above.select("repo_name", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    dirs = each.select("repo_name", F.slice("p", F.lit(1), F.col("depth")).alias("d"), "depth").distinct()
    kept = dirs.where(~F.exists("d", lambda x: x.isin(*TREE_SKIPS) | x.startswith(".")))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at("d", -1), F.lit("/"))
    return kept.select("repo_name", F.array_join("d", "/").alias("dir"), "depth", line.alias("line"))


def largest_directories(files: DataFrame, k: int = 15) -> DataFrame:
    """(repo_name, dir, n): the k directories of each repository with the most files directly in them; ties by name.

    The counts are added up before they are ranked, and Spark cuts each partition to k rows before the shuffle.
    """
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    n = _paths(files).select("repo_name", folder.alias("dir")).groupBy("repo_name", "dir").agg(F.count(F.lit(1)).alias("n"))
    return rank_within(n, ["repo_name"], [F.desc("n"), F.asc("dir")], k).select("repo_name", "dir", "n")


def _lines(files: DataFrame, most: int | None = None) -> DataFrame:
    rows = files.where("content is not null and path is not null").select("path", F.split("content", "\n").alias("l"))
    rows = rows.select("path", F.slice("l", 1, most).alias("l")) if most else rows
    return rows.select("path", F.posexplode("l").alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def outline(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, line_no, kind, name, is_async): classes, functions and imports in all lines, or the first `most`, by the look of the line."""
    lines = _lines(files, most).where(F.col("line").rlike(OUTLINE) | F.col("line").rlike(IMPORT))
    part = lambda i: F.regexp_extract("line", OUTLINE, i)
    kind = F.when(part(1) != "", "class").when(part(4) != "", "function").otherwise("import")
    name = F.when(part(1) != "", part(2)).when(part(4) != "", part(4)).otherwise(F.trim(F.regexp_extract("line", IMPORT, 1)))
    return lines.select("path", "line_no", kind.alias("kind"), name.alias("name"), (part(3) != "").alias("is_async")).distinct()


def includes(files: DataFrame) -> DataFrame:
    """(path, line_no, module, kind): `#include` of C and `use` of Rust as imports."""
    lang = extension(F.col("path"))
    lines = _lines(files.where(lang.isin("c", "h", "cc", "cpp", "hpp", "cxx", "rs")))
    is_rust = extension(F.col("path")) == "rs"
    module = F.when(is_rust, F.trim(F.regexp_extract("line", USE, 1))).otherwise(F.regexp_extract("line", INCLUDE, 1))
    return lines.select("path", "line_no", module.alias("module"), F.when(is_rust, "use").otherwise("include").alias("kind")).where("module <> ''").distinct()


def grep_any(files: DataFrame, words: list[str]) -> DataFrame:
    """(repo_name, relative_path, match_type, matches): files that hold any of the words, in the content, the path or both; case does not matter."""
    pattern = "(?i)" + "|".join(f"\\Q{w}\\E" for w in words)
    kept = files.where("relative_path is not null").where(searchable(F.col("relative_path")))
    hits = kept.select("repo_name", "relative_path", F.coalesce(F.regexp_count("content", F.lit(pattern)), F.lit(0)).alias("matches"), basename(F.col("relative_path")).rlike(pattern).alias("named"))
    kind = F.when((F.col("matches") > 0) & F.col("named"), "both").when(F.col("named"), "filename").otherwise("content")
    return hits.where("matches > 0 or named").select("repo_name", "relative_path", kind.alias("match_type"), "matches").distinct()


def answer_sources(elements: DataFrame) -> DataFrame:
    """(id, source): how an answer names an element, `[type] name (path:La-b)`; missing parts are left empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = F.concat(F.lit("["), text("type"), F.lit("] "), text("name"), F.lit(" ("), text("relative_path"), F.lit(":L"), text("start_line"), F.lit("-"), text("end_line"), F.lit(")"))
    return elements.select("id", source.alias("source")).distinct()


def strip_repository(path: Column, repo_name: Column) -> Column:
    """The part of a path below the component that equals the repository's name (case does not matter); else the path as it is."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p: F.lower(p)), F.lower(repo_name))
    return F.when(at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "/")).otherwise(path)


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: _step(a, p), lambda a: a["low"])
    return path.isNotNull() & ~path.startswith("/") & ~path.rlike("^[A-Za-z]:") & (depth >= 0)


def _step(state: Column, part: Column) -> Column:
    d = state["d"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
    return F.struct(d.alias("d"), F.least(state["low"], d).alias("low"))
