"""Filters and text searches over files and elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescout.functions.patterns import glob_match

# Directories that a text search leaves out, besides those that begin with a dot.
SKIPPED = [".git", "node_modules", "__pycache__", "dist", "build", "venv", "coverage", ".claude", ".kilocode", ".agent", ".agents", ".claude-flow"]


def searchable(path: Column) -> Column:
    """Whether no directory of the path is skipped, and no component hidden."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~F.exists(folders, lambda p: p.isin(*SKIPPED))


def grep(files: DataFrame, pattern: str, glob: str | None = None, limit: int | None = 30, literal: bool = False) -> DataFrame:
    """(repo_name, relative_path, matches): files with matches of a pattern without regard to case; the first `limit` by path."""
    expression = f"(?i)\\Q{pattern}\\E" if literal else f"(?i){pattern}"
    kept = files.where(searchable(F.col("relative_path")))
    if glob:
        kept = kept.where(glob_match(F.col("relative_path"), glob))
    counted = kept.select("repo_name", "relative_path", F.regexp_count("content", F.lit(expression)).alias("matches")).where("matches > 0").distinct()
    return counted.orderBy("relative_path", "repo_name").limit(limit) if limit else counted


def grep_lines(files: DataFrame, pattern: str, per_file: int = 20) -> DataFrame:
    """(relative_path, repo_name, line_no, line): up to `per_file` matching lines of each file; the whole line is searched, its first 200 characters are shown."""
    lines = files.select("repo_name", "relative_path", F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda s: s["line"].rlike(f"(?i){pattern}")).alias("found"))
    return lines.where(F.size("found") > 0).select("repo_name", "relative_path", F.explode(F.slice("found", 1, per_file)).alias("f")).select("repo_name", "relative_path", "f.line_no", F.substring("f.line", 1, 200).alias("line")).distinct()


def list_directory(files: DataFrame, directory: str) -> DataFrame:
    """(repo_name, name, kind, n_files): what lies directly in a directory of each repository; hidden names are left out."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    below = files.select("repo_name", "relative_path").where(F.col("relative_path").startswith(prefix)).distinct()
    rest = F.substring(F.col("relative_path"), len(prefix) + 1, 1 << 20)
    split = below.select("repo_name", F.split(rest, "/").alias("p"))
    named = split.select("repo_name", F.col("p")[0].alias("name"), F.when(F.size("p") > 1, "directory").otherwise("file").alias("kind")).where(~F.col("name").startswith("."))
    return named.groupBy("repo_name", "name", "kind").agg(F.count(F.lit(1)).alias("n_files"))


def list_files(files: DataFrame, part: str) -> DataFrame:
    return files.where(F.lower("relative_path").contains(part.lower())).select("repo_name", "relative_path").distinct()


def matching_paths(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(relative_path, wanted_path): distinct paths that equal a wanted path, end in it, or are its end.

    paths: (relative_path), wanted: (path). All pairs are found without comparing all: the ends of a path that are
    as long as some path of the other side (a few hundred lengths at most) meet that side in an equi-join.
    Null paths match nothing; an empty path is the end of every path.
    """
    mine = paths.select(F.col("relative_path").alias("p")).where("p is not null").distinct()
    asked = wanted.select(F.col("path").alias("w")).where("w is not null").distinct()

    def ends(df: DataFrame, text: str, other: DataFrame, other_text: str) -> DataFrame:
        lengths = F.broadcast(other.agg(F.collect_set(F.length(other_text)).alias("lengths")))  # one row
        longer = F.filter("lengths", lambda n: n <= F.length(text))
        return df.crossJoin(lengths).select(text, F.explode(longer).alias("n")).select(text, F.when(F.col("n") == 0, "").otherwise(F.expr(f"right({text}, n)")).alias("end"))

    mine_ends = ends(mine, "p", asked, "w").join(asked, F.col("end") == F.col("w")).select("p", "w")
    asked_ends = ends(asked, "w", mine, "p").join(mine, F.col("end") == F.col("p")).select("p", "w")
    return mine_ends.unionByName(asked_ends).distinct().select(F.col("p").alias("relative_path"), F.col("w").alias("wanted_path"))


def elements_of_file(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements with each wanted path (path) that equals theirs, ends in it, or is its end; see matching_paths()."""
    return elements.join(matching_paths(elements, wanted), "relative_path")


def browse(elements: DataFrame, path: str) -> DataFrame:
    """The file elements whose path equals or ends in the path, with their code."""
    return elements.where((F.col("type") == "file") & F.col("relative_path").endswith(path))


def elements_with_matches(elements: DataFrame, files: DataFrame, pattern: str, glob: str | None = None, limit: int | None = 30) -> DataFrame:
    """The elements of the files in which a pattern is found (see grep()); other repositories' files of that path count as well."""
    found = grep(files, pattern, glob, limit).select(F.col("relative_path").alias("path")).distinct()
    return elements_of_file(elements, found).drop("wanted_path").distinct()


# Marks before which a backslash makes a search term a pattern.
PATTERN_MARKS = [".", "*", "+", "?", "[", "]", "^", "$", "|", "(", ")", "{", "}"]


def is_pattern(term: Column) -> Column:
    """Whether a search term is read as a regular expression: it has a mark of one with a backslash before it."""
    return reduce(lambda c, m: c | term.contains("\\" + m), PATTERN_MARKS, F.lit(False))


def file_rows(elements: DataFrame, candidates: DataFrame, score: float = 0.8) -> DataFrame:
    """The file elements of candidates (repo_name, relative_path) with the score and source of what tools find; each once."""
    wanted = candidates.select("repo_name", "relative_path").distinct()
    found = elements.where("type = 'file'").join(wanted, ["repo_name", "relative_path"], "left_semi")
    return found.withColumn("total_score", F.lit(score)).withColumn("found_by", F.lit("agent"))


def first_file_rows(elements: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """The file elements of the first `most` candidates by path, where nothing was chosen among them."""
    return file_rows(elements, candidates.select("repo_name", "relative_path").distinct().orderBy("relative_path", "repo_name").limit(most))


def skim(elements: DataFrame, path: str) -> DataFrame:
    """Classes and functions of a file without their code."""
    return elements.where(F.col("type").isin("class", "function") & F.col("relative_path").endswith(path)).withColumn("code", F.lit(""))


def keep_files(elements: DataFrame, keep: list[str]) -> DataFrame:
    """Elements whose path, or repository and path, or path:name, is named, or whose path ends in what is named; all of them if none survives."""
    if not keep:
        return elements
    names = [k.partition(":") for k in keep]
    hit = F.lit(False)
    for path, colon, name in names:
        one = (F.col("relative_path") == path) | (F.concat_ws("/", "repo_name", "relative_path") == path) | F.col("relative_path").endswith("/" + path)
        hit = hit | (one & (F.col("name") == name) if colon else one)
    kept = elements.where(hit)
    return elements if kept.isEmpty() else kept


def keyword_lines(files: DataFrame, pattern: str) -> DataFrame:
    """Outline rows (repo_name, relative_path, line_no, line) of the first 100 lines of each file that match."""
    return grep_lines(files, pattern, 100).where("line_no <= 100")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
