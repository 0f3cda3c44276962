"""Reading repositories from a file system, and the Parquet store of the derived tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescout.functions.patterns import basename, glob_regex, ignored
from codescout.functions.text import language

MAX_BYTES = 5 * 1024 * 1024
#: Directories and names of files that are left out at any depth.
SKIPPED_DIRS = (".git", "node_modules", "__pycache__", "dist", "build")
SKIPPED_NAMES = ("*.pyc", "*.min.js", "*.bundle.js", "*.lock")


def load_repository(spark: SparkSession, root: str, repo_name: str | None = None, ignore_rules: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo_name, path, relative_path, language, size, content) of the files of a repository.

    Files are kept whose extension is known, that are not larger than max_bytes, not empty, and that neither
    the fixed lists nor the ignore rules leave out (those of the root's .gitignore unless given). Names and
    sizes are tested before any content is read: the filters reach the scan. Text that is not UTF-8 is read
    as Latin-1.
    """
    root = root.rstrip("/")
    if ignore_rules is None:
        # Spark leaves out hidden files; rules of a remote repository are given by the caller.
        rules = Path(root.removeprefix("file:")) / ".gitignore"
        ignore_rules = rules.read_text(errors="replace").splitlines() if rules.is_file() else []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    plain = F.regexp_replace("path", "^file:/*", "/")
    start = len("/" + root.removeprefix("file:").lstrip("/")) + 2 if "://" not in root else len(root) + 2
    files = files.withColumn("relative_path", F.substring(plain if "://" not in root else F.col("path"), start, 1 << 20)).withColumn("language", language(F.col("relative_path")))
    parts = F.split("relative_path", "/")
    skip = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*SKIPPED_DIRS))
    name = basename(F.col("relative_path"))
    for glob in SKIPPED_NAMES:
        skip = skip | name.rlike(glob_regex(glob))
    kept = files.where(F.col("language").isNotNull() & ~skip & ~ignored(F.col("relative_path"), ignore_rules))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    out = kept.select(F.lit(repo_name or root.rpartition("/")[2]).alias("repo_name"), plain.alias("path"), "relative_path", "language", F.col("length").alias("size"), text.alias("content"))
    return out.where(F.col("content") != "")


def save(table: DataFrame, store: str, name: str) -> None:
    """Write a derived table, replacing only the repositories that it holds."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(f"{store}/{name}")


def load(spark: SparkSession, store: str, name: str, repos: Sequence[str] | None = None) -> DataFrame:
    """Read a table of the store; a list of repositories prunes partitions."""
    table = spark.read.parquet(f"{store}/{name}")
    return table.where(F.col("repo_name").isin(*repos)) if repos else table


def available(spark: SparkSession, store: str) -> DataFrame:
    """(repo_name, elements, files) of the stored element tables, counted exactly."""
    return load(spark, store, "elements").groupBy("repo_name").agg(F.count(F.lit(1)).alias("elements"), F.count_distinct("relative_path").alias("files"))


def remove(spark: SparkSession, store: str, name: str, repo_name: str) -> None:
    """Take a repository out of a table: an empty partition takes its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}/repo_name={repo_name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_vectors(left: DataFrame, right: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Both tables together; raises if their vectors differ in length."""
    size = lambda df: df.where(F.col(vec_col).isNotNull()).agg(F.min(F.size(vec_col)), F.max(F.size(vec_col))).first()
    a, b = size(left), size(right)
    lengths = {x for x in (*a, *b) if x is not None}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    return left.unionByName(right)


def without(table: DataFrame, predicate: Column) -> DataFrame:
    """The rows for which the predicate does not hold; where it is null the row stays. Vectors and their metadata are one table, so both go."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def read_contents(files: DataFrame, max_chars: int = 50_000) -> DataFrame:
    """(path, content, total_lines, truncated): contents as they are shown, up to max_chars characters, and the lines of what is shown."""
    shown = F.substring("content", 1, max_chars)
    lines = F.length(shown) - F.length(F.replace(shown, F.lit("\n"), F.lit(""))) + 1
    return files.where("content is not null").select("path", shown.alias("content"), lines.cast("int").alias("total_lines"), (F.length("content") >= max_chars).alias("truncated"))
