"""Removing repeated, contained and superfluous elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A larger kind contains a smaller one.
TYPE_RANK = {"file": 3, "class": 2, "function": 1}


def latest(df: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """One row for each key: that of the latest time (nulls count as earliest). Rows of a key are equal but for the time.

    Aggregates before the shuffle, so a key with many repeats is no burden.
    """
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(time_col).isNotNull(), F.col(time_col))).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def type_rank(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in TYPE_RANK.items():
        out = out.when(kind == name, rank)
    return out.otherwise(F.lit(0))


def drop_contained(elements: DataFrame, id_col: str = "id") -> DataFrame:
    """Elements (id, repo_name, relative_path, type, start_line, end_line) that no other element of their file contains.

    An element is contained if another one of its file covers its lines, has not the same lines, and is of the
    same or a larger kind. That relation is transitive, so what a greedy pass from the largest down keeps is
    what nothing covers. In each file the elements are read in the order of their lines and the furthest end
    of each kind is carried along, so no pairs are formed.
    """
    e = elements.withColumn("__rank", type_rank(F.col("type")))
    file = Window.partitionBy("repo_name", "relative_path")
    earlier = file.orderBy("start_line").rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("repo_name", "relative_path", "start_line")
    covered = F.lit(False)
    for rank in (3, 2, 1, 0):
        end = F.when(F.col("__rank") == rank, F.col("end_line"))
        reaches = (F.max(end).over(earlier) >= F.col("end_line")) | (F.max(end).over(beside) > F.col("end_line"))
        covered = covered | (F.coalesce(reaches, F.lit(False)) & (F.col("__rank") <= rank))
    return e.withColumn("__covered", covered).where(~F.col("__covered")).drop("__covered", "__rank")


def best_per_file(elements: DataFrame) -> DataFrame:
    """Of (id, repo_name, relative_path, type, score): where a file has a row of type file only the best of these, else the best row of each id."""
    has_file = F.max((F.col("type") == "file").cast("int")).over(Window.partitionBy("repo_name", "relative_path"))
    marked = elements.withColumn("__file", has_file)
    order = Window.partitionBy("repo_name", "relative_path", "__file", F.when(F.col("__file") == 0, F.col("id"))).orderBy(F.desc("score"), "id")
    kept = marked.where((F.col("__file") == 0) | (F.col("type") == "file"))
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__file", "__n")


def line_total(start: Column, end: Column, code: Column) -> Column:
    """Lines of an element; where its line numbers say nothing, the lines of its code."""
    span = end - start + 1
    return F.when(span > 0, span).otherwise(F.coalesce(F.size(F.split(F.nullif(code, F.lit("")), "\n")), F.lit(0)))
