"""Counts of elements, files and repositories, and the store of dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescout.functions.text import extension
from codescout.session import cut


def ancestors(files: DataFrame) -> DataFrame:
    """(repo_name, dir, n_below, n_direct): every directory with the files below it and directly in it; repeated files count once."""
    paths = files.select("repo_name", "relative_path").where("relative_path is not null").distinct()
    parts = F.split("relative_path", "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    each = paths.select("repo_name", F.size(parts).alias("n"), F.explode(depths).alias("d"), parts.alias("parts"))
    named = each.select("repo_name", F.array_join(F.slice("parts", F.lit(1), F.col("d")), "/").alias("dir"), (F.col("d") == F.col("n") - 1).cast("int").alias("direct"))
    return named.groupBy("repo_name", "dir").agg(F.count(F.lit(1)).alias("n_below"), F.sum("direct").alias("n_direct"))


def repo_stats(elements: DataFrame) -> DataFrame:
    """(repo_name, files, classes, functions, avg_lines, max_depth) over distinct ids."""
    e = elements.select("repo_name", "id", "type", "relative_path", "start_line", "end_line").distinct()
    is_file = F.col("type") == "file"
    return e.groupBy("repo_name").agg(
        F.count_distinct("relative_path").alias("files"),
        F.count_if(F.col("type") == "class").alias("classes"),
        F.count_if(F.col("type") == "function").alias("functions"),
        F.round(F.avg(F.when(is_file, F.col("end_line") - F.col("start_line") + 1)), 6).alias("avg_lines"),
        F.max(F.size(F.split("relative_path", "/")) - 1).alias("max_depth"),
    )


def repo_factor(files: Column, avg_lines: Column, depth: Column) -> Column:
    """0.5 to 2 from the size of a repository."""
    part = lambda x: F.least(F.greatest(x, F.lit(0.5)), F.lit(2.0))
    return (part(F.log10(files + 1) / 3) + part(avg_lines / 200) + part(depth / 5)) / 3


def primary_language(files: DataFrame) -> DataFrame:
    """(repo_name, extension, n): the extension with the most files; the first by name on ties."""
    n = files.select("repo_name", "relative_path").distinct().groupBy("repo_name", extension(F.col("relative_path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("repo_name").agg(F.min_by(F.struct("extension", "n"), F.struct(-F.col("n"), F.col("extension"))).alias("b"))
    return best.select("repo_name", "b.extension", "b.n")


def history(turns: DataFrame, last: int, session: str, turn: str) -> DataFrame:
    """The last turns of each session with their number from the end; reads no session whole into a task beyond Spark's window."""
    return turns.withColumn("from_end", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("from_end") <= last)


def alive(entries: DataFrame, time_col: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries younger than the time to live at `now`."""
    return entries.where(F.col(time_col) > now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def gains(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows with gain: their value less that of the row before them of the same key in this order; null for the first of a key.

    A key may hold most of the rows: they are sorted by range over all tasks, so a key is spread over several of
    them; each compares its own neighbours, and the first row of a key in a task is compared with the last one of
    the tasks before, of which there is one row for each task and key in it. Rows with a null key are left out.
    """
    columns = rows.columns
    sorted_rows = rows.where(F.col(key).isNotNull()).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = cut(sorted_rows.withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part", key).orderBy(*order)
    inside = placed.withColumn("__before", F.lag(value).over(here)).withColumn("__nth", F.row_number().over(here))
    last = placed.groupBy("__part", key).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(key).orderBy("__part"))).select("__part", F.col(key).alias("__key"), "__carried")
    both = inside.join(carried, (inside["__part"] == carried["__part"]) & (F.col(key) == F.col("__key")) & (F.col("__nth") == 1), "left")
    return both.select(*columns, (F.col(value) - F.coalesce("__before", "__carried")).alias("gain"))


def results_summary(results: DataFrame, key: str, most_files: int = 10, most_elements: int = 15) -> DataFrame:
    """(key, n, files, elements) of results (key, relative_path, type, name, score, id): how many there are, their first files by path, and their best elements as `type name`.

    Only the files and elements that are shown are gathered for each key. Null paths and names are not shown.
    """
    count = results.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    paths = results.where("relative_path is not null").select(key, "relative_path").distinct()
    first = paths.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("relative_path"))).where(F.col("nth") <= most_files)
    files = first.groupBy(key).agg(F.sort_array(F.collect_list("relative_path")).alias("files"))
    best = results.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where(F.col("nth") <= most_elements)
    shown = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.concat_ws(" ", "type", "name").alias("label")))), lambda x: x["label"])
    elements = best.where("name is not null").groupBy(key).agg(shown.alias("elements"))
    return count.join(files, key, "left").join(elements, key, "left")
