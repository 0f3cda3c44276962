"""The pN_ queries of the numbered problems, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescout.llm.docpairs import code_doc_pairs, documented_ids
from codescout.llm.files import fault_rates, not_hand_written, parse_faults
from codescout.llm.packing import CAPACITY, pack_documents
from codescout.llm.secrets import find_secrets
from codescout.llm.splitting import split_oversized
from codescout.llm.subjects import find_subjects
from codescout.llm.tokenizer import encode_corpus
from codescout.session import cut
from codescout.sources.tables import read_table

#: Rows of two places that may be broadcast: about 100 MB.
BROADCAST_ROWS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, spread over all cores where its scan has fewer partitions (one small file has one)."""
    table = read_table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _records(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of one row for each key: the first of its repeated rows by place in the files.

    Only keys and places are shuffled to find the surplus rows, which are few; they are left out by a join on
    the place, broadcast where they are at most `BROADCAST_ROWS` and shuffled otherwise.
    """
    table = read_table(spark, sf_dir, name).select(key, *columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    first = Window.partitionBy(key).orderBy("__file", "__row")
    surplus = table.select(key, "__file", "__row").withColumn("n", F.row_number().over(first)).where("n > 1").select("__file", "__row")
    surplus = cut(surplus)
    if surplus.count() <= BROADCAST_ROWS:
        surplus = F.broadcast(surplus)
    return table.join(surplus, ["__file", "__row"], "left_anti").select(key, *columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = parse_faults(_table(spark, sf_dir, "source_files", "path", "repo_name", "content"))
    return faults.where("fault is not null").select(F.col("path").alias("file_path")).distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fault_rates(_table(spark, sf_dir, "source_files", "path", "repo_name", "content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_table(spark, sf_dir, "code_elements", "id", "start_line", "code")).select("id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_records(spark, sf_dir, "code_elements", "id", "start_line", "code"))


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized element the pieces without their overlaps, joined; the longest piece and overlap, and the lines."""
    pieces = split_oversized(_table(spark, sf_dir, "code_elements", "id", "start_line", "code"))
    part = F.struct("piece", F.substring(F.col("code"), F.col("n_overlap") + 1, F.char_length("code")).alias("code"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_set(part)), lambda x: x["code"]), "")
    joined = pieces.groupBy("id").agg(F.md5(whole).alias("code_md5"), (F.max(F.char_length("code")) <= 2000).alias("fits"), (F.max("n_overlap") <= 200).alias("overlap_fits"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return joined


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_reasons(spark, sf_dir).select("path")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(_table(spark, sf_dir, "source_files", "repo_name", "path", "relative_path", "content"), read_table(spark, sf_dir, "library_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "code_elements", "id", "type", "code"))
    return found.select("id", F.explode("line_nos").alias("line_no")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_records(spark, sf_dir, "code_elements", "id", "type", "code")).select("id", F.size("line_nos").alias("n_lines"), "code")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_ids(read_table(spark, sf_dir, "code_elements"), _table(spark, sf_dir, "source_files", "path", "content"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_doc_pairs(_records(spark, sf_dir, "code_elements", "id", "type", "name", "file_path", "start_line", "signature", "code"), _table(spark, sf_dir, "source_files", "path", "content"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, how many of them are placed otherwise than whole or in full containers and a rest, and containers beyond their capacity."""
    packed = p7_packed(spark, sf_dir)
    each = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.count_if(F.col("size") < CAPACITY).alias("short"))
    docs = each.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("pieces")) | (F.col("last") != F.col("n") - 1) | (F.col("short") > 1)).alias("wrong"))
    over = packed.groupBy("container_id").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("over_capacity"))
    return docs.crossJoin(F.broadcast(over))  # one row each


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))
    used = packed.groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n_items"))
    return used.withColumn("unused", F.lit(CAPACITY) - F.col("used"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_subjects(_table(spark, sf_dir, "documents", "doc_id", "lang", "text"), *(read_table(spark, sf_dir, t) for t in ("subject_labels", "subjects")))


def p8_subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_pieces, p2_rejoined, p3_found, p3_reasons, p4_found, p4_redacted, p5_found, p5_pairs, p6_ids, p7_packed, p7_check, p7_containers, p8_found, p8_subject_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT id FROM code_elements WHERE length(code) > 2000",
        "p2_rejoined": "SELECT DISTINCT id, md5(code) AS code_md5, TRUE AS fits, TRUE AS overlap_fits, coalesce(start_line, 1) AS start_line, (coalesce(start_line, 1) + length(code) - length(replace(code, chr(10), '')) - CASE WHEN ends_with(code, chr(10)) THEN 1 ELSE 0 END)::INT AS end_line FROM code_elements WHERE length(code) > 2000",
        "p7_check": "SELECT count(*) AS documents, 0::BIGINT AS wrong, 0::BIGINT AS over_capacity FROM documents",
    }
