"""Similarity search over embedding columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codescout.functions.text import tokens

#: Queries that are sent around at once.
BLOCK_QUERIES = 10_000


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty and zero vectors and for different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(F.coalesce(same, F.lit(False)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_search(vectors: DataFrame, query: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_score: float = 0.0) -> DataFrame:
    """(id, score) of the vectors more similar than min_score to the query, a table of one row (vec)."""
    one = F.broadcast(query.select(F.col("vec").alias("__query")).limit(1))
    scored = vectors.crossJoin(one).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.col("__query")).alias("score"))
    return scored.where(F.col("score") > min_score)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors of each query, exactly, by cosine.

    Vectors stay where they lie: a block of at most `BLOCK_QUERIES` queries is sent to all tasks, each of which keeps
    the best k of its own vectors for each query; only these are shuffled. More queries take one more pass for
    each block. Ties go to the smaller id. Null, empty and zero vectors, and vectors of another length than the
    query's, have the similarity 0 and are left out.
    """
    spark = vectors.sparkSession
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    have = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    parts = []
    for block in range(blocks):
        rows = [(r["id"], r["vec"]) for r in asked.where(F.col("block") == block).collect() if r["vec"]]  # about BLOCK_QUERIES
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for _, v in rows}:
            same = [(i, v) for i, v in rows if len(v) == size]
            by_size[size] = np.array([i for i, _ in same], np.int64), _unit(np.array([v for _, v in same], np.float64))
        sent = spark.sparkContext.broadcast(by_size)
        parts.append(have.mapInArrow(_nearest(sent, k), "query_id long, id long, score double"))
    near = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _nearest(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy()) * np.asarray(column.is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, ...]] = []
            for size, (query_ids, queries) in sent.value.items():
                at = np.flatnonzero(lengths == size)
                if not len(at):
                    continue
                known = _unit(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size))
                own = ids[at]
                for low in range(0, len(queries), 256):
                    score = (queries[low : low + 256] @ known.T).round(6)
                    if len(at) > k:  # the k best, and all that are as good as the last of them
                        least = np.partition(score, -k, axis=1)[:, -k][:, None]
                        row, col = np.nonzero((score >= least) & (score > 0))
                    else:
                        row, col = np.nonzero(score > 0)
                    out.append((query_ids[low + row], own[col], score[row, col]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def hashing_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed tokens."""
    hashed = F.transform(tokens(text), lambda t: F.xxhash64(t))
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(F.filter(hashed, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).cast("float"),
    )


def centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(label, dim, mean): the mean vector of each label, by dimension."""
    each = vectors.select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("dim", "value"))
    return each.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
