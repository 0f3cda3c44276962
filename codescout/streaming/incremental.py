"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codescout.operators.parse import build_elements, parse_files
from codescout.sources.repository import save


def first_seen(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark; the state of older keys is dropped, so it stays bounded."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, keys, n): counts in tumbling windows; events later than the delay are dropped."""
    counted = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n")


def index_stream(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Parse the files of a stream and replace the element partitions of their repositories.

    A batch must hold the whole of each repository in it, as a listing of changed repositories does. Writing a
    batch again after a failure gives the same partitions.
    """

    def write(batch: DataFrame, _: int) -> None:
        save(build_elements(parse_files(batch)), store, "elements")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
