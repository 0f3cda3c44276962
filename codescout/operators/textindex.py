"""Inverted index and BM25 ranking."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codescout.functions.text import tokens
from codescout.session import shared_folder

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Parts of a stored index by term, and tasks among which the postings of a part are dealt.
BUCKETS, SPREAD = 32, 2


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, mode: str = "default") -> DataFrame:
    """(id, term, tf). Null and empty texts have no terms."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col), mode)).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str, text_col: str, mode: str = "default") -> DataFrame:
    """(id, len): the number of tokens, 0 included."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col), mode)).alias("len"))


def corpus_stats(docs: DataFrame, id_col: str, text_col: str, mode: str = "default") -> DataFrame:
    """One row (n, avgdl)."""
    lengths = doc_lengths(docs, id_col, text_col, mode)
    return lengths.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.count(F.lit(1))).alias("avgdl"))


def term_stats(docs: DataFrame, id_col: str, text_col: str, mode: str = "default") -> DataFrame:
    """(term, df, raw_idf). The distinct terms of each document are counted where it lies, so only (term, 1) is shuffled."""
    once = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col), mode))).alias("term"))
    df = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))


def idf(stats: DataFrame, *more: str) -> DataFrame:
    """(term, df, idf) and the columns `more`: a negative raw idf becomes a quarter of the mean raw idf of the whole vocabulary."""
    mean = stats.agg(F.avg("raw_idf").alias("mean_idf"))
    floored = F.when(F.col("raw_idf") < 0, F.col("mean_idf") * FLOOR).otherwise(F.col("raw_idf"))
    return stats.crossJoin(F.broadcast(mean)).select(*more, "term", "df", floored.alias("idf"))


@dataclass(frozen=True)
class TextIndex:
    """A stored index: postings (bucket, term, id, tf, len), terms (bucket, term, df, idf) and stats (n, avgdl, vocabulary), as Parquet.

    Postings and terms are partitioned by a hash of the term and sorted by term, so a question reads the
    parts of its own terms only.
    """

    spark: SparkSession
    path: str
    buckets: int
    id_type: str = "bigint"

    def read(self, table: str) -> DataFrame:
        """A table of the index; its columns are stated, as an index without terms has no files."""
        columns = {"postings": f"term string, id {self.id_type}, tf bigint, len int, bucket int", "terms": "term string, df bigint, idf double, bucket int", "stats": "n bigint, avgdl double, vocabulary bigint"}
        return self.spark.read.schema(columns[table]).parquet(f"{self.path}/{table}")

    def _of(self, table: str, terms: list[str]) -> DataFrame:
        numbers = [_bucket_of(t, self.buckets) for t in terms]
        return self.read(table).where(F.col("bucket").isin(*set(numbers)) & F.col("term").isin(*set(terms)))

    def search(self, query: str, k1: float = K1, b: float = B, mode: str = "default") -> DataFrame:
        """(id, score) as bm25() gives it, from the postings of the question's terms."""
        terms = query_terms(query) if mode == "default" else query.lower().split()
        if not terms:
            return self.read("postings").select("id", F.lit(0.0).alias("score")).where(F.lit(False))
        times = reduce(lambda c, t: c.when(F.col("term") == t, terms.count(t)), sorted(set(terms)), F.when(F.lit(False), 0))
        if self.path not in _STATS:
            _STATS[self.path] = self.read("stats").first()  # one row
        stats = _STATS[self.path]
        if stats is None or not stats["avgdl"]:
            return self._of("postings", terms).select("id", F.lit(0.0).alias("score")).where(F.lit(False))
        weights = {r["term"]: r["idf"] for r in self._of("terms", terms).select("term", "idf").collect()}  # the question's terms
        weight = reduce(lambda c, t: c.when(F.col("term") == t, weights[t]), sorted(weights), F.when(F.lit(False), 0.0)).otherwise(0.0) * times
        tf, length = F.col("tf"), F.col("len")
        part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / stats["avgdl"]))
        return self._of("postings", terms).groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")


#: The statistics of the indexes that were asked, by path.
_STATS: dict[str, Row | None] = {}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def _bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "default", buckets: int = BUCKETS) -> TextIndex:
    """Writes the index of docs below `path` and gives it. Null and empty texts count as documents without terms.

    Texts are read once; what is shuffled are (term, id, 1), summed in each task first. The postings of a frequent
    term are dealt to several tasks and files.
    """
    spark = docs.sparkSession
    _STATS.pop(path, None)
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), mode).alias("words"))
    each = words.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    postings = each.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len")).withColumn("bucket", _bucket(F.col("term"), buckets))
    spread = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = TextIndex(spark, path, buckets, docs.schema[id_col].dataType.simpleString())
    stored = index.read("postings")
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.size(tokens(F.col(text_col), mode)))).first()
    df = stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = idf(df.select("bucket", "term", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf")), "bucket")
    weights.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    mean = index.read("terms").agg(F.count(F.lit(1)).alias("vocabulary")).select(F.lit(n).cast("bigint").alias("n"), F.lit(float(total or 0) / max(n, 1)).alias("avgdl"), "vocabulary")
    mean.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return index


_BUILT: dict[tuple[str, str], TextIndex] = {}


def stored_index(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> TextIndex:
    """The index of docs in the shared folder of this session, built when it is first asked for.

    `key` names the source; a source whose files or sizes change gets an index of its own.
    """
    spark = docs.sparkSession
    name = zlib.crc32("|".join([key, id_col, text_col, *sorted(docs.inputFiles())]).encode())
    at = (spark.sparkContext.applicationId, f"{name}-{_size_of(docs)}")
    if at not in _BUILT:
        _BUILT[at] = build_index(docs, f"{shared_folder(spark)}/index-{at[0]}-{at[1]}", id_col, text_col, buckets=buckets)
    return _BUILT[at]


def _size_of(docs: DataFrame) -> int:
    """Bytes of the files that are read."""
    jvm, total = docs.sparkSession.sparkContext._jvm, 0
    conf = docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in docs.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) > 1]


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, mode: str = "default") -> DataFrame:
    """(id, score) of the documents with a positive score for the query; a repeated query word counts again.

    Only the tokens of the query leave the scan: a document's term counts and its length are computed in
    place, so the one shuffle of the data is that of the vocabulary's document frequencies.
    """
    terms = query_terms(query) if mode == "default" else query.lower().split()
    spark = docs.sparkSession
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    weights = idf(term_stats(docs, id_col, text_col, mode)).where(F.col("term").isin(*set(terms)))
    asked = spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times int")
    asked = asked.join(F.broadcast(weights), "term").select("term", (F.col("times") * F.col("idf")).alias("weight"))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), mode).alias("words"))
    found = words.select("id", F.size("words").alias("len"), F.filter("words", lambda w: w.isin(*set(terms))).alias("hits")).where(F.size("hits") > 0)
    each = found.select("id", "len", "hits", F.explode(F.array_distinct("hits")).alias("term"))
    tf = F.size(F.filter("hits", lambda w: w == F.col("term")))
    scored = each.withColumn("tf", tf).join(F.broadcast(asked), "term").crossJoin(F.broadcast(corpus_stats(docs, id_col, text_col, mode)))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return scored.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k rows of the highest score; rounded first, so that ties are broken by id alike everywhere."""
    return scored.withColumn(score, F.round(score, 6)).orderBy(F.desc(score), tie).limit(k)
