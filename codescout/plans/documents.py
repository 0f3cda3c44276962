"""Registered queries over documents and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codescout.functions import text as tx
from codescout.operators import hybrid as hy
from codescout.operators import rollups as du
from codescout.operators import textindex as ti
from codescout.operators import vectors as ve
from codescout.session import shared_folder
from codescout.sources.tables import read_table

QUESTION = "how does the tournament referee count the stadium tickets"
TERMS = ti.query_terms(QUESTION)
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 1)"
_ASKED = "(VALUES " + ", ".join(f"('{t}', {TERMS.count(t)})" for t in sorted(set(TERMS))) + ") q(term, times)"


def _docs(s, d):
    return read_table(s, d, "documents")


def _bm25_sql(source: str = "documents", key: str = "doc_id", name: str = "scored") -> str:
    return f"""
    tok AS (SELECT {key} AS id, {_WORDS} AS words FROM {source}),
    st AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avgdl FROM tok),
    dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(words) AS term FROM tok) GROUP BY term),
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs, st),
    w AS (SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
    tf AS (SELECT id, len(words) AS dl, term, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM tok) GROUP BY id, words, term),
    {name} AS (SELECT id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
               FROM tf JOIN {_ASKED} USING (term) JOIN w USING (term), st GROUP BY id HAVING sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)"""


_DOT = "list_dot_product(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
_COS = f"({_DOT.format('e.embedding', 'q.vec')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.vec', 'q.vec')})))"
_QVEC = "q AS (SELECT embedding AS vec FROM embeddings ORDER BY vec_id LIMIT 1)"


def _query_vector(s, d):
    return read_table(s, d, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("vec"))


def _index(s, d):
    """The stored index of the documents; built by the first query of the session that asks for it."""
    return ti.stored_index(_docs(s, d).select("doc_id", "text"), "documents")


def index_build(s, d):
    """The stored index, built anew: its postings summed up by term."""
    built = ti.build_index(_docs(s, d).select("doc_id", "text"), f"{shared_folder(s)}/index-{s.sparkContext.applicationId}-new")
    terms = built.read("terms")
    return built.read("postings").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("len").alias("len")).join(terms.select("term", "df", F.round("idf", 6).alias("idf")), "term")


def tokenize_counts(s, d):
    return ti.term_frequencies(_docs(s, d), "doc_id", "text")


def term_idf(s, d):
    out = ti.idf(ti.term_stats(_docs(s, d), "doc_id", "text"))
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(s, d):
    return ti.corpus_stats(_docs(s, d), "doc_id", "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(s, d):
    return ti.top_k(_index(s, d).search(QUESTION), 20)


def bm25_topk_of_source(s, d):
    """Global weights, then the rows of one source (the largest)."""
    scored = _index(s, d).search(QUESTION)
    source = _docs(s, d).where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).select("source")
    mine = _docs(s, d).join(F.broadcast(source), "source", "left_semi").select(F.col("doc_id").alias("id"))
    return ti.top_k(scored.join(mine, "id"), 20)


def bm25_within_source(s, d):
    """The index of one source alone."""
    source = _docs(s, d).where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).select("source")
    return ti.top_k(ti.bm25(_docs(s, d).join(F.broadcast(source), "source", "left_semi"), QUESTION), 20)


_SOURCE = "top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


def cosine_topk(s, d):
    return ti.top_k(ve.cosine_search(read_table(s, d, "embeddings"), _query_vector(s, d)), 20)


def l2_topk(s, d):
    one = _query_vector(s, d)
    far = read_table(s, d, "embeddings").crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("id"), (1.0 / (1.0 + ve.squared_l2(F.col("embedding"), F.col("vec")))).alias("score"))
    return ti.top_k(far, 20)


def knn_batch(s, d):
    vectors = read_table(s, d, "embeddings")
    return ve.knn_batch(vectors, vectors.where("vec_id % 100 = 0"), 10)


def label_centroids(s, d):
    out = ve.centroids(read_table(s, d, "embeddings"))
    return out.select("label", "dim", F.round("mean", 6).alias("mean"))


def centroid_similarity(s, d):
    """Cosine of each vector with the centroid of its own label."""
    c = ve.centroids(read_table(s, d, "embeddings"))
    each = read_table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v")).join(c, ["label", "dim"])
    v = F.col("v").cast("double")
    out = each.groupBy("vec_id").agg((F.sum(v * F.col("mean")) / (F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(F.col("mean") * F.col("mean"))))).alias("similarity"))
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


_KIND = "CASE kind WHEN 'code' THEN 'function' WHEN 'design' THEN 'class' WHEN 'readme' THEN 'documentation' ELSE 'file' END"
_WEIGHT = "CASE type WHEN 'function' THEN 1.2::DOUBLE WHEN 'class' THEN 1.1::DOUBLE WHEN 'file' THEN 0.9::DOUBLE WHEN 'documentation' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


def _kinds(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("id"), F.expr(_KIND).alias("type"), F.coalesce("source", F.lit("")).alias("source"))


def _pools(s, d):
    keyword = _index(s, d).search(QUESTION).orderBy(F.desc(F.round("score", 9)), "id").limit(hy.KEYWORD_POOL)
    vector = ve.cosine_search(read_table(s, d, "embeddings"), _query_vector(s, d)).orderBy(F.desc(F.round("score", 9)), "id").limit(20)
    return keyword, vector


_POOLS = f"""{_bm25_sql()}, kw AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, id LIMIT 50), {_QVEC},
    vec AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE {_COS} > 0 ORDER BY round(score, 9) DESC, id LIMIT 20),
    fused AS (SELECT id, sum(part) AS score FROM (SELECT id, score / (SELECT max(score) FROM kw) * 0.4 AS part FROM kw UNION ALL SELECT id, score * 0.6 FROM vec) GROUP BY id),
    typed AS (SELECT id, type, source, score FROM fused JOIN (SELECT doc_id AS id, {_KIND} AS type, coalesce(source, '') AS source FROM documents) USING (id))"""


def hybrid_search(s, d):
    fused = hy.fuse(*_pools(s, d))
    typed = hy.rerank(_kinds(s, d).join(F.broadcast(fused), "id"), "type")  # at most 70 rows
    return ti.top_k(typed.select("id", "type", "score"), 20)


def retrieval(s, d):
    """One retrieval: the first vector as the question, the second as its pseudocode, and the keywords; English only."""
    vectors = read_table(s, d, "embeddings")
    second = vectors.orderBy("vec_id").limit(2).orderBy(F.desc("vec_id")).limit(1).select(F.col("embedding").alias("vec"))
    elements = _docs(s, d).select(F.col("doc_id").alias("id"), F.expr(_KIND).alias("type"), F.col("lang").alias("language"), F.coalesce("source", F.lit("")).alias("source"))
    found = hy.retrieve(elements, ve.cosine_search(vectors, _query_vector(s, d)), _index(s, d).search(QUESTION), ve.cosine_search(vectors, second), language="en", k=12, group_col="source")
    return found.select("id", "type", F.round("total_score", 6).alias("total_score"))


def combine_components(s, d):
    keyword, vector = _pools(s, d)
    out = hy.combine(vector, keyword)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "total_score")))


def diversified_search(s, d):
    typed = hy.rerank(_kinds(s, d).join(F.broadcast(hy.fuse(*_pools(s, d))), "id"), "type")
    spread = hy.diversify(typed.withColumn("score", F.round("score", 9)), "source")
    return ti.top_k(spread.select("id", "source", "score"), 20)


def select_sources(s, d):
    """Sources as repositories: the mean similarity and the summed keyword score of their documents, blended."""
    keyword = _index(s, d).search(QUESTION).join(_kinds(s, d), "id").groupBy("source").agg(F.sum("score").alias("score"))
    sim = ve.cosine_search(read_table(s, d, "embeddings"), _query_vector(s, d)).join(_kinds(s, d), "id").groupBy("source").agg(F.max("score").alias("score"))
    out = hy.select_repositories(sim.withColumnRenamed("source", "id"), keyword.withColumnRenamed("source", "id"), 5)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("semantic", "keyword", "total")))


def chunk_windows(s, d):
    out = _docs(s, d).select("doc_id", F.explode(tx.word_windows(F.col("text"), 100, 20)).alias("c"))
    return out.select("doc_id", "c.chunk", F.md5("c.text").alias("text_md5"))


def line_counts(s, d):
    t = F.col("text")
    return _docs(s, d).where("text is not null").select("doc_id", tx.count_lines(t).alias("lines"))


def truncate_marker(s, d):
    return _docs(s, d).select("doc_id", F.md5(tx.truncate(F.col("text"), 200)).alias("cut_md5"))


def line_slices(s, d):
    return _docs(s, d).select("doc_id", F.md5(tx.line_slice(F.col("text"), F.lit(2), F.lit(4))).alias("slice_md5"))


def element_ids(s, d):
    return _docs(s, d).where("source is not null").select("doc_id", tx.element_id(F.col("source"), F.col("kind"), F.col("doc_id").cast("string")).alias("element_id"))


def language_rollup(s, d):
    return _docs(s, d).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))


def source_counts(s, d):
    return _docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))


def metadata_filter(s, d):
    return _docs(s, d).where("lang = 'en' and kind = 'code' and source is not null").select("doc_id", "source")


def retrieve_by_kind(s, d):
    """The first fifty of a kind."""
    return _docs(s, d).where("kind = 'design'").orderBy("doc_id").limit(50).select("doc_id", "lang")


def new_documents(s, d):
    """Documents whose text does not occur under a smaller id."""
    t = _docs(s, d).where("text is not null").select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n"))
    return t.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def session_history(s, d):
    """The last three documents of each source, newest first."""
    t = _docs(s, d).where("source is not null")
    order = Window.partitionBy("source").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return t.select("source", "doc_id", F.row_number().over(order).alias("from_end")).where("from_end <= 3")


def session_deltas(s, d):
    """Length gained from one document of a source to the next."""
    t = _docs(s, d).where("source is not null and text is not null").select("source", "doc_id", "created_at", F.length("text").alias("n"))
    return du.gains(t, "source", ["created_at", "doc_id"], "n").select("doc_id", "gain").where("gain is not null")


QUERIES = {
    "tokenize_counts": (tokenize_counts, f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_WORDS}) AS term FROM documents) GROUP BY id, term"),
    "index_build": (index_build, f"WITH {_bm25_sql()} SELECT tf.term, sum(tf)::BIGINT AS tf, sum(dl)::BIGINT AS len, any_value(df) AS df, round(any_value(idf), 6) AS idf FROM tf JOIN w USING (term) JOIN dfs USING (term) GROUP BY tf.term"),
    "term_idf": (term_idf, f"WITH {_bm25_sql()} SELECT w.term, df, round(idf, 6) AS idf FROM w JOIN raw USING (term)"),
    "corpus_stats": (corpus_stats, f"SELECT count(*) AS n, round(sum(len({_WORDS})) / count(*), 6) AS avgdl FROM documents"),
    "bm25_topk": (bm25_topk, f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 20"),
    "bm25_topk_of_source": (bm25_topk_of_source, f"WITH {_bm25_sql()}, {_SOURCE} SELECT id, round(score, 6) AS score FROM scored WHERE id IN (SELECT doc_id FROM documents JOIN top USING (source)) ORDER BY 2 DESC, 1 LIMIT 20"),
    "bm25_within_source": (bm25_within_source, f"WITH {_SOURCE}, mine AS (SELECT doc_id, text FROM documents JOIN top USING (source)), {_bm25_sql('mine')} SELECT id, round(score, 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 20"),
    "cosine_topk": (cosine_topk, f"WITH {_QVEC} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, q WHERE {_COS} > 0 ORDER BY 2 DESC, 1 LIMIT 20"),
    "l2_topk": (l2_topk, f"WITH {_QVEC} SELECT vec_id AS id, round(1.0 / (1.0 + list_sum(list_transform(list_zip(e.embedding, q.vec), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS score FROM embeddings e, q ORDER BY 2 DESC, 1 LIMIT 20"),
    "knn_batch": (knn_batch, f"WITH q AS (SELECT vec_id AS query_id, embedding AS vec FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, q WHERE round({_COS}, 6) > 0) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c) WHERE rank <= 10"),
    "label_centroids": (label_centroids, "SELECT label, dim::INT AS dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim"),
    "centroid_similarity": (centroid_similarity, "WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY label, dim) SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS similarity FROM x JOIN c USING (label, dim) GROUP BY vec_id"),
    "hybrid_search": (hybrid_search, f"WITH {_POOLS} SELECT id, type, round(score * {_WEIGHT}, 6) AS score FROM typed ORDER BY 3 DESC, 1 LIMIT 20"),
    "retrieval": (retrieval, f"WITH {_bm25_sql()}, {_QVEC}, p AS (SELECT embedding AS vec FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 1), kw AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, id LIMIT 10), a AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE {_COS} > 0 ORDER BY round(score, 9) DESC, id LIMIT 20), b AS (SELECT vec_id AS id, {_COS.replace('q.vec', 'p.vec')} AS score FROM embeddings e, p WHERE {_COS.replace('q.vec', 'p.vec')} > 0 ORDER BY round(score, 9) DESC, id LIMIT 10), c AS (SELECT id, sum(s) AS s FROM (SELECT id, score * 0.6 AS s FROM a UNION ALL SELECT id, score * 0.4 FROM b UNION ALL SELECT id, score / (SELECT max(score) FROM kw) * 0.3 FROM kw) GROUP BY id), t AS (SELECT c.id, {_KIND} AS type, coalesce(source, '') AS source, s FROM c JOIN documents d ON d.doc_id = c.id WHERE lang = 'en'), r AS (SELECT id, type, source, round(s * {_WEIGHT}, 9) AS s FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, id) AS k FROM r) SELECT id, type, round(CASE WHEN k > 1 THEN s * 0.9 ELSE s END, 6) AS total_score FROM n ORDER BY round(CASE WHEN k > 1 THEN s * 0.9 ELSE s END, 9) DESC, id LIMIT 12"),
    "combine_components": (combine_components, f"WITH {_POOLS}, a AS (SELECT id, score * 0.6 AS s FROM vec), b AS (SELECT id, score / (SELECT max(score) FROM kw) * 0.3 AS k FROM kw) SELECT id, round(coalesce(s, 0), 6) AS semantic_score, round(coalesce(k, 0), 6) AS keyword_score, round(coalesce(s, 0) + coalesce(k, 0), 6) AS total_score FROM a FULL JOIN b USING (id)"),
    "diversified_search": (diversified_search, f"WITH {_POOLS}, r AS (SELECT id, source, round(score * {_WEIGHT}, 9) AS score FROM typed), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM r) SELECT id, source, round(CASE WHEN k > 1 THEN score * 0.9 ELSE score END, 6) AS score FROM n ORDER BY 3 DESC, 1 LIMIT 20"),
    "select_sources": (select_sources, f"WITH {_bm25_sql()}, {_QVEC}, k AS (SELECT doc_id AS id, coalesce(source, '') AS source FROM documents), kws AS (SELECT source AS id, sum(score) AS score FROM scored JOIN k USING (id) GROUP BY source), sem AS (SELECT source AS id, max(score) AS score FROM (SELECT vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE {_COS} > 0) JOIN k USING (id) GROUP BY source), b AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.score, 0) AS semantic, coalesce(y.score / (SELECT max(score) FROM kws), 0) AS keyword FROM (SELECT * FROM sem WHERE score >= 0.3) x FULL JOIN kws y ON x.id = y.id), t AS (SELECT *, semantic * 0.7 + keyword * 0.3 AS total FROM b) SELECT id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(total, 6) AS total FROM t WHERE total > 0.15 OR semantic > 0.4 OR keyword > 0.95 ORDER BY t.total DESC, id LIMIT 5"),
    "chunk_windows": (chunk_windows, r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, words, unnest(range(greatest(ceil((len(words) - 100) / 80.0), 0)::INT + 1)) AS chunk FROM w WHERE len(words) > 0) SELECT doc_id, chunk::INT AS chunk, md5(array_to_string(list_slice(words, chunk * 80 + 1, chunk * 80 + 100), ' ')) AS text_md5 FROM c"),
    "line_counts": (line_counts, "SELECT doc_id, CASE WHEN text = '' THEN 0 WHEN right(text, 1) = chr(10) THEN length(text) - length(replace(text, chr(10), '')) ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::INT AS lines FROM documents WHERE text IS NOT NULL"),
    "truncate_marker": (truncate_marker, "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || chr(10) || '... (truncated)' ELSE text END) AS cut_md5 FROM documents"),
    "line_slices": (line_slices, "SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS slice_md5 FROM documents"),
    "element_ids": (element_ids, "SELECT doc_id, source || '_' || kind || '_' || substring(sha256(source || doc_id::VARCHAR), 1, 12) AS element_id FROM documents WHERE source IS NOT NULL"),
    "language_rollup": (language_rollup, "SELECT lang, kind, count(*) AS n, count(text) AS with_text FROM documents GROUP BY lang, kind"),
    "source_counts": (source_counts, "SELECT source, count(*) AS n, count(DISTINCT kind) AS kinds FROM documents GROUP BY source"),
    "metadata_filter": (metadata_filter, "SELECT doc_id, source FROM documents WHERE lang = 'en' AND kind = 'code' AND source IS NOT NULL"),
    "retrieve_by_kind": (retrieve_by_kind, "SELECT doc_id, lang FROM documents WHERE kind = 'design' ORDER BY doc_id LIMIT 50"),
    "new_documents": (new_documents, "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text), length(text)"),
    "session_history": (session_history, "SELECT source, doc_id, from_end FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, doc_id DESC)::INT AS from_end FROM documents WHERE source IS NOT NULL) WHERE from_end <= 3"),
    "session_deltas": (session_deltas, "SELECT * FROM (SELECT doc_id, (n - lag(n) OVER (PARTITION BY source ORDER BY created_at, doc_id))::INT AS gain FROM (SELECT source, doc_id, created_at, length(text) AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)) WHERE gain IS NOT NULL"),
}
