"""Registered queries that read the documents as questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.functions import query as q
from codescout.sources.tables import read_table


def _texts(s, d):
    return read_table(s, d, "documents").where("text is not null")


def question_keywords(s, d):
    return _texts(s, d).select("doc_id", F.md5(F.array_join(F.sort_array(q.keywords(F.col("text"))), " ")).alias("keywords_md5"), F.size(q.keywords(F.col("text"))).alias("n"))


def question_complexity(s, d):
    c = q.complexity(F.col("text"))
    return _texts(s, d).select("doc_id", c.alias("complexity"), q.confidence_threshold(c).alias("threshold"), q.line_budget(c).alias("budget"))


def question_class(s, d):
    return _texts(s, d).select("doc_id", q.classify(F.col("text")).alias("class"))


def question_intent(s, d):
    return _texts(s, d).select("doc_id", q.intent(F.col("text")).alias("intent"))


def question_entity(s, d):
    e = q.entity(F.col("text"))
    return _texts(s, d).select("doc_id", e["type"].alias("type"), e["name"].alias("entity")).where("entity is not null")


def question_about_code(s, d):
    return _texts(s, d).select("doc_id", q.about_code(F.col("text")).alias("about_code"))


def question_parts(s, d):
    return _texts(s, d).select("doc_id", F.posexplode(q.parts(F.col("text"))).alias("pos", "part")).select("doc_id", "pos", F.md5("part").alias("part_md5"))


def question_synonyms(s, d):
    words = _texts(s, d).select("doc_id", F.explode(q.expand_question(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def code_keywords(s, d):
    """The words of code of each question: how many, and which come first."""
    k = q.code_keywords(F.col("text"))
    return _texts(s, d).select("doc_id", F.size(k).alias("n"), F.md5(F.array_join(k, " ")).alias("words_md5"))


def question_filters(s, d):
    """Language, extension and path that a question asks for."""
    t = F.col("text")
    out = _texts(s, d).select("doc_id", q.language_filter(t).alias("language"), q.file_filter(t).alias("extension"), q.path_filter(t).alias("path"))
    return out.where("language is not null or extension <> '' or path <> ''")


def question_rewriting(s, d):
    t = F.col("text")
    score = q.complexity(t)
    return _texts(s, d).select("doc_id", q.wants_rewriting(t).alias("rewrite"), q.rounds(score, F.lit(1.0)).alias("rounds"))


# The SQL states the values for itself.
_WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"
_KEYS = r"""list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}_.]+'), lambda w: strlen(w) >= 2 AND w NOT IN (
    'the', 'is', 'at', 'which', 'on', 'a', 'an', 'and', 'or', 'but', 'in', 'of', 'to', 'for', 'with', 'how', 'what', 'where', 'when', 'why', 'does', 'do', 'this', 'that', 'it',
    'from', 'are', 'was', 'were', 'be', 'has', 'have', 'had', 'can', 'could', 'would', 'should', 'will', 'i', 'me', 'my', 'we', 'our', 'you', 'your')))"""
_SCORE = f"""least(CASE WHEN {_WORDS} > 15 THEN 30 WHEN {_WORDS} > 8 THEN 20 ELSE 10 END + CASE WHEN len({_KEYS}) > 6 THEN 20 WHEN len({_KEYS}) > 3 THEN 10 ELSE 0 END
    + CASE WHEN regexp_matches(lower(text), 'and|also|both|between|compare|relationship|interact|flow') THEN 10 ELSE 0 END
    + CASE WHEN regexp_matches(lower(text), 'architecture|design pattern|inheritance|dependency|concurrency|thread|async|lifecycle|pipeline|algorithm') THEN 15 ELSE 0 END
    + CASE WHEN contains(text, '?') THEN 5 ELSE 0 END, 100)"""
_CLASS = """CASE WHEN regexp_matches(lower(text), 'where|find|locate') THEN 'locate' WHEN regexp_matches(lower(text), 'bug|error|fix|wrong') THEN 'debug'
    WHEN regexp_matches(lower(text), 'how to|how do|implement') THEN 'howto' WHEN regexp_matches(lower(text), 'overview|architecture|structure') THEN 'overview' ELSE 'understand' END"""
_SIGNS = """VALUES (1, 'how', ['how', 'implement', 'create', 'build', 'make']), (2, 'what', ['what', 'is', 'are', 'does', 'define', 'purpose']), (3, 'where', ['where', 'locate', 'find', 'which file']),
    (4, 'debug', ['error', 'bug', 'issue', 'problem', 'fix', 'why not', 'doesn''t work']), (5, 'explain', ['explain', 'describe', 'tell me about', 'understand']),
    (6, 'find', ['find', 'search', 'locate', 'show me', 'list']), (7, 'implement', ['implement', 'write', 'code', 'develop', 'algorithm'])"""
_CODE_STOP = "'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from', 'as', 'is', 'was', 'are', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'can', 'this', 'that', 'these', 'those', 'i', 'you', 'he', 'she', 'it', 'we', 'they'"
_CODE = "'function', 'method', 'class', 'module', 'variable', 'parameter', 'return', 'import', 'export', 'api', 'endpoint', 'route', 'database', 'query', 'model', 'schema', 'table', 'authentication', 'auth', 'login', 'user', 'session', 'test', 'unittest', 'spec', 'testing'"
_SYN = """CASE w WHEN 'function' THEN ['function', 'method', 'procedure', 'routine'] WHEN 'method' THEN ['method', 'function', 'member function'] WHEN 'class' THEN ['class', 'object', 'type']
    WHEN 'error' THEN ['error', 'exception', 'bug', 'issue'] WHEN 'api' THEN ['api', 'endpoint', 'route', 'service'] WHEN 'database' THEN ['database', 'db', 'storage', 'persistence']
    WHEN 'auth' THEN ['authentication', 'authorization', 'auth', 'login'] WHEN 'test' THEN ['test', 'unittest', 'spec', 'testing'] ELSE [w] END"""
_FROM = "FROM documents WHERE text IS NOT NULL"
_LANGUAGE = r"""CASE WHEN regexp_matches(l, '\bin\s+python\b|\bpython\s+(code|implementation|script|function|class|module)\b|\busing\s+python\b|\bwritten\s+in\s+python\b|\bpython\s+implement') THEN 'python'
    WHEN regexp_matches(l, '\bin\s+(javascript|js)\b|\bjavascript\s+(code|implementation|function|class|module)\b|\busing\s+javascript\b|\bjs\s+(code|implementation)\b') THEN 'javascript'
    WHEN regexp_matches(l, '\b(in|using)\s+typescript\b|\btypescript\s+(code|implementation|function|class|module)\b|\bts\s+(code|implementation)\b') THEN 'typescript'
    WHEN regexp_matches(l, '\b(in|using)\s+java\b|\bjava\s+(code|implementation|class|method)\b') THEN 'java'
    WHEN regexp_matches(l, '\b(in|using)\s+go\b|\bgo\s+(code|implementation|function|package)\b|\bin\s+golang\b|\bgolang\s+(code|implementation)\b') THEN 'go'
    WHEN regexp_matches(l, '\b(in|using)\s+c\+\+\b|\bc\+\+\s+(code|implementation|class|function)\b') THEN 'cpp'
    WHEN regexp_matches(l, '\b(in|using)\s+rust\b|\brust\s+(code|implementation|function|module)\b') THEN 'rust' END"""
_EXT = r"regexp_extract(lower(text), '(\.(?:py|js|ts|java|go|cpp|c|rs|rb|php|cs))\b', 1)"
_PATH = """regexp_extract(text, '["'']([a-zA-Z0-9_/.-]+)["'']', 1)"""
_N = r"([\p{L}\p{N}_]+)"
_PARTS = "[text]"
for _mark in (" and ", " or ", ", ", "; "):
    _PARTS = f"flatten(list_transform({_PARTS}, lambda p: string_split(p, '{_mark}')))"

QUERIES = {
    "question_filters": (question_filters, f"WITH x AS (SELECT doc_id, {_LANGUAGE} AS language, {_EXT} AS extension, {_PATH} AS path FROM (SELECT doc_id, text, lower(text) AS l {_FROM})) SELECT * FROM x WHERE language IS NOT NULL OR extension <> '' OR path <> ''"),
    "question_rewriting": (question_rewriting, f"WITH x AS (SELECT doc_id, regexp_matches(lower(text), 'implement|how to|write|create|build|develop|algorithm|logic|code for|function that|method that') AS m, len(list_filter([{_CODE}], lambda k: contains(lower(text), k))) AS t, {_WORDS} AS w, {_SCORE} AS c {_FROM}) SELECT doc_id, m OR t >= 3 OR w >= 15 OR (w <= 5 AND t <= 1) AS rewrite, greatest(least(trunc(4 * (0.7 + 0.6 * ((c / 100.0 + 1.0) / 2)))::INT, 6), 2) AS rounds FROM x"),
    "question_keywords": (question_keywords, f"SELECT doc_id, md5(array_to_string(list_sort({_KEYS}), ' ')) AS keywords_md5, len({_KEYS})::INT AS n {_FROM}"),
    "question_complexity": (question_complexity, f"WITH c AS (SELECT doc_id, {_SCORE} AS c {_FROM}) SELECT doc_id, c::INT AS complexity, CASE WHEN c < 30 THEN 95 WHEN c < 60 THEN 92 ELSE 90 END AS threshold, (CASE WHEN c < 30 THEN 7200 WHEN c < 60 THEN 9600 ELSE 12000 END)::INT AS budget FROM c"),
    "question_class": (question_class, f"SELECT doc_id, {_CLASS} AS class {_FROM}"),
    "question_intent": (question_intent, f"WITH s(nth, intent, signs) AS ({_SIGNS}), h AS (SELECT doc_id, intent, nth, len(list_filter(signs, lambda x: contains(lower(text), x))) AS n FROM (SELECT doc_id, text {_FROM}), s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, nth) AS k FROM h) SELECT doc_id, CASE WHEN n = 0 THEN 'general' ELSE intent END AS intent FROM r WHERE k = 1"),
    "question_about_code": (question_about_code, f"SELECT doc_id, regexp_matches(lower(text), 'function|class|method|variable|code|implementation|how to|algorithm|logic|file|module|import|api|endpoint') AS about_code {_FROM}"),
    "question_entity": (question_entity, f"""WITH x AS (SELECT doc_id, nullif(regexp_extract(lower(text), 'function\\s+(?:named\\s+)?["'']?{_N}["'']?', 1), '') AS a, nullif(regexp_extract(lower(text), 'class\\s+(?:named\\s+)?["'']?{_N}["'']?', 1), '') AS b, nullif(regexp_extract(lower(text), 'method\\s+(?:named\\s+)?["'']?{_N}["'']?', 1), '') AS c, nullif(regexp_extract(lower(text), '["'']{_N}["'']?\\s+function', 1), '') AS d, nullif(regexp_extract(lower(text), '["'']{_N}["'']?\\s+class', 1), '') AS e {_FROM}) SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'function' WHEN b IS NOT NULL THEN 'class' WHEN c IS NOT NULL OR d IS NOT NULL THEN 'function' ELSE 'class' END AS type, coalesce(a, b, c, d, e) AS entity FROM x WHERE coalesce(a, b, c, d, e) IS NOT NULL"""),
    "question_parts": (question_parts, f"WITH p AS (SELECT doc_id, list_slice(list_filter(list_transform({_PARTS}, lambda p: regexp_replace(p, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: length(x) > 15 AND x <> text), 1, 3) AS p {_FROM} AND {_WORDS} >= 10) SELECT doc_id, (unnest(range(len(p))))::INT AS pos, md5(unnest(p)) AS part_md5 FROM p"),
    "question_synonyms": (question_synonyms, f"WITH k AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w {_FROM}), e AS (SELECT DISTINCT doc_id, unnest({_SYN}) AS word FROM k) SELECT word, count(*) AS n FROM e GROUP BY word"),
    "code_keywords": (code_keywords, f"WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{_N}'), lambda w: length(w) > 2 AND w NOT IN ({_CODE_STOP})) AS w {_FROM}) SELECT doc_id, len(w)::INT AS n, md5(array_to_string(list_concat(list_filter(w, lambda x: x IN ({_CODE})), list_filter(w, lambda x: x NOT IN ({_CODE}))), ' ')) AS words_md5 FROM k"),
}
