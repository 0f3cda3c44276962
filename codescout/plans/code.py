"""Registered queries over source files, parse results and code elements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.functions import patterns as pt
from codescout.functions import text as tx
from codescout.operators import dedup as de
from codescout.operators import graph as gr
from codescout.operators import hybrid as hy
from codescout.operators import overview as ov
from codescout.operators import parse as pa
from codescout.operators import resolve as rs
from codescout.operators import rollups as ro
from codescout.operators import search as se
from codescout.operators import textindex as ti
from codescout.sources import repository as repo
from codescout.sources.tables import read_table

_E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST) AS n FROM code_elements) WHERE n = 1)"
_F = "f AS (SELECT DISTINCT repo_name, path, relative_path, content FROM source_files)"


def _elements(s, d, *columns):
    return read_table(s, d, "code_elements").select(*columns).distinct()


def _files(s, d):
    return read_table(s, d, "source_files")


def latest_elements(s, d):
    e = read_table(s, d, "code_elements").select("id", "type", "repo_name", "received_at")
    return de.latest(e, ["id"], "received_at").select("id", "type", "repo_name", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


def element_counts(s, d):
    return _elements(s, d, "id", "type").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def elements_per_file(s, d):
    return _elements(s, d, "id", "repo_name", "relative_path", "type").groupBy("repo_name", "relative_path", "type").agg(F.count(F.lit(1)).alias("n"))


def repo_stats(s, d):
    return ro.repo_stats(read_table(s, d, "code_elements"))


def repo_factor(s, d):
    st = ro.repo_stats(read_table(s, d, "code_elements"))
    return st.select("repo_name", F.round(ro.repo_factor(F.col("files"), F.coalesce("avg_lines", F.lit(0.0)), F.col("max_depth")), 6).alias("factor"))


def repo_info(s, d):
    f = _files(s, d).select("repo_name", "path", "relative_path", F.octet_length("content").alias("bytes")).distinct()
    return f.groupBy("repo_name").agg(F.count(F.lit(1)).alias("file_count"), F.round(F.sum("bytes") / 1048576, 6).alias("total_mb"))


def repositories_with_stats(s, d):
    """All repositories, those without files too."""
    repos = read_table(s, d, "repositories").select("repo_name", "default_branch")
    return repos.join(repo_info(s, d), "repo_name", "left").select("repo_name", "default_branch", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("total_mb", F.lit(0.0)).alias("total_mb"))


def dir_ancestors(s, d):
    return ro.ancestors(_files(s, d))


def primary_language(s, d):
    return ro.primary_language(_files(s, d))


def extension_languages(s, d):
    f = _files(s, d).select("path").distinct()
    return f.groupBy(tx.language(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def containment_dedup(s, d):
    e = _elements(s, d, "id", "type", "repo_name", "relative_path", "start_line", "end_line")
    return de.drop_contained(e.where("type <> 'file'")).select("id")


def best_per_file(s, d):
    e = _elements(s, d, "id", "type", "repo_name", "relative_path", "start_line", "end_line")
    scored = e.withColumn("score", (F.col("end_line") - F.col("start_line")).cast("double"))
    return de.best_per_file(scored.where("start_line > 1")).select("id")


def total_lines(s, d):
    e = read_table(s, d, "code_elements").select("id", "repo_name", de.line_total(F.col("start_line"), F.col("end_line"), F.col("code")).alias("lines")).distinct()
    return e.groupBy("repo_name").agg(F.sum("lines").alias("lines"))


_PRIORITY_SQL = "(end_line - start_line + 1)"


def _priorities(s, d):
    e = _elements(s, d, "id", "type", "repo_name", "start_line", "end_line").where("type in ('class', 'function')")
    lines = F.col("end_line") - F.col("start_line") + 1
    relevance = F.least(lines / 100.0, F.lit(1.0))
    p = hy.priority(relevance, F.lit("retrieval"), F.col("type"), lines, F.col("type") == "function")
    return e.select("id", "repo_name", F.round(p, 6).alias("priority"), lines.cast("long").alias("lines"))


def priority_scores(s, d):
    return _priorities(s, d).select("id", "priority")


def budget_prune(s, d):
    """The elements of each repository that fit into 400 lines, by priority."""
    return hy.budget_prune(_priorities(s, d), 400, "repo_name").select("repo_name", "id")


def grep_regex(s, d):
    return se.grep(_files(s, d), r"return [a-z_]+;", limit=None)


def grep_literal(s, d):
    return se.grep(_files(s, d), "sorted(", limit=None, literal=True)


def grep_glob_top(s, d):
    """The first thirty Python files with a match, in the order of paths."""
    return se.grep(_files(s, d), r"def \w+", glob="src/*.py", limit=30)


def grep_lines(s, d):
    return se.grep_lines(_files(s, d), "lambda ").select("repo_name", "relative_path", "line_no", F.md5("line").alias("line_md5"))


def glob_files(s, d):
    f = _files(s, d).select("repo_name", "relative_path").distinct()
    return f.where(pt.glob_match(F.col("relative_path"), "core/**/*.go"))


RULES = ["# comments and blank rules do nothing", "", "*.min.js", "node_modules/", "vendor/", "core/panel_*/", "!core/panel_1/", "config.json", "/tools/*/README.md"]


def ignore_rules(s, d):
    f = _files(s, d).select("repo_name", "relative_path").distinct()
    return f.where(pt.ignored(F.col("relative_path"), RULES))


def list_directory(s, d):
    return se.list_directory(_files(s, d), "src")


def list_files(s, d):
    return se.list_files(_files(s, d), "TOKEN_SPAN")


def elements_of_file(s, d):
    """Elements of the files that hold the longest code of their repository."""
    e = read_table(s, d, "code_elements").select("id", "type", "repo_name", "relative_path", F.length("code").alias("n")).distinct()
    longest = e.where("type = 'file'").groupBy("repo_name").agg(F.min_by("relative_path", F.struct(-F.coalesce("n", F.lit(0)), F.col("relative_path"))).alias("path"))
    return se.elements_of_file(e, longest.select("path").distinct()).select("id", F.col("wanted_path").alias("path")).distinct()


def browse_file(s, d):
    """The file elements of a path's end, with the hash of their code."""
    return se.browse(read_table(s, d, "code_elements"), ".rs").select("id", F.md5("code").alias("code_md5")).distinct()


def elements_with_matches(s, d):
    """The elements of the files in which a pattern is found."""
    e = _elements(s, d, "id", "relative_path")
    return se.elements_with_matches(e, _files(s, d), r"def flush_\w+", limit=None).select("id").distinct()


def skim_elements(s, d):
    e = read_table(s, d, "code_elements").select("id", "type", "name", "relative_path", "start_line", "end_line", "code").distinct()
    return se.skim(e, ".py").select("id", "name", "start_line", "end_line").distinct()


def file_lines(s, d):
    f = _files(s, d).select("path", tx.count_lines(F.col("content")).alias("lines"), tx.comment_lines(F.col("content")).alias("comments"), tx.code_lines(F.col("content")).alias("code_rows")).distinct()
    return f.where("lines is not null")


def keyword_complexity(s, d):
    e = read_table(s, d, "code_elements").where("type = 'function' and code is not null")
    return e.select("id", tx.keyword_complexity(F.col("code")).alias("complexity")).distinct()


def module_paths(s, d):
    return _files(s, d).select("path", tx.module_path(F.col("relative_path")).alias("module")).distinct().where("module is not null")


def imports_flat(s, d):
    return rs.imports_of(read_table(s, d, "parse_results")).groupBy("module").agg(F.count_distinct("file_path").alias("files"))


def import_edges(s, d):
    return rs.import_edges(_files(s, d), read_table(s, d, "parse_results"))


def loose_import_edges(s, d):
    return rs.loose_import_edges(_files(s, d), read_table(s, d, "parse_results"))


def inheritance_edges(s, d):
    return rs.inheritance_edges(_elements(s, d, "id", "type", "name", "file_path"), read_table(s, d, "parse_results"))


def call_edges(s, d):
    return rs.call_edges(_elements(s, d, "id", "type", "name", "file_path"), read_table(s, d, "parse_results"))


def built_elements(s, d):
    """Elements made from the files by this library's own parser."""
    f = _files(s, d).select("repo_name", "path", "relative_path", tx.language(F.col("path")).alias("language"), "content").dropDuplicates(["path"])
    return pa.build_elements(pa.parse_files(f)).groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


def last_definitions(s, d):
    return rs.last_definition(_elements(s, d, "id", "type", "name"), "function")


def fuzzy_elements(s, d):
    """The names of functions and classes that are close to a wanted name."""
    names = read_table(s, d, "code_elements").where("type in ('class', 'function')").select("name").distinct()
    return rs.fuzzy_names(names, "resolve region map")


def fuzzy_repositories(s, d):
    return rs.fuzzy_names(read_table(s, d, "repositories").select(F.col("repo_name").alias("name")), "amber indexer tool")


def functions_without_elements(s, d):
    """Parsed functions that no element stands for (an anti-join on file and name)."""
    p = read_table(s, d, "parse_results").select("file_path", F.explode("functions").alias("f")).select("file_path", F.col("f.name").alias("name")).distinct()
    return p.join(_elements(s, d, "file_path", "name", "type").where("type = 'function'").select("file_path", "name"), ["file_path", "name"], "left_anti")


def file_summaries(s, d):
    """The summary line of each parsed file."""
    p = read_table(s, d, "parse_results")
    names = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["name"]), ", ")
    text = F.concat_ws("; ", F.concat(F.lit("Lines: "), F.coalesce(F.col("total_lines"), F.lit(0))), F.concat(F.lit("Classes: "), F.nullif(names(F.col("classes")), F.lit(""))), F.concat(F.lit("Functions: "), F.nullif(names(F.col("functions")), F.lit(""))))
    return p.select("file_path", text.alias("summary")).distinct()


def bm25_elements(s, d):
    """The best elements of all by their whole text; the index is stored by the first query of the session."""
    e = read_table(s, d, "code_elements").select("id", tx.search_text(*(F.col(c) for c in ("name", "type", "language", "relative_path", "docstring", "signature", "summary", "code"))).alias("text")).dropDuplicates(["id"])
    return ti.top_k(ti.stored_index(e, "elements", "id").search("merge sorted region map header"), 30)


def definitions(s, d):
    return rs.definitions(read_table(s, d, "parse_results"))


def import_names(s, d):
    return rs.import_names(read_table(s, d, "parse_results"))


def docstrings_dedented(s, d):
    e = read_table(s, d, "code_elements").where("docstring <> ''")
    return e.select("id", F.md5(tx.dedent(F.col("docstring"))).alias("doc_md5")).distinct()


def token_estimates(s, d):
    e = read_table(s, d, "code_elements").select("id", tx.token_estimate(F.col("code")).alias("tokens"), F.md5(tx.truncate_tokens(F.col("code"), 100)).alias("head_md5"))
    return e.distinct()


def file_hashes(s, d):
    return _files(s, d).where("content is not null").select("path", F.md5("content").alias("md5")).distinct()


def candidate_rows(s, d):
    """The file elements of the first ten files with a match."""
    e = _elements(s, d, "id", "type", "repo_name", "relative_path")
    return se.first_file_rows(e, se.grep(_files(s, d), r"return [a-z_]+;", limit=None)).select("id", "total_score", "found_by")


def repository_summaries(s, d):
    """What the results of each repository are, elements by their length."""
    e = _elements(s, d, "id", "type", "name", "repo_name", "relative_path", "start_line", "end_line").withColumn("score", F.col("end_line") - F.col("start_line"))
    out = ro.results_summary(e, "repo_name")
    return out.select("repo_name", "n", F.array_join("files", "|").alias("files"), F.array_join("elements", "|").alias("elements"))


def shown_contents(s, d):
    """Contents as they are shown, up to 1,500 characters."""
    out = repo.read_contents(_files(s, d), 1500)
    return out.select("path", F.md5("content").alias("content_md5"), "total_lines", "truncated").distinct()


def url_names(s, d):
    return read_table(s, d, "repositories").select("repo_name", tx.repo_name_of_url(F.col("repo_url")).alias("url_name"))


def element_url_names(s, d):
    e = read_table(s, d, "code_elements").select("repo_name", "repo_url").distinct()
    return e.select("repo_name", tx.repo_name_of_url(F.col("repo_url")).alias("url_name"))


def contained_after_best(s, d):
    """The best element of each file by its length, and none that lies within another."""
    e = _elements(s, d, "id", "type", "repo_name", "relative_path", "start_line", "end_line")
    scored = e.withColumn("score", (F.col("end_line") - F.col("start_line")).cast("double"))
    return de.drop_contained(de.best_per_file(scored.where("type <> 'file'"))).select("id")


def merged_code_graph(s, d):
    """The edges of the store and those that the joins find, as one graph."""
    call = call_edges(s, d).withColumn("graph", F.lit("call"))
    inherit = inheritance_edges(s, d).withColumn("graph", F.lit("inheritance"))
    return gr.merge_graphs(read_table(s, d, "graph_edges"), call, inherit)


def selected_files_boosted(s, d):
    """Elements scored by their length, with the key files of each repository chosen."""
    e = _elements(s, d, "id", "type", "relative_path", "start_line", "end_line")
    scored = e.where("type <> 'documentation'").select("id", F.least((F.col("end_line") - F.col("start_line") + 1) / 200.0, F.lit(1.0)).alias("score"))
    chosen = e.where("type = 'file'").where(ov.is_key_file(F.col("relative_path"))).select("id")
    return hy.merge_selected(scored, chosen).select("id", F.round("score", 6).alias("score"))


_SEARCHABLE = "len(list_filter(string_split(relative_path, '/'), lambda p: starts_with(p, '.'))) = 0 AND len(list_filter(string_split(relative_path, '/')[:-2], lambda p: p IN ('.git', 'node_modules', '__pycache__', 'dist', 'build', 'venv', 'coverage', '.claude', '.kilocode', '.agent', '.agents', '.claude-flow'))) = 0"


def _any(rules: list[str], column: str = "relative_path") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{x}')" for x in rules) + ")"


def _ignored_sql() -> str:
    out = "FALSE"
    for rule in RULES:
        if rule and not rule.startswith("#"):
            out = f"CASE WHEN {_any(pt.ignore_regexes(rule.removeprefix('!')))} THEN {'FALSE' if rule.startswith('!') else 'TRUE'} ELSE {out} END"
    return out


def _glob_sql(glob: str) -> str:
    base = "regexp_extract(relative_path, '[^/]*$')"
    return f"(regexp_matches({base}, '{pt.glob_regex(glob)}') OR regexp_matches(relative_path, '{pt.glob_regex(glob)}') OR regexp_matches({base}, '{pt.glob_regex(glob.rpartition('/')[2])}'))"


_STATS = "st AS (SELECT repo_name, count(DISTINCT relative_path) AS files, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'function') AS functions, round(avg(end_line - start_line + 1) FILTER (type = 'file'), 6) AS avg_lines, max(len(string_split(relative_path, '/')) - 1) AS max_depth FROM e GROUP BY repo_name)"
_INFO = "info AS (SELECT repo_name, count(*) AS file_count, round(sum(strlen(content)) / 1048576, 6) AS total_mb FROM f GROUP BY repo_name)"
_RANK = "CASE {0}.type WHEN 'file' THEN 3 WHEN 'class' THEN 2 WHEN 'function' THEN 1 ELSE 0 END"
_PRI = "round(least((end_line - start_line + 1) / 100.0, 1.0) * 0.4 + 0.2 + CASE type WHEN 'function' THEN 0.2 ELSE 0.15 END + 0.2 * CASE WHEN end_line - start_line + 1 < 10 THEN 0.8 WHEN end_line - start_line + 1 <= 100 THEN 1.0 WHEN end_line - start_line + 1 <= 300 THEN 0.7 ELSE 0.5 END + CASE type WHEN 'function' THEN 0.15 ELSE 0 END, 6)"
_IMPORTS = "i AS (SELECT DISTINCT file_path, x.module AS module, x.level AS level FROM (SELECT file_path, unnest(imports) AS x FROM parse_results))"
_MARK = r"^(#|//|/\*|\*)"
_PY = r"CASE WHEN ends_with(relative_path, '.py') THEN nullif(replace(regexp_replace(regexp_replace(relative_path, '\.py$', ''), '(^|/)__init__$', ''), '/', '.'), '') END"
_NAMES = "array_to_string(list_transform(coalesce({0}, []), lambda x: x.name), ', ')"

QUERIES = {
    "latest_elements": (latest_elements, f"WITH {_E} SELECT id, type, repo_name, epoch_us(received_at) AS received_us FROM e"),
    "element_counts": (element_counts, f"WITH {_E} SELECT type, count(*) AS n FROM e GROUP BY type"),
    "elements_per_file": (elements_per_file, f"WITH {_E} SELECT repo_name, relative_path, type, count(*) AS n FROM e GROUP BY ALL"),
    "repo_stats": (repo_stats, f"WITH {_E}, {_STATS} SELECT * FROM st"),
    "repo_factor": (repo_factor, f"WITH {_E}, {_STATS} SELECT repo_name, round((least(greatest(log10(files + 1) / 3, 0.5), 2) + least(greatest(coalesce(avg_lines, 0) / 200, 0.5), 2) + least(greatest(max_depth / 5, 0.5), 2)) / 3, 6) AS factor FROM st"),
    "repo_info": (repo_info, f"WITH {_F}, {_INFO} SELECT * FROM info"),
    "repositories_with_stats": (repositories_with_stats, f"WITH {_F}, {_INFO} SELECT repo_name, default_branch, coalesce(file_count, 0) AS file_count, coalesce(total_mb, 0) AS total_mb FROM repositories LEFT JOIN info USING (repo_name)"),
    "dir_ancestors": (dir_ancestors, "WITH p AS (SELECT DISTINCT repo_name, string_split(relative_path, '/') AS p FROM source_files WHERE relative_path IS NOT NULL), x AS (SELECT repo_name, p, unnest(range(1, len(p))) AS d FROM p) SELECT repo_name, array_to_string(list_slice(p, 1, d), '/') AS dir, count(*) AS n_below, count(*) FILTER (d = len(p) - 1) AS n_direct FROM x GROUP BY 1, 2"),
    "primary_language": (primary_language, "WITH p AS (SELECT DISTINCT repo_name, relative_path FROM source_files), c AS (SELECT repo_name, lower(regexp_extract(relative_path, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n FROM p GROUP BY 1, 2) SELECT repo_name, extension, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, extension) AS k FROM c) WHERE k = 1"),
    "extension_languages": (extension_languages, "WITH p AS (SELECT DISTINCT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x, path FROM source_files) SELECT m.lang, count(*) AS n FROM p LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in tx.EXTENSIONS.items()) + ") m(x, lang) USING (x) GROUP BY m.lang"),
    "containment_dedup": (containment_dedup, f"WITH {_E}, c AS (SELECT * FROM e WHERE type <> 'file') SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.repo_name = c.repo_name AND o.relative_path = c.relative_path AND o.start_line <= c.start_line AND c.end_line <= o.end_line AND (o.start_line < c.start_line OR c.end_line < o.end_line) AND {_RANK.format('o')} >= {_RANK.format('c')})"),
    "best_per_file": (best_per_file, f"WITH {_E}, c AS (SELECT *, end_line - start_line AS score FROM e WHERE start_line > 1), m AS (SELECT *, max((type = 'file')::INT) OVER (PARTITION BY repo_name, relative_path) AS has FROM c) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY repo_name, relative_path, has, CASE WHEN has = 0 THEN id END ORDER BY score DESC, id) AS k FROM m WHERE has = 0 OR type = 'file') WHERE k = 1"),
    "total_lines": (total_lines, f"WITH {_E} SELECT repo_name, sum(CASE WHEN end_line - start_line + 1 > 0 THEN end_line - start_line + 1 ELSE coalesce(len(string_split(nullif(code, ''), chr(10))), 0) END)::BIGINT AS lines FROM e GROUP BY repo_name"),
    "priority_scores": (priority_scores, f"WITH {_E} SELECT id, {_PRI} AS priority FROM e WHERE type IN ('class', 'function')"),
    "budget_prune": (budget_prune, f"WITH RECURSIVE {_E}, o AS (SELECT repo_name, id, (end_line - start_line + 1) AS lines, row_number() OVER (PARTITION BY repo_name ORDER BY {_PRI} DESC, id) AS k FROM e WHERE type IN ('class', 'function')), s(repo_name, k, id, used, taken, took, ended) AS (SELECT repo_name, k, id, greatest(lines, 0)::BIGINT, 1, TRUE, FALSE FROM o WHERE k = 1 UNION ALL SELECT o.repo_name, o.k, o.id, CASE WHEN s.used + greatest(o.lines, 0) <= 400 THEN s.used + greatest(o.lines, 0) ELSE s.used END, CASE WHEN s.used + greatest(o.lines, 0) <= 400 THEN s.taken + 1 ELSE s.taken END, s.used + greatest(o.lines, 0) <= 400, s.used + greatest(o.lines, 0) > 400 AND s.taken >= 5 FROM s JOIN o ON o.repo_name = s.repo_name AND o.k = s.k + 1 WHERE NOT s.ended) SELECT repo_name, id FROM s WHERE took"),
    "grep_regex": (grep_regex, f"SELECT DISTINCT repo_name, relative_path, len(regexp_extract_all(content, '(?i)return [a-z_]+;'))::INT AS matches FROM source_files WHERE {_SEARCHABLE} AND len(regexp_extract_all(content, '(?i)return [a-z_]+;')) > 0"),
    "grep_literal": (grep_literal, f"SELECT DISTINCT repo_name, relative_path, len(regexp_extract_all(content, '(?i)sorted\\('))::INT AS matches FROM source_files WHERE {_SEARCHABLE} AND len(regexp_extract_all(content, '(?i)sorted\\(')) > 0"),
    "grep_glob_top": (grep_glob_top, f"SELECT DISTINCT repo_name, relative_path, len(regexp_extract_all(content, '(?i)def \\w+'))::INT AS matches FROM source_files WHERE {_SEARCHABLE} AND {_glob_sql('src/*.py')} AND len(regexp_extract_all(content, '(?i)def \\w+')) > 0 ORDER BY relative_path, repo_name LIMIT 30"),
    "grep_lines": (grep_lines, "WITH l AS (SELECT DISTINCT repo_name, relative_path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM source_files), h AS (SELECT repo_name, relative_path, line_no, substring(line, 1, 200) AS line FROM l WHERE regexp_matches(line, '(?i)lambda ')) SELECT repo_name, relative_path, line_no::INT AS line_no, md5(line) AS line_md5 FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, relative_path ORDER BY line_no) AS k FROM h) WHERE k <= 20"),
    "glob_files": (glob_files, f"SELECT DISTINCT repo_name, relative_path FROM source_files WHERE {_glob_sql('core/**/*.go')}"),
    "ignore_rules": (ignore_rules, f"SELECT DISTINCT repo_name, relative_path FROM source_files WHERE {_ignored_sql()}"),
    "list_directory": (list_directory, "WITH p AS (SELECT DISTINCT repo_name, string_split(substring(relative_path, 5), '/') AS p FROM source_files WHERE starts_with(relative_path, 'src/')) SELECT repo_name, p[1] AS name, CASE WHEN len(p) > 1 THEN 'directory' ELSE 'file' END AS kind, count(*) AS n_files FROM (SELECT DISTINCT * FROM p) WHERE NOT starts_with(p[1], '.') GROUP BY 1, 2, 3"),
    "list_files": (list_files, "SELECT DISTINCT repo_name, relative_path FROM source_files WHERE contains(lower(relative_path), 'token_span')"),
    "elements_of_file": (elements_of_file, f"WITH {_E}, w AS (SELECT DISTINCT path FROM (SELECT relative_path AS path, row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(length(code), 0) DESC, relative_path) AS k FROM e WHERE type = 'file') WHERE k = 1) SELECT DISTINCT id, path FROM e JOIN w ON ends_with(relative_path, path) OR ends_with(path, relative_path)"),
    "browse_file": (browse_file, f"WITH {_E} SELECT id, md5(code) AS code_md5 FROM e WHERE type = 'file' AND ends_with(relative_path, '.rs')"),
    "elements_with_matches": (elements_with_matches, f"WITH {_E}, g AS (SELECT DISTINCT relative_path AS path FROM source_files WHERE {_SEARCHABLE} AND regexp_matches(content, '(?i)def flush_\\w+')) SELECT DISTINCT id FROM e JOIN g ON ends_with(relative_path, path) OR ends_with(path, relative_path)"),
    "skim_elements": (skim_elements, f"WITH {_E} SELECT id, name, start_line, end_line FROM e WHERE type IN ('class', 'function') AND ends_with(relative_path, '.py')"),
    "file_lines": (file_lines, f"WITH {_F}, l AS (SELECT path, content, string_split(content, chr(10)) AS x FROM f WHERE content IS NOT NULL) SELECT path, CASE WHEN content = '' THEN 0 WHEN right(content, 1) = chr(10) THEN len(x) - 1 ELSE len(x) END::INT AS lines, len(list_filter(x, lambda y: regexp_matches(trim(y), '{_MARK}')))::INT AS comments, len(list_filter(x, lambda y: trim(y) <> '' AND NOT regexp_matches(trim(y), '{_MARK}')))::INT AS code_rows FROM l"),
    "keyword_complexity": (keyword_complexity, f"WITH {_E} SELECT id, (1 + " + " + ".join(f"len(regexp_extract_all(code, '\\b{w}\\b'))" for w in tx.BRANCH_WORDS) + ")::INT AS complexity FROM e WHERE type = 'function' AND code IS NOT NULL"),
    "module_paths": (module_paths, f"SELECT DISTINCT path, {_PY} AS module FROM source_files WHERE {_PY} IS NOT NULL"),
    "imports_flat": (imports_flat, f"WITH {_IMPORTS} SELECT module, count(DISTINCT file_path) AS files FROM i GROUP BY module"),
    "import_edges": (import_edges, f"WITH p AS (SELECT DISTINCT repo_name, path, relative_path FROM source_files), m AS (SELECT repo_name, target, min(path) AS dst FROM (SELECT repo_name, path, {_PY} AS target FROM p) WHERE target IS NOT NULL GROUP BY 1, 2), {_IMPORTS}, a AS (SELECT repo_name, file_path AS src, module, coalesce(level, 0) AS up, string_split(regexp_replace(relative_path, '/?[^/]*$', ''), '/') AS folder FROM i JOIN p ON p.path = i.file_path WHERE module IS NOT NULL), t AS (SELECT repo_name, src, CASE WHEN up > 0 THEN array_to_string(list_concat(list_filter(list_slice(folder, 1, greatest(len(folder) - up + 1, 0)), lambda x: x <> ''), list_filter([regexp_replace(module, '^\\.+', '')], lambda x: x <> '')), '.') ELSE module END AS target FROM a) SELECT DISTINCT src, dst FROM t JOIN m USING (repo_name, target) WHERE src <> dst"),
    "loose_import_edges": (loose_import_edges, f"WITH {_IMPORTS}, p AS (SELECT DISTINCT repo_name, path FROM source_files), n AS (SELECT repo_name, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem, min(path) AS dst FROM p GROUP BY 1, 2), a AS (SELECT file_path, regexp_extract(regexp_replace(module, '\\.\\w+$', ''), '[^./\\\\:]*$') AS stem FROM i WHERE module IS NOT NULL UNION SELECT file_path, regexp_extract(module, '[^./\\\\:]*$') FROM i WHERE module IS NOT NULL) SELECT DISTINCT file_path AS src, dst FROM a JOIN p ON p.path = a.file_path JOIN n USING (repo_name, stem) WHERE stem <> '' AND file_path <> dst"),
    "inheritance_edges": (inheritance_edges, f"WITH {_E}, b AS (SELECT DISTINCT file_path, c.name AS name, unnest(c.bases) AS base FROM (SELECT file_path, unnest(classes) AS c FROM parse_results)), t AS (SELECT name, max(id) AS dst FROM e WHERE type = 'class' GROUP BY name) SELECT DISTINCT x.id AS src, t.dst FROM b JOIN (SELECT * FROM e WHERE type = 'class') x USING (file_path, name) JOIN t ON t.name = b.base WHERE x.id <> t.dst"),
    "call_edges": (call_edges, f"WITH {_E}, fn AS (SELECT file_path, name, id FROM e WHERE type = 'function'), c AS (SELECT DISTINCT file_path, f.name AS caller, unnest(f.calls) AS callee FROM (SELECT file_path, unnest(functions) AS f FROM parse_results)), s AS (SELECT c.file_path, fn.id AS src, callee FROM c JOIN fn ON fn.file_path = c.file_path AND fn.name = c.caller), near AS (SELECT file_path, name AS callee, max(id) AS near FROM fn GROUP BY 1, 2), far AS (SELECT name AS callee, max(id) AS far FROM fn GROUP BY 1) SELECT DISTINCT src, coalesce(near, far) AS dst FROM s LEFT JOIN near USING (file_path, callee) LEFT JOIN far USING (callee) WHERE coalesce(near, far) IS NOT NULL AND src <> coalesce(near, far)"),
    "built_elements": (built_elements, None),
    "last_definitions": (last_definitions, f"WITH {_E} SELECT name, max(id) AS id FROM e WHERE type = 'function' GROUP BY name"),
    "fuzzy_repositories": (fuzzy_repositories, "WITH r AS (SELECT repo_name AS name, list_distinct(list_filter(regexp_split_to_array(lower(repo_name), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM repositories), s AS (SELECT name, len(list_intersect(w, ['amber', 'indexer', 'tool'])) / greatest(len(list_distinct(list_concat(w, ['amber', 'indexer', 'tool']))), 1) AS score FROM r), t AS (SELECT name, CASE WHEN lower(name) = 'amber indexer tool' THEN 1 WHEN contains(lower(name), 'amber indexer tool') OR contains('amber indexer tool', lower(name)) THEN 2 WHEN score >= 0.5 THEN 3 END AS tier, round(score, 6) AS score FROM s) SELECT * FROM t WHERE tier IS NOT NULL"),
    "fuzzy_elements": (fuzzy_elements, "WITH r AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM (SELECT DISTINCT name FROM code_elements WHERE type IN ('class', 'function'))), s AS (SELECT name, len(list_intersect(w, ['resolve', 'region', 'map'])) / greatest(len(list_distinct(list_concat(w, ['resolve', 'region', 'map']))), 1) AS score FROM r), t AS (SELECT name, CASE WHEN lower(name) = 'resolve region map' THEN 1 WHEN contains(lower(name), 'resolve region map') OR contains('resolve region map', lower(name)) THEN 2 WHEN score >= 0.5 THEN 3 END AS tier, round(score, 6) AS score FROM s) SELECT * FROM t WHERE tier IS NOT NULL"),
    "functions_without_elements": (functions_without_elements, "SELECT DISTINCT file_path, f.name AS name FROM (SELECT file_path, unnest(functions) AS f FROM parse_results) p WHERE NOT EXISTS (SELECT 1 FROM code_elements e WHERE e.type = 'function' AND e.file_path = p.file_path AND e.name = p.f.name)"),
    "file_summaries": (file_summaries, f"SELECT DISTINCT file_path, concat_ws('; ', 'Lines: ' || coalesce(total_lines, 0), 'Classes: ' || nullif({_NAMES.format('classes')}, ''), 'Functions: ' || nullif({_NAMES.format('functions')}, '')) AS summary FROM parse_results"),
    "bm25_elements": (bm25_elements, f"WITH {_E}, t AS (SELECT id, concat_ws(' ', nullif(name, ''), nullif(type, ''), nullif(language, ''), nullif(relative_path, ''), nullif(docstring, ''), nullif(signature, ''), nullif(summary, ''), nullif(code, '')) AS text FROM e), tok AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 1) AS words FROM t), st AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avgdl FROM tok), u AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM tok), tf AS (SELECT id, dl, term, count(*) AS tf FROM u GROUP BY ALL), raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM tf, st GROUP BY term, n), w AS (SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw), r AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN w USING (term), st WHERE term IN ('merge', 'sorted', 'region', 'map', 'header') GROUP BY id) SELECT id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 30"),
    "definitions": (definitions, "WITH d AS (SELECT file_path, 'class' AS kind, '' AS parent, x.name AS name, x.start_line AS start_line, x.end_line AS end_line FROM (SELECT file_path, unnest(classes) AS x FROM parse_results) UNION SELECT file_path, 'function', coalesce(x.class_name, ''), x.name, x.start_line, x.end_line FROM (SELECT file_path, unnest(functions) AS x FROM parse_results)) SELECT concat_ws('::', file_path, nullif(parent, ''), name) AS definition_id, * FROM d WHERE file_path IS NOT NULL AND name IS NOT NULL"),
    "import_names": (import_names, "WITH i AS (SELECT file_path, unnest(imports) AS x FROM parse_results) SELECT DISTINCT file_path, x.line AS line, x.module AS module, unnest(CASE WHEN len(x.names) > 0 THEN x.names ELSE [NULL] END) AS name, coalesce(x.level, 0) AS level, coalesce(unnest(CASE WHEN len(x.names) > 0 THEN x.names ELSE [NULL] END) = '*', FALSE) AS wildcard FROM i"),
    "docstrings_dedented": (
        docstrings_dedented,
        "WITH d AS (SELECT DISTINCT id, string_split(replace(docstring, chr(13), ''), chr(10)) AS l FROM code_elements WHERE docstring <> ''), i AS (SELECT id, l, coalesce(list_min(list_transform(list_filter(l[2:], lambda x: regexp_matches(x, '[^ \\t]')), lambda x: length(regexp_extract(x, '^[ \\t]*')))), 0) AS n FROM d), "
        "w AS (SELECT id, array_to_string(list_concat([regexp_replace(l[1], '^[ \\t]+', '')], list_transform(l[2:], lambda x: substring(x, n + 1))), chr(10)) AS t FROM i) SELECT id, md5(regexp_replace(regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g')) AS doc_md5 FROM w",
    ),
    "token_estimates": (token_estimates, "SELECT DISTINCT id, coalesce(ceil(length(code) / 4.0), 0)::INT AS tokens, md5(substring(code, 1, 400)) AS head_md5 FROM code_elements"),
    "file_hashes": (file_hashes, "SELECT DISTINCT path, md5(content) AS md5 FROM source_files WHERE content IS NOT NULL"),
    "candidate_rows": (candidate_rows, f"WITH {_E}, g AS (SELECT DISTINCT repo_name, relative_path FROM source_files WHERE {_SEARCHABLE} AND regexp_matches(content, '(?i)return [a-z_]+;') ORDER BY relative_path, repo_name LIMIT 10) SELECT id, 0.8::DOUBLE AS total_score, 'agent' AS found_by FROM e JOIN g USING (repo_name, relative_path) WHERE type = 'file'"),
    "repository_summaries": (repository_summaries, f"WITH {_E}, p AS (SELECT repo_name, relative_path, row_number() OVER (PARTITION BY repo_name ORDER BY relative_path) AS k FROM (SELECT DISTINCT repo_name, relative_path FROM e)), b AS (SELECT repo_name, concat_ws(' ', type, name) AS label, row_number() OVER (PARTITION BY repo_name ORDER BY end_line - start_line DESC, id) AS k FROM e), n AS (SELECT repo_name, count(*) AS n FROM e GROUP BY 1), f AS (SELECT repo_name, string_agg(relative_path, '|' ORDER BY k) AS files FROM p WHERE k <= 10 GROUP BY 1), l AS (SELECT repo_name, string_agg(label, '|' ORDER BY k) AS elements FROM b WHERE k <= 15 GROUP BY 1) SELECT * FROM n LEFT JOIN f USING (repo_name) LEFT JOIN l USING (repo_name)"),
    "shown_contents": (shown_contents, "SELECT DISTINCT path, md5(substring(content, 1, 1500)) AS content_md5, len(string_split(substring(content, 1, 1500), chr(10)))::INT AS total_lines, length(content) >= 1500 AS truncated FROM source_files WHERE content IS NOT NULL"),
    "url_names": (url_names, "SELECT repo_name, regexp_replace(regexp_extract(regexp_replace(repo_url, '/+$', ''), '[^/:]*$'), '\\.git$', '') AS url_name FROM repositories"),
    "element_url_names": (element_url_names, "SELECT repo_name, regexp_replace(regexp_extract(regexp_replace(repo_url, '/+$', ''), '[^/:]*$'), '\\.git$', '') AS url_name FROM (SELECT DISTINCT repo_name, repo_url FROM code_elements)"),
    "contained_after_best": (contained_after_best, f"WITH {_E}, c AS (SELECT * FROM e WHERE type <> 'file') SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.repo_name = c.repo_name AND o.relative_path = c.relative_path AND o.start_line <= c.start_line AND c.end_line <= o.end_line AND (o.start_line < c.start_line OR c.end_line < o.end_line) AND {_RANK.format('o')} >= {_RANK.format('c')})"),
    "selected_files_boosted": (selected_files_boosted, f"WITH {_E}, r AS (SELECT id, least((end_line - start_line + 1) / 200.0, 1.0) AS score, 0 AS chosen FROM e WHERE type <> 'documentation' UNION ALL SELECT id, 0.8, 1 FROM e WHERE type = 'file' AND ({' OR '.join(f"contains(lower(regexp_extract(relative_path, '[^/]*$')), '{k}')" for k in ov.KEY_NAMES)})) SELECT id, round(max(score) * CASE WHEN max(chosen) = 1 THEN 1.3 ELSE 1 END, 6) AS score FROM r GROUP BY id"),
}
QUERIES["merged_code_graph"] = (
    merged_code_graph,
    f"SELECT DISTINCT graph, src, dst FROM (SELECT graph, src, dst FROM graph_edges UNION ALL SELECT 'call', src, dst FROM ({QUERIES['call_edges'][1]}) UNION ALL SELECT 'inheritance', src, dst FROM ({QUERIES['inheritance_edges'][1]})) WHERE src <> dst",
)
