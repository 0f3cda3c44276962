"""Registered queries that resolve symbols and calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.operators import symbols as sy
from codescout.plans.code import _E, _PY
from codescout.sources.tables import read_table


def _elements(s, d):
    columns = ["id", "type", "name", "file_path", "repo_name"]
    return read_table(s, d, "code_elements").select(*columns, F.create_map(F.lit("class_name"), F.col("metadata")["class_name"]).alias("metadata"))


def _files(s, d, *more):
    return read_table(s, d, "source_files").select("repo_name", "path", "relative_path", *more)


def _parsed(s, d):
    return read_table(s, d, "parse_results").select("file_path", "classes", "functions", "imports")


def symbol_exports(s, d):
    return sy.exports(_elements(s, d))


def innermost_scopes(s, d):
    """How many lines of each file lie innermost in each scope."""
    return sy.scope_lines(_parsed(s, d)).groupBy("file_path", "scope_type", "scope").agg(F.count(F.lit(1)).alias("lines"))


def call_sites(s, d):
    return sy.call_sites(_files(s, d, "content"))


def instance_variables(s, d):
    return sy.instance_types(_files(s, d, "content"), _parsed(s, d))


def symbol_inheritance(s, d):
    return sy.resolved_inheritance(_elements(s, d), _files(s, d), _parsed(s, d))


def symbol_calls(s, d):
    return sy.resolve_calls(_elements(s, d), _files(s, d, "content"), _parsed(s, d))


def modules_without_files(s, d):
    return sy.modules_without_files(_files(s, d), _parsed(s, d))


def index_coverage(s, d):
    return sy.index_coverage(_files(s, d), _elements(s, d))


def _q(text: str) -> str:
    return text.replace("'", "''")


_EXPORTS = "ex AS (SELECT file_path, symbol, max(id) AS id FROM (SELECT file_path, CASE WHEN type = 'function' THEN concat_ws('.', nullif(metadata['class_name'], ''), name) ELSE name END AS symbol, id FROM e WHERE type IN ('class', 'function') AND name IS NOT NULL) GROUP BY 1, 2)"
_MODULES = f"pf AS (SELECT DISTINCT repo_name, path, relative_path FROM source_files), mo AS (SELECT repo_name, target, min(path) AS dst FROM (SELECT repo_name, path, {_PY} AS target FROM pf) WHERE target IS NOT NULL GROUP BY 1, 2)"
_TARGETS = (
    "ii AS (SELECT DISTINCT file_path AS src, x.module AS module, x.names AS names, x.alias AS alias, x.is_from AS is_from, coalesce(x.level, 0) AS up FROM (SELECT file_path, unnest(imports) AS x FROM parse_results)), "
    "ta AS (SELECT repo_name, src, module, names, alias, is_from, CASE WHEN up > 0 THEN array_to_string(list_concat(list_filter(list_slice(string_split(regexp_replace(relative_path, '/?[^/]*$', ''), '/'), 1, greatest(len(string_split(regexp_replace(relative_path, '/?[^/]*$', ''), '/')) - up + 1, 0)), lambda x: x <> ''), list_filter([regexp_replace(module, '^\\.+', '')], lambda x: x <> '')), '.') ELSE module END AS target FROM ii JOIN pf ON pf.path = src WHERE module IS NOT NULL)"
)
_BOUND = (
    "im AS (SELECT src AS file_path, dst AS target_path, module, names, nullif(alias, '') AS alias, coalesce(is_from, FALSE) AS is_from FROM ta JOIN mo USING (repo_name, target) WHERE src <> dst), "
    "bo AS (SELECT file_path, unnest(names) AS bound, target_path, unnest(names) AS symbol FROM im WHERE is_from UNION SELECT file_path, alias, target_path, names[1] FROM im WHERE is_from AND alias IS NOT NULL UNION SELECT file_path, coalesce(alias, module), target_path, NULL FROM im WHERE NOT is_from)"
)
_RESOLVED = (
    "wy AS (SELECT file_path, ref, 0 AS way, file_path AS at, ref AS symbol FROM rf "
    "UNION ALL SELECT file_path, ref, 1, target_path, symbol FROM rf JOIN bo USING (file_path) WHERE bound = ref AND symbol IS NOT NULL "
    "UNION ALL SELECT file_path, ref, 2, target_path, symbol || '.' || regexp_replace(ref, '^[^.]*\\.', '') FROM rf JOIN bo USING (file_path) WHERE contains(ref, '.') AND bound = string_split(ref, '.')[1] AND symbol IS NOT NULL "
    "UNION ALL SELECT file_path, ref, 3, target_path, string_split(ref, '.')[-1] FROM rf JOIN bo USING (file_path) WHERE contains(ref, '.') AND bound = regexp_replace(ref, '\\.[^.]*$', '') AND symbol IS NULL), "
    "rs AS (SELECT file_path, ref, ['local', 'imported', 'member', 'module'][way + 1] AS how, id FROM (SELECT wy.file_path, ref, way, id, row_number() OVER (PARTITION BY wy.file_path, ref ORDER BY way, id) AS k FROM wy JOIN ex ON ex.file_path = wy.at AND ex.symbol = wy.symbol) WHERE k = 1)"
)
_SCOPES = (
    "sp AS (SELECT DISTINCT file_path, f.start_line AS s, f.end_line AS e, 'function' AS t, f.name AS n, nullif(f.class_name, '') AS c FROM (SELECT file_path, unnest(functions) AS f FROM parse_results) UNION SELECT file_path, f.start_line, f.end_line, 'class', f.name, f.name FROM (SELECT file_path, unnest(classes) AS f FROM parse_results)), "
    "sl AS (SELECT file_path, line_no, t AS scope_type, n AS scope, c AS class_name FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_no ORDER BY s DESC, e, t DESC, n DESC, c DESC NULLS LAST) AS k FROM (SELECT *, unnest(range(s, e + 1)) AS line_no FROM sp WHERE s <= e)) WHERE k = 1)"
)
_LINES = (
    "tx AS (SELECT DISTINCT path AS file_path, string_split_regex(content, '\\r?\\n') AS l FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL), "
    "ln AS (SELECT file_path, line_no, regexp_replace(regexp_replace(line, '" + _q(sy.QUOTED) + "', '\"\"', 'g'), '" + sy.COMMENT + "', '') AS line FROM (SELECT file_path, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM tx))"
)
_CALLS = (
    f"ca AS (SELECT file_path, line_no, unnest(regexp_extract_all(line, '{sy.CALL}')) AS c FROM ln), cn AS (SELECT file_path, line_no, regexp_replace(regexp_replace(c, '^new[ \\t]+', ''), '\\($', '') AS name FROM ca WHERE NOT regexp_matches(c, '{sy.DEFINES}')), "
    "cs AS (SELECT DISTINCT file_path, line_no, regexp_replace(regexp_replace(name, '[^.]*$', ''), '\\.$', '') AS base, string_split(name, '.')[-1] AS callee FROM cn WHERE string_split(name, '.')[-1] NOT IN ('', " + ", ".join(f"'{w}'" for w in sy.NOT_CALLS) + "))"
)
_MADE = f"va AS (SELECT file_path, CASE WHEN scope_type = 'function' THEN scope ELSE '' END AS scope, variable, min(made) AS class_name FROM (SELECT file_path, line_no, regexp_extract(line, '{sy.MADE}', 1) AS variable, regexp_extract(line, '{sy.MADE}', 2) AS made FROM ln WHERE regexp_matches(line, '{sy.MADE}')) LEFT JOIN sl USING (file_path, line_no) GROUP BY 1, 2, 3)"
_OWN = ", ".join(f"'{w}'" for w in sy.OWN)

QUERIES = {
    "symbol_exports": (symbol_exports, f"WITH {_E}, {_EXPORTS} SELECT * FROM ex"),
    "innermost_scopes": (innermost_scopes, f"WITH {_SCOPES} SELECT file_path, scope_type, scope, count(*) AS lines FROM sl GROUP BY ALL"),
    "call_sites": (call_sites, f"WITH {_LINES}, {_CALLS} SELECT file_path, line_no::INT AS line_no, base, callee, CASE WHEN base = '' THEN 'simple' ELSE 'attribute' END AS call_type FROM cs"),
    "instance_variables": (instance_variables, f"WITH {_LINES}, {_SCOPES}, {_MADE} SELECT * FROM va"),
    "symbol_inheritance": (
        symbol_inheritance,
        f"WITH {_E}, {_EXPORTS}, {_MODULES}, {_TARGETS}, {_BOUND}, cl AS (SELECT repo_name, file_path, name, id FROM e WHERE type = 'class'), ba AS (SELECT DISTINCT file_path, c.name AS name, unnest(c.bases) AS ref FROM (SELECT file_path, unnest(classes) AS c FROM parse_results)), "
        f"aq AS (SELECT cl.repo_name, file_path, cl.id AS src, ref FROM ba JOIN cl USING (file_path, name)), rf AS (SELECT DISTINCT file_path, ref FROM aq WHERE ref <> ''), {_RESOLVED}, sr AS (SELECT repo_name, name AS ref, min(id) AS far FROM cl GROUP BY 1, 2) "
        "SELECT src, coalesce(rs.id, far) AS dst, min(CASE WHEN rs.id IS NULL THEN 'repository' ELSE how END) AS how FROM aq LEFT JOIN rs USING (file_path, ref) LEFT JOIN sr USING (repo_name, ref) WHERE coalesce(rs.id, far) <> src GROUP BY 1, 2",
    ),
    "symbol_calls": (
        symbol_calls,
        f"WITH {_E}, {_EXPORTS}, {_MODULES}, {_TARGETS}, {_BOUND}, {_LINES}, {_SCOPES}, {_CALLS}, {_MADE}, an AS (SELECT file_path, variable AS base, min(class_name) AS wide FROM va GROUP BY 1, 2), "
        "pl AS (SELECT DISTINCT file_path, coalesce(scope_type, 'file') AS caller_type, scope AS caller, CASE WHEN scope_type = 'function' THEN scope ELSE '' END AS scope, class_name AS own, base, callee FROM cs LEFT JOIN sl USING (file_path, line_no)), "
        f"aq AS (SELECT DISTINCT pl.file_path, caller_type, caller, CASE WHEN pl.base = '' THEN callee WHEN pl.base IN ({_OWN}) THEN concat_ws('.', own, callee) ELSE coalesce(va.class_name, wide, pl.base) || '.' || callee END AS ref FROM pl LEFT JOIN va ON va.file_path = pl.file_path AND va.scope = pl.scope AND va.variable = pl.base LEFT JOIN an ON an.file_path = pl.file_path AND an.base = pl.base), "
        f"rf AS (SELECT DISTINCT file_path, ref FROM aq WHERE ref <> ''), {_RESOLVED}, wi AS (SELECT file_path, type AS caller_type, name AS caller, max(id) AS inn FROM e WHERE type IN ('class', 'function') GROUP BY 1, 2, 3), ou AS (SELECT file_path, max(id) AS outr FROM e WHERE type = 'file' GROUP BY 1) "
        "SELECT coalesce(inn, outr) AS src, rs.id AS dst, min(how) AS how FROM aq JOIN rs USING (file_path, ref) LEFT JOIN wi USING (file_path, caller_type, caller) LEFT JOIN ou USING (file_path) WHERE coalesce(inn, outr) <> rs.id GROUP BY 1, 2",
    ),
    "modules_without_files": (modules_without_files, f"WITH {_MODULES}, {_TARGETS} SELECT repo_name, target, count(DISTINCT src) AS n_files FROM ta WHERE target <> '' AND regexp_matches(src, '(?i)\\.pyx?$') AND NOT EXISTS (SELECT 1 FROM mo WHERE mo.repo_name = ta.repo_name AND mo.target = ta.target) GROUP BY 1, 2"),
    "index_coverage": (
        index_coverage,
        f"WITH {_E}, {_EXPORTS}, {_MODULES}, sy AS (SELECT file_path AS path, count(*) AS n FROM ex GROUP BY 1), nm AS (SELECT repo_name, count(*) AS n_modules FROM mo GROUP BY 1) "
        "SELECT repo_name, count(*) AS n_files, coalesce(any_value(n_modules), 0) AS n_modules, coalesce(sum(n), 0)::BIGINT AS n_symbols, round(count(n) / count(*), 6) AS coverage FROM (SELECT DISTINCT repo_name, path FROM pf WHERE path IS NOT NULL) LEFT JOIN sy USING (path) LEFT JOIN nm USING (repo_name) GROUP BY repo_name",
    ),
}
