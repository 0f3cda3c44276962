"""Registered queries that describe repositories and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.operators import overview as ov
from codescout.plans.code import _SEARCHABLE
from codescout.sources.tables import read_table

WORDS = ["checksum", "ledger", "a+b"]


def _files(s, d, *more):
    return read_table(s, d, "source_files").select("repo_name", "path", "relative_path", *more)


def key_files(s, d):
    return ov.key_files(_files(s, d))


def files_by_extension(s, d):
    return ov.files_by_extension(_files(s, d))


def readmes(s, d):
    return ov.readmes(_files(s, d))


def project_kinds(s, d):
    return ov.project_kinds(_files(s, d))


def tree_lines(s, d):
    return ov.tree_lines(_files(s, d))


def largest_directories(s, d):
    return ov.largest_directories(_files(s, d), 3)


def file_outlines(s, d):
    """Of the first hundred lines, as its SQL has it."""
    return ov.outline(_files(s, d, "content"), 100).withColumn("name", F.md5("name"))


def include_imports(s, d):
    return ov.includes(_files(s, d, "content"))


def grep_any(s, d):
    return ov.grep_any(_files(s, d, "content"), WORDS)


def answer_sources(s, d):
    return ov.answer_sources(read_table(s, d, "code_elements"))


def stripped_paths(s, d):
    """Whole paths below the folder named like their repository, and whether they stay there."""
    below = ov.strip_repository(F.col("path"), F.col("repo_name"))
    return _files(s, d).where("path is not null").select("path", below.alias("below"), ov.safe_path(below).alias("safe")).distinct()


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_P = "p AS (SELECT DISTINCT repo_name, relative_path, regexp_extract(relative_path, '[^/]*$') AS base, lower(regexp_extract(relative_path, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM source_files WHERE relative_path IS NOT NULL)"
_L = "l AS (SELECT path, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS line_no FROM (SELECT DISTINCT path, {0} AS s FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL))"
_SPLIT = "string_split(content, chr(10))"
_ANY = "(?i)" + "|".join(w.replace("+", "\\+") for w in WORDS)
_SKIPS = ", ".join(f"'{x}'" for x in ov.TREE_SKIPS)
_STEPS = "list_transform(string_split(below, '/'), lambda p: CASE WHEN p = '..' THEN -1 WHEN p IN ('', '.') THEN 0 ELSE 1 END)"

QUERIES = {
    "key_files": (key_files, f"WITH {_P} SELECT repo_name, relative_path FROM p WHERE {_contains('lower(base)', ov.KEY_NAMES)}"),
    "files_by_extension": (files_by_extension, f"WITH {_P} SELECT repo_name, extension, count(*) AS n FROM p GROUP BY ROLLUP (repo_name, extension)"),
    "readmes": (readmes, f"WITH {_P} SELECT repo_name, relative_path FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY len(string_split(relative_path, '/')), lower(relative_path), relative_path) AS k FROM p WHERE regexp_matches(base, '{ov.README}')) WHERE k = 1"),
    "project_kinds": (
        project_kinds,
        f"WITH {_P}, f AS (SELECT repo_name, bool_or(contains(lower(base), 'package.json')) AS node, bool_or({_contains('lower(base)', ['requirements.txt', 'setup.py'])}) AS py, bool_or(extension = 'tsx') AS tsx, bool_or(extension = 'java' OR contains(lower(base), 'android')) AS java, bool_or(contains(lower(base), 'dockerfile')) AS docker FROM p GROUP BY 1) "
        "SELECT repo_name, CASE WHEN node AND tsx THEN 'React web application' WHEN node THEN 'Node.js application' WHEN py THEN 'Python application' WHEN java THEN 'Android application' WHEN docker THEN 'containerized application' ELSE 'software project' END AS kind FROM f",
    ),
    "tree_lines": (tree_lines, f"WITH {_P}, a AS (SELECT repo_name, string_split(relative_path, '/') AS x FROM p), d AS (SELECT DISTINCT repo_name, list_slice(x, 1, depth) AS d, depth FROM (SELECT *, unnest(range(1, least(len(x) - 1, 5) + 1)) AS depth FROM a)) SELECT repo_name, array_to_string(d, '/') AS dir, depth::INT AS depth, repeat('  ', depth - 1) || d[-1] || '/' AS line FROM d WHERE len(list_filter(d, lambda y: y IN ({_SKIPS}) OR starts_with(y, '.'))) = 0"),
    "largest_directories": (largest_directories, f"WITH {_P}, n AS (SELECT repo_name, regexp_replace(relative_path, '/?[^/]*$', '') AS dir, count(*) AS n FROM p GROUP BY 1, 2) SELECT repo_name, dir, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, dir) AS k FROM n) WHERE k <= 3"),
    "file_outlines": (
        file_outlines,
        f"WITH {_L.format(f'list_slice({_SPLIT}, 1, 100)')}, x AS (SELECT path, line_no, regexp_extract(line, '{ov.OUTLINE}', 1) AS a, regexp_extract(line, '{ov.OUTLINE}', 2) AS b, regexp_extract(line, '{ov.OUTLINE}', 3) AS c, regexp_extract(line, '{ov.OUTLINE}', 4) AS d, trim(regexp_extract(line, '{ov.IMPORT}', 1)) AS i FROM l WHERE regexp_matches(line, '{ov.OUTLINE}') OR regexp_matches(line, '{ov.IMPORT}')) "
        "SELECT DISTINCT path, line_no::INT AS line_no, CASE WHEN a <> '' THEN 'class' WHEN d <> '' THEN 'function' ELSE 'import' END AS kind, md5(CASE WHEN a <> '' THEN b WHEN d <> '' THEN d ELSE i END) AS name, c <> '' AS is_async FROM x",
    ),
    "include_imports": (
        include_imports,
        f"WITH {_L.format(_SPLIT)}, x AS (SELECT path, line_no, line, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM l), m AS (SELECT path, line_no::INT AS line_no, CASE WHEN e = 'rs' THEN trim(regexp_extract(line, '{ov.USE}', 1)) ELSE regexp_extract(line, '{ov.INCLUDE}', 1) END AS module, CASE WHEN e = 'rs' THEN 'use' ELSE 'include' END AS kind FROM x WHERE e IN ('c', 'h', 'cc', 'cpp', 'hpp', 'cxx', 'rs')) SELECT DISTINCT * FROM m WHERE module <> ''",
    ),
    "grep_any": (grep_any, f"WITH h AS (SELECT repo_name, relative_path, coalesce(len(regexp_extract_all(content, '{_ANY}')), 0)::INT AS matches, regexp_matches(regexp_extract(relative_path, '[^/]*$'), '{_ANY}') AS named FROM source_files WHERE relative_path IS NOT NULL AND {_SEARCHABLE}) SELECT DISTINCT repo_name, relative_path, CASE WHEN matches > 0 AND named THEN 'both' WHEN named THEN 'filename' ELSE 'content' END AS match_type, matches FROM h WHERE matches > 0 OR named"),
    "answer_sources": (answer_sources, "SELECT DISTINCT id, '[' || coalesce(type, '') || '] ' || coalesce(name, '') || ' (' || coalesce(relative_path, '') || ':L' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') || ')' AS source FROM code_elements"),
    "stripped_paths": (
        stripped_paths,
        "WITH x AS (SELECT DISTINCT path, lower(repo_name) AS r, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '') AS p FROM source_files WHERE path IS NOT NULL), y AS (SELECT path, CASE WHEN list_position(list_transform(p, lambda z: lower(z)), r) > 0 THEN array_to_string(list_slice(p, list_position(list_transform(p, lambda z: lower(z)), r) + 1, len(p)), '/') ELSE path END AS below FROM x) "
        f"SELECT path, below, NOT starts_with(below, '/') AND NOT regexp_matches(below, '^[A-Za-z]:') AND list_min(list_transform(range(1, len({_STEPS}) + 1), lambda i: list_sum(list_slice({_STEPS}, 1, i)))) >= 0 AS safe FROM y",
    ),
}
