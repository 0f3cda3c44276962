"""Globs and ignore rules as regular expressions, made when the plan is made and evaluated by Spark."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: * and ? stay within a path component, ** crosses."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) if not c.isalnum() and c not in "/_" else c)
        i += 1
    return f"^{''.join(out)}$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def glob_match(path: Column, glob: str) -> Column:
    """The glob on the name, on the whole path, or its last component on the name."""
    name = basename(path)
    return name.rlike(glob_regex(glob)) | path.rlike(glob_regex(glob)) | name.rlike(glob_regex(glob.rpartition("/")[2]))


def ignore_regexes(pattern: str) -> list[str]:
    """What a single ignore pattern (without its !) matches, as expressions on the relative path."""
    bare = pattern.strip("/")
    esc = glob_regex(bare)[1:-1]
    if pattern.endswith("/"):
        return [rf"^{esc}/"] if "/" in bare else [rf"(^|/){esc}/"]
    out = [rf"^{esc}$", rf"^{esc}/"]
    if "/" not in bare:
        out.append(rf"(^|/){esc}$")
        if not re.search(r"[*?\[]", bare):
            out.append(rf"(^|/){esc}/")
    return out


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether the last rule that matches ignores the path; a rule with ! takes a path back. Blank rules and comments are skipped."""
    verdict = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, bare = rule.startswith("!"), rule.removeprefix("!")
        hit = path.rlike("|".join(f"(?:{rx})" for rx in ignore_regexes(bare)))
        verdict = F.when(hit, F.lit(not negated)).otherwise(verdict)
    return verdict
