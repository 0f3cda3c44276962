"""Problems 1 and 3: source files that do not parse, and source files that nobody wrote by hand.

Both look at each file once, where it lies, and send on only its path, verdict and hashes. For problem 3 the
files are the leaves of their repositories' directory trees, and the known third-party files are the trees of
one more, unrelated repository for each library. Merkle hashes go bottom-up: from the lines of a file to the
file, and from the files to all directories above them. What unrelated repositories share, a directory, a file
or four fifths of the lines of a file, is a third-party copy; and a directory name under which many copies lie
in several repositories is a root of vendored code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.llm.lexers import LANGUAGE, Fault, problem, skeleton
from codescout.session import cut


def language_of(path: str | None) -> str | None:
    """The language that the extension decides, in any letter case."""
    name = (path or "").rpartition("/")[2]
    return LANGUAGE.get(name.rpartition(".")[2].lower()) if "." in name else None


def parse_faults(files: DataFrame) -> DataFrame:
    """(path, repo_name, language, fault): one row for each input row; fault is null where the content is valid.

    Null paths, unknown extensions and null contents have no fault. Empty files and files of comments only
    follow the language's own rule. Repeated rows stay repeated. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = [language_of(p) for p in batch.column(0).to_pylist()]
            faults = [problem(lang, text) for lang, text in zip(languages, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(faults, pa.string())], names=["path", "repo_name", "language", "fault"])

    return files.select("path", "repo_name", "content").mapInArrow(run, "path string, repo_name string, language string, fault string")


def fault_rates(files: DataFrame) -> DataFrame:
    """(repo_name, language, n_files, n_invalid, rate) over distinct paths; unknown extensions count as a null language."""
    each = parse_faults(files).dropDuplicates(["path"])
    grouped = each.groupBy("repo_name", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("fault").alias("n_invalid"))
    return grouped.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


# --- problem 3 -------------------------------------------------------------------------------------------------------

#: Directories for third-party code, and names of files that package managers write.
VENDOR_DIRS = {"vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "deps", "node_modules", "bower_components", "site-packages", "dist-packages", "pods", "carthage", "jspm_packages", "godeps"}
LOCK_FILE = re.compile(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|packages\.lock|(?:[\w.-]+\.)?lock|pnpm-lock|pubspec\.lock|poetry\.lock|cargo\.lock)\.(?:json|ya?ml|toml)$|(?:^|/)(?:pnpm-lock\.yaml|yarn\.lock|cargo\.lock)$", re.I)
#: What tools write at the head of their files, and what people write there about tools.
MADE = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|from|by|source)\b|\b(?:code|file|source|machine|automatically|auto)[ -](?:was |is )?(?:automatically |auto-?)?generated\b|^\W*generated (?:by|from|with|using|on)\b"
    r"|\bdo not (?:edit|modify|change)\b|\bmanual changes will be (?:lost|overwritten)|automatisch (?:erzeugt|generiert)|generado autom[aá]ticamente|g[ée]n[ée]r[ée] automatiquement|gerado automaticamente|自动生成|自動生成|\bedit the template\b",
    re.I,
)
SPOKEN_OF = re.compile(r"\b(?:reads?|parses?|checks?|writes?|emits?|prints?|produces?|detects?|finds?|skips?)\b.*\b(?:generated|edit|output)\b|method stub|\bby hand\b|no longer generated|(?<![-\w])not generated|used to be generated|maintained by hand|hand-?(?:written|maintained)", re.I)
PROTO = re.compile(r"^\W*source: \S+\.(?:proto|idl|thrift|fbs)\b", re.I)
_HEAD_COMMENT = re.compile(r"\s*(?:(?://|#|--|;|%)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)")
_LITERAL = r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)"
_SLASH_COMMENT, _HASH_COMMENT = re.compile(_LITERAL + r"|//[^\n]*|/\*[\s\S]*?\*/"), re.compile(_LITERAL + r"|#[^\n]*")
_FLOW = re.compile(r"\b(?:function|def|func|fn|class|return|if|for|while|switch|match|try)\b|=>")
_VALUE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b\d[\w.]*|[\[\](){},;:\s]|\b(?:true|false|null|None|True|False)\b")
#: Share of lines from which on a file is a copy, least lines of a copy, and shortest line that counts.
SIMILAR, LEAST_LINES, LINE_CHARS = 0.8, 5, 6
#: A directory name is a root of vendored code from this share of copies on, with so many copies in so many unrelated repositories.
ROOT_SHARE, ROOT_COPIES, ROOT_REPOSITORIES = 0.2, 3, 2
#: Primes of the hashes; products of two remainders fit in 64 bits.
PRIMES = (2147483647, 2147483629)
#: Rows of paths that may be broadcast: about 100 MB.
BROADCAST_ROWS = 500_000
_COMMENT_LINE = ("//", "#", "/*", "*", "--", "<!--")


def made_by_tool(text: str) -> bool:
    """Whether the comments before the first code say that a tool wrote the file."""
    at = 0
    while m := _HEAD_COMMENT.match(text, at):
        for line in m[0].strip().split("\n"):
            if (MADE.search(line) and not SPOKEN_OF.search(line) and not re.search(r"['\"`](?:[^'\"`]*(?:generated|edit)[^'\"`]*)['\"`]", line, re.I)) or PROTO.match(line):
                return True
        at = m.end()
    return False


def layout(language: str, text: str) -> str | None:
    """minified, data or repetitive, by the shape of the text alone."""
    lines = [line for line in text.split("\n") if line.strip()]
    size = sum(map(len, lines))
    if size < 200:
        return None
    if language != "css" and size > 400 and sum(map(text.count, ("return", "if ", "if(", "for ", "for("))) <= 4 + size // 500:
        body = (_HASH_COMMENT if language == "python" else _SLASH_COMMENT).sub(lambda m: m[1] or "", text)
        flow = len(_FLOW.findall(re.sub(_LITERAL, "", body)))
        # Beside functions a single long literal is no more than an embedded image or text.
        whole = re.sub(_LITERAL, lambda m: m[0][:60], body) if flow else body
        if flow <= 2 and len(_VALUE.sub("", body)) < 0.15 * len(whole):
            return "data"
    long = [line for line in lines if len(line) > 250]
    if sum(map(len, long)) > 0.5 * size:
        try:
            shape = skeleton(language, text) if language in ("javascript", "typescript", "go", "java", "rust", "c") else re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", '""', text)
        except Fault:
            shape = text
        bare = [line for line in shape.split("\n") if line.strip()]
        dense = [line for line in bare if len(line) > 200 and line.count(" ") < 0.12 * len(line)]
        if sum(map(len, dense)) > 0.5 * sum(map(len, bare)):
            return "minified"
    if len(lines) >= 12:
        kinds = Counter(text.encode("utf-8", "replace").translate(None, b"0123456789").split(b"\n"))
        kinds = Counter({k: n for k, n in kinds.items() if k.strip()})
        if sum(n for n in kinds.values() if n >= 6) > 0.75 * len(lines) and max(kinds, key=kinds.get).strip(b" \t\r{}()[];,") and sum(1 for k in kinds if kinds[k] >= 6) <= 6:
            return "repetitive"
    return None


def line_hashes(text: str | None) -> list[int]:
    """The distinct hashes of a file's lines without blanks; comments and very short lines are left out."""
    if not text:
        return []
    bare = {"".join(line.split()) for line in text.split("\n")}
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in bare if len(x) >= LINE_CHARS and not x.startswith(_COMMENT_LINE)]


def own_reason(language: str | None, relative: str, text: str | None) -> str | None:
    """lockfile, generated, minified, data, repetitive or null, by the name, header and layout of one valid file."""
    if not text or not text.strip() or language is None or language in ("markdown", "text"):
        return None
    if language in ("json", "yaml", "toml"):
        made = LOCK_FILE.search(relative) or (language == "json" and '"lockfileVersion"' in text[:400])
        found = "lockfile" if made else None
    else:
        found = "generated" if made_by_tool(text) else layout(language, text)
    return found if found and problem(language, text) is None else None


def file_leaves(files: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(repo_name, path, relative_path, reason, leaf, n_lines, lines, is_code): one row for each input row, without its content.

    reason: see own_reason(). leaf is the hash of the content, the sum of the hashes of its lines; lines are
    these hashes, each once, and n_lines their number; of the lines only those among `wanted` (in order) are given,
    if it is. Null and empty contents have no lines. No shuffle.
    """
    sent = files.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rels, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            languages = [language_of(p) for p in paths]
            rels = [r or p or "" for r, p in zip(rels, paths, strict=True)]
            marks = [own_reason(*x) for x in zip(languages, rels, texts, strict=True)]
            code = [lang is not None and lang not in ("json", "yaml", "toml", "markdown", "text") and bool(t and t.strip()) for lang, t in zip(languages, texts, strict=True)]
            lines = [line_hashes(t) if is_code else [] for t, is_code in zip(texts, code, strict=True)]
            leaves = [(sum(x) if x else xxhash.xxh3_64_intdigest(t or "")) % (1 << 64) - (1 << 63) for x, t in zip(lines, texts, strict=True)]
            n_lines = pa.array(map(len, lines), pa.int32())
            if sent is not None:
                lines = _among(lines, sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rels, pa.string()), pa.array(marks, pa.string()), pa.array(leaves, pa.int64()), n_lines, pa.array(lines, pa.list_(pa.int64())), pa.array(code, pa.bool_())],
                names=["repo_name", "path", "relative_path", "reason", "leaf", "n_lines", "lines", "is_code"],
            )

    source = files.select("repo_name", "path", "relative_path", "content")
    return source.mapInArrow(run, "repo_name string, path string, relative_path string, reason string, leaf long, n_lines int, lines array<long>, is_code boolean")


def _among(lines: list[list[int]], wanted: np.ndarray) -> list[list[int]]:
    """The lines of each file that are wanted."""
    flat = np.fromiter((x for file in lines for x in file), np.int64)
    if not len(wanted) or not len(flat):
        return [[] for _ in lines]
    kept = wanted[np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)] == flat
    ends = np.cumsum([len(file) for file in lines])
    return [flat[a:b][kept[a:b]].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def merkle_tree(leaves: DataFrame) -> DataFrame:
    """(family, repo_name, dir, hash, n_files): the Merkle hash of each directory from (family, repo_name, relative_path, leaf).

    The hash of a directory is made of its children's names, hashes and numbers of files:
    H(d) = sum over children c of a(c) H(c) + b(c) n(c), modulo two primes, with a and b hashes of the name. As
    this is linear, each leaf carries its part up to every directory above it, from the bottom to the root, and
    one aggregation, partial in each task, adds the parts up. Trees of any depth; two directories have the same
    hash if they hold the same names and leaves at all depths.
    """
    names = F.reverse(F.split("relative_path", "/"))
    factor = lambda name, seed: F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(PRIMES[0] - 1)) + 1
    step = lambda v, name, p, seed: F.pmod(F.pmod(v * factor(name, seed), F.lit(p)) + factor(name, seed + 1), F.lit(p))
    start = F.struct(F.pmod("leaf", F.lit(PRIMES[0])).alias("h1"), F.pmod("leaf", F.lit(PRIMES[1])).alias("h2"), F.expr("cast(array() as array<struct<h1:bigint,h2:bigint>>)").alias("up"))

    def climb(acc, name):
        h1, h2 = step(acc["h1"], name, PRIMES[0], 1), step(acc["h2"], name, PRIMES[1], 3)
        return F.struct(h1.alias("h1"), h2.alias("h2"), F.concat(acc["up"], F.array(F.struct(h1.alias("h1"), h2.alias("h2")))).alias("up"))

    parts = leaves.select("family", "repo_name", F.split("relative_path", "/").alias("names"), F.aggregate(names, start, climb)["up"].alias("up"))
    above = parts.select("family", "repo_name", "names", F.posexplode("up").alias("i", "h"))
    dirs = above.select("family", "repo_name", F.array_join(F.slice("names", 1, F.size("names") - F.col("i") - 1), "/").alias("dir"), "h")
    summed = dirs.groupBy("family", "repo_name", "dir").agg(F.sum("h.h1").alias("h1"), F.sum("h.h2").alias("h2"), F.count(F.lit(1)).alias("n_files"))
    return summed.select("family", "repo_name", "dir", F.struct(F.pmod("h1", F.lit(PRIMES[0])), F.pmod("h2", F.lit(PRIMES[1]))).alias("hash"), "n_files")


def shared(nodes: DataFrame) -> DataFrame:
    """The rows of nodes (family, hash, ...) whose hash occurs in several families."""
    several = nodes.groupBy("hash").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low <> high").select("hash")
    return nodes.join(several, "hash", "left_semi")


def _family(name: str = "repo_name") -> Column:
    """Repositories are related if their names begin with the same word before the first hyphen."""
    return F.coalesce(F.split(name, "-").getItem(0), F.lit(""))


def library_leaves(libraries: DataFrame) -> DataFrame:
    """(family, repo_name, relative_path, leaf, n_lines, lines) of the code files of the known third-party libraries, each a family."""
    name = F.coalesce("lib_name", F.lit("")).alias("repo_name")
    leaves = file_leaves(libraries.select(name, F.coalesce("file_name", F.lit("")).alias("path"), F.coalesce("file_name", F.lit("")).alias("relative_path"), "content"))
    return leaves.where("is_code").select(F.concat(F.lit("library "), "repo_name").alias("family"), "repo_name", "relative_path", "leaf", "n_lines", "lines")


def third_party(leaves: DataFrame, with_lines: DataFrame, library: DataFrame) -> DataFrame:
    """(path, reason) of the code files that hashes show to be copies: each path once.

    leaves: one row for each path of file_leaves(); with_lines: its rows with their lines, which may repeat;
    library: see library_leaves().

    subtree: below a directory of at least two files that unrelated repositories share; leaf: the same lines as
    a file of an unrelated repository or of a library; lines: four fifths of the lines of such a file and half
    of its own, in any order; root: below a directory whose name is that of a root of vendored code.
    """
    code = leaves.where("is_code and relative_path is not null").select(_family().alias("family"), "repo_name", "path", "relative_path", "leaf", "n_lines")
    columns = ["family", "repo_name", "relative_path", "leaf"]
    below_root = library.withColumn("relative_path", F.concat_ws("/", "repo_name", "relative_path"))
    tree = merkle_tree(code.select(columns).unionByName(below_root.select(columns))).where("n_files >= 2 and dir <> ''")
    subtrees = shared(tree.select("family", "repo_name", "dir", "hash")).select("repo_name", "dir").distinct()
    names = F.split("relative_path", "/")
    ancestors = F.expr("transform(sequence(1, greatest(size(split(relative_path, '/')) - 1, 1)), i -> array_join(slice(split(relative_path, '/'), 1, i), '/'))")
    in_subtree = code.select("repo_name", "path", F.explode(ancestors).alias("dir")).join(subtrees, ["repo_name", "dir"], "left_semi").select("path", F.lit("subtree").alias("reason"))

    long_enough = F.col("n_lines") >= LEAST_LINES
    same = shared(code.where(long_enough).select("family", "path", F.col("leaf").alias("hash")).unionByName(library.where(long_enough).select("family", F.lit(None).cast("string").alias("path"), F.col("leaf").alias("hash"))))
    in_leaf = same.where("path is not null").select("path", F.lit("leaf").alias("reason"))

    known = library.withColumn("file", F.monotonically_increasing_id()).select("file", F.col("n_lines").alias("n_known"), F.explode("lines").alias("line"))
    known = cut(known)
    if known.count() <= BROADCAST_ROWS:  # a fixed table
        known = F.broadcast(known)
    enough_known = F.size("lines") >= 0.5 * F.col("n_lines")  # else no library can have half of them
    open_lines = with_lines.where("is_code").where(long_enough & enough_known).select("path", F.col("n_lines").alias("n"), F.explode("lines").alias("line"))
    met = open_lines.join(known, "line").groupBy("path", "n", "file", "n_known").agg(F.count_distinct("line").alias("both"))
    alike = (F.col("both") >= SIMILAR * F.least("n", "n_known")) & (F.col("both") >= 0.5 * F.col("n")) & (F.col("both") >= LEAST_LINES)
    in_lines = met.where(alike).select("path", F.lit("lines").alias("reason"))

    rank = F.when(F.col("reason") == "subtree", 0).when(F.col("reason") == "leaf", 1).otherwise(2)
    copies = cut(in_subtree.unionByName(in_leaf).unionByName(in_lines).groupBy("path").agg(F.min_by("reason", rank).alias("reason")))
    named = code.join(copies.select("path", F.lit(1).alias("copy")), "path", "left").select("family", "path", "copy", F.explode(F.array_distinct(F.transform(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), lambda x: F.lower(x)))).alias("name"))
    counted = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("copy").alias("copies"), F.count_distinct(F.when(F.col("copy") == 1, F.col("family"))).alias("families"))
    roots = counted.where((F.col("copies") >= ROOT_COPIES) & (F.col("families") >= ROOT_REPOSITORIES) & (F.col("copies") >= ROOT_SHARE * F.col("n"))).select("name")
    in_root = named.where("copy is null").join(roots, "name", "left_semi").select("path", F.lit("root").alias("reason")).distinct()
    return copies.unionByName(in_root)


def not_hand_written(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(path, reason) of the files that nobody wrote by hand for their repository, each path once.

    Reasons: those of third_party(); vendored (below a directory whose name is set aside for third-party code but
    under which too few copies lie to show it); those of own_reason(). Null and empty contents, files that are
    not valid in their language, prose and settings (but lock files) have none.
    """
    library = cut(library_leaves(libraries))
    lines = library.select(F.explode("lines").alias("line")).distinct()
    few = lines.count() <= BROADCAST_ROWS  # a fixed table; lines that no library has need not leave the files then
    wanted = np.sort(np.array([r["line"] for r in lines.collect()], np.int64)) if few else None
    with_lines = cut(file_leaves(files, wanted))
    leaves = cut(with_lines.drop("lines").dropDuplicates(["path"]))
    kept_aside = F.exists(F.slice(F.split("relative_path", "/"), 1, F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(0))), lambda x: F.lower(x).isin(*sorted(VENDOR_DIRS)))
    by_name = leaves.where(F.col("is_code") & kept_aside).select("path", F.lit("vendored").alias("reason"))
    by_hash = third_party(leaves, with_lines, library)
    both = by_hash.withColumn("nth", F.lit(0)).unionByName(by_name.withColumn("nth", F.lit(1))).groupBy("path").agg(F.min_by("reason", "nth").alias("reason"))
    candidates = cut(both.join(leaves.where("reason is not null").select("path"), "path", "left_anti"))
    # Files with a reason of their own are known to be valid; the candidates are looked at where they lie.
    wanted = F.broadcast(candidates) if candidates.count() <= BROADCAST_ROWS else candidates
    faults = parse_faults(files.join(wanted.select("path"), "path", "left_semi")).where("fault is not null").select("path").distinct()
    found = candidates.join(faults, "path", "left_anti")
    return leaves.where("reason is not null").select("path", "reason").unionByName(found)
