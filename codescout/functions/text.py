"""Column functions over code and text. Null inputs give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, mode: str = "default") -> Column:
    """Index tokens: runs of ASCII letters and digits longer than one character, in lower case.

    mode="compat": everything between white space. Null text gives an empty array.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if mode == "compat":
        return F.filter(F.split(low, r"\s+"), lambda x: x != "")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def count_lines(text: Column) -> Column:
    """Lines of a text; a last line feed ends a line and does not begin another. Empty text has 0."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).when(text.endswith("\n"), feeds).otherwise(feeds + 1).cast("int")


def comment_lines(text: Column) -> Column:
    """Lines that begin with a comment mark."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^(#|//|/\*|\*)")))


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin with a comment mark."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|//|/\*|\*)")))


#: What counts as a branch in the keyword estimate of complexity.
BRANCH_WORDS = ["if", "elif", "else", "for", "while", "except", "case"]


def keyword_complexity(code: Column) -> Column:
    """1 plus the number of branch words, as whole words."""
    return F.lit(1) + sum((F.regexp_count(code, F.lit(rf"\b{w}\b")) for w in BRANCH_WORDS), F.lit(0))


def element_id(repo: Column, kind: Column, *parts: Column) -> Column:
    """repo_type_ and the first 12 hex digits of the SHA-256 of the repo and parts, joined without a separator."""
    prefix = F.when(kind == "documentation", F.lit("doc")).otherwise(kind)
    return F.concat(repo, F.lit("_"), prefix, F.lit("_"), F.substring(F.sha2(F.concat(repo, *parts), 256), 1, 12))


def truncate(text: Column, limit: int, marker: str = "\n... (truncated)") -> Column:
    """The first `limit` code points and a marker, if the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, both included, clamped to the text); empty if start lies after end."""
    lines = F.split(text, "\n")
    low = F.greatest(start, F.lit(1))
    high = F.least(end, F.size(lines))
    return F.when(low > high, F.lit("")).otherwise(F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n"))


def search_text(name: Column, kind: Column, language: Column, path: Column, docstring: Column, signature: Column, summary: Column, code: Column, code_chars: int | None = None) -> Column:
    """What the keyword index reads of an element; empty parts are skipped. code_chars: only so many characters of the code."""
    parts = [name, kind, language, path, docstring, signature, summary, F.substring(code, 1, code_chars) if code_chars else code]
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def embedding_text(name: Column, kind: Column, language: Column, path: Column, signature: Column, docstring: Column, summary: Column, code: Column) -> Column:
    """Labelled lines for an embedding model; the code is cut at 10,000 characters."""
    labelled = [("Type", kind), ("Name", name), ("Language", language), ("File", path), ("Signature", signature), ("Documentation", docstring), ("Summary", summary), ("Code", truncate(code, 10_000, "..."))]
    return F.concat_ws("\n", *(F.when(c != "", F.concat(F.lit(f"{label}: "), c)) for label, c in labelled))


def module_path(path: Column) -> Column:
    """The dotted module of a Python file; a package's __init__ is the package, a root __init__ and other files have none."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.when(path.endswith(".py") & (stem != "") & ~path.rlike('[<>:"|?*]'), F.replace(stem, F.lit("/"), F.lit(".")))


def clean_docstring(doc: Column) -> Column:
    """Without surrounding blanks and quotes."""
    return F.trim(F.regexp_replace(F.trim(doc), r"^[\"']{1,3}|[\"']{1,3}$", ""))


def word_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of `size` words, each `overlap` words into the one before; stops once a window reaches the end."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk"), F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ").alias("text"))))

    # The words are split once: within the lambda they are a variable, not the expression.
    return F.transform(F.array(words), windows)[0]


#: The language of each extension.
EXTENSIONS = {
    "py": "python", "pyx": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "json": "json", "yaml": "yaml", "toml": "toml", "md": "markdown", "txt": "text", "css": "css", "html": "html", "sh": "shell", "sql": "sql", "xml": "xml",
}


def extension(path: Column) -> Column:
    """The extension in lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language that the extension stands for; null for others."""
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.create_map(*pairs)[extension(path)]


def dedent(doc: Column) -> Column:
    """A docstring without blank lines at its edges and without the indentation that all lines but the first share."""
    lines = F.split(F.regexp_replace(doc, "\r", ""), "\n")
    rest = F.slice(lines, F.lit(2), F.size(lines))
    indent = F.array_min(F.transform(F.filter(rest, lambda x: x.rlike(r"[^ \t]")), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
    kept = F.transform(rest, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x)))
    whole = F.array_join(F.concat(F.array(F.regexp_replace(lines[0], r"^[ \t]+", "")), kept), "\n")
    return F.regexp_replace(F.regexp_replace(whole, r"[ \t]+(\n|$)", "$1"), r"^\n+|\n+$", "")


def token_estimate(text: Column) -> Column:
    """About how many tokens a text has: one for every four characters; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(4.0)), F.lit(0)).cast("int")


def truncate_tokens(text: Column, tokens: int) -> Column:
    """The beginning of a text that has about this many tokens."""
    return F.substring(text, 1, tokens * 4)


def repo_name_of_url(url: Column) -> Column:
    """The last part of a repository's address, without .git; null for null."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "[^/:]*$", 0), r"\.git$", "")
