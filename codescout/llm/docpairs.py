"""Problem 5: functions paired with their documentation.

In each file, regular expressions detect the signatures, an indentation stack (Python) or a stack of braces
delimits the bodies, and the comment whose last line is next above the signature (with decorators,
annotations or attributes between) is attached, in Python the literal that opens the body. Files are read
where they lie; only the found functions are joined with the elements, on path and line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.llm.files import language_of
from codescout.session import cut

#: Documentations that may be broadcast: about 50 MB.
BROADCAST_ROWS = 100_000

# --- signatures ------------------------------------------------------------------------------------------------------

_WORD_FLOW = r"(?:if|for|while|switch|catch|return|else|do|new|throw|case|await|yield|typeof|delete|try|with|synchronized|match|loop|sizeof|in|of|goto|defer|go|select)\b"
#: A line that may declare a function, with the name in one of the groups.
SIGNATURE = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<a>\w+)[ \t]*[(\[]", re.M),
    "go": re.compile(r"^[ \t]*func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<a>\w+)[ \t]*[(\[]", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+(?P<a>\w+)[ \t]*[<(]", re.M),
    "javascript": re.compile(
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<a>[\w$]*)[ \t]*[<(]"
        r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<b>[\w$]+)[^=\n;]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^\n]*=>|[\w$]+[ \t]*=>|\($)"
        rf"|^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)[ \t]+)*\*?[ \t]*(?!{_WORD_FLOW})(?P<c>[#\w$]+)[ \t]*(?:<[^>\n]*>)?\([^;\n]*\)?[^;\n=]*\{{[ \t]*\r?$"
        rf"|^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)[ \t]+)*(?!{_WORD_FLOW})(?P<d>[#\w$]+)\([ \t]*\r?$"
        r"|^[ \t]*(?:(?:static|public|private|protected|readonly)[ \t]+)*(?P<e>[#\w$]+)[ \t]*(?::[^=\n]*)?=[ \t]*(?:async[ \t]*)?(?:function\b|\([^\n]*=>|[\w$]+[ \t]*=>)",
        re.M,
    ),
    "java": re.compile(rf"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>\n]+>[ \t]*)?(?!{_WORD_FLOW})(?:[\w.]+(?:<[^;{{}}\n]*>)?(?:\[\])*[ \t]+)?(?!{_WORD_FLOW})(?P<a>\w+)[ \t]*\([^;\n]*(?:\{{|\)|,)[ \t]*(?:throws[^;{{\n]*)?\{{?[ \t]*\r?$", re.M),
    "c": re.compile(rf"^(?!#)(?:(?:static|inline|extern|const|unsigned|signed|struct|enum|union|long|short|__\w+)[ \t]+)*(?!{_WORD_FLOW})[A-Za-z_]\w*[ \t*]+(?:[A-Za-z_]\w*[ \t*]+)*(?P<a>[A-Za-z_]\w*)[ \t]*\([^;\n]*(?:\{{|\)|,)[ \t]*\{{?[ \t]*\r?$", re.M),
}
SIGNATURE["typescript"] = SIGNATURE["javascript"]

_DOCSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?(?:\"\"\"(?P<a>(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*)\"\"\"|'''(?P<b>(?:[^\\']|\\[\s\S]|'(?!''))*)'''|\"(?P<c>(?:[^\"\\\n]|\\[\s\S])*)\"(?!\")|'(?P<d>(?:[^'\\\n]|\\[\s\S])*)'(?!'))")
_MARKS = re.compile(r"[()\[\]{}]|\"\"\"|'''|[\"'`#]|//|/\*|:|\n")


def _python_end(text: str, start: int) -> int:
    """Where the header that begins at start ends (after its colon), or -1."""
    depth, at = 0, start
    while m := _MARKS.search(text, at):
        mark, at = m[0], m.end()
        if mark in ('"""', "'''", '"', "'"):
            at = text.find(mark, at)
            if at < 0:
                return -1
            at += len(mark)
        elif mark == "#":
            at = text.find("\n", at)
            if at < 0:
                return -1
        elif mark in "([{":
            depth += 1
        elif mark in ")]}":
            depth -= 1
        elif mark == ":" and depth == 0:
            return at
        elif mark == "\n" and depth <= 0:
            return -1
    return -1


_TRIPLE = re.compile(r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''")
_LINE_START = re.compile(r"\n(?=[^\n])")


def _without_outdents(text: str) -> str:
    """The text with the lines within literals moved far to the right, so that none of them ends a block."""
    return _TRIPLE.sub(lambda m: _LINE_START.sub("\n" + " " * 400, m[0]), text)


def _python_body_end(lines: list[str], first: int) -> int:
    """The last line (from 1) of the block whose header is on line `first`."""
    indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
    last = first
    for n in range(first + 1, len(lines) + 1):
        line = lines[n - 1]
        if line.strip():
            if len(line) - len(line.lstrip()) <= indent and not line.lstrip().startswith((")", "]", "}")):
                break
            last = n
    return last


_BRACE_SCAN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,12}'|`(?:[^`\\]|\\[\s\S])*`|[{};]")


def _brace_end(text: str, start: int) -> int:
    """The offset after the brace that closes the first one after start; or of the semicolon before any brace."""
    depth = 0
    for m in _BRACE_SCAN.finditer(text, start):
        mark = m[0]
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif mark == ";" and not depth:
            return m.end()
    return len(text)


# --- comments --------------------------------------------------------------------------------------------------------

_BETWEEN = re.compile(r"\s*(?:@[\w.]+(?:\(.*\)?)?|#!?\[.*\]?|\[\[.*\]\]|__attribute__.*)\s*$")


def comment_above(lines: list[str], line: int) -> str | None:
    """The comment that ends directly above the line (from 1), decorators and attributes skipped; its text as it stands."""
    n = line - 1
    while n and _BETWEEN.match(lines[n - 1]):
        n -= 1
    if not n:
        return None
    above = lines[n - 1].strip()
    if above.startswith("//"):
        first = n
        while first > 1 and lines[first - 2].strip().startswith("//"):
            first -= 1
        return "\n".join(lines[first - 1 : n])
    if above.endswith("*/"):
        first = n
        while first and "/*" not in lines[first - 1]:
            first -= 1
        if not first or lines[first - 1].strip()[:2] != "/*":
            return None  # a comment behind code
        return "\n".join(lines[first - 1 : n])
    return None


def functions_of(language: str | None, text: str | None) -> list[tuple[int, int, str, str, str, str | None]]:
    """(start_line, end_line, name, signature, code, documentation) of each function, in the order of the text."""
    find = SIGNATURE.get(language)
    if find is None or not text:
        return []
    lines, out = text.split("\n"), []
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    blocks = _without_outdents(text).split("\n") if language == "python" and ('"""' in text or "'''" in text) else lines
    at_line, at = 1, 0
    for m in find.finditer(text):
        at_line += text.count("\n", at, m.start())
        at = m.start()
        name = next((g for g in m.groups() if g), "")
        if language == "python":
            end = _python_end(text, m.end() - 1)
            if end < 0:
                continue
            last = _python_body_end(blocks, at_line)
            doc = _DOCSTRING.match(text, end)
            body = next((g for g in doc.groups() if g is not None), None) if doc else None
            stop = starts[last] - 1
            signature = text[m.start() : end]
        else:
            stop = _brace_end(text, m.start())
            last = at_line + text.count("\n", at, stop)
            body = comment_above(lines, at_line)
            signature = text[m.start() : stop].partition("{")[0]
        out.append((at_line, last, name, " ".join(signature.split()), text[m.start() : max(stop, m.end())], body))
    return out


# --- what says something ---------------------------------------------------------------------------------------------

_TOOL = re.compile(r"(?:nolint\w*|eslint|tslint|jshint|prettier|biome|rustfmt|clippy|clang-format|clang-tidy|checkstyle|spotless|nolint|noqa|noinspection|pylint|flake8|mypy|pyright|ruff|isort|black|yapf|fmt|coverage|istanbul|c8|v8|nosonar|sonar|ts-(?:ignore|nocheck|expect-error)|@ts-|type:\s*ignore|pragma|go:\w+|region|endregion|language=|codespell|cspell|spell-?checker|lint|codegen|doctest|nosec|bandit|formatter|@formatter|@noinspection|suppress|cppcheck|lcov|gcov|gocyclo|gofmt|golint|vim?:|-\*-|todo-tool|jscs|webpack|vite-ignore|sourcery|skipcq|no-cover|fall ?through)\b", re.I)
_TAG = re.compile(r"^[@\\:](?:param|parameter|arg|argument|return|returns|rtype|type|throws|exception|raises?|yields?|see|since|author|version|template|property|inheritdoc|override|public|private|internal|deprecated|tparam|in|out|name|function|method|memberof|async|static|brief)\b[:\s]*", re.I)
_PLACEHOLDER = re.compile(r"^(?:inherited|inherit(?:ed)? from .{0,40}|deprecated|obsolete|legacy|internal(?: use)?(?: only)?|private|public|unused|asdf\w*|qwerty|blah(?: blah)*|docstring|todo|fixme|xxx|tbd|tba|none|n/?a|null|nothing|empty|undocumented|no (?:doc(?:umentation|s|string)?|description|comment)s?.*|(?:add|write|insert|fill in|missing|needs?|document)(?: \w+){0,3} ?(?:doc\w*|description|comment|text|me|this|here|later)?|doc(?:umentation|string|s)?(?: (?:goes here|here|later|missing|to follow|pending))?|description(?: (?:goes here|here|of .{0,30}))?|summary|placeholder|lorem ipsum.*|coming soon|wip|work in progress|to be (?:done|documented|written|added).*|auto-?generated.*|generated.*stub.*|your (?:description|text|code).*|dummy|test|foo|bar|hack|temp(?:orary)?|stub|[a-z]|\?+|\.+)[.!?…: ]*$", re.I)
_TODO = re.compile(r"^(?:todo|fixme|xxx|hack|tbd)\b[:( ]*(?:\w+\)?:?\s*)?(?:add|write|document|describe|explain|comment|doc|docs|documentation|description|fill|this|me|later|cleanup|clean up|refactor|remove|fix|implement|finish|test|check)?\b.{0,40}$", re.I)
_POINTER = re.compile(
    r"^(?:\{?@?(?:see|link|inheritdoc|copydoc)\b|cf\.|refer to\b|same as\b|as above\b|ditto\b|siehe\b|vgl\.|véase\b|ver (?:el|la|los|las|también|nota)\b|voir\b|wie oben\b|gleiche? wie\b|参见|请参阅|见上|同上|详见|https?:|(?:documented|described|explained)\b.{0,12}\b(?:in|at|elsewhere|above|below|there)\b"
    r"|for (?:more|details|docs|documentation|usage)\b.*\bsee\b|(?:documentation|description|docs|details?) (?:is|are|in|at|see|can be found)\b|details? (?:in|see)\b|more in\b|read the\b.{0,40}\b(?:docs?|wiki|readme|manual|design|file)\b)",
    re.I,
)
_KIND_WORDS = set("will shall should can used uses use does given here just a an the this that function method helper helpers routine procedure constructor getter setter class utility util func fn def to for of in on and or its it is from with by as at be internal private public static main wrapper implementation implements implement simple small default callback handler does do performs perform executes execute runs run calls call invokes handles handle funktion methode hilfsfunktion die der das ein eine función método la el una un auxiliar 函数 方法 辅助".split())
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])|\d+|[À-ɏ]+|[㐀-鿿]")


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ies", "ing", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)] + ("y" if end == "ies" else "")
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def plain_text(raw: str) -> list[str]:
    """The lines of a comment or docstring without comment marks, tool lines and decoration."""
    text = raw.replace("\r", "").strip()
    if text.startswith("/*"):
        text = re.sub(r"\*+/\s*$", "", text[2:]).lstrip("*!")
    out = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:///?!?|//+!?|\*+(?!/)|#+)?\s?", "", line).strip()
        line = re.sub(r"^[\s\-=*#~_+.<>/\\|:]{3,}|[\s\-=*#~_+<>/\\|]{3,}$", "", line).strip()
        line = re.sub(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>", " ", line).strip()
        if line and re.search(r"\w", line) and not (_TOOL.match(line.lstrip("@!/# ")) or _TOOL.match(line)):
            out.append(line)
    return out


def says_something(raw: str | None, name: str) -> bool:
    """Whether a documentation describes its function.

    It does not if nothing is left of it, or only placeholders, restatements of the function's name or kind,
    parameters without a description, pointers elsewhere or instructions to a tool.
    """
    if not raw or not raw.strip():
        return False
    own = {_stem(p) for p in _PARTS.findall(name)}
    prose, tags = [], []
    section = False
    for line in plain_text(raw):
        tag = _TAG.match(line)
        if tag:
            tags.append(line[tag.end() :] if not re.match(r"[@\\:](?:brief|description|summary|desc)\b", line, re.I) else line)
            section = True
        elif re.match(r"^(?:args?|arguments?|param(?:eter)?s?|returns?|raises?|yields?|throws|examples?|notes?|attributes|parámetros|parameter|rückgabe|参数|返回)\s*:?\s*$", line, re.I):
            section = True
        elif section and re.match(r"^[\w*`, ]{1,40}\s*(?:\([^)]*\))?\s*(?::|--?|–)(?:\s|$)", line):
            tags.append(line)
        elif section and not prose and re.match(r"^[`*]?\w+[`*]?$", line):
            tags.append(line)
        else:
            prose.append(line)
    sentence = " ".join(prose).strip()
    if sentence and _tells(sentence, own):
        return True
    for tag in tags:  # a described parameter or result
        rest = re.sub(r"^(?:\{[^}]*\}|\[[^\]]*\])?\s*[`*]?[\w.$]+[`*]?\s*(?:\([^)]*\))?\s*(?::|--?|–)?\s*", "", tag)
        if len(rest.split()) >= 2 and _tells(rest, own):
            return True
    return False


def _tells(sentence: str, own: set[str]) -> bool:
    bare = sentence.strip(" .!:;…\"'`*-_")
    if not bare or _PLACEHOLDER.match(bare) or _TODO.match(bare):
        return False
    # Pointers: what is left without the sentences that only point elsewhere.
    left = [s for s in re.split(r"(?<=[.!?。])\s*", sentence) if s.strip(" .!:;") and not _POINTER.match(s.strip())]
    if not left:
        return False
    words = _PARTS.findall(" ".join(left))
    new = [w for w in words if _stem(w) not in own and w.lower() not in _KIND_WORDS]
    if any("㐀" <= w[0] <= "鿿" for w in new):
        return len(new) >= 2
    return len(new) >= 1 and not (len(words) <= 2 and len(" ".join(left)) < 6)


# --- operators -------------------------------------------------------------------------------------------------------


def file_functions(files: DataFrame, with_code: bool = True, with_signature: bool = True) -> DataFrame:
    """(path, start_line, end_line, name, signature, code, doc, told): the functions of each file.

    doc is null where there is no documentation; told is whether it says something. Null paths or contents and
    languages without functions give nothing. Repeated files give the same rows again. Without `with_code`
    code is null, and only functions whose documentation says something are given; without `with_signature`
    signature is null.
    """
    names = ["path", "start_line", "end_line", "name", "signature", "code", "doc", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out = batch.column(0), []
            for row, (path, text) in enumerate(zip(paths.to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for start, end, name, signature, code, doc in functions_of(language_of(path), text):
                    told = says_something(doc, name)
                    if with_code or told:
                        out.append((row, start, end, name, signature if with_signature else None, code if with_code else None, doc if with_signature else None, told))
            rows, *columns = zip(*out, strict=True) if out else [()] * 8
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([paths.take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, start_line int, end_line int, name string, signature string, code string, doc string, told boolean")


def documented_ids(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(id) of the function elements whose documentation in the file says something; each id once."""
    told = file_functions(files, with_code=False, with_signature=False).where("told").select(F.col("path").alias("file_path"), "start_line").distinct()
    wanted = elements.where("type = 'function'").select("id", "file_path", F.col("start_line").cast("int").alias("start_line"))
    return wanted.join(told, ["file_path", "start_line"], "left_semi").select("id").distinct()


def code_doc_pairs(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, signature, code, documentation): function elements with documentation that says something.

    The code is the element's own; where that is null or empty, the text that the stacks delimit in the file.
    One row for each input row; functions without a file, or whose file lacks them, are left out.

    The documentation goes to the elements, by broadcast where it is of at most `BROADCAST_ROWS` functions, so that
    their code stays where it lies; files are read a second time only where an element lacks its code.
    """
    key = ["file_path", "start_line"]
    told = file_functions(files, with_code=False).where("told").select(F.col("path").alias("file_path"), "start_line", F.col("name").alias("found_name"), F.col("signature").alias("found_signature"), "doc")
    told = cut(told.dropDuplicates(key))
    few = told.count() <= BROADCAST_ROWS
    wanted = elements.where("type = 'function'").select("id", "name", "file_path", F.col("start_line").cast("int").alias("start_line"), "signature", "code")
    joined = wanted.join(F.broadcast(told) if few else told, key)
    own = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b)).alias(a)
    described = joined.select("id", *key, own("name", "found_name"), own("signature", "found_signature"), "code", F.col("doc").alias("documentation"))
    has = F.coalesce(F.col("code") != "", F.lit(False))
    lacking = cut(described.where(~has).drop("code"))
    places = lacking.select(F.col("file_path").alias("path")).distinct()
    found = file_functions(files.join(places, "path", "left_semi")).select(F.col("path").alias("file_path"), "start_line", "code").dropDuplicates(key)
    columns = ["id", "name", "signature", "code", "documentation"]
    return described.where(has).select(columns).unionByName(lacking.join(found, key).select(columns))
