"""Understanding of questions as column expressions, so that a table of questions is handled at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning in a question, and in its words of code.
STOP_WORDS = "the is at which on a an and or but in of to for with how what where when why does do this that it from are was were be has have had can could would should will i me my we our you your".split()
CODE_STOP_WORDS = "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might can this that these those i you he she it we they".split()
# Parts of words that show several concepts, or technical depth.
MULTI = ["and", "also", "both", "between", "compare", "relationship", "interact", "flow"]
TECHNICAL = ["architecture", "design pattern", "inheritance", "dependency", "concurrency", "thread", "async", "lifecycle", "pipeline", "algorithm"]
# The kinds of question with their signs, in the order in which they are tried.
CLASSES = [
    ("locate", ["where", "find", "locate"]),
    ("debug", ["bug", "error", "fix", "wrong"]),
    ("howto", ["how to", "how do", "implement"]),
    ("overview", ["overview", "architecture", "structure"]),
]
# Intents with their signs; most signs win, then the order.
INTENTS = [
    ("how", ["how", "implement", "create", "build", "make"]),
    ("what", ["what", "is", "are", "does", "define", "purpose"]),
    ("where", ["where", "locate", "find", "which file"]),
    ("debug", ["error", "bug", "issue", "problem", "fix", "why not", "doesn't work"]),
    ("explain", ["explain", "describe", "tell me about", "understand"]),
    ("find", ["find", "search", "locate", "show me", "list"]),
    ("implement", ["implement", "write", "code", "develop", "algorithm"]),
]
# Words of code, and words by which a question is about code.
CODE_WORDS = "function method class module variable parameter return import export api endpoint route database query model schema table authentication auth login user session test unittest spec testing".split()
ABOUT_CODE = ["function", "class", "method", "variable", "code", "implementation", "how to", "algorithm", "logic", "file", "module", "import", "api", "endpoint"]
# Words that are searched for together.
SYNONYMS = {
    "function": ["function", "method", "procedure", "routine"],
    "method": ["method", "function", "member function"],
    "class": ["class", "object", "type"],
    "error": ["error", "exception", "bug", "issue"],
    "api": ["api", "endpoint", "route", "service"],
    "database": ["database", "db", "storage", "persistence"],
    "auth": ["authentication", "authorization", "auth", "login"],
    "test": ["test", "unittest", "spec", "testing"],
}
# How a question must name a language to ask for it; the first that fits decides.
LANGUAGES = {
    "python": [r"\bin\s+python\b", r"\bpython\s+(code|implementation|script|function|class|module)\b", r"\busing\s+python\b", r"\bwritten\s+in\s+python\b", r"\bpython\s+implement"],
    "javascript": [r"\bin\s+javascript\b", r"\bjavascript\s+(code|implementation|function|class|module)\b", r"\busing\s+javascript\b", r"\bin\s+js\b", r"\bjs\s+(code|implementation)\b"],
    "typescript": [r"\bin\s+typescript\b", r"\btypescript\s+(code|implementation|function|class|module)\b", r"\busing\s+typescript\b", r"\bts\s+(code|implementation)\b"],
    "java": [r"\bin\s+java\b", r"\bjava\s+(code|implementation|class|method)\b", r"\busing\s+java\b"],
    "go": [r"\bin\s+go\b", r"\bgo\s+(code|implementation|function|package)\b", r"\busing\s+go\b", r"\bin\s+golang\b", r"\bgolang\s+(code|implementation)\b"],
    "cpp": [r"\bin\s+c\+\+\b", r"\bc\+\+\s+(code|implementation|class|function)\b", r"\busing\s+c\+\+\b"],
    "rust": [r"\bin\s+rust\b", r"\brust\s+(code|implementation|function|module)\b", r"\busing\s+rust\b"],
}
# Words of questions that ask how to make something.
MAKING = ["implement", "how to", "write", "create", "build", "develop", "algorithm", "logic", "code for", "function that", "method that"]
#: Parts of a question at most.
MOST_PARTS = 3
_NAME = r"([\p{L}\p{N}_]+)"


def _any(text: Column, signs: list[str]) -> Column:
    return reduce(lambda c, s: c | text.contains(s), signs, F.lit(False))


def keywords(question: Column) -> Column:
    """Words of at least two bytes in lower case without stop words, each once, in order."""
    words = F.split(F.lower(question), r"[^\p{L}\p{Nd}_.]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def code_keywords(question: Column) -> Column:
    """Words of more than two characters in lower case without stop words; words of code come first; repeated ones stay."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(_NAME)), lambda w: (F.length(w) > 2) & ~w.isin(*CODE_STOP_WORDS))
    return F.concat(F.filter(words, lambda w: w.isin(*CODE_WORDS)), F.filter(words, lambda w: ~w.isin(*CODE_WORDS)))


def word_count(question: Column) -> Column:
    return F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))


def complexity(question: Column) -> Column:
    """0 to 100 from the number of words and keywords, several concepts, technical words and a question mark."""
    n, k, low = word_count(question), F.size(keywords(question)), F.lower(question)
    score = (
        F.when(n > 15, 30).when(n > 8, 20).otherwise(10)
        + F.when(k > 6, 20).when(k > 3, 10).otherwise(0)
        + F.when(_any(low, MULTI), 10).otherwise(0)
        + F.when(_any(low, TECHNICAL), 15).otherwise(0)
        + F.when(question.contains("?"), 5).otherwise(0)
    )
    return F.least(score, F.lit(100))


def classify(question: Column) -> Column:
    """The first class with a sign in the question; understand if there is none."""
    low = F.lower(question)
    return reduce(lambda c, x: c.when(_any(low, x[1]), x[0]), CLASSES, F.when(F.lit(False), "")).otherwise("understand")


def intent(question: Column) -> Column:
    """The intent with the most signs, the first of them on ties; general if none has any."""
    low = F.lower(question)
    hits = [sum((low.contains(s).cast("int") for s in signs), F.lit(0)) for _, signs in INTENTS]
    best = F.greatest(*hits)
    return F.when(best == 0, F.lit("general")).otherwise(reduce(lambda c, x: c.when(x[1] == best, x[0][0]), zip(INTENTS, hits, strict=True), F.when(F.lit(False), "")))


def expand(words: Column) -> Column:
    """Each word followed by what is searched with it, each once, in order."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array(w)))))


def expand_question(question: Column) -> Column:
    """The words of a question in lower case with what is searched with them, each once, in order."""
    return expand(F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != ""))


def parts(question: Column) -> Column:
    """Up to three parts of a question of ten or more words, cut at conjunctions one after another; parts of up to 15 characters are dropped."""
    cut = lambda pieces, mark: F.flatten(F.transform(pieces, lambda p: F.split(p, mark)))
    pieces = reduce(cut, (" and ", " or ", ", ", "; "), F.array(question))
    stripped = F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.filter(stripped, lambda p: (F.length(p) > 15) & (p != question))
    return F.when(word_count(question) >= 10, F.slice(kept, 1, MOST_PARTS)).otherwise(F.array().cast("array<string>"))


def file_filter(question: Column) -> Column:
    """The extension that the question names first, such as .py; empty if none."""
    return F.regexp_extract(F.lower(question), r"(\.(?:py|js|ts|java|go|cpp|c|rs|rb|php|cs))\b", 1)


def language_filter(question: Column) -> Column:
    """The language that the question asks for; null if none."""
    low = F.lower(question)
    return F.coalesce(*(F.when(low.rlike("|".join(patterns)), F.lit(name)) for name, patterns in LANGUAGES.items()))


def path_filter(question: Column) -> Column:
    """The first quoted text that may be a path; empty if none."""
    return F.regexp_extract(question, r"[\"']([a-zA-Z0-9_/.-]+)[\"']", 1)


def wants_rewriting(question: Column) -> Column:
    """Whether a question is about making something, long or technical, or so short that it is vague."""
    low = F.lower(question)
    technical = sum((low.contains(w).cast("int") for w in CODE_WORDS), F.lit(0))
    return _any(low, MAKING) | (technical >= 3) | (word_count(question) >= 15) | ((word_count(question) <= 5) & (technical <= 1))


def about_code(question: Column) -> Column:
    """Whether a question is about code."""
    return _any(F.lower(question), ABOUT_CODE)


def rounds(score: Column, factor: Column, base: int = 4) -> Column:
    """How many rounds a question of this complexity gets in a repository of this factor: two to six."""
    mean = (score / 100 + factor) / 2
    return F.greatest(F.least((base * (0.7 + 0.6 * mean)).cast("int"), F.lit(6)), F.lit(2))


# How a question names an entity of code, with the type of the entity, in the order in which they are tried.
ENTITIES = [
    (r"function\s+(?:named\s+)?[\"']?([\p{L}\p{N}_]+)[\"']?", "function"),
    (r"class\s+(?:named\s+)?[\"']?([\p{L}\p{N}_]+)[\"']?", "class"),
    (r"method\s+(?:named\s+)?[\"']?([\p{L}\p{N}_]+)[\"']?", "function"),
    (r"[\"']([\p{L}\p{N}_]+)[\"']?\s+function", "function"),
    (r"[\"']([\p{L}\p{N}_]+)[\"']?\s+class", "class"),
]


def entity(question: Column) -> Column:
    """(type, name) of the code entity that the question names, in lower case; null if none."""
    low = F.lower(question)
    found = [F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")) for pattern, _ in ENTITIES]
    return F.coalesce(*(F.when(name.isNotNull(), F.struct(F.lit(kind).alias("type"), name.alias("name"))) for name, (_, kind) in zip(found, ENTITIES, strict=True)))


def confidence_threshold(score: Column) -> Column:
    """What an answer must reach: simple questions must be surer."""
    return F.when(score < 30, 95).when(score < 60, 92).otherwise(90)


def line_budget(score: Column, base: int = 12_000) -> Column:
    return (F.when(score < 30, 0.6).when(score < 60, 0.8).otherwise(1.0) * base).cast("int")


def first_json(reply: Column, schema: str, fallback: Column) -> Column:
    """The JSON object in a model's reply (fenced, or from the first to the last brace) by schema; else the fallback."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.from_json(F.coalesce(fenced, braces), schema), fallback)
