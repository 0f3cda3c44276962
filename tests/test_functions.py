from pyspark.sql import functions as F

from codescout.functions import patterns as pt
from codescout.functions import query as q
from codescout.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="def parse_file(path: str) a 1x") == ["def", "parse", "file", "path", "str", "1x"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []
    assert one(spark, tx.tokens(F.col("t"), "compat"), t=" Foo_bar  baz ") == ["foo_bar", "baz"]


def test_search_text_has_the_whole_code(spark):
    parts = [F.lit(x) for x in ("f", "function", "python", "a.py", "", "", "")]
    code = "x " * 600 + "needle"
    assert one(spark, tx.search_text(*parts, F.col("c")), c=code) == "f function python a.py " + code
    assert one(spark, tx.search_text(*parts, F.col("c"), 10), c=code) == "f function python a.py " + code[:10]


def test_lines(spark):
    for text, n in (("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("a\n\n", 2)):
        assert one(spark, tx.count_lines(F.col("t")), t=text) == n
    assert one(spark, tx.line_slice(F.col("t"), F.lit(2), F.lit(9)), t="a\nb\nc") == "b\nc"
    assert one(spark, tx.line_slice(F.col("t"), F.lit(3), F.lit(2)), t="a\nb\nc") == ""
    assert one(spark, tx.truncate(F.col("t"), 3), t="abcd") == "abc\n... (truncated)"


def test_module_path(spark):
    for path, module in (("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", None), ("a/b.go", None), ("a?b.py", None)):
        assert one(spark, tx.module_path(F.col("p")), p=path) == module


def test_word_windows(spark):
    got = one(spark, tx.word_windows(F.col("t"), 4, 1), t="a b c d e f g")
    assert [r["text"] for r in got] == ["a b c d", "d e f g"]
    assert one(spark, tx.word_windows(F.col("t"), 4, 1), t="  ") is None


def test_globs(spark):
    for path, glob, hit in (("src/a.py", "src/*.py", True), ("x/a.py", "src/*.py", True), ("a.go", "*.py", False), ("a/b/c.go", "a/**/*.go", True), ("b", "?", True), ("[", "[a-c]", False)):
        assert one(spark, pt.glob_match(F.col("p"), glob), p=path) is hit


def test_ignore_rules(spark):
    rules = ["*.log", "build/", "!keep.log", "secret", "# no rule", ""]
    for path, hit in (("a/x.log", True), ("keep.log", False), ("a/build/x.py", True), ("build.py", False), ("a/secret/b", True), ("secret", True), ("b.py", False)):
        assert one(spark, pt.ignored(F.col("p"), rules), p=path) is hit, path


def test_questions(spark):
    classes = (("Where is the payment handler defined?", "locate"), ("Explain the authentication flow", "understand"), ("How to implement a new endpoint?", "howto"), ("There's a bug in the login function", "debug"), ("Give me an overview of the architecture", "overview"), ("the prefix of it", "debug"))
    for text, kind in classes:
        assert one(spark, q.classify(F.col("t")), t=text) == kind
    assert one(spark, q.keywords(F.col("t")), t="How does the parse_file parse the file? é x 漢") == ["parse_file", "parse", "file", "é", "漢"]
    assert one(spark, q.code_keywords(F.col("t")), t="Show the parser of a Class and its method, parser") == ["class", "method", "show", "parser", "its", "parser"]
    hard = "How do the authentication and authorization modules interact with the database layer and what design patterns are used?"
    assert one(spark, q.complexity(F.col("t")), t="where is main?") == 15
    assert one(spark, q.complexity(F.col("t")), t=hard) == 30 + 20 + 10 + 15 + 5
    assert one(spark, q.complexity(F.col("t")), t="the handler") == 20  # "and" lies within "handler"
    assert one(spark, q.intent(F.col("t")), t="why not fix the bug") == "debug"
    assert one(spark, q.entity(F.col("t")), t='what does function named "Load_All" do').asDict() == {"type": "function", "name": "load_all"}
    assert one(spark, q.entity(F.col("t")), t="nothing here") is None
    assert one(spark, q.expand_question(F.col("t")), t="Error in Auth") == ["error", "exception", "bug", "issue", "in", "authentication", "authorization", "auth", "login"]
    assert one(spark, q.parts(F.col("t")), t="one two three four five six seven, and the eighth of them all or nothing") == ["one two three four five six seven,", "the eighth of them all"]
    for text, language in (("sort it in golang please", "go"), ("django views", None), ("using typescript", "typescript"), ("python implements it", "python")):
        assert one(spark, q.language_filter(F.col("t")), t=text) == language
    assert one(spark, q.file_filter(F.col("t")), t="open A.PY and b.go") == ".py"
    assert one(spark, q.wants_rewriting(F.col("t")), t="this is a plain sentence of eight words") is False
    assert one(spark, q.about_code(F.col("t")), t="which module is it") is True
    reply = 'text ```json\n{"confidence": 60}\n``` more'
    assert one(spark, q.first_json(F.col("t"), "confidence int", F.lit(None))["confidence"], t=reply) == 60
    assert one(spark, q.first_json(F.col("t"), "confidence int", F.from_json(F.lit('{"confidence": 90}'), "confidence int"))["confidence"], t="none") == 90
