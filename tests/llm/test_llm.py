import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codescout.llm import docpairs, files, lexers, packing, secrets, splitting, subjects, tokenizer

# --- problem 6 -------------------------------------------------------------------------------------------------------

RANKS = os.path.join(tokenizer.TOKENIZER_DIR, tokenizer.RANKS_FILE)
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizer.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_ranks
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), max_size=6))
def test_ids_equal_a_reference(reference_encoding, texts):
    assert tokenizer.encoder(RANKS).encode_batch(texts) == [reference_encoding.encode_ordinary(t) for t in texts]


@needs_ranks
def test_encode_corpus(spark, reference_encoding):
    texts = [None, "", " ", "hello <|endoftext|> world", "a" * 5000, "=" * 3000, "日本語 ß é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(df).collect()}
    assert got == {i: (reference_encoding.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


# --- problem 7 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tasks", [3])
def test_pack(spark, tasks):
    r = random.Random(1)
    data = [(i, r.choice([0, 5, 100, 900, 1500, 2048, 5000, None, r.randint(1, 700)])) for i in range(400)] + [(1, 10)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, n_ids int"), tasks=tasks).collect()
    used, pieces = {}, {}
    for x in out:
        used[x["container_id"]] = used.get(x["container_id"], 0) + x["size"]
        pieces.setdefault(x["doc_id"], []).append((x["piece"], x["size"]))
    assert max(used.values()) <= 2048
    assert sum(used.values()) == sum(n or 0 for _, n in data)
    for i, n in data[2:400]:
        assert sum(s for _, s in pieces[i]) == (n or 0)
        assert len(pieces[i]) == max(1, -(-(n or 0) // 2048))
    assert len(pieces[1]) >= 2
    least = -(-sum(used.values()) // 2048)
    assert len(used) <= least * 1.06


def test_superstep_matches_as_one_sweep(spark):
    r = random.Random(5)
    docs = [(i, 0, r.randint(1, 60)) for i in range(150)]
    gaps = [(i, r.randint(1, 60)) for i in range(90)]
    made = lambda: (spark.createDataFrame(docs, "item long, piece int, size int"), spark.createDataFrame(gaps, "container_id long, gap int"))
    want, stack = [], []  # the same sweep, one by one: (gap, size) of each match
    for size, is_doc in sorted([(s, 1) for _, _, s in docs] + [(g, 0) for _, g in gaps], key=lambda x: (-x[0], x[1])):
        if not is_doc:
            stack.append(size)
        elif stack:
            want.append((stack.pop(), size))
    gap = dict(gaps)
    for tasks in (1, 2, 5):
        step, left, _, _ = packing.superstep(*made(), 60, 1, tasks)
        got = [(gap[x["container_id"]], x["size"]) for x in step.where("container_id is not null").collect()]
        assert sorted(got) == sorted(want) and left == len(docs) - len(want) and step.count() == len(docs)


def test_pack_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, n_ids int")
    assert packing.pack(empty).count() == 0
    zeros = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_ids int"))
    assert zeros.count() == 2
    ties = packing.pack(spark.createDataFrame([(i, 1024) for i in range(100)], "doc_id long, n_ids int"))
    assert ties.select("container_id").distinct().count() == 50


# --- problem 2 -------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab {};\n\r\té漢", max_size=90), max_size=60))
def test_split_rejoins(parts):
    code = "".join(parts)
    pieces = splitting.split_code(code, 300, 40)
    assert "".join(code[core:end] for _, core, end in pieces) == code
    for n, (start, core, end) in enumerate(pieces):
        assert end - start <= 300
        assert 0 <= core - start <= 40
        assert n == 0 or core == pieces[n - 1][2]


def test_split_oversized(spark):
    code = "".join(f"def f{i}(x):\n    return x + {i}\n\n\n" for i in range(200))
    df = spark.createDataFrame([("a", 10, code), ("b", 1, "short"), ("c", None, "x" * 5000), ("d", 1, None), ("e", 1, "")], "id string, start_line int, code string").withColumn("piece", F.lit(7))
    got = splitting.split_oversized(df).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {"a", "c"}
    a = [r for r in got if r["id"] == "a"]
    assert "".join(r["code"][r["n_overlap"] :] for r in a) == code
    assert a[0]["start_line"] == 10 and a[-1]["end_line"] == 9 + code.count("\n")
    assert all(r["code"][r["n_overlap"] :].lstrip("\n").startswith("def ") for r in a), "cuts lie between functions"
    assert all(r["start_line"] == r["end_line"] == 1 for r in got if r["id"] == "c")
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_valley_decides_the_cut():
    topic = lambda words, n: "".join(f"    {words[i % 3]}.{words[(i + 1) % 3]}({words[(i * 7) % 3]})\n" for i in range(n))
    code = topic(["apple", "cherry", "plum"], 26) + topic(["engine", "piston", "valve"], 30)
    code = code.replace("\n", "\n\n", 6)  # blank lines elsewhere do not draw the cut
    border = code.index("    engine")
    assert splitting.split_code(code, 1000, 100)[0][2] == border


# --- problem 1 -------------------------------------------------------------------------------------------------------

VALID = {
    "python": ["", "# only\n", "def f():\n    '''d'''\n    return {1: [2, (3,)]}\n", "s = '''\n<<<<<<< a\n'''\n"],
    "javascript": ["", "const a = `x ${b ? `y` : {c: 1}.c} z`;\nfor (const x of y) { f(x, ...z) }\nlet r = s.replace(/[{}()]+/g, ' ');", "/*\n<<<<<<< a\n=======\n*/\nexport default {a: 1, b() { return a ? b : c }};", "a = b\nc = d\nswitch (x) { case f(1): break; default: i++ }", "class A { get x() { return 1 } static async *y() {} #p = 3 }\nlabel: while (1) { continue label }"],
    "typescript": ["interface A { b: string; c?: number }\nexport async function f(a: string[], b?: Record<string, number>): Promise<string | null> { return null; }", "abstract class A<T> extends B { private readonly x: number = 1; constructor(public y: string) { super() } }\ntype U = 'a' | 'b';\nconst x = y as unknown as string;"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\nfunc (s *T) F(a, b []string) (int, error) {\n\tdefer func() { x++ }()\n\tfor i := 0; i < 3; i++ {\n\t}\n\treturn 1, nil\n}\n"],
    "java": ["", "package a.b;\nimport java.util.*;\n@X(1) public final class A<T extends B> extends C implements D {\n  char c = '{';\n  List<Map<String, Integer>> m = new HashMap<>();\n  int f(final int... x) throws E { return x -> x + 1; }\n}\n"],
    "rust": ["", "use a::{b, c};\n/* x /* y */ z */\n#[derive(Debug)]\npub struct A<'a> { x: &'a str }\nimpl<'a> A<'a> { fn f(&self) -> Option<char> { match self.x { \"a\" => Some('}'), _ => None } } }\nfn g() { let s = r#\"a\"b\"#; println!(\"{} {{\", s); }\n"],
    "c": ["", "#include <stdio.h>\n#ifdef A\n#define B(x) ((x) + 1)\n#endif\nstatic const char *s = \"a\" \"b\";\nint main(int argc, char **argv) {\n  for (int i = 0; i < 3; i++) { x[i] = *p++; }\n  return a ? b : c;\n}\n"],
    "json": ['{"a": [1, 2.5e3, true, null, "\\u00e9"], "b": {}}', "[]", "3"],
    "yaml": ["", "# c\n", "a:\n  b: 1\n  c: [x, {y: z}]\nd:\n- e\n- f: g\n  h: i\n", "a: |\n  <<<<<<< x\n  b\nc: 'it''s'\nd: \"x\n  y\"\n", '{"a": {"b": [1, 2]}}', "---\na: 1\n---\nb: 2\n", "url: http://a:80/b # c\n", "a: &x\n  b: 1\nc: *x\n", "plain text\n"],
    "toml": ["", "[a]\nb = 1\nc = [\"x\", 'y']\n[[d]]\ne = 1979-05-27\n"],
}
INVALID = {
    "python": ["def f(:\n", "x = (1,\n", "def f():\n", "if x:\npass\n", "s = 'abc\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = 1\n  y = 2\n", '"""open\n', "package main\n"],
    "javascript": ["function f() {", "const a = 'x\n", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "def f(x):\n    return x\n", "interface A { x: number }", "function f(a: string) { }", "const a: number = 1;", "import os\nimport re\n", "let a = ;", "f(1, [2)", "The module keeps every row next to its key."],
    "typescript": ["class A {", "const x: = 1", "def f(x):\n  pass\n", "let s = `a ${b`;", "package app.a;\nimport java.util.*;\n"],
    "go": ["", "// only\n", "func f() {}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nvar s = \"x\n"],
    "java": ["public class A {", "class A { int x = ; }", "def f():\n", "package main\n\nfunc f() {}\n", "class A { void f() { int x = 1 int } } }"],
    "rust": ["fn f() {", "fn f() { let x = ; }", "/* open", "def f():\n    pass\n", "#include <stdio.h>\nint main() { return 0; }\n"],
    "c": ["int f() {", "#if A\nint x;\n", "public class A { }", "def f():\n    return 1\n", "int x = ;", "/* open"],
    "json": ["", "{a: 1}", "[1,]", '{"a" 1}', "[NaN]", "// c\n{}", '{"a": 1} x', "['a']", "[01]"],
    "yaml": ["a: [1, 2\n", "a: b: c\n", "a:\n  b: 1\n c: 2\n", "a: 'x\n", "\ta: 1\n", "a: 1\nplain\n", "<<<<<<< HEAD\na: 1\n=======\na: 2\n>>>>>>> x\n", "[table]\nkey = 1\n", "- a\nb: c\n", "a: @x\n"],
    "toml": ["a = \n", "[a\nb = 1\n", "a: 1\n", "a = 'x\n"],
}


MORE_VALID = {
    "javascript": [
        'load().catch(e => log(e))',
        'p.then(a).catch(b).finally(c)',
        'Symbol.for("x")',
        'it.return(1)',
        'x.throw(e)',
        '({catch: 1, for: 2})',
        'const o = {catch: 1, for: 2, default: 3, return() { return 1 }};',
        'if (a<-1) b()',
        'class A { static async *gen() { yield* x; } get(k) { return k } delete(x) {} #p = 1; static { x() } foo = () => {} }',
        'a = b ? c : d;\nfor (;;) { break }\nfor (let i=0; i<3; i++) f(i);\nfor (const x of y) {}',
        'label: for (const k in o) { continue label }',
        'const {a, b: {c}} = x, [d,, e] = y;',
        'switch (x) { case "a": case 1: f(); break; default: g() }',
        'x = y\n++z',
        'let f = async (a, b = 2, ...c) => ({a, b});',
        'new Foo; new Bar(); typeof x === "y"; void 0; delete a.b',
        'export * as n from "x"; import a, {b as c} from "d"; export {default} from "e"',
        'let of = 1; let get = 2; of + get',
        'a = `x${b}` + tag`y${c}`',
        'x = a ?. b ?? c',
        'do x++; while (x < 3)',
        'if (a) return; else throw new E()',
        'var x = function*() {}',
        'a = {get x() { return 1 }, set x(v) {}, async y() {}, "z": 1, [k]: 2, 3: 4}',
        'async function f() { for await (const x of y) {} }',
        'var x = 1e+5, y = 0xFFn, z = .5',
    ],
    "typescript": [
        'type A = { readonly a?: string; b(): void };',
        'let x = <T,>(a: T) => a;',
        'enum A { B = 1, C }',
        'function f<T extends keyof U>(this: X, a?: T): asserts a is T { }',
        'abstract class A { private constructor(readonly x: number) { super() } declare y: string; abstract z(): void; get w(): string { return "" } }',
        'const a = b as const; const c = d satisfies E;',
        'declare module "x" { export default function f(): void }',
        'type F = (a: number) => string | undefined;\ntype G = | A | B;',
        'import type { A } from "b"; export type { C }',
        'let t: [a: string, b?: number] = x!;',
    ],
    "rust": [
        'fn a() -> impl Fn() { || 1 }',
        'fn a() { let x = if y { 1 } else { 2 }; match x { 0..=9 => {} _ if z => (), Some(ref a) | None => return } }',
        "pub(crate) struct A<'a, T: Fn(u8) -> u8>(&'a T);",
        'fn a() { let [x, ..] = y; for i in 0..10 { break } loop {} }',
        'macro_rules! m { ($a:expr, $($b:tt)*) => { $a; $($b)* } }',
        'fn f() { x.await?; y::<Vec<u8>>(); a as usize; }',
        'impl<T> A for B<T> where T: C { type D = E; const F: u8 = 1; }',
    ],
    "c": [
        'int main(void) { return 0; }',
        'struct a { int b : 3; } c = { .b = 1 };',
        'typedef int (*f)(int, char *);',
        'enum { A, B = 2 };',
        'int a[] = {1, 2, 3,};',
        'static inline void f(unsigned int a, struct b *c) { if (a) { x(); } else y(); do { z++; } while (0); }',
        'extern "C" {\nint f(void);\n}',
        '#define X(a) do { a } while (0)\nint f(void) { X(y) }',
    ],
    "java": [
        'class A { int x = 1; int f(final int a, String... b) throws E { return a; } }',
        'interface A<T> { default void f() {} }',
        'class A { List<List<String>> a = new ArrayList<>(); int[] b = {1, 2,}; Runnable r = () -> { x(); }; Function<A,B> g = A::new; }',
        'class A { void f() { for (int i = 0; i < 3; i++) {} for (String s : t) {} label: while (true) break label; switch (x) { case 1 -> y(); default -> { } } } }',
        'record A(int x, int y) { }',
        '@A(b = 1, c = {2, 3}) public enum B { C, D(1) { int f() { return 1; } }; B() {} }',
    ],
    "go": [
        'package a\nfunc f(a, b int) (x int, err error) { if x := g(); x > 0 { return x, nil }; for i := range y { _ = i }; select { case <-c: default: }; return }\n',
        'package a\ntype T[K comparable, V any] struct { a K `json:"a"`; *B }\nvar x = map[string][]int{"a": {1, 2}}\n',
    ],
    "yaml": [
        '? a\n: b\n',
        'a:\n  ? b\n  : c\n',
        'a: |2\n   x\n  y\n',
        '- - a\n  - b\n- c: d\n',
        'a: !!str x\nb: >-\n  t\n\n  u\nc: 1\n',
    ],
    "python": [
        'def f(a, /, b, *, c=1, **d) -> int: return a\n',
        'x: int = 1\nasync def g():\n    async with a as b, c as d:\n        await e\n',
        'match x:\n    case [1, *rest] if y: pass\n    case {"a": b, **c}:\n        pass\n    case A(b=1) | None: pass\n',
        'type X[T] = list[T]\n',
        'f"{x["a"]!r:>{w}} {{}}"\n',
        'lambda: (yield)\n',
        'try: pass\nexcept* E as e: pass\nelse: pass\nfinally: pass\n',
        'print(a if b else c, *d, **e)\n',
        'x = [i for i in y if i for j in z]\nx[1:2, ::3] = 1\n',
        'from . import (a, b as c,)\nfrom ...d.e import *\nimport f.g as h, i\n',
        '@a.b(c)\nclass D(E, metaclass=F): x = 1; y = 2\n',
        'if (n := f()) > 1: pass\nelif not n: pass\nelse: pass\n',
        'match = 1; case = 2; type = 3\nmatch.x(case)\nprint(type)\n',
        'with (open(a) as b, c): pass\n',
        'del a, b[0]\nassert a, "b"\nraise E from None\nglobal q, r\n',
        'x = yield from y\nx = *a, b\nreturn\n',
        '0x_ff; 1_000.5e-3j; 0o17; 00; .5; 1.\n',
        'for x, *y in z: continue\nelse: pass\nwhile 1: break\n',
        'a = b = c\na += 1\na @= b\na: int\n',
        'x = not a in b is not c and d or e\n',
        '"""doc"""\n',
        'class A[T: int, *U, **V]: pass\n',
        'x = {**a, "b": 1, **c}; y = {1, *z}; w = {k: v for k, v in q}\n',
        'print(*args, sep="")\nx = a[b](c).d\n',
        'if x:\n    pass\n# c\nelse:\n    pass\n',
    ],
    "toml": [
        'a.b."c d" = 1\n[x."y".z]\nb = 1979-05-27T07:32:00Z\nc = {d = 1, e.f = [1, 2,\n 3,]}\n[[p]]\n',
        'a = 0x1f\nb = -1_000.5e+3\nc = inf\nd = """x\ny"""\ne = \'\'\'z\'\'\'\nf = 07:32:00\ng = true # c\n',
        '[a]\r\nb = 1\r\n',
    ],
}
MORE_INVALID = {
    "c": [
        'int main(void) { return 0 }',
        'int f(int a b);',
        'int f(int a b) { return a; }',
        'foo(1,,2);',
        'void f(void) { foo(1,,2); }',
    ],
    "java": [
        'class A { int x = 1 int y; }',
        'interface { }',
        'class A { void f() { foo(1,,2); } }',
        'class { }',
    ],
    "javascript": [
        'class A { foo: 1 }',
        'var 1a = 2',
        'x = a +* b',
        'for (let i=0; i<3, i++) {}',
        'foo(1,,2)',
        'function (a { }',
        'if x { }',
        'let x = ',
        'const a: b = 1',
        'a b c',
        'return }',
        'f(a; b)',
        'x = {a: 1, b: }',
        'else { }}',
        'x = 3px',
    ],
    "typescript": [
        'interface { }',
        'foo(1,,2)',
        'let x: = 1',
        'a + * b',
    ],
    "rust": [
        'fn f() { let x = ; }',
        'fn f( { }',
        'let x = 1',
        'fn f() { a b }',
        'fn f() { 1x }',
    ],
    "go": [
        'package a\nfunc f() { x = = 1 }\n',
        'package a\nfunc f() { foo(1,,2) }\n',
    ],
    "yaml": [
        'a: |\n  x\n y\n',
        'a: >\n    x\n  y\nb: 1\n',
    ],
    "python": [
        '... [cut] ...\n',
        '    \n  x = 1\n',
        '// c\nx = 1\n',
        'x = 343L\n',
        'def f():\n    return x +\n',
        'try:\n    pass\nx = 1\n',
        'else:\n    pass\n',
        'print "x"\n',
        'if x = 1: pass\n',
        'f() = 1\n',
        '1 = x\n',
        'def f(a b): pass\n',
        'x = = 1\n',
        'class A\n    pass\n',
        'use std::env;\n',
        'import\n',
        'from x import\n',
        'x = [1,, 2]\n',
        'for x y: pass\n',
        'while: pass\n',
        'f(,a)\n',
        'a → b\n',
        '0777\n',
        'x = a b\n',
        'None = 1\n',
        'return = 2\n',
        'def = 1\n',
        'x = (1 2)\n',
        'lambda x y: 1\n',
        'import a.\n',
        'try:\n    x\n',
        'x++\n',
        'if x:\n    pass\nelse if y:\n    pass\n',
        'x = a ? b : c\n',
        'func f() { }\n',
        'def f():\n    x = 1;;\n',
    ],
    "toml": [
        'a = 1 b = 2\n',
        '[a]]\n',
        'a = \n',
        '= 1\n',
        'a.= 1\n',
        'a = [1 2]\n',
        'a = {b = 1\n}\n',
        'a = tru\n',
        '<<<<<<< x\n',
        'a: 1\n',
        'a = 01\n',
        '[a\n',
        'a = "x" y\n',
        '[a]\n[a]\n',
        'a=1\na=2\n',
        'a = 1..2\n',
    ],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_lexers(language):
    assert [t for t in MORE_VALID.get(language, []) if lexers.problem(language, t)] == []
    assert [t for t in MORE_INVALID.get(language, []) if not lexers.problem(language, t)] == []
    assert [t for t in VALID[language] if lexers.problem(language, t)] == []
    assert [t for t in INVALID[language] if not lexers.problem(language, t)] == []


def test_python_and_toml_equal_their_parsers():
    """The installed library against the interpreter's own parser, and each of its files with a line cut off in the middle."""
    import ast
    import pathlib
    import warnings

    warnings.simplefilter("ignore")
    checked, wrong = 0, []
    r = random.Random(3)
    for path in sorted(pathlib.Path(os.__file__).parent.glob("*.py"))[:120]:
        text = path.read_text(encoding="utf-8")
        lines = text.split("\n")
        at = r.randrange(len(lines))
        for one in (text, "\n".join([*lines[:at], lines[at][: len(lines[at]) // 2], *lines[at + 1 :]])):
            try:
                ast.parse(one)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            checked += 1
            if valid != (lexers.problem("python", one) is None):
                wrong.append((path.name, valid, lexers.problem("python", one)))
    assert len(wrong) <= 0.02 * checked, wrong


def test_parse_faults(spark):
    df = spark.createDataFrame([("/a/x.PY", "r", "x = ("), ("/a/x.PY", "r", "x = ("), ("/a/y.md", "r", "x = ("), (None, None, "x"), ("/a/z.go", "r", None)], "path string, repo_name string, content string").withColumn("language", F.lit("clash"))
    out = files.parse_faults(df)
    assert {r["path"] for r in out.where("fault is not null").collect()} == {"/a/x.PY"}
    rates = {(r["repo_name"], r["language"]): (r["n_files"], r["n_invalid"]) for r in files.fault_rates(df).collect()}
    assert rates["r", "python"] == (1, 1) and rates["r", "markdown"] == (1, 0)
    assert files.fault_rates(df.limit(0)).count() == 0


# --- problem 3 -------------------------------------------------------------------------------------------------------


def test_not_hand_written(spark):
    body = "\n".join(f"def step_{w}(alpha_{w}, beta_{w}):\n    return alpha_{w} * beta_{w} + gamma_{w}({i})\n" for i, w in enumerate("abcdefghij"))
    by_hand = "import os\n\n# Reads files generated by atool and checks them.\n\ndef main(path):\n    with open(path) as f:\n        return f.read()\n"
    rows = [
        ("red-a", "vendor/kit/x.py", by_hand),
        ("red-a", "vendor_portal/x.py", by_hand.replace("main", "first")),
        ("red-a", "gen.py", "# Code generated by atool. DO NOT EDIT.\nx = 1\n"),
        ("red-a", "banner.py", by_hand.replace("# Reads", 'BANNER = "# Code generated by atool. DO NOT EDIT."\n# Reads')),
        ("red-a", "copy.py", "# moved here\n" + body.replace("step_a", "walk_a")),
        ("red-a", "package-lock.json", '{"lockfileVersion": 3}'),
        ("red-a", "settings.json", '{"a": 1}'),
        ("red-a", "app.min.js", "".join(f"function f{i}(a,b){{return a>b?a:b+{i}}}" for i in range(40))),
        ("red-a", "data.py", "ROWS = [\n" + "".join(f"    ({i}, {i * 7}, 'x{i}'),\n" for i in range(60)) + "]\n"),
        ("red-a", "broken.py", "# Code generated by atool. DO NOT EDIT.\nx = (\n"),
        ("red-a", "empty.py", ""),
        ("red-a", "null.py", None),
        *((repo, f"lib/inner/{n}.go", f"package inner\n\nfunc F{n}(a int) int {{\n\treturn a + {n}\n}}\n") for repo in ("red-a", "blue-b") for n in range(2)),
        ("red-c", "lib/inner/0.go", "package inner\n\nfunc F0(a int) int {\n\treturn a + 0\n}\n"),
    ]
    df = spark.createDataFrame([(repo, f"/srv/{repo}/{rel}", rel, text) for repo, rel, text in [*rows, rows[0]]], "repo_name string, path string, relative_path string, content string").withColumn("hash", F.lit(1))
    lib = spark.createDataFrame([("lib", "x.py", body), ("none", None, None)], "lib_name string, file_name string, content string")
    found = {r["path"].removeprefix("/srv/"): r["reason"] for r in files.not_hand_written(df, lib).collect()}
    assert found == {
        "red-a/vendor/kit/x.py": "vendored",
        "red-c/lib/inner/0.go": "root",  # what lies below lib is shared
        "red-a/gen.py": "generated",
        "red-a/copy.py": "lines",
        "red-a/package-lock.json": "lockfile",
        "red-a/app.min.js": "minified",
        "red-a/data.py": "data",
        **{f"{repo}/lib/inner/{n}.go": "subtree" for repo in ("red-a", "blue-b") for n in range(2)},
    }
    assert files.not_hand_written(df.limit(0), lib).count() == 0


def test_merkle_tree_is_built_of_children(spark):
    rows = [("x", "x-1", "a/b/f", 5), ("x", "x-1", "a/b/g", 6), ("x", "x-1", "a/h", 7), ("y", "y-1", "q/b/f", 5), ("y", "y-1", "q/b/g", 6), ("y", "y-1", "q/c/f", 6), ("y", "y-1", "b/q/f", 5), ("y", "y-1", "/".join("d" * 90) + "/f", 5)]
    df = spark.createDataFrame(rows, "family string, repo_name string, relative_path string, leaf long")
    nodes = {(r["repo_name"], r["dir"]): (tuple(r["hash"]), r["n_files"]) for r in files.merkle_tree(df).collect()}
    assert nodes["x-1", "a/b"] == nodes["y-1", "q/b"]
    assert len({nodes[k] for k in (("x-1", "a"), ("y-1", "q"), ("y-1", "q/c"), ("y-1", "b"), ("y-1", "b/q"))}) == 5
    assert nodes["x-1", "a"][1] == 3 and ("y-1", "/".join("d" * 90)) in nodes
    assert {r["dir"] for r in files.shared(files.merkle_tree(df)).collect()} == {"a/b", "q/b"}


def test_roots_of_vendored_code(spark):
    body = lambda k: "\n".join(f"def step_{w}_{k}(a):\n    return alpha_{w}_{k} * beta_{w}(a)\n" for w in "abcdefgh")
    lib = spark.createDataFrame([(f"lib{k}", "f.py", body(k)) for k in range(4)], "lib_name string, file_name string, content string")
    rows = [(f"{family}-a", f"bought/lib{k}/g{k}.py", body(k)) for k, family in enumerate(("red", "blue", "green", "grey"))]
    rows += [("red-a", "bought/other/own.py", body("z")), ("red-a", "src/own.py", body("y")), ("red-a", "bought/broken.py", body("w") + "x = (")]
    df = spark.createDataFrame([(r, f"/srv/{r}/{p}", p, c) for r, p, c in rows], "repo_name string, path string, relative_path string, content string")
    found = {r["path"]: r["reason"] for r in files.not_hand_written(df, lib).collect()}
    assert found == {**{f"/srv/{r}/{p}": "leaf" for r, p, _ in rows[:4]}, "/srv/red-a/bought/other/own.py": "root"}


# --- problem 4 -------------------------------------------------------------------------------------------------------


def test_field_on_new_lines():
    field = secrets.trained_field()
    wrong = 0
    lines = secrets.training_lines(600, seed=1234)
    for line, spans in lines:
        tokens = secrets.lexical_tokens(line)
        gold = [int(any(a < high and low < b for a, b in spans)) for low, high, _, _ in tokens]
        wrong += field.viterbi(secrets.features(tokens)) != gold
    assert wrong < 0.03 * len(lines)


def test_viterbi_is_the_best_path():
    from itertools import product

    field = secrets.Field()
    r = random.Random(2)
    field.step = [[r.uniform(-1, 1) for _ in "ab"] for _ in "ab"]
    field.weight = {f"f{i}": r.uniform(-2, 2) for i in range(6)}
    for n in range(1, 7):
        rows = [[f"f{r.randint(0, 5)}"] for _ in range(n)]
        score = field.scores(rows)
        value = lambda path: sum(s for s, y in zip(score, path, strict=True) if y) + sum(field.step[a][b] for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        assert value(field.viterbi(rows)) == pytest.approx(max(map(value, product((0, 1), repeat=n))))


def test_find_secrets(spark):
    code = 'x = 1\napi_key = "AKIA' + "Q7" * 8 + '"\npassword = os.environ["PW"]\nurl = "postgres://svc:Tulip!garden41@db.example/x"\nkey = """-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----"""\n'
    df = spark.createDataFrame([("a", "file", code), ("b", "documentation", code), ("c", "function", None), ("d", "function", ""), ("e", None, "return x\n"), ("f", None, code)], "id string, type string, code string").withColumn("line_nos", F.lit("clash"))
    found = {r["id"]: r for r in secrets.find_secrets(df).collect()}
    assert found.keys() == {"a", "f"}
    assert found["a"]["line_nos"] == [2, 4, 5]
    assert found["a"]["code"] == 'x = 1\napi_key = "REDACTED"\npassword = os.environ["PW"]\nurl = "postgres://svc:REDACTED@db.example/x"\nkey = """REDACTED"""\n'
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_lines_without_words_of_secrets():
    finder = secrets.Finder(secrets.trained_field())
    found = lambda code: [code[a:b] for parts in finder.in_code(code) for a, b in parts]
    assert found('hmacKey = "correct-horse-battery"') == ["correct-horse-battery"]
    assert found('connect("db.example", "svc_a", "qwGlmmWo3nAFEi")') == ["qwGlmmWo3nAFEi"]
    assert found("# dump with mysql -uroot -pS3cretPw9x1") == ["S3cretPw9x1"]
    for code in ('token = "next_page_token"', '"""Inherited."""', "rows = items(key_size)", 'k = "-----BEGIN PUBLIC KEY-----\\nAb3\\n-----END PUBLIC KEY-----"', "# ssh -p222222"):
        assert not found(code), code


# --- problem 5 -------------------------------------------------------------------------------------------------------


def test_says_something():
    says = ["Seconds left until the session expires.", "/** Drops each row that has no key. */", "// 返回尚未处理的条目，空列表表示全部完成。", ":param x: the rows that were seen last\n:return: nothing", "// Liefert den Rest.\n// eslint-disable-next-line"]
    empty = ["", "TODO: write docs", "/** */", "// ------", "// eslint-disable-next-line no-undef", "Loads the rows.", "This function will load rows.", "See base class.", "@param x\n@return", "Args:\n    x:\nReturns:", "{@inheritDoc}", "/// ...", "Helper function."]
    assert [d for d in says if not docpairs.says_something(d, "load_rows")] == []
    assert [d for d in empty if docpairs.says_something(d, "load_rows")] == []


def test_documented(spark):
    js = "/** Drops each row that has no key. */\nexport function clean(a) {\n  return a;\n}\n\n// Not directly above it.\n\nfunction far(b) {\n  return b;\n}\nfoo(); // behind code\nfunction near() {\n}\n"
    py = 'class A:\n    @x\n    def f(self, a=")"):\n        """Seconds left until it ends."""\n        return 1\n\n    def g(self):\n        return 2\n'
    source = spark.createDataFrame([("/r/a.js", js), ("/r/b.py", py), ("/r/b.py", py), ("/r/c.js", None), (None, js)], "path string, content string").withColumn("start_line", F.lit("clash"))
    elements = spark.createDataFrame(
        [("1", "function", "clean", "/r/a.js", 2, None, "x"), ("2", "function", "far", "/r/a.js", 8, "", None), ("3", "function", "near", "/r/a.js", 12, "", ""), ("4", "function", "f", "/r/b.py", 3, None, None), ("4", "function", "f", "/r/b.py", 3, None, None), ("5", "function", "g", "/r/b.py", 7, "", "y"), ("6", "class", "A", "/r/b.py", 3, "", ""), ("7", "function", None, None, None, None, None)],
        "id string, type string, name string, file_path string, start_line int, signature string, code string",
    )
    assert {r["id"] for r in docpairs.documented_ids(elements, source).collect()} == {"1", "4"}
    pairs = {r["id"]: r for r in docpairs.code_doc_pairs(elements, source).collect()}
    assert pairs["1"]["code"] == "x" and pairs["1"]["signature"] == "export function clean(a)"
    assert pairs["4"]["documentation"] == "Seconds left until it ends." and pairs["4"]["code"].startswith("    def f") and pairs["4"]["code"].endswith("return 1")
    assert docpairs.documented_ids(elements.limit(0), source).count() == 0


def test_bodies_and_fields():
    py = 'def f():\n    """Seconds left."""\n    x = """\nat the margin\n"""\n    return x\n\ny = 1\n'
    (start, end, name, _, code, doc), *more = docpairs.functions_of("python", py)
    assert (start, end, name, doc, more) == (1, 6, "f", "Seconds left.", []) and code.endswith("return x")
    js = "class A {\n  // Draws the rest of the rows.\n  draw = async (a) => {\n    return a;\n  };\n}\n"
    assert [(f[0], f[2], f[5]) for f in docpairs.functions_of("javascript", js)] == [(3, "draw", "  // Draws the rest of the rows.")]


# --- problem 8 -------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    r = random.Random(4)
    words = {"fruit": "apple pear plum cherry quince".split(), "tools": "hammer chisel plane anvil wrench".split()}
    filler = "the report shows every item beside another one and nothing else changes today".split()
    docs, truth = [], {}
    for i in range(240):
        own = r.choice([["fruit"], ["tools"], ["fruit", "tools"], []])
        text = " ".join(" ".join([*r.choices(filler, k=4), *r.choices(words[s], k=3)]) + "." for s in own for _ in range(3)) or " ".join(r.choices(filler, k=12))
        docs.append((i, text, "en"))
        truth[i] = set(own)
    docs += [(900, None, None), (901, "", "en"), (902, "   ", "xx")]
    labels = [(i, s) for i in range(60) for s in truth[i]] + [(0, None), (None, "fruit"), (5000, "tools")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string")
    sub = spark.createDataFrame([("fruit", "fruit of trees"), ("tools", None)], "subject string, description string")
    got = {}
    for x in subjects.find_subjects(d, lab, sub).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in range(240))
    assert right >= 0.95 * 240
    assert not got.keys() & {900, 901, 902}
    assert subjects.find_subjects(d.limit(0), lab, sub).count() == 0
    assert subjects.find_subjects(d, lab.limit(0), sub).count() >= 0
