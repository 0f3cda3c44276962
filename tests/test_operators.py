import math
import random

import pytest
from pyspark.sql import functions as F

from codescout.operators import dedup, graph, hybrid, parse, resolve, rollups, search, textindex, vectors
from codescout.sources import repository


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


DOCS = [("d1", "the quick brown fox jumps"), ("d2", "a lazy dog sleeps all day long"), ("d3", "quick quick fox"), ("d4", None), ("d5", "")]


def brute_bm25(docs, query):
    toks = {k: [w for w in __import__("re").split("[^a-z0-9]+", (t or "").lower()) if len(w) > 1] for k, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for k, words in toks.items():
        s = 0.0
        for w in textindex.query_terms(query):
            if w in words:
                tf = words.count(w)
                s += (0.25 * mean if raw[w] < 0 else raw[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s > 0:
            out[k] = s
    return out


def test_bm25_is_the_formula(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    for query in ("quick fox", "quick quick dog", "nothing here"):
        got = {r["id"]: r["score"] for r in textindex.bm25(docs, query, "id").collect()}
        want = brute_bm25(DOCS, query)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert textindex.bm25(docs, "", "id").count() == 0
    assert textindex.bm25(docs.limit(0), "quick", "id").count() == 0


def test_one_document_has_no_hit(spark):
    assert textindex.bm25(spark.createDataFrame([("a", "the quick brown fox")], "id string, text string"), "quick brown", "id").count() == 0


def test_cosine_and_knn(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0, 0.0],)], "vec array<float>")
    got = textindex.top_k(vectors.cosine_search(v, q), 2).collect()
    assert [(r["id"], r["score"]) for r in got] == [(0, 1.0), (2, 0.993884)]
    near = vectors.knn_batch(v, v.where("vec_id in (0, 3, 5)"), 2)
    assert rows(near.select("query_id", "id", "rank"), "query_id", "rank") == [(0, 0, 1), (0, 2, 2)]


def test_knn_in_blocks_is_exact(spark, monkeypatch):
    r = random.Random(3)
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    whole = rows(vectors.knn_batch(v, v.where("vec_id % 10 = 0"), 5), "query_id", "rank")
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    assert rows(vectors.knn_batch(v, v.where("vec_id % 10 = 0"), 5), "query_id", "rank") == whole


def test_fusion_and_rerank(spark):
    kw = spark.createDataFrame([("e1", 1.606929)], "id string, score double")
    none = spark.createDataFrame([], "id string, score double")
    typed = hybrid.rerank(hybrid.fuse(kw, none).withColumn("kind", F.lit("function")))
    assert typed.first()["score"] == pytest.approx(0.48)
    vec = spark.createDataFrame([("e1", 1.0)], "id string, score double")
    assert hybrid.rerank(hybrid.fuse(none, vec).withColumn("kind", F.lit("function"))).first()["score"] == pytest.approx(0.72)


def test_diversify(spark):
    r = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 0.9), ("c", "g", 0.85)], "id string, file string, score double")
    assert {x["id"]: round(x["score"], 3) for x in hybrid.diversify(r, "file").collect()} == {"a": 1.0, "b": 0.81, "c": 0.85}


def test_budget_prune(spark):
    c = spark.createDataFrame([(1, "a", 0.9, 100), (1, "b", 0.8, 50), (1, "c", 0.7, 10), (2, "d", 0.1, 999)], "query_id long, id string, priority double, lines long")
    assert {r["id"] for r in hybrid.budget_prune(c, 110).collect()} == {"a", "c", "d"}
    assert hybrid.budget_prune(c.limit(0), 110).count() == 0


def greedy(candidates, budget, least=5):
    out = set()
    for g in {c[0] for c in candidates}:
        used, taken = 0, 0
        for rank, c in enumerate(sorted((c for c in candidates if c[0] == g), key=lambda c: (-c[2], c[1])), 1):
            if not taken or used + c[3] <= budget:
                taken, used = taken + 1, used + c[3]
                out.add((*c, rank))
            elif taken >= least:
                break
    return out


def test_budget_prune_equals_greedy_on_large_groups(spark):
    r = random.Random(11)
    data = [(0, "a", 1.0, 380)] + [(0, f"big{i:05}", 0.9, r.randint(30, 500)) for i in range(3000)] + [(0, f"small{i}", 0.1, 3) for i in range(30)]
    for g in range(1, 25):  # sizes that fit seldom, at once, after gaps, never, and of no line
        least, most = r.choice([(0, 3), (1, 40), (60, 400), (401, 900), (0, 900)])
        data += [(g, f"e{i:05}", round(r.random(), 2), r.randint(least, most)) for i in range(r.choice([3, 40, 1500]))]
    c = spark.createDataFrame(data, "query_id long, id string, priority double, lines long")
    for budget, least in ((400, 5), (400, 1), (60, 3)):
        assert {tuple(x) for x in hybrid.budget_prune(c, budget, least=least).collect()} == greedy(data, budget, least)


CHAIN = [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "d"), ("g", "a", "b"), ("g", "a", "a"), ("g", None, "a")]


def test_graph_walks(spark):
    e = graph.clean_edges(spark.createDataFrame(CHAIN, "graph string, src string, dst string"))
    assert e.count() == 3
    seed = spark.createDataFrame([("a",)], "node string")
    assert graph.khop(e, seed, 1).count() == 1
    assert graph.khop(e, seed, 2).count() == 2
    assert graph.khop(e, seed, 0).count() == 0
    assert rows(graph.khop(e, spark.createDataFrame([("d",)], "node string"), 1).select("node")) == [("c",)]
    assert graph.khop(e, spark.createDataFrame([("d",)], "node string"), 3, "out").count() == 0
    assert rows(graph.shortest_paths(e, seed, 5).where("node = 'd'").select("length", F.array_join("path", ""))) == [(3, "abcd")]
    assert rows(graph.graph_stats(e)) == [("g", 4, 3, 1.5)]
    assert rows(graph.acyclic(e)) == [("g", True)]
    loop = e.unionByName(spark.createDataFrame([("g", "d", "a")], e.schema))
    assert rows(graph.acyclic(loop)) == [("g", False)]
    assert graph.directional_reach(e, seed, 2).count() == 2


def test_containment_equals_greedy(spark):
    r = random.Random(5)
    data = []
    for i in range(400):
        start = r.randint(1, 20)
        data.append((f"e{i}", "repo", f"f{r.randint(0, 40)}", r.choice(["file", "class", "function", "documentation"]), start, start + r.randint(0, 12)))
    rank = {"file": 3, "class": 2, "function": 1}
    kept = set()
    for key in {(d[1], d[2]) for d in data}:
        own = sorted((d for d in data if (d[1], d[2]) == key), key=lambda d: (-rank.get(d[3], 0), -(d[5] - d[4]), d[4]))
        took = []
        for d in own:
            if not any(k[4] <= d[4] and d[5] <= k[5] and (k[4], k[5]) != (d[4], d[5]) for k in took):
                took.append(d)
        kept |= {d[0] for d in took}
    df = spark.createDataFrame(data, "id string, repo_name string, relative_path string, type string, start_line int, end_line int")
    assert {x["id"] for x in dedup.drop_contained(df).collect()} == kept


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", None), (2, None, None)], "id long, v string, t int")
    assert rows(dedup.latest(df, ["id"], "t"), "id") == [(1, "a", 2), (2, None, None)]


def test_grep_and_lists(spark):
    f = spark.createDataFrame([("r", "src/a.py", "Foo foo\nbar"), ("r", "vendor/b.py", "foo"), ("r", ".x/c.py", "foo"), ("r", "d.go", None)], "repo_name string, relative_path string, content string")
    assert rows(search.grep(f, "foo")) == [("r", "src/a.py", 2), ("r", "vendor/b.py", 1)]
    assert rows(search.grep(f, "fo.", literal=True)) == []
    assert rows(search.grep_lines(f, "bar").select("line_no")) == [(2,)]
    assert rows(search.list_directory(f, ""), "name") == [("r", "d.go", "file", 1), ("r", "src", "directory", 1), ("r", "vendor", "directory", 1)]
    assert rows(rollups.ancestors(f), "dir")[1] == ("r", "src", 1, 1)


def test_grep_lines_searches_whole_lines(spark):
    long = "x" * 500 + " needle"
    f = spark.createDataFrame([("r", "a.js", f"needle\n{long}\nno")], "repo_name string, relative_path string, content string")
    assert rows(search.grep_lines(f, "needle").select("line_no", "line"), "line_no") == [(1, "needle"), (2, "x" * 200)]
    assert rows(search.keyword_lines(f, "needle$").select("line_no"), "line_no") == [(1,), (2,)]


def test_resolution(spark):
    elements = spark.createDataFrame([("c1", "class", "Base", "a.py"), ("c2", "class", "Child", "a.py"), ("f1", "function", "run", "a.py"), ("f2", "function", "help", "b.py")], "id string, type string, name string, file_path string")
    parsed = spark.createDataFrame(
        [("a.py", [("Child", ["Base", "Unknown"])], [("run", None, ["help", "run", "print"])]), ("b.py", None, None)],
        "file_path string, classes array<struct<name string, bases array<string>>>, functions array<struct<name string, class_name string, calls array<string>>>",
    )
    assert rows(resolve.inheritance_edges(elements, parsed)) == [("c2", "c1")]
    assert rows(resolve.call_edges(elements, parsed)) == [("f1", "f2")]
    files = spark.createDataFrame([("r", "/r/pkg/a.py", "pkg/a.py"), ("r", "/r/pkg/b.py", "pkg/b.py")], "repo_name string, path string, relative_path string")
    imports = spark.createDataFrame([("/r/pkg/a.py", [("b", ["x"], True, 1, 1, None), (None, [], False, 2, 0, None)])], "file_path string, imports array<struct<module string, names array<string>, is_from boolean, line int, level int, alias string>>")
    assert rows(resolve.import_edges(files, imports)) == [("/r/pkg/a.py", "/r/pkg/b.py")]
    assert rows(resolve.loose_import_edges(files, imports)) == [("/r/pkg/a.py", "/r/pkg/b.py")]


def test_repository_end_to_end(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / ".gitignore").write_text("*.log\nskip.py\n")
    (root / "src/loader.py").write_text('"""Loads."""\n\nclass Base:\n    def go(self):\n        return 1\n\nclass Child(Base):\n    def go(self):\n        return helper()\n\ndef helper():\n    return 2\n')
    (root / "src/p.js").write_text("export function processData(a) {\n  return a;\n}\nclass Q {\n  run(x) {\n    return processData(x);\n  }\n}\n")
    (root / "node_modules/x.js").write_text("x")
    (root / "skip.py").write_text("x = 1")
    (root / "empty.py").write_text("")
    (root / "broken.py").write_text("def (:\n")
    files = repository.load_repository(spark, str(root))
    assert {r["relative_path"] for r in files.collect()} == {"src/loader.py", "src/p.js", "broken.py"}
    elements = parse.build_elements(parse.parse_files(files))
    kinds = {r["type"]: r["n"] for r in elements.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"file": 3, "class": 3, "function": 5, "documentation": 1}
    repository.save(elements, str(tmp_path / "store"), "elements")
    assert rows(repository.available(spark, str(tmp_path / "store"))) == [("proj", 12, 3)]


def test_stream_index(spark, tmp_path):
    from codescout.streaming import incremental

    source = tmp_path / "in"
    spark.createDataFrame([("r", "/r/a.py", "a.py", "python", "def f():\n    pass\n")], "repo_name string, path string, relative_path string, language string, content string").write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).parquet(str(source))
    incremental.index_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    assert repository.load(spark, str(tmp_path / "store"), "elements", ["r"]).count() == 2


def test_acyclic(spark):
    chain = [("long", f"n{i}", f"n{i + 1}") for i in range(60)]
    ring = [("ring", f"n{i}", f"n{(i + 1) % 17}") for i in range(17)] + [("ring", "x", "n0"), ("ring", "n3", "y")]
    pair = [("pair", "a", "b"), ("pair", "b", "a")]
    mesh = [("mesh", f"l{i}{a}", f"l{i + 1}{b}") for i in range(6) for a in "pq" for b in "pq"]
    df = spark.createDataFrame(chain + ring + pair + mesh, "graph string, src string, dst string")
    assert {r["graph"]: r["is_dag"] for r in graph.acyclic(df).collect()} == {"long": True, "ring": False, "pair": False, "mesh": True}
    assert graph.acyclic(df.limit(0)).count() == 0


def test_knn_batch_equals_brute_force(spark):
    import random

    import numpy as np

    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]) for i in range(160)] + [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for x in vectors.knn_batch(df, df.where("vec_id % 20 = 0 or vec_id >= 900"), 7).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["id"], x["score"]))
    known = {i: np.array(v, float) for i, v in rows if v and any(v)}
    for q in [i for i in known if i % 20 == 0 or i >= 900]:
        score = {i: round(float(v @ known[q] / np.linalg.norm(v) / np.linalg.norm(known[q])), 6) for i, v in known.items() if len(v) == len(known[q])}
        want = [(n + 1, i, s) for n, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]) if s > 0]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want]
    assert not got.keys() & {900, 901, 902}


def test_gains_over_spread_keys(spark):
    rows = [("hot", t, (t * 37) % 101) for t in range(300)] + [("cold", t, t * t) for t in range(3)] + [("one", 1, 5), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, t int, n int").repartition(7)
    got = {(r["k"], r["t"]): r["gain"] for r in rollups.gains(df, "k", ["t"], "n").collect()}
    values = {(k, t): n for k, t, n in rows}
    assert got == {(k, t): n - values[k, t - 1] if (k, t - 1) in values else None for (k, t), n in values.items() if k}


def test_paths_that_end_in_each_other(spark):
    paths = ["a/b/lib.py", "b.py", "lib.py", "x/lib.py.bak", "", "A/lib.py"]
    wanted = ["b.py", "lib.py", "b/lib.py", "deep/a/b/lib.py"]
    got = search.matching_paths(spark.createDataFrame([(p,) for p in [*paths, None]], "relative_path string"), spark.createDataFrame([(w,) for w in [*wanted, None]], "path string")).collect()
    assert {tuple(r) for r in got} == {(p, w) for p in paths for w in wanted if p.endswith(w) or w.endswith(p)}


def test_stored_index_equals_the_direct_ranking(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["The quick brown fox", "a lazy dog", "quick quick fox jumps", "dogs and a fox", None, "", "nothing of it", "brown bread"])], "doc_id long, text string")
    index = textindex.build_index(docs, str(tmp_path / "index"), buckets=4)
    for question in ("quick fox", "quick quick bread", "", "zebra"):
        want = {r["id"]: round(r["score"], 9) for r in textindex.bm25(docs, question).collect()}
        assert {r["id"]: round(r["score"], 9) for r in index.search(question).collect()} == want
    empty = textindex.build_index(docs.limit(0), str(tmp_path / "none"))
    assert empty.search("fox").count() == 0


def test_rounds(spark):
    elements = spark.createDataFrame([(i, "r", "f.py", "function", 10 * n, 10 * n + 5) for n, i in enumerate("abcde")] + [("big", "r", "f.py", "class", 0, 25)], "id string, repo_name string, relative_path string, type string, start_line int, end_line int")
    edges = spark.createDataFrame([("call", "d", "e"), ("call", "e", "a")], "graph string, src string, dst string")
    out = hybrid.next_round(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", 0.9), ("b", 0.5), ("d", 0.8), (None, 1.0), ("d", 0.1)], "id string, total_score double"), edges, elements)
    assert [(r["id"], round(r["total_score"], 6)) for r in out.collect()] == [("d", 0.8), ("b", 0.5), ("e", 0.04)]
    rounds = [("x", 1, 60.0, 100, 1000, 95.0), ("x", 2, 96.0, 400, 1000, 95.0), ("y", 1, 50.0, 10, 100, 95.0), ("y", 2, 51.0, 50, 100, 95.0), ("y", 3, 52.0, 90, 100, 95.0), ("z", 1, 50.0, 0, 100, 95.0)]
    got = {r["question_id"]: (r["rounds"], r["gain"], r["rating"], r["stopped"]) for r in hybrid.round_gains(spark.createDataFrame(rounds, "question_id string, round int, confidence double, lines int, budget int, threshold double")).collect()}
    assert got == {"x": (2, 36.0, "excellent", "confidence_threshold_reached"), "y": (3, 2.0, "good" if 2 / 90 * 1000 >= 3 and 90 < 85 else "acceptable", "diminishing_returns"), "z": (1, 0.0, "acceptable", "other")}


def test_documentation_and_branches_of_other_languages(spark):
    js = "/**\n * Drops rows.\n * @param a rows\n */\nfunction clean(a) {\n  if (a && b) { go(a); }\n  return f(a);\n}\n\nfunction bare() {\n}\n"
    row = parse.parse_files(spark.createDataFrame([("r", "/r/a.js", "a.js", "javascript", js)], "repo_name string, path string, relative_path string, language string, content string")).first()
    first, second = row["functions"]
    assert first["docstring"] == "Drops rows.\n@param a rows" and first["complexity"] == 3 and first["calls"] == ["f"]
    assert second["docstring"] is None and second["complexity"] == 1
