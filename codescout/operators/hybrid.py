"""Fusion, re-ranking and selection of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the kinds of element and of the two searches.
TYPE_WEIGHTS = {"function": 1.2, "class": 1.1, "file": 0.9, "documentation": 0.8}
KEYWORD_WEIGHT, VECTOR_WEIGHT, KEYWORD_POOL = 0.4, 0.6, 50


def type_weight(kind: Column) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, weight in TYPE_WEIGHTS.items():
        out = out.when(kind == name, weight)
    return out.otherwise(F.lit(1.0))


def fuse(keyword: DataFrame, vector: DataFrame, keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """(id, score): keyword scores divided by their largest, and similarities, weighted and summed for each id."""
    top = keyword.agg(F.max("score").alias("top"))
    normal = keyword.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top") * keyword_weight).alias("part"))
    return normal.unionByName(vector.select("id", (F.col("score") * vector_weight).alias("part"))).groupBy("id").agg(F.sum("part").alias("score"))


def combine(semantic: DataFrame, keyword: DataFrame, semantic_weight: float = 0.6, keyword_weight: float = 0.3) -> DataFrame:
    """(id, semantic_score, keyword_score, total_score) with the components kept apart."""
    top = keyword.agg(F.max("score").alias("top"))
    kw = keyword.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top") * keyword_weight).alias("keyword_score"))
    sem = semantic.select("id", (F.col("score") * semantic_weight).alias("semantic_score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    both = sem.join(kw, "id", "full_outer").select("id", zero("semantic_score"), zero("keyword_score"))
    return both.withColumn("total_score", F.col("semantic_score") + F.col("keyword_score"))


def rerank(results: DataFrame, kind_col: str = "kind", score_col: str = "score") -> DataFrame:
    return results.withColumn(score_col, F.col(score_col) * type_weight(F.col(kind_col)))


def diversify(results: DataFrame, group_col: str, score_col: str = "score", tie: str = "id", penalty: float = 0.1) -> DataFrame:
    """All but the best result of each group lose `penalty` of their score, once."""
    order = Window.partitionBy(group_col).orderBy(F.desc(score_col), tie)
    return results.withColumn("__rank", F.row_number().over(order)).withColumn(score_col, F.when(F.col("__rank") > 1, F.col(score_col) * (1 - penalty)).otherwise(F.col(score_col))).drop("__rank")


def priority(relevance: Column, source: Column, kind: Column, lines: Column, granular: Column) -> Column:
    """Relevance, where the element was found, its type, a size that is easy to read, and granularity."""
    found = F.when(source == "agent", 0.3).when(source == "retrieval", 0.2).otherwise(0.15)
    typed = F.when(kind == "function", 0.2).when(kind == "class", 0.15).otherwise(0.0)
    size = F.when(lines < 10, 0.8).when(lines <= 100, 1.0).when(lines <= 300, 0.7).otherwise(0.5)
    return relevance * 0.4 + found + typed + size * 0.2 + F.when(granular, 0.15).otherwise(0.0)


def budget_prune(candidates: DataFrame, budget: int, group_col: str = "query_id", least: int = 5) -> DataFrame:
    """Greedy choice within a budget of lines for each group of (group, id, priority, lines).

    In order of priority an element is taken while it fits; the first is always taken; one that does not fit
    is skipped while fewer than `least` are taken, else the choice ends. Ids are unique in a group; lines below
    0 count as 0, and null lines fit nowhere.

    Exact over groups of any size. What does not fit once never fits later, so of each group's elements with
    the same lines the first `least` decide the first picks: `least` times budget + 1 rows are folded in one
    array, whatever the size of the group. The picks after those are the elements that follow without a gap.
    One of them that fails comes within budget + 1 elements of a line or more, so the rest of the group is not sorted.
    """
    least = max(least, 1)
    size = F.when(F.col("lines").isNull(), F.lit(budget + 1)).otherwise(F.greatest(F.col("lines"), F.lit(0))).cast("long")
    p = F.col("priority").cast("double")
    element = F.struct(p.isNull().alias("none"), F.coalesce(~F.isnan(p), F.lit(True)).alias("number"), (-p).alias("order"), "id", F.col("lines").cast("long").alias("lines"), p.alias("priority"), size.alias("size"))
    c = candidates.select(F.col(group_col).alias("g"), element.alias("e"), size.alias("size"))
    first = lambda df, keys, k: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("e"))).where(F.col("n") <= k)

    pool = first(c.where(F.col("size") <= budget), ["g", "size"], least).unionByName(first(c, ["g"], 1).where(F.col("size") > budget))
    took = F.aggregate(
        F.expr("slice(s, 2, size(s))"),
        F.struct(F.slice("s", 1, 1).alias("picks"), F.col("s")[0]["size"].alias("used")),
        lambda a, x: F.when((F.size(a["picks"]) < least) & (a["used"] + x["size"] <= budget), F.struct(F.concat(a["picks"], F.array(x)).alias("picks"), (a["used"] + x["size"]).alias("used"))).otherwise(a),
    )
    picked = pool.groupBy("g").agg(F.sort_array(F.collect_list("e")).alias("s")).select(F.col("g").alias("h"), took.alias("t")).select("h", "t.picks", "t.used")

    both = c.join(picked, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    at = lambda i: F.get("picks", F.lit(i))
    ranked = both.groupBy("g").agg(F.first("picks").alias("picks"), F.array(*(F.count_if(F.col("e") <= at(i)).cast("int") for i in range(least))).alias("ranks"))
    head = ranked.select("g", F.posexplode("picks").alias("i", "e"), "ranks").select("g", "e", F.get("ranks", F.col("i")).alias("rank"))

    tail = both.where((F.size("picks") == least) & (F.col("used") <= budget) & (F.col("e") > at(least - 1))).select("g", "e", "size", "used")
    near = first(tail.where(F.col("size") > 0), ["g"], budget + 1)
    so_far = F.sum("size").over(Window.partitionBy("g").orderBy("e").rowsBetween(Window.unboundedPreceding, 0))
    ends = near.withColumn("used", F.col("used") + so_far).where(F.col("used") > budget).groupBy("g").agg(F.min("e").alias("end"))
    more = tail.join(ends.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").where(F.col("end").isNull() | (F.col("e") < F.col("end")))
    after = more.select("g", "e", F.row_number().over(Window.partitionBy("g").orderBy("e")).alias("k"))
    last = ranked.select(F.col("g").alias("h"), F.get("ranks", F.lit(least - 1)).alias("last"))
    after = after.join(last, F.col("g").eqNullSafe(F.col("h"))).select("g", "e", (F.col("last") + F.col("k")).alias("rank"))
    return head.unionByName(after).select(F.col("g").alias(group_col), "e.id", "e.priority", "e.lines", "rank")


def select_repositories(semantic: DataFrame, keyword: DataFrame, k: int = 5) -> DataFrame:
    """(id, semantic, keyword, total): blended scores of (id, score) tables; what is good enough in any of the three, best first."""
    top = keyword.agg(F.max("score").alias("top"))
    kw = keyword.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("keyword"))
    both = semantic.where("score >= 0.3").select("id", F.col("score").alias("semantic")).join(kw, "id", "full_outer")
    both = both.select("id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    both = both.withColumn("total", F.col("semantic") * 0.7 + F.col("keyword") * 0.3)
    return both.where("total > 0.15 or semantic > 0.4 or keyword > 0.95").orderBy(F.desc("total"), "id").limit(k)


def merge_selected(results: DataFrame, selected: DataFrame, base: float = 0.8, boost: float = 1.3) -> DataFrame:
    """(id, score): results with the selected ids among them; a selected id scores at least base, times boost.

    results: (id, score), selected: (id). Both may repeat ids; the best score of an id counts, a null score as none.
    """
    have = results.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(0).alias("chosen"))
    want = selected.select("id", F.lit(base).alias("score"), F.lit(1).alias("chosen"))
    merged = have.unionByName(want).where("id is not null").groupBy("id").agg(F.max("score").alias("score"), F.max("chosen").alias("chosen"))
    return merged.select("id", (F.col("score") * F.when(F.col("chosen") == 1, boost).otherwise(1.0)).alias("score"))


#: Weights of the parts of a retrieval, how many of each are taken, and what is given in the end.
RETRIEVAL_WEIGHTS = {"semantic": 0.6, "pseudocode": 0.4, "keyword": 0.3}
RETRIEVAL_POOLS = {"semantic": 20, "pseudocode": 10, "keyword": 10}
MAX_RESULTS, MAX_ELEMENTS = 5, 100


def best(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k rows of the highest score; ties by id."""
    return scored.orderBy(F.desc(F.round(score, 9)), "id").limit(k)


def combine_parts(semantic: DataFrame, keyword: DataFrame, pseudocode: DataFrame | None = None) -> DataFrame:
    """(id, semantic_score, keyword_score, pseudocode_score, total_score) of (id, score) tables; keyword scores are divided by their largest.

    Null ids are left out; an id that a table repeats counts with its best score.
    """
    top = keyword.agg(F.max("score").alias("top"))
    parts = {"semantic": semantic.select("id", "score"), "keyword": keyword.crossJoin(F.broadcast(top)).where("top > 0").select("id", (F.col("score") / F.col("top")).alias("score"))}
    if pseudocode is not None:
        parts["pseudocode"] = pseudocode.select("id", "score")
    each = None
    for name, weight in RETRIEVAL_WEIGHTS.items():
        if name in parts:
            one = parts[name].where("id is not null").select("id", F.lit(name).alias("part"), (F.col("score") * weight).alias("score"))
            each = one if each is None else each.unionByName(one)
    of = lambda name: F.coalesce(F.max(F.when(F.col("part") == name, F.col("score"))), F.lit(0.0)).alias(f"{name}_score")
    out = each.groupBy("id").agg(*(of(name) for name in ("semantic", "keyword", "pseudocode")))
    return out.withColumn("total_score", F.col("semantic_score") + F.col("keyword_score") + F.col("pseudocode_score"))


def retrieve(elements: DataFrame, semantic: DataFrame, keyword: DataFrame, pseudocode: DataFrame | None = None, language: str | None = None, kind: str | None = None, path_part: str | None = None, k: int = MAX_RESULTS, group_col: str = "relative_path") -> DataFrame:
    """(id, type, total_score): one retrieval from (id, score) tables and elements (id, type, language, the group column).

    The best of each table are combined, weighted by type, filtered, spread over the groups, and the best k given.
    Filters that are None do not apply; a null group is one group.
    """
    pools = {name: best(table, RETRIEVAL_POOLS[name]) for name, table in (("semantic", semantic), ("keyword", keyword), ("pseudocode", pseudocode)) if table is not None}
    combined = combine_parts(pools["semantic"], pools["keyword"], pools.get("pseudocode"))  # at most forty rows
    typed = rerank(elements.select("id", "type", "language", group_col).join(F.broadcast(combined), "id"), "type", "total_score")
    if language is not None:
        typed = typed.where(F.col("language") == language)
    if kind is not None:
        typed = typed.where(F.col("type") == kind)
    if path_part is not None:
        typed = typed.where(F.col(group_col).contains(path_part))
    spread = diversify(typed.withColumn("total_score", F.round("total_score", 9)), group_col, "total_score")
    return best(spread, k, "total_score").select("id", "type", "total_score")


def limit_by_relevance(results: DataFrame, most: int = MAX_ELEMENTS, score: str = "total_score") -> DataFrame:
    """The `most` rows of the highest score, those without one last; ties by id."""
    return results.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), "id").limit(most)


def next_round(existing: DataFrame, found: DataFrame, edges: DataFrame, elements: DataFrame, hops: int = 2, most: int = MAX_ELEMENTS) -> DataFrame:
    """(id, total_score) that a further round adds to existing (id) from what its tools found (id, total_score).

    What is known is dropped; the rest is widened along the edges, freed of what lies within other elements, once more
    freed of what is known, and cut to the `most` relevant. Neighbours that are no element are dropped.
    """
    from codescout.operators.dedup import drop_contained
    from codescout.operators.graph import expand_scores

    known = existing.select("id").distinct()
    new = found.where("id is not null").groupBy("id").agg(F.max("total_score").alias("total_score")).join(known, "id", "left_anti")
    ranked = new.withColumn("rank", F.struct(-F.coalesce("total_score", F.lit(0.0)), F.col("id")))
    near = expand_scores(edges, ranked.withColumnRenamed("total_score", "score"), hops).select("id", F.col("score").alias("total_score"))
    wide = new.unionByName(near).join(elements.select("id", "repo_name", "relative_path", "type", "start_line", "end_line"), "id")
    return limit_by_relevance(drop_contained(wide).join(known, "id", "left_anti").select("id", "total_score"), most)


def round_gains(rounds: DataFrame, key: str = "question_id", least_gain: float = 5.0, max_rounds: int = 6) -> DataFrame:
    """(key, rounds, initial_confidence, final_confidence, gain, total_lines, budget_used, roi, rating, stopped) of (key, round, confidence, lines, budget, threshold).

    lines are those gathered up to the round; roi is the gain for each thousand of them. Rounds of a question are few.
    """
    order = Window.partitionBy(key).orderBy("round")
    each = rounds.withColumn("gained", F.col("confidence") - F.lag("confidence").over(order)).withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("round"))))
    low = F.coalesce(F.every(F.when(F.col("from_end") <= 2, F.coalesce(F.col("gained") < least_gain, F.lit(False))).otherwise(True)), F.lit(False))
    out = each.groupBy(key).agg(F.count(F.lit(1)).alias("rounds"), F.min_by("confidence", "round").alias("initial_confidence"), F.max_by("confidence", "round").alias("final_confidence"), F.max_by("lines", "round").alias("total_lines"), F.max_by("budget", "round").alias("budget"), F.max_by("threshold", "round").alias("threshold"), low.alias("low"))
    out = out.withColumn("gain", F.col("final_confidence") - F.col("initial_confidence")).withColumn("budget_used", F.col("total_lines") / F.col("budget") * 100)
    out = out.withColumn("roi", F.when(F.col("total_lines") > 0, F.col("gain") / F.col("total_lines") * 1000).otherwise(0.0))
    roi, used = F.col("roi"), F.col("budget_used")
    rating = F.when((roi >= 5) & (used < 70), "excellent").when((roi >= 3) & (used < 85), "good").when((roi >= 1.5) | (used < 90), "acceptable").otherwise("inefficient")
    stopped = F.when(F.col("final_confidence") >= F.col("threshold"), "confidence_threshold_reached").when(F.col("rounds") >= max_rounds, "max_iterations_reached").when(F.col("total_lines") >= F.col("budget"), "line_budget_exceeded").when((F.col("rounds") >= 3) & F.col("low"), "diminishing_returns").otherwise("other")
    return out.select(key, "rounds", "initial_confidence", "final_confidence", "gain", "total_lines", "budget_used", "roi", rating.alias("rating"), stopped.alias("stopped"))
