"""Graphs as edge tables (graph, src, dst): building, walks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescout.session import cut


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without self-loops and null ends."""
    ends = edges.where("src is not null and dst is not null and src <> dst")
    return ends.select("graph", "src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(graph, node, out_degree, in_degree) of clean edges."""
    both = edges.select("graph", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("graph", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("graph", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """(graph, nodes, edges, avg_degree) of clean edges."""
    n = degrees(edges).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"))
    return n.withColumn("avg_degree", F.round(2.0 * F.col("edges") / F.col("nodes"), 6))


def acyclic(edges: DataFrame) -> DataFrame:
    """(graph, is_dag) of clean edges. An empty table gives no row.

    Edges that begin at a node without incoming edges, or end at one without outgoing edges, lie on no cycle and
    are peeled off, round by round, until none is left or none is peeled: what is left then holds a cycle. Between
    rounds, nodes with one edge in and one out are skipped over (some at a time, so that no two neighbours are), which
    leaves cycles as they are and halves long chains instead of walking along them.
    """
    key = ["graph", "node"]
    graphs = edges.select("graph").distinct()
    left = cut(edges.select("graph", "src", "dst").distinct())
    loops = None
    count, turn = left.count(), 0
    while count:
        turn += 1
        starts, ends = left.select("graph", F.col("src").alias("node")), left.select("graph", F.col("dst").alias("node"))
        kept = left.join(ends.distinct().withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").join(starts.distinct().withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi")
        kept = cut(kept.select("graph", "src", "dst"))
        now = kept.count()
        if now == count:
            break
        through = kept.groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next")).where("o = 1").join(kept.groupBy("graph", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("last")).where("i = 1"), key)
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0  # noqa: E731, B023
        skipped = cut(through.where(coin("node") & ~coin("last") & ~coin("next")).select("graph", "node", "last", "next"))
        gone = skipped.select("graph", "node")
        rest = kept.join(gone.withColumnRenamed("node", "src"), ["graph", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_anti")
        joined = cut(rest.select("graph", "src", "dst").unionByName(skipped.select("graph", F.col("last").alias("src"), F.col("next").alias("dst"))).distinct())
        found = joined.where("src = dst").select("graph").distinct()
        loops = cut(found if loops is None else loops.unionByName(found).distinct())
        left = cut(joined.join(loops, "graph", "left_anti"))
        count = left.count()
    rest = left.select("graph").distinct() if loops is None else left.select("graph").unionByName(loops).distinct()
    return graphs.join(rest.withColumn("cyclic", F.lit(True)), "graph", "left").select("graph", F.coalesce(~F.col("cyclic"), F.lit(True)).alias("is_dag"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int, directed: str | None = None) -> DataFrame:
    """(seed, node, hop): nodes within `hops` of each seed (one column, node), with the least number of hops; without the seed.

    directed None walks both ways, "out" along and "in" against the edges. Duplicates and self-loops do no
    harm; an edge of a hub is joined as such, so adaptive execution can split its partition.
    """
    forth = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    step = (forth if directed == "out" else back if directed == "in" else forth.unionByName(back)).where("a is not null and b is not null").distinct()
    front = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0))
    seen = front
    for hop in range(1, hops + 1):
        reached = front.select("seed", F.col("node").alias("a")).join(step, "a").select("seed", F.col("b").alias("node")).distinct()
        front = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            front = cut(front)
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def directional_reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, graph, direction, node, hop): reach in each graph and each direction on its own."""
    forth = edges.select("graph", F.lit("out").alias("direction"), F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select("graph", F.lit("in").alias("direction"), F.col("dst").alias("a"), F.col("src").alias("b"))
    step = forth.unionByName(back).distinct()
    asked = seeds.select("node").distinct()
    front = step.select("graph", "direction", F.col("a").alias("node")).distinct().join(asked, "node").select(F.col("node").alias("seed"), "node", "graph", "direction").withColumn("hop", F.lit(0))
    key = ["seed", "graph", "direction", "node"]
    seen = front.select(*key, "hop")
    for hop in range(1, hops + 1):
        moved = front.select("seed", "graph", "direction", F.col("node").alias("a")).join(step, ["graph", "direction", "a"])
        reached = moved.select("seed", "graph", "direction", F.col("b").alias("node")).distinct()
        front = reached.join(seen.select(*key), key, "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            front = cut(front)
        seen = seen.unionByName(front.select(*key, "hop"))
    return seen.where("hop > 0")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 5) -> DataFrame:
    """(source, node, length, path): for each node within max_depth of a source (node) along the edges, one shortest path, the least by name."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null").distinct()
    front = sources.select(F.col("node").alias("source"), "node").distinct().withColumn("length", F.lit(0)).withColumn("path", F.array("node"))
    seen = front
    for depth in range(1, max_depth + 1):
        grown = front.select("source", F.col("node").alias("a"), "path").join(step, "a").select("source", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        first = grown.groupBy("source", "node").agg(F.min("path").alias("path"))
        front = cut(first.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("length"), "path"))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen.where("length > 0")


def expand_scores(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5, weight: float = 0.1) -> DataFrame:
    """(id, score, related_to): neighbours of ranked seeds (id, score, rank); a neighbour belongs to the best seed that reaches it."""
    near = khop(edges, seeds.select(F.col("id").alias("node")), hops)
    scored = near.join(seeds.select(F.col("id").alias("seed"), F.col("score").alias("parent"), "rank"), "seed")
    new = scored.join(seeds.select(F.col("id").alias("node")), "node", "left_anti")
    best = new.groupBy("node").agg(F.min_by(F.struct("seed", "parent"), "rank").alias("x"))
    return best.select(F.col("node").alias("id"), (F.col("x.parent") * decay * weight).alias("score"), F.col("x.seed").alias("related_to"))


def merge_graphs(*parts: DataFrame) -> DataFrame:
    """(graph, src, dst): the union of edge tables, each edge once, without self-loops; null ends are dropped."""
    merged = parts[0].select("graph", "src", "dst")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("graph", "src", "dst"))
    return clean_edges(merged.where("src is not null and dst is not null")).select("graph", "src", "dst")
