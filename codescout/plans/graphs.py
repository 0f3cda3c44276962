"""Registered queries over the edge tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescout.operators import graph as gr
from codescout.sources.tables import read_table

_EDGES = "g AS (SELECT DISTINCT graph, src, dst FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"
#: The query set of the walks over several steps: the sources whose id ends so, against all edges.
_SEED_TEXT = "right(src, 1) = '0'"
_SEEDS = f"s AS (SELECT DISTINCT src AS seed FROM g WHERE {_SEED_TEXT})"


def _edges(s, d):
    return gr.clean_edges(read_table(s, d, "graph_edges"))


def _seeds(s, d):
    return _edges(s, d).where(_SEED_TEXT).select(F.col("src").alias("node")).distinct()


def edges_dedup(s, d):
    return _edges(s, d)


def degree(s, d):
    return gr.degrees(_edges(s, d))


def graph_stats(s, d):
    return gr.graph_stats(_edges(s, d))


def graph_acyclic(s, d):
    return gr.acyclic(_edges(s, d))


def dangling_edges(s, d):
    """Edges whose end is no element."""
    ids = read_table(s, d, "code_elements").select(F.col("id").alias("dst")).distinct()
    return _edges(s, d).join(ids, "dst", "left_anti").select("graph", "src", "dst")


def successors(s, d):
    """The nodes one step along the edges from each node, with their number."""
    e = _edges(s, d).select("graph", F.col("src").alias("node"), F.col("dst").alias("successor"))
    return e.join(e.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("n")), ["graph", "node"])


def predecessors(s, d):
    """The nodes one step against the edges from each node, with their number."""
    e = _edges(s, d).select("graph", F.col("dst").alias("node"), F.col("src").alias("predecessor"))
    return e.join(e.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("n")), ["graph", "node"])


def khop_undirected(s, d):
    return gr.khop(_edges(s, d), _seeds(s, d), 2)


def khop_directional(s, d):
    return gr.directional_reach(_edges(s, d), _seeds(s, d), 2)


def shortest_path_length(s, d):
    return gr.shortest_paths(_edges(s, d), _seeds(s, d), 4).select("source", "node", "length")


def graph_expand(s, d):
    """Scores of the neighbours of the ten elements with the most edges."""
    ranked = gr.degrees(_edges(s, d)).groupBy("node").agg(F.sum(F.col("out_degree") + F.col("in_degree")).alias("n")).orderBy(F.desc("n"), "node").limit(10)
    seeds = ranked.select(F.col("node").alias("id"), F.col("n").cast("double").alias("score"))
    from pyspark.sql import Window

    seeds = seeds.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # ten rows
    return gr.expand_scores(_edges(s, d), seeds).select("id", F.round("score", 6).alias("score"), "related_to")


_BOTH = "u AS (SELECT DISTINCT src AS a, dst AS b FROM g UNION SELECT DISTINCT dst, src FROM g)"
_HOPS = """one AS (SELECT DISTINCT seed, b AS node FROM s JOIN u ON u.a = s.seed WHERE b <> seed),
    two AS (SELECT DISTINCT seed, u.b AS node FROM one JOIN u ON u.a = one.node WHERE u.b <> seed)"""

QUERIES = {
    "edges_dedup": (edges_dedup, f"WITH {_EDGES} SELECT * FROM g"),
    "degree": (degree, f"WITH {_EDGES} SELECT graph, node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT graph, src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT graph, dst, 0, 1 FROM g) GROUP BY 1, 2"),
    "graph_stats": (graph_stats, f"WITH {_EDGES}, n AS (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g) SELECT graph, count(*) AS nodes, any_value(m) AS edges, round(2.0 * any_value(m) / count(*), 6) AS avg_degree FROM n JOIN (SELECT graph, count(*) AS m FROM g GROUP BY graph) USING (graph) GROUP BY graph"),
    "graph_acyclic": (graph_acyclic, f"WITH RECURSIVE {_EDGES}, r(graph, start, node) AS (SELECT graph, src, dst FROM g UNION SELECT r.graph, r.start, g.dst FROM r JOIN g ON g.graph = r.graph AND g.src = r.node), c AS (SELECT DISTINCT graph FROM r WHERE start = node) SELECT DISTINCT graph, graph NOT IN (SELECT graph FROM c) AS is_dag FROM g"),
    "dangling_edges": (dangling_edges, f"WITH {_EDGES} SELECT * FROM g WHERE dst NOT IN (SELECT id FROM code_elements WHERE id IS NOT NULL)"),
    "successors": (successors, f"WITH {_EDGES} SELECT graph, src AS node, dst AS successor, count(*) OVER (PARTITION BY graph, src) AS n FROM g"),
    "predecessors": (predecessors, f"WITH {_EDGES} SELECT graph, dst AS node, src AS predecessor, count(*) OVER (PARTITION BY graph, dst) AS n FROM g"),
    "khop_undirected": (khop_undirected, f"WITH {_EDGES}, {_SEEDS}, {_BOTH}, {_HOPS} SELECT seed, node, 1 AS hop FROM one UNION ALL SELECT seed, node, 2 FROM (SELECT * FROM two EXCEPT SELECT * FROM one)"),
    "khop_directional": (khop_directional, f"WITH {_EDGES}, {_SEEDS}, t AS (SELECT graph, 'out' AS direction, src AS a, dst AS b FROM g UNION ALL SELECT graph, 'in', dst, src FROM g), one AS (SELECT DISTINCT seed, graph, direction, b AS node FROM s JOIN t ON t.a = s.seed WHERE b <> seed), two AS (SELECT DISTINCT seed, one.graph, one.direction, t.b AS node FROM one JOIN t ON t.a = one.node AND t.graph = one.graph AND t.direction = one.direction WHERE t.b <> seed) SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM (SELECT * FROM two EXCEPT SELECT * FROM one)"),
    "shortest_path_length": (shortest_path_length, f"WITH RECURSIVE {_EDGES}, {_SEEDS}, t AS (SELECT DISTINCT src, dst FROM g), w(source, node, length) AS (SELECT seed, seed, 0 FROM s UNION SELECT w.source, t.dst, w.length + 1 FROM w JOIN t ON t.src = w.node WHERE w.length < 4) SELECT source, node, min(length) AS length FROM w WHERE node <> source GROUP BY 1, 2"),
    "graph_expand": (graph_expand, f"WITH {_EDGES}, d AS (SELECT node AS seed, n::DOUBLE AS score, row_number() OVER (ORDER BY n DESC, node) AS rank FROM (SELECT node, sum(c) AS n FROM (SELECT src AS node, 1 AS c FROM g UNION ALL SELECT dst, 1 FROM g) GROUP BY node) ORDER BY n DESC, node LIMIT 10), s AS (SELECT seed FROM d), {_BOTH}, {_HOPS}, h AS (SELECT * FROM one UNION SELECT * FROM two), r AS (SELECT node, seed, score, row_number() OVER (PARTITION BY node ORDER BY rank) AS k FROM h JOIN d USING (seed) WHERE node NOT IN (SELECT seed FROM d)) SELECT node AS id, round(score * 0.05, 6) AS score, seed AS related_to FROM r WHERE k = 1"),
}
