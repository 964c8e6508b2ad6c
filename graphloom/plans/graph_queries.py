"""Queries of the graph operators over the projected tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.storage import stored
from graphloom.operators import graph as g
from graphloom.plans.projection import edges, nodes, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **ctes: str):
    """Registers a query under its function's name, with oracle SQL over nodes and edges."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, **ctes)
        return f

    return register


def whole(spark, d) -> g.PropertyGraph:
    return g.PropertyGraph(nodes(spark, d), edges(spark, d))


def halves(spark, d) -> tuple[g.PropertyGraph, g.PropertyGraph]:
    """Two versions of the graph: without variables of one name, and without one kind of edge, heavier by a fifth on writes."""
    n, e = stored(nodes(spark, d), "nodes"), stored(edges(spark, d), "edges")  # read several times
    a = g.PropertyGraph(n.filter("NOT name LIKE 'item%'"), e.filter("kind <> 'mutates'"))
    b = g.PropertyGraph(n.filter("kind <> 'event'").withColumn("name", F.expr("CASE WHEN kind = 'method' THEN upper(name) ELSE name END")), e.filter("kind <> 'reads'").withColumn("weight", F.expr("CASE WHEN kind = 'writes' THEN weight * 1.2 ELSE weight END")))
    return a, b


HALVES = {
    "na": "SELECT * FROM nodes WHERE NOT name LIKE 'item%'",
    "ea": "SELECT * FROM edges WHERE kind <> 'mutates'",
    "nb": "SELECT id, kind, CASE WHEN kind = 'method' THEN upper(name) ELSE name END AS name, qualified_name, path, language, role FROM nodes WHERE kind <> 'event'",
    "eb": "SELECT id, source_id, target_id, kind, CASE WHEN kind = 'writes' THEN weight * 1.2 ELSE weight END AS weight FROM edges WHERE kind <> 'reads'",
}


@query("SELECT id, kind, name FROM nodes WHERE kind = 'function' AND language = 'python' AND contains(lower(name), 'get')")
def filter_nodes(spark, d):
    return g.filter_nodes(nodes(spark, d), kind="function", language="python", name_pattern="GET").select("id", "kind", "name")


@query("SELECT id, name FROM nodes WHERE role = 'observation'")
def nodes_by_role(spark, d):
    return g.filter_nodes(nodes(spark, d), role="observation").select("id", "name")


@query("SELECT id, source_id, target_id, weight FROM edges WHERE kind = 'writes' AND weight >= 40")
def filter_edges(spark, d):
    return g.filter_edges(edges(spark, d), kind="writes", min_weight=40).select("id", "source_id", "target_id", "weight")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS ids FROM edges GROUP BY kind")
def edge_ids(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(g.edge_id()).alias("ids"))


@query("SELECT id, substr(sha256('4:kind;' || length(kind) || ':' || kind || ';4:repo;0:;4:path;' || length(path) || ':' || path || ';5:qname;' || length(qualified_name) || ':' || qualified_name || ';'), 1, 16) AS node_id FROM nodes")
def node_ids(spark, d):
    return nodes(spark, d).select("id", g.node_id(("kind", "kind"), ("repo", F.lit("")), ("path", "path"), ("qname", "qualified_name")).alias("node_id"))


@query("SELECT source_id, target_id, kind, max(w) AS weight FROM (SELECT source_id, target_id, kind, weight AS w FROM edges UNION ALL SELECT source_id, target_id, kind, weight * 2 FROM edges WHERE kind = 'calls' UNION ALL SELECT source_id, 'missing', kind, weight FROM edges WHERE kind = 'guards') WHERE target_id <> 'missing' GROUP BY ALL")
def upsert_edges(spark, d):
    e = edges(spark, d).select("source_id", "target_id", "kind", "weight")
    again = e.filter("kind = 'calls'").withColumn("weight", F.col("weight") * 2)
    dangling = e.filter("kind = 'guards'").withColumn("target_id", F.lit("missing"))
    return g.upsert_edges(nodes(spark, d), e.union(again).union(dangling)).select("source_id", "target_id", "kind", "weight")


_SUB = "SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT CAST(sum(weight) AS DOUBLE) FROM e) AS weight"


def _size(graph: g.PropertyGraph):
    return graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight")))


@query(_SUB, n="SELECT * FROM nodes WHERE kind IN ('class', 'method', 'variable')", e="SELECT * FROM edges WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def kind_subgraph(spark, d):
    return _size(g.kind_subgraph(whole(spark, d), ["class", "method", "variable"]))


@query(_SUB, e="SELECT * FROM edges WHERE kind = 'contains'", n="SELECT * FROM nodes WHERE id IN (SELECT source_id FROM e UNION SELECT target_id FROM e)")
def edge_kind_subgraph(spark, d):
    return _size(g.edge_kind_subgraph(whole(spark, d), "contains"))


@query(_SUB, n="SELECT * FROM nodes WHERE NOT name LIKE 'get%'", e="SELECT * FROM edges WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def remove_nodes(spark, d):
    graph = whole(spark, d)
    return _size(g.remove_nodes(graph, graph.nodes.filter("name LIKE 'get%'")))


@query("SELECT id, v AS neighbour FROM adj JOIN nodes ON id = u WHERE kind = 'class'", adj="SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges")
def neighbours(spark, d):
    graph = whole(spark, d)
    return g.neighbours(graph, graph.nodes.filter("kind = 'class'"))


_ENDS = "SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target_id, 1, 0 FROM edges) GROUP BY id"
_DEG = "SELECT nodes.id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS degree, (coalesce(i, 0) + coalesce(o, 0)) / CAST((SELECT count(*) FROM nodes) - 1 AS DOUBLE) AS centrality FROM nodes LEFT JOIN ends ON nodes.id = ends.id"


@query("SELECT * FROM deg", ends=_ENDS, deg=_DEG)
def degrees(spark, d):
    return g.degrees(whole(spark, d))


@query("SELECT 'node' AS what, kind, count(*) AS count FROM nodes GROUP BY ROLLUP (kind) UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ROLLUP (kind)")
def graph_stats(spark, d):
    return g.graph_stats(whole(spark, d))


@query("SELECT n_nodes, n_edges, round(n_edges / CAST(n_nodes * (n_nodes - 1) AS DOUBLE), 9) AS density, round(least(1, 0.6 * n_edges / (n_nodes * (n_nodes - 1) / 2) + 0.4 * least(1, log2(n_nodes + 1) / log2(1000))), 9) AS complexity FROM (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges)")
def graph_metrics(spark, d):
    return g.density(whole(spark, d)).withColumns({"density": F.round("density", 9), "complexity": F.round("complexity", 9)})


@query(
    "SELECT k.u AS id, k.neighbours, count(t.x) AS links, count(t.x) / (k.neighbours * (k.neighbours - 1) / 2.0) AS coefficient FROM k LEFT JOIN t ON t.u = k.u WHERE k.neighbours >= 2 GROUP BY k.u, k.neighbours",
    adj="SELECT source_id AS u, target_id AS v FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id",
    k="SELECT u, count(*) AS neighbours FROM adj GROUP BY u",
    t="SELECT a.u, a.v AS x, b.v AS y FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v JOIN adj c ON c.u = a.v AND c.v = b.v",
)
def clustering_coefficient(spark, d):
    return g.clustering(edges(spark, d))


_KEY = "source_id || '|' || target_id || '|' || kind"


@query(
    "SELECT source_id, target_id, kind, round(weight, 6) AS weight, conflict FROM m WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)",
    **HALVES,
    n="SELECT id FROM na UNION SELECT id FROM nb",
    m="SELECT source_id, target_id, kind, greatest(coalesce(a.weight, b.weight), coalesce(b.weight, a.weight)) AS weight, coalesce(abs(a.weight - b.weight) > 0.1, false) AS conflict FROM ea a FULL JOIN eb b USING (source_id, target_id, kind)",
)
def merge_union(spark, d):
    a, b = halves(spark, d)
    return g.merged_edges(a, b, g.merged_nodes(a, b)).select("source_id", "target_id", "kind", F.round("weight", 6).alias("weight"), "conflict")


@query(
    "SELECT source_id, target_id, kind, round(wd, 6) AS weight FROM (SELECT source_id, target_id, kind, a.weight AS ws, b.weight AS wd FROM ea a JOIN eb b USING (source_id, target_id, kind)) WHERE abs(ws - wd) > 0.1 AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)",
    **HALVES,
    n="SELECT id FROM na UNION SELECT id FROM nb",
)
def merge_conflicts_dynamic(spark, d):
    return g.merge(*halves(spark, d), strategy="dynamic_priority")[1].select("source_id", "target_id", "kind", F.round("weight", 6).alias("weight"))


@query(
    f"""SELECT 'node' AS what, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(a.id, b.id) AS key FROM na a FULL JOIN nb b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name <> b.name OR a.qualified_name <> b.qualified_name OR a.path <> b.path
    UNION ALL SELECT 'edge', CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END, coalesce(a.k, b.k) FROM (SELECT {_KEY} AS k FROM ea) a FULL JOIN (SELECT {_KEY} AS k FROM eb) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
    **HALVES,
)
def graph_diff(spark, d):
    return g.diff(*halves(spark, d))


@query("SELECT (SELECT count(DISTINCT path) FROM nodes) AS modules, avg(CASE WHEN a.path <> b.path THEN 1.0 ELSE 0 END) AS coupling, 1 - avg(CASE WHEN a.path <> b.path THEN 1.0 ELSE 0 END) AS cohesion FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id")
def coupling_cohesion(spark, d):
    return g.coupling_and_cohesion(whole(spark, d))


@query(
    "SELECT 'degree' AS what, id, degree FROM (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10) UNION ALL SELECT 'sink', id, degree FROM deg WHERE out_degree = 0 UNION ALL SELECT 'source', id, degree FROM deg WHERE in_degree = 0",
    ends=_ENDS, deg=_DEG,
)
def hotspots(spark, d):
    return g.hotspots(whole(spark, d))


@query(
    "SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, i AS instability, a AS abstractness, abs(a + i - 1) AS distance, CASE WHEN abs(a + i - 1) > 0.3 AND i > 0.8 THEN 'pain' WHEN abs(a + i - 1) > 0.3 AND i < 0.2 THEN 'uselessness' END AS zone FROM (SELECT *, coalesce(coalesce(ce, 0) / CAST(nullif(coalesce(ca, 0) + coalesce(ce, 0), 0) AS DOUBLE), 0) AS i, coalesce(na / CAST(nullif(na + nc, 0) AS DOUBLE), 0) AS a FROM both_)",
    e="SELECT DISTINCT a.path AS source, b.path AS target FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.path <> b.path",
    cls="SELECT path AS module, CAST(count(*) FILTER (WHERE name LIKE 'Base%') AS BIGINT) AS na, CAST(count(*) FILTER (WHERE NOT name LIKE 'Base%') AS BIGINT) AS nc FROM nodes WHERE kind = 'class' GROUP BY path",
    both_="SELECT module, ca, ce, coalesce(na, 0) AS na, coalesce(nc, 0) AS nc FROM (SELECT source AS module, count(*) AS ce FROM e GROUP BY source) FULL JOIN (SELECT target AS module, count(*) AS ca FROM e GROUP BY target) USING (module) LEFT JOIN cls USING (module)",
)
def module_coupling(spark, d):
    graph = whole(spark, d)
    classes = graph.nodes.filter("kind = 'class'").groupBy(F.col("path").alias("module")).agg(F.count_if(F.col("name").startswith("Base")).alias("n_abstract"), F.count_if(~F.col("name").startswith("Base")).alias("n_concrete"))
    return g.module_metrics(g.module_edges(graph).select(F.col("source_path").alias("source"), F.col("target_path").alias("target")), classes)


@query("SELECT id, kind FROM edges WHERE kind NOT IN ('guards', 'throws')")
def remove_edges(spark, d):
    e = edges(spark, d)
    return g.remove_edges(e, e.filter("kind IN ('guards', 'throws')")).select("id", "kind")


@query("SELECT source_id, target_id, arg_max(CAST(trunc(weight) AS BIGINT), kind) AS weight FROM edges GROUP BY source_id, target_id")
def weighted_adjacency(spark, d):
    return g.weighted_adjacency(edges(spark, d), ["kind"])


@query("SELECT c.id, CAST(count(m.id) AS BIGINT) AS cardinality, coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS names FROM nodes c LEFT JOIN (SELECT source_id, n.id, n.name FROM edges JOIN nodes n ON n.id = target_id AND n.kind = 'method' WHERE edges.kind = 'contains') m ON m.source_id = c.id WHERE c.kind = 'class' GROUP BY c.id")
def class_cardinality(spark, d):
    return g.child_names(whole(spark, d), "class", "method").withColumn("names", F.array_join("names", ","))


@query("SELECT id, degree FROM deg WHERE id IN (SELECT id FROM nodes WHERE kind = 'variable') ORDER BY degree DESC, id LIMIT 50", ends=_ENDS, deg=_DEG)
def top_states(spark, d):
    graph = whole(spark, d)
    return g.top_nodes(graph.nodes.filter("kind = 'variable'"), g.degrees(graph), 50)


@query(
    "SELECT n_nodes, n_edges, round(least(1, 0.6 * n_edges / (n_nodes * (n_nodes - 1) / 2) + 0.4 * least(1, log2(n_nodes + 1) / log2(1000))), 9) AS complexity, round(coupling, 9) AS coupling, round(1 - coupling, 9) AS cohesion FROM (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT avg(CASE WHEN a.path <> b.path THEN 1.0 ELSE 0 END) FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id) AS coupling)"
)
def metric_summary(spark, d):
    graph = whole(spark, d)
    both = g.density(graph).crossJoin(g.coupling_and_cohesion(graph))  # one row each
    return both.select("n_nodes", "n_edges", *[F.round(c, 9).alias(c) for c in ("complexity", "coupling", "cohesion")])
