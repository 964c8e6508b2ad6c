"""Queries of enrichment, communities, sampled centralities, flows, loops and schedules, with their oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored
from graphloom.operators import betweenness as between
from graphloom.operators import communities as community
from graphloom.operators import enrichment, flows, incremental, resolution, schedule, types, validate
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.graph_queries import HALVES, halves, whole
from graphloom.plans.path_queries import _DEPTH, _TIME, hand, trace
from graphloom.plans.projection import HANDOVERS, oracle, plain, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *, graph: bool = False, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, graph=graph, **ctes)
        return f

    return register


# --- enrichment: parts as functions in the files of their brands, users as traced functions ---

_EV = _TIME["ev"].replace("event_type AS name", "'fn_' || CAST(user_id % 211 AS VARCHAR) AS name")
_FN = {
    "fn": "SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'method' WHEN p_partkey % 7 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'fn_' || CAST(p_partkey // 2 AS VARCHAR) END AS name, 'fn_' || CAST(p_partkey + 3 AS VARCHAR) AS qualified_name, p_brand AS path, p_size AS a, p_size * 40 AS z FROM part",
    "ln": "SELECT p_brand AS file, l_linenumber * 50 + (l_orderkey % 50) AS line, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS hits, l_linestatus = 'F' AS br FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cl": "SELECT 'p:' || CAST(l_partkey AS VARCHAR) AS source_id, 'p:' || CAST(l_suppkey AS VARCHAR) AS target_id, 'calls' AS kind, sum(l_quantity) AS weight FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey, l_suppkey",
}
_TRACED = {
    **_FN, **_TIME, "ev": _EV,
    "tm": "SELECT name, count(*) AS n, avg(us / 1000) AS mean_ms, avg(us / 1000) * count(*) AS total FROM du GROUP BY name",
    "le": "SELECT min(total) AS least FROM (SELECT total FROM tm ORDER BY total DESC LIMIT (SELECT greatest(1, count(*) // 10) FROM tm))",
    "ix": "SELECT name, id, 0 AS exact FROM fn WHERE kind <> 'class' UNION ALL SELECT qualified_name, id, 1 FROM fn WHERE kind <> 'class' AND qualified_name <> name",
    "tr": "SELECT id, arg_max(n, (exact, name)) AS call_count, round(arg_max(mean_ms, (exact, name)), 4) AS avg_duration_ms, arg_max(total >= least, (exact, name)) AS is_hot_path FROM ix JOIN tm USING (name), le GROUP BY id",
}


def _functions(spark, d) -> PropertyGraph:
    t = tables(spark, d)
    kind = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'method' WHEN p_partkey % 7 = 0 THEN 'class' ELSE 'function' END").alias("kind")
    name = F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE concat('fn_', p_partkey div 2) END").alias("name")
    n = t["part"].select(F.concat(F.lit("p:"), "p_partkey").alias("id"), kind, name, F.expr("concat('fn_', p_partkey + 3)").alias("qualified_name"), F.concat(F.lit("./"), "p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") * 40).alias("end_line"))
    e = t["lineitem"].filter("l_linenumber = 1").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("weight"))
    e = e.select(F.concat(F.lit("p:"), "l_partkey").alias("source_id"), F.concat(F.lit("p:"), "l_suppkey").alias("target_id"), F.lit("calls").alias("kind"), "weight")
    return PropertyGraph(n, e.withColumn("id", F.expr("substr(sha2(concat_ws('|', source_id, target_id, kind), 256), 1, 16)")))


def _lines(spark, d):
    t = tables(spark, d)
    both = t["lineitem"].join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("p_brand").alias("file"), (F.col("l_linenumber") * 50 + F.col("l_orderkey") % 50).alias("line"), F.expr("CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END").alias("hits"), (F.col("l_linestatus") == "F").alias("is_branch"))


def _traced(spark, d):
    return stored(trace(spark, d).withColumn("name", F.expr("concat('fn_', tid % 211)")), "trace")


@query("SELECT id, CAST(count(*) FILTER (WHERE hits > 0) AS BIGINT) AS coverage_hits, CASE WHEN count(*) FILTER (WHERE br) > 0 THEN count(*) FILTER (WHERE br AND hits > 0) / CAST(count(*) FILTER (WHERE br) AS DOUBLE) END AS branch_coverage FROM fn JOIN ln ON path = file AND line BETWEEN a AND z GROUP BY id HAVING count(*) FILTER (WHERE hits > 0 OR br) > 0", **_FN)
def coverage_marks(spark, d):
    return enrichment.coverage_marks(_functions(spark, d).nodes, _lines(spark, d))


@query("SELECT * FROM tr", **_TRACED)
def trace_marks(spark, d):
    return enrichment.trace_marks(_functions(spark, d).nodes, _traced(spark, d))


@query(
    "SELECT fn.id, CAST(h AS VARCHAR) AS hits, CAST(call_count AS VARCHAR) AS calls, CAST(is_hot_path AS VARCHAR) AS hot FROM fn LEFT JOIN tr USING (id) LEFT JOIN (SELECT id, count(*) FILTER (WHERE hits > 0) AS h FROM fn JOIN ln ON path = file AND line BETWEEN a AND z GROUP BY id HAVING count(*) FILTER (WHERE hits > 0 OR br) > 0) USING (id)",
    **_TRACED,
)
def enriched_nodes(spark, d):
    g = enrichment.enriched(_functions(spark, d), lines=_lines(spark, d), events=_traced(spark, d))
    m = F.col("metadata")
    return g.nodes.select("id", m["coverage_hits"].alias("hits"), m["call_count"].alias("calls"), m["is_hot_path"].alias("hot"))


@query(
    "SELECT source_id, target_id, CAST(greatest(cl.weight, n.weight) AS DOUBLE) AS weight, n.weight IS NOT NULL AS dynamic FROM cl FULL JOIN n USING (source_id, target_id)",
    **{k: v for k, v in _TRACED.items() if k not in ("le", "tr", "ln")},
    **{f"c_{k}": v.replace("FROM o", "FROM c_o").replace("FROM s", "FROM c_s").replace("FROM q", "FROM c_q") for k, v in _DEPTH.items() if k != "ev"},
    pr="SELECT DISTINCT caller, callee FROM (SELECT x.k, x.pid, x.tid, x.name AS callee, arg_max(y.name, y.k) AS caller FROM c_b x JOIN c_b y ON x.pid = y.pid AND x.tid = y.tid AND y.ph = 'B' AND y.k < x.k AND y.depth = x.depth - 1 WHERE x.ph <> 'E' AND x.depth > 0 GROUP BY ALL)",
    n="SELECT i.id AS source_id, j.id AS target_id, CAST(max(coalesce(tm.n, 1)) AS DOUBLE) AS weight FROM pr JOIN ix i ON i.name = caller JOIN ix j ON j.name = callee LEFT JOIN tm ON tm.name = callee GROUP BY i.id, j.id",
)
def enriched_edges(spark, d):
    g = enrichment.enriched(_functions(spark, d), events=_traced(spark, d))
    return g.edges.select("source_id", "target_id", "weight", F.array_contains(F.coalesce("evidence_sources", F.array().cast("array<string>")), "dynamic_trace").alias("dynamic"))


# --- communities, sampled centralities ---


@query()
def communities(spark, d):
    g = hand(spark, d)
    return community.communities(g.nodes, g.edges)


@query("SELECT round(sum(own) / sum(s) - sum(s * s) / (sum(s) * sum(s)), 9) AS modularity FROM (SELECT a.kind AS c, sum(w) AS s, sum(CASE WHEN a.kind = b.kind THEN w ELSE 0 END) AS own FROM (SELECT source_id AS u, target_id AS v, weight AS w FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges) e JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v GROUP BY a.kind)", graph=True)
def kind_modularity(spark, d):
    g = whole(spark, d)
    return spark.createDataFrame([(round(community.modularity(g.edges, g.nodes.select("id", F.col("kind").alias("community"))), 9),)], "modularity double")


@query()
def sampled_betweenness(spark, d):
    g = hand(spark, d)
    return between.betweenness(g.nodes, g.edges, sample=32).select("id", F.round("score", 9).alias("score"))


# --- flows and loops ---

_FLOW = "kind IN ('contains', 'reads', 'writes') AND NOT (source_id LIKE 's:%' AND target_id LIKE 'n:%') AND NOT (source_id LIKE 'r:%' AND kind = 'reads')"


@query(
    "SELECT source, sink, path FROM p WHERE cur = sink", graph=True, f=f"SELECT DISTINCT source_id AS u, target_id AS v FROM edges WHERE {_FLOW}",
    lead="SELECT v AS sink, v AS node FROM f WHERE v NOT IN (SELECT u FROM f) AND v LIKE 'p:%' UNION SELECT sink, u FROM lead JOIN f ON v = node",
    p="SELECT node AS source, sink, node AS cur, node AS path FROM lead WHERE node NOT IN (SELECT v FROM f) UNION ALL SELECT source, p.sink, v, path || '>' || v FROM p JOIN f ON u = cur JOIN lead ON lead.node = v AND lead.sink = p.sink WHERE cur <> p.sink",
)
def taint_paths(spark, d):
    g = whole(spark, d)
    e = stored(g.edges.filter(_FLOW).select("source_id", "target_id"), "flow")
    out = flows.taint_paths(e, None, flows.flow_sinks(e).filter("id LIKE 'p:%'"))
    return out.select("source", "sink", F.array_join("path", ">").alias("path"))


@query(
    "SELECT source_id || '>' || source_id AS loop FROM e WHERE source_id = target_id UNION ALL SELECT a.source_id || '>' || a.target_id || '>' || a.source_id FROM e a JOIN e b ON b.source_id = a.target_id AND b.target_id = a.source_id WHERE a.source_id < a.target_id "
    "UNION ALL SELECT a.source_id || '>' || b.source_id || '>' || c.source_id || '>' || a.source_id FROM e a JOIN e b ON b.source_id = a.target_id JOIN e c ON c.source_id = b.target_id AND c.target_id = a.source_id WHERE a.source_id < b.source_id AND a.source_id < c.source_id AND b.source_id <> c.source_id",
    e=plain(HANDOVERS),
)
def feedback_loops(spark, d):
    return flows.feedback_loops(hand(spark, d).edges, kinds=None, max_nodes=3).select(F.array_join("loop", ">").alias("loop"))


@query(
    "SELECT source_id, target_id FROM e WHERE source_id IN (SELECT id FROM r JOIN cyc ON root = c UNION SELECT c FROM cyc) AND target_id IN (SELECT root FROM r JOIN cyc ON id = c UNION SELECT c FROM cyc)",
    e=plain(HANDOVERS), r="SELECT source_id AS root, target_id AS id FROM e UNION SELECT root, target_id FROM r JOIN e ON source_id = id", cyc="SELECT root AS c FROM r WHERE root = id",
)
def loop_core(spark, d):
    return flows.loop_core(hand(spark, d).edges)


# --- critical paths: stages are the nodes of the containment, their durations the lengths of their names ---

_STEPS = "kind IN ('contains', 'calls', 'triggers')"
_LONG = {
    "du": "SELECT id AS stage, CAST(length(name) AS DOUBLE) AS duration FROM nodes", "li": f"SELECT DISTINCT source_id AS u, target_id AS v FROM edges WHERE {_STEPS}",
    "up": "SELECT stage, duration AS length FROM du WHERE stage NOT IN (SELECT u FROM li) UNION SELECT u, duration + length FROM up JOIN li ON v = up.stage JOIN du ON du.stage = u",
    "lo": "SELECT stage, max(length) AS length FROM up GROUP BY stage",
    "nx": "SELECT u AS stage, min(v) AS next FROM (SELECT u, v, length, max(length) OVER (PARTITION BY u) AS m FROM li JOIN lo ON stage = v) WHERE length = m GROUP BY u",
    "walk": "SELECT stage AS entry, CAST(0 AS BIGINT) AS position, stage FROM (SELECT stage FROM lo ORDER BY length DESC, stage LIMIT 1) UNION ALL SELECT entry, position + 1, next FROM walk JOIN nx USING (stage)",
}


def _process(spark, d):
    g = whole(spark, d)
    return g.nodes.select(F.col("id").alias("stage"), F.length("name").cast("double").alias("duration")), g.edges.filter(_STEPS).select(F.col("source_id").alias("source_stage"), F.col("target_id").alias("target_stage"))


@query("SELECT stage, length, next FROM lo LEFT JOIN nx USING (stage)", graph=True, **_LONG)
def longest_paths(spark, d):
    return schedule.longest_paths(*_process(spark, d))


@query("SELECT entry, position, stage, length AS remaining FROM walk JOIN lo USING (stage)", graph=True, **_LONG)
def critical_path(spark, d):
    return schedule.critical_path(*_process(spark, d))


@query(
    "SELECT position, w.id FROM w JOIN own USING (id, entry) WHERE entry = (SELECT entry FROM own GROUP BY entry ORDER BY count(*) DESC, entry LIMIT 1)", graph=True,
    st="SELECT source_id AS id, target_id AS next FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, id) AS r FROM edges) WHERE r = 1",
    w="SELECT id AS entry, id, CAST(0 AS BIGINT) AS position FROM nodes WHERE id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT entry, next, position + 1 FROM w JOIN st USING (id) WHERE position < 40",
    own="SELECT id, min(entry) AS entry FROM w GROUP BY id",
)
def greedy_critical_path(spark, d):
    n, e = stored(whole(spark, d).nodes.select("id"), "nodes"), stored(whole(spark, d).edges, "edges")
    return schedule.greedy_critical_path(n, e)


@query()
def parallel_groups(spark, d):
    o = tables(spark, d)["orders"]
    stage = F.concat(F.lit("o:"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    s = o.select(stage.alias("stage"), F.expr("CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE)").alias("start"), "o_custkey", "o_orderkey")
    links = s.withColumn("target_stage", F.lead("stage").over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey"))).filter("target_stage IS NOT NULL")
    return schedule.parallel_groups(s.select("stage", "start"), links.select(F.col("stage").alias("source_stage"), "target_stage"))


# --- conflicts and evidence: each customer's parts are a mapping, and customers share parts ---

_MAPPED = {
    "mp": "SELECT 'c:' || CAST(o_custkey AS VARCHAR) AS mapping_id, 'rule_' || CAST(o_custkey % 4 AS VARCHAR) AS rule, CASE o_custkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'action' ELSE 'context' END AS kind, list_sort(list(DISTINCT 'p:' || CAST(l_partkey AS VARCHAR))) AS node_ids, count(DISTINCT l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "pv": "SELECT mapping_id, unnest(range(k)) AS i FROM mp",
    "tx": "SELECT mapping_id, list(n.kind || ':' || n.qualified_name || ' (' || n.path || ')' ORDER BY i) AS t FROM (SELECT mapping_id, unnest(node_ids[1:8]) AS id, unnest(range(len(node_ids[1:8]))) AS i FROM mp) JOIN nodes n USING (id) GROUP BY mapping_id",
    "sn": "SELECT mapping_id, list_concat(t, list_transform(range(least(k, 5)), lambda i: 'provenance:source_' || CAST(i AS VARCHAR)))[1:12] AS s FROM tx JOIN mp USING (mapping_id)",
}


def _mapped(spark, d):
    t = tables(spark, d)
    both = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    m = both.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p:"), "l_partkey"))).alias("node_ids"), F.count_distinct("l_linenumber").alias("k"))
    source = F.expr("transform(sequence(0, CAST(k AS INT) - 1), i -> struct(concat('source_', i) AS source, 0.5D + 0.05D * i AS confidence))")
    return m.select(
        F.concat(F.lit("c:"), "o_custkey").alias("mapping_id"), F.expr("concat('rule_', o_custkey % 4)").alias("rule"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'action' ELSE 'context' END").alias("kind"),
        "node_ids", source.alias("provenance"), F.expr("o_custkey % 5").alias("priority"), F.expr("0.5D + (o_custkey % 7) * 0.05D").alias("confidence"),
    )


@query()
def resolve_shared(spark, d):
    return resolution.resolutions(_mapped(spark, d))


@query("SELECT mapping_id, rule, array_to_string(s, '; ') AS snippets, k AS evidence_count, round(CAST(0.5 + 0.025 * (k - 1) AS DOUBLE), 6) AS evidence_mean FROM mp JOIN sn USING (mapping_id)", graph=True, **_MAPPED)
def evidence_records(spark, d):
    m = stored(_mapped(spark, d), "mappings")
    t = resolution.evidence_trace(m, whole(spark, d).nodes)
    return t.select("mapping_id", "rule", F.array_join("evidence_snippets", "; ").alias("snippets"), F.col("evidence_count").cast("long").alias("evidence_count"), F.round("evidence_mean", 6).alias("evidence_mean"))


@query("SELECT 'rule' AS by, rule AS value, count(*) AS mappings FROM mp GROUP BY rule UNION ALL SELECT 'kind', kind, count(*) FROM mp GROUP BY kind UNION ALL SELECT 'status', 'auto_proposed', count(*) FROM mp", graph=True, **_MAPPED)
def evidence_summary(spark, d):
    return resolution.evidence_summary(resolution.evidence_trace(stored(_mapped(spark, d), "mappings"), whole(spark, d).nodes))


@query()
def evidence_conflicts(spark, d):
    """The whole trace: who won, who was dropped by whom."""
    m = stored(_mapped(spark, d), "mappings")
    return resolution.evidence_trace(m, whole(spark, d).nodes, stored(resolution.resolutions(m), "outcome"))


# --- a state space kept up to date: from the first half of the graph to the second, by the files that differ ---

_IM = "SELECT 'm:' || id AS mapping_id, CASE WHEN kind IN ('class', 'variable') THEN 'hidden_state' WHEN role = 'observation' THEN 'observation' WHEN role = 'action' THEN 'action' END AS kind, id AS node_id, 0.5 + CAST(length(id) AS DOUBLE) AS score FROM nb WHERE kind IN ('class', 'variable') OR role IN ('observation', 'action')"


def _facts(g: PropertyGraph):
    """Facts by file: each node is one, with its mapping and outgoing edges; its checksum is over both."""
    kind = F.expr("CASE WHEN kind IN ('class', 'variable') THEN 'hidden_state' WHEN role IN ('observation', 'action') THEN role END")
    m = g.nodes.select(F.col("id").alias("path"), F.concat(F.lit("m:"), "id").alias("mapping_id"), kind.alias("kind"), F.col("id").alias("node_id"), (F.lit(0.5) + F.length("id").cast("double")).alias("score")).filter("kind IS NOT NULL")
    e = g.edges.select(F.col("source_id").alias("path"), "source_id", "target_id", "kind")
    both = m.select("path", F.xxhash64("mapping_id", "kind", "score").alias("h")).union(e.select("path", F.xxhash64("target_id", "kind")))
    return m, e, stored(both.groupBy("path").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.expr("hex(bit_xor(h))")).alias("checksum")), "files")


@query(
    "SELECT part, id, other, detail, score FROM (SELECT CASE kind WHEN 'hidden_state' THEN 'variable' ELSE kind END AS part, node_id AS id, '' AS other, '' AS detail, score FROM im "
    "UNION ALL SELECT DISTINCT CASE WHEN eb.kind IN ('writes', 'mutates') THEN 'effect' ELSE 'precondition' END, source_id, target_id, CASE WHEN eb.kind IN ('writes', 'mutates') THEN 'writes' ELSE 'reads' END, NULL "
    "FROM eb JOIN im a ON a.node_id = source_id AND a.kind = 'action' JOIN im v ON v.node_id = target_id AND v.kind = 'hidden_state' WHERE eb.kind IN ('writes', 'mutates', 'reads', 'observes'))",
    graph=True, **HALVES, im=_IM,
)
def incremental_compile(spark, d):
    (ma, ea, fa), (mb, eb, fb) = (_facts(g) for g in halves(spark, d))
    changes = stored(incremental.source_changes(fa, fb), "changes")
    facts = incremental.FACTS
    now = incremental.updated(incremental.compiled(ma, ea), incremental.facts_delta(ma, mb, changes, facts["mappings"]), incremental.facts_delta(ea, eb, changes, facts["edges"]))
    return incremental.state_space(now)


# --- types: parts have one by their number, and whoever reads or is written to takes it ---

_TYPED = "CASE p_partkey % 7 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'str' WHEN 3 THEN 'None' WHEN 4 THEN 'bool' ELSE {brand} END"


@query(
    "SELECT symbol, array_to_string(CASE WHEN len(v) > 3 THEN ['Any'] ELSE v END, ',') AS types FROM (SELECT symbol, list_sort(list_concat(list_filter(a, lambda x: x NOT IN ('bool', 'int', 'float', 'complex')), CASE WHEN list_contains(a, 'float') THEN ['float'] WHEN list_contains(a, 'int') THEN ['int'] WHEN list_contains(a, 'bool') THEN ['bool'] ELSE [] END)) AS v FROM (SELECT symbol, list(DISTINCT type) AS a FROM r GROUP BY symbol))",
    graph=True, f="SELECT target_id AS source, source_id AS target FROM edges WHERE kind = 'writes' AND source_id LIKE 'c:%' UNION SELECT source_id, target_id FROM edges WHERE kind IN ('throws', 'returns')",
    r="SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS symbol, " + _TYPED.format(brand="p_brand") + " AS type FROM part UNION SELECT target, type FROM r JOIN f ON source = symbol",
)
def inferred_types(spark, d):
    e = stored(whole(spark, d).edges, "edges")
    known = tables(spark, d)["part"].select(F.concat(F.lit("p:"), "p_partkey").alias("symbol"), F.expr(_TYPED.format(brand="p_brand")).alias("type"))
    flow = e.filter("kind = 'writes' AND source_id LIKE 'c:%'").select(F.col("target_id").alias("source"), F.col("source_id").alias("target"))
    flow = flow.union(e.filter("kind IN ('throws', 'returns')").select("source_id", "target_id"))
    return types.inferred(known, flow).select("symbol", F.array_join("types", ",").alias("types"))


# --- validation: effects of the first half of the graph against variables of the second; stages of customers and suppliers only ---


@query(
    "SELECT DISTINCT 'action_without_variable' AS issue, 'error' AS severity, source_id AS id, target_id AS reference FROM ea JOIN na ON na.id = source_id AND na.kind = 'function' WHERE ea.kind IN ('writes', 'reads') AND target_id NOT IN (SELECT id FROM nb WHERE kind = 'variable' AND name NOT LIKE 'value%')",
    graph=True, **HALVES,
)
def state_space_issues(spark, d):
    a, b = halves(spark, d)
    acts = a.edges.filter("kind IN ('writes', 'reads')").join(a.nodes.filter("kind = 'function'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return validate.state_space_issues(b.nodes.filter("kind = 'variable' AND name NOT LIKE 'value%'"), acts.select(F.col("source_id").alias("action"), F.col("target_id").alias("variable")))


_ST = "SELECT id FROM nodes WHERE kind IN ('function', 'method')"


@query(
    "SELECT 'link_without_source' AS issue, 'error' AS severity, u || '>' || w AS id, u AS reference FROM li WHERE u NOT IN (SELECT id FROM st) UNION ALL SELECT 'link_without_target', 'error', u || '>' || w, w FROM li WHERE w NOT IN (SELECT id FROM st) "
    "UNION ALL SELECT 'entry_without_stage', 'error', id, NULL FROM nodes WHERE kind = 'module' UNION ALL SELECT 'exit_without_stage', 'error', id, NULL FROM nodes WHERE kind = 'variable'",
    graph=True, st=_ST, li="SELECT DISTINCT source_id AS u, target_id AS w FROM edges WHERE kind IN ('calls', 'triggers', 'contains')",
)
def process_issues(spark, d):
    n, e = stored(whole(spark, d).nodes.select("id", "kind"), "nodes"), whole(spark, d).edges.filter("kind IN ('calls', 'triggers', 'contains')")
    links = stored(e.select(F.col("source_id").alias("source_stage"), F.col("target_id").alias("target_stage")), "links")
    return validate.process_issues(n.filter("kind IN ('function', 'method')"), links, n.filter("kind = 'module'"), n.filter("kind = 'variable'"))


@query("SELECT kind, count(*) AS elements, count(o.k) AS covered, count(o.k) / CAST(count(*) AS DOUBLE) AS share FROM nodes LEFT JOIN (SELECT DISTINCT target_id AS k FROM edges WHERE kind IN ('reads', 'writes')) o ON o.k = id GROUP BY kind", graph=True)
def provenance_coverage(spark, d):
    g = whole(spark, d)
    return validate.provenance_coverage(g.nodes.select("id", "kind"), g.edges.filter("kind IN ('reads', 'writes')").select("target_id"))
