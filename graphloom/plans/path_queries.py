"""Queries of traversal, centrality, blankets, processes, traces, state spaces and inference, with their oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.storage import stored
from graphloom.operators import blanket, components, inference, process, statespace, traces, validate
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.graph_queries import whole
from graphloom.plans.projection import HANDOVERS, edges, handovers, nodes, oracle, plain, successions, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *, graph: bool = True, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, graph=graph, **ctes)
        return f

    return register


# --- traversal over the users' hand-overs ---

HAND = {"e": plain(HANDOVERS), "v": "SELECT source_id AS id FROM e UNION SELECT target_id FROM e", "adj": "SELECT source_id AS u, target_id AS w FROM e WHERE source_id <> target_id UNION SELECT target_id, source_id FROM e WHERE source_id <> target_id"}


def hand(spark, d) -> PropertyGraph:
    e = stored(handovers(spark, d), "handovers")
    return PropertyGraph(e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), e)


def asked(g: PropertyGraph):
    """The query set of paths and scores of nodes: the users whose id is divisible by 50."""
    return stored(g.nodes.filter("CAST(substr(id, 2) AS BIGINT) % 50 = 0"), "asked")


_ASKED = "SELECT id FROM v WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0"


@query("SELECT id, min(root) AS component FROM r GROUP BY id", graph=False, **HAND, r="SELECT id AS root, id FROM v UNION SELECT root, w FROM r JOIN adj ON u = id")
def weakly_connected_components(spark, d):
    g = hand(spark, d)
    return components.weak_components(g.nodes, g.edges)


@query("SELECT a.root AS id, min(a.id) AS component FROM r a JOIN r b ON a.root = b.id AND a.id = b.root GROUP BY a.root", graph=False, **HAND, r="SELECT id AS root, id FROM v UNION SELECT root, target_id FROM r JOIN e ON source_id = id")
def strongly_connected_components(spark, d):
    g = hand(spark, d)
    return components.strong_components(g.nodes, g.edges)


@query("SELECT DISTINCT root AS id FROM r JOIN e ON e.source_id = r.id AND e.target_id = r.root", graph=False, **HAND, r="SELECT id AS root, id FROM v UNION SELECT root, target_id FROM r JOIN e ON source_id = id")
def nodes_on_cycles(spark, d):
    g = hand(spark, d)
    return components.on_cycles(g.nodes, g.edges)


_ALL = {**HAND, "r": "SELECT id AS source, id, 0 AS distance FROM v UNION SELECT source, w, distance + 1 FROM r JOIN adj ON u = id WHERE distance < 12", "dd": "SELECT source, id, min(distance) AS k FROM r GROUP BY source, id"}
_DIST = {**HAND, "q": _ASKED, "r": "SELECT id AS source, id, 0 AS distance FROM q UNION SELECT source, w, distance + 1 FROM r JOIN adj ON u = id WHERE distance < 12"}


@query("SELECT source, id, CAST(min(distance) AS INT) AS distance FROM r GROUP BY source, id", graph=False, **_ALL)
def bfs_distances(spark, d):
    g = hand(spark, d)
    return components.distances(g.nodes, g.edges, g.nodes)


@query("SELECT source, id, CAST(min(distance) AS INT) AS distance FROM r WHERE distance <= 2 GROUP BY source, id", graph=False, **_ALL)
def neighbourhood(spark, d):
    g = hand(spark, d)
    return components.distances(g.nodes, g.edges, g.nodes, limit=2)


@query("SELECT source, distance, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT source, id, CAST(min(distance) AS INT) AS distance FROM r GROUP BY source, id) WHERE distance <= 3 GROUP BY source, distance", graph=False, **_ALL)
def dependency_chain(spark, d):
    g = hand(spark, d)
    out = components.distances(g.nodes, g.edges, g.nodes, limit=3)
    return out.groupBy("source", "distance").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


_NEAREST = {**_DIST, "dd": "SELECT source, id, min(distance) AS k FROM r GROUP BY source, id"}


@query("SELECT source, id, array_to_string(min(path), '>') AS path FROM p GROUP BY source, id", graph=False, **_NEAREST, p="SELECT id AS source, id, [id] AS path, 0 AS n FROM q UNION ALL SELECT p.source, w, list_append(path, w), n + 1 FROM p JOIN adj ON u = p.id JOIN dd ON dd.source = p.source AND dd.id = w AND k = n + 1")
def shortest_paths(spark, d):
    g = hand(spark, d)
    return components.bfs_trees(g.edges, asked(g)).select("source", "id", F.array_join("path", ">").alias("path"))


@query(
    "SELECT source, target, path FROM p WHERE done AND source <> target", graph=False, **HAND, s="SELECT id AS source FROM v ORDER BY id LIMIT 2", t="SELECT id AS target FROM v ORDER BY id DESC LIMIT 2",
    p="SELECT source, target, source AS cur, '>' || source || '>' AS path, 1 AS n, false AS done FROM s, t UNION ALL SELECT source, target, w, path || w || '>', n + 1, w = target FROM p JOIN adj ON u = cur WHERE NOT done AND n < 4 AND NOT contains(path, '>' || w || '>')",
)
def simple_paths(spark, d):
    g = hand(spark, d)
    out = components.simple_paths(g.edges, g.nodes.orderBy("id").limit(2), g.nodes.orderBy(F.desc("id")).limit(2), max_nodes=4)
    return out.select("source", "target", F.concat(F.lit(">"), F.array_join("path", ">"), F.lit(">")).alias("path"))


@query("SELECT id, round(rank, 9) AS rank FROM pr WHERE i = 20", graph=False, **HAND, o="SELECT source_id, count(*) AS k FROM e GROUP BY source_id", m="SELECT v.id AS a, w.id AS b, CAST(coalesce(1.0 / k, 0) AS DOUBLE) * (e.source_id IS NOT NULL)::INT AS share FROM v CROSS JOIN v w LEFT JOIN e ON e.source_id = v.id AND e.target_id = w.id LEFT JOIN o ON o.source_id = v.id", pr="SELECT id, CAST(1.0 / (SELECT count(*) FROM v) AS DOUBLE) AS rank, 0 AS i FROM v UNION ALL SELECT b, CAST(0.15 / (SELECT count(*) FROM v) AS DOUBLE) + 0.85 * s, i + 1 FROM (SELECT b, i, sum(rank * share) AS s FROM pr JOIN m ON a = id WHERE i < 20 GROUP BY b, i)")
def pagerank(spark, d):
    g = hand(spark, d)
    return components.pagerank(g.nodes, g.edges).select("id", F.round("rank", 9).alias("rank"))


@query("SELECT source AS id, coalesce(count(*) FILTER (WHERE k > 0) / CAST(nullif(sum(k), 0) AS DOUBLE), 0) AS closeness FROM dd GROUP BY source", graph=False, **_NEAREST)
def closeness_centrality(spark, d):
    g = hand(spark, d)
    return components.closeness(g.nodes, g.edges, asked(g))


@query("SELECT source AS id, h AS hop, count(*) AS reached FROM dd JOIN (SELECT unnest(range(0, 3))::INTEGER AS h) ON k <= h GROUP BY source, h", graph=False, **_ALL)
def neighbourhood_sizes(spark, d):
    g = hand(spark, d)
    return components.neighbourhood_sizes(g.nodes, g.edges, limit=2)


@query("SELECT source AS id, coalesce(count(*) FILTER (WHERE k > 0) / CAST(nullif(sum(k), 0) AS DOUBLE), 0) AS closeness FROM dd GROUP BY source", graph=False, **_ALL)
def approximate_closeness(spark, d):
    g = hand(spark, d)
    return components.approximate_closeness(g.nodes, g.edges)


@query("SELECT id, count(*) / greatest(1.0, CAST((SELECT count(*) - 1 FROM v) * (SELECT count(*) - 2 FROM v) AS DOUBLE) / 2) AS score FROM (SELECT unnest(path[2:-2]) AS id FROM (SELECT min(path) AS path FROM p GROUP BY source, id) WHERE len(path) > 2) GROUP BY id", graph=False, **_NEAREST, p="SELECT id AS source, id, [id] AS path, 0 AS n FROM q UNION ALL SELECT p.source, w, list_append(path, w), n + 1 FROM p JOIN adj ON u = p.id JOIN dd ON dd.source = p.source AND dd.id = w AND k = n + 1")
def betweenness_centrality(spark, d):
    g = hand(spark, d)
    return components.pair_betweenness(g.nodes, g.edges, asked(g))


# --- blankets ---

_SEED = "SELECT id FROM nodes WHERE path LIKE 'asia/%' OR name = 'asia'"
_ROLE = {
    "seed": _SEED, "x": "SELECT source_id AS id, true AS out FROM edges WHERE source_id <> target_id AND source_id IN (SELECT id FROM seed) AND target_id NOT IN (SELECT id FROM seed) UNION ALL SELECT target_id, false FROM edges WHERE source_id <> target_id AND target_id IN (SELECT id FROM seed) AND source_id NOT IN (SELECT id FROM seed)",
    "roles": "SELECT nodes.id, CASE WHEN seed.id IS NULL THEN 'external' WHEN o IS NULL THEN 'internal' WHEN o THEN 'active' ELSE 'sensory' END AS role FROM nodes LEFT JOIN seed ON seed.id = nodes.id LEFT JOIN (SELECT id, bool_or(out) AS o FROM x GROUP BY id) y ON y.id = nodes.id",
}


def _roles(spark, d):
    g = whole(spark, d)
    return blanket.partition(g.nodes, g.edges, g.nodes.filter("path LIKE 'asia/%' OR name = 'asia'")), g


@query("SELECT * FROM roles", **_ROLE)
def blanket_partition(spark, d):
    return _roles(spark, d)[0]


@query("SELECT a.role AS source_role, b.role AS target_role, kind, count(*) AS n FROM edges JOIN roles a ON a.id = source_id JOIN roles b ON b.id = target_id GROUP BY GROUPING SETS ((a.role, b.role, kind), (a.role, b.role))", **_ROLE)
def blanket_network(spark, d):
    roles, g = _roles(spark, d)
    return blanket.network(g.edges, roles)


@query("SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE role IN {r}) AS BIGINT) AS {n}" for n, r in (("internal", "('internal')"), ("sensory", "('sensory')"), ("active", "('active')"), ("external", "('external')"), ("blanket_size", "('sensory', 'active')"), ("system_size", "('internal', 'sensory', 'active')"))) + " FROM roles", **_ROLE)
def blanket_summary(spark, d):
    return blanket.summary(_roles(spark, d)[0])


_CLOSE = {"c": "SELECT id AS root, id FROM nodes WHERE kind = 'module' UNION SELECT root, target_id FROM c JOIN edges ON source_id = c.id AND edges.kind = 'contains'"}


@query("SELECT root, id FROM c", **_CLOSE)
def contains_closure(spark, d):
    g = whole(spark, d)
    return blanket.closure(g.edges, g.nodes.filter("kind = 'module'"))


@query(
    "SELECT *, row_number() OVER (ORDER BY score DESC, size DESC, root)::INT AS rank FROM (SELECT root, count(*) AS size, coalesce(any_value(inn), 0) AS \"inner\", coalesce(any_value(outt), 0) AS \"outer\", coalesce(any_value(inn), 0) / CAST(coalesce(any_value(inn), 0) + coalesce(any_value(outt), 0) + 1 AS DOUBLE) AS score FROM c LEFT JOIN k USING (root) GROUP BY root)",
    **_CLOSE, k="SELECT root, CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS inn, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS outt FROM (SELECT root, eid, count(DISTINCT side) AS n FROM (SELECT root, edges.id AS eid, 1 AS side FROM edges JOIN c ON c.id = source_id UNION ALL SELECT root, edges.id, 2 FROM edges JOIN c ON c.id = target_id) GROUP BY root, eid) GROUP BY root",
)
def cohesion_ranking(spark, d):
    g = whole(spark, d)
    return blanket.cohesion_ranking(g.nodes, g.edges)


# --- traces over the events of each user ---

_EV = "SELECT event_id AS seq, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'X' ELSE 'E' END AS ph, epoch_us(ts) AS ts, CAST(floor(value * 1000) AS BIGINT) AS dur, user_id % 4 AS pid, user_id AS tid FROM events"


def trace(spark, d):
    e = tables(spark, d)["events"]
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.expr("CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'X' ELSE 'E' END").alias("ph"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("ts"),
        F.floor(F.col("value") * 1000).cast("long").alias("dur"), (F.col("user_id") % 4).alias("pid"), F.col("user_id").alias("tid"),
    )


@query("SELECT pid, tid, string_agg(name, '>' ORDER BY ts, CASE ph WHEN 'B' THEN 0 ELSE 1 END, seq) AS calls FROM ev WHERE ph <> 'E' GROUP BY pid, tid", graph=False, ev=_EV)
def call_sequences(spark, d):
    return traces.call_sequences(trace(spark, d)).select("pid", "tid", F.array_join("calls", ">").alias("calls"))


_DEPTH = {
    "ev": _EV, "o": "SELECT *, CASE ph WHEN 'B' THEN 0 WHEN 'X' THEN 1 ELSE 2 END AS o, CASE ph WHEN 'B' THEN 1 WHEN 'E' THEN -1 ELSE 0 END AS dd FROM ev",
    "s": "SELECT *, sum(dd) OVER (PARTITION BY pid, tid ORDER BY ts, o, seq ROWS UNBOUNDED PRECEDING) AS s FROM o",
    "q": "SELECT *, s - least(0, min(s) OVER (PARTITION BY pid, tid ORDER BY ts, o, seq ROWS UNBOUNDED PRECEDING)) AS after, row_number() OVER (PARTITION BY pid, tid ORDER BY ts, o, seq) AS k FROM s",
    "b": "SELECT *, CASE ph WHEN 'B' THEN after - 1 ELSE after END AS depth FROM q",
}


@query("SELECT caller, callee, count(*) AS n FROM (SELECT x.k, x.pid, x.tid, x.name AS callee, arg_max(y.name, y.k) AS caller FROM b x JOIN b y ON x.pid = y.pid AND x.tid = y.tid AND y.ph = 'B' AND y.k < x.k AND y.depth = x.depth - 1 WHERE x.ph <> 'E' AND x.depth > 0 GROUP BY ALL) GROUP BY caller, callee", graph=False, **_DEPTH)
def dynamic_call_graph(spark, d):
    return traces.call_graph(trace(spark, d))


_TIME = {
    "ev": _EV, "o": "SELECT *, CASE ph WHEN 'B' THEN 1 ELSE -1 END AS dd FROM ev WHERE ph <> 'X'",
    "s": "SELECT *, sum(dd) OVER (PARTITION BY pid, tid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM o",
    "q": "SELECT *, s - least(0, min(s) OVER (PARTITION BY pid, tid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS after FROM s",
    "l": "SELECT *, CASE ph WHEN 'B' THEN after ELSE after + 1 END AS level FROM q",
    "z": "SELECT name, ph, ts, lead(ph) OVER w AS ep, lead(ts) OVER w AS et FROM l WINDOW w AS (PARTITION BY pid, tid, level ORDER BY ts, seq)",
    "du": "SELECT name, CAST(dur AS DOUBLE) AS us FROM ev WHERE ph = 'X' UNION ALL SELECT name, CAST(et - ts AS DOUBLE) FROM z WHERE ph = 'B' AND ep = 'E'",
}


@query("SELECT name, count(*) AS n, min(us / 1000) AS min_ms, max(us / 1000) AS max_ms, round(avg(us / 1000), 4) AS mean_ms FROM du GROUP BY name", graph=False, **_TIME)
def trace_timing(spark, d):
    return traces.timing(trace(spark, d)).withColumn("mean_ms", F.round("mean_ms", 4))


@query("SELECT path, count(*) AS n FROM (SELECT unnest([" + ", ".join("CASE WHEN n%d IS NOT NULL THEN concat_ws(' > ', name, %s) END" % (k, ", ".join(f"n{i}" for i in range(1, k + 1))) for k in range(1, 7)) + "]) AS path FROM r) WHERE path IS NOT NULL GROUP BY path ORDER BY n DESC, path LIMIT 10", graph=False, ev=_EV, r="SELECT name, " + ", ".join(f"lead(name, {k}) OVER w AS n{k}" for k in range(1, 7)) + " FROM (SELECT *, CASE ph WHEN 'B' THEN 0 ELSE 1 END AS o FROM ev WHERE ph <> 'E') WINDOW w AS (PARTITION BY pid, tid ORDER BY ts, o, seq)")
def hot_paths(spark, d):
    return traces.hot_paths(trace(spark, d))


@query("SELECT pid, tid, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY pid, tid ORDER BY ts, seq) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY pid, tid ORDER BY ts, seq) <= 3600000000 THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY pid, tid, session", graph=False, ev=_EV)
def trace_sessions(spark, d):
    return traces.sessions(trace(spark, d), 3_600_000_000)


@query("SELECT id, count(*) AS lines, CAST(count(*) FILTER (WHERE hits > 0) AS BIGINT) AS covered, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE hits > 0) / CAST(count(*) AS DOUBLE) AS rate FROM n JOIN c ON c.file = n.path AND line BETWEEN a AND z GROUP BY id", graph=False, n="SELECT p_partkey AS id, p_brand AS path, p_size AS a, p_size + 5 AS z FROM part", c="SELECT p_brand AS file, l_linenumber + (l_orderkey % 50) AS line, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def coverage_spans(spark, d):
    t = tables(spark, d)
    n = t["part"].select(F.col("p_partkey").alias("id"), F.concat(F.lit("./"), "p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))
    c = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("file"), (F.col("l_linenumber") + F.col("l_orderkey") % 50).alias("line")).agg(F.sum(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("hits"))
    return traces.covered_spans(n, c)


# --- state spaces: event types as states, written and read by users' parities ---

_ST = {"st": "SELECT DISTINCT event_type AS s FROM events", "ob": "SELECT DISTINCT 'o_' || event_type AS o FROM events UNION SELECT 'o_any'", "ac": "SELECT DISTINCT 'a' || (user_id % 5) AS a FROM events", "di": "SELECT DISTINCT 'o_' || event_type AS o, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'click' END AS s FROM events", "wr": "SELECT 'a' || (user_id % 5) AS a, event_type AS s FROM events WHERE user_id % 5 < 3 AND length(event_type) % 3 = user_id % 3 GROUP BY ALL"}


def _space(spark, d):
    e = tables(spark, d)["events"]
    return (
        e.select(F.col("event_type").alias("s")).distinct(), e.select(F.concat(F.lit("o_"), "event_type").alias("o")).union(spark.sql("SELECT 'o_any' AS o")).distinct(), e.select(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("a")).distinct(),
        e.select(F.concat(F.lit("o_"), "event_type").alias("o"), F.expr("CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'click' END").alias("s")).distinct(),
        e.filter("user_id % 5 < 3 AND length(event_type) % 3 = user_id % 3").select(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("a"), F.col("event_type").alias("s")).distinct(),
    )


@query("SELECT o, s, round(p / sum(p) OVER (PARTITION BY s), 9) AS p FROM x", graph=False, **_ST, x="SELECT ob.o, st.s, CASE WHEN k IS NULL OR k = n THEN 1.0 / n WHEN di.o IS NOT NULL THEN 0.9 / k ELSE 0.1 / (n - k) END AS p FROM ob CROSS JOIN st CROSS JOIN (SELECT count(*) AS n FROM st) LEFT JOIN (SELECT o, count(*) AS k FROM di GROUP BY o) kk ON kk.o = ob.o LEFT JOIN di ON di.o = ob.o AND di.s = st.s")
def matrix_a(spark, d):
    s, o, _, direct, _ = _space(spark, d)
    return statespace.matrix_a(o, s, direct).withColumn("p", F.round("p", 9))


@query("SELECT s_next, s, a, round(p / sum(p) OVER (PARTITION BY s, a), 9) AS p FROM x", graph=False, **_ST, k="SELECT a, count(*) AS k FROM wr GROUP BY a", x="SELECT st.s AS s_next, st.s, ac.a, CASE WHEN k IS NULL THEN 1.0 ELSE 0.1 END AS p FROM ac CROSS JOIN st LEFT JOIN k ON k.a = ac.a LEFT JOIN wr ON wr.a = ac.a AND wr.s = st.s WHERE k IS NULL OR wr.a IS NULL UNION ALL SELECT wr.s, st.s, wr.a, 0.9 / k FROM wr JOIN k USING (a) CROSS JOIN st")
def matrix_b(spark, d):
    s, _, a, _, written = _space(spark, d)
    return statespace.matrix_b(s, a, written).withColumn("p", F.round("p", 9))


@query("SELECT o, CAST(coalesce(sum(CASE WHEN kind = 'preference' AND label LIKE 'avoid%' THEN -c ELSE c END), 0) AS DOUBLE) AS v FROM ob LEFT JOIN (SELECT 'o_' || event_type AS o, CASE WHEN user_id % 2 = 0 THEN 'preference' ELSE 'constraint' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'avoid it' ELSE 'seek it' END AS label, CAST(0.5 AS DOUBLE) AS c FROM events) USING (o) GROUP BY o", graph=False, ob=_ST["ob"])
def vector_c(spark, d):
    e = tables(spark, d)["events"]
    c = e.select(F.concat(F.lit("o_"), "event_type").alias("o"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'preference' ELSE 'constraint' END").alias("kind"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'avoid it' ELSE 'seek it' END").alias("label"), F.lit(0.5).alias("confidence"))
    return statespace.vector_c(_space(spark, d)[1], c)


@query("SELECT event_type AS s, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)", graph=False)
def vector_d(spark, d):
    return statespace.vector_d(tables(spark, d)["events"].groupBy(F.col("event_type").alias("s")).agg(F.count(F.lit(1)).alias("weight")))


@query("SELECT s, s_next, count(*) AS n FROM (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s_next FROM events) WHERE s_next IS NOT NULL GROUP BY s, s_next", graph=False)
def transition_counts(spark, d):
    e = tables(spark, d)["events"]
    return statespace.transition_counts(e.select(F.col("user_id").alias("who"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


_VEC = {"v": "SELECT l_returnflag AS f, count(*) FILTER (WHERE l_linestatus = 'F') + 1 AS a, count(*) FILTER (WHERE l_linestatus = 'O') + 2 AS b, count(*) FILTER (WHERE l_quantity < 10) + 1 AS c FROM lineitem GROUP BY l_returnflag", "u": "SELECT f, a / CAST(a + b + c AS DOUBLE) AS x, b / CAST(a + b + c AS DOUBLE) AS y, c / CAST(a + b + c AS DOUBLE) AS z FROM v"}


def _vectors(spark, d):
    v = tables(spark, d)["lineitem"].groupBy(F.col("l_returnflag").alias("f")).agg((F.count_if(F.col("l_linestatus") == "F") + 1).alias("a"), (F.count_if(F.col("l_linestatus") == "O") + 2).alias("b"), (F.count_if(F.col("l_quantity") < 10) + 1).alias("c"))
    t = F.col("a") + F.col("b") + F.col("c")
    third = F.lit(1.0) / 3
    return v.select("f", F.array(F.col("a") / t, F.col("b") / t, F.col("c") / t).alias("p"), F.array(third, third, third).alias("q"), F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1)).alias("l"))


@query("SELECT f, round(-(x * ln(x) + y * ln(y) + z * ln(z)), 9) AS entropy, round(x * ln(3 * x) + y * ln(3 * y) + z * ln(3 * z), 9) AS kl, round(0.7 * x / (0.7 * x + 0.2 * y + 0.1 * z), 9) AS posterior, round(x * ln(3 * x) + y * ln(3 * y) + z * ln(3 * z) - (x * ln(0.7) + y * ln(0.2) + z * ln(0.1)), 9) AS vfe FROM u", graph=False, **_VEC)
def probability_scalars(spark, d):
    return _vectors(spark, d).select("f", F.round(statespace.entropy("p"), 9).alias("entropy"), F.round(statespace.kl("p", "q"), 9).alias("kl"), F.round(F.get(statespace.bayes("p", "l"), F.lit(0)), 9).alias("posterior"), F.round(statespace.free_energy("p", "q", "l"), 9).alias("vfe"))


@query()
def agent_episodes(spark, d):
    """An agent for each user, over the model of the user's own steps from one event type to the next."""
    e = tables(spark, d)["events"]
    states = sorted(r[0] for r in e.select("event_type").distinct().collect())  # dimensions of a model
    steps = successions(e, "user_id", "event_type").withColumnRenamed("key", "agent")
    return inference.run_models(statespace.models_of_steps(steps, states), steps=8)


# --- processes and validation ---


@query()
def process_stages(spark, d):
    g = whole(spark, d)
    return process.stages(g.nodes.filter("kind <> 'event'"), g.edges)


@query("SELECT id, policy FROM (SELECT p.id, unnest(list_filter([CASE WHEN regexp_matches(lower(name), 'backoff|reattempt|retries|retry') OR (coalesce(th, false) AND coalesce(ca, false)) THEN 'retry' END, CASE WHEN regexp_matches(lower(name), 'branch|case_|choose|decision|dispatch|if_|predicate|route|router|select|switch|when_') OR coalesce(tg, 0) >= 2 THEN 'branching' END, CASE WHEN regexp_matches(lower(name), 'breaker|circuit|fuse|half_open|open_circuit|tripped') THEN 'circuit_breaker' END], lambda x: x IS NOT NULL)) AS policy FROM nodes p LEFT JOIN (SELECT source_id AS id, bool_or(kind = 'throws') AS th, bool_or(kind = 'catches') AS ca, count(DISTINCT target_id) FILTER (WHERE kind IN ('calls', 'triggers')) AS tg FROM edges GROUP BY source_id) e ON e.id = p.id WHERE p.kind IN ('function', 'method'))")
def resilience_policies(spark, d):
    g = whole(spark, d)
    return process.policies(g.nodes, g.edges)


_LINKS = {"x": "SELECT a.path AS source_stage, b.path AS target_stage, CASE edges.kind WHEN 'calls' THEN 'call' WHEN 'async_calls' THEN 'async_call' WHEN 'triggers' THEN 'event' WHEN 'writes' THEN 'data' WHEN 'reads' THEN 'data' END AS trigger FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.path <> b.path", "k": "SELECT source_stage, target_stage, trigger, count(*) AS n FROM x WHERE trigger IS NOT NULL GROUP BY ALL"}


def _links(spark, d):
    g = whole(spark, d)
    return process.connections(g.nodes.select("id", F.col("path").alias("stage")), g.edges)


@query("SELECT * FROM k", **_LINKS)
def process_connections(spark, d):
    return _links(spark, d)


@query("SELECT stage, unnest(list_filter([CASE WHEN o > 1 THEN 'fan_out' END, CASE WHEN i > 1 THEN 'fan_in' END, CASE WHEN o = 1 AND i = 1 THEN 'sequential' END, CASE WHEN i = 0 THEN 'entry' END, CASE WHEN o = 0 THEN 'exit' END], lambda x: x IS NOT NULL)) AS pattern FROM (SELECT stage, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM (SELECT source_stage AS stage, count(DISTINCT target_stage) AS o FROM k GROUP BY 1) FULL JOIN (SELECT target_stage AS stage, count(DISTINCT source_stage) AS i FROM k GROUP BY 1) USING (stage))", **_LINKS)
def process_patterns(spark, d):
    return process.patterns(_links(spark, d))


@query(
    "SELECT issue, severity, count(*) AS n FROM (SELECT 'missing_name' AS issue, 'error' AS severity FROM n WHERE coalesce(name, '') = '' UNION ALL SELECT 'missing_qualified_name', 'warning' FROM n WHERE coalesce(qualified_name, '') = '' UNION ALL SELECT 'dangling_source', 'error' FROM e WHERE source_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'dangling_target', 'error' FROM e WHERE target_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'negative_weight', 'error' FROM e WHERE weight < 0 UNION ALL SELECT 'duplicate_id', 'error' FROM (SELECT id FROM n GROUP BY id HAVING count(*) > 1)) GROUP BY issue, severity",
    n="SELECT id, CASE WHEN kind = 'module' THEN '' ELSE name END AS name, CASE WHEN kind = 'class' THEN NULL ELSE qualified_name END AS qualified_name FROM nodes WHERE kind <> 'event' UNION ALL SELECT id, name, qualified_name FROM nodes WHERE kind = 'method'", e="SELECT source_id, target_id, CASE WHEN kind = 'throws' THEN -weight ELSE weight END AS weight FROM edges",
)
def graph_validation(spark, d):
    g = whole(spark, d)
    n = g.nodes.filter("kind <> 'event'").withColumns({"name": F.expr("CASE WHEN kind = 'module' THEN '' ELSE name END"), "qualified_name": F.expr("CASE WHEN kind = 'class' THEN NULL ELSE qualified_name END")}).union(g.nodes.filter("kind = 'method'"))
    e = g.edges.withColumn("weight", F.expr("CASE WHEN kind = 'throws' THEN -weight ELSE weight END"))
    return validate.graph_issues(PropertyGraph(n, e)).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT f, round(1 / 3.0, 9) AS uniform, round(x * ln(0.7) + y * ln(0.2) + z * ln(0.1), 9) AS accuracy, round(-(x * ln(0.7) + y * ln(0.2) + z * ln(0.1)), 9) AS surprisal, round(ln(y), 9) AS log_probability FROM u", graph=False, **_VEC)
def likelihood_scalars(spark, d):
    rounded = lambda c, name: F.round(c, 9).alias(name)
    return _vectors(spark, d).select("f", rounded(F.get(statespace.uniform(3), F.lit(0)), "uniform"), rounded(statespace.accuracy("p", "l"), "accuracy"), rounded(statespace.surprisal("p", "l"), "surprisal"), rounded(statespace.log_probability("p", 1), "log_probability"))


@query("SELECT count(*) AS events, count(DISTINCT event_type) AS functions, count(DISTINCT user_id) AS threads, count(DISTINCT props) AS categories FROM events", graph=False)
def trace_summary(spark, d):
    e = tables(spark, d)["events"]
    return traces.summary(e.select(F.col("event_type").alias("name"), F.col("user_id").alias("tid"), F.col("props").alias("cat")))
