"""Property graphs as two DataFrames: identity, selection, degrees, set operations and measures.

Nodes: id, kind, name, qualified_name, path, language and any further columns (``role``; ``metadata``). Edges: id, source_id, target_id,
kind, weight and any further columns. An edge's identity is (source_id, target_id, kind).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import drop, stored

NODE_KINDS = ["repo", "module", "file", "class", "function", "method", "variable", "endpoint", "event", "parameter", "return_value", "data_structure", "configuration", "feature_flag", "test", "assertion", "policy", "action"]
EDGE_KINDS = ["contains", "imports", "inherits", "implements", "depends_on", "reads", "writes", "returns", "calls", "async_calls", "throws", "catches", "yields", "observes", "mutates", "guards", "triggers", "evidence_from_static", "evidence_from_dynamic"]


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame


def node_id(*parts: tuple[str, str | Column]) -> Column:
    """16 hex digits of the SHA-256 of ``length:part;`` for each label and value (a null value counts as empty)."""
    texts = [x for label, value in parts for x in (F.lit(label), F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit("")))]
    return F.substring(F.sha2(F.concat(*[F.concat(F.char_length(x).cast("string"), F.lit(":"), x, F.lit(";")) for x in texts]), 256), 1, 16)


def edge_id(source: str = "source_id", target: str = "target_id", kind: str = "kind") -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, target, kind), 256), 1, 16)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def upsert_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends exist, once for each identity: weight is the greatest, evidence the union."""
    ids = nodes.select(F.col("id").alias("n"))
    ok = edges.join(ids, F.col("source_id") == F.col("n"), "left_semi").join(ids, F.col("target_id") == F.col("n"), "left_semi")
    agg = [F.max("weight").alias("weight")]
    if "evidence_sources" in edges.columns:
        agg.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_sources")))).alias("evidence_sources"))
    return ok.groupBy("source_id", "target_id", "kind").agg(*agg).withColumn("id", edge_id())


def filter_nodes(nodes: DataFrame, *, kind: str | None = None, language: str | None = None, name_pattern: str | None = None, role: str | None = None, metadata: dict | None = None) -> DataFrame:
    """All given conditions; the name is matched as a substring without regard to case."""
    out = nodes
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if language is not None:
        out = out.filter(F.col("language") == language)
    if name_pattern:
        out = out.filter(F.contains(F.lower("name"), F.lit(name_pattern.lower())))
    if role is not None:
        out = out.filter(F.col("role") == role)
    for k, v in (metadata or {}).items():
        out = out.filter(F.col("metadata")[k].eqNullSafe(F.lit(v)))
    return out


def filter_edges(edges: DataFrame, *, kind: str | None = None, source_id: str | None = None, target_id: str | None = None, min_weight: float = 0.0) -> DataFrame:
    out = edges
    for c, v in (("kind", kind), ("source_id", source_id), ("target_id", target_id)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    return out.filter(F.col("weight") >= min_weight) if min_weight > 0 else out


def induced(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes in ``ids`` (id) and the edges between them."""
    ids = ids.select(F.col("id").alias("__n")).distinct()
    edges = graph.edges.join(ids, F.col("source_id") == F.col("__n"), "left_semi").join(ids, F.col("target_id") == F.col("__n"), "left_semi")
    return PropertyGraph(graph.nodes.join(ids, F.col("id") == F.col("__n"), "left_semi"), edges)


def kind_subgraph(graph: PropertyGraph, kinds: list[str]) -> PropertyGraph:
    return induced(graph, graph.nodes.filter(F.col("kind").isin(kinds)))


def edge_kind_subgraph(graph: PropertyGraph, kind: str) -> PropertyGraph:
    """Edges of one kind and their ends; an unknown kind gives an empty graph."""
    edges = graph.edges.filter((F.col("kind") == kind) & F.lit(kind in EDGE_KINDS))
    ends = edges.select(F.col("source_id").alias("__n")).union(edges.select("target_id")).distinct()
    return PropertyGraph(graph.nodes.join(ends, F.col("id") == F.col("__n"), "left_semi"), edges)


def remove_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes in ``ids`` and the edges at them."""
    gone = ids.select(F.col("id").alias("__n")).distinct()
    edges = graph.edges.join(gone, F.col("source_id") == F.col("__n"), "left_anti").join(gone, F.col("target_id") == F.col("__n"), "left_anti")
    return PropertyGraph(graph.nodes.join(gone, F.col("id") == F.col("__n"), "left_anti"), edges)


def remove_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the edges in ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("__e")).distinct(), F.col("id") == F.col("__e"), "left_anti")


def weighted_adjacency(edges: DataFrame, order: list[str]) -> DataFrame:
    """source_id, target_id, weight: the whole part of the weight of the last parallel edge by ``order``."""
    return edges.groupBy("source_id", "target_id").agg(F.max_by(F.col("weight").cast("long"), F.struct(*order)).alias("weight"))


def child_names(graph: PropertyGraph, kind: str, child_kind: str) -> DataFrame:
    """id, cardinality, names (sorted): what each node of one kind contains of another; 0 and none for a node without."""
    children = graph.nodes.filter(F.col("kind") == child_kind).select(F.col("id").alias("target_id"), F.col("name").alias("child"))
    held = graph.edges.filter("kind = 'contains'").select("source_id", "target_id").distinct().join(children, "target_id")
    found = held.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("child")).alias("found"))
    both = graph.nodes.filter(F.col("kind") == kind).select("id").join(found, "id", "left")
    return both.select("id", F.coalesce("k", F.lit(0)).alias("cardinality"), F.coalesce("found", F.array().cast("array<string>")).alias("names"))


def top_nodes(nodes: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """id, degree of the k given nodes of greatest degree (ties: the smaller id first)."""
    return nodes.select("id").join(degrees.select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(k)


def adjacency(edges: DataFrame) -> DataFrame:
    """u, v: neighbours in either direction, once; a self-loop makes a node its own neighbour."""
    end = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    return edges.select(F.explode(F.array(end("source_id", "target_id"), end("target_id", "source_id"))).alias("pair")).select("pair.*").distinct()


def neighbours(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """id (of the given nodes), neighbour."""
    return adjacency(graph.edges).join(ids.select(F.col("id").alias("u")), "u").select(F.col("u").alias("id"), F.col("v").alias("neighbour"))


def degrees(graph: PropertyGraph) -> DataFrame:
    """id, in_degree, out_degree, degree, centrality of every node; parallel edges count, a self-loop counts twice."""
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = graph.edges.select(F.explode(F.array(end("source_id", 0, 1), end("target_id", 1, 0))).alias("end")).select("end.*")
    count = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    both = graph.nodes.select("id").join(count, "id", "left").crossJoin(F.broadcast(n))  # one row
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return both.select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"), F.when(F.col("n") > 1, (i + o) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def edge_profile(edges: DataFrame) -> DataFrame:
    """id and the number of outgoing edges of each kind (columns ``out_<kind>``), computed once for all rules."""
    return edges.groupBy(F.col("source_id").alias("id")).agg(*[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"out_{k}") for k in EDGE_KINDS])


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """what ('node' or 'edge'), kind, count; kind null for totals."""
    part = lambda df, what: df.rollup("kind").agg(F.count(F.lit(1)).alias("count")).select(F.lit(what).alias("what"), "kind", "count")
    return part(graph.nodes, "node").union(part(graph.edges, "edge"))


def density(graph: PropertyGraph) -> DataFrame:
    """One row: n_nodes, n_edges, density over ordered pairs, complexity (with density over unordered pairs, and size)."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.crossJoin(m).select(
        "n_nodes", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0).alias("density"),
        F.when(F.col("n_nodes") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.6 * F.when(pairs > 0, F.col("n_edges") / (pairs / 2)).otherwise(0.0) + 0.4 * F.least(F.lit(1.0), F.log2(F.col("n_nodes") + 1) / F.log2(F.lit(1000.0))))).alias("complexity"),
    )


#: Open pairs of neighbours that one step of ``clustering`` may send; more are met slice by slice, each of which leaves counts only.
WEDGES = 100_000_000


def clustering(edges: DataFrame, *, wedges: int = WEDGES) -> DataFrame:
    """id, neighbours, links, coefficient of each node with two neighbours or more (undirected).

    Each edge between neighbours is met once, as a pair of the node's adjacency that is an edge itself. Nodes go by numbers there, and the pairs by slices of nodes.
    """
    adj = stored(adjacency(edges).filter("u <> v"), "adjacency")
    k = stored(adj.groupBy("u").agg(F.count(F.lit(1)).alias("neighbours")).withColumn("m", F.monotonically_increasing_id()), "degrees")
    # orient edges towards the larger degree, so that hubs don't pair up all their neighbours
    one, two = k.toDF("u", "ku", "a"), k.toDF("v", "kv", "b")
    rank = adj.filter("u < v").join(one, "u").join(two, "v").withColumn("first", F.expr("ku < kv OR (ku = kv AND u < v)"))
    up = stored(rank.select(F.expr("IF(first, a, b)").alias("u"), F.expr("IF(first, b, a)").alias("v")), "oriented-edges")
    drop(adj)
    n = up.groupBy("u").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(F.expr("CAST(d AS DECIMAL(19, 0)) * (d - 1) / 2"))).first()[0]
    slices = max(1, -(-int(n or 0) // wedges))
    ends = up.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    # Dealt to all tasks: the edges themselves are few bytes, the pairs that they make are not.
    parts, counts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), []
    for i in range(slices):
        part = (up if slices == 1 else up.filter(F.pmod(F.xxhash64("u"), F.lit(slices)) == i)).repartition(parts, "u")
        closed = part.withColumnRenamed("v", "x").join(part.withColumnRenamed("v", "y"), "u").filter("x < y").join(ends, ["x", "y"])
        counts.append(stored(closed.select(F.explode(F.array("u", "x", "y")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("links")), "links"))
    links = reduce(DataFrame.union, counts).groupBy("m").agg(F.sum("links").alias("links"))
    out = k.filter("neighbours >= 2").join(links, "m", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return out.select(F.col("u").alias("id"), "neighbours", "links", (F.col("links") / (F.col("neighbours") * (F.col("neighbours") - 1) / 2)).alias("coefficient"))


def merged_nodes(static: PropertyGraph, dynamic: PropertyGraph) -> DataFrame:
    """Nodes of both graphs, those of ``static`` first by id."""
    return static.nodes.unionByName(dynamic.nodes.join(static.nodes.select("id"), "id", "left_anti").select(static.nodes.columns))


def merged_edges(static: PropertyGraph, dynamic: PropertyGraph, nodes: DataFrame, *, strategy: str = "union", tolerance: float = 0.1) -> DataFrame:
    """source_id, target_id, kind, ws, wd (the weight in either graph or null), weight and conflict of the edges of both graphs between ``nodes``."""
    key = ["source_id", "target_id", "kind"]
    a = static.edges.select(*key, F.col("weight").alias("ws"))
    b = dynamic.edges.select(*key, F.col("weight").alias("wd"))
    both = a.join(b, key, "full").withColumn("conflict", F.coalesce(F.abs(F.col("ws") - F.col("wd")) > tolerance, F.lit(False)))
    greater = F.greatest("ws", "wd")
    chosen = {"union": greater, "static_priority": F.col("ws"), "dynamic_priority": F.col("wd")}[strategy]
    edges = both.withColumn("weight", F.when(F.col("conflict"), chosen).otherwise(greater))
    ids = nodes.select(F.col("id").alias("__n"))
    return edges.join(ids, F.col("source_id") == F.col("__n"), "left_semi").join(ids, F.col("target_id") == F.col("__n"), "left_semi")


def merge(static: PropertyGraph, dynamic: PropertyGraph, *, strategy: str = "union", tolerance: float = 0.1) -> tuple[PropertyGraph, DataFrame]:
    """Both graphs, nodes of ``static`` first by id, and the conflicts: edges whose weights differ by more than ``tolerance``.

    A conflicting edge gets the greater weight (union), the static (static_priority) or the dynamic one (dynamic_priority), any other the greater. Edges without their ends are dropped.
    """
    nodes = merged_nodes(static, dynamic)
    edges = merged_edges(static, dynamic, nodes, strategy=strategy, tolerance=tolerance)
    key = ["source_id", "target_id", "kind"]
    return PropertyGraph(nodes, edges.select(edge_id().alias("id"), *key, "weight")), edges.filter("conflict").select(*key, "ws", "wd", "weight")


def incremental_merge(base: PropertyGraph, delta: PropertyGraph) -> PropertyGraph:
    """``base`` with the changes of ``delta``: new nodes and edges are added, known nodes keep their columns and take over entries of ``metadata`` (a map, if there is one),
    known edges get the greater weight and the evidence of both (``evidence_sources``, if there are any). Edges without their ends are dropped.
    """
    nodes = merged_nodes(base, delta)
    if "metadata" in nodes.columns:
        newer = delta.nodes.select("id", F.col("metadata").alias("__new"))
        kept = F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
        columns = nodes.columns
        nodes = nodes.join(newer, "id", "left").withColumn("metadata", F.when(F.col("__new").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("__new")).otherwise(F.map_concat(kept, "__new"))).select(columns)
    edges = merged_edges(base, delta, nodes)
    key = ["source_id", "target_id", "kind"]
    more = []
    if "evidence_sources" in base.edges.columns:
        more = ["evidence_sources"]
        both = base.edges.select(*key, "evidence_sources").unionByName(delta.edges.select(*key, "evidence_sources"))
        edges = edges.join(both.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_sources")))).alias("evidence_sources")), key)
    return PropertyGraph(nodes, edges.select(edge_id().alias("id"), *key, "weight", *more))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module, target: the known module of the longest dotted prefix of each imported name, other than the importing one.

    ``imports``: path, module (the name), importer (the name of the importing module, may be null); ``modules``: name. Names without a known prefix are left out.
    """
    parts = F.split("module", r"\.")
    tried = imports.select("path", "module", "importer", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("name", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "."))
    known = modules.select("name").distinct()
    found = tried.filter(~F.col("name").eqNullSafe(F.col("importer"))).join(known, "name")
    return found.groupBy("path", "module").agg(F.max_by("name", "n").alias("target"))


def merge_all(graphs: list[PropertyGraph]) -> PropertyGraph:
    if not graphs:
        raise ValueError("no graphs to merge")
    return reduce(lambda a, b: merge(a, b)[0], graphs)


def diff(old: PropertyGraph, new: PropertyGraph, *, compared: tuple[str, ...] = ("name", "qualified_name", "path")) -> DataFrame:
    """what, change, key: nodes added, removed or changed in a compared column, and edges added or removed by identity."""
    fields = lambda df, alias: df.select("id", F.struct(*compared).alias(alias))
    both = fields(old.nodes, "a").withColumn("ina", F.lit(True)).join(fields(new.nodes, "b").withColumn("inb", F.lit(True)), "id", "full")
    change = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    nodes = both.select(F.lit("node").alias("what"), change.alias("change"), F.col("id").alias("key")).filter("change IS NOT NULL")
    keyed = lambda g, c: g.edges.select(F.concat_ws("|", "source_id", "target_id", "kind").alias("key")).distinct().withColumn(c, F.lit(True))
    edges = keyed(old, "ina").join(keyed(new, "inb"), "key", "full").filter("ina IS NULL OR inb IS NULL")
    return nodes.union(edges.select(F.lit("edge"), F.when(F.col("ina").isNull(), "added").otherwise("removed"), "key"))


def module_edges(graph: PropertyGraph) -> DataFrame:
    """Edges with the path of each end (an edge without a known end is left out)."""
    at = graph.nodes.select(F.col("id"), F.coalesce("path", F.lit("unknown")).alias("p"))
    return graph.edges.join(at.select(F.col("id").alias("source_id"), F.col("p").alias("source_path")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("p").alias("target_path")), "target_id")


def coupling_and_cohesion(graph: PropertyGraph) -> DataFrame:
    """One row: coupling (share of edges between modules, 0 with one module) and cohesion (share within)."""
    e = module_edges(graph)
    modules = graph.nodes.agg(F.count_distinct(F.coalesce("path", F.lit("unknown"))).alias("modules"))
    share = e.agg(F.avg(F.when(F.col("source_path") != F.col("target_path"), 1.0).otherwise(0.0)).alias("across"))
    return share.crossJoin(modules).select("modules", F.when(F.col("modules") <= 1, 0.0).otherwise(F.coalesce("across", F.lit(0.0))).alias("coupling"), F.coalesce(1 - F.col("across"), F.lit(0.0)).alias("cohesion"))


def hotspots(graph: PropertyGraph, top: int = 10) -> DataFrame:
    """what (degree, sink, source), id, degree: the nodes of greatest degree, and those without outgoing or incoming edges."""
    d = stored(degrees(graph), "degrees")
    most = d.orderBy(F.desc("degree"), "id").limit(top).select(F.lit("degree").alias("what"), "id", "degree")
    return most.union(d.filter("out_degree = 0").select(F.lit("sink"), "id", "degree")).union(d.filter("in_degree = 0").select(F.lit("source"), "id", "degree"))


def module_metrics(imports: DataFrame, classes: DataFrame) -> DataFrame:
    """module, ca, ce, instability, abstractness, distance, zone.

    ``imports``: source, target; ``classes``: module, n_abstract, n_concrete. Zones by distance over 0.3: pain at instability over 0.8, uselessness under 0.2.
    """
    e = imports.select("source", "target").filter("source <> target").distinct()
    out = e.groupBy(F.col("source").alias("module")).agg(F.count_distinct("target").alias("ce"))
    into = e.groupBy(F.col("target").alias("module")).agg(F.count_distinct("source").alias("ca"))
    both = out.join(into, "module", "full").join(classes, "module", "left").na.fill(0)
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    a = F.when(F.col("n_abstract") + F.col("n_concrete") > 0, F.col("n_abstract") / (F.col("n_abstract") + F.col("n_concrete"))).otherwise(0.0)
    both = both.withColumn("instability", i).withColumn("abstractness", a).withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    zone = F.when((F.col("distance") > 0.3) & (F.col("instability") > 0.8), "pain").when((F.col("distance") > 0.3) & (F.col("instability") < 0.2), "uselessness")
    return both.select("module", "ca", "ce", "instability", "abstractness", "distance", zone.alias("zone"))
