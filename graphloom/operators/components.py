"""Weakly and strongly connected components, and other iterations over edge tables.

Each step's result is written to the shared folder, so lineage stays short and no node's neighbours meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import drop, stored


#: Words of 64 sources in one row of a search from many.
WORDS = 16
_WORDS = [f"w{i}" for i in range(WORDS)]


def _state(df: DataFrame, *columns: str) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that is reachable without regard to direction) of every node.

    Large-star and small-star steps alternate until the edges point from each component's smallest node to all others.
    """
    ends = edges.select("source_id", "target_id")
    now = stored(ends.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).filter("a < b").distinct(), "wcc")
    state = _state(now, "a", "b")
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        top = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(top, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        now = stored(small, "wcc")
        before, state = state, _state(now, "a", "b")
        if state == before:
            break
    return nodes.select("id").join(now.select(F.col("b").alias("id"), F.col("a").alias("least")), "id", "left").select("id", F.coalesce("least", "id").alias("component"))


def _reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed colours pushed forward: for each node the least ``c`` that reaches it along a -> b edges (same ``g``)."""
    now = stored(seeds, "colour")
    while True:
        pushed = now.join(edges, "id").select(F.col("b").alias("id"), "c")
        new = stored(now.select("id", "c").union(pushed).groupBy("id").agg(F.min("c").alias("c")), "colour")
        if _state(new, "id", "c") == _state(now, "id", "c"):
            return new
        now = new


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id) by forward colouring: nodes whose colour reaches back to its origin are one component."""
    left, done = stored(nodes.select("id"), "scc"), None
    e = stored(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("b")).filter("id <> b").distinct(), "scc")
    while not left.isEmpty():
        # nodes without both an incoming and an outgoing edge among those left are components of their own
        while True:
            inner = left.join(e.select("id").distinct(), "id", "left_semi").join(e.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
            inner = stored(inner, "scc")
            k = stored(e.join(inner, "id", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "b"), "scc")
            single = left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
            done = stored(single if done is None else done.union(single), "scc")
            smaller = inner.count() < left.count()
            left, e = inner, k
            if not smaller:
                break
        if left.isEmpty():
            break
        colour = _reached(left.select("id", F.col("id").alias("c")), e)
        same = e.join(colour, "id").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").filter("c = cb")
        back = _reached(colour.filter("id = c"), same.select(F.col("b").alias("id"), F.col("id").alias("b")))
        found = stored(back.select("id", F.col("c").alias("component")), "scc")
        done = stored(done.union(found), "scc")
        left = stored(left.join(found, "id", "left_anti"), "scc")
        e = stored(e.join(left, "id", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "b"), "scc")
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    least = done.groupBy("component").agg(F.min("id").alias("least"))
    return done.join(least, "component").select("id", F.col("least").alias("component"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the nodes that lie on a directed cycle, self-loops included."""
    scc = strong_components(nodes, edges)
    many = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    loops = edges.filter("source_id = target_id").select(F.col("source_id").alias("id"))
    return scc.join(many, "component", "left_semi").select("id").union(loops).distinct()


def _steps(edges: DataFrame, directed: bool) -> DataFrame:
    e = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return stored((e if directed else e.union(e.select("v", "u"))).filter("u <> v").distinct(), "steps")


def _sets(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, id and words of the sets of sources {id}, and the sources of each block in the order of their bits: sources are dealt to blocks of ``64 * WORDS``."""
    m, bits = F.col("m"), 64 * WORDS
    ids = sources.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("m", F.monotonically_increasing_id())
    ids = stored(ids.select("id", F.floor(m / bits).alias("block"), (m % bits).cast("int").alias("bit")), "sources")
    own = [F.expr(f"IF(bit div 64 = {i}, shiftleft(1L, bit % 64), 0L)").alias(w) for i, w in enumerate(_WORDS)]
    names = ids.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "id"))), lambda x: x["id"]).alias("names"))
    return stored(ids.select("block", "id", *own), "front"), stored(names, "blocks")


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame, *, directed: bool = False, limit: int | None = None) -> DataFrame:
    """source, id, distance (fewest steps, 0 for the source itself) of all nodes that each source reaches.

    A step goes over sets of sources, as bits: an edge carries the whole set of a block, and sets that meet at a node are united before they are sent. Pairs are made only of the result.
    """
    e = _steps(edges, directed)
    front, names = _sets(sources)
    fronts, step = [front], 0
    no = [F.lit(0).cast("long").alias(f"s{w}") for w in _WORDS]
    while not fronts[-1].isEmpty() and (limit is None or step < limit):  # a step adds nodes or is the last
        step += 1
        near = fronts[-1].join(e, F.col("id") == F.col("u")).select("block", F.col("v").alias("id"), *_WORDS, *no)
        # On a graph that is read both ways, what a front leads to lies at most one level back.
        seen = reduce(DataFrame.union, fronts if directed else fronts[-2:])
        both = near.union(seen.select("block", "id", *[F.lit(0).cast("long") for _ in _WORDS], *_WORDS))
        both = both.groupBy("block", "id").agg(*[F.bit_or(w).alias(w) for w in near.columns[2:]])
        new = both.select("block", "id", *[F.expr(f"{w} & ~s{w}").alias(w) for w in _WORDS])
        fronts.append(stored(new.filter(" | ".join(_WORDS) + " <> 0"), "front"))
    levels = reduce(DataFrame.union, [f.select("block", "id", F.array(*_WORDS).alias("words"), F.lit(k).alias("distance")) for k, f in enumerate(fronts)])
    words = levels.join(names, "block").select("names", "id", "distance", F.posexplode("words").alias("place", "word")).filter("word <> 0")
    bits = words.select("names", "id", "distance", "place", "word", F.explode(F.expr("sequence(0, 63)")).alias("bit")).filter("(shiftrightunsigned(word, bit) & 1L) = 1L")
    return bits.select(F.get("names", F.col("place") * 64 + F.col("bit")).alias("source"), "id", "distance")


def neighbourhood_sizes(nodes: DataFrame, edges: DataFrame, *, directed: bool = False, limit: int | None = None, lg_cells: int = 12) -> DataFrame:
    """id, hop, reached: about how many nodes each node reaches in at most ``hop`` steps, itself included, by a HyperLogLog counter a node.

    A hop unites the counters of a node and its neighbours: edges times a counter of fixed size, not pairs of nodes. Counts are exact up to some hundred nodes and within about
    1 / sqrt(2 ** lg_cells) beyond. Ends when a hop changes no count, or after ``limit``.
    """
    e = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("v"))
    e = stored((e if directed else e.union(e.select(F.col("v").alias("id"), F.col("id").alias("v")))).filter("id <> v").distinct(), "steps")
    now = stored(nodes.groupBy("id").agg(F.hll_sketch_agg("id", lg_cells).alias("sketch")).withColumn("reached", F.lit(1).cast("long")), "counters")
    done, hop, total = [stored(now.select("id", F.lit(0).alias("hop"), "reached"), "reached")], 0, None
    while limit is None or hop < limit:
        hop += 1
        both = now.select("id", "sketch").union(e.join(now.select(F.col("id").alias("v"), "sketch"), "v").select("id", "sketch"))
        past, now = now, stored(both.groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("reached", F.hll_sketch_estimate("sketch")), "counters")
        drop(past)  # counters are needed for one step, counts for the result
        before, total = total, now.agg(F.sum("reached")).first()[0]
        if total == before or not total:
            break
        done.append(stored(now.select("id", F.lit(hop).alias("hop"), "reached"), "reached"))
    return reduce(DataFrame.union, done)


def approximate_closeness(nodes: DataFrame, edges: DataFrame, *, directed: bool = False, lg_cells: int = 12) -> DataFrame:
    """id, closeness of every node, from the counts of ``neighbourhood_sizes``: other nodes reached over the sum of their distances (0 if none)."""
    sizes = neighbourhood_sizes(nodes, edges, directed=directed, lg_cells=lg_cells)
    # The sum of distances is the sum over hops of the nodes that lie beyond.
    per = sizes.groupBy("id").agg(F.max("reached").alias("all"), F.sum("reached").alias("sum"), F.count(F.lit(1)).alias("hops"))
    far = F.col("hops") * F.col("all") - F.col("sum")
    return per.select("id", F.when(far > 0, (F.col("all") - 1) / far).otherwise(0.0).alias("closeness"))


def unreachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the nodes that no node without incoming edges reaches: those on cycles that nothing leads into, and what only they lead to."""
    e = stored(edges.select("source_id", "target_id").distinct(), "steps")
    fronts = [stored(nodes.select("id").join(e, F.col("id") == F.col("target_id"), "left_anti"), "entries")]
    while not fronts[-1].isEmpty():  # a step adds nodes or is the last
        near = fronts[-1].join(e, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id")).distinct()
        fronts.append(stored(near.join(reduce(DataFrame.union, fronts), "id", "left_anti"), "front"))
    return nodes.select("id").join(reduce(DataFrame.union, fronts), "id", "left_anti")


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id, closeness of ``sources`` (None: of all nodes, which takes all pairs): reached nodes over the sum of their distances (0 if none is reached)."""
    asked = nodes if sources is None else sources
    d = distances(nodes, edges, asked).filter("distance > 0")
    c = d.groupBy(F.col("source").alias("id")).agg((F.count(F.lit(1)) / F.sum("distance")).alias("closeness"))
    return asked.select("id").join(c, "id", "left").na.fill(0.0, ["closeness"])


def pagerank(nodes: DataFrame, edges: DataFrame, *, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank after a fixed number of steps; parallel edges count each, and nodes without outgoing edges pass nothing on."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    flow = stored(edges.groupBy(F.col("source_id").alias("id"), F.col("target_id").alias("b")).agg(F.count(F.lit(1)).alias("k")).join(out, "id").select("id", "b", (F.col("k") / F.col("out")).alias("share")), "flow")
    ids = stored(nodes.select("id"), "rank-nodes")
    now = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        into = now.join(flow, "id").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        now = ids.join(into, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            now = stored(now, "rank")
    return now


def _tree_levels(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Levels of source, id, place, up: breadth-first trees (undirected) that visit neighbours in the order of their ids, with each node's place among its level's and its parent's place."""
    e = _steps(edges, directed=False)
    root = sources.select(F.col("id").alias("source"), "id", F.lit(1).cast("long").alias("place"), F.lit(None).cast("long").alias("up"))
    levels = [stored(root, "tree")]
    order = Window.partitionBy("source").orderBy("up", "id")
    while not levels[-1].isEmpty():  # a step adds nodes or is the last
        # Of all parents on the last level the one that was reached first has the smallest path. What a level leads to lies at most one level back.
        near = levels[-1].join(e, F.col("id") == F.col("u")).select("source", F.col("v").alias("id"), F.col("place").alias("up"), F.lit(False).alias("seen"))
        seen = reduce(DataFrame.union, levels[-2:]).select("source", "id", F.lit(None).cast("long"), F.lit(True))
        new = near.union(seen).groupBy("source", "id").agg(F.min("up").alias("up"), F.max("seen").alias("seen")).filter("NOT seen")
        levels.append(stored(new.select("source", "id", F.row_number().over(order).cast("long").alias("place"), "up"), "tree"))
    return levels


def bfs_trees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, id, path: the path that a breadth-first search finds which visits neighbours in the order of their ids (undirected)."""
    levels = _tree_levels(edges, sources)
    paths = [stored(levels[0].select("source", "id", "place", F.array("id").alias("path")), "paths")]
    for level in levels[1:]:
        above = paths[-1].select("source", F.col("place").alias("up"), F.col("path").alias("__above"))
        paths.append(stored(level.join(above, ["source", "up"]).select("source", "id", "place", F.concat("__above", F.array("id")).alias("path")), "paths"))
        drop(level)
    return reduce(DataFrame.union, paths).select("source", "id", "path")


def pair_betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id, score: inner visits of one shortest path from each of ``sources`` (None: every node, which takes all pairs) to each other node, over (n - 1)(n - 2) / 2; nodes without visits are left out.

    A node is an inner one of the paths to all that stand below it in a source's tree, so levels are summed from the last one up and no path is written out.
    """
    n = nodes.count()
    below, visits = None, []
    for level in reversed(_tree_levels(edges, (nodes if sources is None else sources).select("id"))[1:]):
        under = F.lit(0).cast("long").alias("under")
        past, below = below, level.select("source", "up", "id", under) if below is None else level.join(below.groupBy("source", F.col("up").alias("place")).agg(F.sum(F.col("under") + 1).alias("k")), ["source", "place"], "left").select("source", "up", "id", F.coalesce("k", F.lit(0)).alias("under"))
        below = stored(below, "below")
        visits.append(stored(below.filter("under > 0").groupBy("id").agg(F.sum("under").alias("k")), "visits"))
        drop(level, *([] if past is None else [past]))
    if not visits:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, visits).groupBy("id").agg((F.sum("k") / max(1.0, (n - 1) * (n - 2) / 2)).alias("score"))


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, max_nodes: int = 5, directed: bool = False) -> DataFrame:
    """source, target, path of all simple paths of at most ``max_nodes`` nodes that end where they first meet their target."""
    e = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    if not directed:
        e = e.union(e.select("v", "u"))
    e = stored(e.filter("u <> v").distinct(), "steps")
    pairs = sources.select(F.col("id").alias("source")).crossJoin(F.broadcast(targets.select(F.col("id").alias("target"))))  # the pairs that were asked for
    open_ = pairs.select("source", "target", F.array("source").alias("path"))
    done = open_.filter("source = target")
    open_ = open_.filter("source <> target")
    for _ in range(max_nodes - 1):
        step = open_.join(e, F.element_at("path", -1) == F.col("u")).filter("NOT array_contains(path, v)").select("source", "target", F.concat("path", F.array("v")).alias("path"))
        done = done.union(step.filter("element_at(path, -1) = target"))
        open_ = step.filter("element_at(path, -1) <> target")
    return done


def simple_cycles(edges: DataFrame, *, max_nodes: int = 10, each_order: bool = False) -> DataFrame:
    """nodes (sorted), path of directed cycles of at most ``max_nodes`` nodes, one for each set of nodes (the smallest path) or, with ``each_order``, every one.

    A cycle is found from its smallest node only, so each is walked once.
    """
    e = stored(edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).distinct(), "steps")
    loops = e.filter("u = v").select(F.array("u").alias("path"))
    e = e.filter("u <> v")
    open_, done = e.filter("u < v").select(F.array("u", "v").alias("path")), loops
    for n in range(2, max_nodes + 1):
        # An edge back to the start meets its path on both ends; other steps are made only if a longer cycle may come of them.
        done = done.union(open_.join(e, (F.element_at("path", -1) == F.col("u")) & (F.get("path", F.lit(0)) == F.col("v"))).select("path"))
        if n == max_nodes:
            break
        step = open_.join(e, F.element_at("path", -1) == F.col("u")).filter("v > path[0] AND NOT array_contains(path, v)")
        open_ = stored(step.select(F.concat("path", F.array("v")).alias("path")), "cycles")
        if open_.isEmpty():
            break
    if each_order:
        return done.select(F.array_sort("path").alias("nodes"), "path")
    return done.select(F.array_sort("path").alias("nodes"), "path").groupBy("nodes").agg(F.min("path").alias("path"))


def diameter(nodes: DataFrame, edges: DataFrame) -> int | None:
    """The greatest undirected distance; None of fewer than two nodes or of an unconnected graph."""
    n = nodes.count()
    if n < 2:
        return None
    row = distances(nodes, edges, nodes).agg(F.count(F.lit(1)).alias("pairs"), F.max("distance").alias("d")).first()
    return row.d if row.pairs == n * n else None
