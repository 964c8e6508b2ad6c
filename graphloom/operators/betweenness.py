"""Betweenness by Brandes' accumulation in joins: path counts forward by level, dependencies backward, from all or from seeded sources.

Each level's front is a part of one stored table, so no step writes again what was found before. Rows are sources times reached nodes: for a large graph take ``sample`` sources, of which
the scores are unbiased estimates. A source's dependency on a node lies between 0 and n - 2, so by Hoeffding's bound all normalised scores are, with a chance of at least
1 - d, within ``error_bound(n, sample, d)`` of the exact ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

SEED = 0


def error_bound(n: int, sample: int, chance: float = 0.05) -> float:
    return math.sqrt(math.log(2 * max(n, 1) / chance) / (2 * max(sample, 1)))


def sampled_nodes(nodes: DataFrame, sample: int, seed: int = SEED) -> DataFrame:
    """``sample`` nodes in the order of a seeded hash."""
    return nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)


def path_counts(edges: DataFrame, sources: DataFrame, *, directed: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """Levels of source, id, paths (shortest paths from the source; level 0 is the source itself), and the steps (u, v) taken."""
    e = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    e = e if directed else e.union(e.select("v", "u"))
    e = stored(e.filter("u <> v").distinct(), "steps")
    fronts = [stored(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")), "front")]
    while True:
        seen = reduce(DataFrame.union, [f.select("source", "id") for f in fronts])
        near = fronts[-1].join(e, F.col("id") == F.col("u")).groupBy("source", F.col("v").alias("id")).agg(F.sum("paths").alias("paths"))
        front = stored(near.join(seen, ["source", "id"], "left_anti"), "front")
        if front.isEmpty():
            return fronts, e
        fronts.append(front)


def dependencies(fronts: list[DataFrame], steps: DataFrame) -> DataFrame:
    """source, id, dependency of all nodes on some shortest path from the source, its ends left out."""
    below, parts = None, []
    for front in reversed(fronts[1:]):
        if below is None:
            now = front.withColumn("dependency", F.lit(0.0))
        else:
            share = below.select("source", F.col("id").alias("v"), ((1 + F.col("dependency")) / F.col("paths")).alias("share"))
            given = share.join(steps, "v").groupBy("source", F.col("u").alias("id")).agg(F.sum("share").alias("share"))
            now = front.join(given, ["source", "id"], "left").select("source", "id", "paths", F.coalesce(F.col("paths") * F.col("share"), F.lit(0.0)).alias("dependency"))
        below = stored(now, "dependencies")
        parts.append(below.filter("dependency > 0").select("source", "id", "dependency"))
    return reduce(DataFrame.union, parts) if parts else fronts[0].select("source", "id", F.lit(0.0).alias("dependency")).limit(0)


def betweenness(nodes: DataFrame, edges: DataFrame, *, sample: int | None = None, seed: int = SEED, directed: bool = True) -> DataFrame:
    """id, score of every node: shares of shortest paths through it over all ordered pairs of others, (n - 1)(n - 2) of them; estimated from ``sample`` sources if given."""
    n = nodes.count()
    k = n if sample is None else min(sample, n)
    sources = nodes.select("id") if sample is None else sampled_nodes(nodes, k, seed)
    sums = dependencies(*path_counts(edges, sources, directed=directed)).groupBy("id").agg(F.sum("dependency").alias("d"))
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("score"))
