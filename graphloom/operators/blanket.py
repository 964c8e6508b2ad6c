"""Markov blankets of node sets, and the edges between their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored


def partition(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, role. Of the seeds (id): internal without neighbours outside, active with an edge to the outside, sensory with edges from it only; all others are external."""
    s = seeds.select("id").distinct()
    inside = s.withColumn("inside", F.lit(True))
    e = edges.select("source_id", "target_id").filter("source_id <> target_id")
    e = e.join(inside.select(F.col("id").alias("source_id"), F.col("inside").alias("a")), "source_id", "left").join(inside.select(F.col("id").alias("target_id"), F.col("inside").alias("b")), "target_id", "left")
    cross = e.filter("(a IS NULL) <> (b IS NULL)").select(F.coalesce(F.when(F.col("a"), F.col("source_id")), F.col("target_id")).alias("id"), F.coalesce(F.col("a"), F.lit(False)).alias("out"))
    at = cross.groupBy("id").agg(F.bool_or("out").alias("out"))
    both = nodes.select("id").join(inside, "id", "left").join(at, "id", "left")
    return both.select("id", F.when(F.col("inside").isNull(), "external").when(F.col("out").isNull(), "internal").when(F.col("out"), "active").otherwise("sensory").alias("role"))


def network(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """source_role, target_role, kind, n; kind null for all kinds."""
    r = roles.select("id", "role")
    both = edges.join(r.select(F.col("id").alias("source_id"), F.col("role").alias("source_role")), "source_id").join(r.select(F.col("id").alias("target_id"), F.col("role").alias("target_role")), "target_id")
    return both.groupingSets([["source_role", "target_role", "kind"], ["source_role", "target_role"]], "source_role", "target_role", "kind").agg(F.count(F.lit(1)).alias("n"))


def closure(edges: DataFrame, roots: DataFrame, *, kind: str = "contains") -> DataFrame:
    """root, id: everything that each root (id) contains, itself included."""
    e = edges.filter(F.col("kind") == kind).select(F.col("source_id").alias("id"), F.col("target_id").alias("b")).distinct()
    front = stored(roots.select(F.col("id").alias("root"), "id"), "closure")
    seen = front
    while not front.isEmpty():
        near = front.join(e, "id").select("root", F.col("b").alias("id")).distinct()
        front = stored(near.join(seen, ["root", "id"], "left_anti"), "closure")
        seen = stored(seen.union(front), "closure")
    return seen


def module_seeds(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """id: modules whose name or qualified name holds one of the names, and all that they contain."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains("name", F.lit(n)) | F.contains("qualified_name", F.lit(n))
    return closure(edges, nodes.filter(F.col("kind") == "module").filter(hit)).select("id").distinct()


def cohesion_ranking(nodes: DataFrame, edges: DataFrame, *, kind: str = "module") -> DataFrame:
    """root, size, inner, outer, score of the closure of each node of a kind: inner edges over inner and outer ones and 1; best first by rank."""
    c = closure(edges, nodes.filter(F.col("kind") == kind))
    size = c.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    e = edges.select("id", "source_id", "target_id")
    a = e.join(c.select("root", F.col("id").alias("source_id")), "source_id").select("root", "id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = e.join(c.select("root", F.col("id").alias("target_id")), "target_id").select("root", "id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    at = a.union(b).groupBy("root", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = at.groupBy("root").agg(F.sum(F.when(F.col("a") + F.col("b") == 2, 1).otherwise(0)).alias("inner"), F.sum(F.when(F.col("a") + F.col("b") == 1, 1).otherwise(0)).alias("outer"))
    out = size.join(n, "root", "left").na.fill(0).withColumn("score", F.col("inner") / (F.col("inner") + F.col("outer") + 1))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("size"), "root")))


def summary(roles: DataFrame) -> DataFrame:
    """One row: nodes of each role, blanket_size (sensory and active), system_size (with internal)."""
    n = lambda *r: F.sum(F.when(F.col("role").isin(*r), 1).otherwise(0))
    return roles.agg(n("internal").alias("internal"), n("sensory").alias("sensory"), n("active").alias("active"), n("external").alias("external"), n("sensory", "active").alias("blanket_size"), n("internal", "sensory", "active").alias("system_size"))
