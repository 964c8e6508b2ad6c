"""Critical paths of processes and of weighted graphs, and groups of stages that can run side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored
from graphloom.operators.process import levels

#: Starts that are nearer than this are the same for parallel groups.
NEAR = 0.1


def _along(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """start, position, id of all nodes from each of ``starts`` (id) on along ``jumps`` (id, next: one for each id), by pointer doubling.

    After k rounds a walk is known up to 2^k nodes. On a cycle a walk ends where it would meet itself.
    """
    jump, found, k = stored(jumps.select("id", "next"), "jumps"), stored(starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("position"), "id"), "walk"), 0
    while True:
        more = found.join(jump, "id").select("start", (F.col("position") + (1 << k)).alias("position"), F.col("next").alias("id"))
        # Of two visits of one node the earlier counts: what follows the later one is what followed the earlier.
        new = stored(found.unionByName(more).groupBy("start", "id").agg(F.min("position").alias("position")).select("start", "position", "id"), "walk")
        if new.count() == found.count():
            return new
        jump = stored(jump.join(jump.toDF("next", "then"), "next").select("id", F.col("then").alias("next")), "jumps")
        found, k = new, k + 1


def longest_paths(durations: DataFrame, links: DataFrame) -> DataFrame:
    """stage, length (the longest sum of durations from it to an end, its own included), next (the successor on it, the smallest of equals; null at an end).

    ``durations``: stage, duration (a missing or null one counts 1); ``links``: source_stage, target_stage. Raises ``ValueError`` for a cycle.
    """
    e = stored(links.select("source_stage", "target_stage").distinct(), "links")
    if not e.filter("source_stage = target_stage").isEmpty():
        raise ValueError("a stage depends on itself")
    back = stored(levels(e.select(F.col("target_stage").alias("source_stage"), F.col("source_stage").alias("target_stage"))), "levels")
    top = back.agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("cyclic")).first()
    if top.cyclic:
        raise ValueError(f"{top.cyclic} stages lie on or before a cycle")
    every = durations.select("stage", F.coalesce("duration", F.lit(1.0)).cast("double").alias("duration")).join(back, "stage", "full")
    every = stored(every.select("stage", F.coalesce("duration", F.lit(1.0)).alias("duration"), F.coalesce("level", F.lit(0)).alias("level")), "stages")
    ends = every.filter("level = 0").select("stage", F.col("duration").alias("length"), F.lit(None).cast(every.schema["stage"].dataType).alias("next"))
    done = [stored(ends, "longest")]
    for k in range(1, 1 + (top.top or 0)):
        known = reduce(DataFrame.union, done)
        here = every.filter(F.col("level") == k).withColumnRenamed("stage", "source_stage")
        ahead = here.join(e, "source_stage").join(known.select(F.col("stage").alias("target_stage"), "length"), "target_stage")
        best = ahead.groupBy("source_stage").agg(F.max("duration").alias("duration"), F.max(F.col("length")).alias("longest"))
        first = ahead.join(best.select("source_stage", "longest"), "source_stage").filter("length = longest").groupBy("source_stage").agg(F.min("target_stage").alias("next"))
        done.append(stored(best.join(first, "source_stage").select(F.col("source_stage").alias("stage"), (F.col("duration") + F.col("longest")).alias("length"), "next"), "longest"))
    return reduce(DataFrame.union, done)


def critical_path(durations: DataFrame, links: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """entry, position (from 0), stage, remaining (length from the stage on) of the longest path from each of ``entries`` (stage), or else from where the longest of all begins (ties: the smallest)."""
    best = stored(longest_paths(durations, links), "longest")
    if entries is None:
        starts = best.orderBy(F.desc("length"), "stage").limit(1).select(F.col("stage").alias("id"))
    else:
        starts = best.join(entries.select("stage").distinct(), "stage", "left_semi").select(F.col("stage").alias("id"))
    walk = _along(best.filter("next IS NOT NULL").select(F.col("stage").alias("id"), "next"), starts)
    return walk.join(best.select(F.col("stage").alias("id"), "length"), "id").select(F.col("start").alias("entry"), "position", F.col("id").alias("stage"), F.col("length").alias("remaining"))


def heaviest_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, next: each node's outgoing edge of greatest weight (ties: the smallest edge id), where it leads to a node of the graph."""
    best = edges.groupBy(F.col("source_id").alias("id")).agg(F.max("weight").alias("w"))
    first = edges.join(best, (F.col("source_id") == best["id"]) & F.col("weight").eqNullSafe(best["w"])).groupBy("source_id").agg(F.min(F.struct(edges["id"], "target_id")).alias("e"))
    steps = first.select(F.col("source_id").alias("id"), F.col("e.target_id").alias("next"))
    return steps.join(nodes.select(F.col("id").alias("next")), "next", "left_semi").join(nodes.select("id"), "id", "left_semi").select("id", "next")


def greedy_critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, id of the longest greedy walk: from each node without incoming edges, in the order of ids, along heaviest edges until a node that this or an earlier walk has visited.

    Every node belongs to the first entry (by id) that reaches it, which is found by passing the least entry along pointers that double; a walk is what belongs to its entry. Of equally long walks the first entry's counts.
    """
    jump = stored(heaviest_steps(nodes, edges), "steps")
    entries = nodes.select("id").join(edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")
    owner = stored(entries.select("id", F.col("id").alias("entry")), "owner")
    hop = jump
    while True:
        passed = owner.join(hop, "id").select(F.col("next").alias("id"), "entry")
        new = stored(owner.unionByName(passed).groupBy("id").agg(F.min("entry").alias("entry")), "owner")
        hop = stored(hop.join(hop.toDF("next", "then"), "next").select("id", F.col("then").alias("next")), "steps")
        same = new.count() == owner.count() and new.join(owner, ["id", "entry"], "left_anti").isEmpty()
        owner = new
        if same and passed_all(owner, jump):
            break
    sizes = owner.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "entry").limit(1)
    walk = _along(jump, best.select(F.col("entry").alias("id")))
    return walk.join(owner.select("id", F.col("entry").alias("start")), ["id", "start"], "left_semi").select("position", "id")


def passed_all(owner: DataFrame, jump: DataFrame) -> bool:
    """Whether no step leads from an owner to a later one or to none."""
    told = owner.join(jump, "id").select(F.col("next").alias("id"), F.col("entry").alias("least"))
    return told.join(owner, "id", "left").filter("entry IS NULL OR least < entry").isEmpty()


def markov_order(nodes: DataFrame, edges: DataFrame) -> int:
    """Steps of the greedy critical path, 1 at least."""
    return max(1, greedy_critical_path(nodes, edges).count() - 1)


def parallel_groups(stages: DataFrame, links: DataFrame, *, near: float = NEAR) -> DataFrame:
    """leader, stage of groups of two or more stages that start together and of which none depends on the leader or the other way round.

    ``stages``: stage, start. In the order of start and stage, the first without a group leads one and takes all others without one that start less than ``near`` later and have no link with it.
    Where two starts in a row are ``near`` or more apart no group can reach over, so the order is cut there; in each round every such stretch forms its next group, and ends when all its
    stages are taken.
    """
    order = Window.orderBy("start")
    # Only the distinct starts are put in one order; they are counted by their number, not by stages.
    starts = stages.select("start").distinct()
    cuts = starts.withColumn("cut", F.when(F.col("start") - F.lag("start").over(order) < near, 0).otherwise(1)).withColumn("stretch", F.sum("cut").over(order))
    left = stored(stages.select("stage", "start").join(cuts.select("start", "stretch"), "start"), "stretches")
    e = links.select(F.col("source_stage").alias("leader"), F.col("target_stage").alias("stage"))
    e = stored(e.union(e.select("stage", "leader")).distinct(), "links")
    done = []
    while not left.isEmpty():
        first = left.groupBy("stretch").agg(F.min(F.struct("start", "stage")).alias("f")).select("stretch", F.col("f.stage").alias("leader"), F.col("f.start").alias("since"))
        near_by = left.join(first, "stretch").filter((F.col("stage") == F.col("leader")) | (F.col("start") - F.col("since") < near))
        group = stored(near_by.join(e, ["leader", "stage"], "left_anti").select("leader", "stage"), "group")
        done.append(group)
        left = stored(left.join(group.select("stage"), "stage", "left_anti"), "stretches")
    if not done:
        return stages.select(F.col("stage").alias("leader"), "stage")
    every = reduce(DataFrame.union, done)
    many = every.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return every.join(many, "leader", "left_semi")
