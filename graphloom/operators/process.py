"""Process models: stages of a graph, their connections, patterns and order; resilience policies; time lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import keywords as kw
from graphloom.functions.storage import stored
from graphloom.operators.components import weak_components

# What an edge between stages triggers.
TRIGGERS = {"calls": "call", "async_calls": "async_call", "triggers": "event", "writes": "data", "reads": "data"}
_PRIORITY = "CASE kind WHEN 'method' THEN 4 WHEN 'function' THEN 3 WHEN 'class' THEN 2 WHEN 'module' THEN 1 ELSE 0 END"


def stages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, stage, stage_name: nodes by the first segment of their path and, within it, by components over calls and triggers; named by the primary node."""
    group = F.coalesce(F.nullif(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("")), F.lit("root"))
    n = stored(nodes.select("id", "kind", "name", group.alias("grp")), "stages")
    at = n.select("id", "grp")
    e = edges.filter("kind IN ('calls', 'triggers')").select("source_id", "target_id")
    e = e.join(at.select(F.col("id").alias("source_id"), F.col("grp").alias("ga")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("grp").alias("gb")), "target_id").filter("ga = gb")
    c = stored(n.join(weak_components(n, e), "id"), "stages")
    primary = c.groupBy("grp", "component").agg(F.max(F.struct(F.expr(_PRIORITY).alias("p"), "name")).alias("best"))
    return c.join(primary, ["grp", "component"]).select("id", F.concat_ws(":", "grp", "component").alias("stage"), F.col("best.name").alias("stage_name"))


def connections(staged: DataFrame, edges: DataFrame) -> DataFrame:
    """source_stage, target_stage, trigger, n of the edges that cross stages."""
    s = staged.select("id", "stage")
    kind = F.create_map(*[F.lit(x) for kv in TRIGGERS.items() for x in kv])[F.col("kind")]
    both = edges.withColumn("trigger", kind).filter("trigger IS NOT NULL").join(s.select(F.col("id").alias("source_id"), F.col("stage").alias("source_stage")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("stage").alias("target_stage")), "target_id")
    return both.filter("source_stage <> target_stage").groupBy("source_stage", "target_stage", "trigger").agg(F.count(F.lit(1)).alias("n"))


def patterns(links: DataFrame) -> DataFrame:
    """stage, pattern: fan_out and fan_in with over one partner, sequential with one on each side, entry and exit."""
    e = links.select("source_stage", "target_stage").distinct()
    out, into = e.groupBy(F.col("source_stage").alias("stage")).agg(F.count(F.lit(1)).alias("o")), e.groupBy(F.col("target_stage").alias("stage")).agg(F.count(F.lit(1)).alias("i"))
    d = out.join(into, "stage", "full").na.fill(0)
    found = F.array_compact(F.array(F.when(F.col("o") > 1, "fan_out"), F.when(F.col("i") > 1, "fan_in"), F.when((F.col("o") == 1) & (F.col("i") == 1), "sequential"), F.when(F.col("i") == 0, "entry"), F.when(F.col("o") == 0, "exit")))
    return d.select("stage", F.explode(found).alias("pattern"))


def policies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, policy: retry (name, a call of itself, or throwing and catching), branching (name, or two targets of calls and triggers), circuit_breaker (name) of functions and methods."""
    n = nodes.filter("kind IN ('function', 'method')")
    e = edges.groupBy(F.col("source_id").alias("id")).agg(
        F.bool_or((F.col("kind") == "calls") & (F.col("source_id") == F.col("target_id"))).alias("again"), F.bool_or(F.col("kind") == "throws").alias("throws"), F.bool_or(F.col("kind") == "catches").alias("catches"),
        F.count_distinct(F.when(F.col("kind").isin("calls", "triggers"), F.col("target_id"))).alias("targets"),
    )
    both = n.join(e, "id", "left").na.fill({"again": False, "throws": False, "catches": False, "targets": 0})
    retry = kw.contains_any("name", kw.RETRY_HINTS) | F.col("again") | (F.col("throws") & F.col("catches"))
    branch = kw.contains_any("name", kw.BRANCH_HINTS) | (F.col("targets") >= 2)
    found = F.array_compact(F.array(F.when(retry, "retry"), F.when(branch, "branching"), F.when(kw.contains_any("name", kw.CIRCUIT_HINTS), "circuit_breaker")))
    return both.select("id", F.explode(found).alias("policy"))


def levels(links: DataFrame) -> DataFrame:
    """stage, level: the longest way from a stage without predecessors; stages on or behind a cycle have none (null)."""
    e = stored(links.select("source_stage", "target_stage").filter("source_stage <> target_stage").distinct(), "levels")
    left = stored(e.select(F.explode(F.array("source_stage", "target_stage")).alias("stage")).distinct(), "levels")
    done, level = None, 0
    while True:
        free = left.join(e.select(F.col("target_stage").alias("stage")).distinct(), "stage", "left_anti").withColumn("level", F.lit(level))
        free = stored(free, "levels")
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        left = stored(left.join(free, "stage", "left_anti"), "levels")
        e = stored(e.join(free.select(F.col("stage").alias("source_stage")), "source_stage", "left_anti"), "levels")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.union(rest)


def timeline(durations: DataFrame, links: DataFrame) -> DataFrame:
    """stage, start, end: each stage starts when its last predecessor has ended (stages on cycles at 0). ``durations``: stage, duration."""
    order = stored(durations.join(levels(links), "stage", "left").select("stage", F.coalesce("duration", F.lit(1.0)).alias("duration"), F.coalesce("level", F.lit(0)).alias("level")), "timeline")
    done = stored(order.filter("level = 0").select("stage", F.lit(0.0).alias("start"), F.col("duration").alias("end")), "timeline")
    for k in range(1, 1 + (order.agg(F.max("level")).first()[0] or 0)):
        e = links.select(F.col("source_stage").alias("stage"), "target_stage").distinct()
        start = done.join(e, "stage").groupBy(F.col("target_stage").alias("stage")).agg(F.max("end").alias("start"))
        new = order.filter(F.col("level") == k).join(start, "stage", "left").select("stage", F.coalesce("start", F.lit(0.0)).alias("start"), (F.coalesce("start", F.lit(0.0)) + F.col("duration")).alias("end"))
        done = stored(done.union(new), "timeline")
    return done


def total_duration(stages: DataFrame) -> DataFrame:
    """One row: when the last stage of a time line (stage, start, end) has ended; 0 without stages."""
    return stages.agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("total"))
