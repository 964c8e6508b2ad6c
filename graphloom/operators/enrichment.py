"""What was seen at run time, written back to a graph: coverage by lines, calls and durations by traces.

Nodes may have ``start_line`` and ``end_line`` (both inclusive) and ``metadata`` (map of strings); edges may have ``evidence_sources``. Missing ones are added.
Covered lines meet the spans of nodes, which nest, by prefix sums: a node's count is that up to its end less that before its start, so neither a long span nor a deep nest
multiplies rows. Lines and ends of spans meet in buckets of ``BUCKET`` lines of one file; the sums of whole buckets are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored
from graphloom.operators import traces
from graphloom.operators.graph import PropertyGraph, edge_id

BUCKET = 1024
CALLABLE = ["function", "method"]
DYNAMIC = "dynamic_trace"


def coverage_marks(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """id, coverage_hits (covered lines in the span), branch_coverage (share of its branch lines that were taken; null without) of nodes with either.

    ``lines``: file, line, hits, is_branch; a row each time a line was recorded. ``nodes``: id, path, start_line, end_line.
    """
    at = F.floor(F.col("line") / BUCKET).cast("long").alias("bucket")
    branch = F.coalesce("is_branch", F.lit(False)) if "is_branch" in lines.columns else F.lit(False)
    seen = lines.withColumn("branch", branch).groupBy(traces.normal_path("file").alias("p"), F.col("line").cast("long").alias("line")).agg(
        F.count_if(F.col("hits") > 0).alias("c"), F.count_if("branch").alias("b"), F.count_if(F.col("branch") & (F.col("hits") > 0)).alias("t")
    )
    seen = stored(seen.withColumn("bucket", at), "covered-lines")
    spans = nodes.filter("start_line <= end_line AND path <> ''").select("id", traces.normal_path("path").alias("p"), F.explode(F.array(F.struct((F.col("start_line").cast("long") - 1).alias("line"), F.lit(-1).alias("sign")), F.struct(F.col("end_line").cast("long").alias("line"), F.lit(1).alias("sign")))).alias("e"))
    ends = spans.select("id", "p", "e.line", "e.sign").withColumn("bucket", at)
    sums = ["c", "b", "t"]
    # Ends come after the lines that they include.
    both = seen.withColumn("id", F.lit(None).cast(nodes.schema["id"].dataType)).withColumn("sign", F.lit(0)).unionByName(ends.select("*", *[F.lit(0).alias(s) for s in sums]))
    upto = Window.partitionBy("p", "bucket").orderBy("line", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    within = both.select("id", "p", "bucket", "sign", *[F.sum(s).over(upto).alias(s) for s in sums]).filter("sign <> 0")
    before = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ends.select("p", "bucket").distinct().join(seen.groupBy("p", "bucket").agg(*[F.sum(s).alias(s) for s in sums]), ["p", "bucket"], "full").na.fill(0, sums)
    buckets = buckets.select("p", "bucket", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}0") for s in sums])
    total = within.join(buckets, ["p", "bucket"]).groupBy("id").agg(*[F.sum(F.col("sign") * (F.col(s) + F.col(f"{s}0"))).alias(s) for s in sums])
    return total.filter("c > 0 OR b > 0").select("id", F.col("c").alias("coverage_hits"), F.when(F.col("b") > 0, F.col("t") / F.col("b")).alias("branch_coverage"))


def function_index(nodes: DataFrame) -> DataFrame:
    """name, id, exact: functions and methods under their name and, marked as exact, their qualified name."""
    n = nodes.filter(F.col("kind").isin(CALLABLE))
    full = n.filter("qualified_name <> '' AND qualified_name <> name").select(F.col("qualified_name").alias("name"), "id", F.lit(True).alias("exact"))
    return n.select("name", "id", F.lit(False).alias("exact")).union(full)


def trace_marks(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """id, call_count, avg_duration_ms (4 digits), is_hot_path of functions in the trace; what is known under the qualified name goes first."""
    hot = traces.hot_functions(traces.timing(events))
    found = function_index(nodes).join(hot, "name")
    best = found.groupBy("id").agg(F.max(F.struct("exact", "name", "n", "mean_ms", "hot")).alias("x"))
    return best.select("id", F.col("x.n").alias("call_count"), F.round("x.mean_ms", 4).alias("avg_duration_ms"), F.col("x.hot").alias("is_hot_path"))


def trace_calls(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """source_id, target_id, weight: calls in the trace between functions of the graph; the weight is how often the callee was timed (1 at least)."""
    index = stored(function_index(nodes).select("name", "id").distinct(), "functions")
    pairs = traces.call_graph(events).select("caller", "callee")
    counts = traces.timing(events).select(F.col("name").alias("callee"), "n")
    named = pairs.join(counts, "callee", "left").select("caller", "callee", F.coalesce("n", F.lit(1)).cast("double").alias("weight"))
    named = named.join(index.select(F.col("name").alias("caller"), F.col("id").alias("source_id")), "caller").join(index.select(F.col("name").alias("callee"), F.col("id").alias("target_id")), "callee")
    return named.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))


def enriched(graph: PropertyGraph, *, lines: DataFrame | None = None, events: DataFrame | None = None) -> PropertyGraph:
    """The graph with coverage and trace marks in the nodes' ``metadata``, and calls of the trace as edges.

    A call that the graph has gets the greater weight and one more evidence source; others are added.
    """
    nodes, edges = graph.nodes, graph.edges
    if "metadata" not in nodes.columns:
        nodes = nodes.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for marks in ([coverage_marks(nodes, lines)] if lines is not None else []) + ([trace_marks(nodes, events)] if events is not None else []):
        names = marks.columns[1:]
        own = [f"__{n}" for n in names]  # nodes may have columns of these names
        joined = nodes.join(marks.toDF("id", *own).withColumn("__found", F.lit(True)), "id", "left")
        new = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(o).cast("string") for o in own]))
        kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(names))  # noqa: B023
        nodes = joined.withColumn("metadata", F.when(F.col("__found"), F.map_concat(kept, new)).otherwise(F.col("metadata"))).select(*nodes.columns)
    if events is not None:
        if "evidence_sources" not in edges.columns:
            edges = edges.withColumn("evidence_sources", F.lit(None).cast("array<string>"))
        calls = stored(trace_calls(nodes, events).withColumn("kind", F.lit("calls")), "trace-calls")
        keys = ["source_id", "target_id", "kind"]
        seen = edges.join(calls.withColumnRenamed("weight", "__weight"), keys, "left")
        more = F.array_union(F.coalesce("evidence_sources", F.array().cast("array<string>")), F.array(F.lit(DYNAMIC)))
        seen = seen.withColumn("weight", F.greatest("weight", "__weight")).withColumn("evidence_sources", F.when(F.col("__weight").isNotNull(), more).otherwise(F.col("evidence_sources"))).select(*edges.columns)
        new = calls.join(edges.select(*keys).distinct(), keys, "left_anti").withColumn("id", edge_id()).withColumn("evidence_sources", F.array(F.lit(DYNAMIC)))
        edges = seen.unionByName(new, allowMissingColumns=True)
    return PropertyGraph(nodes, edges)
