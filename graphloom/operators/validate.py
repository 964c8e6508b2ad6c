"""Validation: issues of graphs as rows, gaps of provenance, and scores of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph


def graph_issues(graph: PropertyGraph) -> DataFrame:
    """issue, severity, id: missing names, dangling ends, negative weights, repeated ids."""
    n, e = graph.nodes, graph.edges
    row = lambda df, issue, severity, c="id": df.select(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.col(c).alias("id"))
    ids = n.select(F.col("id").alias("__n")).distinct()
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    parts = [
        row(n.filter(empty("id")), "missing_id", "error"), row(n.filter(empty("name")), "missing_name", "error"), row(n.filter(empty("qualified_name")), "missing_qualified_name", "warning"),
        row(e.join(ids, F.col("source_id") == F.col("__n"), "left_anti"), "dangling_source", "error", "source_id"), row(e.join(ids, F.col("target_id") == F.col("__n"), "left_anti"), "dangling_target", "error", "target_id"),
        row(e.filter("weight < 0"), "negative_weight", "error", "source_id"), row(n.groupBy("id").count().filter("count > 1"), "duplicate_id", "error"),
    ]
    return reduce(DataFrame.union, parts)


def provenance_gaps(elements: DataFrame, records: DataFrame) -> DataFrame:
    """Elements (id) without a record (target_id)."""
    return elements.join(records.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def validation_score(issues: DataFrame, total: int) -> DataFrame:
    """One row: 1 less 0.1 for each error, 0.02 for each warning and 0.001 for each other issue, over the elements; at least 0."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    out = issues.agg(F.coalesce(n("error"), F.lit(0)).alias("errors"), F.coalesce(n("warning"), F.lit(0)).alias("warnings"), F.coalesce(n("info"), F.lit(0)).alias("infos"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - (0.1 * F.col("errors") + 0.02 * F.col("warnings") + 0.001 * F.col("infos")) / max(1, total)))


def state_space_issues(variables: DataFrame, effects: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """issue, severity, id, reference of a model: variables (id) that stand twice, actions (effects: action, variable) and preferences (preference, variable) that name no variable."""
    ids = variables.select(F.col("id").alias("variable")).distinct()
    none = F.lit(None).cast("string").alias("reference")
    twice = variables.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_variable").alias("issue"), F.lit("error").alias("severity"), "id", none)
    missing = lambda df, of: df.select(of, "variable").distinct().join(ids, "variable", "left_anti").select(F.lit(f"{of}_without_variable").alias("issue"), F.lit("error").alias("severity"), F.col(of).alias("id"), F.col("variable").alias("reference"))
    out = twice.union(missing(effects, "action"))
    return out if preferences is None else out.union(missing(preferences, "preference"))


def process_issues(stages: DataFrame, links: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """issue, severity, id, reference of a process: stages (id) that stand twice, ends of links (source_stage, target_stage), entries and exits (id) that are no stage."""
    ids = stages.select("id").distinct()
    row = lambda df, issue, i, r: df.select(F.lit(issue).alias("issue"), F.lit("error").alias("severity"), i.alias("id"), r.alias("reference"))
    none = F.lit(None).cast("string")
    name = F.concat_ws(">", "source_stage", "target_stage")
    pairs = links.select("source_stage", "target_stage").distinct()
    away = lambda c: pairs.join(ids.withColumnRenamed("id", c), c, "left_anti")
    parts = [
        row(stages.groupBy("id").count().filter("count > 1"), "duplicate_stage", F.col("id"), none),
        row(away("source_stage"), "link_without_source", name, F.col("source_stage")), row(away("target_stage"), "link_without_target", name, F.col("target_stage")),
        row(entries.select("id").distinct().join(ids, "id", "left_anti"), "entry_without_stage", F.col("id"), none), row(exits.select("id").distinct().join(ids, "id", "left_anti"), "exit_without_stage", F.col("id"), none),
    ]
    return reduce(DataFrame.union, parts)


def provenance_coverage(elements: DataFrame, records: DataFrame) -> DataFrame:
    """kind, elements, covered, share: how many elements (id, kind) have a record (target_id), by kind."""
    known = records.select(F.col("target_id").alias("id")).distinct().withColumn("known", F.lit(1))
    out = elements.join(known, "id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("elements"), F.count("known").alias("covered"))
    return out.withColumn("share", F.col("covered") / F.col("elements"))
