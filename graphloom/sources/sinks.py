"""Writers of graphs: Parquet, JSON lines, CSV, Arrow IPC, GraphML, DOT and Mermaid."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph


def write_parquet(graph: PropertyGraph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file, by way of the driver: for results that fit there."""
    import pyarrow as pa

    table = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)


def dot_lines(graph: PropertyGraph) -> DataFrame:
    """Lines of a DOT graph in order of ``part``: head, nodes, edges, foot."""
    spark = graph.nodes.sparkSession
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '\\\\"'), F.lit('"'))
    ends = spark.sql("SELECT 0 AS part, 'digraph G {' AS line UNION ALL SELECT 3, '}'")
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), q("source_id"), F.lit(" -> "), q("target_id"), F.lit(" [label="), q("kind"), F.lit("];")).alias("line"))
    return ends.union(n).union(e)


def mermaid_lines(graph: PropertyGraph) -> DataFrame:
    spark = graph.nodes.sparkSession
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    head = spark.sql("SELECT 0 AS part, 'graph TD' AS line")
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), safe("id"), F.lit("["), F.regexp_replace("name", r'[\[\]"]', ""), F.lit("]")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), safe("source_id"), F.lit(" -->|"), "kind", F.lit("| "), safe("target_id")).alias("line"))
    return head.union(n).union(e)


def graphml_rows(graph: PropertyGraph) -> DataFrame:
    """Elements of a GraphML document in order of ``part``."""
    spark = graph.nodes.sparkSession
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys = "".join(f"<key id={quoteattr(k)} for={quoteattr(f)} attr.name={quoteattr(k)} attr.type={quoteattr(t)}/>" for k, f, t in (("name", "node", "string"), ("kind", "all", "string"), ("weight", "edge", "double")))
    ends = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="name">'), esc("name"), F.lit('</data><data key="kind">'), esc("kind"), F.lit("</data></node>")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc("source_id"), F.lit('" target="'), esc("target_id"), F.lit('"><data key="kind">'), esc("kind"), F.lit('</data><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    return ends.union(n).union(e)
