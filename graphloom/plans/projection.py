"""The test tables as a property graph: one projection, read by Spark and by the oracle.

region -> module, nation -> class, customer -> function, supplier -> method, part -> variable, orders -> event. Names begin with words
that the keyword rules know. Edges: containment by geography; customers trigger orders, call suppliers and read, write or mutate parts by the
line items' return flag; suppliers read parts and write or read their nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]


def _word(key: str, words: list[str]) -> str:
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


_CUSTOMER = ["get", "set", "handle", "validate", "env", "retry", "list", "update", "route", "test"]
_SUPPLIER = ["fetch", "send", "select", "check", "circuit", "throttle", "read", "process"]
_PART = ["state", "alpha", "value", "lambda_x", "item"]
_NATION = ["BaseHandler", "StateMachine", "ConfigStore", "Repository", "Validator"]

NODES = f"""
SELECT 'r:' || CAST(r_regionkey AS STRING) AS id, 'module' AS kind, lower(r_name) AS name, lower(r_name) AS qualified_name, lower(r_name) AS path, 'python' AS language, CAST(NULL AS STRING) AS role FROM {{region}}
UNION ALL SELECT 'n:' || CAST(n_nationkey AS STRING), 'class', {_word("n_nationkey", _NATION)} || '_' || lower(n_name), lower(r_name) || '.' || lower(n_name), lower(r_name) || '/' || lower(n_name), 'python', 'hidden_state' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), 'function', {_word("c_custkey", _CUSTOMER)} || '_customer_' || CAST(c_custkey AS STRING), lower(n_name) || '.' || c_name, lower(r_name) || '/' || lower(n_name), CASE WHEN c_custkey % 4 = 0 THEN 'javascript' ELSE 'python' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'action' END FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'method', {_word("s_suppkey", _SUPPLIER)} || '_supplier_' || CAST(s_suppkey AS STRING), lower(n_name) || '.' || s_name, lower(r_name) || '/' || lower(n_name), 'python', CASE WHEN s_suppkey % 2 = 0 THEN 'observation' END FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 'p:' || CAST(p_partkey AS STRING), 'variable', {_word("p_partkey", _PART)} || '_part_' || CAST(p_partkey AS STRING), p_brand || '.' || p_name, p_brand, 'python', NULL FROM {{part}}
UNION ALL SELECT 'o:' || CAST(o_orderkey AS STRING), 'event', 'order_' || CAST(o_orderkey AS STRING), 'order_' || CAST(o_orderkey AS STRING), 'orders', 'python', NULL FROM {{orders}}
"""

EDGES = """
SELECT 'r:' || CAST(n_regionkey AS STRING) AS source_id, 'n:' || CAST(n_nationkey AS STRING) AS target_id, 'contains' AS kind, CAST(1 AS DOUBLE) AS weight FROM {nation}
UNION ALL SELECT 'r:' || CAST(n_regionkey AS STRING), 'n:' || CAST(n_nationkey AS STRING), 'reads', 1 FROM {nation} WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'n:' || CAST(n_nationkey AS STRING), 'n:' || CAST((n_nationkey * 7 + 3) % 25 AS STRING), 'inherits', 1 FROM {nation} WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'n:' || CAST(c_nationkey AS STRING), 'c:' || CAST(c_custkey AS STRING), 'contains', 1 FROM {customer}
UNION ALL SELECT 'n:' || CAST(s_nationkey AS STRING), 's:' || CAST(s_suppkey AS STRING), 'contains', 1 FROM {supplier}
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'n:' || CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN 'writes' ELSE 'reads' END, 1 FROM {supplier}
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'n:' || CAST(s_nationkey AS STRING), 'guards', 1 FROM {supplier} WHERE s_acctbal < 2000
UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), 'n:' || CAST(c_nationkey AS STRING), 'throws', 1 FROM {customer} WHERE c_acctbal < 0
UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), 'n:' || CAST(c_nationkey AS STRING), 'returns', 1 FROM {customer} WHERE c_custkey % 7 = 4
UNION ALL SELECT 'c:' || CAST(o_custkey AS STRING), 'o:' || CAST(o_orderkey AS STRING), 'triggers', 1 FROM {orders}
UNION ALL SELECT 'c:' || CAST(o_custkey AS STRING), 'p:' || CAST(l_partkey AS STRING), CASE l_returnflag WHEN 'N' THEN 'reads' WHEN 'R' THEN 'writes' ELSE 'mutates' END, CAST(sum(l_quantity) AS DOUBLE) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey, l_returnflag
UNION ALL SELECT 'c:' || CAST(o_custkey AS STRING), 's:' || CAST(l_suppkey AS STRING), 'calls', CAST(count(*) AS DOUBLE) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
UNION ALL SELECT 's:' || CAST(l_suppkey AS STRING), 'p:' || CAST(l_partkey AS STRING), 'reads', CAST(count(*) AS DOUBLE) FROM {lineitem} GROUP BY l_suppkey, l_partkey
"""

#: Hand-overs between the users of consecutive events: a directed graph with cycles.
HANDOVERS = """
SELECT DISTINCT 'u' || CAST(user_id AS STRING) AS source_id, 'u' || CAST(next_user AS STRING) AS target_id
FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next_user FROM {events}) x
WHERE next_user IS NOT NULL
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def projected(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: d for t, d in tables(spark, sf_dir).items() if f"{{{t}}}" in text})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projected(spark, sf_dir, EDGES)
    return out.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "source_id", "target_id", "kind"), 256), 1, 16))


def successions(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and next (the value of the key's next event by ts, event_id) of all events that have one, in stretches of an hour: else a few keys would sort all events in few tasks.

    Only the first and last events of stretches meet by key.
    """
    e = events.select(F.col(key).alias("key"), F.col(value).alias("value"), "ts", "event_id")
    e = e.withColumn("hour", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 3600000000L") if dict(e.dtypes)["ts"].startswith(("timestamp", "date")) else F.expr("ts div 3600"))
    within = e.select("key", "value", F.lead("value").over(Window.partitionBy("key", "hour").orderBy("ts", "event_id")).alias("next"))
    of = lambda f: f(F.struct("ts", "event_id", "value"))["value"]
    ends = e.groupBy("key", "hour").agg(of(F.min).alias("first"), of(F.max).alias("value"))
    across = ends.select("key", "value", F.lead("first").over(Window.partitionBy("key").orderBy("hour")).alias("next"))
    return within.union(across).filter("next IS NOT NULL")


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``HANDOVERS`` says."""
    pairs = successions(tables(spark, sf_dir)["events"], "event_type", "user_id").select("value", "next").distinct()
    return pairs.select(F.concat(F.lit("u"), "value").alias("source_id"), F.concat(F.lit("u"), "next").alias("target_id"))


def plain(text: str) -> str:
    """The oracle's form of a projection."""
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def oracle(query: str, *, graph: bool = True, **more: str) -> str:
    """``query`` over nodes and edges (and the tables of ``more``, in order)."""
    parts = []
    if graph:
        parts.append(f"nodes AS ({plain(NODES)})")
        parts.append(f"edges AS (SELECT *, substr(sha256(source_id || '|' || target_id || '|' || kind), 1, 16) AS id FROM ({plain(EDGES)}))")
    parts += [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query


def documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_chars, quality, toxic of labelled documents."""
    t = tables(spark, sf_dir)
    both = t["documents"].select("doc_id", "lang", "n_chars").join(t["labels"], "doc_id")
    return both.groupBy("doc_id", "lang", "n_chars").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
