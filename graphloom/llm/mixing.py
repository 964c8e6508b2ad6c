"""Mixing of sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget goes down the tree domain - language - source. At each node it is shared among the children by weight, no child gets
more than all leaves below it can give (their tokens times ``max_epochs``), and what it can't use goes to its
siblings by their weights. A node's budget is what its parent could place there, so a shortage is first made up for by
siblings and only then by the siblings of an ancestor. Each leaf then takes its whole documents once for every full epoch that its
budget holds, and of the last epoch, ordered by a hash of seed, epoch and doc_id, the longest prefix that fits the rest.

Where the prefix ends is found by counts over hash digits, level by level, so that only a small part of a leaf is ever sorted. Rows meet the plan of
their leaf by broadcast, or over salted keys if there are very many leaves, so a leaf that holds a third of all rows is dealt to many tasks.

Nulls and odd rows: null names of domain, language or source count as ``''``; a null text has no tokens. Children that are not in the
weights have weight 1; a weight of 0 or less gives no budget. Rows of one doc_id in one leaf are taken together or not at
all. Empty tables give no rows. ``mixed`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import meet, scratch, stored, table

SEED = 17
#: Hash digits (of 16 values each) by which the end of a prefix is narrowed down at one level, and levels.
DIGITS, LEVELS = 2, 2
MAX_EPOCHS = 2
#: Share of the corpus' tokens, as a fraction.
SHARE = (4, 5)
#: level, name, weight. Fixed parameters of the query.
WEIGHTS = [
    ("domain", "web", 4), ("domain", "books", 3), ("domain", "news", 2), ("domain", "forum", 1),
    ("lang", "en", 5), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 1),
]
#: Domain of a document of the test tables: by the number in its source's name.
DOMAIN = "element_at(array('web', 'books', 'news', 'forum'), 1 + CAST(coalesce(nullif(regexp_extract(source, '([0-9]{1,6})$', 1), ''), '0') AS INT) % 4)"
TOKENS = r"CAST(regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS BIGINT)"
LEAF = ["__domain", "__lang", "__source"]


def shared_out(children: DataFrame, parents: list[str], order: list[str]) -> DataFrame:
    """Adds ``alloc`` to children (parents, budget, cap, weight): water-filling within each parent.

    Sorted by cap per weight, the level ``(budget - caps before) / (weights - weights before)`` rises while children are filled and
    falls afterwards, so its maximum is the level of all children that are not filled.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = by.orderBy("ratio", *order).rowsBetween(Window.unboundedPreceding, -1)
    live = F.col("weight") > 0
    out = children.withColumn("ratio", F.when(live, F.col("cap") / F.col("weight")))
    out = out.withColumn("w", F.when(live, F.col("weight")).otherwise(0.0))
    out = out.withColumn("cap_before", F.coalesce(F.sum(F.when(live, F.col("cap"))).over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = out.withColumn("level", F.when(live, (F.col("budget") - F.col("cap_before")).cast("double") / (F.sum("w").over(by) - F.col("w_before"))))
    out = out.withColumn("top", F.max("level").over(by))
    out = out.withColumn("alloc", F.when(live, F.floor(F.least(F.col("cap").cast("double"), F.col("w") * F.greatest("top", F.lit(0.0))))).otherwise(0).cast("long"))
    return out.drop("ratio", "w", "cap_before", "w_before", "level", "top")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, *, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (__domain, __lang, __source, tokens) with ``alloc``, the tokens that each is to give."""
    told = weights.na.drop().groupBy("level", "name").agg(F.max("weight").cast("double").alias("weight"))
    now = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = now.agg(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} DIV {share[1]}").cast("long").alias("budget"))
    for depth, level in enumerate(("domain", "lang", "source")):
        keys = LEAF[: depth + 1]
        nodes = now.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        nodes = nodes.crossJoin(F.broadcast(whole)) if depth == 0 else nodes.join(given, LEAF[:depth])  # one row, or the budgets of the parents  # noqa: F821
        own = told.filter(F.col("level") == level).select(F.col("name").alias(keys[-1]), "weight")
        nodes = nodes.join(own, keys[-1], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        given = shared_out(nodes, LEAF[:depth], [keys[-1]]).select(*keys, F.col("alloc").alias("budget"))
    return leaves.join(given, LEAF).withColumnRenamed("budget", "alloc")


def _hash(epoch) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))))


def plan(rows: DataFrame, weights: DataFrame, *, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """For each leaf: __epochs, and __last, the last hash of its prefix of the next epoch (null: an empty prefix).

    ``rows``: __domain, __lang, __source, __id, __tokens; read several times, so better stored.
    """
    spark = rows.sparkSession
    leaves = rows.groupBy(*LEAF).agg(F.sum("__tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, share=share, max_epochs=max_epochs)
    safe = F.greatest("tokens", F.lit(1))
    budgets = budgets.withColumn("epochs", F.expr("alloc DIV greatest(tokens, 1)")).withColumn("rest", F.col("alloc") % safe)
    path = scratch(spark, "leaf-budgets")
    budgets.select(*LEAF, "epochs", "rest").write.parquet(path)
    budgets = spark.read.parquet(path)
    # rest > 0: of leaves that give nothing of the next epoch no row is read further
    cut = budgets.filter("rest > 0").select(*LEAF, "epochs", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    for level in range(1, levels + 1):
        inside = meet(rows, cut, LEAF, spread="__id").withColumn("h", _hash(F.col("epochs"))).filter(F.expr("startswith(h, prefix)"))
        sums = inside.groupBy(*LEAF, "epochs", "left", F.substring("h", 1, digits * level).alias("digits")).agg(F.sum("__tokens").alias("t"))
        upto = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("digits"))
        after = sums.withColumn("upto", upto)
        # The bucket in which the budget ends; it exists, as the rest is less than the leaf's tokens.
        ends = after.filter("upto > `left`").groupBy(*LEAF, "epochs").agg(F.min(F.struct("digits", F.expr("`left` - upto + t").alias("left"))).alias("e"))
        path = scratch(spark, "leaf-cuts")
        ends.select(*LEAF, "epochs", "e.left", F.col("e.digits").alias("prefix")).write.parquet(path)
        cut = spark.read.parquet(path)
    inside = meet(rows, cut, LEAF, spread="__id").withColumn("h", _hash(F.col("epochs"))).filter(F.expr("startswith(h, prefix)"))
    upto = F.sum("__tokens").over(Window.partitionBy(*LEAF).orderBy("h", "__id"))  # the default frame takes rows of one hash together
    last = inside.withColumn("upto", upto).filter("upto <= `left`").groupBy(*LEAF).agg(F.max("h").alias("last"))
    # All smaller buckets are in the prefix; without a row of the last bucket it ends before that bucket's prefix.
    ends = cut.join(last, LEAF, "left").select(*LEAF, F.coalesce("last", "prefix").alias("last"))
    return budgets.join(ends, LEAF, "left").select(*LEAF, F.col("epochs").alias("__epochs"), F.col("last").alias("__last"))


def _copies(docs: DataFrame, weights: DataFrame, *, domain: str = DOMAIN, tokens: str = TOKENS, **parameters) -> DataFrame:
    """row (of ``docs``), __domain, __lang, __source, __tokens and __copies (0: not taken)."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct("*").alias("row"), name(F.expr(domain)).alias("__domain"), name(F.col("lang")).alias("__lang"), name(F.col("source")).alias("__source"),
        F.col("doc_id").cast("long").alias("__id"), F.expr(tokens).alias("__tokens"),
    )
    rows = stored(keyed.select(*LEAF, "__id", "__tokens"), "leaf-rows")
    out = meet(keyed, stored(plan(rows, weights, **parameters), "leaf-plan"), LEAF, spread="__id")
    taken = F.col("__last").isNotNull() & (_hash(F.col("__epochs")) <= F.col("__last"))
    return out.select("row", *LEAF, "__tokens", (F.col("__epochs") + F.when(taken, 1).otherwise(0)).alias("__copies"))


def with_copies(docs: DataFrame, weights: DataFrame, **parameters) -> DataFrame:
    """``docs`` with __domain, __lang, __source, __tokens and __copies (0: not taken)."""
    return _copies(docs, weights, **parameters).select("row.*", *LEAF, "__tokens", "__copies")


def mixed(docs: DataFrame, weights: DataFrame, **parameters) -> DataFrame:
    """The rows of the mixture, each as often as its leaf's epochs take it, with the columns of ``docs``."""
    return _copies(docs, weights, **parameters).filter("__copies > 0").select("row", F.explode(F.expr("sequence(1L, __copies)")).alias("copy")).select("row.*")


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in WEIGHTS], "level string, name string, weight double")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the mixture takes, with its leaf, tokens and copies."""
    out = with_copies(table(spark, sf_dir, "documents"), weight_table(spark)).filter("__copies > 0")
    return out.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


def _fill_sql(name: str, nodes: str, parents: str, key: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_a AS (SELECT *, cap / weight AS ratio FROM ({nodes})),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before, coalesce(sum(weight) OVER ({part} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before, sum(weight) OVER ({part}) AS w_all FROM {name}_a),
{name}_c AS (SELECT *, max(CAST(budget - cap_before AS DOUBLE) / (w_all - w_before)) OVER ({part}) AS top FROM {name}_b),
{name} AS (SELECT *, CAST(floor(least(CAST(cap AS DOUBLE), weight * greatest(top, 0))) AS BIGINT) AS alloc FROM {name}_c)"""


_NUMBER = "CAST(coalesce(nullif(regexp_extract(source, '([0-9]{1,6})$', 1), ''), '0') AS INT) % 4"
OP4_SQL = (
    rf"""WITH d AS (SELECT doc_id, lang, source, CASE {_NUMBER} WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'forum' END AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),"""
    + _fill_sql("x", f"SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM l) AS budget, CAST(CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM l GROUP BY domain", "", "domain")
    + ","
    + _fill_sql("y", "SELECT l.domain, lang, sum(l.cap) AS cap, any_value(x.alloc) AS budget, CAST(CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM l JOIN x USING (domain) GROUP BY l.domain, lang", "domain", "lang")
    + ","
    + _fill_sql("z", "SELECT l.domain, l.lang, source, l.cap AS cap, y.alloc AS budget, CAST(1 AS DOUBLE) AS weight FROM l JOIN y USING (domain, lang)", "domain, lang", "source")
    + f""",
p AS (SELECT l.domain, l.lang, l.source, alloc // greatest(tokens, 1) AS epochs, alloc % greatest(tokens, 1) AS rest FROM l JOIN z USING (domain, lang, source)),
h AS (SELECT d.*, epochs, rest, md5(concat_ws(':', '{SEED}', epochs, doc_id)) AS h FROM d JOIN p USING (domain, lang, source)),
u AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) <= rest THEN 1 ELSE 0 END AS copies FROM h)
SELECT doc_id, domain, lang, source, n_tokens, CAST(copies AS BIGINT) AS copies FROM u WHERE copies > 0"""
)
