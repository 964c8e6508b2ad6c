"""Types of symbols by a monotone fixpoint: known types flow along assignments, calls and returns until nothing changes.

A symbol's value is a set of type names, ordered by inclusion; of numbers only the widest counts (bool, int, float, complex), and more than ``WIDTH`` different types are ``Any``, the
top. Values only grow and a value can grow at most ``WIDTH`` + 4 times, so the rounds end, and what they end in depends on no order. A round passes on only what has grown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

ANY = "Any"
WIDTH = 3
# Python's numbers, each of which the next can stand for.
NUMBERS = ["bool", "int", "float", "complex"]


def joined_types(atoms: Column, width: int = WIDTH) -> Column:
    """The value of a set of type names: sorted, of numbers the widest, ``Any`` alone if there are more than ``width``."""
    numbers = F.array(*map(F.lit, NUMBERS))
    widest = F.coalesce(*[F.when(F.array_contains(atoms, n), F.array(F.lit(n))) for n in reversed(NUMBERS)], F.array().cast("array<string>"))
    own = F.array_sort(F.concat(F.array_except(atoms, numbers), widest))
    return F.when(F.array_contains(atoms, ANY) | (F.size(own) > width), F.array(F.lit(ANY))).otherwise(own)


def _values(atoms: DataFrame, width: int) -> DataFrame:
    """symbol, types of rows (symbol, type): no task holds more names of a symbol than decide its value."""
    once = atoms.distinct()
    most = width + len(NUMBERS) + 1
    # Any goes first, and more names than these are Any with or without the rest.
    first = Window.partitionBy("symbol").orderBy(F.when(F.col("type") == ANY, 0).otherwise(1), "type")
    few = once.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= most)
    return few.groupBy("symbol").agg(F.collect_set("type").alias("atoms")).select("symbol", joined_types(F.col("atoms"), width).alias("types"))


def inferred(known: DataFrame, flows: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """symbol, types of all symbols that a type reaches. ``known``: symbol, type; ``flows``: source, target (the target takes what the source has)."""
    e = stored(flows.select("source", "target").filter("source <> target").distinct(), "type-flows")
    now = stored(_values(known.select("symbol", "type").na.drop(), width), "types")
    grown = now
    while not grown.isEmpty():
        passed = grown.select(F.col("symbol").alias("source"), F.explode("types").alias("type")).join(e, "source").select(F.col("target").alias("symbol"), "type")
        touched = passed.select("symbol").distinct()
        old = now.join(touched, "symbol", "left_semi").select("symbol", F.explode("types").alias("type"))
        new = _values(passed.union(old), width)
        grown = stored(new.join(now.withColumnRenamed("types", "before"), "symbol", "left").filter("before IS NULL OR types <> before").select("symbol", "types"), "grown")
        now = stored(now.join(grown.select("symbol"), "symbol", "left_anti").unionByName(grown), "types")
    return now


def annotation(types: str | Column) -> Column:
    """A value as Python writes it: ``T``, ``A | B``, and ``Optional[T]`` where one of two is None."""
    t = F.col(types) if isinstance(types, str) else types
    rest = F.array_remove(t, "None")
    text = F.array_join(rest, " | ")
    return F.when(F.size(rest) == 0, "None").when(F.array_contains(t, "None"), F.concat(F.lit("Optional["), text, F.lit("]"))).otherwise(text)
