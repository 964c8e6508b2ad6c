"""Runtime traces and coverage: call sequences, call graphs, timings, hot paths, and joins of lines to spans.

Events: seq (order of ingestion), name, ph (B, E or X), ts, dur (microseconds), pid, tid. All order ties end at ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

THREAD = ["pid", "tid"]


def chrome_events(df: DataFrame) -> DataFrame:
    """Defaults for missing fields: ph X, ts, dur, pid and tid 0, name empty."""
    return df.na.fill({"ph": "X", "ts": 0, "dur": 0, "pid": 0, "tid": 0, "name": ""})


def _ordered(events: DataFrame) -> DataFrame:
    return events.filter("ph IN ('B', 'E', 'X')").withColumn("o", F.expr("CASE ph WHEN 'B' THEN 0 WHEN 'X' THEN 1 ELSE 2 END"))


def call_sequences(events: DataFrame) -> DataFrame:
    """pid, tid, calls: names of B and X events by (ts, B before X before E)."""
    rows = _ordered(events).filter("ph <> 'E'")
    return rows.groupBy(*THREAD).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "o", "seq", "name"))), lambda x: x["name"]).alias("calls"))


def with_depth(events: DataFrame, *, by_ts_only: bool = False) -> DataFrame:
    """Adds ``depth``: open B events before this one. An E without an open B leaves the depth at 0.

    The depth is the running sum of +1 and -1 above its running minimum, so unmatched ends do not go below 0.
    """
    order = ["ts", "seq"] if by_ts_only else ["ts", "o", "seq"]
    upto = Window.partitionBy(*THREAD).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _ordered(events).withColumn("d", F.expr("CASE ph WHEN 'B' THEN 1 WHEN 'E' THEN -1 ELSE 0 END"))
    rows = rows.withColumn("s", F.sum("d").over(upto)).withColumn("low", F.least(F.lit(0), F.min("s").over(upto)))
    # after the event; a B stands at the depth before it
    return rows.withColumn("after", F.col("s") - F.col("low")).withColumn("depth", F.expr("CASE ph WHEN 'B' THEN after - 1 ELSE after END"))


def call_graph(events: DataFrame) -> DataFrame:
    """caller, callee, n: at each B or X event the caller is the innermost open B of its thread."""
    rows = with_depth(events)
    upto = Window.partitionBy(*THREAD, "level").orderBy("ts", "o", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # each B is the possible caller of events one level deeper; both meet in one window by level
    opens = rows.filter("ph = 'B'").withColumn("level", F.col("depth") + 1).withColumn("opener", F.col("name")).withColumn("event", F.lit(False))
    calls = rows.filter("ph <> 'E'").withColumn("level", F.col("depth")).withColumn("opener", F.lit(None).cast("string")).withColumn("event", F.lit(True))
    both = opens.unionByName(calls).withColumn("caller", F.last("opener", ignorenulls=True).over(upto))
    return both.filter("event AND level > 0 AND caller IS NOT NULL").groupBy("caller", F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"))


def durations(events: DataFrame) -> DataFrame:
    """name, us of each X event and of each B with the E that closes it (last in, first out, whatever the E's name)."""
    x = events.filter("ph = 'X'").select("name", F.col("dur").cast("double").alias("us"))
    rows = with_depth(events.filter("ph <> 'X'"), by_ts_only=True).withColumn("level", F.expr("CASE ph WHEN 'B' THEN after ELSE after + 1 END"))
    then = Window.partitionBy(*THREAD, "level").orderBy("ts", "seq")
    pairs = rows.withColumn("end_ph", F.lead("ph").over(then)).withColumn("end_ts", F.lead("ts").over(then)).filter("ph = 'B' AND end_ph = 'E'")
    return x.union(pairs.select("name", (F.col("end_ts") - F.col("ts")).cast("double")))


def timing(events: DataFrame) -> DataFrame:
    """name, n, min_ms, max_ms, mean_ms."""
    ms = F.col("us") / 1000
    return durations(events).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("mean_ms"))


def hot_paths(events: DataFrame, *, top: int = 10, longest: int = 7) -> DataFrame:
    """path, n: the most frequent runs of 2 to ``longest`` consecutive calls of a thread (ties: by path).

    Windows over the ordered calls give the runs without collecting a thread's sequence.
    """
    order = Window.partitionBy(*THREAD).orderBy("ts", "o", "seq")
    rows = _ordered(events).filter("ph <> 'E'").select("name", *[F.lead("name", k).over(order).alias(f"n{k}") for k in range(1, longest)])
    runs = [F.when(F.col(f"n{k}").isNotNull(), F.concat_ws(" > ", "name", *[f"n{i}" for i in range(1, k + 1)])) for k in range(1, longest)]
    out = rows.select(F.explode(F.array_compact(F.array(*runs))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "path").limit(top)


def sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """pid, tid, session, first_ts, last_ts, n: runs of events without a pause of over ``gap_us``."""
    w = Window.partitionBy(*THREAD).orderBy("ts", "seq")
    rows = events.withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= gap_us, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy(*THREAD, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def normal_path(path: str):
    """Slashes forward, without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def covered_spans(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """id, lines, covered, hits, rate of nodes (id, path, start_line, end_line) by coverage lines (file, line, hits) in their span."""
    n = nodes.withColumn("p", normal_path("path"))
    c = lines.withColumn("p", normal_path("file"))
    both = n.join(c, (n.p == c.p) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("covered"), F.sum("hits").alias("hits")).withColumn("rate", F.col("covered") / F.col("lines"))


def hot_functions(times: DataFrame) -> DataFrame:
    """Adds total_ms and hot: whether the total is at least that of rank max(1, n // 10) from the top."""
    # Stored: sums of doubles depend on the order in which a shuffle brings them, so the bound and the totals must come of one computation.
    t = stored(times.withColumn("total_ms", F.col("mean_ms") * F.col("n")), "totals")
    n = t.count()
    if not n:
        return t.withColumn("hot", F.lit(False))
    least = t.orderBy(F.desc("total_ms")).limit(max(1, n // 10)).agg(F.min("total_ms").alias("least"))
    return t.crossJoin(F.broadcast(least)).withColumn("hot", F.col("total_ms") >= F.col("least")).drop("least")  # one row


def summary(events: DataFrame) -> DataFrame:
    """One row: events, functions (different names), threads and categories of trace events (name, tid, cat)."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("name").alias("functions"), F.count_distinct("tid").alias("threads"), F.count_distinct("cat").alias("categories"))
