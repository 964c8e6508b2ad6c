"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in DataFrame functions only.

A text's paragraphs are its lines, long ones cut after the last sentence end within ``PIECE`` characters; each version of a text has a sketch of
the set of their 64-bit digests, of ``TABLES`` tables. A digest falls into one cell of each table, and a cell holds
a count, the XOR of its digests and the XOR of their checks. Two sketches are subtracted cell by cell, which leaves the digests in which
the versions differ. Peeling takes, table by table in turn, the digests that stand alone in a cell out of the other tables; if
anything is left after ``CYCLES`` turns, both versions are sketched again with ``GROWTH`` times as many cells, until
nothing is left. The likeness is the Jaccard index of the paragraphs: both sizes are sums of the sketches' counts, and the difference is what was peeled.

A document's fingerprint is the size and a 128-bit digest of its sketch at the first size (``FIRST_CELLS`` cells a table), over all cells with their places.

Documents are dealt out once, by ranges of their ids, as many as the rows need; sketching, subtracting and peeling all aggregate within the partition of a range, as the
digests are kept in files bucketed by range.

Nulls and odd rows: a null text counts as empty; two empty texts have likeness 1. Equal texts have equal fingerprints. Rows
with a null ``doc_id`` come first, in the order of a hash of their texts. Repeated rows stay; rows of one id are ordered by text. An empty table gives no rows. Columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import scratch, shuffle_partitions, table

PIECE = 128
PATTERN = rf"[^\n]{{0,{PIECE - 1}}}[.!?\n]|[^\n]{{1,{PIECE}}}"
TABLES = 3
#: Cells of each table at the first try of peeling, and the growth of a retry.
FIRST_CELLS = 40
GROWTH = 8
#: Turns of peeling over all tables at one size.
CYCLES = 4
#: Rows of one range of ids, in which neighbours are found, about.
RANGE_ROWS = 50
#: Percentiles of ids that go through the driver at most; what lies between two is cut evenly into as many ranges as the rows need.
COARSE = 2000

KEY = ["r", "rn", "kind"]


def digests(text: str):
    """The set of 64-bit paragraph digests of a text column."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), lambda p: F.xxhash64(p)))


def with_range(docs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``r``, which rises with doc_id, and ``c`` (the same for ranges between two percentiles): ranges between percentiles, each cut evenly; null ids by a hash of their text."""
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    count = seen.n // range_rows
    coarse = min(COARSE, count)
    fine, nulls = max(1, -(-count // COARSE)), max(1, seen.nulls // range_rows)
    null = f"-1L - pmod(xxhash64(text), {nulls}L)"
    row = None
    if coarse > 1:
        row = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10 * coarse).alias("p")).first()
    if row is None or not row.p:
        return docs.withColumn("r", F.expr(f"IF(doc_id IS NULL, {null}, 0L)")).withColumn("c", F.expr(f"IF(doc_id IS NULL, -1 - CAST(pmod(xxhash64(text), {nulls}L) DIV 64 AS INT), 0)"))
    ends = sorted(set(row.p))
    steps = [1 << b for b in range(len(ends).bit_length() - 1, -1, -1)]
    at = f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) -> IF(lo + s <= {len(ends)} AND ends[least(lo + s, {len(ends)}) - 1] <= doc_id, lo + s, lo))"
    out = docs.withColumn("ends", F.lit([int(x) for x in ends])).withColumn("c", F.expr(at))
    low, high = "ends[greatest(c, 1) - 1]", f"ends[least(c, {len(ends) - 1})]"
    part = f"IF(c BETWEEN 1 AND {len(ends) - 1}, least({fine - 1}L, CAST(floor({fine} * (CAST(doc_id AS DOUBLE) - {low}) / greatest(1, {high} - {low})) AS BIGINT)), 0L)"
    out = out.withColumn("r", F.expr(f"IF(doc_id IS NULL, {null}, c * {fine}L + {part})")).withColumn("c", F.expr("IF(doc_id IS NULL, -1 - CAST((-1L - r) DIV 64 AS INT), c)"))
    return out.select(*docs.columns, "r", "c")


def range_before(ranges: DataFrame) -> DataFrame:
    """r and last_r: the range before each of ``ranges`` (r, c; once each), before the first the last.

    Within a ``c`` by a window of its ranges; only the first and last ranges of every ``c`` meet in one place.
    """
    within = Window.partitionBy("c").orderBy("r")
    inner = ranges.select("c", "r", F.lag("r").over(within).alias("last_r"))
    borders = ranges.groupBy("c").agg(F.min("r").alias("r"), F.max("r").alias("top"), F.lit(1).alias("one"))
    whole = Window.partitionBy("one").orderBy("r")
    borders = borders.select("r", F.coalesce(F.lag("top").over(whole), F.max("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last_r"))
    return inner.filter("last_r IS NOT NULL").select("r", "last_r").union(borders)


def with_next(docs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """r, rn, doc_id, text and next_text: the text of the next document by doc_id, after the last that of the first."""
    rows = with_range(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), range_rows=range_rows)
    by = Window.partitionBy("r").orderBy("doc_id", "text")
    rows = rows.select("r", "c", F.row_number().over(by).alias("rn"), "doc_id", "text", F.lead("text").over(by).alias("after"))
    firsts = rows.filter("rn = 1").select(F.col("r").alias("first_r"), F.col("text").alias("first_text"))
    before = range_before(rows.groupBy("r").agg(F.min("c").alias("c")))
    firsts = firsts.join(before, F.col("first_r") == F.col("r")).select("last_r", "first_text")
    both = rows.join(firsts, F.expr("r = last_r AND after IS NULL"), "left")
    return both.select("r", "rn", "doc_id", "text", F.coalesce("after", "first_text").alias("next_text"))


def sketched(rows: DataFrame, cells: int, keys: list[str]) -> DataFrame:
    """Sketches of ``rows`` (``keys``, digests: an array): keys, cell, n, x, c of every cell that is not empty."""
    place = [f"pmod(xxhash64(x, {j}), {cells}) + {j * cells}" for j in range(TABLES)]
    d = rows.select(*keys, F.explode("digests").alias("x"))
    d = d.select(*keys, "x", F.expr("xxhash64(x, 77)").alias("c"), F.explode(F.expr(f"array({', '.join(place)})")).alias("cell"))
    return d.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(c)").alias("c"))


def subtracted(signed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that differ, of sketches (keys, sign, cell, n, x, c): those with sign 1 less those with sign -1."""
    out = signed.groupBy(*keys, "cell").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(c)").alias("c"))
    return out.filter("n <> 0 OR x <> 0 OR c <> 0")


def peel(cells_left: DataFrame, cells: int, keys: list[str] = KEY) -> DataFrame:
    """keys, rest (cells that are left), found (digests and sides recovered) of differences of sketches (keys, cell, n, x, c)."""
    cell = lambda x, j: f"pmod(xxhash64({x}, {j}), {cells}) + {j * cells}"

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "got", "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(c)").alias("c")).filter("n <> 0 OR x <> 0 OR c <> 0")

    now = cells_left.select(*keys, F.lit(False).alias("got"), F.col("cell").cast("long").alias("cell"), F.col("n").cast("long").alias("n"), "x", "c")
    same = "struct(got, cell, n, x, c)"
    for turn in range(CYCLES * TABLES):
        j = turn % TABLES
        others = [f"struct(false AS got, {cell('x', o)} AS cell, -n AS n, x, c)" for o in range(TABLES) if o != j]
        alone = f"NOT got AND cell >= {j * cells} AND cell < {(j + 1) * cells} AND abs(n) = 1 AND c = xxhash64(x, 77)"
        taken = f"array(struct(true AS got, x AS cell, n, x, c), {', '.join(others)})"
        now = summed(now.select(*keys, F.explode(F.expr(f"IF({alone}, {taken}, array({same}))")).alias("o")).select(*keys, "o.*"))
    return now.groupBy(*keys).agg(F.sum(F.when(F.col("got"), 0).otherwise(1)).alias("rest"), F.collect_list(F.expr("IF(got, struct(cell AS digest, n AS side), NULL)")).alias("found"))


#: Versions: 0 the text, 1 the edited text, 2 the next text. Pairs (kinds): 0 text and edited, 1 text and next.
VERSIONS = "array(struct(0 AS v, own AS digests), struct(1 AS v, edit AS digests), struct(2 AS v, next AS digests))"
PAIRS = "CASE v WHEN 0 THEN array(struct(0 AS kind, 1 AS sign), struct(1 AS kind, 1 AS sign)) WHEN 1 THEN array(struct(0 AS kind, -1 AS sign)) ELSE array(struct(1 AS kind, -1 AS sign)) END"


def version_sketches(kept: DataFrame, cells: int, *, also: list[str] | None = None) -> DataFrame:
    """Sketches r, rn, v, cell, n, x, c (and the columns ``also``, of a document) of the versions of ``kept`` (r, rn, own, edit, next: digests)."""
    keys = ["r", "rn", *(also or [])]
    return sketched(kept.select(*keys, F.inline(F.expr(VERSIONS))), cells, [*keys, "v"])


def differences(kept: DataFrame, *, first_cells: int = FIRST_CELLS) -> list[DataFrame]:
    """r, rn, kind, found of all pairs of versions that differ: one table for each size that was tried.

    A pair whose sketches are equal is in none of the tables.
    """
    spark = kept.sparkSession
    # The kinds that are still open stand with each document (bit k for kind k), so a retry picks documents before they are sketched.
    done, cells, rows = [], first_cells, kept.withColumn("open", F.lit(3))
    while True:
        signed = version_sketches(rows, cells, also=["open"]).withColumn("p", F.explode(F.expr(PAIRS))).filter("shiftright(open, p.kind) & 1 = 1")
        path = scratch(spark, "peeled")
        peel(subtracted(signed.select("r", "rn", "p.kind", "p.sign", "cell", "n", "x", "c"), KEY), cells).write.parquet(path)
        tried = spark.read.parquet(path)
        done.append(tried.filter("rest = 0").select(*KEY, "found"))
        failed = tried.filter("rest > 0").groupBy("r", "rn").agg(F.expr("bit_or(shiftleft(1, kind))").alias("open"))
        if failed.isEmpty():
            return done
        rows, cells = kept.join(failed, ["r", "rn"]), cells * GROWTH


def fingerprints(sketches: DataFrame, cells: int, keys: list[str]) -> DataFrame:
    """keys, size, fingerprint of sketches of ``cells`` cells a table: the size and two XORs of hashes of all cells with their places."""
    xor = lambda seed: F.lpad(F.lower(F.hex(F.expr(f"bit_xor(xxhash64(cell, n, x, c, {seed}))"))), 16, "0")
    size = F.sum(F.when(F.col("cell") < cells, F.col("n")).otherwise(0))
    return sketches.groupBy(*keys).agg(size.alias("size"), F.concat(size.cast("string"), F.lit("-"), xor(1), xor(2)).alias("fingerprint"))


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` in the shared folder, bucketed by ``r`` as the shuffle by ``r`` has dealt them. The catalog's entry is only needed to read them so, and goes."""
    spark = rows.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(shuffle_partitions(spark), "r").option("path", scratch(spark, name)).saveAsTable(unique)
    out = spark.table(unique)
    out.schema  # resolved with its buckets
    spark.sql(f"DROP TABLE {unique}")
    return out


def likeness(docs: DataFrame, *, range_rows: int = RANGE_ROWS, first_cells: int = FIRST_CELLS) -> DataFrame:
    """The contract's columns for every row of ``docs``: each document against its edited text and against the next document."""
    half = "CAST(n_chars DIV 2 AS INT)"
    rows = with_next(docs, range_rows=range_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, CAST(n_chars AS INT) - {half}), left(next_text, {half}))"))
    kept = bucketed(
        rows.select("r", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("edit"), digests("next_text").alias("next")),
        "paragraphs",
    )
    found = None
    for part in differences(kept, first_cells=first_cells):
        part = part.select(*KEY, F.size("found").alias("delta"))
        found = part if found is None else found.union(part)
    delta = found.groupBy("r", "rn").agg(F.sum(F.when(F.col("kind") == 0, F.col("delta"))).alias("d0"), F.sum(F.when(F.col("kind") == 1, F.col("delta"))).alias("d1"))
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    prints = fingerprints(version_sketches(kept, first_cells), first_cells, ["r", "rn", "v"]).groupBy("r", "rn").agg(
        of(0, "size").alias("s0"), of(1, "size").alias("s1"), of(2, "size").alias("s2"), of(0, "fingerprint").alias("f0"), of(1, "fingerprint").alias("f1")
    )
    both = kept.select("r", "rn", "doc_id", "n_chars", "edited_sha256").join(prints, ["r", "rn"], "left").join(delta, ["r", "rn"], "left")
    both = both.na.fill(0, ["s0", "s1", "s2", "d0", "d1"])
    # An empty version has no cells.
    empty = "0-" + "0" * 32

    def near(size: str, d: str):
        total = F.col("s0") + F.col(size)
        return F.when(total == 0, 1.0).otherwise((total - F.col(d)) / (total + F.col(d)))

    return both.select("doc_id", "n_chars", "edited_sha256", F.coalesce("f0", F.lit(empty)).alias("fingerprint"), F.coalesce("f1", F.lit(empty)).alias("edited_fingerprint"), near("s1", "d0").alias("near_edited"), near("s2", "d1").alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likeness(table(spark, sf_dir, "documents"))
