"""Line dedup by a fixed-depth template tree, in DataFrame functions only.

Digits are variable fields in every line. The tree leads by the number of tokens and then by the first ``DEPTH`` tokens (one
with a variable field counts as ``<*>``) to a leaf. Templates are of two kinds:

* a masked line as a whole, which recurs if it stands in at least ``MIN_DOCS`` different texts (``LONG_DOCS`` for lines of
  ``LONG_TOKENS`` tokens or more);
* a general form of a leaf. The tokens after the leading ones are up to ``RUNS`` fields: one token each, or runs of about equal length
  if there are more. A field's value is constant if at least ``FORM_LINES`` different masked lines of the leaf have it there, and variable
  otherwise. Lines with the same constant values at the same places have one form, so a leaf can hold any number of forms. A form needs
  a variable field; of single tokens one in five of the line may be variable (one at least), of runs a half. It
  recurs if ``FORM_LINES`` masked lines of ``FORM_DOCS`` different texts have it.

Lines of recurring templates are dropped everywhere but where the template stands first (smallest doc_id, then line). Exact copies of one document
count once for a template, so copies alone make no template recur. Near copies count apart.

Constant values and forms are counted on masked lines, each once, so a line that fills a third of all rows is one row there. Templates meet the lines by
broadcast, if there are few, or by salted keys.

Nulls and odd rows: a null text stays null, an empty one empty; lines without a word stay. Rows with a null ``doc_id`` come first in order. Repeated rows are all kept and treated alike. Empty
tables give no rows. Columns of the input pass through whatever their names, but for ``__n_lines`` and ``__n_dropped``, which are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import meet, stored, table

DEPTH = 2
RUNS = 8
MIN_TOKENS = 1
MIN_DOCS = 3
LONG_TOKENS, LONG_DOCS = 50, 2
FORM_DOCS, FORM_LINES = 20, 4
#: Lines of fewer tokens have no general form.
FORM_TOKENS = 4

FIELDS = [f"f{i}" for i in range(RUNS)]


def parsed_lines(docs: DataFrame) -> DataFrame:
    """__id, __h, __pos, leaf, lh (hash of the masked line), n (tokens), fields (their hashes; null for none) of every line with a word."""
    # The hash is taken before texts are cut, so once for a text and not once for a line.
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"), F.split("text", "\n", -1).alias("lines"))
    lines = texts.select("__id", "__h", F.posexplode("lines").alias("__pos", "line")).filter(r"line RLIKE '[^\\x20\\x09-\\x0D]'")
    spaced = F.regexp_replace("line", "[0-9]+", "<*>")
    for c in "\t\r\x0b\x0c":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    tokens = lines.select("__id", "__h", "__pos", F.array_remove(F.split(spaced, " ", -1), "").alias("tokens")).withColumn("n", F.size("tokens"))
    lead = [F.when(F.expr(f"contains(get(tokens, {i}), '<*>')"), "<*>").otherwise(F.get("tokens", F.lit(i))) for i in range(DEPTH)]
    # One lambda and not RUNS expressions, which make more code than the JVM compiles.
    at = lambda i: f"IF(rest <= {RUNS}, least({i}, rest), CAST(floor(rest * ({i}) / {RUNS}) AS INT))"
    field = f"CAST(xxhash64(slice(tokens, {DEPTH + 1} + {at('i')}, {at('i + 1')} - {at('i')})) & 2147483647L AS INT)"
    fields = F.expr(f"IF(n >= {FORM_TOKENS}, transform(sequence(0, least(rest, {RUNS}) - 1), i -> {field}), NULL)")
    tokens = tokens.withColumn("rest", F.greatest(F.col("n") - DEPTH, F.lit(1)))
    return tokens.select("__id", "__h", "__pos", F.xxhash64("n", *lead).alias("leaf"), F.xxhash64("tokens").alias("lh"), "n", fields.alias("fields"))


def general_forms(lines: DataFrame, *, form_lines: int = FORM_LINES) -> DataFrame:
    """lh, form: the form of every masked line that has one in common with others of its leaf."""
    columns = lines.filter("fields IS NOT NULL").select("lh", "leaf", "n", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)])
    once = columns.groupBy("lh").agg(*[F.min(c).alias(c) for c in ("leaf", "n", *FIELDS)])  # equal in all rows of a masked line
    once = stored(once, "masked-lines")
    leaves = stored(once.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= form_lines).select("leaf"), "leaves")
    once = meet(once, leaves, "leaf", spread="lh")
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(1 << i).alias("bit"), F.xxhash64("leaf", F.lit(i), c).alias("key"))) for i, c in enumerate(FIELDS)]))
    fields = once.select("lh", "leaf", "n", F.inline(keys))
    constant = stored(fields.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= form_lines).select("key"), "constant-fields")
    found = meet(fields, constant, "key", spread="lh").groupBy("lh", "leaf", "n").agg(F.sum("bit").alias("places"), F.expr("bit_xor(key)").alias("values"), F.count(F.lit(1)).alias("k"))
    runs = F.least(F.col("n") - DEPTH, F.lit(RUNS))
    single = F.col("n") - DEPTH <= RUNS
    variable = runs - F.col("k")
    found = found.filter((variable > 0) & F.when(single, variable <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).otherwise(variable * 2 <= RUNS))
    found = stored(found.select("lh", F.xxhash64("leaf", "places", "values").alias("form")), "line-forms")
    many = stored(found.groupBy("form").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= form_lines).select("form"), "forms")
    return meet(found, many, "form", spread="lh")


def recurring_lines(docs: DataFrame, *, min_docs: int | None = None) -> DataFrame:
    """__id, __h, __drop (positions in no order) of the documents that lose lines; ``min_docs``: one threshold for all kinds."""
    exact_docs, long_docs, form_docs = (MIN_DOCS, LONG_DOCS, FORM_DOCS) if min_docs is None else (min_docs,) * 3
    lines = stored(parsed_lines(docs), "lines")
    places = lines.select("__id", "__h", "__pos", "lh")
    whole = lines.groupBy("lh", "n", "__h").agg(F.lit(1).alias("one")).groupBy("lh", "n").agg(F.count("one").alias("texts"))
    whole = stored(whole.filter(F.col("texts") >= F.when(F.col("n") >= LONG_TOKENS, long_docs).otherwise(exact_docs)).select("lh"), "recurring-masked-lines")
    exact = meet(places, whole, "lh", spread=["__id", "__pos"]).select("__id", "__h", "__pos", F.col("lh").alias("template"), F.lit(0).alias("kind"))

    forms = stored(general_forms(lines), "general-forms")
    alike = stored(meet(places, forms, "lh", spread=["__id", "__pos"]).select("__id", "__h", "__pos", F.col("form").alias("template"), F.lit(1).alias("kind")), "lines-with-forms")
    often = alike.groupBy("template", "__h").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("one").alias("texts")).filter(F.col("texts") >= form_docs).select("template")
    hits = exact.unionByName(meet(alike, stored(often, "recurring-forms"), "template", spread=["__id", "__pos"]).select(exact.columns))

    # A line of a general form that also recurs as it is counts by the form, so that one of the form's lines stays.
    of_line = hits.groupBy("__id", "__h", "__pos").agg(F.max(F.struct("kind", "template")).alias("t"))
    of_line = stored(of_line.select("__id", "__h", "__pos", "t.kind", "t.template"), "recurring-lines")
    first = of_line.groupBy("kind", "template").agg(F.min(F.struct("__id", "__pos", "__h")).alias("f")).select("f.*")
    stay = first.groupBy("__id", "__h").agg(F.collect_set("__pos").alias("stay"))
    drop = of_line.groupBy("__id", "__h").agg(F.collect_set("__pos").alias("all"))
    out = drop.alias("d").join(stay.alias("s"), F.expr("d.__id <=> s.__id AND d.__h = s.__h"), "left")
    out = out.select("d.__id", "d.__h", F.expr("CASE WHEN s.stay IS NULL THEN d.`all` ELSE array_except(d.`all`, s.stay) END").alias("__drop"))
    return out.filter("size(__drop) > 0")


def drop_recurring_lines(docs: DataFrame, *, min_docs: int | None = None) -> DataFrame:
    """``docs`` without recurring lines, and the columns ``__n_lines`` and ``__n_dropped``."""
    drop = recurring_lines(docs, min_docs=min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    both = rows.join(drop, F.expr("id <=> __id AND h = __h"), "left").withColumn("lines", F.split("row.text", "\n", -1))
    # The lines between two dropped ones are one slice, so the work is in proportion to the lines.
    both = both.withColumn("bounds", F.expr("concat(array(-1), sort_array(__drop), array(size(lines)))"))
    rest = "array_join(flatten(transform(sequence(0, size(__drop)), j -> slice(lines, bounds[j] + 2, bounds[j + 1] - bounds[j] - 1))), '\n')"
    text = F.expr(f"CASE WHEN __drop IS NULL THEN row.text ELSE {rest} END")
    return both.select(
        F.col("row").withField("text", text).alias("row"), F.expr("CASE WHEN row.text IS NULL THEN 0L ELSE CAST(size(lines) AS BIGINT) END").alias("__n_lines"),
        F.expr("CASE WHEN __drop IS NULL THEN 0L ELSE CAST(size(__drop) AS BIGINT) END").alias("__n_dropped"),
    ).select("row.*", "__n_lines", "__n_dropped")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and remaining text of every document."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")
