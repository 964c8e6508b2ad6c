"""Audit of how far sources of one language diverge, by an inverted index with baseline corrections.

Terms are counted for each (language, source) in one pass over the texts; a language keeps the terms of at least ``MIN_DOCS`` of its documents.
Every group gives each of the V kept terms a smoothed probability p in billionths, and two groups differ by the sum over the terms of
f(p, q) = floor((p - q)^2 / (p + q)). Most counts are zero, so a pair of groups starts at V * f(p0, q0) of its two zero counts, and only postings
(counts above zero) correct that:

* a posting against a zero count, f(p, q0) - f(p0, q0), depends on the posting's count alone: these are summed from the
  histogram of each group's counts, not term by term;
* where a term has postings in both groups, the two corrections above are replaced by the true value.

The sums of both kinds are aggregated before they are shuffled; a term's postings are at most as many as the language has sources, and the pairs of
sources are the result. The terms that stand out in a group against its language are ranked by a window that keeps the first ``TOP`` in each task.

Nulls and odd rows: null text, lang and source are read as ''. Groups without any term are in the result (with pairs, without terms). Repeated
rows count as documents of their own. An empty table gives no rows, a language with one source no pairs. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import ascii_words
from graphloom.llm.shared import meet, stored, table

MIN_DOCS = 10
TOP = 10
#: Added to every count.
SMOOTHING = 2
#: Distinct terms that a task holds before it hands on its counts.
HELD_TERMS = 200_000

_LETTERS = ascii_words.table(ascii_words.LETTERS)
#: A count of occurrences and one of documents in one number.
_DOC = 1 << 44


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = {}

    def rows() -> pa.RecordBatch:
        """All that is held, and for each group a row without a term."""
        langs, sources, terms, counts, docs = [], [], [], [], []
        for (lang, source), own in held.items():
            n = len(own) + 1
            langs += [lang] * n
            sources += [source] * n
            terms += [None, *own]
            counts += [0, *(v % _DOC for v in own.values())]
            docs += [0, *(v // _DOC for v in own.values())]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            own = held.setdefault((lang.as_py(), source.as_py()), {})
            before, found = len(own), Counter()
            for piece in ascii_words.words(text.as_py(), _LETTERS):
                found.update(piece)
            get = own.get
            for term, n in found.items():
                own[term] = get(term, 0) + n + _DOC
            size += len(own) - before
            if size >= HELD_TERMS:
                yield rows()
                size = 0
    if held:
        yield rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); each group also has a row with a null term."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + SMOOTHING) / total), exact; 1 where there are no terms."""
    return F.expr(f"1 + coalesce(CAST({n} + {SMOOTHING} AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0)) div nullif({total}, 0), 0)")


def difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def index(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Stored: the groups (lang, source, v, total, p0, lang_total) and the postings of kept terms (lang, source, term, n, p, p0, q)."""
    counted = stored(counts(docs), "term-counts")
    term = Window.partitionBy("lang", "term")
    kept = counted.filter("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("d"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("once"))
    kept = stored(kept.filter(F.col("d") >= min_docs).drop("d"), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("once").cast("long")).alias("v"))
    sums = counted.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "v"])
    langs = sums.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    groups = sums.select("lang", "source", "n").join(langs, "lang").withColumn("total", F.expr(f"n + {SMOOTHING} * v")).withColumn("lang_total", F.expr(f"lang_n + {SMOOTHING} * v"))
    groups = stored(groups.select("lang", "source", "v", "total", "lang_total", probability("0", "total").alias("p0")), "source-groups")
    postings = meet(kept, groups, ["lang", "source"], spread="term")
    return groups, stored(postings.select("lang", "source", "term", "n", probability("n", "total").alias("p"), "p0", probability("lang_n", "lang_total").alias("q")), "postings")


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b, value for each two sources a < b of a language."""
    own = groups.select("lang", "source", "v", "p0")
    other = own.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    start = own.join(other, "lang").filter("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.expr(f"v * {difference('p0', 'q0')}").alias("value"))
    alone = postings.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").filter("source <> other")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.expr(f"m * ({difference('p', 'q0')} - {difference('p0', 'q0')})").alias("value")).filter("value <> 0")
    x, y = postings.alias("x"), postings.alias("y")
    both = x.join(y, F.expr("x.lang = y.lang AND x.term = y.term AND x.source < y.source"))
    change = f"{difference('x.p', 'y.p')} - {difference('x.p', 'y.p0')} - {difference('x.p0', 'y.p')} + {difference('x.p0', 'y.p0')}"
    both = both.select("x.lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.expr(change).alias("value")).filter("value <> 0")
    return start.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: the other sources of the language, and the terms that stand out in the source."""
    groups, postings = index(docs, min_docs=min_docs)
    pairs = pair_values(groups, postings)
    sides = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    parts = [
        sides.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(first).alias("rank")),
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(first).alias("rank")).filter(F.col("rank") <= top),
    ]
    return parts[0].unionByName(parts[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT d.lang, count(DISTINCT kept.term) AS v FROM d LEFT JOIN kept USING (lang) GROUP BY d.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
m AS (SELECT g.lang, g.source, any_value(v.v) AS v, coalesce(sum(c.n), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
l AS (SELECT lang, sum(n) AS n FROM m GROUP BY lang),
full_ AS (SELECT m.lang, m.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT // (m.n + 2 * m.v)::HUGEINT AS p FROM m JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(x.n) + 2)::HUGEINT // (any_value(l.n) + 2 * any_value(v.v))::HUGEINT AS q FROM full_ x JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM full_ x JOIN full_ y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM full_ JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER FROM ranked WHERE rank <= 10
"""
