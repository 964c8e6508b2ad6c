"""A training-data pipeline of five stages over ``documents``: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_templates, mixing, near_copies, quality_rules, sentencepiece_nbest, simhash
from graphloom.llm.shared import stored, table

#: The mixture's tokens as a share of its input's; without repetition, so that it can only leave out surplus of sources.
MIX_SHARE = (9, 10)
MIX_EPOCHS = 1
#: Bytes of an Arrow batch that goes to a Python worker, about. Spark's 64 MB are held several times over by executor and worker, in every task.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``ARROW_BYTES``, from here on; a bound of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, str(ARROW_BYTES))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    small_batches(spark)
    return quality_rules.keep_content(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across them."""
    out = line_templates.drop_recurring_lines(docs).drop("__n_lines", "__n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: op8's SimHash links, and a similarity of 0.8 on five-word shingles, which lies beyond its three bits."""
    small_batches(spark)
    return simhash.keep_first(docs, near_copies.near_copies(docs, simhash.near_duplicates(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take."""
    return mixing.mixed(docs, mixing.weight_table(spark), share=MIX_SHARE, max_epochs=MIX_EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its best segmentations."""
    import public_tokenizers

    small_batches(spark)
    return sentencepiece_nbest.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The line labelling and the encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
