"""Token ids in ORC: integer run-length encoded lists, row indexes, Bloom filters on document ids.

``write_token_orc`` encodes documents with a byte-level BPE of the tokenizers library and writes one ORC
file per shard; shards are ranges of ``doc_id`` and rows ascend in them. Each row stores its offset
within the shard, so the global offset of a document needs only one sum per shard. ORC's writer encodes
the ids with its integer run-length encoding, keeps a row index (min and max of ``doc_id`` every
``row_index_stride`` rows) and a Bloom filter on ``doc_id`` in each stripe. Readers take stripes in
parallel, and a filter on ``doc_id`` skips stripes by statistics and Bloom filters.

Special tokens' strings in a text get the special tokens' ids, as the library's ``encode`` gives them.

Nulls and odd rows: a null text counts as empty (only the end id is written). Rows with a null
``doc_id`` come first. Repeated rows are kept, ordered by ``doc_id`` and then text. An empty table gives
an empty dataset. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import scratch, shuffle_partitions

#: Chunks whose token ids do not depend on what stands around them: words of Latin letters with the space
#: before them, closing punctuation, else all up to the next space.
CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?![\w'])| ?[.,;:!?*#$%&|]+(?=\s|\Z)| ?[^ ]+| ")
#: Runs of white space that chunks would cut differently; such texts are encoded as one piece.
SPACES = re.compile(r"\s (?:\s|\Z)")
#: Entries a worker keeps at most: about 100 MB for words of usual length.
CACHE = 500_000
#: Longer chunks are encoded but not kept.
CACHED_CHARS = 64

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000

SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, tokens array<int>"


class ChunkEncoder:
    """Encodes whole texts; ids of frequent chunks are looked up, all others come from the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library gives a special token's string in a text the token's own id. Texts that hold one are encoded as one piece.
        names = sorted({x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content})
        self.whole = re.compile("|".join([SPACES.pattern, *map(re.escape, names)]))
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        if len(known) >= CACHE:
            known.clear()
        split = [[x] if self.whole.search(x) else CHUNK.findall(x) for x in texts]
        new = list({c for chunks in split for c in chunks if c not in known})
        long: dict[str, bytes] = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (known if len(c) <= CACHED_CHARS and len(known) < CACHE else long)[c] = np.asarray(e.ids, "<u4").tobytes()
        if not long:
            get = known.__getitem__
            return [b"".join(map(get, chunks)) for chunks in split]
        return [b"".join(known[c] if c in known else long[c] for c in chunks) for chunks in split]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _groups(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about as many characters in all; a text is never cut."""
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode_shard(tokenizer_path: str, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text").to_pylist()):
                ids = [x + end for x in enc.encode(group)]
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.cumsum(counts)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard, np.int32)), batch.column("doc_id").slice(at, len(ids)), pa.array(start + ends - counts), pa.array(counts), lists],
                    ["shard", "doc_id", "local_start", "n_tokens", "tokens"],
                )
                at += len(ids)
                start += int(ends[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int, shards: int, stripe_bytes: int = STRIPE_BYTES, row_index_stride: int = ROW_INDEX_STRIDE) -> None:
    """Writes ``docs`` (doc_id, text) as token ids to ORC files at ``path``, in ascending ``doc_id`` order."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode_shard(tokenizer_path, end_id), SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, tokens; filters on doc_id reach the stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, shard_start: ids before each shard, from the count columns only (a row for each shard)."""
    sums = read_token_orc(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("shard_start"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets, values = np.asarray(lists.offsets), memoryview(np.ascontiguousarray(np.asarray(lists.values).astype("<u4", copy=False))).cast("B")
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("local_start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of an ORC dataset of token ids."""
    rows = read_token_orc(spark, path).mapInArrow(_crc, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(shard_starts(spark, path))  # a row for each shard
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all of ``documents`` to ORC in the shared folder and returns the digests read back."""
    import public_tokenizers

    path = scratch(spark, "token-orc")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_orc(docs, path, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, shards=shuffle_partitions(spark))
    return token_digests(spark, path)
