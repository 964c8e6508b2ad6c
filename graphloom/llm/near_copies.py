"""Near copies: groups of documents linked by a Jaccard similarity of at least ``SIMILARITY`` on distinct five-word shingles.

At that similarity 64-bit SimHash fingerprints lie ten bits apart on average, which is beyond what variants of segments can index. So
candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which two sets at 0.8 miss every one with a chance
of (1 - 0.8 ** 4) ** 40 = 7e-10, and less above. The exact Jaccard of every candidate pair that can matter is then computed.

Documents with equal shingles are one set. In each key's bucket all sets are first compared with the bucket's smallest and largest. Buckets that
these links leave with several components are open; their sets are compared by prefixes: with the shingles of every set in one order, the rare ones
first, two sets at 0.8 or more share one so near to both their beginnings that what follows it can still make up the overlap. No such pair is left
out, and sets that are alike by less, however many, meet only where they share rare shingles. Pairs within a component can't change it.
Before two sets are a row they are told apart by their parity sketches: ``BITS`` bits of which each shingle flips one, so that two sketches never differ in more
bits than the sets have shingles that only one of them holds, and too many differing bits prove a similarity below 0.8. In a group of n sets that stay
apart but share the places where they differ, the pairs that are looked at in this way can still grow with n * n, as a pair at 0.75 can't be told from
one at 0.8 without looking; the rows that are made, shuffled and compared are those near 0.8 or above. A shingle's sets are dealt to as many tasks as they need.

Nulls and odd rows: texts of up to five words are one shingle, null and empty texts have none and are copies of each other. Rows with a
null ``doc_id`` link others but stand for none. Repeated rows are all returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import meet, small, stored
from graphloom.llm.simhash import shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 4
#: Bits of a parity sketch.
BITS = 512
#: Sets that share a shingle and meet in one task, at most about.
MEETING = 2048
#: Shingles that are hashed at once.
CHUNK = 4096
#: Classes of shingles whose counts are sent to all executors. They only order the shingles: more classes save candidates, and results are equal.
CLASSES = 1 << 20
#: The hashes of up to so many texts of sets with company are sent to all executors (two numbers each); more meet the texts by a shuffle.
WANTED_ROWS = 2_000_000

_rng = np.random.default_rng(17)
_FLIP, _FACTOR = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTOR |= np.uint64(1)
_MIX = _rng.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.asarray(shingle_hashes(text, SHINGLE), np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(own), CHUNK):
        np.minimum(least, ((own[a : a + CHUNK, None] ^ _FLIP) * _FACTOR).min(0), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least[:, k]) * _MIX[k]
        keys ^= keys >> np.uint64(29)
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        names, keys = [], []
        for text in batch.column("text"):
            own = shingles(text.as_py())
            names.append(xxh64_intdigest(own.tobytes(), 7))
            keys.append(band_keys(own).view(np.int64) if len(own) else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "name", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t.as_py()) for t in batch.column("text")]
        longs = lambda rows: pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("name"), longs(own), longs([parity(o) for o in own]), pa.array([len(o) for o in own], pa.int64())], ["name", "own", "sketch", "n"])


def _class_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall in each of the classes."""
    found = sets.select(F.explode("own").alias("s")).groupBy(F.pmod("s", F.lit(CLASSES)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[found.column("class").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) and shingles, in the common order, of those that a set at the similarity can share first; none that only this set has."""
    often = counts[own % CLASSES]
    order = np.lexsort((own, often))[: len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1]
    places = np.flatnonzero(often[order] > 1)
    return places, own[order[places]]


def parity(own: np.ndarray) -> np.ndarray:
    """``BITS`` bits in longs: whether an odd number of a set's shingles falls on each."""
    odd = np.bincount((own >> np.uint64(44)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefix_rows(open_sets: DataFrame) -> DataFrame:
    """name, c, n (size of the set), place and shingle: the prefix of each set."""
    counts = open_sets.sparkSession.sparkContext.broadcast(_class_counts(open_sets))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cs = batch.column("name").to_numpy(), batch.column("c").to_numpy()
            for i, own in enumerate(batch.column("own")):
                own = own.values.to_numpy()
                places, found = prefix(own, counts.value)
                fill = lambda v: pa.array(np.full(len(found), v, np.int64))
                yield pa.RecordBatch.from_arrays([fill(names[i]), fill(cs[i]), fill(len(own)), pa.array(places.astype(np.int64)), pa.array(found)], ["name", "c", "n", "place", "shingle"])

    return open_sets.select("name", "c", "own").mapInArrow(rows, "name long, c long, n long, place long, shingle long")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = [parity(own.values.to_numpy().view(np.uint64)).view(np.int64) for own in batch.column("own")]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sketches, pa.list_(pa.int64()))], ["name", "sketch"])


#: Whether the parity sketches of two sets x and y (sketch, n) leave a similarity of ``SIMILARITY`` open.
NEAR = f"{1 + SIMILARITY} * ({' + '.join(f'bit_count(x.sketch[{i}] ^ y.sketch[{i}])' for i in range(BITS // 64))}) <= {1 - SIMILARITY} * (x.n + y.n) + 1e-6"


def prefix_pairs(open_sets: DataFrame) -> DataFrame:
    """Pairs a < b of sets (name, c, own) with other ``c`` that can have the similarity, and all that do."""
    rows = stored(_prefix_rows(open_sets), "prefixes")
    # The classes say little of large tables; only what sets of several components hold can make a pair, and only that is dealt out with its sketch.
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    shared = shared.select("shingle", F.expr(f"1 + k div {MEETING}").alias("parts"))
    kept = stored(rows.join(shared, "shingle"), "shared-prefixes")
    told = open_sets.join(kept.select("name").distinct(), "name", "left_semi").select("name", "own").mapInArrow(_sketched, "name long, sketch array<long>")
    rows = stored(kept.join(told, "name"), "sketched-prefixes")
    enough = f"{1 + SIMILARITY} * least(x.n - x.place, y.n - y.place) >= {SIMILARITY} * (x.n + y.n) - 1e-6"
    left = rows.withColumn("part", F.expr("pmod(xxhash64(name), parts)")).alias("x")
    right = rows.withColumn("part", F.expr("explode(sequence(0L, parts - 1))")).alias("y")
    met = left.join(right, F.expr(f"x.shingle = y.shingle AND x.part = y.part AND x.c <> y.c AND x.name < y.name AND {enough} AND {NEAR}"))
    return met.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that parity sketches don't tell apart, so that few whole sets are sent about."""
    told = sets.select("name", "sketch", "n")
    both = pairs.join(told.alias("x"), F.expr("a = x.name")).join(told.alias("y"), F.expr("b = y.name"))
    return both.filter(F.expr(NEAR)).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets have the similarity."""
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("own").alias("y")), "b")
    both = both.filter("least(size(x), size(y)) >= 0.79 * greatest(size(x), size(y))").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return both.filter(F.col("n") >= SIMILARITY * (F.col("m") - F.col("n"))).select("a", "b")


def _known(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """a < b: the sets of each group of texts, each with the smallest of its group."""
    named = stored(rows.select("h", "name").distinct().join(groups.select("h", F.col("component").alias("known")).distinct(), "h").select("known", "name").distinct(), "known-groups")
    first = stored(named.groupBy("known").agg(F.min("name").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("known", "a"), "first-sets")
    return meet(named, first, "known", spread="name").filter("a < name").select("a", F.col("name").alias("b"))


def near_copies(docs: DataFrame, groups: DataFrame | None = None, *, wanted_rows: int = WANTED_ROWS) -> DataFrame:
    """doc_id, h, component (never null) and component_id (smallest doc_id reachable over pairs with the similarity) of every row.

    ``groups``: h and component of texts that count as linked whatever their similarity, such as those of ``simhash.near_duplicates``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(_sketch, "doc_id long, h long, name long, keys array<long>"), "sketches")
    once = stored(rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "distinct-sets")
    buckets = once.select("name", F.explode("keys").alias("key"))
    ends = buckets.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low < high")
    members = stored(buckets.join(ends, "key"), "buckets")
    stars = members.select("name", F.explode(F.array("low", "high")).alias("end")).filter("name <> end")
    stars = stars.select(F.least("name", "end").alias("a"), F.greatest("name", "end").alias("b")).distinct()
    # One text of each set that has company.
    wanted = stored(rows.join(members.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("h").alias("h")), "wanted-sets")
    sets = stored(texts.join(small(wanted, wanted_rows), "h").select("name", "text").dropDuplicates(["name"]).mapInArrow(_sets, "name long, own array<long>, sketch array<long>, n long"), "sets")

    links = _alike(_near(stars, sets), sets)
    links = stored(links if groups is None else links.unionByName(_known(rows, groups)), "links")
    labels = stored(components(links), "labels")
    open_ = members.select("key", "name").join(labels, F.col("name") == F.col("node"), "left").select("key", "name", F.coalesce("component", "name").alias("c"))
    mixed = open_.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("h")).filter("l < h").select("key")
    unsettled = stored(open_.join(mixed, "key", "left_semi").select("name", "c").distinct(), "unsettled-sets")
    rest = prefix_pairs(stored(sets.select("name", "own").join(unsettled, "name"), "open-sets"))
    more = rest.join(stars, ["a", "b"], "left_anti")
    labels = stored(components(links.unionByName(_alike(more, sets))), "labels")

    grouped = once.join(labels, F.col("name") == F.col("node"), "left").select("name", "least", F.coalesce("component", "name").alias("component"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    told = stored(grouped.join(firsts, "component").select("name", "component", "component_id"), "set-components")
    return meet(rows.select("doc_id", "h", "name"), told, "name", spread=["doc_id", "h"]).select("doc_id", "h", "component", "component_id")
