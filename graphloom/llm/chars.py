"""Characters of whole corpora as small codes, and counts of windows of codes.

The most frequent characters have codes of their own. All others are spelled in their UTF-8 bytes, each byte with a code, so that texts
of any script stay distinct: a text is a row of symbols, of which a character is one or up to four.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 9
CODES = 1 << BITS
#: Bytes of UTF-8 texts are 0 to 244.
BYTES = 245
#: Characters with codes of their own at most: the codes but for the outside of a text, the bytes and unknown characters.
OWN = CODES - BYTES - 2
#: Characters that are handled at once, about; a longer text is handled whole.
GROUP_CHARS = 2_000_000


@dataclass(frozen=True)
class Alphabet:
    """Codes: 0 outside of a text, then ``characters``, then one for unknown characters, or the bytes if the corpus has more characters."""

    characters: tuple[int, ...]
    spelled: bool

    @property
    def size(self) -> int:
        return 1 + len(self.characters) + (BYTES if self.spelled else 1)

    def table(self) -> np.ndarray:
        """Code of each code point; 0 for those that are spelled."""
        codes = np.full(0x110000, 0 if self.spelled else 1 + len(self.characters), np.uint16)
        codes[list(self.characters)] = np.arange(1, 1 + len(self.characters))
        return codes


def groups(texts: Iterable, chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) with about as many characters in all."""
    group, size = [], 0
    for x in texts:
        group.append(x or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in groups(batch.column("text").to_pylist()):
            found = np.bincount(points(group), minlength=1)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["c", "n"])


def alphabet(docs: DataFrame, own: int = OWN) -> Alphabet:
    """The ``own`` most frequent characters of all documents (ties: the smaller first); all others are spelled."""
    counts = docs.select("text").mapInArrow(_char_counts, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    found = [r.c for r in counts.orderBy(F.desc("n"), "c").limit(own + 1).collect()]
    return Alphabet(tuple(found[:own]), len(found) > own)


def symbols(texts: list[str], codes: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts, and how many each text has. ``first_byte``: the code of byte 0."""
    at = points(texts)
    out, sizes = codes[at], np.array([len(x) for x in texts], np.int64)
    if out.all():
        return out, sizes
    spelled = out == 0
    width = np.where(spelled, 1 + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000), 1).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(width)))
    line = np.zeros(int(ends[-1]), np.uint16)
    line[ends[:-1][~spelled]] = out[~spelled]
    for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        here = spelled & (width == n)
        c, place = at[here].astype(np.int64), ends[:-1][here]
        line[place] = first_byte + (lead | c >> 6 * (n - 1))
        for k in range(1, n):
            line[place + k] = first_byte + (0x80 | c >> 6 * (n - 1 - k) & 0x3F)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return line, np.diff(ends[bounds])


def windows(texts: list[str], letters: Alphabet, codes: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each symbol (its own code and those of its neighbours, first to last), and the symbols of each text. ``codes``: the alphabet's table."""
    own, sizes = symbols(texts, codes, 1 + len(letters.characters))
    pad = max(before, after)
    starts = np.concatenate(([0], np.cumsum(sizes + pad)))[:-1] + pad
    line = np.zeros(int(sizes.sum() + pad * (len(texts) + 1)), np.uint16)
    total = int(sizes.sum())
    place = np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    line[place] = own
    keys = np.zeros(total, np.int64)
    for k in range(-before, after + 1):
        keys <<= BITS
        keys |= line[place + k]
    return keys, sizes


def _window_counts(letters: Alphabet, before: int, after: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letters.table()
        for batch in batches:
            for group in groups(batch.column("text").to_pylist()):
                keys, _ = windows(group, letters, codes, before, after)
                place, unique = pd.factorize(keys)
                yield pa.RecordBatch.from_arrays([pa.array(unique, pa.int64()), pa.array(np.bincount(place, minlength=len(unique)), pa.int64())], ["key", "n"])

    return run


def window_counts(docs: DataFrame, letters: Alphabet, before: int, after: int) -> DataFrame:
    """key, n: how often each window occurs in all of ``docs``."""
    return docs.select("text").mapInArrow(_window_counts(letters, before, after), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def summed_by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; 0 for empty ones."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
    return out
