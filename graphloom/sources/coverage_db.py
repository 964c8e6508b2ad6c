"""Coverage databases (SQLite files of a coverage tool) as a Spark source.

``CoverageDatabases`` is a Python data source, ``spark.read.format("coverage_db")`` after ``register``: a partition is a range of file ids in one database, so a
large database is read by many tasks, and conditions on ``file`` (equality, IN) are evaluated by the database. Its folder must be mounted on all executors.
``coverage_databases`` reads databases from any store that Spark reads, each as a whole.

Both give database, context, file, line for every covered line. The lines come from bitmaps (``line_bits``) or, in older databases, from plain rows (``line``). Files that
aren't such databases have no rows, unless the option ``broken`` is ``fail``. A line that several contexts cover has a row for each.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "database string, context string, file string, line int"
#: Ids of files in one partition, and names of files in one condition at most.
FILES, NAMES = 5000, 500
_HEAD = b"SQLite format 3\0"


def covered_lines(numbits: bytes | None) -> np.ndarray:
    """Lines of a bitmap: bit b of byte k stands for line 8 k + b."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(numbits or b"", np.uint8), bitorder="little")).astype(np.int32)


def _batches(con: sqlite3.Connection, database: str, where: str, values: list) -> Iterator[pa.RecordBatch]:
    """A batch for each file and context of one database; ``where`` is a condition on ``f.id`` and ``f.path``."""
    tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    if "file" not in tables:
        return
    kind = "line_bits" if "line_bits" in tables else "line" if "line" in tables else None
    if kind is None:
        return
    columns = {r[1] for r in con.execute(f"PRAGMA table_info({kind})")}
    named = "context" in tables and "context_id" in columns
    context = ("c.context", "LEFT JOIN context c ON c.id = b.context_id") if named else ("''", "")
    what = "b.numbits" if kind == "line_bits" else "b.lineno"
    rows = con.execute(f"SELECT f.path, {context[0]}, {what} FROM file f JOIN {kind} b ON b.file_id = f.id {context[1]} WHERE {where} ORDER BY f.id", values)
    for path, of, x in rows:
        lines = covered_lines(x) if kind == "line_bits" else np.array([x], np.int32)
        n = len(lines)
        yield pa.RecordBatch.from_arrays([pa.array([database] * n, pa.string()), pa.array([of or ""] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array(lines)], ["database", "context", "file", "line"])


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


class _Part(InputPartition):
    def __init__(self, database: str, low: int, high: int):
        self.database, self.low, self.high = database, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.files = int(options.get("filesperpartition", FILES))
        self.strict = options.get("broken", "skip") == "fail"
        self.wanted: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is None or f.attribute != ("file",) or self.wanted is not None or len(values) > NAMES:
                yield f
            else:
                self.wanted = [v for v in values if v is not None]

    def _databases(self) -> Iterator[str]:
        if os.path.isfile(self.root):
            yield self.root
        for folder, _, names in sorted(os.walk(self.root)):
            yield from (os.path.join(folder, n) for n in sorted(names) if fnmatch(n, self.pattern))

    def partitions(self) -> list[_Part]:
        out = []
        for path in self._databases():
            with open(path, "rb") as f:
                if f.read(len(_HEAD)) != _HEAD:
                    if self.strict:
                        raise ValueError(f"{path} is no database")
                    continue
            low, high = 0, 0
            try:
                con = _open(path)
                low, high = con.execute("SELECT min(id), max(id) FROM file").fetchone()
                con.close()
            except sqlite3.DatabaseError:
                if self.strict:
                    raise
            if high is not None and low is not None:
                out += [_Part(path, a, a + self.files) for a in range(low, high + 1, self.files)]
        return out or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.database:
            return
        where, values = "f.id >= ? AND f.id < ?", [part.low, part.high]
        if self.wanted is not None:
            where += f" AND f.path IN ({', '.join('?' * len(self.wanted))})"
            values += self.wanted
        try:
            con = _open(part.database)
            yield from _batches(con, part.database, where, values)
            con.close()
        except sqlite3.DatabaseError:
            if self.strict:
                raise


class CoverageDatabases(DataSource):
    """Options: path (a database or a folder), pattern (of file names), filesPerPartition, broken (skip or fail)."""

    @classmethod
    def name(cls) -> str:
        return "coverage_db"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CoverageDatabases)


def coverage_databases(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """The same rows of all databases below ``path``, in any store that Spark reads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                if data.startswith(_HEAD):
                    con = sqlite3.connect(":memory:")
                    try:
                        con.deserialize(data)
                        yield from _batches(con, name.as_py(), "1", [])
                    except sqlite3.DatabaseError:
                        pass
                    con.close()

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "content").mapInArrow(rows, SCHEMA)
