"""Readers: source trees, dependency manifests, traces and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java"}
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache"]


def source_files(spark: SparkSession, root: str, *, tests: bool = True) -> DataFrame:
    """path, language, is_test, checksum, text of files with a known extension below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(LANGUAGES)).load(root)
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)]
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    out = raw.select(F.regexp_replace("path", rf"^.*?{base}/", "").alias("path"), language.alias("language"), F.sha2("content", 256).alias("checksum"), F.decode("content", "UTF-8").alias("text"))
    out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    out = out.withColumn("is_test", F.col("path").rlike(r"(^|/)(tests?|__tests__)/|(^|/)test_|_test\.|\.spec\.|\.test\."))
    return out if tests else out.filter("NOT is_test")


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """name, version, is_local of a requirements file: comments and blank lines are skipped, ``-e`` is a local package."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("x")).filter("x <> '' AND NOT startswith(x, '#')")
    local = F.col("x").startswith("-e")
    name = F.when(local, F.trim(F.expr("substr(x, 3)"))).otherwise(F.regexp_extract("x", r"^([A-Za-z0-9._-]+)", 1))
    return rows.select(name.alias("name"), F.when(~local, F.trim(F.regexp_replace("x", r"^[A-Za-z0-9._-]+", ""))).alias("version"), local.alias("is_local"))


def package_json(spark: SparkSession, path: str) -> DataFrame:
    """name, version, is_dev of a package.json's dependencies."""
    kinds = "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("j"))
    part = lambda c, dev: rows.select(F.explode(f"j.{c}").alias("name", "version")).withColumn("is_dev", F.lit(dev))
    return part("dependencies", False).union(part("devDependencies", True))


def chrome_trace(spark: SparkSession, path: str) -> DataFrame:
    """seq, name, cat, ph, ts, dur, pid, tid of a trace file: an object with traceEvents, or a bare list."""
    one = "STRUCT<name: STRING, cat: STRING, ph: STRING, ts: BIGINT, dur: BIGINT, pid: BIGINT, tid: BIGINT>"
    rows = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"traceEvents ARRAY<{one}>")["traceEvents"], F.from_json("value", f"ARRAY<{one}>")).alias("events"))
    return rows.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")


def folded_stacks(spark: SparkSession, path: str) -> DataFrame:
    """stack (array, outermost first), leaf, n of lines ``a;b;c N``."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(.*)\s+(\d+)\s*$", 1).alias("s"), F.regexp_extract("value", r"^(.*)\s+(\d+)\s*$", 2).alias("n")).filter("s <> ''")
    return rows.select(F.split("s", ";").alias("stack"), F.element_at(F.split("s", ";"), -1).alias("leaf"), F.col("n").cast("long").alias("n"))


def perf_samples(spark: SparkSession, path: str) -> DataFrame:
    """seq, leaf: the innermost symbol of each sample of ``perf script`` output (samples are set off by blank lines)."""
    samples = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n\s*\n")).alias("seq", "sample")).filter("trim(sample) <> ''")
    return samples.select("seq", F.regexp_extract(F.get(F.split("sample", "\n"), F.lit(1)), r"^\s*[0-9a-fA-F]+\s+(\S+)", 1).alias("leaf")).filter("leaf <> ''")


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """file, line, hits, is_branch of a Cobertura report."""
    schema = "_filename STRING, lines STRUCT<line: ARRAY<STRUCT<_number: INT, _hits: INT, _branch: STRING>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    return rows.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l")).select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"), (F.coalesce("l._branch", F.lit("false")) == "true").alias("is_branch"))


def coverage_lines(bits: DataFrame) -> DataFrame:
    """file, line of covered lines from rows (file, numbits): bit b of byte k stands for line 8 k + b."""
    n = F.octet_length("numbits") * 8
    byte = "conv(hex(substr(numbits, CAST(l DIV 8 + 1 AS INT), 1)), 16, 10)"
    return bits.withColumn("l", F.explode(F.sequence(F.lit(0), n - 1))).filter(F.expr(f"shiftright(CAST({byte} AS INT), l % 8) & 1 = 1")).select("file", F.col("l").alias("line"))


def changed_files(status: DataFrame) -> DataFrame:
    """change (A, M, D, R, C), path (the new one of a rename) of ``git diff --name-status`` lines (column value)."""
    parts = F.split("value", "\t")
    return status.select(F.substring(F.get(parts, F.lit(0)), 1, 1).alias("change"), F.element_at(parts, -1).alias("path")).filter("change IN ('A', 'M', 'D', 'R', 'C')")


def patched(cached: DataFrame, new: DataFrame, changes: DataFrame, *, key: str = "path") -> DataFrame:
    """Cached rows without those of changed or deleted paths, and the new ones."""
    return cached.join(changes.select(F.col("path").alias(key)).distinct(), key, "left_anti").unionByName(new)
