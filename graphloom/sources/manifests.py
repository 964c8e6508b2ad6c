"""Package manifests of source trees: what each package is called and depends on, by the name of the file.

pyproject.toml, setup.py, requirements.txt, package.json and Cargo.toml are read as whole texts from any store. TOML becomes JSON in a small function; everything else is a
plan. A file that can't be parsed has no metadata and no dependencies.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Manifests by file name, and extras that are for development.
NAMES = ["pyproject.toml", "setup.py", "requirements.txt", "package.json", "Cargo.toml"]
DEV_EXTRAS = ["dev", "test", "develop"]

_META = "name STRING, version STRING, description STRING"


@F.pandas_udf(StringType())
def toml_json(texts: pd.Series) -> pd.Series:
    """A TOML text as JSON; null if it can't be parsed."""
    import json
    import tomllib

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(tomllib.loads(text or ""), default=str)
        except ValueError:
            return None

    return texts.map(one)


def manifest_texts(spark: SparkSession, root: str) -> DataFrame:
    """path, manifest (its kind, a name in small letters), text of all manifests below ``root``."""
    glob = "{%s}" % ",".join(NAMES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("manifest"), F.decode("content", "UTF-8").alias("text"))


def requirement(line: Column) -> Column:
    """name, version, is_local of a requirement line; null if it is none. ``-e`` with a path is a local package named by its last part."""
    line = F.trim(line)
    place = F.regexp_extract(line, r"^-e\s+((?:file:|\.).*)$", 1)
    name = F.regexp_extract(line, r"^([A-Za-z0-9._-]+)", 1)
    version = F.nullif(F.trim(F.regexp_replace(line, r"^[A-Za-z0-9._-]+", "")), F.lit(""))
    as_row = lambda n, v, local: F.struct(n.alias("name"), v.alias("version"), F.lit(local).alias("is_local"))
    local = as_row(F.element_at(F.split(place, "/"), -1), F.lit(None).cast("string"), True)
    return F.when(place != "", local).when(name != "", as_row(name, version, False))


def _setup_list(text: Column) -> Column:
    """The requirements of a Python list's source: separated by commas, without quotes."""
    return F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, "^[\\s'\"]+|[\\s'\"]+$", ""))


def _parsed(texts: DataFrame) -> DataFrame:
    toml = F.when(F.col("manifest").isin("pyproject.toml", "cargo.toml"), toml_json("text"))
    rows = texts.withColumn("toml", toml)
    project = F.from_json("toml", "project STRUCT<name: STRING, version: STRING, description: STRING, dependencies: ARRAY<STRING>, `optional-dependencies`: MAP<STRING, ARRAY<STRING>>>")["project"]
    cargo = F.from_json("toml", "package STRUCT<name: STRING, version: STRING, description: STRING>, dependencies MAP<STRING, STRING>, `dev-dependencies` MAP<STRING, STRING>")
    node = F.from_json("text", f"{_META}, dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>")
    is_ = lambda kind, c: F.when(F.col("manifest") == kind, c)
    return rows.withColumns({"project": is_("pyproject.toml", project), "cargo": is_("cargo.toml", cargo), "node": is_("package.json", node)})


def packages(texts: DataFrame) -> DataFrame:
    """path, manifest, name, version, description of manifests (path, manifest, text); requirements.txt has none of the three."""
    rows = _parsed(texts)
    said = lambda key: F.when(F.col("manifest") == "setup.py", F.nullif(F.regexp_extract("text", key + "\\s*=\\s*[\"']([^\"']+)[\"']", 1), F.lit("")))
    of = lambda key: F.coalesce(F.col("project")[key], F.col("cargo.package")[key], F.col("node")[key], said(key)).alias(key)
    return rows.select("path", "manifest", of("name"), of("version"), of("description"))


def dependencies(texts: DataFrame) -> DataFrame:
    """path, manifest, name, version, is_dev, is_local of all dependencies of manifests (path, manifest, text)."""
    rows, parts = _parsed(texts), []
    key = ["path", "manifest"]

    def lines(df: DataFrame, array: Column, dev: Column) -> None:
        each = df.select(*key, F.explode(array).alias("line"), dev.alias("is_dev"))
        parts.append(each.select(*key, requirement(F.col("line")).alias("d"), "is_dev").filter("d IS NOT NULL").select(*key, "d.name", "d.version", "is_dev", "d.is_local"))

    def named(df: DataFrame, mapping: str, dev: bool) -> None:
        each = df.select(*key, F.explode(F.col(mapping)).alias("name", "spec"))
        version = F.when(F.col("spec").startswith("{"), F.get_json_object("spec", "$.version")).otherwise(F.col("spec"))
        parts.append(each.select(*key, "name", version.alias("version"), F.lit(dev).alias("is_dev"), F.lit(False).alias("is_local")))

    py = rows.filter("project IS NOT NULL")
    lines(py, F.col("project.dependencies"), F.lit(False))
    extras = py.select(*key, F.explode(F.col("project")["optional-dependencies"]).alias("extra", "list"))
    lines(extras, F.col("list"), F.col("extra").isin(DEV_EXTRAS))
    plain = rows.filter("manifest = 'requirements.txt'").withColumn("lines", F.filter(F.transform(F.split("text", "\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#")))
    lines(plain, F.col("lines"), F.lit(False))
    setup = rows.filter("manifest = 'setup.py'")
    found = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    lines(setup, _setup_list(found("text", r"(?s)install_requires\s*=\s*\[(.*?)\]")), F.lit(False))
    extra = setup.withColumn("extras", found("text", r"(?s)extras_require\s*=\s*\{(.*?)\}"))
    for name in DEV_EXTRAS:
        lines(extra, _setup_list(found("extras", rf"(?s)[\"']?{name}[\"']?\s*:\s*\[(.*?)\]")), F.lit(True))
    named(rows, "cargo.dependencies", False)
    named(rows.withColumn("dev", F.col("cargo")["dev-dependencies"]), "dev", True)
    named(rows, "node.dependencies", False)
    named(rows, "node.devDependencies", True)
    return reduce(DataFrame.unionByName, parts)
