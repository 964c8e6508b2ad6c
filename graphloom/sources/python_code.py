"""Facts of Python sources: one row for each definition, import, call, flow and metric of a file, by the standard library's parser.

``files`` has path and text; every file is parsed once, in the task that reads it. A file with a syntax error gives one row of kind ``error``.
"""

from __future__ import annotations

import ast
import io
import math
import sys
import tokenize
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

FACTS = "path string, fact string, name string, owner string, detail string, line int, value double"


def _decisions(body: list[ast.stmt]) -> int:
    """One and the decision points: branches, loops, handlers, tries, ternaries, and further operands of and/or."""
    points = 1
    for x in ast.walk(ast.Module(body, [])):
        if isinstance(x, ast.BoolOp):
            points += len(x.values) - 1
        points += isinstance(x, (ast.Try, ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp))
    return points


def nesting_cost(body: list[ast.stmt]) -> int:
    """Cognitive complexity: one for each branch, loop, try and handler, and one more for each level that it (or a ``with``) lies deeper than the second."""
    branching = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.Try, ast.ExceptHandler)
    cost, todo = 0, [(x, 0) for x in body]
    while todo:
        x, depth = todo.pop()
        nests = isinstance(x, (*branching, ast.With))
        if nests:
            cost += isinstance(x, branching) + max(0, depth - 1)
        for child in ast.iter_child_nodes(x):
            if isinstance(child, ast.ExceptHandler):
                todo.append((child, depth))  # a handler stands beside its try
            elif isinstance(child, ast.stmt):
                todo.append((child, depth + nests))
    return cost


def _dotted(x: ast.expr) -> str:
    try:
        return ast.unparse(x)
    except ValueError:
        return ""


def facts_of(path: str, text: str, kinds: Collection[str] | None = None) -> list[tuple]:
    """(path, fact, name, owner, detail, line, value) rows of one file; with ``kinds`` only facts of these, and errors."""
    wanted = lambda *names: kinds is None or any(n in kinds for n in names)
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError) as error:
        return [(path, "error", type(error).__name__, None, str(error)[:200], getattr(error, "lineno", None) or 0, None)]
    out: list[tuple] = []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def add(fact, name, owner, detail, node, value=None):
        if wanted(fact):
            out.append((path, fact, name, owner, detail, getattr(node, "lineno", 0), value))

    def function(node, owner):
        if wanted(kind := "method" if owner else "function"):
            add(kind, node.name, owner, ",".join(a.arg for a in node.args.args), node, float(_decisions(node.body)))
        if wanted("cognitive"):
            add("cognitive", node.name, owner, None, node, float(nesting_cost(node.body)))

    for node in tree.body if wanted("function", "method", "cognitive", "class", "attribute", "import", "variable") else ():
        if isinstance(node, functions):
            function(node, None)
        elif isinstance(node, ast.ClassDef):
            add("class", node.name, None, ",".join(map(_dotted, node.bases)), node)
            for child in node.body:
                if isinstance(child, functions):
                    function(child, node.name)
                elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name):
                    add("attribute", child.target.id, node.name, _dotted(child.annotation), child)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                add("import", alias.asname or alias.name.split(".")[0], None, alias.name, node)
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                add("import", alias.asname or alias.name, None, "." * node.level + (node.module or ""), node)
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            add("variable", node.targets[0].id, None, type(node.value).__name__, node)

    calls, flows, uses = wanted("call"), wanted("flow"), wanted("use")

    def visit(node, owner):
        for child in ast.iter_child_nodes(node):
            inner = child.name if isinstance(child, (*functions, ast.ClassDef)) else owner
            if calls and isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else _dotted(f)
                add("call", name, owner, _dotted(f.value) if isinstance(f, ast.Attribute) else None, child, float(len(child.args)))
            elif flows and isinstance(child, ast.Assign):
                for target in child.targets:
                    if isinstance(target, ast.Name):
                        for x in ast.walk(child.value):
                            if isinstance(x, ast.Name):
                                add("flow", target.id, owner, x.id, child)
            elif uses and isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                add("use", child.id, owner, None, child)
            visit(child, inner)

    if calls or flows or uses:
        visit(tree, None)
    lines = (text or "").splitlines()
    blank, comment = sum(not x.strip() for x in lines), sum(x.strip().startswith("#") for x in lines)
    for name, n in (("lines", len(lines)), ("blank", blank), ("comment", comment), ("code", len(lines) - blank - comment)):
        add("metric", name, None, None, None, float(n))
    for kind, token in _tokens(text or "") if wanted("operator", "operand") else ():
        add(kind, token, None, None, None)
    return out


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    """Operators and operands of a file."""
    import keyword

    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.OP or (t.type == tokenize.NAME and keyword.iskeyword(t.string)):
                yield "operator", t.string
            elif t.type in (tokenize.NAME, tokenize.NUMBER, tokenize.STRING):
                yield "operand", t.string
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return


def facts(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """The facts of all files; with ``kinds`` only those, so that what a caller drops (most rows are uses and tokens) is neither found nor sent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in FACTS.split(", ")]
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["text"]) for r in facts_of(p, t, kinds)]
            yield pd.DataFrame(rows, columns=columns).astype({"line": "int32", "value": "float64"})

    return files.select("path", "text").mapInPandas(run, FACTS)


def halstead(f: DataFrame) -> DataFrame:
    """path, n1, n2, big_n1, big_n2, volume, difficulty, effort from the operator and operand rows."""
    op, an = F.col("fact") == "operator", F.col("fact") == "operand"
    out = f.filter(op | an).groupBy("path").agg(F.count_distinct(F.when(op, F.col("name"))).alias("n1"), F.count_distinct(F.when(an, F.col("name"))).alias("n2"), F.count_if(op).alias("big_n1"), F.count_if(an).alias("big_n2"))
    n, length = F.col("n1") + F.col("n2"), F.col("big_n1") + F.col("big_n2")
    out = out.withColumn("volume", F.when(n > 0, length * F.log2(n.cast("double"))).otherwise(0.0)).withColumn("difficulty", F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("big_n2") / F.col("n2")).otherwise(0.0))
    return out.withColumn("effort", F.col("volume") * F.col("difficulty"))


def dead_code(f: DataFrame) -> DataFrame:
    """path, name, what, confidence: imports (0.95), private functions (0.8) and private variables (0.7) that their file never uses."""
    used = f.filter("fact IN ('use', 'call')").select("path", "name").distinct()
    private = F.col("name").startswith("_") & ~F.col("name").startswith("__")
    d = f.filter((F.col("fact") == "import") | (F.col("fact").isin("function", "variable") & private))
    confidence = F.when(F.col("fact") == "import", 0.95).when(F.col("fact") == "function", 0.8).otherwise(0.7)
    return d.join(used, ["path", "name"], "left_anti").select("path", "name", F.col("fact").alias("what"), confidence.alias("confidence"))


def hotspots(f: DataFrame, least: int = 10) -> DataFrame:
    """path, owner, name, complexity of functions and methods with at least ``least`` decisions."""
    return f.filter("fact IN ('function', 'method')").filter(F.col("value") >= least).select("path", "owner", "name", F.col("value").cast("int").alias("complexity"))


def cognitive(f: DataFrame) -> DataFrame:
    """path, owner, name, line, cost of every function and method."""
    return f.filter("fact = 'cognitive'").select("path", "owner", "name", "line", F.col("value").cast("long").alias("cost"))


def entry_points(f: DataFrame) -> DataFrame:
    """path, fact, name of public functions, methods and classes."""
    return f.filter("fact IN ('function', 'method', 'class')").filter(~F.col("name").startswith("_")).select("path", "fact", "name")


def imports(f: DataFrame) -> DataFrame:
    """path, module, origin: stdlib, local (relative, or a file of this table) or third_party."""
    top = F.split_part(F.regexp_replace("detail", r"^\.+", ""), F.lit("."), F.lit(1))
    names = F.array(F.regexp_extract("path", r"([^/]+)\.py$", 1), F.regexp_extract("path", r"^([^/]+)/", 1))  # files, and top folders
    own = f.select(F.explode(names).alias("top")).filter("top <> ''").distinct().withColumn("own", F.lit(True))
    std = F.col("top").isin(sorted(sys.stdlib_module_names))
    rows = f.filter("fact = 'import'").withColumn("top", top).join(own, "top", "left")
    return rows.select("path", F.col("detail").alias("module"), F.when(F.col("detail").startswith(".") | F.col("own"), "local").when(std, "stdlib").otherwise("third_party").alias("origin"))


def call_edges(f: DataFrame) -> DataFrame:
    """path, caller, callee, line, target_line: each call with the first definition of that name in its file, if any."""
    first = Window.partitionBy("path", "name").orderBy("line")
    defined = f.filter("fact IN ('function', 'method', 'class')").withColumn("r", F.row_number().over(first)).filter("r = 1").select("path", "name", F.col("line").alias("target_line"))
    return f.filter("fact = 'call'").join(defined, ["path", "name"], "left").select("path", F.col("owner").alias("caller"), F.col("name").alias("callee"), "line", "target_line")


def flow_edges(f: DataFrame) -> DataFrame:
    """path, source, target of assignments: names that a target's value reads."""
    return f.filter("fact = 'flow'").select("path", F.col("detail").alias("source"), F.col("name").alias("target"))


def flow_ends(f: DataFrame) -> DataFrame:
    """path, name, end: sources (nothing flows in) and sinks (nothing flows out)."""
    # Both ends of a flow come of one pass over the facts, and a name's ends meet in one aggregation.
    end = lambda c, out: F.struct("path", F.col(c).alias("name"), F.lit(out).alias("out"))
    ends = flow_edges(f).select(F.explode(F.array(end("source", True), end("target", False))).alias("x")).select("x.*")
    per = ends.groupBy("path", "name").agg(F.bool_or("out").alias("leaves"), F.bool_or(~F.col("out")).alias("enters"))
    # Rows without a path or name are nobody's match: they are ends by themselves.
    alone = F.col("path").isNull() | F.col("name").isNull()
    kinds = F.array_compact(F.array(F.when(F.col("leaves") & (alone | ~F.col("enters")), "source"), F.when(F.col("enters") & (alone | ~F.col("leaves")), "sink")))
    return per.select("path", "name", F.explode(kinds).alias("end"))


# Node kinds of language facts.
NODE_KIND_OF_FACT = {
    "python:class": "class", "python:function": "function", "python:method": "method", "python:module": "module", "python:variable": "variable", "python:parameter": "parameter", "python:decorator": "function",
    "javascript:class": "class", "javascript:function": "function", "javascript:async_function": "function", "javascript:arrow_function": "function", "javascript:method": "method", "javascript:module": "module", "javascript:variable": "variable",
    "java:class": "class", "java:interface": "class", "java:method": "method", "java:package": "module", "java:field": "variable",
    "generic:class": "class", "generic:function": "function", "generic:module": "module",
}


def normalised(f: DataFrame, language: str = "python") -> DataFrame:
    """Facts with their node kind; facts of other kinds are left out."""
    kinds = F.create_map(*[F.lit(x) for kv in NODE_KIND_OF_FACT.items() for x in kv])
    return f.withColumn("node_kind", kinds[F.concat(F.lit(f"{language}:"), "fact")]).filter("node_kind IS NOT NULL")


GRAPH_FACTS = ("class", "function", "method", "call", "import")


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of Python files: modules, classes, methods, functions; containment, calls within a file, inheritance and imports between files."""
    from graphloom.operators.graph import edge_id, node_id

    # Parsed once and stored, as five kinds of edges and the nodes come of it.
    f = stored(facts(files, GRAPH_FACTS), "code-facts")
    modules = files.select(F.col("path"), F.lit("module").alias("kind"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("qualified_name"), F.lit(None).cast("string").alias("owner"))
    modules = modules.withColumn("name", F.element_at(F.split("qualified_name", r"\."), -1))
    defined = normalised(f).filter("node_kind IN ('class', 'function', 'method')").select("path", F.col("node_kind").alias("kind"), "owner", "name")
    defined = defined.join(modules.select("path", F.col("qualified_name").alias("m")), "path").withColumn("qualified_name", F.concat_ws(".", "m", "owner", "name")).drop("m").distinct()
    every = modules.select("path", "kind", "owner", "name", "qualified_name").unionByName(defined)
    nodes = every.select(node_id(("kind", "kind"), ("repo", F.lit("")), ("path", "path"), ("qname", "qualified_name")).alias("id"), "kind", "name", "qualified_name", "path", F.lit("python").alias("language"), "owner")
    nodes = stored(nodes, "code-nodes")
    at = lambda test: nodes.filter(test)
    parts = [
        at("kind IN ('class', 'function')").alias("b").join(at("kind = 'module'").alias("a"), F.col("a.path") == F.col("b.path")).select(F.col("a.id").alias("source_id"), F.col("b.id").alias("target_id"), F.lit("contains").alias("kind")),
        at("kind = 'method'").alias("b").join(at("kind = 'class'").alias("a"), (F.col("a.path") == F.col("b.path")) & (F.col("a.name") == F.col("b.owner"))).select(F.col("a.id"), F.col("b.id"), F.lit("contains")),
        call_edges(f).alias("c").join(at("kind IN ('function', 'method')").alias("a"), (F.col("a.path") == F.col("c.path")) & (F.col("a.name") == F.col("c.caller"))).join(at("kind IN ('function', 'method', 'class')").alias("b"), (F.col("b.path") == F.col("c.path")) & (F.col("b.name") == F.col("c.callee"))).select(F.col("a.id"), F.col("b.id"), F.lit("calls")),
        f.filter("fact = 'class' AND detail <> ''").withColumn("base", F.explode(F.split("detail", ","))).alias("c").join(at("kind = 'class'").alias("a"), (F.col("a.path") == F.col("c.path")) & (F.col("a.name") == F.col("c.name"))).join(at("kind = 'class'").alias("b"), F.col("b.name") == F.col("c.base")).select(F.col("a.id"), F.col("b.id"), F.lit("inherits")),
        f.filter("fact = 'import'").select("path", F.col("detail").alias("module")).alias("i").join(at("kind = 'module'").alias("a"), F.col("a.path") == F.col("i.path")).join(at("kind = 'module'").alias("b"), F.col("b.qualified_name") == F.regexp_replace("i.module", r"^\.+", "")).select(F.col("a.id"), F.col("b.id"), F.lit("imports")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    edges = edges.groupBy("source_id", "target_id", "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return nodes.drop("owner"), edges.withColumn("id", edge_id())
