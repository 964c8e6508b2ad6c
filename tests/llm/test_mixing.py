import hashlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from graphloom.llm import mixing


def fill(budget, children):
    """children: (cap, weight). Exact water-filling by rounds."""
    got, open_ = [0] * len(children), {i for i, (_, w) in enumerate(children) if w > 0}
    while open_:
        total = sum(children[i][1] for i in open_)
        full = {i for i in open_ if Fraction(children[i][0]) <= budget * children[i][1] / total}
        if not full:
            for i in open_:
                got[i] = int(budget * children[i][1] / total)
            break
        for i in full:
            got[i] = children[i][0]
            budget -= children[i][0]
        open_ -= full
    return got


def brute(rows, weights, share, max_epochs):
    """rows: (doc_id, domain, lang, source, tokens) -> copies by doc_id."""
    w = lambda level, name: Fraction(weights.get((level, name), 1))
    leaves = defaultdict(int)
    for _, *leaf, t in rows:
        leaves[tuple(leaf)] += t
    budgets = {(): Fraction(sum(leaves.values()) * share[0] // share[1])}
    for depth, level in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, b in budgets.items():
            names = sorted({k[depth] for k in leaves if k[:depth] == parent})
            caps = [sum(t for k, t in leaves.items() if k[: depth + 1] == (*parent, n)) * max_epochs for n in names]
            new.update({(*parent, n): Fraction(x) for n, x in zip(names, fill(b, [(c, w(level, n)) for c, n in zip(caps, names)]))})
        budgets = new
    out = {}
    for leaf, b in budgets.items():
        own = [(r[0], r[4]) for r in rows if tuple(r[1:4]) == leaf]
        epochs, rest = divmod(int(b), max(1, leaves[leaf]))
        total, going = 0, rest > 0
        for d, t in sorted(own, key=lambda r: (hashlib.md5(f"{mixing.SEED}:{epochs}:{r[0]}".encode()).hexdigest(), r[0])):
            total += t
            going = going and total <= rest
            if epochs + going:
                out[d] = epochs + going
    return out


@pytest.mark.parametrize("digits, levels, share", [(2, 2, (4, 5)), (1, 1, (1, 3)), (1, 1, (9, 1))])
def test_against_brute_force(spark, digits, levels, share):
    rows = [(i, "d%d" % (i % 3), ["en", "fr"][i % 7 > 3], "s%d" % (i * i % 5), (i * 37) % 11 + (500 if i == 50 else 0)) for i in range(400)]
    docs = spark.createDataFrame([(d, a, b, c, "w " * t, "x") for d, a, b, c, t in rows], "doc_id long, domain string, lang string, source string, text string, epochs string")
    weights = spark.createDataFrame([("domain", "d0", 5.0), ("lang", "fr", 2.0), ("source", "s4", 0.0)], "level string, name string, weight double")
    got = mixing.mixed(docs, weights, domain="domain", share=share, max_epochs=2, digits=digits, levels=levels)
    assert got.columns == docs.columns
    copies = defaultdict(int)
    for r in got.collect():
        copies[r.doc_id] += 1
    assert dict(copies) == brute(rows, {("domain", "d0"): 5, ("lang", "fr"): 2, ("source", "s4"): 0}, share, 2)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None), (1, "a b c", None, None), (None, None, "en", "src1"), (3, "", "en", "src1"), (4, "d", "en", "src1")], "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, mixing.weight_table(spark), share=(1, 1), max_epochs=1).collect()
    assert sorted(r.text or "" for r in got if r.text) == ["a b c", "a b c", "d"]
    assert mixing.mixed(docs.limit(0), mixing.weight_table(spark)).count() == 0


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql(mixing.OP4_SQL).fetchall())
    assert sorted(map(tuple, mixing.op4_mixing(spark, d).collect())) == want and want
