"""Types by a fixpoint against brute force."""

import random
from collections import defaultdict

from graphloom.operators.scores import rank_percentiles
from graphloom.operators.types import NUMBERS, annotation, inferred


def value(atoms, width):
    numbers = [n for n in NUMBERS if n in atoms]
    own = sorted({a for a in atoms if a not in NUMBERS} | set(numbers[-1:]))
    return ["Any"] if "Any" in atoms or len(own) > width else own


def test_fixpoint_against_all_that_reaches_a_symbol(spark):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(40)]
    known = [(rng.choice(names), rng.choice([*NUMBERS, "str", "None", "Cart", "list", "dict"])) for _ in range(22)] + [("s1", "Any"), ("s2", None), (None, "int")]
    flows = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    for width in (3, 1):
        atoms = defaultdict(set)
        for s, t in known:
            if s and t:
                atoms[s].add(t)
        for _ in names:
            for a, b in flows:
                if atoms[a]:
                    atoms[b] |= atoms[a]
        got = {r.symbol: r.types for r in inferred(spark.createDataFrame(known, "symbol string, type string"), spark.createDataFrame(flows, "source string, target string").repartition(3), width=width).collect()}
        assert got == {s: value(a, width) for s, a in atoms.items() if a} and len(got) > 15


def test_annotations(spark):
    rows = [(["int"],), (["None", "str"],), (["None"],), (["Cart", "str"],), (["Any"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "types array<string>").select(annotation("types")).collect()]
    assert got == ["int", "Optional[str]", "None", "Cart | str", "Any"]


def test_percentiles_by_rank(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, 1.5, rng.random() * 9])) for _ in range(500)] + [("c", 4.0)] * 70 + [("d", 2.0)]
    for parts in (64, 2, 1):
        got = {(r.g, r.percent): r.v for r in rank_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0, 50, 95, 100], parts=parts).collect()}
        want = {}
        for g in "abcd":
            own = sorted(v for k, v in rows if k == g and v is not None)
            want |= {(g, p): own[min(len(own) * p // 100, len(own) - 1)] for p in (0, 50, 95, 100)}
        assert got == want
