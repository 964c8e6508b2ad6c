"""Communities, betweenness, flows, loops and schedules against brute force."""

import itertools
import random
from collections import defaultdict

import pytest

from graphloom.operators import betweenness, communities, flows, schedule


def edges_of(spark, pairs, weighted=False):
    rows = [(f"e{i:04}", *p[:2], p[2] if len(p) > 2 else "calls", float(p[3]) if len(p) > 3 else 1.0) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, kind string, weight double")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


# --- communities ---


def brute_modularity(pairs, of):
    w = defaultdict(float)
    for a, b, *rest in pairs:
        x = float(rest[1]) if len(rest) > 1 else 1.0
        w[a, b] += x
        w[b, a] += x
    m2 = sum(w.values())
    k = defaultdict(float)
    for (a, _), x in w.items():
        k[a] += x
    return sum(x for (a, b), x in w.items() if of[a] == of[b]) / m2 - sum(sum(k[v] for v in k if of[v] == c) ** 2 for c in set(of.values())) / m2**2


def cliques(n, size, rng):
    pairs = [(f"n{c}_{i}", f"n{c}_{j}") for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return pairs + [(f"n{c}_0", f"n{(c + 1) % n}_1") for c in range(n)] + [(f"n{rng.randrange(n)}_2", f"n{rng.randrange(n)}_3", "calls", 0.25) for _ in range(4)]


def test_communities_find_cliques_and_the_modularity_never_falls(spark):
    pairs = cliques(6, 6, random.Random(1)) + [("n0_0", "n0_0", "calls", 2.0)]
    names = {v for p in pairs for v in p[:2]} | {"alone"}
    nodes, edges = ids(spark, names), edges_of(spark, pairs)
    found, values = communities.levels(nodes, edges)
    of = {r.id: r.community for r in found.collect()}
    assert set(of) == names and of["alone"] == "alone" and all(of[c] == c for c in of.values())
    assert {frozenset(v for v in of if of[v] == c) for c in of.values()} == {frozenset(f"n{c}_{i}" for i in range(6)) for c in range(6)} | {frozenset({"alone"})}
    assert all(a < b for a, b in itertools.pairwise(values)) and values[-1] == pytest.approx(brute_modularity(pairs, of), abs=1e-12)
    assert communities.modularity(edges, found) == pytest.approx(values[-1], abs=1e-12)
    again = communities.communities(nodes.repartition(7), edges.repartition(3).orderBy("target_id"))
    assert {r.id: r.community for r in again.collect()} == of


def test_communities_of_a_random_graph_are_better_than_components_and_end(spark):
    rng = random.Random(9)
    pairs = [(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}", "calls", rng.choice([0.5, 1, 3])) for _ in range(60)]
    names = {v for p in pairs for v in p[:2]}
    found, values = communities.levels(ids(spark, names), edges_of(spark, pairs), least_gain=0)
    of = {r.id: r.community for r in found.collect()}
    assert values[-1] == pytest.approx(brute_modularity(pairs, of), abs=1e-12) and values[-1] > 0.2 and values == sorted(values)
    assert communities.communities(ids(spark, names), edges_of(spark, pairs).limit(0)).filter("id <> community").isEmpty()


def test_disjoint_moves_touch_no_community_twice_and_add_up(spark):
    moves = spark.createDataFrame([("x", "A", "B", 5), ("y", "B", "C", 4), ("z", "C", "D", 5), ("u", "E", "F", 1), ("v", "E", "G", 1)], "id string, a string, b string, gain long")
    assert sorted(r.id for r in communities._disjoint(moves).collect()) == ["u", "x", "z"]


# --- betweenness ---


def brute_betweenness(names, pairs, sources, directed):
    steps = defaultdict(set)
    for a, b in pairs:
        if a != b:
            steps[a].add(b)
            if not directed:
                steps[b].add(a)
    score = dict.fromkeys(names, 0.0)
    for s in sources:
        paths, seen, found = [[s]], {s}, defaultdict(list)
        while paths:
            longer = [[*p, v] for p in paths for v in steps[p[-1]] if v not in seen]
            seen |= {p[-1] for p in longer}
            for p in longer:
                found[p[-1]].append(p)
            paths = longer
        for all_ in found.values():
            for p in all_:
                for v in p[1:-1]:
                    score[v] += 1 / len(all_)
    n = len(names)
    return {v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_from_all_and_from_sampled_sources(spark):
    rng = random.Random(3)
    names = [f"v{i:02}" for i in range(16)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(34)]
    nodes, edges = ids(spark, names), edges_of(spark, pairs)
    for directed in (True, False):
        got = {r.id: r.score for r in betweenness.betweenness(nodes, edges, directed=directed).collect()}
        assert got == pytest.approx(brute_betweenness(names, pairs, names, directed), abs=1e-12)
    some = [r.id for r in betweenness.sampled_nodes(nodes, 5, 7).collect()]
    got = {r.id: r.score for r in betweenness.betweenness(nodes, edges, sample=5, seed=7).collect()}
    assert got == pytest.approx(brute_betweenness(names, pairs, some, True), abs=1e-12)
    whole = brute_betweenness(names, pairs, names, True)
    assert max(abs(got[v] - whole[v]) for v in names) <= betweenness.error_bound(16, 5)
    assert {r.score for r in betweenness.betweenness(nodes, edges.limit(0)).collect()} == {0.0}


# --- flows and loops ---


def all_paths(pairs, sources, sinks, longest=99):
    steps, out = defaultdict(set), []
    for a, b in pairs:
        if a != b:
            steps[a].add(b)

    def walk(path, sink):
        if path[-1] == sink:
            out.append((path[0], sink, path))
        elif len(path) < longest:
            for v in steps[path[-1]]:
                if v not in path:
                    walk([*path, v], sink)

    for s, t in itertools.product(sources, sinks):
        walk([s], t)
    return sorted(out)


def test_taint_paths_with_cycles_and_dead_ends(spark):
    rng = random.Random(6)
    names = [f"v{i:02}" for i in range(11)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(22)] + [("in1", "v01"), ("in2", "v02"), ("v03", "out1"), ("v04", "out2"), ("in1", "dead"), ("in1", "out1")]
    edges = edges_of(spark, pairs)
    got = lambda **a: sorted((r.source, r.sink, r.path) for r in flows.taint_paths(edges, **a).collect())
    sources, sinks = {a for a, _ in pairs} - {b for _, b in pairs}, {b for _, b in pairs} - {a for a, _ in pairs}
    assert got() == all_paths(pairs, sources, sinks) and len(got()) > 3
    given = {"sources": ids(spark, ["v01", "v03", "in2", "nowhere"]), "sinks": ids(spark, ["v03", "out2"])}
    assert got(**given) == all_paths(pairs, ["v01", "v03", "in2"], ["v03", "out2"])
    assert got(**given, max_nodes=4) == all_paths(pairs, ["v01", "v03", "in2"], ["v03", "out2"], 4)
    assert flows.taint_paths(edges.limit(0)).count() == 0


def test_loops(spark):
    rng = random.Random(8)
    pairs = [(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}", rng.choice(["calls", "reads", "contains"])) for _ in range(26)] + [("t1", "t2", "calls"), ("v0", "t1", "calls")]
    edges = edges_of(spark, pairs)
    for kinds in (None, ["calls", "reads"]):
        kept = {(a, b) for a, b, k in pairs if kinds is None or k in kinds}
        steps = defaultdict(set)
        for a, b in kept:
            steps[a].add(b)
        want = set()

        def walk(path, steps=steps, want=want):
            for v in steps[path[-1]]:
                if v == path[0]:
                    want.add((*path, v))
                elif v > path[0] and v not in path and len(path) < 5:
                    walk([*path, v])

        for v in list(steps):
            walk([v])
        got = [tuple(r.loop) for r in flows.feedback_loops(edges, kinds=kinds, max_nodes=5).collect()]
        assert sorted(got) == sorted(want) and (want or kinds)
        assert flows.has_loops(edges, kinds=kinds) == bool(want)
    assert not flows.has_loops(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c")]))
    assert flows.has_loops(edges_of(spark, [("a", "a")])) and not flows.has_loops(edges_of(spark, [("a", "a", "contains")]))


# --- schedules ---


def test_longest_and_critical_paths(spark):
    rng = random.Random(4)
    names = [f"s{i:02}" for i in range(20)]
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.2 and b != "s19"]
    duration = {n: rng.choice([1.0, 2.0, 5.0]) for n in names if n != "s07"}
    steps = defaultdict(list)
    for a, b in pairs:
        steps[a].append(b)

    def longest(v):
        best = max([(longest(w)[0], [-ord(c) for c in w], w) for w in steps[v]], default=None)
        return (duration.get(v, 1.0) + (best[0] if best else 0.0), best and best[2])

    d = spark.createDataFrame([*duration.items(), ("s99", None)], "stage string, duration double")
    links = spark.createDataFrame(pairs, "source_stage string, target_stage string")
    got = {r.stage: (r.length, r.next) for r in schedule.longest_paths(d, links).collect()}
    assert got == {**{v: longest(v) for v in names}, "s99": (1.0, None)}
    walk, at = [], min(names, key=lambda v: (-longest(v)[0], v))
    while at:
        walk.append(at)
        at = longest(at)[1]
    rows = sorted((r.position, r.stage, r.remaining) for r in schedule.critical_path(d, links).collect())
    assert rows == [(i, v, longest(v)[0]) for i, v in enumerate(walk)] and len(walk) > 3
    two = schedule.critical_path(d, links, spark.createDataFrame([("s05",), (walk[0],)], "stage string"))
    assert sorted(r.stage for r in two.filter("entry = '%s'" % walk[0]).collect()) == sorted(walk)
    with pytest.raises(ValueError, match="cycle"):
        schedule.longest_paths(d, links.union(spark.createDataFrame([(walk[-1], walk[0])], links.schema)))
    with pytest.raises(ValueError, match="itself"):
        schedule.longest_paths(d, spark.createDataFrame([("a", "a")], links.schema))


def brute_greedy(names, pairs):
    out, into = defaultdict(list), {b for _, b, *_ in pairs}
    for i, (a, b, _, w) in enumerate(pairs):
        out[a].append((-w, i, b))
    visited, best = set(), []
    for e in sorted(n for n in names if n not in into):
        path, at = [], e
        while at in names and at not in visited:
            visited.add(at)
            path.append(at)
            at = min(out[at])[2] if out[at] else None
        best = path if len(path) > len(best) else best
    return best


def test_greedy_walks_share_what_they_visit(spark):
    for seed in range(4):
        rng = random.Random(seed)
        names = [f"v{i:02}" for i in range(24)]
        pairs = [(rng.choice(names), rng.choice(names[6:] + ["gone"] * (seed % 2)), "calls", rng.choice([1, 2, 3])) for _ in range(40)]
        got = [r.id for r in schedule.greedy_critical_path(ids(spark, names), edges_of(spark, pairs)).orderBy("position").collect()]
        assert got == brute_greedy(set(names), pairs)
    chain = [(f"c{i:03}", f"c{i + 1:03}", "calls", 1) for i in range(60)]
    assert schedule.markov_order(ids(spark, [f"c{i:03}" for i in range(61)]), edges_of(spark, chain)) == 60
    assert schedule.markov_order(ids(spark, ["a"]), edges_of(spark, chain).limit(0)) == 1


def brute_groups(stages, links, near):
    order, taken, out = sorted(stages, key=lambda s: (s[1], s[0])), set(), []
    for s, t in order:
        if s in taken:
            continue
        group = [s]
        taken.add(s)
        for o, u in order:
            if o not in taken and abs(u - t) < near and (s, o) not in links and (o, s) not in links:
                group.append(o)
                taken.add(o)
        if len(group) > 1:
            out += [(s, x) for x in group]
    return sorted(out)


def test_parallel_groups_are_the_greedy_ones(spark):
    for seed, near in ((1, 0.1), (2, 0.1), (3, 0.35)):
        rng = random.Random(seed)
        stages = [(f"s{i:02}", rng.choice([0.0, 0.05, 0.09, 0.15, 0.18, 0.4, 0.45, 2.0, 2.0, 7.5])) for i in range(30)]
        links = {(f"s{rng.randrange(30):02}", f"s{rng.randrange(30):02}") for _ in range(60)}
        links = {(a, b) for a, b in links if a != b}
        got = schedule.parallel_groups(spark.createDataFrame(stages, "stage string, start double"), spark.createDataFrame(sorted(links), "source_stage string, target_stage string"), near=near)
        assert sorted((r.leader, r.stage) for r in got.collect()) == brute_groups(stages, links, near)
    none = spark.createDataFrame([], "stage string, start double")
    assert schedule.parallel_groups(none, spark.createDataFrame([], "source_stage string, target_stage string")).count() == 0
