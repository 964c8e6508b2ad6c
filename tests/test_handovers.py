"""The traversal queries over all hand-overs of a small table of events, against brute force."""

import shutil
from collections import defaultdict

import pytest

from graphloom.operators import components
from graphloom.plans.path_queries import QUERIES, hand
from graphloom.plans.projection import TABLES

#: Consecutive users of one event type; event ids are odd and even, and two parts are not connected.
USERS = [("a", [10, 20, 30, 10, 40, 40, 50]), ("b", [70, 80, 90]), ("c", [50, 60])]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d, rows = str(tmp_path_factory.mktemp("events")), []
    for kind, users in USERS:
        rows += [(len(rows) + i, u, kind, i * 1500) for i, u in enumerate(users)]  # some in one stretch, some in the next
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts long").write.parquet(f"{d}/events.parquet")
    for t in TABLES:
        if t != "events":  # read, but not used
            shutil.copytree(f"{d}/events.parquet", f"{d}/{t}.parquet")
    edges = {(f"u{a}", f"u{b}") for _, users in USERS for a, b in zip(users, users[1:])}
    return d, edges


def reach(steps, start):
    """Distance and smallest shortest path of all that can be reached."""
    seen, level = {start: [start]}, [start]
    while level:
        found = {}
        for u in level:
            for w in steps[u]:
                if w not in seen:
                    found[w] = min(found.get(w, [*seen[u], w]), [*seen[u], w])
        seen |= found
        level = list(found)
    return seen


def test_traversals_take_all_handovers_and_all_starts(spark, small):
    d, edges = small
    nodes = {x for e in edges for x in e}
    both, one = defaultdict(set), defaultdict(set)
    for a, b in edges:
        one[a].add(b)
        both[a].add(b)
        both[b].add(a)
    trees, out = {v: reach(both, v) for v in nodes}, {v: set(reach(one, v)) for v in nodes}
    rows = lambda name: [tuple(r) for r in QUERIES[name](spark, d).collect()]
    assert dict(rows("weakly_connected_components")) == {v: min(trees[v]) for v in nodes}
    strong = {v: min(w for w in out[v] if v in out[w]) for v in nodes}
    assert dict(rows("strongly_connected_components")) == strong
    assert {r[0] for r in rows("nodes_on_cycles")} == {v for v in nodes if v in one[v] or list(strong.values()).count(strong[v]) > 1}
    far = sorted((s, v, len(p) - 1) for s in nodes for v, p in trees[s].items())
    g = hand(spark, d)
    assert sorted(map(tuple, components.distances(g.nodes, g.edges, g.nodes).collect())) == far
    assert sorted(rows("bfs_distances")) == far
    assert sorted(rows("neighbourhood")) == [r for r in far if r[2] <= 2]
    directed = {(s, v) for s in nodes for v in out[s]}
    assert {(r.source, r.id) for r in components.distances(g.nodes, g.edges, g.nodes, directed=True).collect()} == directed
    chains = defaultdict(list)
    for s, v, k in far:
        if k <= 3:
            chains[s, k].append(v)
    assert sorted(rows("dependency_chain")) == sorted((s, k, ",".join(sorted(v))) for (s, k), v in chains.items())
    assert sorted(rows("shortest_paths")) == sorted(("u50", v, ">".join(p)) for v, p in trees["u50"].items())  # the only user that is asked for
    every = sorted((r.source, r.id, tuple(r.path)) for r in components.bfs_trees(g.edges, g.nodes).collect())
    assert every == sorted((s, v, tuple(p)) for s in nodes for v, p in trees[s].items())
    true = {s: (len(trees[s]) - 1) / sum(len(p) - 1 for p in trees[s].values()) for s in nodes}
    assert dict(rows("closeness_centrality")) == pytest.approx({"u50": true["u50"]})
    assert dict(map(tuple, components.closeness(g.nodes, g.edges).collect())) == pytest.approx(true) == dict(rows("approximate_closeness"))
    sizes = {(r.id, r.hop): r.reached for r in components.neighbourhood_sizes(g.nodes, g.edges).collect()}
    assert sizes == {(s, h): sum(len(p) - 1 <= h for p in trees[s].values()) for s in nodes for h in range(max(len(p) for t in trees.values() for p in t.values()))}

    def inner(sources):
        count = defaultdict(int)
        for s in sources:
            for p in trees[s].values():
                for v in p[1:-1]:
                    count[v] += 1
        return {v: k * 2 / ((len(nodes) - 1) * (len(nodes) - 2)) for v, k in count.items()}

    assert dict(rows("betweenness_centrality")) == pytest.approx(inner(["u50"]))
    assert dict(map(tuple, components.pair_betweenness(g.nodes, g.edges).collect())) == pytest.approx(inner(nodes))
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        rank = {v: 0.15 / len(nodes) + 0.85 * sum(rank[u] / len(one[u]) for u in nodes if v in one[u]) for v in nodes}
    got = dict(rows("pagerank"))
    assert all(abs(got[v] - rank[v]) < 1e-8 for v in nodes)


def test_searches_from_many_sources_fill_several_blocks(spark):
    """A chain, a hub with 1,500 leaves and a ring: more sources than one block has bits, sets that meet at a node, and a directed search."""
    pairs = [("hub", f"leaf{i}") for i in range(1500)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("c00", "c00")]
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    ids = spark.createDataFrame([(v,) for v in sorted({v for p in pairs for v in p})] + [("gone",), ("gone",)], "id string")
    both, one = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        one[a].add(b)
        both[a].add(b)
        both[b].add(a)
    for steps, directed in ((one, True), (both, False)):
        found = components.distances(ids, e, ids if directed else ids.filter("id NOT LIKE 'leaf1%'"), directed=directed)
        starts = {r.id for r in ids.collect() if directed or not r.id.startswith("leaf1")}
        want = {(s, v, len(p) - 1) for s in starts for v, p in reach(steps, s).items()}
        assert found.count() == len(want)
        assert {tuple(r) for r in found.collect()} == want
    few = ids.filter("id IN ('c03', 'hub', 'r2', 'leaf7')")
    trees = {s: reach(both, s) for s in ("c03", "hub", "r2", "leaf7")}
    assert {(r.source, r.id, tuple(r.path)) for r in components.bfs_trees(e, few).collect()} == {(s, v, tuple(p)) for s, t in trees.items() for v, p in t.items()}
    visits, n = defaultdict(int), ids.count()
    for t in trees.values():
        for p in t.values():
            for v in p[1:-1]:
                visits[v] += 1
    assert dict(map(tuple, components.pair_betweenness(ids, e, few).collect())) == pytest.approx({v: k * 2 / ((n - 1) * (n - 2)) for v, k in visits.items()})
