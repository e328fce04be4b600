"""Traversals and paths against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.graph import PropertyGraph
from quillgraph.operators.traverse import reach


def graph(spark, nodes, edges, dead=()):
    g = PropertyGraph.from_rows(spark, [(n, "P", {}) for n in nodes], [(f"e{i}", t, a, b, {}) for i, (a, b, t) in enumerate((*e, "L")[:3] for e in edges)])
    gone = F.col("id").isin(list(dead)) if dead else F.lit(False)
    return PropertyGraph.from_dataframes(g.node_views[None].withColumn("is_deleted", gone), g.edge_views[None].withColumn("is_deleted", gone))


def ids(q):
    return sorted(r.id for r in q.collect())


@pytest.fixture(scope="module")
def five(spark):
    return graph(spark, "ABCDE", ["AB", "AC", "BC", "CD", "DE"])


def test_hops(five):
    at = lambda n, *a: ids(five.node(n).traverse(*a))
    assert at("A", "out") == ["B", "C"] and at("A", "out", None, 2) == ["B", "C", "D"] and at("C", "in") == ["A", "B"]
    assert at("C", "both") == ["A", "B", "D"] and at("A", "out", None, 0) == [] and at("A", "out", None, None) == ["B", "C", "D", "E"]
    assert at("A", "out", None, 5) == ["B", "C", "D", "E"] and at("E", "out") == [] and at("A", "out", "X") == []


def test_cycles_end(spark):
    g = graph(spark, "ab", ["ab", "ba"])
    assert ids(g.node("a").traverse("out", None, None)) == ["b"]
    assert ids(g.node("a").traverse("out").traverse("out")) == ["a"]  # a later stage starts afresh


def test_edge_types(spark):
    g = graph(spark, "abc", [("a", "b", "KNOWS"), ("a", "c", "REFERENCES")])
    assert ids(g.node("a").traverse("out", "KNOWS")) == ["b"] and ids(g.node("a").traverse("out")) == ["b", "c"]


def test_deleted_edges_and_nodes(spark):
    g = graph(spark, "abc", ["ab", "bc"], dead=("e0",))
    assert ids(g.node("a").traverse("out")) == []
    g = graph(spark, "abc", ["ab", "bc"], dead=("b",))
    assert ids(g.node("a").traverse("out", None, 2)) == ["c"]  # through the deleted node
    assert g.shortest_path("a", "c").count() == 0 and g.all_paths("a", "c", 3).count() == 0
    assert g.without_dangling().live_edges().count() == 0


def test_with_edges(spark):
    g = graph(spark, "abc", ["ab", "bc"])
    nodes, edges = g.node("a").traverse("out", None, 2).with_edges()
    assert ids(nodes) == ["b", "c"] and ids(edges) == ["e0", "e1"]
    _, both = g.node("a").traverse("both", None, 2).with_edges()
    assert ids(both) == ["e0", "e0", "e1"]
    assert g.node("a").with_edges()[1].count() == 0


def test_order_of_discovery_decides_limits(spark):
    g = graph(spark, "axyzw", [("a", "z"), ("a", "y"), ("z", "w"), ("y", "x")])
    q = g.node("a").traverse("out", None, 2)
    assert [r.id for r in q.limit(2).collect()] == ["z", "y"] and [r.id for r in q.limit(2, 2).collect()] == ["w", "x"]
    assert [r.id for r in q.limit(1, 1).collect()] == ["y"]


def test_shortest_paths(spark):
    assert graph(spark, "ab", ["ab"]).shortest_path("a", "b").first().length == 1
    g = graph(spark, "abc", ["ab", "bc"])
    p = g.shortest_path("a", "c").first()
    assert (p.length, p.node_ids, p.edge_ids) == (2, ["a", "b", "c"], ["e0", "e1"])
    assert g.shortest_path("a", "a").first().length == 0 and g.shortest_path("c", "a").count() == 0
    assert g.shortest_path("a", "c", "X").count() == 0


def test_ties_go_to_the_edge_that_came_first(spark):
    g = graph(spark, "axyc", ["ax", "ay", "xc", "yc"])
    assert g.shortest_path("a", "c").first().node_ids == ["a", "x", "c"]
    assert [r.node_ids[1] for r in g.all_paths("a", "c", 3).collect()] == ["x", "y"]
    g = graph(spark, "axyc", ["ay", "ax", "xc", "yc"])
    assert g.shortest_path("a", "c").first().node_ids == ["a", "y", "c"]


def test_all_paths(spark):
    chain = graph(spark, "abcd", ["ab", "bc", "cd"])
    assert chain.all_paths("a", "d", 2).count() == 0 and chain.all_paths("a", "d", 3).count() == 1
    assert [r.length for r in graph(spark, "abc", ["ab", "bc", "ca"]).all_paths("a", "c", 5).collect()] == [2]
    twice = graph(spark, "ab", [("a", "b", "KNOWS"), ("a", "b", "FOLLOWS")])
    assert twice.all_paths("a", "b", 2).count() == 2 and twice.all_paths("a", "b", 2, "KNOWS").count() == 1
    assert [r.length for r in chain.all_paths("a", "a", 3).collect()] == [0] and chain.all_paths("a", "zz", 3).count() == 0


def test_degrees(spark):
    g = graph(spark, "ABCDE", ["AB", "AC", "AD", "BC", "CD", "CE", "DE"])
    assert {r.id: r.degree for r in g.degrees().collect()} == dict(zip("ABCDE", (3, 1, 2, 1, 0), strict=True))
    assert {r.id: r.degree for r in g.degrees("in").collect()} == dict(zip("ABCDE", (0, 1, 2, 2, 2), strict=True))
    assert [r.id for r in g.neighbours("A").collect()] == ["B", "C", "D"]


def plain_reach(edges, start, direction, depth):
    step = {}
    for a, b in edges:
        if direction in ("out", "both"):
            step.setdefault(a, []).append(b)
        if direction in ("in", "both"):
            step.setdefault(b, []).append(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if depth is None or seen[x] < depth:
            for y in step.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
    return {k: v for k, v in seen.items() if v}


def test_random_graphs_agree_with_a_plain_search(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(24)]
    g = graph(spark, names, pairs)
    start = spark.createDataFrame([("n0",)], "id string")
    for direction, depth in (("out", 2), ("in", 3), ("both", 4), ("out", None)):
        found = {r.id: r.hop for r in reach(start, g.live_edges(), direction, depth).collect()}
        assert found == plain_reach(pairs, "n0", direction, depth)
    far = plain_reach(pairs, "n0", "out", None)
    target = max(far, key=lambda x: (far[x], x))
    assert g.shortest_path("n0", target).first().length == far[target]
