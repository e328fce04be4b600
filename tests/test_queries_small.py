"""Behaviour on small graphs."""

import pytest
from pyspark.sql import functions as F

from quillgraph.graph import PropertyGraph

PEOPLE = [("Alice", 32, "Seoul"), ("Bob", 28, "Busan"), ("Cath", 35, "Seoul"), ("Dee", 24, "Incheon"), ("Eli", 30, "Daegu")]


def ids(q):
    return [r.id for r in (q.collect() if hasattr(q, "collect") else q)]


def names(q):
    return [r.properties["name"]["s"] for r in q.collect()]


@pytest.fixture(scope="module")
def grid(spark):
    return PropertyGraph.from_rows(spark, [(f"p{i}", "Person", {"age": 20 + i, "city": "Busan" if i % 2 else "Seoul"}) for i in range(10)] + [(f"c{i}", "Concept", {"name": "x"}) for i in range(5)])


@pytest.fixture(scope="module")
def people(spark):
    return PropertyGraph.from_rows(spark, [(n, "Person", {"name": n, "age": a, "city": c}) for n, a, c in PEOPLE])


def test_sources(grid):
    assert grid.nodes("Person").count() == 10 and grid.nodes("Concept").count() == 5 and grid.nodes("Nobody").count() == 0
    assert ids(grid.node("p3")) == ["p3"] and grid.node("missing").first() is None
    assert grid.nodes_where("age", gt=25).count() == 4 and grid.nodes_where("age", lt=22).count() == 2
    assert grid.nodes_where("age", in_=[20, 21, 99]).count() == 2 and grid.nodes_where("name", equals="x").count() == 5
    assert grid.all_nodes().count() == 15


def test_filters(grid):
    q = grid.nodes("Person")
    assert q.where("city", equals="Seoul").count() == 5
    assert q.where("age", gt=25).count() == 4 and q.where("age", lt=25).count() == 5
    assert q.where("age", in_=[20, 21, 99]).count() == 2 and q.where("age", in_=[]).count() == 0
    assert q.where("age", gt="hello").count() == 0 and q.where("age", ">", 25.0).count() == 0
    assert q.where("city", equals="Seoul").where("age", gt=22).count() == 3
    assert q.where(lambda p: p.field("age", "int") % 5 == 0).count() == 2
    for op, n in (("=", 1), ("!=", 9), (">", 4), (">=", 5), ("<", 5), ("<=", 6)):
        assert q.where("age", op, 25).count() == n


def test_bad_predicates_fail_when_built(grid):
    q = grid.nodes("Person")
    for call in (lambda: q.where("age", "~", 1), lambda: q.limit(-1), lambda: q.limit(1, -1), lambda: q.traverse("sideways")):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: q.where("age", "=", None), lambda: q.where("age", "=", b"x"), lambda: q.where("age")):
        with pytest.raises(TypeError):
            call()


def test_order_and_limits(people):
    q = people.nodes("Person")
    assert [r.properties["age"]["i"] for r in q.sorted("age", False).collect()] == [35, 32, 30, 28, 24]
    assert names(q.sorted("name").limit(2, 2)) == ["Cath", "Dee"]
    assert names(q.where("age", ">=", 28).sorted("age", False).limit(2)) == ["Cath", "Alice"]
    assert names(q.where("name", contains="LI")) == ["Alice", "Eli"]
    assert q.limit(0).count() == 0 and q.limit(3, 10).count() == 0
    assert q.sorted("age").first().id == "Dee" and q.limit(2, 1).first().id == "Bob" and people.nodes("No").first() is None
    assert q.exists() and not q.where("age", ">", 99).exists()


def test_substrings_have_no_special_characters(spark):
    g = PropertyGraph.from_rows(spark, [("a", "Doc", {"title": "100% done"}), ("b", "Doc", {"title": "half_done"}), ("c", "Doc", {"title": 100})])
    assert ids(g.nodes("Doc").where("title", contains="100%")) == ["a"]
    assert ids(g.nodes("Doc").where("title", contains="_")) == ["b"]


def test_both_meanings_of_one_chain(spark):
    g = PropertyGraph.from_rows(spark, [("a", "N", {"v": 3}), ("b", "N", {}), ("c", "N", {"v": "x"}), ("d", "N", {"v": 1})])
    q = g.nodes("N")
    s = q.where(lambda p: F.lit(True))  # makes it sequential
    assert ids(q.where("v", "!=", 3)) == ["d"] and sorted(ids(s.where("v", "!=", 3))) == ["c", "d"]
    assert ids(q.sorted("v").limit(9)) == ["b", "d", "a", "c"] and ids(s.sorted("v").limit(9)) == ["d", "a", "c", "b"]
    assert ids(q.sorted("v", False).limit(9)) == ["c", "a", "d", "b"] and ids(s.sorted("v", False).limit(9)) == ["c", "a", "d", "b"]
    assert ids(q.limit(1).where("v", "=", 1)) == ["d"] and ids(s.limit(1).where("v", "=", 1)) == []
    assert ids(q.limit(1).limit(3)) == ["a", "b", "c"] and ids(s.limit(1).limit(3)) == ["a"]


def test_aggregates(spark):
    rows = [("a", "Person", {"name": "Alice", "age": 30, "score": 4.5}), ("b", "Person", {"name": "Bob", "age": 25, "score": 3.8}), ("c", "Person", {"name": "Cath", "age": 35, "score": 4.9}), ("r", "Animal", {"name": "Rex", "age": 5})]
    g = PropertyGraph.from_rows(spark, rows)
    q = g.nodes("Person")
    assert q.sum("age") == 90 and abs(q.sum("score") - 13.2) < 1e-9 and q.avg("age") == 30 and (q.min("age"), q.max("age")) == (25, 35)
    assert q.sum("nothing") == 0 and q.avg("nothing") is None and q.sum("name") == 0
    no = g.nodes("No")
    assert (no.sum("age"), no.avg("age"), no.min("age"), no.max("age")) == (0, None, None, None)
    assert q.where("age", ">", 25).sum("age") == 65 and q.min("name") == "Alice" and q.max("name") == "Cath"
    everyone = g.all_nodes()
    assert abs(everyone.avg("score") - 4.4) < 1e-9 and abs(everyone.where(lambda p: F.lit(True)).avg("score") - 3.3) < 1e-9
    assert q.sorted("age").limit(2).sum("age") == 55


def test_mixed_kinds_have_an_extreme(spark):
    g = PropertyGraph.from_rows(spark, [("a", "N", {"v": "z"}), ("b", "N", {"v": 7}), ("c", "N", {"v": 9}), ("d", "N", {"v": [1]})])
    assert g.nodes("N").min("v") == 7 and g.nodes("N").max("v") == 9


def test_several_labels(spark):
    g = PropertyGraph.from_rows(spark, [("a", ["Person", "Employee"], {}), ("b", "Person", {}), ("c", "Employee", {})])
    assert ids(g.nodes("Person")) == ["a", "b"] and ids(g.nodes("Employee")) == ["a", "c"]
    assert g.node("a").first().label == "Employee"
    assert {r.label: r["count"] for r in g.labels().collect()} == {"Person": 2, "Employee": 2}


def test_index_lookup(spark):
    g = PropertyGraph.from_rows(spark, [("a", "Person", {"email": "a@x"}), ("b", "Person", {"email": "b@x"})], indexes=[("Person", "email")])
    assert [r.id for r in g.lookup("Person", "email", "a@x").collect()] == ["a"] and g.lookup("Person", "email", "z").count() == 0
    assert g.lookup("Person", "name", "a") is None


@pytest.fixture(scope="module")
def ties(spark):
    people = [(x, "Person", {"name": x}) for x in "abc"]
    edges = [("1", "KNOWS", "a", "b", {"since": 2020, "weight": 1.0}), ("2", "KNOWS", "a", "c", {"since": 2022, "weight": 2.5}), ("3", "WORKS_WITH", "b", "c", {"since": 2021, "weight": 3.0, "dept": "Engineering"})]
    return PropertyGraph.from_rows(spark, people, edges)


def test_edge_queries(ties):
    k = ties.edges("KNOWS")
    assert k.count() == 2 and ties.edges(from_="a").count() == 2 and ties.edges(to="c").count() == 2 and ties.edges().count() == 3
    assert k.where("since", ">", 2020).count() == 1 and ids(ties.edges("WORKS_WITH").where("dept", contains="GIN")) == ["3"]
    assert ids(k.sorted("since", False)) == ["2", "1"] and ids(k.sorted("since").limit(1, 1)) == ["2"]
    assert k.sum("weight") == 3.5 and k.avg("weight") == 1.75 and k.min("since") == 2020 and k.max("weight") == 2.5
    assert k.where("since", ">", 2020).sum("weight") == 2.5 and k.exists() and k.first().id == "1"
    assert ids(k.where(lambda p: p.field("since", "int") > 2021)) == ["2"]
    assert ties.edge("3").first().type == "WORKS_WITH" and ties.edge("9").count() == 0
    assert ties.edges_from("a").count() == 2 and ties.edges_from("a", "KNOWS").count() == 2 and ties.edges_to("c", "WORKS_WITH").count() == 1
    with pytest.raises(TypeError):
        ties.edges("KNOWS", from_="a")


def test_sql_views(ties, spark):
    ties.register("g")
    assert spark.sql("SELECT count(*) FROM g_edges e JOIN g_nodes n ON n.id = e.to_id").first()[0] == 3
