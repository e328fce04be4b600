"""The journal, the writable store, streams, sync, snapshots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import adjacency, journal
from quillgraph.operators.merge import MAP, field_level, local_wins, remote_wins, resolve_changes
from quillgraph.sources import snapshot
from quillgraph.sources.snapshot import SnapshotError, load_or_discard, read_snapshot, write_snapshot
from quillgraph.store import CHANGES, EndpointMissing, GraphError, GraphStore, LastLabel, NotFound
from quillgraph.streaming.contract import CHECKS, ContractBroken, resume
from quillgraph.streaming.sync import Coordinator, LogBackend, Synchroniser
from quillgraph.types import NODES, Revision, prop_row, prop_value, schema, seeded_ids


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore.open(spark, str(tmp_path / "store"), actor="me", ids=seeded_ids(1))


def props(row):
    return {k: prop_value(v) for k, v in row.properties.items()}


def test_writing_and_reading(store):
    with store.transaction() as tx:
        a = tx.add_node("Person", {"name": "Alice", "drop": "x", "none": None})
        b = tx.add_node(["Person", "Employee"], {"name": "Bob"})
        e = tx.add_edge(a, b, "KNOWS", {"since": 2020})
    g = store.graph()
    assert g.nodes("Person").count() == 2 and g.nodes("Employee").count() == 1 and g.edges("KNOWS").count() == 1
    store.update_node(a, {"age": 32, "drop": None})
    assert props(store.node(a)) == {"name": "Alice", "age": 32}
    store.update_edge(e, {"since": 2021})
    assert props(store.edge(e)) == {"since": 2021}
    store.add_label("VIP", a)
    store.add_label("VIP", a)
    assert store.node(a).labels == ["Person", "VIP"]
    store.remove_label("Person", a)
    with pytest.raises(LastLabel):
        store.remove_label("VIP", a)
    rows = store.journal().orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, len(rows) + 1)) and [r.revision.counter for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].base_revision is None and rows[3].base_revision.counter == 1
    assert journal.invalid(store.journal()).count() == 0
    assert [r.event for r in journal.events(store.journal()).orderBy("sequence").collect()][:4] == ["NodeAdded", "NodeAdded", "EdgeAdded", "NodeUpdated"]


def test_deleting(store):
    with store.transaction() as tx:
        a, b = tx.add_node("P"), tx.add_node("P")
        tx.add_edge(a, b, "L")
    store.delete_node(b)
    store.delete_node(b)
    store.delete_node("missing")
    g = store.graph()
    assert g.nodes("P").count() == 1 and g.edges("L").count() == 1  # no cascade
    dead = store.tombstones("node").collect()
    assert [r.id for r in dead] == [b] and g.tombstones("node").count() == 1
    assert store.tombstones("node", dt.datetime.now() + dt.timedelta(days=2)).count() == 0
    with pytest.raises(NotFound):
        store.update_node(b, {"x": 1})
    with pytest.raises(GraphError):
        store.add_node("P", id=b)
    with pytest.raises(EndpointMissing):
        store.add_edge(a, b, "L")


def test_transactions_are_atomic(store):
    with pytest.raises(RuntimeError), store.transaction() as tx:
        tx.add_node("P")
        raise RuntimeError
    assert store.journal().count() == 0
    with store.transaction() as tx:
        a = tx.add_node("P", {"v": 1})
        tx.update_node(a, {"v": 2})
        with pytest.raises(GraphError), store.transaction():
            pass
        tx.delete_node(a)
        b = tx.add_node("P")
    assert [r.id for r in store.graph().nodes("P").collect()] == [b]
    assert store.journal().agg(F.max("revision.counter")).first()[0] == 4


def test_bulk_loads(store, spark):
    nodes = spark.range(100).select(F.concat(F.lit("n"), "id").alias("id"), F.array(F.lit("P")).alias("labels"), F.lit("P").alias("label"), F.col("id").alias("seq"))
    nodes = nodes.select(*[F.col(c) if c in nodes.columns else F.lit(None).cast(schema(NODES)[c].dataType).alias(c) for c in schema(NODES).fieldNames()])
    edge = "id string, type string, from_id string, to_id string, properties map<string,struct<type:string,s:string,i:bigint,d:double,b:boolean,ts:timestamp,bin:binary,arr:string>>, created_at timestamp, modified_at timestamp, revision struct<actor_id:string,counter:bigint,wall_clock:timestamp>, is_deleted boolean, seq bigint"
    edges = spark.createDataFrame([(f"e{i}", "L", "n0", f"n{i}", None, None, None, None, None, i) for i in range(1, 100)] + [("x", "L", "n0", "nowhere", None, None, None, None, None, 100)], edge)
    with pytest.raises(EndpointMissing):
        store.bulk_insert(nodes, edges, strict=True)
    assert store.bulk_insert(nodes, edges) == (100, 100)
    g = store.graph()
    assert g.node("n0").traverse("out").count() == 99 and g.without_dangling().live_edges().count() == 99
    store.update_node("n5", {"v": 1})
    assert store.graph().nodes("P").count() == 100 and props(store.node("n5")) == {"v": 1}


def test_fold_follows_the_order_of_the_journal(spark):
    t = [dt.datetime(2020, 1, d) for d in (1, 2, 3)]
    rows = [(1, "a", "upsert", "x", 1, t[2]), (2, "b", "upsert", "y", 1, t[1]), (3, "c", "upsert", "x", 2, t[0])]
    kind = "struct<actor_id:string,counter:bigint,wall_clock:timestamp>"
    frame = spark.createDataFrame([(s, c, "node", "n", op, (actor, n, at)) for s, c, op, actor, n, at in rows], f"sequence bigint, change_id string, entity_kind string, entity_id string, operation string, revision {kind}")
    assert journal.fold(frame).first().change_id == "c"  # y1 < x1, then x1 < x2
    assert journal.fold(frame.filter("change_id <> 'b'"), one_actor=True).first().change_id == "c"
    assert journal.append_new(frame.filter("sequence = 1"), frame.unionByName(frame)).count() == 2
    assert journal.latest_row(frame, "node", "n").first().sequence == 3 and [r.sequence for r in journal.tail(frame, 1).collect()] == [2, 3]


def test_edge_logs(spark):
    kind = "struct<actor_id:string,counter:bigint,wall_clock:timestamp>"
    base = spark.createDataFrame([("e1", "L", "a", "b", 1), ("e2", "L", "a", "c", 2)], "id string, type string, from_id string, to_id string, seq bigint")
    t = [dt.datetime(2020, 1, d) for d in (1, 2)]
    log = lambda *rows: spark.createDataFrame([(i, "a", to, "L", act, r, p) for p, (i, to, act, r) in enumerate(rows)], f"id string, from_id string, to_id string, type string, action string, revision {kind}, position bigint")
    r = lambda n: ("x", n, t[0])
    got = lambda *rows: [(x.id, x.to_id) for x in adjacency.overlay(base, log(*rows)).orderBy("seq").collect()]
    assert got(("e1", "b", "delete", r(1))) == [("e2", "c")]
    assert got(("e3", "d", "insert", r(1)), ("e3", "d", "delete", r(2)), ("e3", "z", "insert", r(3))) == [("e1", "b"), ("e2", "c"), ("e3", "z")]
    assert got(("e1", "q", "insert", r(1))) == [("e1", "q"), ("e2", "c")]
    assert got(("e9", "d", "insert", ("A", 99, t[0])), ("e9", "d", "delete", ("B", 1, t[1]))) == [("e1", "b"), ("e2", "c")]
    assert adjacency.should_compact(401, 100) and not adjacency.should_compact(400, 100)
    assert adjacency.compact(base, log(("e1", "b", "delete", r(1)))).count() == 1
    rich = base.withColumns({"w": F.col("seq") * 1.5, "is_deleted": F.lit(False)})
    kept = adjacency.compact(rich, log(("e1", "q", "insert", r(1)), ("e7", "z", "insert", r(2))))
    assert kept.columns == rich.columns and [(x.id, x.to_id, x.w) for x in kept.orderBy("seq").collect()] == [("e1", "q", 1.5), ("e2", "c", 3.0), ("e7", "z", None)]
    entries = log(("e1", "q", "insert", r(1)), ("e7", "q", "insert", r(2)), ("e8", "z", "insert", r(3)))
    assert [x.id for x in adjacency.incoming_entries(entries, "q").collect()] == ["e1", "e7"] and adjacency.outgoing_entries(entries, "a", "L").count() == 3 and adjacency.outgoing_entries(entries, "q").count() == 0


SIDE = f"entity_kind string, entity_id string, properties {MAP}, deleted boolean, revision struct<actor_id:string,counter:bigint,wall_clock:timestamp>"


@pytest.mark.parametrize(("base", "local", "remote", "options", "action", "result"), [
    ({"x": 1}, {"x": 2}, {"x": 1}, {}, "merge", {"x": 2}),
    ({"x": 1}, {"x": 1}, {"x": 2}, {}, "merge", {"x": 2}),
    ({"x": 1}, {"x": 2}, {"x": 3}, {}, "merge", {"x": 3}),
    ({"x": 1}, {"x": 2}, {"x": 3}, {"same_field": "local"}, "merge", {"x": 2}),
    ({"x": 1}, {"x": 2}, {"x": 3}, {"same_field": "fail"}, "fail", None),
    ({"x": 1}, {"x": 2}, {"x": 2}, {"same_field": "fail"}, "merge", {"x": 2}),
    ({"x": 1, "y": 1}, {"x": 1, "a": 5}, {"x": 1, "y": 1, "b": 6}, {}, "merge", {"x": 1, "a": 5, "b": 6}),
    ({"x": 1, "gone": 1}, {"x": 2}, {"x": 1}, {}, "merge", {"x": 2, "gone": 1}),
    ({"x": 1}, None, {"x": 2}, {}, "fail", None),
    ({"x": 1}, None, {"x": 2}, {"on_delete": "remote"}, "useRemote", {"x": 2}),
    ({"x": 1}, None, {"x": 2}, {"on_delete": "delete"}, "delete", None),
    ({"x": 1}, None, None, {}, "delete", None),
])
def test_three_way_merges(spark, base, local, remote, options, action, result):
    frame = lambda p, n: spark.createDataFrame([("node", "n", {k: prop_row(v) for k, v in (p or {}).items()}, p is None, ("a", n, None))], SIDE)
    row = resolve_changes(frame(base, 1), frame(local, 2), frame(remote, 3), field_level(**options)).first().resolution
    assert row.action == action
    if result is not None:
        assert {k: prop_value(v) for k, v in row.properties.items()} == result


def test_whole_record_policies(spark):
    frame = lambda v, n: spark.createDataFrame([("node", "n", {"x": prop_row(v)}, False, ("a", n, None))], SIDE)
    sides = frame(1, 1), frame(2, 2), frame(3, 3)
    assert resolve_changes(*sides, remote_wins).first().resolution.properties["x"].i == 3
    assert resolve_changes(*sides, local_wins).first().resolution.properties["x"].i == 2
    quiet = resolve_changes(frame(1, 1), frame(1, 1), frame(3, 3), local_wins).first()
    assert not quiet.diverged and quiet.resolution.action == "useRemote"


def test_two_stores_converge(spark, tmp_path):
    backend = LogBackend(spark, str(tmp_path / "log"))
    a, b = (GraphStore.open(spark, str(tmp_path / x), actor=x, ids=seeded_ids(i)) for i, x in enumerate("ab"))
    ca, cb = Coordinator(a, backend), Coordinator(b, backend)
    n = a.add_node("P", {"name": "Alice"})
    assert ca.run_once().pushed == 1 and cb.run_once().pulled == 1
    assert props(b.node(n)) == {"name": "Alice"}
    a.update_node(n, {"age": 30})
    b.update_node(n, {"city": "Seoul"})
    for c in (ca, cb, ca, cb):
        assert c.run_once().state == "idle"
    want = {"name": "Alice", "age": 30, "city": "Seoul"}
    assert props(a.node(n)) == want and props(b.node(n)) == want
    a.delete_node(n)
    ca.run_once(), cb.run_once()
    assert b.node(n) is None
    backend.fail_next = 1
    a.add_node("P")
    assert ca.run_once().state == "offline" and ca.run_once().state == "idle"
    assert backend.log().groupBy("change_id").count().filter("count > 1").count() == 0


def test_following_changes(spark, store, tmp_path):
    seen = []
    note = lambda df, _: seen.extend(r.event for r in df.orderBy("sequence").collect())
    a = store.add_node("P")
    store.follow(note, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == ["NodeAdded"]
    store.update_node(a, {"v": 1})
    store.delete_node(a)
    store.follow(note, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == ["NodeAdded", "NodeUpdated", "NodeDeleted"]


def test_snapshots(spark, store, tmp_path):
    with store.transaction() as tx:
        a, b = tx.add_node("P", {"v": 1}), tx.add_node("P")
        tx.add_edge(a, b, "L")
    path = str(tmp_path / "snap")
    manifest = write_snapshot(store.graph(), path)
    assert (manifest["nodes"]["rows"], manifest["edges"]["rows"]) == (2, 1)
    g = read_snapshot(spark, path)
    assert [r.id for r in g.nodes("P").where("v", "=", 1).collect()] == [a] and [r.id for r in g.node(a).traverse("out").collect()] == [b]
    assert load_or_discard(spark, path, "disabled") is None and write_snapshot(store.graph(), path, policy="disabled") is None
    store.add_node("P", {"v": 2})
    write_snapshot(store.graph(), path)
    folders = [x for x in (tmp_path / "snap").iterdir() if x.is_dir()]
    assert read_snapshot(spark, path).nodes("P").count() == 3 and len(folders) == 1  # the older version is gone
    part = next((folders[0] / "nodes").glob("part-*.parquet"))
    (folders[0] / "nodes" / "part-extra.parquet").write_bytes(part.read_bytes())
    with pytest.raises(SnapshotError):
        read_snapshot(spark, path)
    assert load_or_discard(spark, path) is None and not (tmp_path / "snap").exists()
    assert load_or_discard(spark, str(tmp_path / "none")) is None


def test_a_failure_to_read_keeps_a_snapshot(spark, store, tmp_path, monkeypatch):
    store.add_node("P")
    path = str(tmp_path / "snap")
    write_snapshot(store.graph(), path)

    def lost(df):
        raise RuntimeError("an executor was lost")

    monkeypatch.setattr(snapshot, "checksum", lost)
    with pytest.raises(RuntimeError):
        load_or_discard(spark, path)
    monkeypatch.undo()
    assert load_or_discard(spark, path).nodes("P").count() == 1


def test_what_grows_does_not_go_through_the_driver(store, spark, tmp_path):
    """Spark takes 200,000 ids for less than 10 MB, as their files are small; in memory they are more. The least that it sends has a page of 4 MB."""
    n = 200_000
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.array(F.lit("P")).alias("labels"), F.lit("P").alias("label"), F.col("id").alias("seq"))
    edges = spark.range(n).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("L").alias("type"), F.concat(F.lit("n"), "id").alias("from_id"), F.concat(F.lit("n"), (F.col("id") * 7) % n).alias("to_id"), F.col("id").alias("seq"))
    few = [("delete", "node", "n3", None, None, None, None, None), ("add", "node", "new", ["P"], None, None, None, None), ("add", "edge", "f", None, "L", "new", "n5", None), ("patch", "edge", "e9", None, None, None, None, {"v": prop_row(1)})]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "9m")
    try:
        assert store.bulk_insert(nodes, edges, strict=True) == (n, n)
        assert store.apply(spark.createDataFrame(few, schema(CHANGES))) == 4
        with pytest.raises(EndpointMissing):
            store.apply(spark.createDataFrame([("add", "edge", "g", None, "L", "new", "n3", None)], schema(CHANGES)))
        with pytest.raises(GraphError):
            store.bulk_insert(nodes.filter("seq = 8"))
        store.compact()
        store.delete_node("n4")
        g = store.graph()
        assert g.nodes("P").unordered().count() == n - 1 and props(store.edge("e9")) == {"v": 1}
        assert g.without_dangling().live_edges().count() == n + 1 - 4  # e3 and e4, and the two edges that end there
        write_snapshot(g, str(tmp_path / "snapshot"))
        assert read_snapshot(spark, str(tmp_path / "snapshot")).edges("L").unordered().count() == n + 1
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_changes_of_many_entities(store, spark):
    row = lambda action, kind, id, **c: (action, kind, id, c.get("labels"), c.get("type"), c.get("from_id"), c.get("to_id"), {k: prop_row(v) for k, v in c["properties"].items()} if "properties" in c else None)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema(CHANGES))
    assert store.apply(frame(row("add", "node", "a", labels=["P", "P"], properties={"x": 1, "n": None}), row("add", "node", "b", labels=["P"]), row("add", "edge", "e", type="L", from_id="a", to_id="b"))) == 3
    assert store.apply(frame(row("patch", "node", "a", properties={"x": None, "y": 2}), row("add_labels", "node", "b", labels=["Q"]), row("delete", "edge", "e"), row("delete", "node", "none"))) == 3
    assert props(store.node("a")) == {"y": 2} and store.node("b").labels == ["P", "Q"] and store.edge("e") is None
    bad = [(row("patch", "node", "z"), NotFound), (row("add", "node", "a", labels=["P"]), GraphError), (row("remove_labels", "node", "a", labels=["P"]), LastLabel), (row("add", "edge", "f", type="L", from_id="a", to_id="z"), EndpointMissing), (row("add", "node", "c"), LastLabel), (row("move", "node", "a"), GraphError), (row("patch", "edge", "e"), NotFound)]
    for change, error in bad:
        with pytest.raises(error):
            store.apply(frame(row("add", "node", "new", labels=["P"]), change))
    with pytest.raises(GraphError):
        store.apply(frame(row("delete", "node", "a"), row("delete", "node", "a")))
    assert store.journal().count() == 6 and store.apply(frame()) == 0
    rows = store.journal().orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, 7)) == [r.revision.counter for r in rows] and len({r.change_id for r in rows}) == 6
    store.add_node("P")  # counters go on behind a frame's
    assert store.journal().agg(F.max("revision.counter"), F.max("sequence")).first() == (7, 7)


def test_compaction_loses_nothing(store, spark):
    with store.transaction() as tx:
        ids = [tx.add_node(["P", f"Q{i}"], {"v": i}) for i in range(5)]
        edges = [tx.add_edge(ids[0], i, "L", {"w": 1.5}) for i in ids[1:]]
    store.delete_node(ids[4])
    store.delete_edge(edges[0])
    seen = lambda s: ([sorted(map(str, x.collect())) for x in (s.nodes(), s.edges(), s.tombstones("node"))])
    before, old = seen(store), store.graph()
    assert store.should_compact()
    store.compact()
    again = GraphStore.open(spark, store.path, actor="me", ids=seeded_ids(2))
    assert seen(again) == before and again.state().count() == 0 and not again.should_compact()
    again.update_node(ids[1], {"v": 9})
    with pytest.raises(NotFound):
        again.update_node(ids[4], {})
    more = spark.createDataFrame([("bulk", ["P"])], "id string, labels array<string>")
    assert again.bulk_insert(more) == (1, 0)
    for _ in range(2):
        assert props(again.node(ids[1])) == {"v": 9} and props(again.node(ids[2])) == {"v": 2} and again.graph().nodes("P").count() == 5
        assert again.journal().agg(F.max("revision.counter")).first()[0] == again.journal().count() == 12
        again.compact()
    assert old.nodes("P").count() == 4 and old.nodes("P").where("v", "=", 9).count() == 0  # a reader keeps what it has open
    with pytest.raises(GraphError):
        again.bulk_insert(more)
    with pytest.raises(GraphError):
        again.bulk_insert(spark.createDataFrame([("x", ["P"]), ("x", ["P"])], more.schema))


def test_jobs_do_not_grow_with_a_transaction(spark, store):
    store.add_node("P", id="p")
    tracker = spark.sparkContext.statusTracker()
    for n, group in ((2, "few"), (12, "many")):
        spark.sparkContext.setJobGroup(group, group)
        with store.transaction() as tx:
            tx.load(("node", "p"))
            for _ in range(n):
                tx.add_edge("p", tx.add_node("Q"), "L")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("many")) == len(tracker.getJobIdsForGroup("few"))


def test_long_histories_take_little_room(spark):
    t = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=n)
    rng, rows = random.Random(3), []
    for entity in range(6):
        counters = {"x": 0, "y": 0, "z": 0}
        for n in range(120):
            actor = rng.choice("xyz") if entity % 2 else "xyz"[n // 40]
            counters[actor] += rng.choice((1, 1, 0, -1))
            rows.append((len(rows), f"c{len(rows)}", "node", f"n{entity}", "upsert", (actor, counters[actor], t(rng.randrange(200) if entity > 2 else n))))
    frame = spark.createDataFrame(rows, "sequence bigint, change_id string, entity_kind string, entity_id string, operation string, revision struct<actor_id:string,counter:bigint,wall_clock:timestamp>")
    want = {}
    for r in rows:
        now = want.get(r[3])
        if now is None or not Revision(*r[5]) < Revision(*now[5]):
            want[r[3]] = r
    got = {r.entity_id: (r.change_id, r.first_sequence) for r in journal.fold(frame).collect()}
    assert got == {k: (r[1], 120 * int(k[1:])) for k, r in want.items()}


@pytest.mark.parametrize("check", CHECKS, ids=lambda c: c.__name__)
def test_backends_keep_the_contract(spark, tmp_path, check):
    def make():
        path = str(tmp_path / str(random.random()))
        return lambda: LogBackend(spark, path)

    check(spark, make)


def test_the_contract_notices(spark, tmp_path):
    class Forgetful(LogBackend):
        def pull(self, after, actor, most):
            return super().pull(0, actor, most)

    with pytest.raises(ContractBroken):
        resume(spark, lambda: lambda: Forgetful(spark, str(tmp_path / "log")))


def test_several_backends(spark, store, tmp_path):
    sync, told = Synchroniser(store), []
    sync.watch(lambda name, s: told.append((name, s.state)))
    for name in ("x", "y"):
        sync.enable(name, LogBackend(spark, str(tmp_path / name)))
    store.add_node("P")
    assert sync.sync_now("x").pushed == 1 and sync.sync_now("y").pushed == 1 and set(sync.status()) == {"x", "y"}
    assert told[-2:] == [("y", "syncing"), ("y", "idle")]
    sync.disable("x")
    with pytest.raises(LookupError):
        sync.sync_now("x")
    sync.enable("x", LogBackend(spark, str(tmp_path / "x")))
    assert sync.sync_now("x").pushed == 0  # goes on from its cursor
