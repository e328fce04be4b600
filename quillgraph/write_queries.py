"""Queries through the writable store, snapshots and synchronisation, registered beside those of ``queries``.

A scenario writes a store once a session; several queries read it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import lru_cache
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import journal
from .operators.merge import field_level
from .plans.lineage import session_dir
from .queries import _journal, query
from .sources.mapping import commerce, read_table
from .sources.snapshot import load_or_discard, migrate, read_snapshot, write_snapshot
from .store import EndpointMissing, GraphError, GraphStore, LastLabel, NotFound
from .streaming.contract import CHECKS, Make
from .streaming.sync import Coordinator, LogBackend, Synchroniser
from .types import JOURNAL, NODES, PROP, prop_struct, schema

NO_PROPERTIES = f"map<string,{PROP}>"


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _properties(**values: tuple[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(prop_struct(tag, c) for tag, c in values.values())))


def _value(key: str, field: str) -> Column:
    return F.element_at("properties", F.lit(key))[field].alias(key)


def _changes(rows: DataFrame, action: str, kind: str, id: Column, **columns: Column) -> DataFrame:
    """Rows of ``store.CHANGES``."""
    parts = {"labels": "array<string>", "type": "string", "from_id": "string", "to_id": "string", "properties": NO_PROPERTIES}
    return rows.select(F.lit(action).alias("action"), F.lit(kind).alias("entity_kind"), id.alias("id"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in parts.items()))


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


# a shop: customers, orders and who placed them, loaded at once and then changed in three commits, compacted in between


@lru_cache(maxsize=8)
def _shop(application: str, d: str) -> SimpleNamespace:
    spark = SparkSession.getActiveSession()
    c, o, s = (read_table(spark, d, t) for t in ("customer", "orders", "supplier"))
    store = GraphStore.open(spark, _fresh(spark, "shop"), actor="shop", indexes=[("Customer", "name")])
    customers = c.select(_name("customer", "c_custkey").alias("id"), F.array_sort(F.array(F.lit("Customer"), "c_mktsegment")).alias("labels"), F.lit("Customer").alias("label"), _properties(name=("string", F.col("c_name")), acctbal=("double", F.col("c_acctbal"))).alias("properties"), F.col("c_custkey").alias("seq"))
    orders = o.select(_name("order", "o_orderkey").alias("id"), F.array(F.lit("Order")).alias("labels"), F.lit("Order").alias("label"), F.lit(None).cast(NO_PROPERTIES).alias("properties"), F.col("o_orderkey").alias("seq"))
    placed = o.select(_name("placed", "o_orderkey").alias("id"), F.lit("PLACED").alias("type"), _name("customer", "o_custkey").alias("from_id"), _name("order", "o_orderkey").alias("to_id"), _properties(totalprice=("double", F.col("o_totalprice"))).alias("properties"), F.col("o_orderkey").alias("seq"))
    loaded = store.bulk_insert(customers.unionByName(orders), placed, strict=True)
    nation, id, edge, number = F.col("c_nationkey"), _name("customer", "c_custkey"), _name("placed", "o_orderkey"), F.col("o_orderkey") % 10
    frames = [
        _changes(c.filter(nation < 5), "patch", "node", id, properties=_properties(name=("string", F.lit("patched")), acctbal=("null", F.lit(None)))),
        _changes(c.filter(nation == 5), "add_labels", "node", id, labels=F.array(F.lit("VIP"))),
        _changes(c.filter(nation == 6), "remove_labels", "node", id, labels=F.array("c_mktsegment")),
        _changes(c.filter(nation == 7), "delete", "node", id),
        _changes(o.filter(number == 1), "patch", "edge", edge, properties=_properties(totalprice=("double", F.lit(0.0)))),
        _changes(o.filter(number == 0), "delete", "edge", edge),
        _changes(s, "add", "node", _name("supplier", "s_suppkey"), labels=F.array(F.lit("Supplier")), properties=_properties(name=("string", F.col("s_name")))),
        _changes(s, "add", "edge", _name("serves", "s_suppkey"), type=F.lit("SERVES"), from_id=_name("supplier", "s_suppkey"), to_id=_name("customer", "s_suppkey"), properties=_properties(since=("int", F.lit(2020)))),
    ]
    first = frames[0]
    for f in frames[1:]:
        first = first.unionByName(f)
    store.apply(first)
    between = dt.datetime.now()
    store.apply(_changes(c.filter(nation == 8), "delete", "node", id).unionByName(_changes(o.filter(number == 2), "delete", "edge", edge)).unionByName(_changes(c.filter(nation == 5), "add_labels", "node", id, labels=F.array(F.lit("VIP")))))
    store.compact()
    store.apply(_changes(c.filter(nation == 9), "patch", "node", id, properties=_properties(name=("string", F.lit("late")))))
    return SimpleNamespace(store=GraphStore.open(spark, store.path, actor="shop", indexes=store.indexes), loaded=loaded, between=between)


def shop(spark: SparkSession, d: str) -> SimpleNamespace:
    return _shop(spark.sparkContext.applicationId, d)


_LABELS = "CASE WHEN c_nationkey = 6 THEN ['Customer'] WHEN c_nationkey = 5 THEN list_sort(['Customer', c_mktsegment, 'VIP']) ELSE list_sort(['Customer', c_mktsegment]) END"
_CUSTOMER = f"SELECT 'customer:' || c_custkey AS id, array_to_string({_LABELS}, ',') AS labels, CASE WHEN c_nationkey < 5 THEN 'patched' WHEN c_nationkey = 9 THEN 'late' ELSE c_name END AS name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS acctbal FROM customer WHERE c_nationkey NOT IN (7, 8)"


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM orders) AS edges")
def store_bulk_load(spark, d):
    return spark.createDataFrame([shop(spark, d).loaded], "nodes bigint, edges bigint")


@query(_CUSTOMER)
def store_nodes(spark, d):
    return shop(spark, d).store.graph().nodes("Customer").unordered().select("id", F.array_join("labels", ",").alias("labels"), _value("name", "s"), _value("acctbal", "d"))


@query("SELECT 'placed:' || o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN 0 ELSE o_totalprice END AS totalprice FROM orders WHERE o_orderkey % 10 NOT IN (0, 2)")
def store_edges(spark, d):
    return shop(spark, d).store.graph().edges("PLACED").unordered().select("id", _value("totalprice", "d"))


@query("SELECT 'serves:' || s_suppkey AS id, 'supplier:' || s_suppkey AS from_id, 'customer:' || s_suppkey AS to_id, CAST(2020 AS BIGINT) AS since FROM supplier")
def store_added_edges(spark, d):
    return shop(spark, d).store.graph().edges("SERVES").unordered().select("id", "from_id", "to_id", _value("since", "i"))


@query(f"SELECT unnest({_LABELS}) AS label, count(*) AS n FROM customer WHERE c_nationkey NOT IN (7, 8) GROUP BY label UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def store_labels(spark, d):
    return shop(spark, d).store.graph().labels().select("label", F.col("count").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey NOT IN (7, 8)")
def store_traverse_past_deleted(spark, d):
    return shop(spark, d).store.graph().nodes("Supplier").traverse("out", "SERVES").unordered().select("id")


@query("SELECT 'serves:' || s_suppkey AS id FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_nationkey NOT IN (7, 8) UNION ALL SELECT 'placed:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (7, 8) AND o_orderkey % 10 NOT IN (0, 2)")
def store_without_dangling(spark, d):
    return shop(spark, d).store.graph().without_dangling().live_edges().select("id")


@query("SELECT 'customer:' || c_custkey AS id, 'node' AS kind FROM customer WHERE c_nationkey = 8")
def store_node_tombstones_since(spark, d):
    at = shop(spark, d)
    return at.store.tombstones("node", at.between).select("id", "kind")


@query("SELECT 'placed:' || o_orderkey AS id, 'edge' AS kind FROM orders WHERE o_orderkey % 10 = 2")
def store_edge_tombstones_since(spark, d):
    at = shop(spark, d)
    return at.store.graph().tombstones("edge", at.between).select("id", "kind")


@query("SELECT 'node' AS kind, count(*) AS n FROM customer WHERE c_nationkey IN (7, 8) UNION ALL SELECT 'edge', count(*) FROM orders WHERE o_orderkey % 10 IN (0, 2)")
def store_tombstones(spark, d):
    store = shop(spark, d).store
    return store.tombstones("node").unionByName(store.tombstones("edge")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 9")
def store_index_lookup(spark, d):
    return shop(spark, d).store.graph().lookup("Customer", "name", "late").select("id")


_EVENTS = "SELECT event, n FROM (SELECT 'NodeUpdated' AS event, count(*) AS n FROM customer WHERE c_nationkey < 7 OR c_nationkey = 9 UNION ALL SELECT 'NodeDeleted', count(*) FROM customer WHERE c_nationkey IN (7, 8) UNION ALL SELECT 'EdgeUpdated', count(*) FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT 'EdgeDeleted', count(*) FROM orders WHERE o_orderkey % 10 IN (0, 2) UNION ALL SELECT 'NodeAdded', count(*) FROM supplier UNION ALL SELECT 'EdgeAdded', count(*) FROM supplier) WHERE n > 0"


@query(_EVENTS)
def store_events(spark, d):
    return journal.events(shop(spark, d).store.journal()).groupBy("event").agg(F.count("*").alias("n"))


@query(_EVENTS)
def change_stream(spark, d):
    seen = _fresh(spark, "events")
    follow = shop(spark, d).store.follow(lambda df, _: df.write.mode("append").parquet(seen), _fresh(spark, "offsets"))
    follow.awaitTermination(600)
    return spark.read.parquet(seen).groupBy("event").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS last, CAST(sum(n) AS BIGINT) + 1 AS next FROM ({_EVENTS})")
def store_counters(spark, d):
    store = shop(spark, d).store
    about = store.journal().agg(F.countDistinct("sequence", "change_id", "revision.counter").alias("rows"), F.max("sequence").alias("last"))
    return about.withColumn("next", F.lit(journal.next_counter(store.journal(), "shop")).cast("bigint"))


@query("SELECT error, CAST(n AS BIGINT) AS n FROM (VALUES ('EndpointMissing', 0), ('GraphError', 0), ('GraphError', 0), ('GraphError', 0), ('LastLabel', 0), ('NotFound', 0), ('NotFound', 0)) v(error, n)")
def store_refusals(spark, d):
    """What each breach of a rule raises, and how many journal rows it leaves."""
    store, one = shop(spark, d).store, spark.range(1)
    before = store.journal().count()
    node = lambda action, id, **c: _changes(one, action, "node", F.lit(id), **c)
    whole = F.array(F.lit("Customer"))
    frames = [
        node("patch", "nobody"), node("add", "order:1", labels=whole), node("remove_labels", "order:1", labels=F.array(F.lit("Order"))), node("add_labels", "nobody", labels=whole),
        _changes(one, "add", "edge", F.lit("e"), type=F.lit("T"), from_id=F.lit("order:1"), to_id=F.lit("nobody")), node("delete", "order:1").unionByName(node("delete", "order:1")),
    ]
    errors = []
    for frame in frames:
        try:
            store.apply(node("add", "new", labels=whole).unionByName(frame))
        except GraphError as e:
            errors.append((type(e).__name__, store.journal().count() - before))
    try:
        store.bulk_insert(one.select(F.lit("order:1").alias("id"), whole.alias("labels")))
    except GraphError as e:
        errors.append((type(e).__name__, store.journal().count() - before))
    return spark.createDataFrame(errors, "error string, n bigint")


# single mutations


@lru_cache(maxsize=8)
def _small(application: str, d: str) -> GraphStore:
    spark = SparkSession.getActiveSession()
    store = GraphStore.open(spark, _fresh(spark, "small"), actor="me")
    rows = read_table(spark, d, "customer").filter("c_custkey between 1 and 6").orderBy("c_custkey").collect()
    with store.transaction() as tx:
        for r in rows:
            tx.add_node(["Customer", f"N{r['c_nationkey']}"], {"name": r["c_name"], "acctbal": r["c_acctbal"]}, id=f"customer:{r['c_custkey']}")
        for k in range(1, 6):
            tx.add_edge(f"customer:{k}", f"customer:{k + 1}", "NEXT", {"weight": k}, id=f"next:{k}")
    store.update_node("customer:1", {"name": "patched", "acctbal": None})
    store.add_label("VIP", "customer:2")
    store.remove_label(f"N{rows[2]['c_nationkey']}", "customer:3")
    store.delete_node("customer:4")
    store.update_edge("next:1", {"weight": 100})
    store.delete_edge("next:2")
    for call, error in ((lambda: store.update_node("customer:4", {}), NotFound), (lambda: store.remove_label("Customer", "customer:3"), LastLabel), (lambda: store.add_edge("customer:1", "customer:4", "NEXT"), EndpointMissing), (lambda: store.add_node("Customer", id="customer:4"), GraphError)):
        try:
            call()
        except error:
            continue
        raise AssertionError(f"{error.__name__} was not raised")
    try:
        with store.transaction() as tx:
            tx.add_node("Customer", id="ghost")
            tx.update_node("customer:5", {"name": "ghost"})
            tx.delete_edge("next:5")
            raise KeyError
    except KeyError:
        pass
    return store


def small(spark: SparkSession, d: str) -> GraphStore:
    return _small(spark.sparkContext.applicationId, d)


@query("SELECT 'customer:' || c_custkey AS id, CASE c_custkey WHEN 2 THEN 'Customer,N' || c_nationkey || ',VIP' WHEN 3 THEN 'Customer' ELSE 'Customer,N' || c_nationkey END AS labels, CASE c_custkey WHEN 1 THEN 'patched' ELSE c_name END AS name, CASE c_custkey WHEN 1 THEN NULL ELSE c_acctbal END AS acctbal FROM customer WHERE c_custkey IN (1, 2, 3, 5, 6)")
def single_node_writes(spark, d):
    return small(spark, d).graph().all_nodes().unordered().select("id", F.array_join("labels", ",").alias("labels"), _value("name", "s"), _value("acctbal", "d"))


@query("SELECT 'next:' || k AS id, CAST(CASE k WHEN 1 THEN 100 ELSE k END AS BIGINT) AS weight FROM (VALUES (1), (3), (4), (5)) v(k)")
def single_edge_writes(spark, d):
    return small(spark, d).graph().edges("NEXT").unordered().select("id", _value("weight", "i"))


@query("SELECT k AS sequence, k AS counter, CASE WHEN k <= 6 THEN 'NodeAdded' WHEN k <= 11 THEN 'EdgeAdded' WHEN k <= 14 THEN 'NodeUpdated' WHEN k = 15 THEN 'NodeDeleted' WHEN k = 16 THEN 'EdgeUpdated' ELSE 'EdgeDeleted' END AS event, k > 11 AS has_base FROM range(1, 18) r(k)")
def single_writes_journal(spark, d):
    store = small(spark, d)
    based = store.journal().select("change_id", F.col("base_revision").isNotNull().alias("has_base"))
    return journal.events(store.journal()).join(based, "change_id").select("sequence", F.col("revision.counter").alias("counter"), "event", "has_base")


@query("SELECT CAST(5 AS BIGINT) AS nodes, CAST(4 AS BIGINT) AS edges, CAST(18 AS BIGINT) AS next")
def store_reopened(spark, d):
    g = GraphStore.open(spark, small(spark, d).path, actor="me")
    nodes, edges = (x.count_df().withColumnRenamed("count", name) for x, name in ((g.graph().all_nodes(), "nodes"), (g.graph().edges(), "edges")))
    return nodes.crossJoin(edges).withColumn("next", F.lit(journal.next_counter(g.journal(), "me")).cast("bigint"))  # a row each


# snapshots


@query(f"SELECT id, name FROM ({_CUSTOMER}) WHERE acctbal > 5000")
def snapshot_round_trip(spark, d):
    path = _fresh(spark, "snapshot")
    g = shop(spark, d).store.graph()
    write_snapshot(commerce(spark, d).without_dangling(), path)  # an older one, which is replaced
    write_snapshot(g, path)
    return read_snapshot(spark, path).nodes("Customer").where("acctbal", ">", 5000.0).unordered().select("id", _value("name", "s"))


@query("SELECT * FROM (VALUES ('damaged', false, false), ('disabled', false, true), ('missing', false, false), ('not written', false, false), ('sound', true, true)) v(name, loaded, kept)")
def snapshot_policies(spark, d):
    """Whether each kind of snapshot is loaded, and whether it is still there afterwards."""
    g = small(spark, d).graph()
    there = lambda path: bool(_listed(spark, path))
    out = []
    for name, policy in (("sound", "auto"), ("disabled", "disabled"), ("damaged", "auto"), ("missing", "auto"), ("not written", "auto")):
        path = _fresh(spark, "snapshot")
        if name != "missing":
            write_snapshot(g, path, policy="disabled" if name == "not written" else "auto")
        if name == "damaged":
            g.live_nodes().limit(1).write.mode("append").parquet(f"{path}/{_listed(spark, path)[0]}/nodes")
        loaded = load_or_discard(spark, path, policy) is not None
        out.append((name, loaded, there(path)))
    return spark.createDataFrame(out, "name string, loaded boolean, kept boolean")


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(p)] if files.exists(p) else []


@query("SELECT 'customer:' || c_custkey AS id, 'Customer' AS labels, '00000000-0000-0000-0000-000000000000' AS actor, CAST(0 AS BIGINT) AS counter, c_name AS name FROM customer")
def migrated_rows(spark, d):
    """Rows of the first schema: one label, properties as text, no revision."""
    text = F.to_json(_properties(name=("string", F.col("c_name"))))
    old = read_table(spark, d, "customer").select(_name("customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), text.alias("properties"), F.lit("2020-01-01").cast("timestamp").alias("modified_at"))
    return migrate(old, NODES, 1).select("id", F.array_join("labels", ",").alias("labels"), F.col("revision.actor_id").alias("actor"), F.col("revision.counter").alias("counter"), _value("name", "s"))


# synchronisation


@lru_cache(maxsize=8)
def _devices(application: str, d: str) -> SimpleNamespace:
    """Two stores that sync through a log: one adds customers, then both change some of them, in other fields."""
    spark = SparkSession.getActiveSession()
    c = read_table(spark, d, "customer").filter("c_nationkey < 5")
    id, k = _name("customer", "c_custkey"), F.col("c_custkey")
    backend = LogBackend(spark, _fresh(spark, "log"))
    a, b = (GraphStore.open(spark, _fresh(spark, "device"), actor=x) for x in "ab")
    ca, cb = Coordinator(a, backend), Coordinator(b, backend)
    rounds = []

    def run(name: str, c: Coordinator) -> None:
        s = c.run_once()
        rounds.append((len(rounds) + 1, name, s.state, s.pushed, s.pulled))

    a.apply(_changes(c, "add", "node", id, labels=F.array(F.lit("Customer")), properties=_properties(name=("string", F.col("c_name")), acctbal=("double", F.col("c_acctbal")))))
    run("a", ca), run("b", cb)
    a.apply(_changes(c.filter(k % 2 == 0), "patch", "node", id, properties=_properties(name=("string", F.lit("local")))))
    b.apply(_changes(c.filter(k % 5 == 0), "patch", "node", id, properties=_properties(acctbal=("double", F.lit(0.0)))).unionByName(_changes(c.filter(k % 10 == 3), "delete", "node", id)))
    for _ in range(2):
        run("a", ca), run("b", cb)
    return SimpleNamespace(a=a, b=b, coordinators=(ca, cb), backend=backend, rounds=rounds)


def devices(spark: SparkSession, d: str) -> SimpleNamespace:
    return _devices(spark.sparkContext.applicationId, d)


_SYNCED = "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'local' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS acctbal FROM customer WHERE c_nationkey < 5 AND c_custkey % 10 <> 3"


@query(f"SELECT s AS store, id, name, acctbal FROM ({_SYNCED}), (VALUES ('a'), ('b')) v(s)")
def sync_converges(spark, d):
    at = devices(spark, d)
    side = lambda store, name: store.graph().nodes("Customer").unordered().select(F.lit(name).alias("store"), "id", _value("name", "s"), _value("acctbal", "d"))
    return side(at.a, "a").unionByName(side(at.b, "b"))


_COUNTED = "(SELECT count(*) FROM customer WHERE c_nationkey < 5 AND {})"


@query(
    "SELECT CAST(round AS BIGINT) AS round, device, state, pushed, pulled FROM (VALUES (1, 'a', 'idle', {all}, 0), (2, 'b', 'idle', 0, {all}), (3, 'a', 'idle', {even}, 0), (4, 'b', 'idle', {own}, {even})) v(round, device, state, pushed, pulled)".format(
        all=_COUNTED.format("true"), even=_COUNTED.format("c_custkey % 2 = 0"), own=_COUNTED.format("(c_custkey % 5 = 0 OR c_custkey % 10 = 3)"))
)
def sync_rounds(spark, d):
    return spark.createDataFrame(devices(spark, d).rounds[:4], "round bigint, device string, state string, pushed bigint, pulled bigint")


@query("SELECT CAST(round AS BIGINT) AS round, state, CAST(pushed AS BIGINT) AS pushed, CAST(held AS BIGINT) AS held FROM (VALUES (1, 'offline', 0, 0), (2, 'idle', 1, 0)) v(round, state, pushed, held)")
def sync_offline(spark, d):
    """A round that cannot reach the log changes nothing; the next one goes on."""
    store, backend = GraphStore.open(spark, _fresh(spark, "device"), actor="a"), LogBackend(spark, _fresh(spark, "log"))
    store.add_node("P")
    sync, out, backend.fail_next = Coordinator(store, backend), [], 1
    for i in (1, 2):
        s = sync.run_once()
        out.append((i, s.state, s.pushed, 0 if s.pushed else backend.end()))
    return spark.createDataFrame(out, "round bigint, state string, pushed bigint, held bigint")


@query(_SYNCED)
def sync_last_versions(spark, d):
    """What the second device and the log have in common."""
    known = devices(spark, d).coordinators[1].versions.latest().filter("not deleted")
    return known.select(F.col("entity_id").alias("id"), _value("name", "s"), _value("acctbal", "d"))


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey < 5 AND c_custkey % 6 = 0")
def sync_conflicts(spark, d):
    """Both devices change one field, and the resolver leaves that to people."""
    c = read_table(spark, d, "customer").filter("c_nationkey < 5")
    id, k = _name("customer", "c_custkey"), F.col("c_custkey")
    backend = LogBackend(spark, _fresh(spark, "log"))
    a, b = (GraphStore.open(spark, _fresh(spark, "device"), actor=x) for x in "ab")
    ca, cb = (Coordinator(s, backend, resolver=field_level("fail")) for s in (a, b))
    name = lambda x: _properties(name=("string", F.lit(x)))
    a.apply(_changes(c, "add", "node", id, labels=F.array(F.lit("Customer")), properties=name("old")))
    ca.run_once(), cb.run_once()
    a.apply(_changes(c.filter(k % 2 == 0), "patch", "node", id, properties=name("a")))
    b.apply(_changes(c.filter(k % 3 == 0), "patch", "node", id, properties=name("b")))
    ca.run_once()
    return spark.createDataFrame([(cb.run_once().n_conflicts,)], "n bigint")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events' journal, by three actors, in the columns of JOURNAL."""
    j = _journal(spark, d).withColumns({"actor_id": (F.col("entity_id").cast("bigint") % 3).cast("string"), "graph_id": F.lit("main")})
    payload = F.struct(*(F.col(f"payload.{c}").alias(c) if c in ("properties", "labels") else F.lit(None).alias(c) for c in schema(JOURNAL)["payload"].dataType.fieldNames()))
    return j.withColumn("payload", payload).select(*(F.col(f.name).cast(f.dataType) for f in schema(JOURNAL)))


@query("SELECT event_id + 1 AS position FROM events WHERE event_id >= 200 AND event_id < 700 AND user_id % 3 <> 0")
def pull_since(spark, d):
    backend = LogBackend(spark, _fresh(spark, "log"))
    backend.push(_log(spark, d))
    return backend.pull(200, "0", 500).select("position")


@query("SELECT count(*) AS accepted, count(*) FILTER (event_id % 2 = 1) AS fresh, count(*) AS held FROM events")
def push_again(spark, d):
    backend, rows = LogBackend(spark, _fresh(spark, "log")), _log(spark, d)
    backend.push(rows.filter("sequence % 2 = 0"))
    accepted, fresh = backend.push(rows)
    return accepted.agg(F.countDistinct("change_id").alias("accepted")).withColumns({"fresh": F.lit(fresh).cast("bigint"), "held": F.lit(backend.end()).cast("bigint")})


@query("SELECT CAST(step AS BIGINT) AS step, backend, state FROM (VALUES (1, 'log', 'idle'), (2, 'log', 'syncing'), (3, 'log', 'idle'), (4, 'log', 'syncing'), (5, 'log', 'offline'), (6, 'none', 'unknown')) v(step, backend, state)")
def sync_statuses(spark, d):
    told = []
    sync = Synchroniser(GraphStore.open(spark, _fresh(spark, "device"), actor="a"))
    sync.watch(lambda name, s: told.append((len(told) + 1, name, s.state)))
    backend = LogBackend(spark, _fresh(spark, "log"))
    sync.enable("log", backend)
    sync.sync_now("log")
    sync.store.add_node("P")
    backend.fail_next = 1
    sync.sync_now("log")
    sync.disable("log")
    try:
        sync.sync_now("log")
    except LookupError:
        told.append((len(told) + 1, "none", "unknown"))
    return spark.createDataFrame(told, "step bigint, backend string, state string")


@query("SELECT * FROM (VALUES ('idempotent_push'), ('resume'), ('round_trip')) v(held)")
def backend_contract(spark, d):
    """The checks that a log backend holds to."""

    def make() -> Make:
        path = _fresh(spark, "log")
        return lambda: LogBackend(spark, path)

    held = []
    for check in CHECKS:
        check(spark, make)
        held.append((check.__name__,))
    return spark.createDataFrame(held, "held string")
