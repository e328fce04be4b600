"""The graph queries by name, each with the SQL that gives the same rows on the same tables.

Results are ids and scalars only. Sums of doubles are rounded, as the order of addition is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.properties import Properties
from .graph import PropertyGraph
from .operators import adjacency, journal
from .operators.merge import MAP, field_level, local_wins, resolve_changes
from .sources.mapping import acquaintances, commerce, event_chains, lattice, read_table
from .types import prop_struct

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# sources


@query("SELECT count(*) AS n FROM customer")
def nodes_labeled_count(spark, d):
    return commerce(spark, d).nodes("Customer").count_df().select(F.col("count").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id, 'BUILDING' AS label FROM customer WHERE c_mktsegment = 'BUILDING'")
def multi_label_scan(spark, d):
    return commerce(spark, d).nodes("BUILDING").to_df().select("id", "label")


@query("SELECT label, count(*) AS n FROM (SELECT 'Customer' AS label FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT 'Nation' FROM nation UNION ALL SELECT 'Region' FROM region UNION ALL SELECT 'Supplier' FROM supplier UNION ALL SELECT 'Part' FROM part UNION ALL SELECT 'Order' FROM orders) GROUP BY label")
def label_counts(spark, d):
    return commerce(spark, d).labels().select("label", F.col("count").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def node_by_id(spark, d):
    return commerce(spark, d).node("customer:7").to_df().select("id", F.col("name__string").alias("name"))


@query("SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS from_id, 'order:' || o_orderkey AS to_id FROM orders WHERE o_orderkey = 7")
def edge_by_id(spark, d):
    return commerce(spark, d).edge("placed:7").select("id", "from_id", "to_id")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey = 7")
def scan_where_equals(spark, d):
    return _ids(commerce(spark, d).nodes_where("nationkey", equals=7).to_df())


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 9000")
def scan_where_gt(spark, d):
    return _ids(commerce(spark, d).nodes_where("acctbal", gt=9000.0).to_df())


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < -500")
def scan_where_lt(spark, d):
    return _ids(commerce(spark, d).nodes_where("acctbal", lt=-500.0).to_df())


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size IN (3, 14, 15)")
def scan_where_in(spark, d):
    return _ids(commerce(spark, d).nodes_where("size", in_=[3, 14, 15, "3"]).to_df())


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 5)")
def property_index_lookup(spark, d):
    g = commerce(spark, d)
    name = g.node("customer:5").first()["name__string"]
    return _ids(g.lookup("Customer", "name", name))


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_custkey = 11")
def edges_from_node(spark, d):
    return commerce(spark, d).edges_from("customer:11", "PLACED").select(F.col("to_id").alias("id"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 3")
def edges_to_node(spark, d):
    return commerce(spark, d).edges_to("nation:3", "IN_NATION").select(F.col("from_id").alias("id"))


@query("SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS from_id FROM orders")
def edges_of_type(spark, d):
    return commerce(spark, d).edges_of_type("PLACED").select("id", "from_id")


# filters

_CUSTOMERS = "SELECT 'customer:' || c_custkey AS id FROM customer WHERE "


@query(_CUSTOMERS + "c_nationkey = 7")
def where_equals(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", equals=7).to_df())


@query(_CUSTOMERS + "c_acctbal > 5000")
def where_gt(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("acctbal", gt=5000.0).to_df())


@query(_CUSTOMERS + "c_acctbal < 0")
def where_lt(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("acctbal", lt=0.0).to_df())


@query(_CUSTOMERS + "c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_in(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("mktsegment", in_=["BUILDING", "MACHINERY", 3]).to_df())


@query(_CUSTOMERS + "false")
def where_in_empty(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("mktsegment", in_=[]).to_df())


def _where_op(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        return _ids(commerce(spark, d).nodes("Customer").where("nationkey", op, 12).to_df())

    run.__name__ = f"where_op_{name}"
    query(f"{_CUSTOMERS}c_nationkey {sql} 12")(run)


for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<=")):
    _where_op(_name, _op, _sql)


@query(_CUSTOMERS + "c_acctbal > 0 AND c_nationkey <= 4 AND contains(lower(c_name), '1')")
def where_chained(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("acctbal", ">", 0.0).where("nationkey", "<=", 4).where("name", contains="1").to_df())


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
def where_op_date(spark, d):
    import datetime as dt

    return _ids(commerce(spark, d).nodes("Order").where("orderdate", ">=", dt.datetime(1997, 1, 1)).to_df())


@query(_CUSTOMERS + "false")
def where_type_mismatch_declarative(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "!=", "7").to_df())


@query(_CUSTOMERS + "true")
def where_type_mismatch_sequential(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where(lambda p: F.lit(True)).where("nationkey", "!=", "7").to_df())


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'an')")
def where_contains(spark, d):
    return _ids(commerce(spark, d).nodes("Part").where("name", contains="AN").to_df())


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 7 = 3")
def where_contains_special(spark, d):
    parts = commerce(spark, d).live_nodes("Part").withColumn("title__string", F.concat(F.col("name__string"), F.when(F.col("size__int") % 7 == 3, " 100%_OFF\\").otherwise(" 100 off")))
    return _ids(PropertyGraph(spark, {"Part": parts}, {}).nodes("Part").where("title", contains="0%_off\\").to_df())


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'an') AND p_size > 10")
def where_contains_sequential(spark, d):
    return _ids(commerce(spark, d).nodes("Part").where("size", gt=10).where("name", contains="AN").to_df())


def _odd_keys(spark: SparkSession, d: str) -> PropertyGraph:
    """Parts with one property whose key has marks, in the map."""
    parts = commerce(spark, d).live_nodes("Part")
    properties = F.map_from_arrays(F.array(F.lit("size's `a.b` $.x")), F.array(prop_struct("int", F.col("size__int"))))
    return PropertyGraph(spark, {"Part": parts.select("id", "labels", "label", "seq", properties.alias("properties"))}, {})


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size >= 40")
def where_key_as_it_is(spark, d):
    return _ids(_odd_keys(spark, d).nodes("Part").where("size's `a.b` $.x", ">=", 40).to_df())


@query("SELECT 'customer:' || c_custkey AS id, 'Customer' AS label, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS acctbal, c_mktsegment AS segment, c_custkey AS seq FROM customer WHERE c_nationkey = 7")
def whole_rows(spark, d):
    rows = commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).to_df()
    return rows.select("id", F.array_max(F.array_intersect("labels", F.array(F.lit("Customer")))).alias("label"), F.col("name__string").alias("name"), F.col("nationkey__int").alias("nation"), F.col("acctbal__double").alias("acctbal"), F.col("mktsegment__string").alias("segment"), "seq")


@query(_CUSTOMERS + "c_acctbal * 2 > 10000 AND c_nationkey % 2 = 0")
def where_closure(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where(lambda p: (p.number("acctbal") * 2 > 10000) & (p.field("nationkey", "int") % 2 == 0)).to_df())


# order


@query("SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
def sorted_limit_offset(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").sorted("acctbal", False).limit(10, 5).to_df())


@query("SELECT 'customer:' || c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def topk(spark, d):
    return commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).sorted("acctbal", False).limit(5).to_df().select("id", F.col("acctbal__double").alias("acctbal"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY c_name, c_custkey LIMIT 3")
def last_sort_and_limit_count(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").sorted("acctbal").limit(50).sorted("name").limit(3).to_df())


@query("SELECT id FROM (SELECT 'customer:' || c_custkey AS id, c_name, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50) ORDER BY c_name, id LIMIT 3")
def each_sort_and_limit_counts(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where(lambda p: F.lit(True)).sorted("acctbal").limit(50).sorted("name").limit(3).to_df())


_MIXED = "SELECT 'customer:' || c_custkey AS id, c_acctbal AS b, c_custkey AS k FROM customer UNION ALL SELECT 'nation:' || n_nationkey, NULL, n_nationkey FROM nation"


@query(f"SELECT id FROM ({_MIXED}) ORDER BY b ASC NULLS FIRST, k, id LIMIT 30")
def sort_missing_declarative(spark, d):
    return _ids(_customers_and_nations(spark, d).all_nodes().sorted("acctbal").limit(30).to_df())


@query(f"SELECT id FROM ({_MIXED}) ORDER BY b DESC NULLS LAST, k, id LIMIT 30 OFFSET 1490")
def sort_missing_descending(spark, d):
    return _ids(_customers_and_nations(spark, d).all_nodes().sorted("acctbal", False).limit(30, 1490).to_df())


@query(f"SELECT id FROM ({_MIXED}) ORDER BY b ASC NULLS LAST, k, id LIMIT 30")
def sort_missing_sequential(spark, d):
    return _ids(_customers_and_nations(spark, d).all_nodes().where(lambda p: F.lit(True)).sorted("acctbal").limit(30).to_df())


def _customers_and_nations(spark: SparkSession, d: str) -> PropertyGraph:
    g = commerce(spark, d)
    return PropertyGraph(spark, {k: g.node_views[k] for k in ("Customer", "Nation")}, g.edge_views)


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 40")
def limit_then_filter_declarative(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").limit(40).where("acctbal", ">", 0.0).to_df())


@query("SELECT id FROM (SELECT 'customer:' || c_custkey AS id, c_acctbal FROM customer ORDER BY c_custkey LIMIT 40) WHERE c_acctbal > 0")
def limit_then_filter_sequential(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").limit(40).where("acctbal", gt=0.0).to_df())


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 1")
def first_node(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).limit(1).to_df())


# aggregates


@query("SELECT round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey = 7")
def sum_prop(spark, d):
    return commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).sum_df("acctbal").select(F.round("sum", 2).alias("total"))


@query("SELECT CAST(0 AS DOUBLE) AS total FROM region WHERE r_regionkey = 0")
def sum_empty(spark, d):
    return commerce(spark, d).nodes("Nobody").sum_df("acctbal").select(F.col("sum").alias("total"))


@query("SELECT round(avg(c_acctbal), 4) AS mean FROM customer")
def avg_declarative(spark, d):
    return _customers_and_nations(spark, d).all_nodes().avg_df("acctbal").select(F.round("avg", 4).alias("mean"))


@query("SELECT round((SELECT sum(c_acctbal) FROM customer) / ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)), 4) AS mean")
def avg_sequential(spark, d):
    return _customers_and_nations(spark, d).all_nodes().where(lambda p: F.lit(True)).avg_df("acctbal").select(F.round("avg", 4).alias("mean"))


@query("SELECT min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
def min_max_prop(spark, d):
    q = commerce(spark, d).nodes("Customer")
    one = lambda df, c, name: df.select(F.lit(1).alias("one"), F.col(f"{c}.d").alias(name))
    return one(q.min_df("acctbal"), "min", "least").join(one(q.max_df("acctbal"), "max", "most"), "one").drop("one")


@query("SELECT min(p_name) AS least FROM part")
def min_string(spark, d):
    return commerce(spark, d).nodes("Part").min_df("name").select(F.col("min.s").alias("least"))


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_nationkey = 7")
def exists_node(spark, d):
    return commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).count_df().select((F.col("count") > 0).alias("found"))


# edge queries


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 3")
def edge_where_sort_limit(spark, d):
    return _ids(commerce(spark, d).edges("PLACED").where("totalprice", ">", 100000.0).sorted("totalprice", False).limit(20, 3).to_df())


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_custkey = 11 AND contains(lower(o_orderstatus), 'o')")
def edge_from_contains(spark, d):
    return _ids(commerce(spark, d).edges(from_="customer:11").where("orderstatus", contains="O").to_df())


@query("SELECT 'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id FROM lineitem WHERE l_partkey = 5")
def edge_to(spark, d):
    return _ids(commerce(spark, d).edges(to="part:5").to_df())


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_totalprice / 2 > 100000")
def edge_closure(spark, d):
    return _ids(commerce(spark, d).edges("PLACED").where(lambda p: p.number("totalprice") / 2 > 100000).to_df())


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_discount > 0.05")
def edge_aggregates(spark, d):
    q = commerce(spark, d).edges("CONTAINS").where("discount", ">", 0.05)
    parts = [q.count_df().select(F.col("count").alias("n")), q.sum_df("quantity").select(F.round("sum", 2).alias("total")), q.avg_df("quantity").select(F.round("avg", 4).alias("mean")), q.min_df("quantity").select(F.col("min.d").alias("least")), q.max_df("quantity").select(F.col("max.d").alias("most"))]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


@query("SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'SUPPLIES_FROM', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem")
def edge_scan(spark, d):
    return commerce(spark, d).edges().unordered().groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT id FROM (SELECT 'placed:' || o_orderkey AS id, o_orderkey FROM orders WHERE o_totalprice > 50000 ORDER BY o_totalprice, o_orderkey LIMIT 30) ORDER BY id LIMIT 30")
def edge_sequential_sort_limit(spark, d):
    return _ids(commerce(spark, d).edges("PLACED").where(lambda p: p.number("totalprice") > 50000).sorted("totalprice").limit(30).to_df())


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first_edge(spark, d):
    row = commerce(spark, d).edges("PLACED").where("totalprice", ">", 100000.0).sorted("totalprice").first()
    return spark.createDataFrame([(row["id"],)] if row else [], "id string")


@query("SELECT 'customer:' || c_custkey AS id, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY c_custkey")
def sql_views(spark, d):
    g = commerce(spark, d)
    PropertyGraph(spark, {"Customer": g.node_views["Customer"]}, {"PLACED": g.edge_views["PLACED"]}).register("commerce")
    return spark.sql("SELECT n.id, count(*) AS n FROM commerce_nodes n JOIN commerce_edges e ON e.from_id = n.id WHERE n.nationkey__int = 7 GROUP BY n.id")


# traversal

_KNOWS = "knows AS (SELECT c_custkey AS a, (c_custkey * m + k) % (SELECT count(*) FROM customer) AS b, slot FROM customer, (VALUES (7, 3, 0), (11, 5, 1), (13, 1, 2)) v(m, k, slot))"


def _reach_sql(start: str, depth: int) -> str:
    return f"WITH RECURSIVE {_KNOWS}, r AS (SELECT CAST({start} AS BIGINT) AS id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN knows ON a = id WHERE hop < {depth}) SELECT DISTINCT 'customer:' || id AS id FROM r WHERE id <> {start}"


@query("SELECT 'order:' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def traverse_out_1(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).traverse("out", "PLACED").to_df())


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def traverse_in_1(spark, d):
    g = commerce(spark, d)
    return _ids(g.node("region:2").traverse("in", "IN_REGION").traverse("in", "IN_NATION").to_df())


@query("SELECT 'region:' || n_regionkey AS id FROM nation WHERE n_nationkey = 7 UNION SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 7 UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 7")
def traverse_both_any(spark, d):
    return _ids(commerce(spark, d).node("nation:7").traverse("both").to_df())


@query(_reach_sql("17", 3))
def traverse_cycle_3(spark, d):
    return _ids(acquaintances(spark, d).node("customer:17").traverse("out", "KNOWS", 3).to_df())


@query(_reach_sql("17", 5))
def traverse_cycle_5(spark, d):
    return _ids(acquaintances(spark, d).node("customer:17").traverse("out", "KNOWS", 5).to_df())


@query("WITH s AS (SELECT min_by(event_id, (ts, event_id)) AS e, user_id FROM events WHERE user_id IN (SELECT min(user_id) FROM events) GROUP BY user_id) SELECT 'event:' || event_id AS id FROM events JOIN s USING (user_id) WHERE event_id <> e")
def traverse_unlimited(spark, d):
    g = event_chains(spark, d)
    user = read_table(spark, d, "events").agg(F.min("user_id").alias("u"))
    first = read_table(spark, d, "events").join(user, F.col("user_id") == F.col("u")).agg(F.min_by("event_id", F.struct("ts", "event_id"))).first()[0]
    return _ids(g.node(f"event:{first}").traverse("out", "NEXT", None).to_df())


@query("SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def traverse_chain(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).traverse("out", "PLACED").traverse("out", "CONTAINS").to_df())


@query("SELECT DISTINCT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 9)")
def traverse_there_and_back(spark, d):
    return _ids(commerce(spark, d).node("customer:9").traverse("out", "IN_NATION").traverse("in", "IN_NATION").to_df())


@query("SELECT 'order:' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND o_totalprice > 150000 AND o_orderstatus <> 'F'")
def traverse_then_filter(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).traverse("out", "PLACED").where("totalprice", ">", 150000.0).where("orderstatus", "!=", "F").to_df())


@query("SELECT id FROM (SELECT 'order:' || o_orderkey AS id, row_number() OVER (ORDER BY c_custkey, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7) WHERE r BETWEEN 6 AND 15")
def traverse_then_limit(spark, d):
    return _ids(commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).traverse("out", "PLACED").limit(10, 5).to_df())


@query(f"WITH {_KNOWS}, one AS (SELECT b AS id FROM knows WHERE a = 17) SELECT 'knows:' || a || ':' || slot AS id FROM knows WHERE a = 17 OR (a IN (SELECT id FROM one) AND a <> 17)")
def collect_with_edges(spark, d):
    return _ids(acquaintances(spark, d).node("customer:17").traverse("out", "KNOWS", 2).with_edges()[1])


@query(f"WITH {_KNOWS}, near AS (SELECT DISTINCT id FROM (SELECT b AS id FROM knows WHERE a = 17 UNION SELECT a FROM knows WHERE b = 17 UNION SELECT 17)) SELECT 'knows:' || a || ':' || slot AS id FROM knows WHERE a IN (SELECT id FROM near) UNION ALL SELECT 'knows:' || a || ':' || slot FROM knows WHERE b IN (SELECT id FROM near)")
def collect_with_edges_both(spark, d):
    return _ids(acquaintances(spark, d).node("customer:17").traverse("both", "KNOWS", 2).with_edges()[1])


# paths

#: Keys of customers some steps of different slots away from customer 17, whatever their number.
_AWAY = {0: "17"}
for _hop, (_m, _k) in enumerate(((7, 3), (11, 5), (13, 1), (7, 3)), 1):
    _AWAY[_hop] = f"(({_AWAY[_hop - 1]} * {_m} + {_k}) % (SELECT count(*) FROM customer))"


def _away(spark: SparkSession, d: str, hops: int) -> str:
    n, at = read_table(spark, d, "customer").count(), 17
    for m, k in ((7, 3), (11, 5), (13, 1), (7, 3))[:hops]:
        at = (at * m + k) % n
    return f"customer:{at}"


def _paths_sql(start: str, target: str, depth: int, steps: str) -> str:
    """Simple paths by plain recursion over ``steps`` (a, b, edge, seq)."""
    return f"""WITH RECURSIVE {steps}, p AS (SELECT CAST({start} AS BIGINT) AS pos, [CAST({start} AS BIGINT)] AS nodes, CAST([] AS VARCHAR[]) AS edges, CAST([] AS BIGINT[]) AS seqs
UNION ALL SELECT b, list_append(nodes, b), list_append(edges, edge), list_append(seqs, seq) FROM p JOIN steps ON a = pos WHERE len(edges) < {depth} AND pos <> {target} AND NOT list_contains(nodes, b))"""


_KNOWN = f"{_KNOWS}, steps AS (SELECT a, b, 'knows:' || a || ':' || slot AS edge, a * 3 + slot AS seq FROM knows)"
_LATTICE = "steps AS (SELECT c_custkey AS a, c_custkey + way AS b, kind || ':' || c_custkey AS edge, c_custkey * 2 + slot AS seq FROM customer, (VALUES ('right', 1, 0), ('down', 10, 1)) v(kind, way, slot))"
_FIRST = " SELECT len(edges) AS length, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges FROM p WHERE pos = {} ORDER BY len(edges), seqs LIMIT 1"
_EACH = " SELECT len(edges) AS length, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges FROM p WHERE pos = {}"


def _path_rows(df: DataFrame) -> DataFrame:
    keys = F.transform("node_ids", lambda x: F.replace(x, F.lit("customer:"), F.lit("")))
    return df.select(F.col("length").cast("long").alias("length"), F.array_join(keys, ",").alias("nodes"), F.array_join("edge_ids", ",").alias("edges"))


@query(_paths_sql("17", _AWAY[4], 4, _KNOWN) + _FIRST.format(_AWAY[4]))
def shortest_path(spark, d):
    return _path_rows(acquaintances(spark, d).shortest_path("customer:17", _away(spark, d, 4), "KNOWS"))


@query(_paths_sql("12", "45", 6, _LATTICE) + _FIRST.format(45))
def shortest_path_among_equals(spark, d):
    return _path_rows(lattice(spark, d).shortest_path("customer:12", "customer:45"))


@query("SELECT 0 AS length WHERE false")
def shortest_path_none(spark, d):
    return commerce(spark, d).shortest_path("nation:3", "customer:1", "IN_REGION").select("length")


@query("SELECT CAST(0 AS BIGINT) AS length, '12' AS nodes, '' AS edges")
def shortest_path_to_itself(spark, d):
    return _path_rows(lattice(spark, d).shortest_path("customer:12", "customer:12"))


@query(_paths_sql("17", _AWAY[3], 5, _KNOWN) + _EACH.format(_AWAY[3]))
def all_paths(spark, d):
    return _path_rows(acquaintances(spark, d).all_paths("customer:17", _away(spark, d, 3), 5, "KNOWS"))


@query(_paths_sql("12", "45", 6, _LATTICE) + _EACH.format(45))
def all_paths_among_equals(spark, d):
    return _path_rows(lattice(spark, d).all_paths("customer:12", "customer:45", 6))


@query(_paths_sql("12", "15", 6, _LATTICE) + " SELECT count(*) AS n FROM p WHERE pos = 15 AND edges[1] LIKE 'right%'")
def all_paths_by_type(spark, d):
    return lattice(spark, d).all_paths("customer:12", "customer:15", 6, "RIGHT").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM region WHERE false")
def all_paths_too_short(spark, d):
    return lattice(spark, d).all_paths("customer:12", "customer:45", 5).agg(F.count("*").alias("n"))


# adjacency


@query("SELECT 'customer:' || c_custkey AS id, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def out_degree(spark, d):
    g = commerce(spark, d)
    return adjacency.degrees(g.live_nodes("Customer"), g.live_edges("PLACED"), "out")


@query("SELECT 'part:' || p_partkey AS id, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def in_degree(spark, d):
    g = commerce(spark, d)
    return adjacency.degrees(g.live_nodes("Part"), g.live_edges("CONTAINS"), "in")


@query("SELECT 'placed:' || o_orderkey AS edge_id, 'order:' || o_orderkey AS id FROM orders WHERE o_custkey = 11")
def neighbours(spark, d):
    return commerce(spark, d).neighbours("customer:11", "out", "PLACED")


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def dangling_edges_dropped(spark, d):
    g = commerce(spark, d)
    customers = g.nodes("Customer").where("nationkey", "<", 5).unordered()
    return _ids(adjacency.attached(customers.unionByName(g.live_nodes("Order"), allowMissingColumns=True), g.live_edges("PLACED")))


# the journal: events of a user are changes of one entity, an error is a deletion


def _journal(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    props = F.map_from_arrays(F.array(F.lit("k"), F.lit("value")), F.array(prop_struct("int", F.get_json_object("props", "$.k").cast("bigint")), prop_struct("double", F.col("value"))))
    payload = F.struct(props.alias("properties"), F.array(F.col("event_type")).alias("labels"))
    revision = F.struct(F.lit("a").alias("actor_id"), F.col("event_id").alias("counter"), F.col("ts").alias("wall_clock"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    base = F.when(~first, F.struct(F.lit("a").alias("actor_id"), (F.col("event_id") - 1).alias("counter"), F.col("ts").alias("wall_clock")))
    return e.select(F.col("event_id").alias("sequence"), F.col("event_id").cast("string").alias("change_id"), F.lit("a").alias("actor_id"), F.lit("node").alias("entity_kind"), F.col("user_id").cast("string").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), payload.alias("payload"), base.alias("base_revision"), revision.alias("revision"), F.col("ts").alias("created_at"))


_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"


@query(f"SELECT CAST(user_id AS VARCHAR) AS id, event_id AS sequence, round(value, 6) AS value FROM ({_NEWEST}) WHERE event_type <> 'error'")
def journal_state_fold(spark, d):
    live = journal.fold(_journal(spark, d)).filter("operation = 'upsert'")
    return live.select(F.col("entity_id").alias("id"), "sequence", F.round(F.element_at("payload.properties", "value")["d"], 6).alias("value"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS id, event_id AS sequence FROM ({_NEWEST}) WHERE event_type <> 'error'")
def journal_fold_one_actor(spark, d):
    return journal.fold(_journal(spark, d), one_actor=True).filter("operation = 'upsert'").select(F.col("entity_id").alias("id"), "sequence")


@query("SELECT event_id AS sequence FROM events WHERE event_id > 100")
def journal_tail(spark, d):
    return journal.tail(_journal(spark, d), 100).select("sequence")


@query("SELECT event_id AS sequence FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_id = 50) ORDER BY event_id DESC LIMIT 1")
def journal_latest_row(spark, d):
    j = _journal(spark, d)
    user = j.filter("sequence = 50").first()["entity_id"]
    return journal.latest_row(j, "node", user).select("sequence")


@query("SELECT count(*) AS n FROM events")
def journal_count(spark, d):
    return journal.count(_journal(spark, d))


@query(f"SELECT CAST(user_id AS VARCHAR) AS id FROM ({_NEWEST}) WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29 00:00:00'")
def tombstones_since(spark, d):
    import datetime as dt

    return journal.tombstones(journal.fold(_journal(spark, d)), "node", dt.datetime(2024, 1, 29)).select("id")


@query("SELECT event_id AS sequence FROM events WHERE event_type = 'purchase' OR event_type = 'signup' AND event_id % 2 = 0")
def invalid_changes(spark, d):
    j = _journal(spark, d)
    kind = F.element_at("payload.labels", 1)
    odd = j.withColumns({"payload": F.when(kind == "purchase", F.lit(None)).otherwise(F.col("payload")), "operation": F.when((kind == "signup") & (F.col("sequence") % 2 == 0), "move").otherwise(F.col("operation"))})
    return journal.invalid(odd).select("sequence")


@query("SELECT event_id AS sequence, CASE WHEN event_type = 'error' THEN 'NodeDeleted' WHEN r = 1 THEN 'NodeAdded' ELSE 'NodeUpdated' END AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)")
def mutation_events(spark, d):
    return journal.events(_journal(spark, d)).select("sequence", "event")


@query("SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS from_id FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 10 <> 1 UNION ALL SELECT 'placed:' || o_orderkey, 'moved' FROM orders WHERE o_orderkey % 10 = 1")
def edge_log_merge(spark, d):
    base = commerce(spark, d).live_edges("PLACED")
    number = F.col("seq") % 10
    revision = F.struct(F.lit("a").alias("actor_id"), F.col("seq").alias("counter"), F.lit("2020-01-01").cast("timestamp").alias("wall_clock"))
    log = base.filter(number <= 1).select("id", F.lit("moved").alias("from_id"), "to_id", "type", F.when(number == 0, "delete").otherwise("insert").alias("action"), revision.alias("revision"), F.col("seq").alias("position"))
    return adjacency.overlay(base, log).select("id", "from_id")


_LOG_ROWS = "FROM orders WHERE o_custkey = 11 AND o_orderkey % 3 < 2"


def _edge_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders' edges, and a log that deletes each third of them and moves the next to customer 0."""
    base = commerce(spark, d).live_edges("PLACED")
    number = F.col("seq") % 3
    revision = F.struct(F.lit("a").alias("actor_id"), F.col("seq").alias("counter"), F.lit("2020-01-01").cast("timestamp").alias("wall_clock"))
    log = base.filter(number < 2).select("id", "from_id", F.when(number == 0, F.col("to_id")).otherwise("order:0").alias("to_id"), "type", F.when(number == 0, "delete").otherwise("insert").alias("action"), revision.alias("revision"), F.col("seq").alias("position"))
    return base, log


@query(f"SELECT 'placed:' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'insert' END AS action {_LOG_ROWS}")
def log_entries_from(spark, d):
    return adjacency.outgoing_entries(_edge_log(spark, d)[1], "customer:11").select("id", "action")


@query("SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 1 UNION SELECT 'placed:' || o_orderkey FROM orders WHERE o_orderkey = 0")
def log_entries_to(spark, d):
    return adjacency.incoming_entries(_edge_log(spark, d)[1], "order:0", "PLACED").select("id")


@query("SELECT 'placed:' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'order:0' ELSE 'order:' || o_orderkey END AS to_id, o_totalprice AS totalprice, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 > 0")
def edge_log_compacted(spark, d):
    return adjacency.compact(*_edge_log(spark, d)).select("id", "to_id", F.col("totalprice__double").alias("totalprice"), F.col("orderstatus__string").alias("status"))


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_nationkey < 5 THEN 'patched' ELSE c_name END AS name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS acctbal FROM customer")
def patch_merge(spark, d):
    nodes = commerce(spark, d).live_nodes("Customer")
    old = F.map_from_arrays(F.array(F.lit("name"), F.lit("acctbal")), F.array(prop_struct("string", F.col("name__string")), prop_struct("double", F.col("acctbal__double"))))
    patch = F.map_from_arrays(F.array(F.lit("name"), F.lit("acctbal")), F.array(prop_struct("string", F.lit("patched")), prop_struct("null", F.lit(None))))
    rows = nodes.select("id", journal.patched(old, F.when(F.col("nationkey__int") < 5, patch)).alias("properties"))
    p = Properties(rows.columns)
    return rows.select("id", p.field("name", "string").alias("name"), p.field("acctbal", "double").alias("acctbal"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, local and remote versions of the customers: each side changed the balance of some and the segment of others."""
    c = read_table(spark, d, "customer")

    def side(segment, balance, counter):
        properties = F.map_from_arrays(F.array(F.lit("segment"), F.lit("balance")), F.array(prop_struct("string", segment), prop_struct("double", balance))).cast(MAP)
        return c.select(F.lit("node").alias("entity_kind"), F.col("c_custkey").cast("string").alias("entity_id"), properties.alias("properties"), F.lit(False).alias("deleted"), F.struct(F.lit("a").alias("actor_id"), counter.cast("bigint").alias("counter"), F.lit(None).cast("timestamp").alias("wall_clock")).alias("revision"))

    k, seg, bal = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    base = side(seg, bal, F.lit(1))
    local = side(F.when(k % 2 == 0, F.lit("local")).otherwise(seg), bal, F.when(k % 2 == 0, 2).otherwise(1))
    remote = side(F.when(k % 3 == 0, F.lit("remote")).otherwise(seg), F.when(k % 5 == 0, F.lit(0.0)).otherwise(bal), F.lit(3))
    return base, local, remote


_MERGED = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN '{both}' WHEN c_custkey % 2 = 0 THEN 'local' WHEN c_custkey % 3 = 0 THEN 'remote' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS balance FROM customer"


def _merged(df: DataFrame) -> DataFrame:
    p = F.col("resolution.properties")
    return df.select(F.col("entity_id").alias("id"), F.element_at(p, "segment")["s"].alias("segment"), F.element_at(p, "balance")["d"].alias("balance"))


@query(_MERGED.replace("{both}", "remote"))
def field_merge_remote(spark, d):
    return _merged(resolve_changes(*_versions(spark, d), field_level("remote")))


@query(_MERGED.replace("{both}", "local"))
def field_merge_local(spark, d):
    return _merged(resolve_changes(*_versions(spark, d), field_level("local")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'fail' WHEN c_custkey % 2 = 0 THEN 'merge' ELSE 'useRemote' END AS action FROM customer")
def field_merge_conflicts(spark, d):
    return resolve_changes(*_versions(spark, d), field_level("fail")).select(F.col("entity_id").alias("id"), "resolution.action")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'useLocal' ELSE 'useRemote' END AS action FROM customer")
def local_wins_actions(spark, d):
    return resolve_changes(*_versions(spark, d), local_wins).select(F.col("entity_id").alias("id"), "resolution.action")


@query("SELECT event_id AS sequence FROM events WHERE event_id % 2 = 1")
def push_dedupe(spark, d):
    j = _journal(spark, d)
    return journal.append_new(j.filter("sequence % 2 = 0"), j.unionByName(j)).select("sequence")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation, two hops out to the parts they ordered, the dearest first."""
    q = commerce(spark, d).nodes("Customer").where("nationkey", "=", 7).traverse("out", "PLACED").traverse("out", "CONTAINS").sorted("retailprice", False).limit(20)
    return q.to_df().select("id", F.col("name__string").alias("name"), F.col("retailprice__double").alias("retailprice"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "SELECT DISTINCT 'part:' || p_partkey AS id, p_name AS name, p_retailprice AS retailprice, p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 20"
ORACLES["flagship"] = f"SELECT id, name, retailprice FROM ({ORACLES['flagship']})"
