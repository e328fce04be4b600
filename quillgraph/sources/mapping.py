"""Graphs over relational tables: a table's rows are nodes, its keys are edges.

Each property is promoted to a flat column ``key__tag``, so a predicate on it is a predicate on the table's own column
and reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: Spark's type names -> tag of the property.
TAGS = {"string": "string", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "boolean": "bool", "timestamp": "date", "timestamp_ntz": "date", "date": "date", "binary": "data"}
_CAST = {"int": "bigint", "double": "double", "date": "timestamp"}


@dataclass(frozen=True)
class NodeTable:
    """A table whose rows are nodes. ``labels`` may add a column whose value is a further label."""

    label: str
    table: str
    key: str
    prefix: str = ""
    more_labels: str | None = None


@dataclass(frozen=True)
class EdgeTable:
    """A table whose rows are edges; ``ids``, ``from_`` and ``to`` are SQL expressions over it."""

    type: str
    table: str
    id: str
    from_: str
    to: str
    seq: str
    ends: tuple[str, str]
    properties: tuple[str, ...] = ()
    prefix: str = ""


def flat(df: DataFrame, columns: list[str], prefix: str) -> list[Column]:
    """The promoted properties of some columns, with a prefix of their names stripped."""
    out = []
    for name, kind in df.dtypes:
        if name in columns and kind in TAGS:
            tag = TAGS[kind]
            value = F.col(name).cast(_CAST[tag]) if tag in _CAST else F.col(name)
            out.append(value.alias(f"{name.removeprefix(prefix)}__{tag}"))
    return out


def node_view(df: DataFrame, t: NodeTable) -> DataFrame:
    more = [F.col(t.more_labels)] if t.more_labels else []
    labels = F.array_sort(F.array(F.lit(t.label), *more))
    name = F.concat(F.lit(f"{t.label.lower()}:"), F.col(t.key).cast("string"))
    return df.select(name.alias("id"), labels.alias("labels"), F.array_min(labels).alias("label"), *flat(df, df.columns, t.prefix), F.col(t.key).cast("bigint").alias("seq"))


def edge_view(df: DataFrame, t: EdgeTable) -> DataFrame:
    return df.select(F.expr(t.id).alias("id"), F.lit(t.type).alias("type"), F.expr(t.from_).alias("from_id"), F.expr(t.to).alias("to_id"), *flat(df, list(t.properties), t.prefix), F.expr(t.seq).cast("bigint").alias("seq"))


class Lazily(Mapping):
    """Frames by name, each made when it is first asked for: a query opens only the tables that it names."""

    def __init__(self, makers: Mapping[str | None, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str | None) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str | None]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def map_tables(spark: SparkSession, tables: Mapping[str, DataFrame], nodes: list[NodeTable], edges: list[EdgeTable], indexes: frozenset[tuple[str, str]] = frozenset()) -> PropertyGraph:
    """The graph of some tables. A further label of a table's nodes is a filter on that table."""
    views = Lazily({t.label: lambda t=t: node_view(tables[t.table], t) for t in nodes})
    links = Lazily({t.type: lambda t=t: edge_view(tables[t.table], t) for t in edges})
    primary = frozenset(views)
    return _Mapped(spark, views, links, {t.type: t.ends for t in edges}, indexes, lambda x: x if x in primary else None, tuple(t.label for t in nodes if t.more_labels))


@dataclass(frozen=True)
class _Mapped(PropertyGraph):
    labelled: tuple[str, ...] = ()

    def live_nodes(self, label: str | None = None) -> DataFrame:
        if label is None or label in self.node_views or not self.labelled:
            return super().live_nodes(label)
        return self._union([self.node_views[x].filter(F.array_contains("labels", label)) for x in self.labelled])

    def node_by_id(self, id: str) -> DataFrame:
        """Only the table that an id's prefix names is read, by its own key."""
        kind, _, key = id.partition(":")
        for label in self.node_views:
            if label is not None and label.lower() == kind and key.lstrip("-").isdigit():
                return self.node_views[label].filter((F.col("seq") == int(key)) & (F.col("id") == id))
        return super().node_by_id(id)


#: The columns of the tables: no file is opened to find out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


COMMERCE_NODES = [
    NodeTable("Region", "region", "r_regionkey", "r_"), NodeTable("Nation", "nation", "n_nationkey", "n_"), NodeTable("Customer", "customer", "c_custkey", "c_", "c_mktsegment"),
    NodeTable("Supplier", "supplier", "s_suppkey", "s_"), NodeTable("Part", "part", "p_partkey", "p_"), NodeTable("Order", "orders", "o_orderkey", "o_"),
]
_name = lambda kind, column: f"concat('{kind}:', cast({column} as string))"
COMMERCE_EDGES = [
    EdgeTable("IN_REGION", "nation", _name("nation_region", "n_nationkey"), _name("nation", "n_nationkey"), _name("region", "n_regionkey"), "n_nationkey", ("Nation", "Region")),
    EdgeTable("IN_NATION", "customer", _name("customer_nation", "c_custkey"), _name("customer", "c_custkey"), _name("nation", "c_nationkey"), "c_custkey", ("Customer", "Nation")),
    EdgeTable("SUPPLIES_FROM", "supplier", _name("supplier_nation", "s_suppkey"), _name("supplier", "s_suppkey"), _name("nation", "s_nationkey"), "s_suppkey", ("Supplier", "Nation")),
    EdgeTable("PLACED", "orders", _name("placed", "o_orderkey"), _name("customer", "o_custkey"), _name("order", "o_orderkey"), "o_orderkey", ("Customer", "Order"), ("o_totalprice", "o_orderdate", "o_orderstatus"), "o_"),
    EdgeTable("CONTAINS", "lineitem", "concat_ws(':', 'contains', l_orderkey, l_linenumber, l_partkey, l_suppkey)", _name("order", "l_orderkey"), _name("part", "l_partkey"), "l_orderkey * 8 + l_linenumber", ("Order", "Part"), ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), "l_"),
]


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the order tables."""
    tables = Lazily({name: lambda name=name: read_table(spark, sf_dir, name) for name in SCHEMAS})
    return map_tables(spark, tables, COMMERCE_NODES, COMMERCE_EDGES, frozenset({("Customer", "name"), ("Part", "brand")}))


def acquaintances(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers who know three others each, by arithmetic on their keys: a graph with cycles."""
    customers = read_table(spark, sf_dir, "customer")
    n = customers.count()
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(((7, 3), (11, 5), (13, 1)))]))
    pairs = customers.select(F.col("c_custkey").alias("k"), slots.alias("s")).select("k", "s.slot", F.pmod(F.col("k") * F.col("s.a") + F.col("s.b"), F.lit(n)).alias("to"))
    edges = pairs.select(F.concat_ws(":", F.lit("knows"), "k", "slot").alias("id"), F.lit("KNOWS").alias("type"), F.concat(F.lit("customer:"), F.col("k").cast("string")).alias("from_id"), F.concat(F.lit("customer:"), F.col("to").cast("string")).alias("to_id"), F.col("slot").cast("bigint").alias("slot__int"), (F.col("k") * 3 + F.col("slot")).alias("seq"))
    view = node_view(customers, COMMERCE_NODES[2])
    return _Mapped(spark, {"Customer": view}, {"KNOWS": edges}, {"KNOWS": ("Customer", "Customer")}, frozenset(), None, ("Customer",))


def lattice(spark: SparkSession, sf_dir: str, width: int = 10) -> PropertyGraph:
    """Customers on a lattice ``width`` wide, each with an edge to the next (RIGHT) and to the one below (DOWN): many shortest paths."""
    customers = read_table(spark, sf_dir, "customer")
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(t).alias("type"), F.lit(by).alias("by")) for i, (t, by) in enumerate((("RIGHT", 1), ("DOWN", width)))]))
    steps = customers.select(F.col("c_custkey").alias("k"), slots.alias("s")).select("k", "s.*")
    name = lambda c: F.concat(F.lit("customer:"), c.cast("string"))
    edges = steps.select(F.concat_ws(":", F.lower("type"), "k").alias("id"), "type", name(F.col("k")).alias("from_id"), name(F.col("k") + F.col("by")).alias("to_id"), (F.col("k") * 2 + F.col("slot")).alias("seq"))
    return _Mapped(spark, {"Customer": node_view(customers, COMMERCE_NODES[2])}, {None: edges}, {}, frozenset(), None, ("Customer",))


def event_chains(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each user's events, one after another: long chains."""
    events = read_table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    links = events.select("event_id", after.alias("next")).filter("next is not null")
    name = lambda c: F.concat(F.lit("event:"), F.col(c).cast("string"))
    edges = links.select(F.concat(F.lit("next:"), F.col("event_id").cast("string")).alias("id"), F.lit("NEXT").alias("type"), name("event_id").alias("from_id"), name("next").alias("to_id"), F.col("event_id").alias("seq"))
    nodes = events.select(name("event_id").alias("id"), F.array(F.lit("Event")).alias("labels"), F.lit("Event").alias("label"), F.col("user_id").alias("user_id__int"), F.col("event_type").alias("event_type__string"), F.col("value").alias("value__double"), F.get_json_object("props", "$.k").cast("bigint").alias("k__int"), F.col("event_id").alias("seq"))
    return PropertyGraph(spark, {"Event": nodes}, {"NEXT": edges}, {"NEXT": ("Event", "Event")})
