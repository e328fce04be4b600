"""A property graph over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.properties import Properties
from .operators import adjacency, paths
from .plans.stages import Source, Traverse
from .query import EdgeQuery, NodeQuery
from .types import EDGES, NODES, literal, prop_row, schema, tag_of

_MISSING = object()


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes and edges as views, one or several of each.

    ``node_views`` maps a label to the frame of nodes that carry it, where nodes are stored by label; the key None holds
    nodes whose labels are in the column ``labels``. ``edge_views`` does the same for edge types. ``node_ends`` says
    which labels an edge type's ends have, where that is known, so that looking up reached nodes reads only those.
    ``indexes`` are the declared (label, property) pairs.
    """

    spark: SparkSession
    node_views: Mapping[str | None, DataFrame]
    edge_views: Mapping[str | None, DataFrame]
    node_ends: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    indexes: frozenset[tuple[str, str]] = frozenset()
    id_of_label: Callable[[str], str | None] | None = None

    @classmethod
    def from_dataframes(cls, nodes: DataFrame, edges: DataFrame, indexes: Iterable[tuple[str, str]] = ()) -> PropertyGraph:
        """A graph of general nodes and edges: the columns of NODES and EDGES, or flat ``key__tag`` columns besides."""
        return cls(nodes.sparkSession, {None: nodes}, {None: edges}, indexes=frozenset(indexes))

    @classmethod
    def from_rows(cls, spark: SparkSession, nodes: Iterable[tuple], edges: Iterable[tuple] = (), indexes: Iterable[tuple[str, str]] = ()) -> PropertyGraph:
        """A small graph from Python: nodes (id, labels, properties), edges (id, type, from, to, properties)."""
        n = [(i, sorted([labels] if isinstance(labels, str) else labels), min([labels] if isinstance(labels, str) else labels), {k: prop_row(v) for k, v in props.items()}, None, None, None, False, s) for s, (i, labels, props) in enumerate(nodes)]
        e = [(i, t, a, b, {k: prop_row(v) for k, v in props.items()}, None, None, None, False, s) for s, (i, t, a, b, props) in enumerate(edges)]
        return cls.from_dataframes(spark.createDataFrame(n, schema(NODES)), spark.createDataFrame(e, schema(EDGES)), indexes)

    # views

    @staticmethod
    def _live(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("is_deleted")) if "is_deleted" in df.columns else df

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def live_nodes(self, label: str | None = None) -> DataFrame:
        """Nodes that are not deleted, with a label if one is given (any of a node's labels counts)."""
        if label is None:
            keep = [k for k in self.node_views if k is None or self.id_of_label is None or self.id_of_label(k) is not None]
            return self._union([self._live(self.node_views[k]) for k in keep])
        if label in self.node_views:
            return self._live(self.node_views[label])
        if None not in self.node_views:
            return self._live(next(iter(self.node_views.values()))).limit(0)
        general = self._live(self.node_views[None])
        return general.filter(F.coalesce(F.array_contains("labels", label), F.lit(False)) | (F.col("label") == label))

    def live_edges(self, type: str | None = None) -> DataFrame:
        if type is None:
            return self._union([self._live(v) for v in self.edge_views.values()])
        if type in self.edge_views:
            return self._live(self.edge_views[type])
        if None not in self.edge_views:
            return self._live(next(iter(self.edge_views.values()))).limit(0)
        return self._live(self.edge_views[None]).filter(F.col("type") == type)

    def node_by_id(self, id: str) -> DataFrame:
        return self.live_nodes().filter(F.col("id") == id)

    def nodes_at(self, ids: DataFrame, step: Traverse | None = None) -> DataFrame:
        """The live nodes of some ids: only where a traversal by one edge type can end, if that is known."""
        nodes = self.live_nodes()
        if step and step.edge in self.node_ends and step.max_depth == 1:
            a, b = self.node_ends[step.edge]
            ends = {"out": [b], "in": [a], "both": [*dict.fromkeys([a, b])]}[step.direction]
            nodes = self._union([self.live_nodes(x) for x in ends])
        return nodes.join(ids, "id", "left_semi")

    # sources

    def nodes(self, label: str) -> NodeQuery:
        return NodeQuery(self, (Source("label", label),))

    def node(self, id: str) -> NodeQuery:
        return NodeQuery(self, (Source("id", id),))

    def all_nodes(self) -> NodeQuery:
        return NodeQuery(self, (Source("scan"),))

    def nodes_where(self, key: str, *, equals: Any = _MISSING, gt: Any = _MISSING, lt: Any = _MISSING, in_: Any = _MISSING) -> NodeQuery:
        """A scan of all nodes with one predicate."""
        given = {k: v for k, v in (("equals", equals), ("gt", gt), ("lt", lt), ("in_", in_)) if v is not _MISSING}
        if len(given) != 1:
            raise TypeError("nodes_where needs one predicate")
        return self.all_nodes().where(key, **given)

    def edges(self, type: str | None = None, *, from_: str | None = None, to: str | None = None) -> EdgeQuery:
        given = [Source(k, v) for k, v in (("type", type), ("from", from_), ("to", to)) if v is not None]
        if len(given) > 1:
            raise TypeError("edges takes one of type, from_ and to; see edges_from and edges_to for both")
        return EdgeQuery(self, (given[0] if given else Source("scan"),))

    # direct reads

    def edge(self, id: str) -> DataFrame:
        """0 or 1 live edges."""
        return self.live_edges().filter(F.col("id") == id)

    def edges_from(self, id: str, type: str | None = None) -> DataFrame:
        return self.live_edges(type).filter(F.col("from_id") == id)

    def edges_to(self, id: str, type: str | None = None) -> DataFrame:
        return self.live_edges(type).filter(F.col("to_id") == id)

    def edges_of_type(self, type: str) -> DataFrame:
        return self.live_edges(type)

    def lookup(self, label: str, key: str, value: Any) -> DataFrame | None:
        """An index lookup: None if (label, key) is not declared, else the nodes, possibly none."""
        if (label, key) not in self.indexes:
            return None
        nodes = self.live_nodes(label)
        return nodes.filter(Properties(nodes.columns).equals(key, value))

    def tombstones(self, kind: str, since: Any = None) -> DataFrame:
        """Deleted nodes or edges (id, kind, modified_at, revision) from a time on, in order of deletion."""
        views = {"node": self.node_views, "edge": self.edge_views}[kind]
        frames = [v.filter("is_deleted") for v in views.values() if "is_deleted" in v.columns]
        if not frames:
            raise ValueError("these views keep no deleted rows")
        rows = self._union(frames).select("id", F.lit(kind).alias("kind"), "modified_at", "revision")
        if since is not None:
            rows = rows.filter(F.col("modified_at") >= F.lit(since))
        return rows.orderBy("modified_at", "id")

    # paths and adjacency

    def shortest_path(self, source: str, target: str, via: str | None = None) -> DataFrame:
        return paths.shortest_path(self.live_nodes(), self.live_edges(via), source, target)

    def all_paths(self, source: str, target: str, max_depth: int, via: str | None = None) -> DataFrame:
        return paths.all_paths(self.live_nodes(), self.live_edges(via), source, target, max_depth)

    def degrees(self, direction: str = "out", type: str | None = None) -> DataFrame:
        return adjacency.degrees(self.live_nodes(), self.live_edges(type), direction)

    def neighbours(self, id: str, direction: str = "out", type: str | None = None) -> DataFrame:
        return adjacency.neighbours(self.live_edges(type), id, direction)

    def without_dangling(self) -> PropertyGraph:
        """The graph without the edges that have a missing or deleted end."""
        edges = adjacency.attached(self.live_nodes(), self.live_edges())
        return PropertyGraph(self.spark, self.node_views, {None: edges}, indexes=self.indexes)

    def register(self, prefix: str = "graph") -> None:
        """Temporary views ``<prefix>_nodes`` and ``<prefix>_edges``, for SQL."""
        self.live_nodes().createOrReplaceTempView(f"{prefix}_nodes")
        self.live_edges().createOrReplaceTempView(f"{prefix}_edges")

    def labels(self) -> DataFrame:
        """(label, count) over all labels of all live nodes."""
        return self.live_nodes().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count"))


def property_equals(df: DataFrame, key: str, value: Any) -> Column:
    """For use outside queries: equality of a property in any frame of nodes or edges."""
    if tag_of(value) != "null":
        literal(value)
    return Properties(df.columns).equals(key, value)
