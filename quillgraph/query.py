"""Immutable, lazy queries over nodes and edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any, Self

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions.properties import Properties
from .operators.traverse import reach, reach_in_order, scanned_edges
from .plans.stages import Compare, Contains, Limit, Sorted, Source, Stage, Traverse, Where, aggregates_in_place, is_declarative, order_is_visible
from .types import ORDERED, prop_struct, prop_value

if TYPE_CHECKING:
    from .graph import PropertyGraph

_MISSING = object()


@dataclass(frozen=True)
class _Query:
    graph: PropertyGraph
    stages: tuple[Stage, ...]

    def _with(self, stage: Stage) -> Self:
        return replace(self, stages=(*self.stages, stage))

    def sorted(self, key: str, ascending: bool = True) -> Self:
        """Sorts by a property; ties are in order of insertion."""
        return self._with(Sorted(key, ascending))

    def limit(self, count: int, offset: int = 0) -> Self:
        if count < 0 or offset < 0:
            raise ValueError("limit and offset are not negative")
        return self._with(Limit(count, offset))

    # running

    def _source(self) -> DataFrame:
        raise NotImplementedError

    def to_df(self) -> DataFrame:
        """The result, lazily. A result with a defined order is ordered; see ``ordered`` for turning that off."""
        return self._run(True)

    def unordered(self) -> DataFrame:
        """The same rows without the final sort, which is needless before an aggregation or a write."""
        return self._run(False)

    def _run(self, ordered: bool) -> DataFrame:
        return self._declarative(ordered) if is_declarative(self.stages) else self._sequential(ordered)

    def _declarative(self, ordered: bool) -> DataFrame:
        df = self._source()
        props = Properties(df.columns)
        for s in self.stages[1:]:
            if isinstance(s, Compare):
                df = df.filter(props.compares(s.key, s.op, s.value))
            elif isinstance(s, Contains):
                df = df.filter(props.contains(s.key, s.part))
        sort = next((s for s in reversed(self.stages) if isinstance(s, Sorted)), None)
        limit = next((s for s in reversed(self.stages) if isinstance(s, Limit)), None)
        if limit or ordered and sort:
            keys = [k.asc_nulls_first() if sort.ascending else k.desc_nulls_last() for k in props.sort_key(sort.key)] if sort else []
            df = df.orderBy(*keys, "seq", "id")
        return df.offset(limit.offset).limit(limit.count) if limit else df

    def _sequential(self, ordered: bool) -> DataFrame:
        df, order = self._source(), [F.col("seq").asc(), F.col("id").asc()]
        last = max((i for i, s in enumerate(self.stages) if isinstance(s, Sorted)), default=-1)
        for i, s in enumerate(self.stages[1:], 1):
            props = Properties(df.columns)
            if isinstance(s, Where):
                df = df.filter(self._predicate(props, s))
            elif isinstance(s, Compare):
                df = df.filter(props.compares_or_differs(s.key, s.op, s.value))
            elif isinstance(s, Contains):
                df = df.filter(props.contains(s.key, s.part))
            elif isinstance(s, Sorted):
                order = [*(k.asc_nulls_last() if s.ascending else k.desc_nulls_last() for k in props.sort_key(s.key)), *order]
            elif isinstance(s, Limit):
                df = df.orderBy(*order).offset(s.offset).limit(s.count)
            elif isinstance(s, Traverse):
                df, order = self._traverse(df, s, i)
        return df.orderBy(*order).drop("_hop", "_rank") if ordered and last > 0 else df.drop("_hop", "_rank")

    def _traverse(self, df: DataFrame, s: Traverse, at: int) -> tuple[DataFrame, list[Column]]:
        raise TypeError("edges are not traversed")

    @staticmethod
    def _predicate(props: Properties, s: Where) -> Column:
        if s.kind == "function":
            return F.coalesce(s.function(props), F.lit(False))
        if s.kind == "in":
            return props.within(s.key, s.value)
        return props.equals(s.key, s.value) if s.kind == "equals" else props.compares(s.key, {"gt": ">", "lt": "<"}[s.kind], s.value)

    # terminals

    def collect(self) -> list[Row]:
        return self.to_df().collect()

    def count_df(self) -> DataFrame:
        return self.unordered().agg(F.count("*").alias("count"))

    def count(self) -> int:
        return self.count_df().first()["count"]

    def first(self) -> Row | None:
        """The first row of the result, or None; a query without a limit reads no more than it must."""
        q = self if any(isinstance(s, Limit) for s in self.stages) else self.limit(1)
        rows = q.to_df().take(1)
        return rows[0] if rows else None

    def exists(self) -> bool:
        return not self.unordered().limit(1).isEmpty()

    def sum_df(self, key: str) -> DataFrame:
        """The sum of a property's numbers as a double, 0 if there are none. Other kinds of values count nothing."""
        df = self.unordered()
        return df.agg(F.coalesce(F.sum(Properties(df.columns).number(key)), F.lit(0.0)).alias("sum"))

    def sum(self, key: str) -> float:
        return self.sum_df(key).first()["sum"]

    def avg_df(self, key: str) -> DataFrame:
        """The mean of a property's numbers.

        Over a source and filters alone, rows without the property do not count. In any other query they count as 0.
        """
        df = self.unordered()
        number = Properties(df.columns).number(key)
        if aggregates_in_place(self.stages):
            return df.agg(F.avg(number).alias("avg"))
        return df.agg((F.coalesce(F.sum(number), F.lit(0.0)) / F.nullif(F.count("*"), F.lit(0))).alias("avg"))

    def avg(self, key: str) -> float | None:
        return self.avg_df(key).first()["avg"]

    def _extreme_df(self, key: str, function: Callable[[Column], Column], name: str) -> DataFrame:
        df = self.unordered()
        props = Properties(df.columns)
        tags = [t for t in ORDERED if t in props.tags(key)]
        if not tags:
            return df.agg(F.lit(None).cast("string").alias("_")).select(Properties(()).value(key).alias(name))
        field = lambda t: F.when(~F.isnan(props.field(key, t)), props.field(key, t)) if t == "double" else props.field(key, t)
        found = df.agg(*[function(field(t)).alias(t) for t in tags])
        return found.select(F.coalesce(*[F.when(F.col(t).isNotNull(), prop_struct(t, F.col(t))) for t in tags]).alias(name))

    def min_df(self, key: str) -> DataFrame:
        """The least value as a value of the union; of mixed kinds, the kind that comes first in ``ORDERED`` counts."""
        return self._extreme_df(key, F.min, "min")

    def max_df(self, key: str) -> DataFrame:
        return self._extreme_df(key, F.max, "max")

    def min(self, key: str) -> Any:
        return prop_value(self.min_df(key).first()["min"])

    def max(self, key: str) -> Any:
        return prop_value(self.max_df(key).first()["max"])


@dataclass(frozen=True)
class NodeQuery(_Query):
    """``g.nodes("Person").where("age", ">", 30).traverse("out", "KNOWS").to_df()``"""

    def where(self, key: str | Callable[[Properties], Column], op: str | None = None, value: Any = None, *, equals: Any = _MISSING, gt: Any = _MISSING, lt: Any = _MISSING, in_: Any = _MISSING, contains: str | None = None) -> NodeQuery:
        """Keeps the nodes that a predicate holds for.

        ``where(key, op, value)`` and ``where(key, contains=...)`` keep a query declarative. ``equals``, ``gt``, ``lt``,
        ``in_`` and a function of the row's properties make it sequential.
        """
        if callable(key):
            return self._with(Where("function", function=key))
        if op is not None:
            Properties(()).compares(key, op, value)  # fails here, not when the query runs
            return self._with(Compare(key, op, value))
        if contains is not None:
            return self._with(Contains(key, contains))
        for kind, v in (("equals", equals), ("gt", gt), ("lt", lt), ("in", in_)):
            if v is not _MISSING:
                return self._with(Where(kind, key, list(v) if kind == "in" else v))
        raise TypeError("where needs a predicate")

    def traverse(self, direction: str = "out", edge: str | None = None, max_depth: int | None = 1) -> NodeQuery:
        """Goes to the nodes that the current ones newly reach; ``max_depth`` None has no limit."""
        if direction not in ("out", "in", "both"):
            raise ValueError("direction is out, in or both")
        return self._with(Traverse(direction, edge, max_depth))

    def with_edges(self) -> tuple[DataFrame, DataFrame]:
        """The result and the edges that its traversals looked at, those of all stages, duplicates included."""
        edges: list[DataFrame] = []
        for i, s in enumerate(self.stages):
            if isinstance(s, Traverse):
                before = replace(self, stages=self.stages[:i]).unordered()
                edges.append(scanned_edges(before, self.graph.live_edges(s.edge), s.direction, s.max_depth))
        if not edges:
            return self.to_df(), self.graph.live_edges().limit(0)
        out = edges[0]
        for e in edges[1:]:
            out = out.unionByName(e, allowMissingColumns=True)
        return self.to_df(), out

    def _source(self) -> DataFrame:
        s = self.stages[0]
        if s.kind == "label":
            return self.graph.live_nodes(s.value)
        return self.graph.node_by_id(s.value) if s.kind == "id" else self.graph.live_nodes()

    def _traverse(self, df: DataFrame, s: Traverse, at: int) -> tuple[DataFrame, list[Column]]:
        edges = self.graph.live_edges(s.edge)
        if order_is_visible(self.stages, at):
            found = reach_in_order(df.select("id", "seq"), edges, s.direction, s.max_depth)
            nodes = found.select("id", F.col("hop").alias("_hop"), F.col("rank").alias("_rank")).join(self.graph.live_nodes(), "id")
            return nodes, [F.col("_hop").asc(), F.col("_rank").asc()]
        found = reach(df.select("id"), edges, s.direction, s.max_depth).select("id")
        return self.graph.nodes_at(found, s), [F.col("seq").asc(), F.col("id").asc()]


@dataclass(frozen=True)
class EdgeQuery(_Query):
    """``g.edges(type="KNOWS").where("since", ">", 2020).sorted("since").to_df()``"""

    def where(self, key: str | Callable[[Properties], Column], op: str | None = None, value: Any = None, *, contains: str | None = None) -> EdgeQuery:
        if callable(key):
            return self._with(Where("function", function=key))
        if op is not None:
            Properties(()).compares(key, op, value)
            return self._with(Compare(key, op, value))
        if contains is not None:
            return self._with(Contains(key, contains))
        raise TypeError("where needs a predicate")

    def _source(self) -> DataFrame:
        s = self.stages[0]
        if s.kind == "type":
            return self.graph.live_edges(s.value)
        df = self.graph.live_edges()
        return df if s.kind == "scan" else df.filter(F.col(f"{s.kind}_id") == s.value)
