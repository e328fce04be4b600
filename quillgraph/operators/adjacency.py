"""Degrees, neighbours, attached edges, and the overlay of an edge log on a base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread
from .journal import winners
from .traverse import oriented


def degrees(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(id, degree) of every live node, 0 included; ``both`` counts each end of an edge."""
    counts = oriented(edges, direction).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def neighbours(edges: DataFrame, id: str, direction: str = "out") -> DataFrame:
    """(edge_id, id) next to a node, in order of insertion."""
    steps = oriented(edges, direction, F.col("id").alias("edge_id")).filter(F.col("src") == id)
    return steps.orderBy("turn", "seq").select("edge_id", F.col("dst").alias("id"))


def attached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are live nodes."""
    ids = nodes.select("id")
    for end in ("from_id", "to_id"):
        edges = edges.join(spread(ids.withColumnRenamed("id", end)), end, "left_semi")
    return edges


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that lack a live end, for checks before a write."""
    return edges.join(spread(attached(nodes, edges).select("id")), "id", "left_anti")


LOG_ACTIONS = ("insert", "delete")


def outgoing_entries(log: DataFrame, id: str, type: str | None = None) -> DataFrame:
    """A log's entries whose edges leave a node, in order."""
    return _entries(log, "from_id", id, type)


def incoming_entries(log: DataFrame, id: str, type: str | None = None) -> DataFrame:
    """A log's entries whose edges end at a node, in order."""
    return _entries(log, "to_id", id, type)


def _entries(log: DataFrame, end: str, id: str, type: str | None) -> DataFrame:
    rows = log.filter(F.col(end) == id)
    return (rows if type is None else rows.filter(F.col("type") == type)).orderBy("position")


def overlay(base: DataFrame, log: DataFrame) -> DataFrame:
    """Edges of ``base`` with a log (id, from_id, to_id, type, action, revision, position) laid over it.

    For each edge, the log's entries are folded in order of position (see ``journal.winners``). A surviving delete hides
    the base edge; surviving inserts replace it or follow the base's edges in order of their first position. The result
    has the base's columns: those that the log has too come from the winning entry, the others stay as they are.
    """
    won = winners(log, ["id"], "position")
    kept = base.join(won.select("id"), "id", "left_anti").select(base.columns)
    both = won.filter("action = 'insert'").alias("w").join(base.alias("b"), F.col("w.id") == F.col("b.id"), "left")
    order = F.when(F.col("b.seq").isNotNull(), F.col("b.seq")).otherwise(F.lit(1 << 62) + F.col("w.first"))
    columns = [order.alias("seq") if c == "seq" else F.col(f"w.{c}" if c in won.columns else f"b.{c}").alias(c) for c in base.columns]
    return kept.unionByName(both.select(*columns))


def should_compact(log_entries: int, nodes: int, factor: int = 4) -> bool:
    """Whether a log has outgrown its base."""
    return log_entries > factor * nodes


def compact(base: DataFrame, log: DataFrame) -> DataFrame:
    """The base with the log folded in, all its columns kept, numbered anew; the caller writes it and starts an empty log."""
    rows = overlay(base, log)
    return rows.orderBy("seq", "id").withColumn("seq", F.monotonically_increasing_id())
