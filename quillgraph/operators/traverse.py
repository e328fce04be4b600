"""Breadth-first expansion over edges, one equi-join a hop.

Only ids travel. What a traversal returns are the nodes that it newly reaches, never those that it starts from; nodes
that are deleted are walked through and drop out when nodes are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

DIRECTIONS = ("out", "in", "both")
#: Up to so many hops are one lazy plan; each hop mentions the hops before it twice, so more are cut hop by hop.
LAZY_HOPS = 3
#: What a search may take at most, as a guard against running forever: beyond it the search fails, and says so.
MOST_HOPS = 100_000
#: After so many hops, the nodes seen so far are written as one table, so that plans stay short.
KEPT_HOPS = 8


def oriented(edges: DataFrame, direction: str, *carry: str) -> DataFrame:
    """(src, dst, turn, seq, ...): each edge as the steps that it allows; ``turn`` is 0 along the edge, 1 against it."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    along = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit(0).alias("turn"), "seq", *carry)
    against = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.lit(1).alias("turn"), "seq", *carry)
    return {"out": along, "in": against}.get(direction) or along.unionByName(against)


def reach(start: DataFrame, edges: DataFrame, direction: str, max_depth: int | None) -> DataFrame:
    """(id, hop) of the nodes that ``start`` (id) reaches in at most so many hops."""
    steps = oriented(edges, direction)
    frontier = seen = start.select("id").distinct().withColumn("hop", F.lit(0))
    if max_depth is not None and max_depth <= 0:
        return seen.filter(F.lit(False))
    lazy = max_depth is not None and max_depth <= LAZY_HOPS
    if not lazy:
        frontier = seen = cut(seen)
    for hop in range(1, (max_depth or MOST_HOPS) + 1):
        ahead = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct()
        frontier = ahead.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        if not lazy:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
        if not lazy and hop % KEPT_HOPS == 0:
            seen = cut(seen, "seen")
    else:
        if max_depth is None:
            raise RuntimeError(f"no end after {MOST_HOPS} hops")
    return seen.filter("hop > 0")


def reach_in_order(start: DataFrame, edges: DataFrame, direction: str, max_depth: int | None) -> DataFrame:
    """(id, hop, rank): as ``reach``, for when the order of discovery is visible, which is that of (hop, rank).

    A hop's nodes are ranked by their predecessor's rank and the step taken. The ranks are increasing, not consecutive:
    they come from a range sort, so that no task numbers a whole hop.
    """
    steps = oriented(edges, direction)
    ranked = lambda df, *order: cut(df.orderBy(*order, "id").select("id", "hop", F.monotonically_increasing_id().alias("rank")))
    seen = frontier = ranked(start.groupBy("id").agg(F.min("seq").alias("seq")).withColumn("hop", F.lit(0)), "seq")
    for hop in range(1, (MOST_HOPS if max_depth is None else max_depth) + 1):
        ahead = frontier.select(F.col("id").alias("src"), "rank").join(steps, "src").select(F.col("dst").alias("id"), F.struct("rank", "turn", "seq").alias("came"))
        fresh = ahead.join(seen, "id", "left_anti").groupBy("id").agg(F.min("came").alias("came")).withColumn("hop", F.lit(hop))
        frontier = ranked(fresh, "came")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % KEPT_HOPS == 0:
            seen = cut(seen, "seen")
    else:
        if max_depth is None:
            raise RuntimeError(f"no end after {MOST_HOPS} hops")
    return seen.filter("hop > 0")


def scanned_edges(start: DataFrame, edges: DataFrame, direction: str, max_depth: int | None) -> DataFrame:
    """The edges (all columns) that the traversal looks at, also those to nodes already seen.

    An edge between two expanded nodes is looked at from both ends under ``both``, and so comes twice.
    """
    if max_depth is not None and max_depth <= 0:
        return edges.limit(0)
    last = None if max_depth is None else max_depth - 1
    expanded = start.select("id").distinct()
    if last is None or last > 0:
        expanded = expanded.unionByName(reach(start, edges, direction, last).select("id"))
    out = [edges.join(expanded.withColumnRenamed("id", end), end, "left_semi").select(edges.columns) for name, end in (("out", "from_id"), ("in", "to_id")) if direction in (name, "both")]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
