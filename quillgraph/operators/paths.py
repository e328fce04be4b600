"""Path queries. A path is a row: length, node_ids and edge_ids in walking order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .traverse import KEPT_HOPS, MOST_HOPS, oriented, reach

PATH = "length int, node_ids array<string>, edge_ids array<string>"


def _single(start: DataFrame) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    return start.select("id", F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"), empty.alias("steps"))


def _rows(paths: DataFrame) -> DataFrame:
    return paths.select(F.size("edge_ids").alias("length"), "node_ids", "edge_ids")


def _all_live(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keeps the paths whose nodes all exist."""
    tagged = cut(paths.withColumn("path_id", F.monotonically_increasing_id()), "paths")
    met = tagged.select("path_id", F.explode("node_ids").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select("path_id").distinct()
    return tagged.join(met, "path_id", "left_anti").drop("path_id")


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The first shortest path along edges, as 0 or 1 rows.

    Of several shortest paths, the one found first counts: predecessors in order of discovery, then edges in order of
    insertion. There is no path if a node of that one is deleted; a live detour is not tried.

    Each hop keeps, of every node that it discovers, a rank in the order of discovery (by a range sort, so that no task
    numbers all of them), the predecessor and the edge. The path is walked back at the end, a lookup for each hop.
    """
    spark = nodes.sparkSession
    if source == target:
        return _rows(_single(nodes.filter(F.col("id") == source).select("id")))
    steps = oriented(edges, "out", F.col("id").alias("edge_id"))
    frontier = spark.createDataFrame([(source, 0)], "id string, rank bigint")
    seen = frontier.select("id")
    levels: list[DataFrame] = []
    for hop in range(1, MOST_HOPS + 1):
        ahead = frontier.select(F.col("id").alias("src"), "rank").join(steps, "src").select(F.col("dst").alias("id"), F.struct("rank", "seq", "edge_id", "src").alias("came"))
        fresh = ahead.join(seen, "id", "left_anti").groupBy("id").agg(F.min("came").alias("came")).select("id", "came.*")
        level = cut(fresh.orderBy("rank", "seq", "edge_id").select("id", F.monotonically_increasing_id().alias("rank"), "src", "edge_id"))
        levels.append(level)
        about = level.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("id") == target), F.lit(False)).alias("found")).first()
        if about["found"]:
            break
        if not about["n"]:
            return spark.createDataFrame([], PATH)
        frontier = level.select("id", "rank")
        seen = seen.unionByName(frontier.select("id"))
        if hop % KEPT_HOPS == 0:
            seen = cut(seen, "seen")
    else:
        raise RuntimeError(f"no end after {MOST_HOPS} hops")
    node_ids, edge_ids = [target], []
    for level in reversed(levels):
        back = level.filter(F.col("id") == node_ids[-1]).first()
        edge_ids.append(back["edge_id"])
        node_ids.append(back["src"])
    path = spark.createDataFrame([(len(edge_ids), node_ids[::-1], edge_ids[::-1])], PATH)
    live = nodes.select("id").join(F.broadcast(path.select(F.explode("node_ids").alias("id"))), "id", "left_semi").distinct().count()  # as many as the path is long
    return path if live == len(node_ids) else path.limit(0)


def all_paths(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """Every simple path of at most ``max_depth`` edges, depth first: PATH and ``steps`` (the edges' insertion numbers).

    Parallel edges make paths of their own. Both ends must exist, and paths through deleted nodes are left out. Only
    nodes from which the target is still near enough are walked to. The result itself may be exponential in the depth.
    """
    spark = nodes.sparkSession
    if source == target:
        return _ranked(_single(nodes.filter(F.col("id") == source).select("id")))
    empty = _single(spark.createDataFrame([], "id string"))
    if max_depth <= 0 or nodes.filter(F.col("id").isin(source, target)).select("id").distinct().count() < 2:
        return _ranked(empty)
    goal = spark.createDataFrame([(target,)], "id string")
    left = cut(reach(goal, edges, "in", max_depth - 1).select(F.col("id").alias("dst"), F.col("hop").alias("left")).unionByName(goal.select(F.col("id").alias("dst"), F.lit(0).alias("left"))))
    steps = oriented(edges, "out", F.col("id").alias("edge_id")).join(left, "dst")
    frontier, found = _single(spark.createDataFrame([(source,)], "id string")), empty
    for hop in range(1, max_depth + 1):
        near = steps.filter(F.col("left") <= max_depth - hop)
        ahead = frontier.withColumnRenamed("id", "src").join(near, "src").filter(~F.array_contains("node_ids", F.col("dst")))
        ahead = cut(ahead.select(F.col("dst").alias("id"), F.concat("node_ids", F.array("dst")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.concat("steps", F.array("seq")).alias("steps")))
        found = found.unionByName(ahead.filter(F.col("id") == target))
        frontier = ahead.filter(F.col("id") != target)
        if frontier.isEmpty():
            break
    return _ranked(_all_live(found, nodes))


def _ranked(paths: DataFrame) -> DataFrame:
    """Paths in the order of a depth-first search, which is that of their steps' insertion numbers."""
    return paths.orderBy("steps").select(F.size("edge_ids").alias("length"), "node_ids", "edge_ids", "steps")
