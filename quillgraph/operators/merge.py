"""Conflict resolution between a local and a remote version with a common base, as columns.

A record is struct<properties, deleted>; a missing record is null. A resolution is
struct<action, properties, reason>, where the action is useLocal, useRemote, merge, delete or fail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import PROP

MAP = f"map<string,{PROP}>"
Resolver = Callable[[Column, Column, Column], Column]
SAME_FIELD = ("remote", "local", "fail")
ON_DELETE = ("fail", "delete", "remote")


def resolution(action: str, properties: Column | None = None, reason: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(action).alias("action"), (none if properties is None else properties).cast(MAP).alias("properties"), (none if reason is None else reason).cast("string").alias("reason"))


def remote_wins(base: Column, local: Column, remote: Column) -> Column:
    return F.when(remote.isNull() | remote["deleted"], resolution("delete")).otherwise(resolution("useRemote", remote["properties"]))


def local_wins(base: Column, local: Column, remote: Column) -> Column:
    return F.when(local.isNull() | local["deleted"], resolution("delete")).otherwise(resolution("useLocal", local["properties"]))


def _or_empty(properties: Column) -> Column:
    return F.coalesce(properties, F.from_json(F.lit("{}"), MAP))


def field_level(same_field: str = "remote", on_delete: str = "fail") -> Resolver:
    """A three-way merge, key by key.

    A key that one side alone changed takes that side's value; a key that both changed alike takes it; otherwise
    ``same_field`` decides. A key that one side removed and the other left alone is removed. A key that both sides
    removed stays as in the base. If exactly one side is deleted, ``on_delete`` decides.
    """
    if same_field not in SAME_FIELD or on_delete not in ON_DELETE:
        raise ValueError(f"same_field is one of {SAME_FIELD}, on_delete one of {ON_DELETE}")

    def resolve(base: Column, local: Column, remote: Column) -> Column:
        b, mine, theirs = (_or_empty(x["properties"]) for x in (base, local, remote))
        sides = F.map_zip_with(mine, theirs, lambda k, x, y: F.struct(x.alias("l"), y.alias("r")))
        pick = {"remote": lambda l, r: r, "local": lambda l, r: l, "fail": lambda l, r: F.lit(None).cast(PROP)}[same_field]  # noqa: E741

        def choose(k: Column, was: Column, s: Column) -> Column:
            l, r = s["l"], s["r"]  # noqa: E741
            return F.when(s.isNull(), was).when(l.eqNullSafe(r), l).when(r.eqNullSafe(was), l).when(l.eqNullSafe(was), r).otherwise(pick(l, r))

        def clashes(k: Column, was: Column, s: Column) -> Column:
            l, r = s["l"], s["r"]  # noqa: E741
            return s.isNotNull() & ~l.eqNullSafe(r) & ~r.eqNullSafe(was) & ~l.eqNullSafe(was)

        merged = F.map_filter(F.map_zip_with(b, sides, choose), lambda k, v: v.isNotNull())
        both = resolution("merge", merged)
        if same_field == "fail":
            bad = F.array_sort(F.map_keys(F.map_filter(F.map_zip_with(b, sides, clashes), lambda k, v: v)))
            both = F.when(F.size(bad) > 0, resolution("fail", reason=F.concat(F.lit("both sides changed "), F.array_join(bad, ", ")))).otherwise(both)
        gone_l, gone_r = (x.isNull() | x["deleted"] for x in (local, remote))
        kept = F.when(gone_r, resolution("delete")).otherwise(resolution("useRemote", remote["properties"]))
        one = {"fail": resolution("fail", reason=F.lit("one side is deleted")), "delete": resolution("delete"), "remote": kept}[on_delete]
        return F.when(gone_l & gone_r, resolution("delete")).when(gone_l | gone_r, one).otherwise(both)

    return resolve


def resolve_changes(base: DataFrame, local: DataFrame, remote: DataFrame, resolver: Resolver) -> DataFrame:
    """Resolves every remotely changed entity: frames of (entity_kind, entity_id, properties, deleted, revision).

    Where the local version is still the base's revision, the remote one applies as it is; where both differ from the
    base, the resolver decides. Returns the key, ``diverged`` and ``resolution``.
    """
    key = ["entity_kind", "entity_id"]
    side = lambda df, name: df.select(*key, F.struct("properties", "deleted", "revision").alias(name))
    rows = side(remote, "remote").join(side(local, "local"), key, "left").join(side(base, "base"), key, "left")
    diverged = F.col("local").isNotNull() & ~F.col("local.revision").eqNullSafe(F.col("base.revision"))
    taken = F.when(F.col("remote.deleted"), resolution("delete")).otherwise(resolution("useRemote", F.col("remote.properties")))
    return rows.select(*key, diverged.alias("diverged"), F.when(diverged, resolver(F.col("base"), F.col("local"), F.col("remote"))).otherwise(taken).alias("resolution"), F.col("remote.revision").alias("remote_revision"))
