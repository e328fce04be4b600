"""The change journal: folding it into states, tails, tombstones, patches.

The journal is the only thing that is written. A row carries an entity's whole merged payload, so a state needs one row
of each entity, and any number of readers may hold any version.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import EDGES, NODES, REVISION, ZERO_ACTOR, revision_before, schema

UPSERT, DELETE = "upsert", "delete"


def patched(old: Column, patch: Column) -> Column:
    """A property map after a patch: the patch's keys win, and its null values remove keys."""
    kind = "map<string,struct<type:string,s:string,i:bigint,d:double,b:boolean,ts:timestamp,bin:binary,arr:string>>"
    empty = F.from_json(F.lit("{}"), kind)
    merged = F.map_zip_with(F.coalesce(old, empty), F.coalesce(patch, empty), lambda k, a, b: F.coalesce(b, a))
    return F.map_filter(merged, lambda k, v: v["type"] != "null")


def append_new(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose change_id the journal does not hold yet, each change once."""
    return rows.dropDuplicates(["change_id"]).join(journal.select("change_id"), "change_id", "left_anti")


def tail(journal: DataFrame, after: int = 0) -> DataFrame:
    """Rows behind a sequence number, in order."""
    return journal.filter(F.col("sequence") > after).orderBy("sequence")


def count(journal: DataFrame) -> DataFrame:
    """How many changes there are."""
    return journal.agg(F.count("*").alias("n"))


def latest_row(journal: DataFrame, kind: str, id: str) -> DataFrame:
    """The newest row of one entity (0 or 1 rows)."""
    own = journal.filter((F.col("entity_kind") == kind) & (F.col("entity_id") == id))
    return own.orderBy(F.col("sequence").desc()).limit(1)


def winners(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the winner of its history in the order of a column, with ``first``, where the history begins.

    A later row wins unless its revision is before the winner's. Between several actors that relation has cycles, so the
    rows of a key are folded in order. Before that, runs of rows of one actor whose counters and clocks do not fall are
    cut down to their last row, which beats whatever any of them beats; so a key's array has as many entries as its
    actors took turns, however long its history is.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    now, then = F.col("revision"), F.lead("revision").over(own)
    goes_on = (then["actor_id"] == now["actor_id"]) & (then["counter"] >= now["counter"]) & (then["wall_clock"] >= now["wall_clock"])
    first = F.first(order).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumns({"first": first, "_goes_on": F.coalesce(goes_on, F.lit(False))}).filter("not _goes_on").drop("_goes_on")
    entry = F.struct(order, "revision", *(c for c in rows.columns if c not in (*keys, order, "revision")))
    by_order = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    history = last.groupBy(*keys).agg(F.array_sort(F.collect_list(entry), by_order).alias("h"), F.min("first").alias("first"))
    winner = F.aggregate(F.slice("h", 2, 1 << 30), F.element_at("h", 1), lambda a, e: F.when(revision_before(e["revision"], a["revision"]), a).otherwise(e))
    return history.select(*keys, "first", winner.alias("w")).select(*keys, "first", "w.*")


def fold(journal: DataFrame, one_actor: bool = False) -> DataFrame:
    """One row per entity: the winner of its history (see ``winners``), and ``first_sequence``.

    With one actor the newest row wins, which Spark combines before the shuffle.
    """
    keys = ["entity_kind", "entity_id"]
    if not one_actor:
        return winners(journal, keys, "sequence").withColumnRenamed("first", "first_sequence")
    entry = F.struct("sequence", "revision", *(c for c in journal.columns if c not in (*keys, "sequence", "revision")))
    won = journal.groupBy(*keys).agg(F.max_by(entry, F.struct(F.col("revision.counter"), F.col("sequence"))).alias("w"), F.min("sequence").alias("first_sequence"))
    return won.select(*keys, "first_sequence", "w.*")


def nodes_of(state: DataFrame) -> DataFrame:
    """Folded node rows in the columns of NODES; deleted nodes stay, marked."""
    rows = state.filter("entity_kind = 'node'")
    p = "payload."
    return rows.select(F.col("entity_id").alias("id"), F.col(p + "labels").alias("labels"), F.array_min(p + "labels").alias("label"), F.col(p + "properties").alias("properties"), F.col(p + "created_at").alias("created_at"), F.col("created_at").alias("modified_at"), "revision", (F.col("operation") == DELETE).alias("is_deleted"), F.col("first_sequence").alias("seq")).to(schema(NODES))


def edges_of(state: DataFrame) -> DataFrame:
    rows = state.filter("entity_kind = 'edge'")
    p = "payload."
    return rows.select(F.col("entity_id").alias("id"), F.col(p + "type").alias("type"), F.col(p + "from_id").alias("from_id"), F.col(p + "to_id").alias("to_id"), F.col(p + "properties").alias("properties"), F.col(p + "created_at").alias("created_at"), F.col("created_at").alias("modified_at"), "revision", (F.col("operation") == DELETE).alias("is_deleted"), F.col("first_sequence").alias("seq")).to(schema(EDGES))


def tombstones(state: DataFrame, kind: str, since: Any = None) -> DataFrame:
    """Deleted entities (id, kind, modified_at, revision) from a time on, in order."""
    rows = state.filter((F.col("entity_kind") == kind) & (F.col("operation") == DELETE))
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since))
    return rows.select(F.col("entity_id").alias("id"), F.col("entity_kind").alias("kind"), F.col("created_at").alias("modified_at"), "revision").orderBy("modified_at", "id")


def backfilled(df: DataFrame, actor: str = ZERO_ACTOR) -> DataFrame:
    """Rows written before there were revisions get (actor, 0, modified_at)."""
    made = F.struct(F.lit(actor).alias("actor_id"), F.lit(0).cast("bigint").alias("counter"), F.col("modified_at").alias("wall_clock")).cast(REVISION)
    return df.withColumn("revision", F.coalesce("revision", made) if "revision" in df.columns else made)


def next_counter(journal: DataFrame, actor: str) -> int:
    """The next free counter of an actor."""
    top = journal.filter(F.col("actor_id") == actor).agg(F.max("revision.counter")).first()[0]
    return (top or 0) + 1


def events(journal: DataFrame) -> DataFrame:
    """Journal rows as mutation events: added, updated or deleted, of nodes or edges."""
    what = F.when(F.col("operation") == DELETE, "deleted").when(F.col("base_revision").isNull(), "added").otherwise("updated")
    return journal.select("sequence", "change_id", F.concat(F.initcap("entity_kind"), F.initcap(what)).alias("event"), "entity_kind", "entity_id", "payload", "revision", "created_at")


def invalid(journal: DataFrame) -> DataFrame:
    """Rows that break the journal's rules: unknown kind or operation, or an upsert without a payload."""
    ok = F.col("entity_kind").isin("node", "edge") & F.col("operation").isin(UPSERT, DELETE) & ((F.col("operation") == DELETE) | F.col("payload").isNotNull())
    return journal.filter(~F.coalesce(ok, F.lit(False)))
