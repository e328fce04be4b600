"""Synchronising stores through a shared change log.

A backend is an append-only log with positions. A round pushes the local rows behind the push cursor, pulls what others
have logged, resolves it against the local state and the version that both sides had in common, and moves both cursors.
Rounds work on whole frames: however many changes there are, a round is a few Spark jobs for each wave (the most changes
that one entity has in a pull).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import journal
from ..operators.merge import MAP, Resolver, field_level, resolve_changes
from ..plans.lineage import cut, numbered
from ..store import GraphStore
from ..types import JOURNAL, REVISION, schema

LOG = f"position bigint, {JOURNAL}"
SIDE = ["entity_kind", "entity_id", "properties", "deleted", "revision"]


class Transport(Protocol):
    """What a backend has to do; see ``quillgraph.streaming.contract`` for what is expected of it."""

    def push(self, changes: DataFrame) -> tuple[DataFrame, int]: ...

    def pull(self, after: int, actor: str, most: int) -> DataFrame: ...

    def end(self) -> int: ...


class SyncFailed(Exception):
    """A transport's failure; the round changed nothing that it had not finished."""


class LogBackend:
    """A log in a folder (Parquet), with one writer at a time. ``fail_next`` makes the next calls fail, for tests."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.fail_next = spark, path, 0
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)

    def log(self) -> DataFrame:
        return self.spark.read.schema(schema(LOG)).parquet(self.path)

    def _maybe_fail(self) -> None:
        if self.fail_next:
            self.fail_next -= 1
            raise SyncFailed("the backend is not available")

    def push(self, changes: DataFrame) -> tuple[DataFrame, int]:
        """Appends the changes that the log does not hold, in their order.

        Returns the (change_id, sequence) that the log now holds, which are all, and how many of them were new.
        """
        self._maybe_fail()
        fresh, count = numbered(journal.append_new(self.log(), changes), "sequence", after=self.end(), name="position")
        if count:
            fresh.select(schema(LOG).fieldNames()).write.mode("append").parquet(self.path)
        return changes.select("change_id", "sequence"), count

    def pull(self, after: int, actor: str, most: int) -> DataFrame:
        """Other actors' changes behind a position, at most so many positions of the log."""
        self._maybe_fail()
        return self.log().filter((F.col("position") > after) & (F.col("position") <= after + most) & (F.col("actor_id") != actor))

    def end(self) -> int:
        return self.log().agg(F.max("position")).first()[0] or 0


class RecordVersions:
    """The versions of entities that this store and a backend have had in common: an append-only table beside the journal."""

    DDL = f"backend string, entity_kind string, entity_id string, properties {MAP}, deleted boolean, revision {REVISION}, at timestamp"

    def __init__(self, store: GraphStore, backend: str):
        self.store, self.backend, self.path = store, backend, f"{store.path}/versions"

    def all(self) -> DataFrame:
        if not self.store._fs().exists(self.store._hpath("versions")):
            return self.store.spark.createDataFrame([], schema(self.DDL))
        return self.store.spark.read.schema(schema(self.DDL)).parquet(self.path).filter(F.col("backend") == self.backend)

    def latest(self) -> DataFrame:
        """The last synced version of each entity."""
        rows = self.all()
        newest = F.max_by(F.struct("properties", "deleted", "revision", "at"), F.struct("at", "revision.counter"))
        return rows.groupBy("entity_kind", "entity_id").agg(newest.alias("v")).select("entity_kind", "entity_id", "v.*")

    def save(self, rows: DataFrame) -> None:
        """Rows of SIDE that both sides now hold."""
        out = rows.withColumns({"backend": F.lit(self.backend), "at": F.lit(dt.datetime.now())})
        out.select(schema(self.DDL).fieldNames()).write.mode("append").parquet(self.path)

    def at(self, wanted: DataFrame) -> DataFrame:
        """SIDE rows of the versions that (entity_kind, entity_id, revision) rows name, as far as they are known."""
        keys = wanted.select("entity_kind", "entity_id", F.col("revision").alias("wanted"))
        rows = self.all().join(keys, ["entity_kind", "entity_id"]).filter(F.col("revision").eqNullSafe(F.col("wanted")))
        return rows.select(*SIDE).dropDuplicates(["entity_kind", "entity_id"])


@dataclass
class Status:
    """idle, syncing, offline, conflict or error, and what the last round did; ``conflicts`` lists the first of them."""

    state: str = "idle"
    pushed: int = 0
    pulled: int = 0
    n_conflicts: int = 0
    conflicts: list[tuple[str, str, str]] = field(default_factory=list)
    error: str | None = None


#: Conflicts that a status lists.
LISTED = 100


class Coordinator:
    """Syncs one store with one backend. Cursors are kept beside the store's journal.

    ``batch`` is how many rows go to the backend, or come from it, at once.
    """

    def __init__(self, store: GraphStore, backend: Transport, name: str = "main", resolver: Resolver | None = None, batch: int = 1 << 20):
        self.store, self.backend, self.name, self.batch = store, backend, name, batch
        self.resolver = resolver or field_level()
        self.versions = RecordVersions(store, name)
        self.status, self.enabled = Status(), True

    # cursors: the last row of a small append-only table

    CURSOR = "backend string, pushed bigint, pulled bigint, at timestamp"

    def _cursors(self) -> tuple[int, int]:
        path = f"{self.store.path}/cursors"
        if not self.store._fs().exists(self.store._hpath("cursors")):
            return 0, 0
        row = self.store.spark.read.schema(self.CURSOR).parquet(path).filter(F.col("backend") == self.name).agg(F.max("pushed"), F.max("pulled")).first()
        return row[0] or 0, row[1] or 0

    def _move(self, pushed: int, pulled: int) -> None:
        frame = self.store.spark.createDataFrame([(self.name, pushed, pulled, dt.datetime.now())], self.CURSOR)
        frame.coalesce(1).write.mode("append").parquet(f"{self.store.path}/cursors")

    def run_once(self) -> Status:
        """One round. Conflicts that the resolver fails are reported and leave the local version as it is."""
        if not self.enabled:
            return self.status
        self.status = Status("syncing")
        try:
            self._push()
            self._pull()
            self.status.state = "conflict" if self.status.n_conflicts else "idle"
        except SyncFailed as e:
            self.status.state, self.status.error = "offline", str(e)
        except Exception as e:
            self.status.state, self.status.error = "error", str(e)
            raise
        return self.status

    @staticmethod
    def _side(rows: DataFrame) -> DataFrame:
        return rows.select("entity_kind", "entity_id", F.col("payload.properties").alias("properties"), (F.col("operation") == journal.DELETE).alias("deleted"), "revision")

    def _push(self) -> None:
        """Sends own rows in batches by sequence; the cursor moves no further than what was accepted without a gap."""
        pushed, pulled = self._cursors()
        own = self.store.journal().filter((F.col("sequence") > pushed) & (F.col("actor_id") == self.store.actor))
        last = own.agg(F.max("sequence")).first()[0]
        if last is None:
            return
        for start in range(pushed, last, self.batch):
            part = own.filter((F.col("sequence") > start) & (F.col("sequence") <= start + self.batch))
            accepted, fresh = self.backend.push(part)
            self.versions.save(self._side(part.join(accepted.select("change_id"), "change_id", "left_semi")))
            self.status.pushed += fresh
            self._move(min(start + self.batch, last), pulled)

    def _pull(self) -> None:
        pushed, pulled = self._cursors()
        end = self.backend.end()
        while pulled < end:
            self._apply(self.backend.pull(pulled, self.store.actor, self.batch))
            pulled = min(pulled + self.batch, end)
            self._move(pushed, pulled)

    def _apply(self, changes: DataFrame) -> None:
        """Applies a batch in waves, each with one change of an entity at most, in the log's order."""
        fresh = journal.append_new(self.store.journal(), changes)
        order = Window.partitionBy("entity_kind", "entity_id").orderBy("position")
        waves = cut(fresh.withColumn("wave", F.row_number().over(order)), "waves")
        for wave in range(1, (waves.agg(F.max("wave")).first()[0] or 0) + 1):
            self._apply_wave(waves.filter(F.col("wave") == wave).drop("wave"))

    def _apply_wave(self, changes: DataFrame) -> None:
        """Journals the outcome under the remote actor, so that it is not pushed back; a merge becomes a change of its own."""
        key = ["entity_kind", "entity_id"]
        touched = changes.select(*key)
        rows = self._side(changes)
        held = self.store.states(touched)
        local = self._side(held)
        base = self.versions.at(changes.select(*key, F.col("base_revision").alias("revision")))
        mine = held.select(*key, F.col("payload").alias("own"))
        decided = resolve_changes(base, local, rows, self.resolver).join(changes, key).join(mine, key, "left")
        action = F.col("resolution.action")
        properties = F.when(action == "delete", F.coalesce("payload", "own")["properties"]).otherwise(F.col("resolution.properties"))
        payload = F.coalesce("payload", "own").withField("properties", properties)
        merged = action.isin("merge", "useLocal") & F.col("diverged") & F.col("own").isNotNull() & ~_same(properties, F.col("payload.properties"))
        out = cut(decided.withColumns({"outcome": payload, "merged": F.coalesce(merged, F.lit(False)), "reason": F.col("resolution.reason"), "done": action}).drop("resolution"), "outcome")
        failed = out.filter("done = 'fail'")
        about = out.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("done") == "fail").cast("long")), F.lit(0)).alias("failed")).first()
        self.status.pulled += about["n"]
        if about["failed"]:
            self.status.n_conflicts += about["failed"]
            listed = failed.orderBy("position").select(*key, "reason").limit(max(0, LISTED - len(self.status.conflicts))).collect()
            self.status.conflicts += [tuple(r) for r in listed]
        ours = F.struct(F.lit(self.store.actor).alias("actor_id"), F.lit(None).cast("bigint").alias("counter"), F.lit(dt.datetime.now()).alias("wall_clock")).cast(REVISION)
        fine = out.filter("done <> 'fail'")
        self.versions.save(self._side(fine.select(*changes.columns)))
        new = fine.select(
            "position", F.when(F.col("merged"), F.upper(F.expr("uuid()"))).otherwise(F.col("change_id")).alias("change_id"), "graph_id",
            F.when(F.col("merged"), self.store.actor).otherwise(F.col("actor_id")).alias("actor_id"), *key, F.when(F.col("done") == "delete", journal.DELETE).otherwise(journal.UPSERT).alias("operation"),
            F.col("outcome").alias("payload"), F.when(F.col("merged"), F.col("revision")).otherwise(F.col("base_revision")).alias("base_revision"), F.when(F.col("merged"), ours).otherwise(F.col("revision")).alias("revision"), "created_at")
        self.store.append_merged(new, "position")


def _same(a, b):
    """Whether two maps of properties hold the same; compared entry by entry, as maps have no equality."""
    entries = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"], F.to_json(e["value"]))))
    return F.coalesce(entries(a) == entries(b), a.isNull() & b.isNull())


class Synchroniser:
    """The backends that a store is synced with, by name: enabling, running, disabling, and what state they are in."""

    def __init__(self, store: GraphStore):
        self.store, self._coordinators, self._watchers = store, {}, []

    def enable(self, name: str, backend: Transport, resolver: Resolver | None = None, batch: int = 1 << 20) -> None:
        """Registers a backend; cursors of an earlier registration under this name go on from where they were."""
        self._coordinators[name] = Coordinator(self.store, backend, name, resolver, batch)
        self._tell(name)

    def disable(self, name: str) -> None:
        """Forgets a backend; its cursors stay."""
        self._coordinators.pop(name, None)

    def watch(self, on_status: Callable[[str, Status], None]) -> None:
        """Calls ``on_status`` with a backend's name and status before and after each of its rounds."""
        self._watchers.append(on_status)

    def status(self) -> dict[str, Status]:
        return {name: c.status for name, c in self._coordinators.items()}

    def sync_now(self, name: str) -> Status:
        """One round with a backend; LookupError if none has this name."""
        if name not in self._coordinators:
            raise LookupError(f"no backend is called {name}")
        self._tell(name, Status("syncing"))
        try:
            return self._coordinators[name].run_once()
        finally:
            self._tell(name)

    def _tell(self, name: str, status: Status | None = None) -> None:
        for f in self._watchers:
            f(name, status or self._coordinators[name].status)
