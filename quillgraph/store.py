"""A writable graph: mutations become journal rows, and every commit is one atomic append.

A store is a folder: ``journal`` (a folder of Parquet for each commit, renamed into place), ``bulk`` (one for each bulk
load) and ``base`` (one for each compaction: all nodes and edges as of a sequence number). A reader sees whole commits
only. Many may read; one writes, and keeps what it has written last in mind.

Single mutations look up what they touch in one Spark job and are written by one. Changes of many entities belong in
``apply`` (a frame of changes: checks and new states are joins, one commit) or ``bulk_insert`` (whole new frames).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .graph import PropertyGraph
from .operators import adjacency, journal
from .plans.lineage import beside, cut, numbered, spread
from .types import EDGES, JOURNAL, NODES, PAYLOAD, PROP, REVISION, Revision, prop_row, random_ids, schema


class GraphError(Exception):
    """A mutation that the graph's rules forbid."""


class NotFound(GraphError):
    pass


class EndpointMissing(GraphError):
    pass


class LastLabel(GraphError):
    pass


#: Changes of many entities at once, for ``GraphStore.apply``. ``labels`` are a new node's, or those to add or remove.
CHANGES = f"action string, entity_kind string, id string, labels array<string>, type string, from_id string, to_id string, properties map<string,{PROP}>"
ACTIONS = ("add", "patch", "add_labels", "remove_labels", "delete")
#: Keys of entities are sent to all executors up to this number, and joined beyond it.
MOST_SENT = 1 << 17
_ERRORS = {"exists": GraphError, "missing": NotFound, "end": EndpointMissing, "last label": LastLabel}


class Transaction:
    """Mutations staged in the driver; they are written together or not at all."""

    def __init__(self, store: GraphStore):
        self.store, self.rows, self.staged = store, [], {}

    # reading: staged state first, then the store's

    def load(self, *keys: tuple[str, str]) -> None:
        """Looks up several entities (kind, id) in one job; mutations that touch them then need none of their own."""
        missing = [k for k in dict.fromkeys(keys) if k not in self.staged]
        if missing:
            self.staged |= dict.fromkeys(missing) | self.store._fetch(missing)

    def _current(self, kind: str, id: str) -> dict[str, Any] | None:
        self.load((kind, id))
        return self.staged[kind, id]

    def _live(self, kind: str, id: str) -> dict[str, Any]:
        now = self._current(kind, id)
        if now is None or now["deleted"]:
            raise NotFound(f"{kind} {id}")
        return now

    def _append(self, kind: str, id: str, operation: str, payload: dict | None, base: dict | None) -> None:
        revision = self.store._mint()
        self.rows.append({"sequence": None, "change_id": next(self.store.ids), "graph_id": self.store.graph_id, "actor_id": self.store.actor, "entity_kind": kind, "entity_id": id, "operation": operation, "payload": payload, "base_revision": base, "revision": revision.row(), "created_at": revision.wall_clock})
        before = self.staged.get((kind, id))
        self.staged[kind, id] = {"payload": payload or (before or {}).get("payload"), "revision": revision.row(), "deleted": operation == journal.DELETE}

    def _new(self, kind: str, id: str | None) -> str:
        """An id for a new entity. One that the store mints is new; one that is given must not exist."""
        if id is None:
            id = next(self.store.ids)
            self.staged[kind, id] = None
        elif self._current(kind, id) is not None:
            raise GraphError(f"{kind} {id} exists or existed")
        return id

    # mutations

    def add_node(self, labels: str | Iterable[str], properties: dict[str, Any] | None = None, id: str | None = None) -> str:
        names = sorted({labels} if isinstance(labels, str) else set(labels))
        if not names:
            raise ValueError("a node has a label")
        id = self._new("node", id)
        self._append("node", id, journal.UPSERT, self._payload(properties, labels=names), None)
        return id

    def add_edge(self, from_id: str, to_id: str, type: str, properties: dict[str, Any] | None = None, id: str | None = None) -> str:
        self.load(("node", from_id), ("node", to_id), *([("edge", id)] if id else []))
        for end in (from_id, to_id):
            now = self._current("node", end)
            if now is None or now["deleted"]:
                raise EndpointMissing(end)
        id = self._new("edge", id)
        self._append("edge", id, journal.UPSERT, self._payload(properties, type=type, from_id=from_id, to_id=to_id), None)
        return id

    @staticmethod
    def _payload(properties: dict[str, Any] | None, **rest: Any) -> dict[str, Any]:
        empty = {"labels": None, "type": None, "from_id": None, "to_id": None, "created_at": dt.datetime.now()}
        return empty | {"properties": {k: prop_row(v) for k, v in (properties or {}).items() if v is not None}} | rest

    def _update(self, kind: str, id: str, properties: dict[str, Any]) -> None:
        """Merges a patch; a None value removes its key."""
        now = self._live(kind, id)
        merged = dict(now["payload"]["properties"] or {})
        for k, v in properties.items():
            if v is None:
                merged.pop(k, None)
            else:
                merged[k] = prop_row(v)
        self._append(kind, id, journal.UPSERT, now["payload"] | {"properties": merged}, now["revision"])

    def update_node(self, id: str, properties: dict[str, Any]) -> None:
        self._update("node", id, properties)

    def update_edge(self, id: str, properties: dict[str, Any]) -> None:
        self._update("edge", id, properties)

    def _relabel(self, id: str, labels: list[str], now: dict[str, Any]) -> None:
        self._append("node", id, journal.UPSERT, now["payload"] | {"labels": sorted(labels)}, now["revision"])

    def add_label(self, label: str, id: str) -> None:
        now = self._live("node", id)
        if label not in now["payload"]["labels"]:
            self._relabel(id, [*now["payload"]["labels"], label], now)

    def remove_label(self, label: str, id: str) -> None:
        now = self._live("node", id)
        left = [x for x in now["payload"]["labels"] if x != label]
        if not left:
            raise LastLabel(f"{label} is the last label of {id}")
        if len(left) < len(now["payload"]["labels"]):
            self._relabel(id, left, now)

    def _delete(self, kind: str, id: str) -> None:
        """Marks an entity as deleted; edges of a deleted node stay. Nothing happens where there is none."""
        now = self._current(kind, id)
        if now is not None and not now["deleted"]:
            self._append(kind, id, journal.DELETE, now["payload"], now["revision"])

    def delete_node(self, id: str) -> None:
        self._delete("node", id)

    def delete_edge(self, id: str) -> None:
        self._delete("edge", id)


def _fitted(frame: DataFrame, ddl: str) -> DataFrame:
    """A frame in the columns of a schema; those that it lacks are null, others are left out."""
    return frame.select(*(F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(ddl)))


class GraphStore:
    """``with store.transaction() as tx: ...`` or single mutations of the same names on the store."""

    def __init__(self, spark: SparkSession, path: str, actor: str | None = None, ids: Iterator[str] | None = None, indexes: Iterable[tuple[str, str]] = ()):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), ids or random_ids()
        self.actor, self.graph_id, self.indexes = actor or str(uuid.uuid4()).upper(), "main", tuple(indexes)
        self._counter: int | None = None
        self._top: int | None = None
        self._open: Transaction | None = None
        self._manifests: dict[str, dict] = {}
        self._fs().mkdirs(self._hpath("journal"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> GraphStore:
        return cls(spark, path, **options)

    # files

    def _hpath(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._hpath().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files = self._fs()
        return sorted(x.getPath().getName() for x in files.listStatus(self._hpath(folder))) if files.exists(self._hpath(folder)) else []

    def _publish(self, frames: dict[str, DataFrame], target: str) -> None:
        """Writes frames beside the store's data and renames them into place, so that they are seen as a whole."""
        staging = f"_staging/{uuid.uuid4().hex}"
        for name, frame in frames.items():
            frame.write.parquet(f"{self.path}/{staging}{name and '/'}{name}")
        files = self._fs()
        files.mkdirs(self._hpath(target).getParent())
        if not files.rename(self._hpath(staging), self._hpath(target)):
            raise OSError(f"could not move a commit to {target}")

    # state

    def journal(self) -> DataFrame:
        return self.spark.read.schema(schema(JOURNAL)).option("recursiveFileLookup", "true").parquet(f"{self.path}/journal")

    def _version(self) -> tuple[str | None, int, frozenset[str]]:
        """The newest compaction: its folder, the last sequence and the bulk loads that it holds."""
        names = self._names("base")
        if not names:
            return None, 0, frozenset()
        name = names[-1]
        if name not in self._manifests:
            self._manifests[name] = json.loads(self.spark.read.parquet(f"{self.path}/base/{name}/manifest").first()["value"])
        return name, self._manifests[name]["through"], frozenset(self._manifests[name]["bulk"])

    def _base(self, kind: str) -> DataFrame | None:
        """Nodes or edges that the newest compaction and the bulk loads since hold."""
        name, _, held = self._version()
        folders = ([f"base/{name}"] if name else []) + [f"bulk/{x}" for x in self._names("bulk") if x not in held]
        folders = [x for x in folders if self._fs().exists(self._hpath(f"{x}/{kind}"))]
        ddl = NODES if kind == "nodes" else EDGES
        return self.spark.read.schema(schema(ddl)).parquet(*(f"{self.path}/{x}/{kind}" for x in folders)) if folders else None

    def _recent(self) -> DataFrame:
        """Journal rows that the newest compaction does not hold."""
        return self.journal().filter(F.col("sequence") > self._version()[1])

    @staticmethod
    def _as_rows(base: DataFrame, kind: str) -> DataFrame:
        """Base rows as the oldest journal rows of their entities."""
        payload = F.struct(*(F.col(c) if c in base.columns else F.lit(None).alias(c) for c in ("properties", "labels", "type", "from_id", "to_id", "created_at"))).cast(PAYLOAD)
        operation = F.when(F.coalesce("is_deleted", F.lit(False)), journal.DELETE).otherwise(journal.UPSERT)
        return base.select(F.lit(-1).cast("bigint").alias("sequence"), F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), operation.alias("operation"), payload.alias("payload"), "revision", F.col("modified_at").alias("created_at"))

    def _folded(self, rows: DataFrame, only: dict[str, list[str]] | None = None) -> DataFrame:
        """The states of the entities of some journal rows (and of ``only``, by kind), from the base on."""
        for kind in ("node", "edge"):
            base = self._base(f"{kind}s")
            if base is not None and (only is None or only.get(kind)):
                touched = rows.filter(F.col("entity_kind") == kind).select(F.col("entity_id").alias("id")).distinct()
                own = base.join(spread(touched), "id", "left_semi") if only is None else base.filter(F.col("id").isin(only[kind]))
                rows = rows.unionByName(self._as_rows(own, kind), allowMissingColumns=True)
        return journal.fold(rows)

    def state(self) -> DataFrame:
        """The states of all entities that the journal has changed since the newest compaction."""
        return self._folded(self._recent())

    def states(self, touched: DataFrame) -> DataFrame:
        """The states of some entities (entity_kind, entity_id), of those that there are."""
        keys = beside(cut(touched.select("entity_kind", "entity_id").distinct(), "keys"), MOST_SENT, "merge")
        rows = self._recent().join(keys, ["entity_kind", "entity_id"], "left_semi")
        for kind in ("node", "edge"):
            base = self._base(f"{kind}s")
            if base is not None:
                rows = rows.unionByName(self._as_rows(base, kind).join(keys, ["entity_kind", "entity_id"], "left_semi"), allowMissingColumns=True)
        return journal.fold(rows)

    def _all(self, kind: str, rows: DataFrame) -> DataFrame:
        base = self._base(kind)
        if base is None:
            return rows
        new = rows.join(spread(base.select("id", F.col("seq").alias("_seq"))), "id", "left").withColumn("seq", F.coalesce("_seq", "seq"))
        return base.join(spread(rows.select("id")), "id", "left_anti").select(rows.columns).unionByName(new.select(rows.columns))

    def nodes(self) -> DataFrame:
        """All nodes, deleted ones marked: the base under the folded journal."""
        return self._all("nodes", journal.nodes_of(self.state()))

    def edges(self) -> DataFrame:
        return self._all("edges", journal.edges_of(self.state()))

    def graph(self) -> PropertyGraph:
        """The graph as it is now. It pins the files it reads, so later commits do not change it."""
        return PropertyGraph.from_dataframes(self.nodes(), self.edges(), self.indexes)

    def tombstones(self, kind: str, since: Any = None) -> DataFrame:
        dead = (self.nodes() if kind == "node" else self.edges()).filter("is_deleted")
        rows = dead.select("id", F.lit(kind).alias("kind"), "modified_at", "revision")
        return (rows if since is None else rows.filter(F.col("modified_at") >= F.lit(since))).orderBy("modified_at", "id")

    def _fetch(self, keys: list[tuple[str, str]]) -> dict[tuple[str, str], dict[str, Any]]:
        """The states of a few entities (kind, id), in one job."""
        only = {kind: [i for k, i in keys if k == kind] for kind in ("node", "edge")}
        asked = F.lit(False)
        for kind, ids in only.items():
            if ids:
                asked = asked | (F.col("entity_kind") == kind) & F.col("entity_id").isin(ids)
        rows = self._folded(self._recent().filter(asked), only).select("entity_kind", "entity_id", "operation", "payload", "revision").collect()  # as many as keys
        out = {}
        for r in (row.asDict(recursive=True) for row in rows):
            out[r["entity_kind"], r["entity_id"]] = {"payload": r["payload"], "revision": r["revision"], "deleted": r["operation"] == journal.DELETE}
        return out

    def node(self, id: str) -> Row | None:
        return self.graph().node(id).first()

    def edge(self, id: str) -> Row | None:
        return self.graph().edge(id).first()

    # writing

    def _start(self) -> None:
        """Reads once where the journal and this actor's counter stand."""
        if self._top is None or self._counter is None:
            own = F.when(F.col("actor_id") == self.actor, F.col("revision.counter"))
            row = self.journal().agg(F.max("sequence").alias("top"), F.max(own).alias("counter")).first()
            counters = [row["counter"] or 0]
            for kind in ("nodes", "edges"):
                base = self._base(kind)
                if base is not None:
                    counters.append(base.filter(F.col("revision.actor_id") == self.actor).agg(F.max("revision.counter")).first()[0] or 0)
            self._top, self._counter = row["top"] or 0, max(counters) + 1

    def _mint(self) -> Revision:
        self._start()
        revision = Revision(self.actor, self._counter, dt.datetime.now())
        self._counter += 1
        return revision

    def commit_rows(self, rows: list[dict[str, Any]]) -> None:
        """Appends a few journal rows, numbered behind the journal's."""
        if not rows:
            return
        self._start()
        for i, r in enumerate(rows, self._top + 1):
            r["sequence"] = i
        columns = schema(JOURNAL).fieldNames()
        self.append(self.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema(JOURNAL)).coalesce(1), len(rows))

    def append(self, rows: DataFrame, count: int) -> None:
        """Appends ``count`` journal rows, which are numbered behind the journal's, as one commit."""
        self._start()
        if count:
            self._publish({"": rows.select(schema(JOURNAL).fieldNames())}, f"journal/c{self._top + 1:020d}")
            self._top += count

    def append_merged(self, rows: DataFrame, order: str) -> int:
        """Appends journal rows of other actors, and own ones without a counter, which get one; returns how many."""
        self._start()
        placed, count = numbered(rows, order, after=0, name="_n")
        mine = (F.col("actor_id") == self.actor) & F.col("revision.counter").isNull()
        revision = F.when(mine, F.col("revision").withField("counter", F.lit(self._counter - 1) + F.col("_n"))).otherwise(F.col("revision"))
        self.append(placed.withColumns({"sequence": F.lit(self._top) + F.col("_n"), "revision": revision}), count)
        self._counter += count
        return count

    def apply(self, changes: DataFrame) -> int:
        """Applies CHANGES, at most one for each entity, as one commit; returns the number of journal rows.

        The same rules hold as for single mutations: what is added is new, what is patched or relabelled is live, an
        edge's ends are live (or added here), a node keeps a label, a patch's null values remove keys. Deleting what is
        not there, adding a label twice and removing one that is not there change nothing. If any change breaks a rule,
        nothing is written, and the error names the first such entity.
        """
        self._start()
        given = cut(_fitted(changes, CHANGES), "changes")
        ends = given.filter("action = 'add' and entity_kind = 'edge'").select("id", F.explode(F.array("from_id", "to_id")).alias("end"))
        touched = given.select("entity_kind", F.col("id").alias("entity_id")).unionByName(ends.select(F.lit("node").alias("entity_kind"), F.col("end").alias("entity_id")))
        nothing = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema(JOURNAL)["payload"].dataType))  # of a deletion that came without one
        held = cut(self.states(touched).select("entity_kind", F.col("entity_id").alias("id"), F.coalesce("payload", nothing).alias("now"), F.col("revision").alias("was"), (F.col("operation") == journal.DELETE).alias("dead")), "held")
        joined = given.join(spread(held), ["entity_kind", "id"], "left").withColumn("times", F.count("*").over(Window.partitionBy("entity_kind", "id")))
        live = F.coalesce(~F.col("dead"), F.lit(False))
        there = held.filter("entity_kind = 'node' and not dead").select(F.col("id").alias("end")).unionByName(given.filter("action = 'add' and entity_kind = 'node'").select(F.col("id").alias("end")))
        loose = ends.join(spread(there), "end", "left_anti").select(F.lit("edge").alias("entity_kind"), "id", F.lit(True).alias("loose")).distinct()
        labels = F.coalesce("labels", F.array().cast("array<string>"))
        had = F.coalesce(F.col("now.labels"), F.array().cast("array<string>"))
        after = F.array_sort(F.when(F.col("action") == "add", F.array_distinct(labels)).when(F.col("action") == "add_labels", F.array_union(had, labels)).otherwise(F.array_except(had, labels)))
        relabels = F.col("action").isin("add_labels", "remove_labels")
        error = (
            F.when(~F.col("action").isin(*ACTIONS) | ~F.col("entity_kind").isin("node", "edge") | F.col("id").isNull() | relabels & (F.col("entity_kind") == "edge"), "not a change")
            .when(F.col("times") > 1, "changed twice")
            .when((F.col("action") == "add") & F.col("now").isNotNull(), "exists")
            .when(((F.col("action") == "patch") | relabels) & ~live, "missing")
            .when(F.coalesce("loose", F.lit(False)), "end")
            .when((F.col("entity_kind") == "node") & F.col("action").isin("add", "add_labels", "remove_labels") & (F.size(after) == 0), "last label")
        )
        idle = (F.col("action") == "delete") & ~live | relabels & (after == F.array_sort(had))
        added = F.struct(journal.patched(F.lit(None), F.col("properties")).alias("properties"), F.when(F.col("entity_kind") == "node", after).alias("labels"), "type", "from_id", "to_id", F.current_timestamp().alias("created_at")).cast(PAYLOAD)
        patched = F.col("now").withField("properties", journal.patched(F.col("now.properties"), F.col("properties")))
        payload = F.when(F.col("action") == "add", added).when(F.col("action") == "patch", patched).when(relabels, F.col("now").withField("labels", after)).otherwise(F.col("now"))
        rows = joined.join(spread(loose), ["entity_kind", "id"], "left").select("entity_kind", F.col("id").alias("entity_id"), "action", "was", error.alias("error"), F.coalesce(idle, F.lit(False)).alias("idle"), payload.alias("payload"))
        checked = cut(rows, "changes")
        bad = checked.filter("error is not null").orderBy("entity_kind", "entity_id").first()
        if bad is not None:
            raise _ERRORS.get(bad["error"], GraphError)(f"{bad['entity_kind']} {bad['entity_id']}: {bad['error']}")
        now = F.lit(dt.datetime.now())
        fresh, count = numbered(checked.filter("not idle"), "entity_kind", "entity_id", after=0, name="n")
        operation = F.when(F.col("action") == "delete", journal.DELETE).otherwise(journal.UPSERT)
        revision = F.struct(F.lit(self.actor).alias("actor_id"), (F.lit(self._counter - 1) + F.col("n")).alias("counter"), now.alias("wall_clock")).cast(REVISION)
        out = fresh.select((F.lit(self._top) + F.col("n")).alias("sequence"), F.upper(F.expr("uuid()")).alias("change_id"), F.lit(self.graph_id).alias("graph_id"), F.lit(self.actor).alias("actor_id"), "entity_kind", "entity_id", operation.alias("operation"), "payload", F.col("was").alias("base_revision"), revision.alias("revision"), now.alias("created_at"))
        self.append(out, count)
        self._counter += count
        return count

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        if self._open is not None:
            raise GraphError("transactions do not nest")
        self._open = tx = Transaction(self)
        counter = self._counter
        try:
            yield tx
            self.commit_rows(tx.rows)
        except BaseException:
            self._counter = counter
            raise
        finally:
            self._open = None

    def _single(self, name: str, *args: Any, **kwargs: Any) -> Any:
        with self.transaction() as tx:
            return getattr(tx, name)(*args, **kwargs)

    def add_node(self, *args: Any, **kwargs: Any) -> str:
        return self._single("add_node", *args, **kwargs)

    def add_edge(self, *args: Any, **kwargs: Any) -> str:
        return self._single("add_edge", *args, **kwargs)

    def update_node(self, id: str, properties: dict[str, Any]) -> None:
        self._single("update_node", id, properties)

    def update_edge(self, id: str, properties: dict[str, Any]) -> None:
        self._single("update_edge", id, properties)

    def add_label(self, label: str, id: str) -> None:
        self._single("add_label", label, id)

    def remove_label(self, label: str, id: str) -> None:
        self._single("remove_label", label, id)

    def delete_node(self, id: str) -> None:
        self._single("delete_node", id)

    def delete_edge(self, id: str) -> None:
        self._single("delete_edge", id)

    def bulk_insert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, strict: bool = False) -> tuple[int, int]:
        """Adds whole frames (of NODES and EDGES, or some of their columns) at once, without journal rows; returns how many.

        Ids are new and occur once, else nothing is written. ``strict`` refuses edges that lack an end; otherwise they
        are stored and drop out where ends are looked up.
        """
        frames = {}
        for name, frame, ddl, old in (("nodes", nodes, NODES, self.nodes), ("edges", edges, EDGES, self.edges)):
            if frame is not None:
                given = _fitted(frame, ddl).withColumns({"is_deleted": F.coalesce("is_deleted", F.lit(False)), "modified_at": F.coalesce("modified_at", F.lit(dt.datetime.now()))})
                frames[name] = cut(journal.backfilled(given), "bulk")
                known = old().select("id", F.lit(0).alias("given")).unionByName(frames[name].select("id", F.lit(1).alias("given")))
                twice = known.groupBy("id").agg(F.count("*").alias("times"), F.sum("given").alias("given")).filter("times > 1 and given > 0 and id is not null").first()
                if twice is not None:
                    raise GraphError(f"{name[:-1]} {twice['id']} exists or comes twice")
        if strict and "edges" in frames:
            known = self.nodes() if nodes is None else self.nodes().unionByName(frames["nodes"])
            if not adjacency.missing_ends(known.filter("not coalesce(is_deleted, false)"), frames["edges"]).isEmpty():
                raise EndpointMissing("some edges lack an end")
        if frames:
            self._publish(frames, f"bulk/b{len(self._names('bulk')):010d}-{uuid.uuid4().hex}")
        return tuple(frames[x].count() if x in frames else 0 for x in ("nodes", "edges"))

    # compaction

    def should_compact(self, factor: int = 4) -> bool:
        """Whether the journal since the newest compaction has outgrown the nodes that it holds."""
        base = self._base("nodes")
        return adjacency.should_compact(self._recent().count(), base.count() if base is not None else 0, factor)

    def compact(self) -> None:
        """Writes all nodes and edges, with all their columns and deletions, as a new base; reading folds only later rows.

        The journal stays for followers and for synchronisation, and so do older bases for readers that have them open.
        """
        self._start()
        manifest = {"through": self._top, "bulk": self._names("bulk")}
        text = self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
        self._publish({"nodes": self.nodes(), "edges": self.edges(), "manifest": text}, f"base/v{len(self._names('base')):010d}")

    # streams

    def changes(self) -> DataFrame:
        """A streaming frame of mutation events, from the journal's start unless a checkpoint says otherwise."""
        rows = self.spark.readStream.schema(schema(JOURNAL)).option("recursiveFileLookup", "true").parquet(f"{self.path}/journal")
        return journal.events(rows)

    def follow(self, on_batch: Any, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Calls ``on_batch(events, batch_id)`` for each batch of new changes; restarts where the checkpoint left off."""
        writer = self.changes().writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
