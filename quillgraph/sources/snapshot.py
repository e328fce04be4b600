"""Snapshots: a graph as Parquet with a manifest, checked before use.

A snapshot's folder holds versions, each renamed into place as a whole; the newest one counts. A write removes older
versions only when its own is in place, so there is a whole one at any time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.journal import backfilled
from ..types import EDGES, NODES, schema

FORMAT = 1
#: Versions of the stored schema: 1 has no revisions, 2 adds them, 3 adds typed properties, 4 adds several labels.
SCHEMA_VERSION = 4
POLICIES = ("auto", "disabled")


class SnapshotError(Exception):
    """A snapshot that is missing, incomplete or not what its manifest says. A failure to read is not one."""


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and the sum of their CRC-32s, which does not depend on their order."""
    row = df.agg(F.count("*"), F.sum(F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary")))).first()
    return row[0], row[1] or 0


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _size(spark: SparkSession, path: str) -> list[int]:
    """Files and bytes of a folder."""
    p, files = _fs(spark, path)
    about = files.getContentSummary(p)
    return [about.getFileCount(), about.getLength()]


def _versions(spark: SparkSession, path: str) -> list[str]:
    p, files = _fs(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(p) if x.getPath().getName().startswith("v")) if files.exists(p) else []


def _policy(policy: str) -> bool:
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    return policy == "auto"


def write_snapshot(graph: PropertyGraph, path: str, version: int = SCHEMA_VERSION, policy: str = "auto") -> dict | None:
    """Writes a new version beside the others, renames it into place, and removes older ones; returns its manifest.

    With the policy ``disabled`` nothing is written.
    """
    if not _policy(policy):
        return None
    spark = graph.spark
    staging = f"{path}/_{uuid.uuid4().hex}"
    manifest: dict = {"format": FORMAT, "schema_version": version, "indexes": sorted(map(list, graph.indexes))}
    for name, frame in (("nodes", graph.live_nodes()), ("edges", graph.live_edges())):
        frame.write.parquet(f"{staging}/{name}")
        rows, crc = checksum(spark.read.schema(frame.schema).parquet(f"{staging}/{name}"))
        manifest[name] = {"rows": rows, "crc32": crc, "size": _size(spark, f"{staging}/{name}"), "schema": frame.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    before = _versions(spark, path)
    target, files = _fs(spark, f"{path}/v{int(before[-1][1:]) + 1 if before else 0:010d}")
    if not files.rename(_fs(spark, staging)[0], target):
        raise SnapshotError(f"could not move the snapshot to {target}")
    for name in before:
        files.delete(_fs(spark, f"{path}/{name}")[0], True)
    return manifest


def _newest(spark: SparkSession, path: str) -> str:
    versions = _versions(spark, path)
    if not versions:
        raise SnapshotError(f"there is no snapshot in {path}")
    return f"{path}/{versions[-1]}"


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the newest version, with ``folder``, where that is."""
    folder = _newest(spark, path)
    target, files = _fs(spark, f"{folder}/manifest")
    rows = spark.read.text(f"{folder}/manifest").collect() if files.exists(target) else []
    try:
        manifest = json.loads(rows[0]["value"])
    except (IndexError, ValueError) as e:
        raise SnapshotError(f"no manifest in {folder}") from e
    if manifest.get("format") != FORMAT:
        raise SnapshotError(f"format {manifest.get('format')} is not known")
    if not 1 <= manifest.get("schema_version", 0) <= SCHEMA_VERSION:
        raise SnapshotError(f"schema version {manifest.get('schema_version')} is not known")
    return manifest | {"folder": folder}


def read_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    """The snapshot's graph, after checking both tables' sizes and contents against the manifest."""
    from pyspark.sql.types import StructType

    manifest = read_manifest(spark, path)
    frames = {}
    for name in ("nodes", "edges"):
        about, folder = manifest[name], f"{manifest['folder']}/{name}"
        target, files = _fs(spark, folder)
        if not files.exists(target) or _size(spark, folder) != about["size"]:
            raise SnapshotError(f"{name} has lost or gained files")
        frames[name] = spark.read.schema(StructType.fromJson(about["schema"])).parquet(folder)
        if checksum(frames[name]) != (about["rows"], about["crc32"]):
            raise SnapshotError(f"{name} is not what the manifest says")
    return PropertyGraph.from_dataframes(migrate(frames["nodes"], NODES, manifest["schema_version"]), migrate(frames["edges"], EDGES, manifest["schema_version"]), [tuple(x) for x in manifest["indexes"]])


def migrate(df: DataFrame, ddl: str, version: int) -> DataFrame:
    """A table of an older version in today's columns, one version at a time; flat properties stay as they are."""
    have = set(df.columns)
    if version < 2 and "modified_at" in have:
        df = backfilled(df)
    if version < 3 and "properties" in have and dict(df.dtypes)["properties"] == "string":
        df = df.withColumn("properties", F.from_json("properties", schema(ddl)["properties"].dataType))
    if version < 4 and "label" in have and "labels" not in have:
        df = df.withColumn("labels", F.array("label"))
    for f in schema(ddl):
        if f.name not in df.columns and f.name in ("is_deleted",):
            df = df.withColumn(f.name, F.lit(False))
    return df


def load_or_discard(spark: SparkSession, path: str, policy: str = "auto") -> PropertyGraph | None:
    """The snapshot's graph, or None after removing one that is not sound. ``disabled`` never reads.

    Only a mismatch with the manifest removes a snapshot; a job that fails (a lost executor, say) leaves it as it is.
    """
    if not _policy(policy):
        return None
    try:
        return read_snapshot(spark, path)
    except SnapshotError:
        target, files = _fs(spark, path)
        if files.exists(target):
            files.delete(target, True)
        return None
