"""Property values, identities and the schemas of nodes, edges and journal rows.

A property is a tagged union. Its tag takes part in equality: an int 1, a double 1.0 and a string "1" are three
different values. Only int, double, string, bool and date values have an order, each among its own kind.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag of a value -> the field of the union that holds it and that field's type.
FIELDS = {"int": ("i", "bigint"), "double": ("d", "double"), "string": ("s", "string"), "bool": ("b", "boolean"), "date": ("ts", "timestamp"), "data": ("bin", "binary"), "array": ("arr", "string")}
#: Tags with an order, in the order in which a minimum of mixed values prefers them.
ORDERED = ("int", "double", "string", "bool", "date")
NUMERIC = ("int", "double")

PROP = "struct<type:string,s:string,i:bigint,d:double,b:boolean,ts:timestamp,bin:binary,arr:string>"
REVISION = "struct<actor_id:string,counter:bigint,wall_clock:timestamp>"
_TAIL = f"properties map<string,{PROP}>, created_at timestamp, modified_at timestamp, revision {REVISION}, is_deleted boolean, seq bigint"
NODES = f"id string, labels array<string>, label string, {_TAIL}"
EDGES = f"id string, type string, from_id string, to_id string, {_TAIL}"
PAYLOAD = f"struct<properties:map<string,{PROP}>,labels:array<string>,type:string,from_id:string,to_id:string,created_at:timestamp>"
JOURNAL = f"sequence bigint, change_id string, graph_id string, actor_id string, entity_kind string, entity_id string, operation string, payload {PAYLOAD}, base_revision {REVISION}, revision {REVISION}, created_at timestamp"

#: The revision of entities that were written without one.
ZERO_ACTOR = "00000000-0000-0000-0000-000000000000"


def _tagged_json(value: Any) -> dict:
    """The tagged JSON form of a value, for the elements of arrays."""
    tag, v = tag_of(value), value
    if tag == "null":
        return {"type": "null"}
    if tag == "date":
        v = round(value.timestamp() * 1000)
    elif tag == "data":
        v = base64.b64encode(bytes(value)).decode()
    elif tag == "array":
        v = [_tagged_json(x) for x in value]
    return {"type": tag, "value": v}


def tag_of(value: Any) -> str:
    """The tag of a Python value; a bool is not an int."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dt.datetime):
        return "date"
    if isinstance(value, (bytes, bytearray)):
        return "data"
    if isinstance(value, (list, tuple)):
        return "array"
    raise TypeError(f"not a property value: {type(value).__name__}")


def array_text(value: Iterable[Any]) -> str:
    """The canonical text of an array value: equal arrays have equal texts. NaN and infinities are written as Python's JSON does."""
    return json.dumps([_tagged_json(x) for x in value], sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stored(value: Any) -> Any:
    """What the tag's field holds: dates are cut to milliseconds, arrays are canonical text."""
    tag = tag_of(value)
    if tag == "array":
        return array_text(value)
    if tag == "data":
        return bytearray(value)
    if tag == "date":
        return value.replace(microsecond=value.microsecond // 1000 * 1000)
    if tag == "int" and not -(1 << 63) <= value < 1 << 63:
        raise OverflowError("int values have 64 bits")
    return value


def prop_row(value: Any) -> dict[str, Any]:
    """A value as a row of the union."""
    tag = tag_of(value)
    row = dict.fromkeys(("s", "i", "d", "b", "ts", "bin", "arr")) | {"type": tag}
    if tag != "null":
        row[FIELDS[tag][0]] = stored(value)
    return row


def prop_value(row: Any) -> Any:
    """The Python value of a row of the union; arrays come back as their canonical text, parsed."""
    if row is None or row["type"] == "null":
        return None
    v = row[FIELDS[row["type"]][0]]
    return json.loads(v) if row["type"] == "array" else bytes(v) if row["type"] == "data" else v


def literal(value: Any) -> Column:
    """A typed literal for the field of the value's tag. NaN is allowed here: it equals nothing."""
    tag = tag_of(value)
    if tag == "null":
        return F.lit(None)
    v = value if tag == "double" else stored(value)
    return F.lit(v).cast(FIELDS[tag][1])


def prop_struct(tag: str, value: Column) -> Column:
    """A union value with one field set."""
    kinds = {f: t for f, t in FIELDS.values()}
    fields = [F.lit(tag).alias("type")]
    for name in ("s", "i", "d", "b", "ts", "bin", "arr"):
        fields.append((value if FIELDS.get(tag, ("",))[0] == name else F.lit(None)).cast(kinds[name]).alias(name))
    return F.struct(*fields)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Revision:
    """One actor's counter and wall clock at a change.

    ``a < b``: by counter for the same actor, else by wall clock, else by actor. The relation is not transitive across
    actors, so a history is folded in its own order and never sorted.
    """

    actor_id: str
    counter: int
    wall_clock: dt.datetime

    def __lt__(self, other: Revision) -> bool:
        if self.actor_id == other.actor_id:
            return self.counter < other.counter
        if self.wall_clock != other.wall_clock:
            return self.wall_clock < other.wall_clock
        return self.actor_id < other.actor_id

    @property
    def is_placeholder(self) -> bool:
        return self.actor_id == ZERO_ACTOR and self.counter == 0

    def row(self) -> dict[str, Any]:
        return {"actor_id": self.actor_id, "counter": self.counter, "wall_clock": self.wall_clock}


def revision_before(a: Column, b: Column) -> Column:
    """``a < b`` of revisions, as a column."""
    clock = F.when(a["wall_clock"] != b["wall_clock"], a["wall_clock"] < b["wall_clock"]).otherwise(a["actor_id"] < b["actor_id"])
    return F.when(a["actor_id"] == b["actor_id"], a["counter"] < b["counter"]).otherwise(clock)


def random_ids() -> Iterator[str]:
    while True:
        yield str(uuid.uuid4()).upper()


def seeded_ids(seed: int) -> Iterator[str]:
    """Reproducible ids: version 4 UUIDs from the public splitmix64 sequence."""
    state, mask = seed & (1 << 64) - 1, (1 << 64) - 1

    def word() -> int:
        nonlocal state
        state = state + 0x9E3779B97F4A7C15 & mask
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    while True:
        yield str(uuid.UUID(int=word() << 64 | word(), version=4)).upper()
