"""Column expressions over properties.

A graph keeps a property either as a flat column named ``key__tag`` (a promoted property: its predicates reach the
Parquet scan) or in the ``properties`` map. A flat column of the key hides the map.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FIELDS, NUMERIC, ORDERED, literal, prop_struct, tag_of

OPERATORS = ("=", "!=", ">", ">=", "<", "<=")
#: Tags that a literal of a pushable comparison can have.
COMPARABLE = ORDERED


class Properties:
    """The properties of the rows of a DataFrame with the given columns."""

    def __init__(self, columns: Sequence[str]):
        self.columns = set(columns)
        self.mapped = "properties" in self.columns

    def tags(self, key: str) -> list[str]:
        """The tags that a property can have here."""
        flat = [t for t in FIELDS if f"{key}__{t}" in self.columns]
        return flat or ([*FIELDS] if self.mapped else [])

    def _flat(self, key: str) -> bool:
        return any(f"{key}__{t}" in self.columns for t in FIELDS)

    def field(self, key: str, tag: str) -> Column:
        """The property's value if it has this tag, else null."""
        if f"{key}__{tag}" in self.columns:
            return F.col(f"`{key}__{tag}`")
        if self._flat(key) or not self.mapped:
            return F.lit(None).cast(FIELDS[tag][1])
        value = F.element_at("properties", F.lit(key))
        return F.when(value["type"] == tag, value[FIELDS[tag][0]])

    def present(self, key: str) -> Column:
        """Whether the row has the property at all (a null value is one)."""
        if self._flat(key):
            return reduce(Column.__or__, [F.col(f"`{key}__{t}`").isNotNull() for t in FIELDS if f"{key}__{t}" in self.columns])
        return F.coalesce(F.map_contains_key("properties", F.lit(key)), F.lit(False)) if self.mapped else F.lit(False)

    def value(self, key: str) -> Column:
        """The property as a value of the union, or null where it is missing."""
        if self._flat(key) or not self.mapped:
            return F.coalesce(*[F.when(self.field(key, t).isNotNull(), prop_struct(t, self.field(key, t))) for t in self.tags(key)], prop_null())
        return F.element_at("properties", F.lit(key))

    def number(self, key: str) -> Column:
        """An int or double as a double, else null."""
        have = [self.field(key, t).cast("double") for t in NUMERIC if t in self.tags(key)]
        return F.coalesce(*have) if have else F.lit(None).cast("double")

    # predicates: never null

    def equals(self, key: str, value: Any) -> Column:
        """Equality of tag and value. A missing property equals nothing, NaN equals nothing."""
        tag = tag_of(value)
        if tag == "null":
            return F.coalesce(F.element_at("properties", F.lit(key))["type"] == "null", F.lit(False)) if self.mapped and not self._flat(key) else F.lit(False)
        if tag == "double" and value != value:
            return F.lit(False)
        return F.coalesce(self.field(key, tag) == literal(value), F.lit(False))

    def within(self, key: str, values: Iterable[Any]) -> Column:
        """Membership, tag by tag; an empty list holds nothing."""
        by: dict[str, list[Any]] = {}
        for v in values:
            by.setdefault(tag_of(v), []).append(v)
        out = F.lit(False)
        for tag, same in by.items():
            if tag == "null":
                out = out | self.equals(key, None)
            else:
                out = out | F.coalesce(self.field(key, tag).isin([literal(v) for v in same if v == v]), F.lit(False))
        return out

    def compares(self, key: str, op: str, value: Any) -> Column:
        """A comparison with a value of the same tag; anything else is false."""
        if op not in OPERATORS:
            raise ValueError(f"operator is one of {OPERATORS}, not {op!r}")
        tag = tag_of(value)
        if tag not in COMPARABLE:
            raise TypeError(f"a {tag} value has no order; use equals or in_")
        if value != value:
            return F.lit(False)
        a, b = self.field(key, tag), literal(value)
        if tag == "double" and op in (">", ">=", "!="):
            a = F.when(~F.isnan(a), a)
        return F.coalesce({"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op], F.lit(False))

    def compares_or_differs(self, key: str, op: str, value: Any) -> Column:
        """As ``compares``, but a present value of another tag is unequal."""
        if op != "!=":
            return self.compares(key, op, value)
        return self.present(key) & ~self.equals(key, value)

    def contains(self, key: str, part: str) -> Column:
        """Whether a string property holds a substring, in either case; no character of it is special."""
        return F.coalesce(F.lower(self.field(key, "string")).contains(part.lower()), F.lit(False))

    def sort_key(self, key: str) -> tuple[Column, Column, Column]:
        """Three columns that order values by storage class: null, numbers (dates and bools too), text."""
        numbers = [self.number(key)]
        if "bool" in self.tags(key):
            numbers.append(self.field(key, "bool").cast("int").cast("double"))
        if "date" in self.tags(key):
            numbers.append(F.unix_micros(self.field(key, "date")).cast("double") / 1000)
        number = F.coalesce(*numbers)
        text = self.field(key, "string")
        rank = F.when(number.isNotNull(), 1).when(text.isNotNull(), 2)
        return rank, number, text


def prop_null() -> Column:
    from ..types import PROP

    return F.lit(None).cast(PROP)
