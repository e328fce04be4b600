"""The stages of a query, and the choice between its two meanings.

A query is a tuple of stages. If it consists of a label, scan or edge source followed only by comparisons, substring
filters, sorts and limits, it is *declarative*: all filters apply first, then the last sort, then the last limit.
Otherwise it is *sequential*: every stage applies to the result of the one before. The two differ in what ``!=`` says
about values of another type, in where missing values sort, and in repeated sorts and limits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Source:
    """kind: label, id, scan, type, from or to."""

    kind: str
    value: str | None = None


@dataclass(frozen=True)
class Where:
    """A predicate outside the declarative set: equals, gt, lt, in or a function of the row's properties."""

    kind: str
    key: str | None = None
    value: Any = None
    function: Callable | None = None


@dataclass(frozen=True)
class Compare:
    key: str
    op: str
    value: Any


@dataclass(frozen=True)
class Contains:
    key: str
    part: str


@dataclass(frozen=True)
class Sorted:
    key: str
    ascending: bool


@dataclass(frozen=True)
class Limit:
    count: int
    offset: int


@dataclass(frozen=True)
class Traverse:
    direction: str
    edge: str | None
    max_depth: int | None


Stage = Source | Where | Compare | Contains | Sorted | Limit | Traverse


def is_declarative(stages: tuple[Stage, ...]) -> bool:
    """Whether the query as a whole is declarative. A single-id source never is."""
    return stages[0].kind != "id" and all(isinstance(s, (Compare, Contains, Sorted, Limit)) for s in stages[1:])


def aggregates_in_place(stages: tuple[Stage, ...]) -> bool:
    """Whether sums and averages apply to the source and filters alone, skipping rows without the property."""
    return stages[0].kind != "id" and all(isinstance(s, (Compare, Contains)) for s in stages[1:])


def order_is_visible(stages: tuple[Stage, ...], at: int) -> bool:
    """Whether a later limit sees the order that the traversal at this place discovers nodes in."""
    for s in stages[at + 1 :]:
        if isinstance(s, Limit):
            return True
        if isinstance(s, (Sorted, Traverse)):
            return isinstance(s, Traverse) and order_is_visible(stages, stages.index(s, at + 1))
    return False
