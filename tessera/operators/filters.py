"""Metadata filters: a tree of conditions on a map column, compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Condition:
    """kind: eq, ne, contains, exists, not_exists, and, or."""

    kind: str
    key: str = ""
    value: str = ""
    parts: tuple = field(default=())

    def column(self, metadata: Column | str = "metadata") -> Column:
        """Never null: a missing key (or a null map) fails eq and contains, passes ne; an empty `and` or `or` is true."""
        m = F.col(metadata) if isinstance(metadata, str) else metadata
        got = F.element_at(m, F.lit(self.key))
        match self.kind:
            case "eq":
                return F.coalesce(got == self.value, F.lit(False))
            case "ne":
                return ~F.coalesce(got == self.value, F.lit(False))
            case "contains":
                return F.coalesce(F.contains(got, F.lit(self.value)), F.lit(False))
            case "exists":
                return F.coalesce(F.map_contains_key(m, self.key), F.lit(False))
            case "not_exists":
                return ~F.coalesce(F.map_contains_key(m, self.key), F.lit(False))
            case "and" | "or":
                return reduce(and_ if self.kind == "and" else or_, [p.column(metadata) for p in self.parts]) if self.parts else F.lit(True)
        raise ValueError(f"unknown condition {self.kind!r}")


def eq(key: str, value: str) -> Condition:
    return Condition("eq", key, value)


def ne(key: str, value: str) -> Condition:
    return Condition("ne", key, value)


def contains(key: str, value: str) -> Condition:
    return Condition("contains", key, value)


def exists(key: str) -> Condition:
    return Condition("exists", key)


def not_exists(key: str) -> Condition:
    return Condition("not_exists", key)


def all_of(*parts: Condition) -> Condition:
    return Condition("and", parts=parts)


def any_of(*parts: Condition) -> Condition:
    return Condition("or", parts=parts)


def matches_all(metadata: Column | str, wanted: Column | str) -> Column:
    """Whether metadata has every entry of the map `wanted`, row by row; an empty or null `wanted` fits all."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.forall(F.coalesce(F.map_entries(wanted), F.array()), lambda e: F.coalesce(F.element_at(m, e["key"]) == e["value"], F.lit(False)))
