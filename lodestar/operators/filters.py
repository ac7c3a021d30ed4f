"""Metadata filter policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import strip

Value = str | int | float | bool
# What users may filter by, and what the system always asks for.
USER_FIELDS = ("document_type", "language", "source_file", "status")


@dataclass(frozen=True)
class FilterPolicy:
    """User filters are checked by name; system filters win over them."""

    system: Mapping[str, Value] = field(default_factory=lambda: {"status": "published"})

    def apply(self, user: Mapping[str, Value] | None = None) -> dict[str, Value]:
        asked = dict(user or {})
        unknown = sorted(set(asked) - set(USER_FIELDS) - set(self.system))
        if unknown:
            raise ValueError(f"unsupported metadata filters: {', '.join(unknown)}")
        return asked | dict(self.system)


def matches(filters: Mapping[str, Value]) -> Column:
    """All fields equal; a null field matches nothing."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()), F.lit(True))


def query_matches(fields: Sequence[str], prefix: str = "filter_") -> Column:
    """For a join of queries and chunks: each non-null filter column of the query equals the chunk's field."""
    return reduce(lambda a, b: a & b, (F.col(prefix + f).isNull() | (F.col(prefix + f) == F.col(f)) for f in fields), F.lit(True))


def askable(queries, column: str = "query"):
    """Queries that aren't blank: more than white space of any kind."""
    return queries.filter(strip(F.col(column)) != "")


def positive(**limits: float) -> None:
    """Raises ValueError unless all limits are above zero."""
    for name, value in limits.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")
