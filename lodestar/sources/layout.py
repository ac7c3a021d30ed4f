"""Chunks laid out in folders by their metadata, so that filters choose folders before anything is read.

A field's folder is a hash of its value, so there are at most FOLDERS of them however many values a
field has; filters on the field itself stay and tell values of one folder apart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.filters import Value

#: Fields that chunks are laid out by, and folders of each.
FIELDS = ("status", "language")
FOLDERS = 32


def folder_column(field: str) -> str:
    return f"in_{field}"


def folder_of(value: Column) -> Column:
    """The folder of a value; null has one too."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(FOLDERS)).cast("int")


def laid_out(chunks: DataFrame, fields: Iterable[str] = FIELDS) -> DataFrame:
    """chunks with the folder of each field; a field that they lack counts as null."""
    return chunks.withColumns({folder_column(f): folder_of(F.col(f) if f in chunks.columns else F.lit(None)) for f in fields})


def _usable(chunks: DataFrame, fields: Iterable[str]) -> list[str]:
    """Those fields that chunks have folders for; values of other types than text are compared by other rules than a hash."""
    types = dict(chunks.dtypes)
    return [f for f in fields if types.get(folder_column(f)) == "int" and types.get(f) == "string"]


def in_folders(chunks: DataFrame, filters: Mapping[str, Value]) -> DataFrame:
    """chunks of the folders that filters (field to value) can be met in; all if there are no folders for the fields."""
    named = [f for f in _usable(chunks, filters) if isinstance(filters[f], str)]
    return chunks.filter(reduce(lambda a, b: a & b, (F.col(folder_column(f)) == folder_of(F.lit(filters[f])) for f in named), F.lit(True)))


def in_folders_of(chunks: DataFrame, queries: DataFrame, fields: Iterable[str]) -> DataFrame:
    """chunks of the folders that any query's own filters (columns filter_*, null for none) name; a query without a filter needs all.

    At most as many numbers as there are folders, and one, reach the driver for a field."""
    for f in _usable(chunks, fields):
        own = F.col(f"filter_{f}")
        asked = {r[0] for r in queries.select(F.when(own.isNotNull(), folder_of(own))).distinct().collect()}
        if None not in asked:
            chunks = chunks.filter(F.col(folder_column(f)).isin(sorted(asked)))
    return chunks


def write(chunks: DataFrame, path: str, fields: Iterable[str] = FIELDS) -> None:
    laid_out(chunks, fields).write.partitionBy(*map(folder_column, fields)).parquet(path)
