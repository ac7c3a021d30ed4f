"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.operators.filters import positive

DIGITS = 9
#: Queries and vectors of a block; every block of the one meets every block of the other once.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
#: Vectors that are multiplied at once, and scores that are held at once.
VECTORS, SCORES = 2048, 1 << 21


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    matrix = np.array(vectors, np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]


def _permitted(filters: list[pa.Array], fields: list[pa.Array], shape: tuple[int, int]) -> np.ndarray:
    """query_matches() of every chunk (row) and query (column)."""
    out = np.ones(shape, bool)
    for wanted, own in zip(filters, fields, strict=True):
        asked = np.array(wanted.to_pylist(), object)
        out &= (asked == None)[None, :] | (np.array(own.to_pylist(), object)[:, None] == asked[None, :])  # noqa: E711
    return out


class _Best:
    """The best chunks of each query so far: more scores, ids last; what is beyond the limit goes as rows come in."""

    def __init__(self, queries: int, limit: int):
        self.queries, self.limit = queries, limit
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, first: int, names: np.ndarray) -> None:
        """scores of chunks (rows) for the queries from number `first` on (columns)."""
        floor = -np.inf
        if len(scores) > self.limit:
            floor = np.partition(scores, len(scores) - self.limit, axis=0)[len(scores) - self.limit]
        row, column = np.nonzero((scores >= floor) & ~np.isneginf(scores))
        self.found.append((column + first, scores[row, column], names[row]))
        self.size += len(row)
        if self.size > max(1 << 16, 4 * self.queries * self.limit):
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, scores and ids of the best."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        query, score, name = (np.concatenate(x) for x in zip(*self.found, strict=True))
        _, place = np.unique(name, return_inverse=True)
        order = np.lexsort((place, -score, query))
        query, score, name = query[order], score[order], name[order]
        head = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
        keep = rank < self.limit
        self.found = [(query[keep], score[keep], name[keep])]
        self.size = int(keep.sum())
        return self.found[0]


def _block(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _product(limit: int, id_type: pa.DataType, query_type: pa.DataType, filters: Sequence[str], fields: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of vectors and a block of queries to each query's best of the block."""
    schema = pa.schema([("query_id", query_type), ("chunk_id", id_type), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        asked = _block(queries)
        ids, matrix = asked.column("query_id"), _unit(_rows(asked.column("vector")))
        best = _Best(len(matrix), limit)
        for a in range(0, len(vectors), VECTORS):
            batch = _block(vectors.slice(a, VECTORS))
            units, names = _unit(_rows(batch.column("vector"))), np.array(batch.column("chunk_id").to_pylist(), object)
            step = max(1, SCORES // len(batch))
            for first in range(0, len(matrix), step):
                scores = np.round(units @ matrix[first : first + step].T, DIGITS) + 0.0
                if filters:
                    scores[~_permitted([asked.column(f).slice(first, step) for f in filters], [batch.column(f) for f in fields], scores.shape)] = -np.inf
                best.add(scores, first, names)
        query, score, name = best.rows()
        return pa.Table.from_arrays([ids.take(pa.array(query)), pa.array(name.tolist(), id_type), pa.array(score)], schema=schema)

    return run


def nearest(queries: DataFrame, chunks: DataFrame, limit: int, id_col: str = "chunk_id", vector_col: str = "vector", fields: Sequence[str] = ()) -> DataFrame:
    """query_id, chunk_id, score, rank of each query's nearest chunks.

    Filters that all queries share belong before this: they prune the scan. Those of single queries
    are columns filter_* of queries for the fields, and hold before the ranking. Vectors and queries
    are dealt into blocks by a hash; a task multiplies a block of each and keeps its queries' best,
    which meet by query. Neither side reaches the driver, and vectors are copied for each further
    QUERY_BLOCK queries only."""
    positive(limit=limit)
    own = [f"filter_{f}" for f in fields]
    asked = queries.select("query_id", "vector", *own)
    vectors = chunks.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("vector"), *fields)
    across, down = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-vectors.select("chunk_id").count() // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = vectors.withColumn("__down", place("chunk_id", down)).withColumn("__across", every(across))
    right = asked.withColumn("__across", place("query_id", across)).withColumn("__down", every(down))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    product = _product(limit, to_arrow_type(schema["chunk_id"].dataType), to_arrow_type(schema["query_id"].dataType), own, fields)
    found = left.groupBy("__down", "__across").cogroup(right.groupBy("__down", "__across")).applyInArrow(product, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
