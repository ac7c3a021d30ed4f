"""Feature-hashing embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import CJK, LATIN_TOKEN, in_python

DIMENSIONS = 384
#: Tokens whose bins a task remembers, and texts that are laid out at once.
KNOWN, TEXTS = 1 << 19, 1024


class _Bins(dict):
    """Token to twice its bin, plus one if its sign is positive: bin by the first four bytes of its SHA-256, sign by the fifth byte's last bit."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        digest = hashlib.sha256(token.encode()).digest()
        self[token] = at = int.from_bytes(digest[:4], "big") % self.dimensions * 2 + (digest[4] & 1)
        return at


def _counter(dimensions: int) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """Lower-cased texts, TEXTS at a time, to their bins' sums (a row each)."""
    bins, tokens = _Bins(dimensions), in_python(f"{LATIN_TOKEN}|{CJK}")

    def run(texts: pa.Array) -> Iterator[np.ndarray]:
        for a in range(0, len(texts), TEXTS):
            own = texts.slice(a, TEXTS)
            out = np.zeros((len(own), dimensions))
            for row, text in zip(out, own, strict=True):
                at = np.fromiter(map(bins.__getitem__, tokens.findall(text.as_py() or "")), np.int64)
                if len(at):
                    row[:] = np.bincount(at >> 1, (at & 1) * 2.0 - 1.0, dimensions)
            yield out

    return run


def _summed(dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, places, values), equal ids side by side, to (id, idx, value) of each id's sums that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0)  # the id that the next batch may go on with, and its sums
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_pylist()
            new = np.fromiter((i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))), bool, len(ids))
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            lists = batch.column(1)
            at = np.repeat(group, np.diff(lists.offsets.to_numpy())) * dimensions + lists.flatten().to_numpy()
            keys, inverse = np.unique(at, return_inverse=True)
            sums = np.bincount(inverse, batch.column(2).flatten().to_numpy(), len(keys))
            if last is not None and last.column(0).to_pylist()[0] == ids[0]:
                own = keys < dimensions
                held[keys[own]] += sums[own]
                keys, sums = keys[~own], sums[~own]
                if group[-1] == 0:
                    continue
            if last is not None:
                yield _rows(last, np.flatnonzero(held), held[np.flatnonzero(held)], np.zeros(np.count_nonzero(held), np.int64))
            tail = keys >= group[-1] * dimensions
            last, held = batch.slice(int(heads[-1]), 1), np.zeros(dimensions)
            held[keys[tail] - group[-1] * dimensions] = sums[tail]
            keep = ~tail & (sums != 0)
            if keep.any():
                yield _rows(batch, keys[keep] % dimensions, sums[keep], heads[keys[keep] // dimensions])
        if last is not None:
            yield _rows(last, np.flatnonzero(held), held[np.flatnonzero(held)], np.zeros(np.count_nonzero(held), np.int64))

    return run


def _rows(batch: pa.RecordBatch, places: np.ndarray, values: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(places, pa.int32()), pa.array(values, pa.float64())], names=["id", "idx", "value"])


def embed_long(rows: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, idx, value): non-zero bins before scaling.

    A text's bins are summed where it is read, a few texts at a time. The bins, not the tokens, are dealt
    and sorted by id, so that the sums of rows that share an id meet in a stream: no task holds more than some texts."""
    kind = dict(rows.dtypes)[id_col]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(dimensions)
        for batch in batches:
            first = 0
            for sums in counts(batch.column(1)):
                row, place = np.nonzero(sums)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sums))))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((place, pa.int32()), (sums[row, place], pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sums)), *lists], names=["id", "places", "values"])
                first += len(sums)

    texts = rows.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    found = texts.mapInArrow(binned, f"id {kind}, places array<int>, values array<double>")
    met = found.repartition("id").sortWithinPartitions("id").mapInArrow(_summed(dimensions), f"id {kind}, idx int, value double")
    return met.withColumnRenamed("id", id_col)


def vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The text's vector: unit length, or zeros for a text without tokens."""

    @F.arrow_udf("array<double>")
    def laid_out(texts: pa.Array) -> pa.Array:
        parts = []
        for sums in _counter(dimensions)(texts):
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            flat = np.divide(sums, norm, out=sums, where=norm > 0).reshape(-1)
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dimensions), pa.int32()), pa.array(flat)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return laid_out(F.lower(text))


def embed(rows: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector) of every row, by its text alone."""
    return rows.select(F.col(id_col), vector(F.col(text_col), dimensions).alias("vector"))
