"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7).

Items are partitioned by size into classes of powers of two. For a class of at most M shingles a
document is seen through windows of 2 * M shingles, M apart, so that an item's passage lies wholly
in one of them and its similarity to that window is bounded below however long the document is. A
window that shares any of its minima with an item of its class makes a candidate, and a candidate
counts if the whole document contains enough of the item's shingles. The class of the smallest items
has windows of one shingle, whose minimum is the shingle itself: for these the search is exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, pieces, small_batches, text_buffer, unused
from lodestar.llm.shingles import permutations, shingles

#: The least window similarity of an item at 0.8 is 0.19; all of 64 minima miss with a chance of 1e-6.
PERMUTATIONS = 64
#: Shingles in a block; classes double from here.
BLOCK = 16
#: Items of fewer shingles than this are in the class of the smallest.
SMALL = 9
#: Items held by every task at once; more are searched in further passes over the documents.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20
PIECE = 1 << 19
#: A filter has some FILTER_SLOTS for each entry, and no more than 2**FILTER_BITS.
FILTER_SLOTS, FILTER_BITS = 64, 20


def _slots(entries: int) -> int:
    """Slots of a filter for so many entries, a power of two."""
    return 1 << min(FILTER_BITS, max(10, (FILTER_SLOTS * entries).bit_length()))


class ItemIndex:
    """The items of one pass: shingle sets, and sorted minima by size class."""

    def __init__(self, ids: list, texts: list[str | None], width: int, percent: int, id_type: pa.DataType | None = None):
        raw, offsets = text_buffer(pa.array(texts, pa.string()))
        hashes, at = shingles(raw, offsets, width)
        self.ids, self.width, self.percent, self.id_type = ids, width, percent, id_type
        self.sets = [np.unique(hashes[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        a, b = permutations(PERMUTATIONS, 11)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[int]] = {}
        small = [i for i, s in enumerate(self.sets) if 0 < len(s) < SMALL]
        whole = np.concatenate([self.sets[i] for i in small]) if small else hashes[:0]
        order = np.argsort(whole, kind="stable")
        self.small = (whole[order], np.repeat(np.array(small, int), [len(self.sets[i]) for i in small])[order])
        self.small_seen = np.zeros(_slots(len(whole)), bool)
        self.small_seen[whole & np.uint64(len(self.small_seen) - 1)] = True
        for i, s in enumerate(self.sets):
            if len(s) >= SMALL:
                by_class.setdefault(max(0, (len(s) - 1).bit_length() - BLOCK.bit_length() + 1), []).append(i)
        for level, items in by_class.items():
            keys = np.stack([(((self.sets[i] >> np.uint64(32)).astype(np.uint32)[:, None] * a + b).min(axis=0)) for i in items])
            flat = keys.astype(np.uint64) << np.uint64(8) | np.arange(PERMUTATIONS, dtype=np.uint64)
            order = np.argsort(flat, axis=None, kind="stable")
            seen = np.zeros((PERMUTATIONS, _slots(len(items))), bool)
            seen[np.arange(PERMUTATIONS), keys & np.uint32(seen.shape[1] - 1)] = True
            self.classes[level] = (flat.reshape(-1)[order], np.repeat(np.array(items), PERMUTATIONS)[order], np.packbits(seen, axis=1, bitorder="little"))

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, item's shingles, common shingles) that pass."""
        hashes, at = shingles(raw, offsets, self.width)
        n = np.diff(at)
        if not len(hashes):
            return []
        a, b = permutations(PERMUTATIONS, 11)
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        per_doc = -(-n // BLOCK)
        first = np.concatenate(([0], np.cumsum(per_doc)))
        doc = np.repeat(np.arange(len(n)), per_doc)
        starts = at[:-1][doc] + (np.arange(first[-1]) - first[doc]) * BLOCK
        blocks = np.empty((PERMUTATIONS, len(starts)), np.uint32)
        for p in range(PERMUTATIONS):
            np.minimum.reduceat(low * a[p] + b[p], starts, out=blocks[p])
        found: set[int] = set()

        def candidates(docs: np.ndarray, keys: np.ndarray, known: np.ndarray, items: np.ndarray) -> None:
            """Adds (document, item) of every key that is known, as one number."""
            low = np.searchsorted(known, keys)
            many = np.searchsorted(known, keys, "right") - low
            some = np.flatnonzero(many)
            _, one = np.unique(docs[some] * len(known) + low[some], return_index=True)
            for d, a, n in zip(docs[some[one]].tolist(), low[some[one]].tolist(), many[some[one]].tolist(), strict=True):
                found.update((d * len(self.ids) + items[a : a + n]).tolist())

        hit = np.flatnonzero(self.small_seen[hashes & np.uint64(len(self.small_seen) - 1)]) if len(self.small[0]) else []
        if len(hit):
            candidates(np.searchsorted(at, hit, "right") - 1, hashes[hit], *self.small)
        for level, (keys, items, seen) in self.classes.items():
            step = 1 << level
            begin = np.flatnonzero((np.arange(first[-1]) - first[doc]) % step == 0)
            end = np.minimum(begin + 2 * step, first[doc[begin] + 1])
            cuts = np.stack([begin, end], axis=1).reshape(-1)
            for p in range(PERMUTATIONS):
                row = np.append(blocks[p], np.uint32(0xFFFFFFFF))
                window = np.minimum.reduceat(row, cuts)[::2]
                slot = window & np.uint32(8 * seen.shape[1] - 1)
                hit = np.flatnonzero(seen[p][slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & 1)
                if len(hit):
                    candidates(doc[begin[hit]], window[hit].astype(np.uint64) << np.uint64(8) | np.uint64(p), keys, items)
        out = []
        whole: dict[int, np.ndarray] = {}
        for d, i in (divmod(pair, len(self.ids)) for pair in sorted(found)):
            if d not in whole:
                whole = {d: np.unique(hashes[at[d] : at[d + 1]])}
            common = int(np.isin(self.sets[i], whole[d], assume_unique=True).sum())
            if 100 * common >= self.percent * len(self.sets[i]):
                out.append((d, i, len(self.sets[i]), common))
        return out


def _search(index: ItemIndex, item_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                hits = index.find(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if hits:
                    doc, item, size, common = (list(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([a + d for d in doc])),
                            pa.array([index.ids[i] for i in item], item_type),
                            pa.array(size, pa.int64()),
                            pa.array(common, pa.int64()),
                        ],
                        names=["doc_id", "item_id", "item_shingles", "common"],
                    )

    return run


def _indexes(items: DataFrame, width: int, percent: int) -> Iterator[ItemIndex]:
    """Indexes of (item, text), as many as their number and bytes ask for."""
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-rows // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toArrow()
        yield ItemIndex(part.column(0).to_pylist(), part.column(1).to_pylist(), width, percent, part.schema.field(0).type)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, item_shingles, common and containment for documents that hold a test item.

    A document holds an item if its text has at least percent of the item's distinct shingles.
    Null, empty and blank texts and items match nothing; an item of fewer words than the width is
    one shingle, found in documents of just these words; repeated rows are reported once each;
    null ids are reported as null; with either table empty there are no rows. Other columns aren't
    read. The items are measured first and searched in passes of bounded size, so what each task
    holds doesn't grow with the benchmark."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = dict(texts.dtypes)["id"], dict(items.dtypes)["item"]
    schema = f"doc_id {id_type}, item_id {item_type}, item_shingles long, common long"
    found = [texts.mapInArrow(_search(index, index.id_type), schema) for index in _indexes(items, width, percent)]
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("common") / F.col("item_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that hold no test item, with their columns, which may have any names. Rows are dropped by id, so those with a null id stay; without_items() judges each row."""
    (own,) = unused(docs, "hit")
    hit = cut(contaminated(docs, benchmark, width, percent, id_col, text_col).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(broadcast_checked(hit, 1_000_000), docs[id_col] == F.col(own), "left_anti")


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that hold no test item, with their columns; each is judged by its own text, whatever its id."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def without(index: ItemIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = text_buffer(batch.column(at))
                keep = np.ones(len(batch), bool)
                for a, b in pieces(offsets, PIECE):
                    keep[[a + d for d, *_ in index.find(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]] = False
                yield batch.filter(pa.array(keep))

        return run

    items = benchmark.select(F.col("item_id").alias("item"), F.col("text")).filter(F.col("text").isNotNull())
    for index in _indexes(items, width, percent):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs


#: DuckDB's form of contaminated() with its default parameters.
CONTAMINATED_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT kind, id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END)) AS g FROM w),
n AS (SELECT id, count(*)::BIGINT AS item_shingles FROM s WHERE kind = 1 GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS common FROM s i JOIN s d ON d.kind = 0 AND i.kind = 1 AND d.g = i.g GROUP BY 1, 2)
SELECT c.doc_id, c.item_id, n.item_shingles, c.common, c.common::DOUBLE / n.item_shingles AS containment
FROM c JOIN n ON n.id = c.item_id WHERE 100 * c.common >= 80 * n.item_shingles
"""
