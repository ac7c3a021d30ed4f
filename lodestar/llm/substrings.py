"""Removal of repeated runs of words by FM-indexes (operator 12).

A window is WINDOW consecutive words of a document; its words are removed where the window also starts
in a document of smaller id. Every window holds an anchor, its GRAM words of least hash, so equal
windows hold equal anchors at equal places. (1) The scan lists the anchors' hashes of every document;
(2) those that several rows have are kept, no other window can repeat; (3) documents, dealt into
batches, cut the windows of kept anchors into contexts, the words around an anchor, which go to the
anchor's shard: so a shard holds all that its windows can be equal to, and no document meets other
shards. (4) A shard builds a compressed FM-index of its distinct contexts and streams contexts
through it backward: matching statistics tell where WINDOW words match, and the range of suffixes
which do has a least id; (5) the verdicts return to the batches.

Hashes only say where to look: words are numbers that differ where their bytes do, and windows are
equal where the index says so. An anchor of FREQUENT rows has too many different contexts for one
shard: each of its windows goes to a shard by its own hash, and first to one within a group of
batches, which sends on only the rows of the group's least id."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, text_buffer, words_count
from lodestar.llm.fmindex import FMIndex
from lodestar.llm.lexicon import hashes, numbers, slices
from lodestar.llm.shingles import _IS_WORD, bounds, mixed

WINDOW, GRAM = 13, 7
#: Bytes of text in a batch, on average. A shard gets the contexts of as many bytes as SHARD batches have, a list the anchors of LIST.
BATCH_BYTES, SHARD, LIST = 4 << 20, 2, 8
#: An anchor that this many rows have is frequent.
FREQUENT = 256
#: Batches that make a group, at least.
GROUP = 64
#: Windows that are looked at at once.
STRETCH = 1 << 18
_FLAG = np.uint32(1 << 31)
_LISTED = pa.schema([("shard", pa.int64()), ("hashes", pa.binary()), ("batches", pa.binary())])
_KEPT = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary())])
#: level 0: verdicts for the batch that is the number; 1: contexts of a shard; 2: those of a group's shard, `to` is their shard.
_CONTEXTS = pa.schema([("level", pa.int64()), ("number", pa.int64()), *((n, pa.binary()) for n in ("texts", "of", "id", "batch", "row", "start", "many", "to"))])
_FIELDS = (("of", "<i4"), ("id", "<i8"), ("batch", "<i8"), ("row", "<i4"), ("start", "<i4"), ("many", "u1"), ("to", "<i8"))
_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _parts(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number and the places that have it."""
    if len(number):
        order = np.argsort(number, kind="stable")
        heads = np.flatnonzero(np.diff(number[order], prepend=number[order[0]] - 1))
        for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
            yield int(number[order[a]]), order[a:b]


def _joined(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = max(0, len(hashed) - width + 1)
    out = hashed[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashed[k : k + n]
    return mixed(out)


def anchors(hashed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each anchor, and its hash, from the words' hashes and documents."""
    n = len(hashed) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, wide = _joined(hashed, GRAM), WINDOW - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = (np.minimum(least[:n], least[wide - width : wide - width + n]) & low).astype(np.int64)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = at[starts]
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[starts[1:]] != doc[starts[:-1]]))))
    return starts[head], starts[np.append(head[1:], len(starts)) - 1], grams[at[head]]


class Words:
    """The words of a text column: start, end and document of each, and offsets per document."""

    def __init__(self, texts: pa.Array):
        self.raw, offsets = text_buffer(texts)
        self.start, self.end = bounds(_IS_WORD[self.raw], offsets) if len(self.raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.offsets = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Ranges of words with STRETCH windows each; every window is whole in just one."""
        for a in range(0, max(0, len(self.start) - WINDOW + 1), STRETCH):
            yield a, min(len(self.start), a + STRETCH + WINDOW - 1)


def short(hashed: np.ndarray) -> np.ndarray:
    """The bits of hashes that lists hold: 31, so one of some thousands is taken for another's, which only adds contexts to look at."""
    return (hashed >> np.uint64(33)).astype(np.uint32)


def _list(lists: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(1) rows (batch, text) to (shard, hashes, batches): each row's distinct anchors and its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for a in range(0, len(batch), 512):
                words = Words(batch.column(1).slice(a, 512))
                found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for x, y in words.stretches():
                    first, _, hashed = anchors(hashes(words.raw, words.start[x:y], words.end[x:y]), words.doc[x:y])
                    found.append(hashed)
                    rows.append(words.doc[x + first])
                hashed, row = np.concatenate(found), np.concatenate(rows)
                order = np.lexsort((hashed, row))
                hashed, row = hashed[order], row[order]
                new = np.ones(len(hashed), bool)
                new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
                hashed, owner = hashed[new], number[a + row[new]].astype(np.uint32)
                out = [(s, short(hashed[i]).tobytes(), owner[i].tobytes()) for s, i in _parts((hashed % np.uint64(lists)).astype(np.int64))]
                yield pa.RecordBatch.from_pylist([dict(zip(_LISTED.names, r, strict=True)) for r in out], _LISTED)

    return run


def _blob(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(text_buffer(column)[0].tobytes(), kind)


def _keep(table: pa.Table) -> pa.Table:
    """(2) a shard's lists to (batch, shard, hashes): anchors that several rows have, flagged if frequent."""
    hashed, batch = _blob(table.column("hashes"), "<u4"), _blob(table.column("batches"), "<u4")
    order = np.argsort(hashed, kind="stable")
    hashed, batch = hashed[order], batch[order]
    head = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1]))) if len(hashed) else np.zeros(0, np.int64)
    count = np.repeat(np.diff(np.append(head, len(hashed))), np.diff(np.append(head, len(hashed))))
    kept = np.flatnonzero(count > 1)
    hashed, batch = hashed[kept] | (count[kept] >= FREQUENT) * _FLAG, batch[kept].astype(np.int64)
    shard = table.column("shard")[0].as_py()
    return pa.Table.from_pylist([{"batch": b, "shard": shard, "hashes": np.unique(hashed[i]).tobytes()} for b, i in _parts(batch)], _KEPT)


def _sorted(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """ids and texts of a batch in the order of both, the same whenever it is read."""
    ids, texts = table.column("id").to_numpy(), table.column("text").combine_chunks()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        strings = texts.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], strings[i])), np.int64)
    return ids[order], texts.take(pa.array(order))


def _rows(level: int, number: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, fields: dict[str, np.ndarray]) -> Iterator[dict]:
    """A row for each number with its distinct contexts raw[start:end], each followed by a line feed, and their places."""
    if not len(start):
        return
    same, first = numbers(raw, start, end)
    for n, i in _parts(number):
        one, of = np.unique(same[i], return_inverse=True)
        text = slices(raw, start[first[one]], end[first[one]] + 1)
        text[0][text[1][1:] - 1] = 10
        held = {"of": of, **{name: value[i] for name, value in fields.items()}}
        yield {"level": level, "number": n, "texts": text[0].tobytes(), **{name: held[name].astype(kind).tobytes() for name, kind in _FIELDS if name in held}}


def _cut(shards: int, lists: int, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(3) a batch and its kept anchors to contexts by shard."""
    coarse = max(1, shards // groups)

    def run(table: pa.Table, kept: pa.Table) -> pa.Table:
        if not len(table) or not len(kept):
            return _CONTEXTS.empty_table()
        batch = table.column("batch")[0].as_py()
        marked = _blob(kept.column("hashes"), "<u4")
        sizes = np.diff(text_buffer(kept.column("hashes"))[1]) // 4
        known = np.repeat(kept.column("shard").to_numpy(), sizes).astype(np.uint64) << np.uint64(32) | (marked & ~_FLAG)
        order = np.argsort(known)
        known, frequent = known[order], marked[order] >= _FLAG
        ids, texts = _sorted(table)
        words, rows = Words(texts), []
        for x, y in words.stretches():
            start, end, doc = words.start[x:y], words.end[x:y], words.doc[x:y]
            own = hashes(words.raw, start, end)
            first, last, hashed = anchors(own, doc)
            asked = (hashed % np.uint64(lists)) << np.uint64(32) | short(hashed)
            slot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            have = known[slot] == asked
            if not have.any():
                continue
            # the stretch's words with one space after each
            line, at = slices(words.raw, start, end + 1) if end[-1] < len(words.raw) else slices(np.append(words.raw, np.uint8(32)), start, end + 1)
            line[at[1:] - 1] = 32
            often = have & frequent[slot]
            for level, which in ((1, have & ~often), (2, often)):
                a, b, anchor = first[which], last[which], hashed[which]
                if not len(a):
                    continue
                if level == 2:  # every window for itself
                    many = b - a + 1
                    upto = np.cumsum(many)
                    a = np.repeat(a - (upto - many), many) + np.arange(upto[-1])
                    b, anchor = a, _joined(own, WINDOW)[a]
                to = (mixed(anchor) % np.uint64(shards)).astype(np.int64)
                number = to if level == 1 else (batch % groups) * coarse + to % coarse
                row = doc[a]
                fields = {"id": ids[row], "batch": np.full(len(a), batch), "row": row, "start": a + x - words.offsets[row], "many": b - a + 1, "to": to}
                rows += _rows(level, number, line, at[a], at[b + WINDOW] - 1, fields)
        return pa.Table.from_pylist(rows, _CONTEXTS)

    return run


def least_ids(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4) of distinct contexts, the documents of `words`, with their least ids: for each of their windows the
    least id of all contexts that hold the window, one context's windows after the other's, and their offsets."""
    symbol, first = numbers(words.raw, words.start, words.end)
    length = np.diff(words.offsets)
    # the index's text: contexts with symbol 0 after each
    text = np.zeros(len(symbol) + len(length), np.int64)
    place = np.arange(len(symbol)) + words.doc
    text[place] = symbol + 1
    values = np.repeat(ids, length + 1)
    index = FMIndex(text, len(first) + 1, WINDOW, values)
    match, low, _ = index.matching(text, words.offsets[:-1] + np.arange(len(length)), length)
    # a context of m words has m - WINDOW + 1 windows, all of which the index holds
    windows = np.flatnonzero(match == WINDOW)
    return index.least[index.classes(low[windows])], np.searchsorted(windows, words.offsets)


def _verdicts(batch: np.ndarray, row: np.ndarray, start: np.ndarray, bits: np.ndarray) -> Iterator[dict]:
    for b, i in _parts(batch):
        held = {"row": row[i], "start": start[i], "many": bits[i]}
        yield {"level": 0, "number": b, **{name: held[name].astype(kind).tobytes() for name, kind in _FIELDS if name in held}}


def _settle(table: pa.Table) -> pa.Table:
    """(4) the contexts of one level and number to verdicts by batch; verdicts stay as they are.

    Within a group (level 2) windows of a greater id than the group's least are settled, the others go on to their shard."""
    level = table.column("level")[0].as_py()
    if not level:
        return table
    fields = {name: _blob(table.column(name), kind) for name, kind in _FIELDS}
    raw, at = text_buffer(table.column("texts"))
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    # contexts are numbered within their row; a row's first is as many on as there were before
    before = np.searchsorted(ends, at[:-1])
    of = fields["of"].astype(np.int64) + np.repeat(before, np.diff(text_buffer(table.column("of"))[1]) // 4)
    same, first = numbers(raw, begins, ends)
    context = same[of]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, context, fields["id"])
    chosen, offsets = slices(raw, begins[first], ends[first] + 1)
    words = Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chosen))]))
    found, windows = least_ids(words, least)
    many = fields["many"].astype(np.int64)
    upto = np.cumsum(many)
    shift = np.arange(upto[-1]) - np.repeat(upto - many, many)
    smaller = found[np.repeat(windows[context], many) + shift] < np.repeat(fields["id"], many)
    bits = np.bitwise_or.reduceat(smaller.astype(np.uint8) << shift.astype(np.uint8), upto - many)
    gone = np.flatnonzero(bits)
    rows = list(_verdicts(fields["batch"][gone], fields["row"][gone], fields["start"][gone], bits[gone]))
    if level == 2:
        left = np.flatnonzero(bits == 0)
        left = left[np.argsort(begins[first[context[left]]], kind="stable")]
        own = first[context[left]]
        rows += _rows(1, fields["to"][left], raw, begins[own], ends[own], {name: fields[name][left] for name in ("id", "batch", "row", "start", "many", "to")})
    return pa.Table.from_pylist(rows, _CONTEXTS)


def covered(table: pa.Table, verdicts: pa.Table) -> tuple[np.ndarray, Words, np.ndarray]:
    """ids and words of a batch, and which words go."""
    ids, texts = _sorted(table)
    words = Words(texts)
    edge = np.zeros(len(words.start) + WINDOW + 1, np.int32)
    if len(verdicts):
        row, start, bits = (_blob(verdicts.column(n), k) for n, k in (("row", "<i4"), ("start", "<i4"), ("many", "u1")))
        for k in range(8):
            on = np.flatnonzero(bits >> k & 1)
            at = words.offsets[row[on]] + start[on] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
    return ids, words, np.cumsum(edge)[: len(words.start)] > 0


def _remove(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    """(5) a batch and its verdicts to doc_id, n_words, n_removed, kept_sha256."""
    if not len(table):
        return _REMOVED.empty_table()
    ids, texts = _kept(table, verdicts)
    rows = [(i, n, removed, hashlib.sha256(kept).hexdigest()) for i, (n, removed, kept) in zip(ids, texts, strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REMOVED.types, strict=True)], schema=_REMOVED)


def _kept(table: pa.Table, verdicts: pa.Table) -> tuple[list[int], Iterator[tuple[int, int, bytes]]]:
    """ids of a batch and, of each, its number of words, how many go, and those that stay, joined by a space."""
    ids, words, gone = covered(table, verdicts)

    def each() -> Iterator[tuple[int, int, bytes]]:
        for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
            stay = a + np.flatnonzero(~gone[a:b])
            kept = b""
            if len(stay):
                low, high = words.start[stay[0]], words.end[stay[-1]]
                line, at = slices(np.append(words.raw[low:high], np.uint8(32)), words.start[stay] - low, words.end[stay] - low + 1)
                line[at[1:] - 1] = 32
                kept = line[:-1].tobytes()
            yield b - a, b - a - len(stay), kept

    return ids.tolist(), each()


def _kept_texts(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string())])
    if not len(table):
        return schema.empty_table()
    ids, texts = _kept(table, verdicts)
    return pa.table([pa.array(ids, pa.int64()), pa.array([t[2].decode() for t in texts], pa.string())], schema=schema)


def _searched(docs: DataFrame, batch_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows decided without a search, searched rows by batch, verdicts by batch)."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    sizes = cut(rows.select("id", "digest", F.octet_length("text").cast("long").alias("size")))
    copies = sizes.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = broadcast_checked(cut(copies.select("digest", "first")), 400_000)
    marked = rows.join(copies, "digest", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    # WINDOW words have that many bytes and as many spaces less one
    searched = (F.octet_length("text") >= 2 * WINDOW - 1) & F.col("id").isNotNull() & ~F.col("copy")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count, lists, shards = (max(1, -(-total // (batch_bytes * k))) for k in (1, LIST, SHARD))
    batches = marked.filter(searched).select(F.pmod(F.xxhash64("id", "digest"), F.lit(count)).alias("batch"), "id", "text")
    listed = batches.select("batch", "text").mapInArrow(_list(lists), _sql(_LISTED))
    kept = listed.groupBy("shard").applyInArrow(_keep, _sql(_KEPT))
    groups = max(1, min(-(-count // GROUP), int(count**0.5)))
    contexts = batches.groupBy("batch").cogroup(kept.groupBy("batch")).applyInArrow(_cut(shards, lists, groups), _sql(_CONTEXTS))
    for _ in range(2):
        contexts = contexts.groupBy("level", "number").applyInArrow(_settle, _sql(_CONTEXTS))
    verdicts = contexts.select(F.col("number").alias("batch"), "row", "start", "many")
    return marked.filter(~searched).select("id", "text", "copy"), batches, verdicts


def repeated_windows(docs: DataFrame, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by a space) of every row.

    A text equal to that of a smaller id goes whole if it has WINDOW words. Null, empty and blank texts
    have no words; texts of fewer words than a window stay; rows of one id don't count as smaller than
    each other and equal ones have equal results; a row with a null id loses nothing and costs no
    other row anything; an empty table gives no rows; ids that aren't whole numbers raise ValueError.
    Other columns aren't read."""
    decided, batches, verdicts = _searched(docs, batch_bytes, id_col, text_col)
    n = words_count(F.col("text"))
    gone = F.col("copy") & (n >= WINDOW)
    joined = F.array_join(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    plain = decided.select(F.col("id").alias("doc_id"), n.alias("n_words"), F.when(gone, n).otherwise(F.lit(0)).alias("n_removed"), F.sha2(F.when(gone, F.lit("")).otherwise(joined), 256).alias("kept_sha256"))
    return plain.unionByName(batches.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(_remove, _sql(_REMOVED)))


def without_windows(docs: DataFrame, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the words that stay, joined by a space."""
    decided, batches, verdicts = _searched(docs, batch_bytes, id_col, text_col)
    gone = F.col("copy") & (words_count(F.col("text")) >= WINDOW)
    joined = F.array_join(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    plain = decided.select(F.col("id").alias("doc_id"), F.when(gone, F.lit("")).otherwise(joined).alias("kept"))
    return plain.unionByName(batches.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(_kept_texts, "doc_id long, kept string"))


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    """doc_id, words, removed words and the kept ones joined, by a table of all windows, for tests."""
    texts = [(i, "".join(" " if c in " \t\n\v\f\r" else c for c in t or "").split(" ")) for i, t in rows]
    texts = [(i, [w for w in t if w]) for i, t in texts]
    least: dict[tuple[str, ...], int] = {}
    for i, t in texts:
        for p in range(len(t) - WINDOW + 1 if i is not None else 0):
            least[tuple(t[p : p + WINDOW])] = min(least.get(tuple(t[p : p + WINDOW]), i), i)
    out = []
    for i, t in texts:
        gone = set()
        for p in range(len(t) - WINDOW + 1 if i is not None else 0):
            if least[tuple(t[p : p + WINDOW])] < i:
                gone |= set(range(p, p + WINDOW))
        out.append((i, len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone)))
    return out


#: DuckDB's form of repeated_windows(), for unique ids.
WINDOWS_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM t WHERE doc_id IS NOT NULL)),
m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT s.doc_id, s.i + unnest(range({WINDOW})) AS i FROM s JOIN m ON m.s = s.s AND m.least < s.doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN h ON h.doc_id = w.doc_id AND h.i = w.i GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
