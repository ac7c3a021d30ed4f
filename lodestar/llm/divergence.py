"""Divergence between the sources of each language (operator 13).

A group is a (language, source); its vector holds its count of every kept term. Vectors are cut into
cells by blocks of terms, since a divergence is a sum over terms. Cells stay where they are dealt to
while compressed vectors of the other groups circulate: in the rounds of a round-robin tournament every
two groups of a language meet once in each block, one as host, the other as visitor, and both directions
are evaluated there. Terms are ranked by a heap in every cell and the heaps are merged."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, pieces, text_buffer
from lodestar.llm.lexicon import numbers, strings
from lodestar.llm.shingles import bounds

#: Documents that must have a term, and terms that a group reports.
MIN_DOCS, TOP = 3, 200
SCALE = 10**9
#: Terms in a block, on average; an index within a block has to fit 32 bits.
BLOCK = 1 << 14
#: Rounds whose visitors are on their way at once.
WAVE = 8
#: Bytes of text whose terms are counted at once.
PIECE = 6 << 20
#: Rows of a side, once counted, up to which a join broadcasts it.
SMALL = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def _counted(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a piece with their group, count and number of documents."""
    raw = _LOWER[raw]
    start, end = bounds(_IS_TERM[raw], offsets)
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    number, first = numbers(raw, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    pair, count = np.unique(doc * len(first) + number, return_counts=True)
    doc, number = np.divmod(pair, len(first))
    key, which = np.unique(group[doc] * len(first) + number, return_inverse=True)
    own, term = np.divmod(key, len(first))
    return strings(raw, start[first[term]], end[first[term]]), own, np.bincount(which, count).astype(np.int64), np.bincount(which)


def _long(raw: np.ndarray, group: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one document of any length: stretches end where no term does, and count together."""
    parts, a = [], 0
    while a < len(raw):
        b = a + PIECE
        while b < len(raw) and _IS_TERM[raw[b]] and _IS_TERM[raw[b - 1]]:
            b += 1
        b = min(b, len(raw))
        term, _, count, _ = _counted(raw[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
        parts.append(pa.table({"term": term, "n": count}))
        a = b
    merged = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    count = merged.column("n_sum").to_numpy()
    return merged.column("term").combine_chunks(), np.full(len(count), group), count, np.ones(len(count), np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, n, docs), and a row without a term for each group."""
    for batch in batches:
        names, codes = [], np.zeros(len(batch), np.int64)
        seen: dict[tuple[str, str], int] = {}
        for i, name in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if name not in seen:
                seen[name] = len(names)
                names.append(name)
            codes[i] = seen[name]
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        zeros = np.zeros(len(names), np.int64)
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), pa.array(zeros), pa.array(zeros)], names=["lang", "source", "term", "n", "docs"])
        raw, offsets = text_buffer(batch.column(2))
        for a, b in pieces(offsets, PIECE):
            own = raw[offsets[a] : offsets[b]]
            if len(own) > PIECE:
                term, group, count, docs = _long(own, int(codes[a]))
            else:
                term, group, count, docs = _counted(own, offsets[a : b + 1] - offsets[a], codes[a:b])
            at = pa.array(group, pa.int64())
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), term, pa.array(count, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers, none negative, of one length: each in its least width, deflated."""
    widths = [next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w) for x in arrays]
    return bytes([len(widths), *widths]) + zlib.compress(b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(arrays, widths, strict=True)), 1)


def unpacked(data: bytes | None, count: int) -> list[np.ndarray]:
    """What was packed, as int64; null is `count` empty arrays."""
    if data is None:
        return [np.zeros(0, np.int64) for _ in range(count)]
    widths, body = data[1 : 1 + data[0]], zlib.decompress(data[1 + data[0] :])
    n, at, out = len(body) // sum(widths), 0, []
    for w in widths:
        out.append(np.frombuffer(body, f"<u{w}", n, at).astype(np.int64))
        at += n * w
    return out


def vector(term: np.ndarray, count: np.ndarray) -> bytes:
    """A sparse vector: ascending terms, as steps, and their counts."""
    return packed([np.diff(term, prepend=0), count])


def entries(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts of a vector; null is empty."""
    step, count = unpacked(data, 2)
    return np.cumsum(step), count


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: by three steps of a thousand, none of which overflows."""
    whole, rest = np.divmod(count + 1, total + terms)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total + terms)
        whole = whole * 1000 + digit
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def meeting(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], one_total: int, other_total: int, terms: int, block_terms: int) -> tuple[int, int]:
    """The sums of gaps() of two groups over a block's terms, in both directions."""
    if not terms:
        return 0, 0
    both = np.union1d(one[0], other[0])
    p = []
    for (at, count), total in ((one, one_total), (other, other_total)):
        dense = np.zeros(len(both) + 1, np.int64)  # the last place stands for the terms that neither has
        dense[np.searchsorted(both, at)] = count
        p.append(shares(dense, total, terms))
    rest = block_terms - len(both)
    there, back = gaps(p[0], p[1]), gaps(p[1], p[0])
    return int(there[:-1].sum()) + rest * int(there[-1]), int(back[:-1].sum()) + rest * int(back[-1])


def _pack(table: pa.Table) -> pa.Table:
    """A cell's rows (lang, block, source, at, n, total) as one."""
    at, n, total = (table.column(c).to_numpy() for c in ("at", "n", "total"))
    order = np.argsort(at)
    values = [[table.column(c)[0].as_py()] for c in ("lang", "block", "source")]
    return pa.table([*values, [int(n.sum())], [vector(at[order], n[order])], [packed([total[order]])]], schema=_CELLS)


_CELLS = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("sum", pa.int64()), ("vector", pa.binary()), ("totals", pa.binary())])
_VALUES = pa.schema([("lang", pa.string()), ("one", pa.int64()), ("other", pa.int64()), ("value", pa.int64())])


def _heaps(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells to (lang, source, block, at, value): the `top` terms that a group has more of than its language, by value and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (at, n), (total,) = entries(row["vector"]), unpacked(row["totals"], 1)
                if not len(at):
                    continue
                p, q = shares(n, row["n"], row["terms"]), shares(total, row["lang_n"], row["terms"])
                value = gaps(p, q)
                more = np.flatnonzero(p > q)
                best = more[np.lexsort((at[more], -value[more]))[:top]]
                m = len(best)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * m, pa.string()), pa.array([row["source"]] * m, pa.string()), pa.array([row["block"]] * m, pa.int64()), pa.array(at[best]), pa.array(value[best])], names=["lang", "source", "block", "at", "value"])

    return run


def _meet(host: pa.Table, visitors: pa.Table) -> pa.Table:
    """A cell and those that visit it to the block's share of the divergences, in both directions."""
    if not len(host) or not len(visitors):
        return _VALUES.empty_table()
    here = {c: host.column(c)[0].as_py() for c in ("lang", "number", "n", "terms", "block_terms", "vector")}
    own, rows = entries(here["vector"]), []
    for k in range(len(visitors)):
        guest, total, data = (visitors.column(c)[k].as_py() for c in ("number", "n", "vector"))
        there, back = meeting(own, entries(data), here["n"], total, here["terms"], here["block_terms"])
        rows += [(here["lang"], here["number"], guest, there), (here["lang"], guest, here["number"], back)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _VALUES.types, strict=True)], schema=_VALUES)


def visits(cells: DataFrame, first: int, wave: int) -> DataFrame:
    """The cells that are on their way in rounds first to first + wave - 1, with their host's number.

    By the circle method: of an even number of players the last stays and the others turn, so that i
    and j meet in round (i + j) modulo (players - 1). Of two the lesser is host if their sum is even."""
    players = F.col("groups") + F.col("groups") % 2
    turning, me = players - 1, F.col("number")
    rounds = F.least(F.lit(first + wave), turning)
    on = cells.filter(F.lit(first) < turning).withColumn("round", F.explode(F.sequence(F.lit(first).cast("long"), rounds - 1)))
    met = F.pmod(F.col("round") - me, turning)
    opponent = F.when(me == turning, F.pmod(F.col("round") * (players / 2).cast("long"), turning)).otherwise(F.when(met == me, turning).otherwise(met))
    met_at = on.withColumn("host", opponent).filter(F.col("host") < F.col("groups"))
    visiting = ((me + F.col("host")) % 2 == 0) == (F.col("host") < me)
    return met_at.filter(visiting).select("lang", "block", "host", "number", "n", "vector")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: each group's divergence from every other source of its
    language (part pair), and the terms by which it differs most from its language (part term).

    Null language, source and text count as ''. A group without kept terms (without any text) has pairs but no
    terms; a language without kept terms has pairs of value 0; a language of one source has no pairs;
    repeated rows are documents of their own; an empty table gives no rows. Other columns aren't read.
    Counts are summed per task before they are shuffled by (language, source, term); cells, once packed,
    are checkpointed, and what circulates is what WAVE rounds need at a time."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    held = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = held.filter("term is not null")
    known = cut(words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"))
    langs = held.groupBy("lang").agg(F.count(F.when(F.col("term").isNull(), 1)).alias("groups")).join(known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n")), "lang", "left").na.fill(0)
    langs = broadcast_checked(cut(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block))).withColumn("blocks", F.col("blocks").cast("long"))), SMALL)
    dealt = known.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    terms = cut(dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long") - 1))
    rows = words.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).select("lang", "block", "source", "at", "n", "total")
    vectors = cut(rows.groupBy("lang", "block", "source").applyInArrow(_pack, "lang string, block long, source string, sum long, vector binary, totals binary"))

    groups = held.filter("term is null").select("lang", "source").join(vectors.groupBy("lang", "source").agg(F.sum("sum").alias("n")), ["lang", "source"], "left").na.fill(0)
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).join(langs, "lang")
    groups = cut(groups)
    sizes = cut(terms.groupBy("lang", "block").agg(F.count("*").alias("block_terms")))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    every = every.join(broadcast_checked(sizes, SMALL), ["lang", "block"], "left").na.fill(0, ["block_terms"])
    cells = cut(every.join(vectors.drop("sum"), ["lang", "block", "source"], "left"))

    heaps = cells.select("lang", "source", "block", "n", "terms", "lang_n", "vector", "totals").mapInArrow(_heaps(top), "lang string, source string, block long, at long, value long")
    named = heaps.join(terms.select("lang", "block", "at", "term"), ["lang", "block", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    # cells stay in the partitions of their key; only visitors are shuffled
    resident = cells.select("lang", "block", F.col("number").alias("host"), "number", "n", "terms", "block_terms", "vector").repartition("lang", "block", "host").persist()
    most, first, values = groups.agg(F.coalesce(F.max("groups"), F.lit(0))).first()[0], 0, None
    while first < most + most % 2 - 1:
        guests = visits(cells, first, WAVE).groupBy("lang", "block", "host")
        met = cut(resident.groupBy("lang", "block", "host").cogroup(guests).applyInArrow(_meet, "lang string, one long, other long, value long").groupBy("lang", "one", "other").agg(F.sum("value").alias("value")))
        values = met if values is None else values.unionByName(met)
        first += WAVE
    resident.unpersist()
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best).cast("int"))
    out = ranked(named).filter(F.col("rank") <= top)
    if values is not None:
        name = lambda number, source: broadcast_checked(groups.select("lang", F.col("number").alias(number), F.col("source").alias(source)), SMALL)
        pairs = values.join(name("one", "source"), ["lang", "one"]).join(name("other", "item"), ["lang", "other"])
        out = out.unionByName(ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")))
    return out


#: DuckDB's form of audit() with its default parameters.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM t JOIN v ON v.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE count > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
