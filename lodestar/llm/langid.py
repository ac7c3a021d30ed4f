"""Language identification by prediction by partial matching over bytes (operator 5).

Each language has a context tree of order up to 4 with escape method C: in a context seen n times
with d distinct followers, a follower seen c times costs -log2(c / (n + d)) bits, any other byte
costs the escape -log2(d / (n + d)) and what it costs in the context one byte shorter; below order
0 every byte costs 8 bits. Statistics are frozen after training, so a byte's cost depends on it and
the four bytes before it alone, and whole texts of any length are scored by table look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, small_batches, text_buffer

ORDER = 4
#: Bounds of the training sample: whole texts, in order of a hash of their id, until a language has this many bytes,
#: or its even part of what all languages may have together.
TRAIN_BYTES, TRAIN_TOTAL = 400_000, 6_400_000
#: Languages whose costs share a table; a table has a column for each, so that one for all would grow with their square.
GROUP = 16
#: A text that costs more bits a byte than bytes drawn evenly is in no learned language.
MAX_BITS = 8.0
PIECE = 1 << 19
UNDETERMINED = "und"


class HashTable:
    """Rows of 64-bit keys, found by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        self.stored = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        home = self._home(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = (home[left] + self.probes) & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.slots[at[won]] = left[won]
            self.stored[at[won]] = keys[left[won]]
            keep = np.ones(len(left), bool)
            keep[won] = False
            left = left[keep]
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._home(keys)
        out = np.where(self.stored[at] == keys, self.slots[at], -1)
        left = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = (at[left] + probe) & ((1 << self.bits) - 1)
            same = self.stored[slot] == keys[left]
            out[left[same]] = self.slots[slot[same]]
            left = left[~same & (self.slots[slot] >= 0)]
        return out


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each after ORDER line feeds, and the offsets of these stretches."""
    n = len(offsets) - 1
    starts = offsets + ORDER * np.arange(n + 1)
    out = np.full(len(raw) + ORDER * n, 10, np.uint8)
    for i in range(n):
        out[starts[i] + ORDER : starts[i + 1]] = raw[offsets[i] : offsets[i + 1]]
    return out, starts


def grams(text: np.ndarray, order: int) -> np.ndarray:
    """For each place from ORDER on: the byte there and the `order` bytes before it, as a number."""
    n = len(text) - ORDER
    out = text[ORDER - order : ORDER - order + n].astype(np.uint64)
    for j in range(ORDER - order + 1, ORDER + 1):
        out <<= np.uint64(8)
        out |= text[j : j + n]
    return out


class Trees:
    """Frozen costs of a group of languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for name in self.languages:
            joined = np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts[name]), np.uint8)
            real = np.ones(max(0, len(joined) - ORDER), bool)
            at = 0
            for t in texts[name]:
                real[max(0, at - ORDER) : at] = False
                at += ORDER + len(t)
            seen.append([np.unique(grams(joined, k)[real], return_counts=True) if len(joined) > ORDER else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in range(ORDER + 1)])
        count = len(self.languages)
        self.gram_tables: list[HashTable] = []
        self.gram_costs: list[np.ndarray] = []
        self.context_tables: list[HashTable] = []
        self.escape_costs: list[np.ndarray] = []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([s[k][0] for s in seen])) if count else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            costs, escapes = np.zeros((len(keys), count), np.float32), np.zeros((len(contexts), count), np.float32)
            shorter = self.cost_rows(keys & np.uint64(256**k - 1), k - 1) if k else np.full((len(keys), count), 8.0)
            for i in range(count):
                own, c = seen[i][k]
                context, first = np.unique(own >> np.uint64(8), return_index=True)
                if not len(own):
                    costs[:, i] = shorter[:, i]
                    continue
                n, d = np.add.reduceat(c, first), np.diff(np.append(first, len(own)))
                at = np.searchsorted(contexts, context)
                escapes[at, i] = -np.log2(d / (n + d))
                costs[:, i] = shorter[:, i] + escapes[np.searchsorted(contexts, keys >> np.uint64(8)), i]
                costs[np.searchsorted(keys, own), i] = -np.log2(c / np.repeat(n + d, d))
            self.gram_tables.append(HashTable(keys))
            self.gram_costs.append(np.vstack([costs, np.zeros((1, count), np.float32)]))
            self.context_tables.append(HashTable(contexts))
            self.escape_costs.append(np.vstack([escapes, np.zeros((1, count), np.float32)]))

    def cost_rows(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits in every language of each gram of the order; the last row of a table is zero."""
        rows = self.gram_tables[order].rows(keys)
        out = self.gram_costs[order][rows]
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            short = keys[miss] & np.uint64(256**order - 1)
            lower = self.cost_rows(short, order - 1) if order else np.float32(8.0)
            out[miss] = self.escape_costs[order][self.context_tables[order].rows(keys[miss] >> np.uint64(8))] + lower
        return out

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        text, starts = padded(raw, offsets)
        if len(text) <= ORDER or not self.languages:
            return total
        for a in range(0, len(text) - ORDER, PIECE):
            costs = self.cost_rows(grams(text[a : a + PIECE + ORDER], ORDER), ORDER)
            # a text's places are starts[i] .. starts[i + 1] - ORDER, padding's stand between
            lo, hi = np.clip(starts[:-1], a, a + len(costs)) - a, np.clip(starts[1:] - ORDER, a, a + len(costs)) - a
            here = np.flatnonzero(hi > lo)
            if len(here):
                sums = np.vstack([costs, costs[:1]])
                total[here] += np.add.reduceat(sums, np.stack([lo[here], hi[here]], 1).reshape(-1), axis=0, dtype=np.float64)[::2]
        return total


class Model:
    """Frozen costs of any number of languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        groups = [self.languages[a : a + GROUP] for a in range(0, len(self.languages), GROUP)]
        self.trees = [Trees({name: texts[name] for name in names}) for names in groups]

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        return np.hstack([np.zeros((len(offsets) - 1, 0)), *(t.bits(raw, offsets) for t in self.trees)])

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of each text."""
        n = np.diff(offsets)
        if not self.languages:
            return [UNDETERMINED] * len(n), np.zeros(len(n)), np.full(len(n), MAX_BITS)
        bits = self.bits(raw, offsets)
        best = bits.argmin(axis=1)
        rate = bits.min(axis=1) / np.maximum(n, 1)
        score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        letters = has_letter(raw, offsets)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0), rate


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any script."""
    plain = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    out = np.zeros(len(offsets) - 1, bool)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[i] = plain[a:b].any() or any(c.isalpha() for c in raw[a:b].tobytes().decode("utf-8", "replace"))
    return out


def learning_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows that may be learned from: language known, CRC-32 of the id as text modulo 4 not 2."""
    return docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))


def held_out(column):
    """Whether an id is held out; a null id is treated as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, train_total: int = TRAIN_TOTAL) -> Model:
    """A model from a bounded sample of the rows that may be learned from.

    Ranking by a hash of the id keeps the sample the same on every run. Every language is learned, from
    whole texts until train_bytes, or its even part of train_total, are reached (the one that
    crosses the bound included, if it isn't longer than the bound itself)."""
    languages = learning_rows(docs, id_col, lang_col).filter(F.col(text_col).isNotNull()).select(lang_col).distinct().count()
    train_bytes = min(train_bytes, train_total // max(1, languages))
    fit = learning_rows(docs, id_col, lang_col).filter(F.col(text_col).isNotNull())
    rows = fit.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.octet_length(text_col).alias("n"))
    rows = rows.filter(F.col("n").between(1, train_bytes)).withColumn("h", F.xxhash64("id"))
    found = rows.groupBy("lang").agg(F.count("*").alias("c"), F.avg("n").alias("m")).collect()
    # the lowest hashes: as many rows as could fill the bound if all were of the language's mean size, twofold
    means = {r["lang"]: (r["c"], max(1.0, r["m"])) for r in found}
    share = F.lit(False)
    for name, (c, m) in means.items():
        part = min(1.0, 2.0 * (train_bytes / m + 20) / c)
        share = share | ((F.col("lang") == name) & (F.col("h").cast("double") / 2.0**64 + 0.5 <= part))
    within = Window.partitionBy("lang").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    picked = fit.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    picked = picked.withColumn("h", F.xxhash64("id")).withColumn("n", F.octet_length("text")).filter(F.col("n").between(1, train_bytes) & share)
    picked = picked.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).filter(F.col("before") < train_bytes)
    texts: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "h", "id", "text").orderBy("lang", "h", "id", "text").toArrow().to_pylist():
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(texts)


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                names, score, rate = model.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["id", "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the language) and bits_per_byte of every row.

    Null, empty and letterless texts are `und` with score 0; so is every text if nothing could be
    learned. Equal texts have equal results, ties go to the first language by name; an empty table
    gives no rows. Nothing but the text is an input of the prediction."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predict(model), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, bits_per_byte double")
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _accept(model: Model, text_at: int, max_bits: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(text_at))
            for a, b in pieces(offsets, PIECE):
                names, _, rate = model.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array([name != UNDETERMINED and r <= max_bits for name, r in zip(names, rate, strict=True)], pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """The rows whose text is in a learned language, with all their columns.

    Rejected: `und`, and texts that the best language codes in more than max_bits a byte."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_accept(model, docs.columns.index(text_col), max_bits), docs.schema)
