"""Recursive character chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import TEXTS, chunk_hash, document_type, language

# Fixed value: separators, the strongest first; the last cuts between characters.
SEPARATORS = ("\n\n", "\n", ". ", "。", "; ", "；", ", ", "，", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """The text parted before each separator."""
    if not separator:
        return list(text)
    out, begin, at = [], 0, text.find(separator)
    while at >= 0:
        if at > begin:
            out.append(text[begin:at])
        begin, at = at, text.find(separator, at + len(separator))
    return [*out, text[begin:]] if begin < len(text) else out


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Parts joined as far as `size` goes; the next chunk begins with parts of the last, up to `overlap`."""
    held: deque[str] = deque()
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    if held:
        yield "".join(held)


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where the separators allow it, stripped, none empty."""
    use = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    weaker, small, out = separators[use + 1 :], [], []
    for part in _cut(text, separators[use]):
        if len(part) < size:
            small.append(part)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split(part, size, overlap, weaker) if weaker else [part]
    out += _packed(small, size, overlap)
    return [c for c in (x.strip() for x in out) if c]


@dataclass(frozen=True)
class Chunker:
    size: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("size must be positive")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")

    def chunks(self, pages: DataFrame) -> DataFrame:
        """Pages (text, source_file, page_number, used_ocr, ...) to chunks with their metadata; other columns stay."""
        size, overlap = self.size, self.overlap

        @F.arrow_udf("array<string>")
        def cut(text: pa.Array) -> pa.Array:
            # few texts and their parts are Python's strings at once
            parts = [pa.array([split(t, size, overlap) if t else [] for t in text.slice(a, TEXTS).to_pylist()], pa.list_(pa.string())) for a in range(0, len(text), TEXTS)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

        rows = pages.withColumn("_parts", cut("text")).select("*", F.posexplode("_parts").alias("chunk_ordinal", "_chunk")).withColumn("text", F.col("_chunk")).drop("_parts", "_chunk")
        digest = chunk_hash(F.col("text"))
        return rows.withColumns({"chunk_hash": digest, "chunk_id": digest, "document_type": document_type(F.col("source_file")), "language": language(F.col("text")), "status": F.lit("published")})
