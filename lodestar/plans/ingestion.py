"""Ingestion: files to pages, chunks, summaries, embeddings, store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.jobs import cut, cut_observed
from lodestar.functions.text import first_sentence
from lodestar.operators import bm25, embedding
from lodestar.operators.chunking import Chunker
from lodestar.sources import files
from lodestar.sources.store import ChunkStore, first_chunks

EMBED_BATCH, CONCURRENCY = 32, 4
#: Files without content that are named one by one; the number of others is told.
NAMED = 100
#: From texts to vectors, for one batch; an exception loses that batch alone.
Embed = Callable[[list[str]], list[list[float]]]
#: From a text to its summary; an exception gives the extractive one.
Summarize = Callable[[str], str]


@dataclass
class Stats:
    files_seen: int = 0
    files_succeeded: int = 0
    files_failed: int = 0
    pages_parsed: int = 0
    chunks_created: int = 0
    chunks_skipped: int = 0
    chunks_upserted: int = 0
    warnings: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def summarized(chunks: DataFrame, summarize: Summarize | None = None) -> DataFrame:
    """Adds context_summary and summary_fallback; without a provider the extractive summary, in the JVM."""
    own = first_sentence(F.col("text"))
    if summarize is None:
        return chunks.withColumns({"context_summary": own, "summary_fallback": F.lit(False)})

    def attempt(text: str) -> str | None:
        try:
            return summarize(text)
        except Exception:  # a provider may fail in any way
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with ThreadPoolExecutor(CONCURRENCY) as pool:
                yield batch.append_column("_summary", pa.array(list(pool.map(attempt, batch.column("text").to_pylist())), pa.string()))

    asked = chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("_summary", T.StringType())]))
    missing = F.col("_summary").isNull()
    return asked.withColumns({"context_summary": F.coalesce("_summary", own), "summary_fallback": missing}).drop("_summary")


def embedded(chunks: DataFrame, embed: Embed | None = None, batch_size: int = EMBED_BATCH) -> DataFrame:
    """Adds vector; null where the provider failed for the batch or gave a wrong number of vectors. Without a provider feature hashing."""
    if embed is None:
        return chunks.join(embedding.embed(chunks, "chunk_hash", "text"), "chunk_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), batch_size):
                some = batch.slice(a, batch_size)
                try:
                    vectors = pa.array(list(embed(some.column("text").to_pylist())), pa.list_(pa.float64()))
                    if len(vectors) != len(some):
                        raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                except Exception:  # a provider may fail in any way
                    vectors = pa.nulls(len(some), pa.list_(pa.float64()))
                yield some.append_column("vector", vectors)

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


@dataclass
class Ingestion:
    store: ChunkStore
    chunker: Chunker = field(default_factory=Chunker)
    summarize: Summarize | None = None
    embed: Embed | None = None
    ocr: files.Ocr | None = None
    #: A kept search index that gets a segment for every addition.
    index: bm25.Stored | None = None

    def run(self, source: str) -> Stats:
        """Ingests a file or folder; what is stored already costs no summary and no embedding."""
        return self.add_files(files.discover(self.store.spark, source))

    def add_files(self, found: DataFrame) -> Stats:
        """Ingests files (path, content)."""
        stats = Stats()
        found = files.parse(found, self.ocr)
        if self.ocr is not None:
            found = cut(found)
        pages = Observation()
        read = files.usable(found).observe(pages, F.count(F.lit(1)).alias("n"))
        chunks, made = cut_observed(self.chunker.chunks(read), n=F.count(F.lit(1)))
        stats.pages_parsed, stats.chunks_created = pages.get["n"], made["n"]
        with_chunks = chunks.select("path").distinct().withColumn("chunked", F.lit(1))
        per_file, total = cut_observed(found.select("path").distinct().join(with_chunks, "path", "left"), seen=F.count(F.lit(1)), good=F.count("chunked"))
        stats.files_seen, stats.files_succeeded, stats.files_failed = total["seen"], total["good"], total["seen"] - total["good"]
        if stats.files_failed:
            stats.warnings += [f"no usable content: {r['path']}" for r in per_file.filter("chunked is null").select("path").orderBy("path").limit(NAMED).collect()]
        if stats.files_failed > NAMED:
            stats.warnings.append(f"no usable content: {stats.files_failed - NAMED} more files")
        return self.add(chunks, stats)

    def add(self, chunks: DataFrame, stats: Stats | None = None) -> Stats:
        """Stores chunks that are new; of one hash the first by path, page and ordinal."""
        stats = stats or Stats(chunks_created=chunks.count())
        unique = first_chunks(chunks, ["path", "page_number", "chunk_ordinal"])
        try:
            pending, fresh = cut_observed(self.store.pending(unique), n=F.count(F.lit(1)))
        except Exception as problem:  # nothing is embedded unless it is known to be new
            stats.warnings.append(f"hash check failed: {problem}")
            return stats
        new = fresh["n"]
        stats.chunks_skipped = stats.chunks_created - new
        if not new:
            return stats
        size = F.when(F.col("vector").isNotNull(), F.size("vector"))
        rows, told = cut_observed(
            embedded(summarized(pending, self.summarize), self.embed),
            fallbacks=F.count_if("summary_fallback"), whole=F.count("vector"), least=F.min(size), most=F.max(size),
        )
        if told["fallbacks"]:
            stats.warnings.append(f"{told['fallbacks']} chunks have extractive summaries instead")
        whole = rows.filter("vector is not null")
        lost = new - told["whole"]
        if lost:
            stats.warnings.append(f"{lost} chunks weren't embedded")
        if not told["whole"] or told["least"] != told["most"]:
            stats.warnings.append("vectors of several sizes" if told["whole"] else "no vectors")
            return stats
        try:
            self.store.ensure(told["most"])
            self.store.append(whole)
        except Exception as problem:  # the counters so far are worth having whatever a store does
            stats.warnings.append(f"storing failed: {problem}")
            return stats
        stats.chunks_upserted = new - lost
        if self.index is not None:
            self.index.refresh(whole)
        return stats
