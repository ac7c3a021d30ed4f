"""Console entry points: ingest, evaluate chunk sizes, evaluate retrieval modes, serve."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lodestar.operators import bm25
from lodestar.operators.chunking import Chunker
from lodestar.plans import evaluate, service
from lodestar.plans.config import RetrievalConfig
from lodestar.plans.ingestion import Ingestion
from lodestar.plans.retrieval import completed
from lodestar.sources import golden
from lodestar.sources.providers import ModelServer
from lodestar.sources.store import ChunkStore

Arguments = Sequence[str] | None


def _spark() -> SparkSession:
    return SparkSession.builder.appName("lodestar").getOrCreate()


def _parser(text: str, *folders: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=text)
    for folder in folders:
        parser.add_argument(folder)
    return parser


def ingest(arguments: Arguments = None) -> int:
    """Ingests a file or folder into a store; prints the counters as JSON."""
    parser = _parser("Ingest Markdown and PDF files", "source", "store")
    parser.add_argument("--chunk-size", type=int, default=int(os.getenv("CHUNK_SIZE", "512")))
    parser.add_argument("--chunk-overlap", type=int, default=int(os.getenv("CHUNK_OVERLAP", "64")))
    parser.add_argument("--model-server", help="base URL; without it summaries are extractive and embeddings hashed")
    own = parser.parse_args(arguments)
    server = ModelServer(own.model_server) if own.model_server else None
    job = Ingestion(ChunkStore(_spark(), own.store), Chunker(own.chunk_size, own.chunk_overlap), server and server.summarize, server and server.embed)
    stats = job.run(own.source)
    print(json.dumps(stats.as_dict(), indent=2))
    return 1 if stats.files_seen and not stats.files_succeeded else 0


def evaluate_chunks(arguments: Arguments = None) -> int:
    """Context recall of a folder at several chunk sizes, written as JSON."""
    parser = _parser("Evaluate chunk sizes", "source", "golden", "stores", "output")
    parser.add_argument("--chunk-sizes", type=int, nargs="+", default=[256, 512])
    parser.add_argument("--top-k", type=int, default=3)
    own, spark = parser.parse_args(arguments), _spark()
    asked, rows = golden.evidence_questions(spark, own.golden), None
    for size in own.chunk_sizes:
        row = evaluate.evaluate_chunk_size(spark, own.source, asked, f"{own.stores}/chunks-{size}", size, own.top_k)
        rows = row if rows is None else rows.unionByName(row)
    golden.write_results(rows, own.output)
    return 0


def evaluate_retrieval(arguments: Arguments = None) -> int:
    """Metrics of the three modes on a folder's chunks, written as JSON."""
    parser = _parser("Evaluate retrieval modes", "source", "golden", "store", "output")
    for name, value in (("chunk-size", 512), ("chunk-overlap", 64), ("candidate-k", 30), ("rerank-k", 20), ("rrf-rank-constant", 60)):
        parser.add_argument(f"--{name}", type=int, default=value)
    own, spark = parser.parse_args(arguments), _spark()
    store = ChunkStore(spark, own.store)
    Ingestion(store, Chunker(own.chunk_size, own.chunk_overlap)).run(own.source)
    config = RetrievalConfig(candidate_k=own.candidate_k, rerank_k=own.rerank_k, final_k=10, rank_constant=own.rrf_rank_constant)
    golden.write_results(evaluate.evaluate_modes(store.searchable(), golden.questions(spark, own.golden), config), own.output)
    return 0


def api(arguments: Arguments = None) -> int:
    """Serves POST /v1/rag/query over a store until it is stopped."""
    parser = _parser("Answer questions over HTTP", "store")
    parser.add_argument("--port", type=int, default=8000)
    parser.add_argument("--model-server", help="base URL; without it answers are extracts")
    own, spark = parser.parse_args(arguments), _spark()
    store = ChunkStore(spark, own.store)
    chunks = completed(store.searchable())
    index = bm25.Stored(spark, f"{own.store.rstrip('/')}-index")
    index.replace(bm25.index(chunks))
    generator = ModelServer(own.model_server).answers if own.model_server else service.extractive
    built = service.build_service(chunks, generator, index=index, store=store)
    service.serve(built, spark, own.port).serve_forever()
    return 0
