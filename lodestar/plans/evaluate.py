"""Evaluation of retrieval modes and chunk sizes."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.jobs import cut
from lodestar.operators import bm25, evaluation
from lodestar.operators.chunking import Chunker
from lodestar.operators.filters import FilterPolicy
from lodestar.plans.config import RetrievalConfig
from lodestar.plans.ingestion import Ingestion
from lodestar.plans.retrieval import Retriever, dense_pipeline, dense_rerank_pipeline
from lodestar.sources.store import ChunkStore


def evaluate_modes(chunks: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, index: bm25.Index | None = None, policy: FilterPolicy | None = None) -> DataFrame:
    """One row of metrics for dense, dense with rerank and hybrid with rerank; latency is the batch's time over its questions.

    Dense candidates are the same for all three and are searched once; every mode's latency has their time.

    A question's filters (column filters) hold before dense and sparse ranking. A branch or reranker that fails
    ends the evaluation: metrics of what is left would read as the mode's."""
    config = config or RetrievalConfig(final_k=10)
    common = {"index": index} | ({} if policy is None else {"policy": policy})
    runs = {
        "dense": (replace(dense_pipeline(chunks, config), **common), "dense"),
        "dense+rerank": (replace(dense_rerank_pipeline(chunks, config), **common), "dense"),
        "hybrid+rerank": (Retriever(chunks, config, **common), "hybrid"),
    }
    asked, out = max(1, questions.count()), None
    begun = time.monotonic()
    dense = runs["dense"][0].candidates("dense", questions)
    searched = time.monotonic() - begun
    for label, (retriever, mode) in runs.items():
        begun = time.monotonic()
        results = cut(retriever.retrieve(questions, mode, known={"dense": dense}).results)
        spent = (time.monotonic() - begun + searched) * 1000 / asked
        seen = results.select("query_id", "rank", F.coalesce("rerank_score", "score").alias("score"), "source_file")
        row = evaluation.metrics(evaluation.judged(questions, seen)).select(F.lit(label).alias("mode"), F.lit(spent).alias("latency_ms"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def question_recall(chunks: DataFrame, questions: DataFrame, top_k: int = 3, index: bm25.Index | None = None, policy: FilterPolicy | None = None) -> DataFrame:
    """query_id and recall of every question (query_id, query, evidence): hybrid search's best top_k against the chunks that hold its evidence."""
    reference = evaluation.evidence_chunks(questions, chunks)
    own = Retriever(chunks, index=index) if policy is None else Retriever(chunks, index=index, policy=policy)
    retrieved = own.hybrid_wide(questions, top_k).filter(F.col("rank") <= top_k)
    return evaluation.context_recall(questions, reference, retrieved)


def evaluate_chunk_size(spark: SparkSession, source: str, questions: DataFrame, store_path: str, size: int, top_k: int = 3) -> DataFrame:
    """chunk_size, chunk_count, top_k, context_recall and per_question (in order of query_id) of a folder cut to chunks of one size."""
    store = ChunkStore(spark, store_path)
    Ingestion(store, Chunker(size, max(32, size // 8))).run(source)
    chunks = store.searchable()
    recall = question_recall(chunks, questions, top_k)
    each = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "recall"))), lambda r: r["recall"])
    return recall.agg(F.lit(size).alias("chunk_size"), F.lit(chunks.count()).alias("chunk_count"), F.lit(top_k).alias("top_k"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("context_recall"), each.alias("per_question"))
