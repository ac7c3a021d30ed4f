"""Lexical reranking."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.jobs import cut
from lodestar.functions.text import bm25_tokens

LOGGER = logging.getLogger(__name__)
LEXICAL_WEIGHT = 0.7
DIGITS = 9
#: A reranker takes (candidates, limit) and returns them with score, rerank_score and rerank_rank.
Reranker = Callable[[DataFrame, int], DataFrame]


def lexical(candidates: DataFrame, limit: int, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Candidates (query_id, query, chunk_id, text, context_summary, score, rank, ...) by share of the
    query's distinct terms in summary and text, mixed with the score over its largest size.

    A query without terms keeps its order and scores."""
    if not 0 <= lexical_weight <= 1:
        raise ValueError("lexical_weight must be between 0 and 1")
    asked = F.array_distinct(bm25_tokens(F.col("query")))
    body = F.concat(F.coalesce(F.col("context_summary"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")))
    share = F.size(F.array_intersect(asked, bm25_tokens(body))) / F.size(asked)
    largest = F.max(F.abs("score")).over(Window.partitionBy("query_id"))
    original = F.greatest(F.lit(0.0), F.col("score") / F.when(largest > 0, largest).otherwise(F.lit(1.0)))
    mixed = F.round(F.lit(lexical_weight) * share + F.lit(1 - lexical_weight) * original, DIGITS)
    scored = candidates.withColumn("_terms", F.size(asked)).withColumn("rerank_score", F.when(F.col("_terms") > 0, mixed).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_terms") > 0, F.col("rerank_score")).desc_nulls_last(), "rank")
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= limit)
    return ranked.withColumn("score", F.col("rerank_score")).drop("_terms")


def with_fallback(candidates: DataFrame, limit: int, reranker: Reranker, timeout: float | None = None) -> tuple[DataFrame, bool]:
    """The reranker's rows, or the first `limit` candidates and True if it fails or takes too long.

    Their scores are not the reranker's, so a threshold for those says nothing of them; callers must tell of the failure.
    The plan is run here, to the checkpoint folder, to see. timeout is in seconds a query that has
    candidates; beyond all queries' time together the reranker's jobs are cancelled."""
    tag = f"rerank-{uuid.uuid4().hex}"
    context = candidates.sparkSession.sparkContext

    def run() -> DataFrame:
        context.addJobTag(tag)
        try:
            return cut(reranker(candidates, limit))
        finally:
            context.removeJobTag(tag)

    seconds = None if timeout is None else timeout * max(1, candidates.select("query_id").distinct().count())
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(run).result(seconds), False
    except Exception as problem:  # a reranker is foreign code; what it raises must not end the search
        if isinstance(problem, TimeoutError):
            context.cancelJobsWithTag(tag)
        LOGGER.exception("the reranker failed; going on with the order before it")
        plain = candidates.filter(F.col("rank") <= limit)
        return plain.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rerank_rank", F.lit(None).cast("int")), True
    finally:
        pool.shutdown(wait=False)
