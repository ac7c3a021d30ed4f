"""Retrieval of whole query tables: dense, sparse, hybrid, reranked."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.jobs import broadcast_if_small, cut
from lodestar.operators import bm25, dense, embedding, fusion, rerank
from lodestar.operators.filters import USER_FIELDS, FilterPolicy, Value, askable, matches
from lodestar.plans.config import MODES, RetrievalConfig
from lodestar.sources import layout

LOGGER = logging.getLogger(__name__)
#: Columns that results carry of their chunk.
CARRIED = ("chunk_hash", "text", "source_file", "page_number", "document_type", "language", "status", "context_summary", "parent_id")


def completed(chunks: DataFrame) -> DataFrame:
    """chunks with null for metadata that the table lacks."""
    have = set(chunks.columns)
    return chunks.select("*", *[F.lit(None).cast("int" if c == "page_number" else "string").alias(c) for c in CARRIED if c not in have])


@dataclass
class Outcome:
    """results (query_id, query, rank, chunk_id, score, ...) and diagnostics (query_id, counts, and failed: the branches and reranker that were left out)."""

    results: DataFrame
    diagnostics: DataFrame


@dataclass
class Retriever:
    """Searches chunks (chunk_id, text, metadata, optional vector) for queries (query_id, query, optional vector).

    A column filters of queries, map<string,string>, has each query's own metadata filters. A stored
    index is looked up for every search, so that its latest segments are found. Of chunks that are laid out
    in folders (sources/layout.py) only those are read that the filters can be met in."""

    chunks: DataFrame
    config: RetrievalConfig = field(default_factory=RetrievalConfig)
    policy: FilterPolicy = field(default_factory=FilterPolicy)
    reranker: rerank.Reranker | None = rerank.lexical
    embed: object = embedding.embed
    index: bm25.Index | bm25.Stored | None = None

    def __post_init__(self) -> None:
        self.chunks = fusion.identified(completed(self.chunks))

    def _allowed(self, filters: Mapping[str, Value] | None) -> DataFrame:
        applied = self.policy.apply(filters)
        return layout.in_folders(self.chunks, applied).filter(matches(applied))

    def _own(self, queries: DataFrame) -> tuple[DataFrame, list[str]]:
        """queries with a column filter_* for every field that their own filters may name, and these fields; system filters win."""
        if "filters" not in queries.columns:
            return queries, []
        named = queries.select(F.explode(F.map_keys("filters")).alias("field")).distinct().collect()
        asked = self.policy.apply({r["field"]: "" for r in named})
        fields = [f for f in USER_FIELDS if f in asked and f not in self.policy.system]
        return queries.withColumns({f"filter_{f}": F.try_element_at("filters", F.lit(f)) for f in fields}), fields

    def dense(self, queries: DataFrame, limit: int, filters: Mapping[str, Value] | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank by cosine; filtered before the search."""
        queries, fields = self._own(queries)
        asked, allowed = askable(queries), layout.in_folders_of(self._allowed(filters), queries, fields)
        described = allowed.select("chunk_id", *fields)
        if "vector" not in asked.columns:
            asked = self.embed(asked, "query_id", "query")
            if fields:
                asked = asked.join(queries.select("query_id", *[f"filter_{f}" for f in fields]), "query_id")
        if "vector" not in allowed.columns:
            allowed = self.embed(allowed, "chunk_id", "text")
            if fields:
                allowed = allowed.join(described, "chunk_id")
        return dense.nearest(asked, allowed, limit, fields=fields)

    def sparse(self, queries: DataFrame, limit: int, filters: Mapping[str, Value] | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank by BM25; statistics are those of all chunks."""
        queries, fields = self._own(queries)
        index = self.index.index() if isinstance(self.index, bm25.Stored) else self.index or bm25.index(self.chunks, terms=bm25.query_terms(queries))
        allowed = layout.in_folders_of(self._allowed(filters), queries, fields) if fields or self.policy.apply(filters) else None
        return bm25.search(queries, index, limit, allowed, fields=fields)

    def _described(self, queries: DataFrame, ranked: DataFrame) -> DataFrame:
        """Ranked ids with the query's text and the chunk's fields; only these few rows meet the texts."""
        fields = self.chunks.select("chunk_id", *CARRIED)
        return fields.join(broadcast_if_small(cut(ranked)), "chunk_id").join(queries.select("query_id", "query"), "query_id")

    def _branch(self, search, queries: DataFrame, filters, guarded: bool) -> tuple[DataFrame | None, Exception | None]:
        if not guarded:
            return cut(search(queries, self.config.candidate_k, filters)), None
        try:
            return cut(search(queries, self.config.candidate_k, filters)), None
        except Exception as problem:  # one failing branch must not end a hybrid search
            LOGGER.exception("a search failed")
            return None, problem

    def candidates(self, branch: str, queries: DataFrame, filters: Mapping[str, Value] | None = None) -> DataFrame:
        """The candidates of a branch, dense or sparse, checkpointed; its failure is raised."""
        return self._branch(getattr(self, branch), queries, filters, False)[0]

    def retrieve(self, queries: DataFrame, mode: str | None = None, filters: Mapping[str, Value] | None = None, guarded: bool = False, known: Mapping[str, DataFrame] | None = None, kept: bool = False) -> Outcome:
        """Candidates, fusion for hybrid, rerank of the first rerank_k, first final_k.

        The candidates, few rows that cost the most, are checkpointed. guarded goes on without a branch
        or reranker that fails (or takes longer than reranker_timeout a query), and diagnostics name it; where
        every branch fails, and without guarded, the failure is raised. kept checkpoints reranked rows too, for
        callers that read results and diagnostics. known has branches' candidates for the same queries and
        filters, which aren't searched again."""
        mode = mode or self.config.mode
        if mode not in MODES:
            raise ValueError(f"unsupported mode: {mode}")
        self.policy.apply(filters)
        self._own(queries)  # raises for unsupported fields, guarded or not
        config = self.config
        known = known or {}
        branches = {name: (known[name], None) if name in known else self._branch(getattr(self, name), queries, filters, guarded) for name in ("dense", "sparse") if mode in (name, "hybrid")}
        found = {name: rows for name, (rows, _) in branches.items() if rows is not None}
        if not found:  # no rows of a failed search would read as nothing found
            raise next(problem for _, problem in branches.values())
        missing = [name for name in branches if name not in found]
        if mode == "hybrid":
            ranked = fusion.fuse(found, config.candidate_k, config.rank_constant).withColumn("backend", F.lit("hybrid"))
        else:
            rows = found[mode]
            other = "sparse" if mode == "dense" else "dense"
            ranked = rows.withColumns({f"{mode}_rank": F.col("rank"), f"{other}_rank": F.lit(None).cast("int"), "sources": F.lit(mode), "backend": F.lit(mode)})
        candidates = self._described(queries, ranked if self.reranker is None else ranked.filter(F.col("rank") <= config.rerank_k))
        failed = False
        if self.reranker is None:
            final = candidates.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.lit(None).cast("int")})
        else:
            if guarded:
                final, failed = rerank.with_fallback(candidates, config.rerank_k, self.reranker, config.reranker_timeout)
            else:
                final = self.reranker(candidates, config.rerank_k)
                final = cut(final) if kept else final
            missing += ["reranker"] * failed
            final = final.withColumn("backend", F.when(F.lit(not failed), F.concat("backend", F.lit("+rerank"))).otherwise(F.col("backend")))
        final = final.withColumn("retrieval_rank", F.col("rank")).withColumn("rank", F.coalesce("rerank_rank", "rank"))
        results = final.filter(F.col("rank") <= config.final_k)
        counts = queries.select("query_id")
        for name in ("dense", "sparse"):
            rows = found.get(name)
            own = queries.limit(0).select("query_id", F.lit(0).cast("long").alias(f"{name}_candidates")) if rows is None else rows.groupBy("query_id").agg(F.count("*").alias(f"{name}_candidates"))
            counts = counts.join(own, "query_id", "left")
        counts = counts.join(ranked.groupBy("query_id").agg(F.count("*").alias("fused")), "query_id", "left")
        shown = final.groupBy("query_id").agg(F.count("rerank_rank").alias("reranked_candidates"), F.count(F.when(F.col("rank") <= config.final_k, 1)).alias("final_chunks"))
        counts = counts.join(shown, "query_id", "left").na.fill(0)
        left_out = F.array(*[F.lit(name) for name in missing]).cast("array<string>")
        return Outcome(results, counts.withColumns({"mode": F.lit(mode), "reranker_fallback": F.lit(failed), "failed": left_out}))

    def hybrid_wide(self, queries: DataFrame, limit: int, filters: Mapping[str, Value] | None = None) -> DataFrame:
        """Hybrid search that takes three times `limit` from each branch and reranks to `limit`; failures propagate."""
        wide = {"dense": self.dense(queries, 3 * limit, filters), "sparse": self.sparse(queries, 3 * limit, filters)}
        fused = self._described(queries, fusion.fuse(wide, 3 * limit if self.reranker else limit, self.config.rank_constant))
        return fused if self.reranker is None else self.reranker(fused, limit).withColumn("rank", F.col("rerank_rank"))


def dense_pipeline(chunks: DataFrame, config: RetrievalConfig | None = None) -> Retriever:
    """Dense search without reranking."""
    return Retriever(chunks, config or RetrievalConfig("dense"), reranker=None)


def dense_rerank_pipeline(chunks: DataFrame, config: RetrievalConfig | None = None) -> Retriever:
    """Dense search with lexical reranking."""
    return Retriever(chunks, config or RetrievalConfig("dense"))
