"""Answers: threshold, context, generation, citation check, refusal."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.jobs import cut
from lodestar.functions.prompts import correction
from lodestar.operators import bm25, context
from lodestar.operators.filters import Value
from lodestar.plans.config import RetrievalConfig, from_environment
from lodestar.plans.retrieval import Retriever, completed
from lodestar.sources.store import ChunkStore

# The answer of a refusal, and its reasons in the order in which they are looked for.
REFUSAL = "知识库无法回答该问题。"
REASONS = ("no_retrieval_results", "below_relevance_threshold", "empty_context", "invalid_citation")
#: The reason where one of the first three may come of a failed branch or reranker: nothing is known then, so there is no answer either.
FAILED = "retrieval_failed"
#: Takes (query_id, query, context, correction) rows and returns them with a column answer.
Generator = Callable[[DataFrame], DataFrame]


def extractive(asked: DataFrame) -> DataFrame:
    """An offline generator: the first line of the first block, cited."""
    line = F.regexp_extract("context", r"\[S1\][^\n]*\n([^\n]*)", 1)
    return asked.withColumn("answer", F.concat(line, F.lit(" [S1]")))


def relevant(results: DataFrame, threshold: float) -> DataFrame:
    """Results that reach the threshold by rerank score, else by score."""
    return results.filter(F.coalesce("rerank_score", "score") >= F.lit(threshold))


def refusal_reason(found: DataFrame) -> DataFrame:
    """Adds reason (null if answered) to rows with results, relevant, blocks and valid."""
    ladder = F.when(F.coalesce("results", F.lit(0)) == 0, REASONS[0]).when(F.coalesce("relevant", F.lit(0)) == 0, REASONS[1]).when(F.coalesce("blocks", F.lit(0)) == 0, REASONS[2])
    return found.withColumn("reason", ladder.when(~F.coalesce("valid", F.lit(False)), REASONS[3]))


@dataclass
class Service:
    retriever: Retriever
    generator: Generator = extractive
    #: Chunks that may be parents: a table, or a store that is asked for the ids that results name.
    parents: DataFrame | ChunkStore | None = None
    config: RetrievalConfig = field(default_factory=RetrievalConfig)
    #: Goes on without a branch or reranker that fails; else the failure is raised, and no reranker_timeout holds.
    guarded: bool = True

    def _answers(self, asked: DataFrame) -> DataFrame:
        rows = self.generator(asked)
        check = context.validate_citations(F.col("answer"), F.map_keys("source_map"))
        return rows.withColumns(check)

    def query(self, queries: DataFrame, mode: str = "dense", filters: Mapping[str, Value] | None = None) -> DataFrame:
        """query_id, answer, citations, refused, refusal_reason, final_chunks, context_tokens and retrieval (the diagnostics) of every query.

        Queries whose answer cites nothing or unknown sources are asked once more, with a correction. A guarded service leaves out a branch or reranker
        that fails and names it in retrieval.failed; what is found then may be answered, but is no ground for a refusal: that has reason FAILED and no answer."""
        outcome = self.retriever.retrieve(queries, mode, filters, guarded=self.guarded, kept=True)
        results = outcome.results
        good = relevant(results, self.config.threshold_of(mode))
        parents = self.parents
        if isinstance(parents, ChunkStore):
            good = cut(good)
            ids = good.select(F.nullif(F.col("parent_id"), F.lit("")).alias("chunk_id")).filter("chunk_id is not null")
            parents = completed(parents.by_id(ids))
        expanded = good if parents is None else context.expand_parents(good, parents)
        built = context.build(expanded, self.config.max_context_tokens, self.config.per_document)
        asked = cut(built.join(queries.select("query_id", "query"), "query_id").withColumn("correction", F.lit("")))
        first = cut(self._answers(asked))
        again = first.filter("not valid").drop("answer", "referenced", "invalid", "valid").withColumn("correction", correction(F.map_keys("source_map")))
        answers = first.filter("valid").unionByName(cut(self._answers(again)))
        counts = queries.select("query_id").join(results.groupBy("query_id").agg(F.count("*").alias("results")), "query_id", "left")
        counts = counts.join(good.groupBy("query_id").agg(F.count("*").alias("relevant")), "query_id", "left")
        described = outcome.diagnostics.select("query_id", F.struct(*[c for c in outcome.diagnostics.columns if c != "query_id"]).alias("retrieval"))
        counts = counts.join(described, "query_id", "left")
        found = refusal_reason(counts.join(answers.withColumnRenamed("chunks", "blocks"), "query_id", "left"))
        doubtful = F.col("reason").isin(*REASONS[:3]) & (F.size("retrieval.failed") > 0)
        found = found.withColumn("reason", F.when(doubtful, FAILED).otherwise(F.col("reason")))
        refused = F.col("reason").isNotNull()
        cited = F.transform("referenced", lambda s: F.struct(s.alias("source_id"), F.try_element_at(F.col("source_map"), s).alias("source")))
        return found.select(
            "query_id",
            F.when(refused, F.when(F.col("reason") != FAILED, F.lit(REFUSAL))).otherwise(F.col("answer")).alias("answer"),
            F.when(~refused, cited).alias("citations"),
            refused.alias("refused"),
            F.col("reason").alias("refusal_reason"),
            F.coalesce("blocks", "results", F.lit(0)).alias("final_chunks"),
            F.coalesce("token_count", F.lit(0)).alias("context_tokens"),
            "retrieval",
        )


def build_service(chunks: DataFrame, generator: Generator = extractive, env: Mapping[str, str] | None = None, index: bm25.Index | bm25.Stored | None = None, store: ChunkStore | None = None) -> Service:
    """A service over a chunks table, and the index fitted on it, by environment settings; parents come from the store, if it is given."""
    config = from_environment(env)
    return Service(Retriever(chunks, config, index=index), generator, store or completed(chunks), config)


LOGGER = logging.getLogger(__name__)
MAX_QUERY = 2000


def answer_one(service: Service, spark, query: str, mode: str = "hybrid", filters: Mapping[str, Value] | None = None) -> dict:
    """One question, as an HTTP handler would ask it; ValueError for what the caller got wrong."""
    if not 1 <= len(query) <= MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    rows = service.query(spark.createDataFrame([(0, query)], "query_id long, query string"), mode, filters)
    return rows.first().asDict(recursive=True)


def respond(service: Service, spark, body: bytes) -> tuple[int, dict]:
    """HTTP status and answer for a request {query, mode, filters}: 400 for what the caller got wrong, 503 for failures."""
    try:
        asked = json.loads(body)
        if not isinstance(asked, dict) or not isinstance(asked.get("query"), str) or not isinstance(asked.get("filters") or {}, dict):
            raise ValueError("a request is an object with a query, and filters that are an object")
        answer = answer_one(service, spark, asked["query"], asked.get("mode", "hybrid"), asked.get("filters"))
        return (503, {"detail": "retrieval is unavailable"}) if answer["refusal_reason"] == FAILED else (200, answer)
    except ValueError as problem:
        return 400, {"detail": str(problem)}
    except Exception:
        LOGGER.exception("a query failed")
        return 503, {"detail": "retrieval is unavailable"}


def serve(service: Service, spark, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for POST /v1/rag/query; call its serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, answer = respond(service, spark, body) if self.path == "/v1/rag/query" else (404, {"detail": "not found"})
            raw = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            LOGGER.debug("request %s", self.path)

    return ThreadingHTTPServer((host, port), Handler)
