"""Summaries, embeddings and answers from a local model server over HTTP (POST /api/generate and /api/embed)."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import prompts
from lodestar.functions.text import NO_CONTEXT

EMBED_BATCH, CONCURRENCY, RETRIES = 32, 4, 2
# Tokens that a summary may have, and its characters.
SUMMARY_TOKENS, SUMMARY_CHARS = 80, 240


def _one_sentence(text: str) -> str:
    """What functions.text.first_sentence() gives, for one answer: bounded, and a fixed sentence for an empty one."""
    value = " ".join(text.split()).strip("\"'`- ")
    ends = [i for i in map(value.find, ".!?。！？") if i >= 0]
    chosen = value[: min(ends) + 1] if ends else value[:SUMMARY_CHARS].rstrip(" ,;:，；：") + "."
    return chosen[:SUMMARY_CHARS].strip() if value else NO_CONTEXT


@dataclass(frozen=True)
class ModelServer:
    """Calls are tried again RETRIES times, after 1, 2, ... seconds; then the last error is raised."""

    base_url: str = "http://localhost:11434"
    generator: str = "llama3.2:3b"
    embedder: str = "nomic-embed-text"
    timeout: float = 60.0
    retries: int = RETRIES
    pause: float = 1.0

    def post(self, endpoint: str, body: dict) -> dict:
        request = urllib.request.Request(self.base_url.rstrip("/") + endpoint, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    found = json.load(answer)
                if not isinstance(found, dict):
                    raise ValueError("the server's answer is no object")
                return found
            except (OSError, ValueError) as problem:
                if attempt == self.retries:
                    raise RuntimeError(f"the model server failed: {problem}") from problem
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def generate(self, prompt: str, **options: int) -> str:
        return str(self.post("/api/generate", {"model": self.generator, "stream": False, "options": {"temperature": 0, **options}, "prompt": prompt}).get("response", ""))

    def summarize(self, text: str) -> str:
        """One sentence on a chunk."""
        return _one_sentence(self.generate(prompts.summary_prompt(text), num_predict=SUMMARY_TOKENS))

    def answers(self, asked: DataFrame) -> DataFrame:
        """A generator for the service: (query_id, query, context, correction, ...) with answer; a failing call ends the job."""
        names = [*asked.columns, "answer"]
        prompted = asked.withColumn("_prompt", prompts.answer_prompt(F.col("query"), F.col("context"), F.col("correction")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                with ThreadPoolExecutor(CONCURRENCY) as pool:
                    said = [text.strip() for text in pool.map(self.generate, batch.column(batch.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], names=names)

        return prompted.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("answer", T.StringType())]))

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors of texts, EMBED_BATCH a call and CONCURRENCY calls at a time."""

        def one(batch: list[str]) -> list[list[float]]:
            vectors = self.post("/api/embed", {"model": self.embedder, "input": batch}).get("embeddings")
            if not isinstance(vectors, list) or len(vectors) != len(batch):
                raise ValueError("the server's vectors don't match the texts")
            return [[float(x) for x in v] for v in vectors]

        with ThreadPoolExecutor(CONCURRENCY) as pool:
            return [v for part in pool.map(one, [texts[a : a + EMBED_BATCH] for a in range(0, len(texts), EMBED_BATCH)]) for v in part]
