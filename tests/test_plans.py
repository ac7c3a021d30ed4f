import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions.jobs import cut_observed
from lodestar.operators import bm25, rerank
from lodestar.operators.chunking import Chunker
from lodestar.operators.filters import FilterPolicy
from lodestar.plans import catalog, evaluate, ingestion, service
from lodestar.plans.config import RetrievalConfig, from_environment
from lodestar.plans.ingestion import Ingestion
from lodestar.plans.retrieval import Retriever, completed
from lodestar.plans import kept as keeping
from lodestar.sources import files, golden, layout
from lodestar.sources.providers import ModelServer
from lodestar.sources.store import ChunkStore, merged
from lodestar.streaming.ingest import ingest_files_stream

SCHEMA = "chunk_id string, chunk_hash string, text string, source_file string, page_number int, language string, status string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("iam-1", "iam-1", "IAM access denied means a missing policy.", "iam.pdf", 3, "en", "published"),
        ("s3-1", "s3-1", "S3 bucket policy denies public access.", "s3.md", 1, "en", "published"),
        ("zz-1", "zz-1", "IAM access secret draft.", "draft.md", 1, "en", "draft"),
    ]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "IAM access denied"), (2, " "), (3, "completely unrelated words")], "query_id long, query string")


def test_config():
    assert from_environment({"RETRIEVAL_FINAL_K": "3"}).final_k == 3
    for bad in ({"mode": "x"}, {"final_k": 40}, {"candidate_k": 0}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_retrieve(chunks, queries, mode):
    outcome = Retriever(chunks).retrieve(queries, mode)
    best = outcome.results.filter("query_id = 1").orderBy("rank").first()
    assert best["chunk_id"] == "iam-1" and best["backend"] == f"{mode}+rerank"
    assert outcome.results.filter("status <> 'published' or query_id = 2").count() == 0
    assert outcome.diagnostics.count() == 3


def test_failing_branch_and_reranker(chunks, queries):
    def broken(*_):
        raise RuntimeError

    own = Retriever(chunks, embed=broken, reranker=broken)
    outcome = own.retrieve(queries, "hybrid", {"language": "en"}, guarded=True)
    assert outcome.results.filter("query_id = 1").orderBy("rank").first()["chunk_id"] == "iam-1"
    assert outcome.diagnostics.first()["reranker_fallback"]
    with pytest.raises(RuntimeError):
        own.retrieve(queries, "hybrid")
    with pytest.raises(ValueError):
        own.retrieve(queries, "odd")
    with pytest.raises(ValueError):
        own.retrieve(queries, "sparse", {"owner": "x"})


def test_hybrid_wide(chunks, queries):
    got = Retriever(chunks, reranker=rerank.lexical).hybrid_wide(queries, 1).filter("query_id = 1").collect()
    assert [r["chunk_id"] for r in got] == ["iam-1"]


def test_service(chunks, queries):
    own = service.Service(Retriever(chunks), config=RetrievalConfig(threshold=0.3))
    got = {r["query_id"]: r for r in own.query(queries, "sparse").collect()}
    assert not got[1]["refused"] and got[1]["citations"][0]["source"]["source_file"] == "iam.pdf"
    assert got[2]["refusal_reason"] == got[3]["refusal_reason"] == "no_retrieval_results" and got[3]["answer"] == service.REFUSAL
    strict = service.Service(Retriever(chunks), config=RetrievalConfig(threshold=9.0))
    assert strict.query(queries.filter("query_id = 1"), "sparse").first()["refusal_reason"] == "below_relevance_threshold"
    calls = []

    def wrong(asked):
        calls.append(1)
        return asked.withColumn("answer", F.lit("made up [S99]"))

    bad = service.Service(Retriever(chunks), wrong, config=RetrievalConfig(threshold=0.3))
    assert bad.query(queries.filter("query_id = 1"), "sparse").first()["refusal_reason"] == "invalid_citation" and len(calls) == 2
    with pytest.raises(ValueError):
        service.answer_one(own, queries.sparkSession, "")
    assert not service.answer_one(service.build_service(chunks, env={"SPARSE_RELEVANCE_THRESHOLD": "0.3"}), queries.sparkSession, "IAM access denied", "sparse", {"language": "en"})["refused"]


def test_ingestion_is_idempotent(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# Title\n\nSome text about buckets.")
    (folder / "sub" / "b.markdown").write_text("# Title\n\nSome text about buckets.")
    (folder / "empty.md").write_text("\n")
    (folder / "bad.pdf").write_bytes(b"%PDF-1.4 broken")
    (folder / "skip.txt").write_text("x")
    calls = []

    def summarize(text):
        raise RuntimeError

    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and not store.exists()
    first = Ingestion(store, Chunker(64, 8), summarize).run(str(folder))
    assert (first.files_seen, first.files_succeeded, first.files_failed) == (4, 2, 2)
    assert (first.chunks_created, first.chunks_skipped, first.chunks_upserted) == (2, 1, 1)
    assert len(first.warnings) == 3 and first.warnings[-1].startswith("1 chunks have extractive") and not calls
    stored = store.read().first()
    assert stored["source_file"] == "a.md" and stored["summary_fallback"] and store.vector_size() == 384
    again = Ingestion(store, Chunker(64, 8)).run(str(folder))
    assert (again.chunks_upserted, again.chunks_skipped) == (0, 2)
    with pytest.raises(ValueError):
        store.ensure(7)
    assert store.by_id(spark.createDataFrame([(stored["chunk_id"],)] * 2, "chunk_id string")).count() == 1
    assert store.existing(spark.createDataFrame([(stored["chunk_hash"],), ("x",)], "chunk_hash string")).count() == 1


def test_a_failing_embedding_batch_is_left_out(spark, tmp_path):
    (tmp_path / "a.md").write_text("text to embed")

    def embed(texts):
        raise RuntimeError

    stats = Ingestion(ChunkStore(spark, str(tmp_path / "store")), embed=embed).run(str(tmp_path / "a.md"))
    assert stats.chunks_upserted == 0 and "no vectors" in stats.warnings


def test_parse_markdown_encodings(spark, tmp_path):
    (tmp_path / "u.md").write_bytes("﻿é".encode())
    (tmp_path / "l.md").write_bytes("é".encode("latin-1"))
    pages = files.usable(files.parse(files.discover(spark, str(tmp_path))))
    assert sorted((r["source_file"], r["text"], r["page_number"]) for r in pages.collect()) == [("l.md", "é", 1), ("u.md", "é", 1)]


def test_merged(spark):
    schema = "chunk_hash string, doc_id long"
    out = merged(spark.createDataFrame([("a", 1), ("b", 2)], schema), spark.createDataFrame([("b", 3)], schema))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3)]


def test_policy_reaches_dense_search(chunks, queries):
    drafts = Retriever(chunks, policy=FilterPolicy({"status": "draft"})).dense(queries, 5)
    assert {r["chunk_id"] for r in drafts.collect()} == {"zz-1"}


def test_each_question_has_its_own_filters(spark, chunks):
    asked = [("a", "IAM access denied bucket", True, ["s3.md"], {"source_file": "s3.md"}), ("b", "IAM access denied bucket", True, ["iam.pdf"], {}), ("c", "IAM access bucket", True, ["s3.md"], {"source_file": "s3.md", "status": "draft"}), ("d", "IAM access bucket", False, [], {"language": "fr"})]
    questions = spark.createDataFrame(asked, "query_id string, query string, answerable boolean, expected_sources array<string>, filters map<string,string>")
    for mode in ("dense", "sparse", "hybrid"):
        found = Retriever(chunks).retrieve(questions, mode).results.select("query_id", "chunk_id").collect()
        got = {q: {r["chunk_id"] for r in found if r["query_id"] == q} for q in "abcd"}
        assert got["a"] == got["c"] == {"s3-1"} and "iam-1" in got["b"] and got["d"] == set()
    rows = evaluate.evaluate_modes(chunks, questions).collect()
    assert len(rows) == 3 and all(r["mrr"] == 1.0 and r["refusal_accuracy"] == 1.0 for r in rows)
    with pytest.raises(ValueError):
        Retriever(chunks).retrieve(questions.withColumn("filters", F.create_map(F.lit("owner"), F.lit("x"))), "hybrid", guarded=True)


def test_service_goes_on_without_a_failing_branch_and_reranker(chunks, queries):
    def broken(*_):
        raise RuntimeError

    own = service.Service(Retriever(chunks, embed=broken, reranker=broken), config=RetrievalConfig(threshold=0.0))
    assert not own.query(queries.filter("query_id = 1"), "hybrid").first()["refused"]


def test_the_reranker_sees_rerank_k_candidates(spark):
    rows = [(f"c{i:02}", "needle " + "hay " * i, "published") for i in range(40)]
    rows[35] = ("c35", "needle thread " + "hay " * 200, "published")  # the words of the question, but far down
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, status string")
    asked = spark.createDataFrame([(1, "needle")], "query_id long, query string")
    seen = []

    def spy(candidates, limit):
        seen.append((limit, candidates.count(), candidates.agg(F.max("rank")).first()[0]))
        return rerank.lexical(candidates, limit)

    outcome = Retriever(chunks, RetrievalConfig(candidate_k=30, rerank_k=20, final_k=5), reranker=spy).retrieve(asked, "sparse")
    assert outcome.results.count() == 5 and seen == [(20, 20, 20)]
    row = outcome.diagnostics.first()
    assert (row["sparse_candidates"], row["reranked_candidates"], row["final_chunks"]) == (30, 20, 5)


def test_the_21st_candidate_stays_out(spark):
    rows = [(f"c{i:02}", "needle " * 3 + "hay " * i, "published") for i in range(20)] + [("last", "needle rope " + "hay " * 400, "published")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, status string")
    asked = spark.createDataFrame([(1, "needle needle needle needle rope")], "query_id long, query string").withColumn("query", F.lit("needle"))
    wins = lambda candidates, limit: candidates.withColumns({"rerank_score": F.length("text").cast("double"), "rerank_rank": F.expr("row_number() over (partition by query_id order by length(text) desc)")})
    for k, best in ((20, "c19"), (21, "last")):
        found = Retriever(chunks, RetrievalConfig(candidate_k=30, rerank_k=k, final_k=5), reranker=wins).retrieve(asked, "sparse").results
        assert found.orderBy("rank").first()["chunk_id"] == best


def test_a_slow_reranker_is_given_up(chunks, queries):
    def slow(candidates, limit):
        time.sleep(30)
        return candidates

    begun = time.monotonic()
    outcome = Retriever(chunks, RetrievalConfig(reranker_timeout=0.2), reranker=slow).retrieve(queries.filter("query_id = 1"), "sparse", guarded=True)
    assert outcome.diagnostics.first()["reranker_fallback"] and outcome.results.count() > 0 and time.monotonic() - begun < 25


def test_blank_questions_of_any_white_space(spark, chunks):
    asked = spark.createDataFrame([(1, "\t\n"), (2, "\u3000\u00a0"), (3, None), (4, "IAM")], "query_id long, query string")
    for mode in ("dense", "sparse"):
        assert {r["query_id"] for r in Retriever(chunks).retrieve(asked, mode).results.collect()} == {4}


def test_a_kept_index_is_fitted_once(spark, chunks, queries, tmp_path):
    index = bm25.index(chunks).save(str(tmp_path / "index"))
    loaded = bm25.load(spark, str(tmp_path / "index"))
    plain = Retriever(chunks).sparse(queries, 5).collect()
    for own in (index, loaded):
        assert Retriever(chunks, index=own).sparse(queries, 5).collect() == plain


def test_kept_tables_follow_their_files(spark, tmp_path):
    source, made = str(tmp_path / "t.parquet"), []
    spark.createDataFrame([("a", "red fox")], "chunk_id string, text string").write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source)

    first = keeping.kept(spark, [source], make)
    assert first.chunks.count() == 1 and first.index.terms.count() == 2
    keeping.kept(spark, [source], make)
    assert len(made) == 1
    spark.createDataFrame([("b", "blue whale")], "chunk_id string, text string").write.mode("append").parquet(source)
    assert keeping.kept(spark, [source], make).chunks.count() == 2 and len(made) == 2


GOLDEN = {"id": "q", "category": "c", "answerable": True, "question": "IAM access denied", "expected_sources": ["iam.pdf"]}


def test_golden_sets(spark, tmp_path):
    def write(rows):
        (tmp_path / "golden.json").write_text(json.dumps(rows))
        return golden.questions(spark, str(tmp_path / "golden.json"))

    rows = [GOLDEN | {"id": f"q{i}", "filters": {"language": "en", "deep": {"a": 1}, "page": 3}} for i in range(15)]
    got = write(rows).orderBy("query_id").first()
    assert got["filters"] == {"language": "en", "page": "3"} and got["expected_sources"] == ["iam.pdf"] and got["answerable"]
    for bad in (rows[:14], {"rows": rows}, [*rows, "x"], [*rows, GOLDEN | {"filters": ["en"]}], [*rows, {"id": "x"}]):
        with pytest.raises(ValueError):
            write(bad)
    golden.write_results(spark.createDataFrame([("dense", 0.5)], "mode string, mrr double"), str(tmp_path / "out.json"))
    text = (tmp_path / "out.json").read_text()
    assert json.loads(text) == [{"mode": "dense", "mrr": 0.5}] and text.startswith("[\n  {")


def test_modes_are_evaluated(spark, chunks):
    asked = spark.createDataFrame([("a", "IAM access denied", True, ["iam.pdf"]), ("b", "bucket policy", True, ["s3.md"]), ("c", "zebra", False, [])], "query_id string, query string, answerable boolean, expected_sources array<string>")
    rows = {r["mode"]: r for r in evaluate.evaluate_modes(chunks, asked).collect()}
    assert set(rows) == {"dense", "dense+rerank", "hybrid+rerank"}
    best = rows["hybrid+rerank"]
    assert best["recall_at_5"] == best["mrr"] == 1.0 and best["refusal_accuracy"] == 1.0 and best["latency_ms"] > 0


def test_chunk_sizes_are_evaluated(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    parts = [f"## Part {i}\n\nThe code {w} appears when a {w} table is read. " + "More on this follows here. " * 4 for i, w in enumerate("amber birch cedar dune".split())]
    (tmp_path / "docs" / "a.md").write_text("\n\n".join(parts))
    rows = [{"question": f"What does code {w} mean?", "reference_evidence": e} for w, e in (("amber", "code AMBER appears"), ("cedar", ["code  cedar appears"]), ("none", "nowhere to be found"))]
    (tmp_path / "golden.json").write_text(json.dumps(rows))
    asked = golden.evidence_questions(spark, str(tmp_path / "golden.json"))
    for size, count in ((200, 4), (2000, 1)):
        row = evaluate.evaluate_chunk_size(spark, str(tmp_path / "docs"), asked, str(tmp_path / f"store{size}"), size).first()
        assert (row["chunk_size"], row["chunk_count"], row["top_k"], row["per_question"]) == (size, count, 3, [1.0, 1.0, 0.0])
        assert abs(row["context_recall"] - 2 / 3) < 1e-9


def test_nothing_at_a_path(spark, tmp_path):
    assert files.discover(spark, str(tmp_path / "none")).count() == 0
    stats = Ingestion(ChunkStore(spark, str(tmp_path / "store"))).run(str(tmp_path / "none"))
    assert (stats.files_seen, stats.chunks_created) == (0, 0)
    for name in ("b.md", "a.MD", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.MD", "b.md"]


def test_scanned_pages(spark, tmp_path, monkeypatch):
    (tmp_path / "lib").mkdir()
    fake = "class Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self):\n        if self.t == 'broken': raise RuntimeError\n        return self.t\n\nclass PdfReader:\n    def __init__(self, f): self.pages = [Page(t) for t in f.read().decode().split('|')]\n"
    (tmp_path / "lib" / "pypdf.py").write_text(fake)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "pypdf.py"))
    long = "A page with more than thirty characters of text."
    (tmp_path / "x.pdf").write_text(f"{long}|scan|broken|{'*' * 40}<br>|empty")

    def ocr(content, number):
        if number == 2:
            raise OSError
        return {1: "read by <b>OCR</b>", 3: "stars", 4: ""}[number]

    pages = lambda ocr: [(r["page_number"], r["text"], r["used_ocr"]) for r in files.parse(files.discover(spark, str(tmp_path / "x.pdf")), ocr).orderBy("page_number").collect()]
    assert pages(ocr) == [(1, long, False), (2, "read by OCR", True), (3, "", False), (4, "stars", True), (5, "", False)]
    assert [t for _, t, _ in pages(None)] == [long, "", "", "", ""]


def test_http(chunks, queries):
    spark = queries.sparkSession
    own = service.build_service(chunks, env={"SPARSE_RELEVANCE_THRESHOLD": "0.3"})
    ask = lambda **body: service.respond(own, spark, json.dumps(body).encode())
    for bad in ({}, {"query": ""}, {"query": "x", "mode": "odd"}, {"query": "x", "filters": {"owner": "y"}}, {"query": "x", "filters": [1]}):
        assert ask(**bad)[0] == 400
    assert service.respond(own, spark, b"no json")[0] == 400

    def broken(asked):
        raise RuntimeError

    own.generator, good = broken, own.generator
    assert ask(query="IAM access denied", mode="sparse")[0] == 503
    own.generator = good
    server = service.serve(own, spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/v1/rag/query", json.dumps({"query": "IAM access denied", "mode": "sparse", "filters": {"language": "en"}}).encode())
    with urllib.request.urlopen(request, timeout=60) as answer:
        found = json.load(answer)
    server.shutdown()
    assert not found["refused"] and found["citations"][0]["source"]["source_file"] == "iam.pdf" and found["retrieval"]["sparse_candidates"] >= 1


def test_model_server(spark, tmp_path):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(self.path)
            fails = len(calls) % 2 == 1 and self.path == "/api/generate"
            answer = {"embeddings": [[float(len(t)), 1.0] for t in body.get("input", [])]} if self.path == "/api/embed" else {"response": ' "A summary. And more." '}
            self.send_response(500 if fails else 200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = ModelServer(f"http://127.0.0.1:{server.server_port}", pause=0.01)
    assert model.summarize("text") == "A summary." and calls == ["/api/generate"] * 2
    assert model.embed(["a", "bb"] * 40) == [[1.0, 1.0], [2.0, 1.0]] * 40 and calls.count("/api/embed") == 3
    (tmp_path / "a.md").write_text("text to embed")
    stats = Ingestion(ChunkStore(spark, str(tmp_path / "store")), summarize=model.summarize, embed=model.embed).run(str(tmp_path / "a.md"))
    stored = ChunkStore(spark, str(tmp_path / "store")).read().first()
    assert stats.chunks_upserted == 1 and stored["vector"] == [13.0, 1.0] and stored["context_summary"] == "A summary."
    asked = spark.createDataFrame([(1, "q", "c", "")], "query_id long, query string, context string, correction string")
    assert model.answers(asked).first()["answer"] == '"A summary. And more."'
    server.shutdown()
    with pytest.raises(RuntimeError):
        ModelServer("http://127.0.0.1:9", retries=0, timeout=1).embed(["x"])


def versioned(rows, spark):
    return spark.createDataFrame([(h, t, v) for h, t, v in rows], "chunk_hash string, text string, vector array<double>").withColumn("chunk_id", F.col("chunk_hash"))


def test_store_replaces_what_is_upserted(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = [(f"h{k}", f"text {k}", [float(k), 1.0]) for k in range(200)]
    store.upsert(versioned(rows, spark))
    before = store.read()
    stored = {r["chunk_hash"]: r for r in before.collect()}
    assert len(stored) == 200 and store.vector_size() == 2 and all(r["point_id"] for r in stored.values())
    version, held = store.versions.read()
    store.upsert(versioned([("h7", "changed", [0.0, 0.0]), ("new", "n", [1.0, 1.0])], spark).withColumn("status", F.lit("draft")))
    now = {r["chunk_hash"]: r for r in store.read().collect()}
    assert len(now) == 201 and now["h7"]["text"] == "changed" and now["h7"]["status"] == "draft" and now["h8"]["text"] == "text 8" and now["h8"]["status"] is None
    # readers of the version before still have it, and few buckets were written anew
    assert {r["chunk_hash"]: r["text"] for r in before.collect()} == {h: r["text"] for h, r in stored.items()}
    fresh = store.versions.read()[1]["live"]
    assert sum(fresh[b] != own for b, own in held["live"].items()) <= 2
    store.append(versioned([("more", "m", [1.0, 1.0])], spark))
    assert store.compact(most=1) >= 1 and store.vacuum() >= 1 and store.read().count() == 202
    assert all(len(own) == 1 for own in store.versions.read()[1]["live"].values())


def test_a_run_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.upsert(versioned([("a", "old", [1.0])], spark))

    def dies(self, after, content):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(type(store.versions), "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(versioned([("a", "new", [1.0])], spark))
    assert [r["text"] for r in store.read().collect()] == ["old"] and store.vacuum() == 1
    store.upsert(versioned([("a", "new", [1.0])], spark))
    assert [r["text"] for r in store.read().collect()] == ["new"]
    with pytest.raises(RuntimeError):  # another run has published this version
        store.versions.publish(0, {})


def test_the_store_is_not_shuffled_for_a_few_chunks(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.append(versioned([(f"h{k}", "t", [1.0]) for k in range(500)], spark))
    asked = versioned([("h3", "t", [1.0]), ("x", "t", [1.0])], spark)
    pending = store.pending(asked)
    assert [r["chunk_hash"] for r in pending.collect()] == ["x"]
    plan = store.existing(asked)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "ReadSchema: struct<chunk_hash:string>" in scan
    assert len([p for p in store._near(asked).inputFiles()]) <= 2


def test_what_a_store_refuses_is_a_warning(spark, tmp_path):
    (tmp_path / "a.md").write_text("some text")
    (tmp_path / "b.md").write_text("other text")
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert Ingestion(store, embed=lambda texts: [[1.0, 2.0]] * len(texts)).run(str(tmp_path / "a.md")).chunks_upserted == 1
    stats = Ingestion(store).run(str(tmp_path / "b.md"))
    assert (stats.files_succeeded, stats.chunks_created, stats.chunks_upserted) == (1, 1, 0) and "dimensions" in stats.warnings[-1]


def test_too_few_vectors_lose_one_batch(spark, tmp_path):
    chunks = spark.createDataFrame([(f"h{k}", "bad" if k < 2 else "good") for k in range(6)], "chunk_hash string, text string").coalesce(1)

    def embed(texts):
        return [[1.0]] * (len(texts) - ("bad" in texts))

    rows = {r["chunk_hash"]: r["vector"] for r in ingestion.embedded(chunks, embed, 2).collect()}
    assert [k for k, v in sorted(rows.items()) if v is None] == ["h0", "h1"]


def test_chunk_sizes_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    asked = spark.createDataFrame([("q", "what", ["that"])], "query_id string, query string, evidence array<string>")
    row = evaluate.evaluate_chunk_size(spark, str(tmp_path / "docs"), asked, str(tmp_path / "store"), 256).first()
    assert (row["chunk_count"], row["context_recall"]) == (0, 0.0)


def test_a_file_stream_gives_the_store_of_one_run(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    index = bm25.Stored(spark, str(tmp_path / "index"))
    streamed = Ingestion(ChunkStore(spark, str(tmp_path / "streamed")), Chunker(64, 8), index=index)
    for k, text in enumerate(("# One\n\nThe red fox runs far away.", "# Two\n\nA blue whale swims. " + "More of it. " * 20, "# One\n\nThe red fox runs far away.")):
        (folder / f"{k}.md").write_text(text)
        done = ingest_files_stream(spark, str(folder), streamed, str(tmp_path / "progress"))
        assert [s.files_seen for s in done] == [1]
    assert ingest_files_stream(spark, str(folder), streamed, str(tmp_path / "progress")) == []
    whole = Ingestion(ChunkStore(spark, str(tmp_path / "whole")), Chunker(64, 8))
    whole.run(str(folder))
    kept = lambda job: sorted((r["chunk_hash"], r["source_file"], r["text"], r["chunk_ordinal"]) for r in job.store.read().collect())
    assert kept(streamed) == kept(whole)
    asked = spark.createDataFrame([(1, "red fox"), (2, "whale more")], "query_id long, query string")
    fresh = Retriever(whole.store.read()).sparse(asked, 5).orderBy("query_id", "rank").collect()
    assert Retriever(streamed.store.read(), index=index).sparse(asked, 5).orderBy("query_id", "rank").collect() == fresh


def test_summaries_are_bounded():
    from lodestar.sources import providers

    assert providers._one_sentence("  ") == providers.NO_CONTEXT and len(providers._one_sentence("word " * 400)) <= 240


def test_parents_come_from_the_store_by_id(spark, tmp_path):
    columns = "chunk_hash string, chunk_id string, text string, source_file string, status string, parent_id string, vector array<double>"
    rows = [("p", "p", "IAM policies in full. Access denied and what to do.", "iam.md", "published", None, [1.0]), ("d", "d", "Draft parent.", "d.md", "draft", None, [1.0]), ("c1", "c1", "IAM access denied", "iam.md", "published", "p", [1.0]), ("c2", "c2", "access denied twice", "d.md", "published", "d", [1.0])]
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame(rows, columns))
    asked = spark.createDataFrame([(1, "IAM access denied")], "query_id long, query string")
    children = store.read().filter("parent_id is not null").drop("vector")
    config = RetrievalConfig(thresholds={"sparse": 0.0})
    answers = [service.Service(Retriever(children, config), parents=parents, config=config).query(asked, "sparse").first() for parents in (store, completed(store.read()))]
    assert answers[0]["answer"] == answers[1]["answer"] and "in full" in answers[0]["answer"] and not answers[0]["refused"]
    assert answers[0]["citations"] == answers[1]["citations"]


def test_measures_come_with_the_checkpoint(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("a")).repartition(7)
    for df, want in ((rows, (1000, 500)), (rows.filter("id < 0"), (0, 0)), (rows.join(rows.limit(0).select("id"), "id"), (0, 0)), (rows.limit(0), (0, 0))):
        written, seen = cut_observed(df, n=F.count(F.lit(1)), a=F.count("a"))
        assert (seen["n"], seen["a"]) == want and written.count() == want[0]


def test_counters_of_an_ingestion_need_no_jobs_of_their_own(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.md").write_text(f"text {i // 2}" if i else "\n")
    spark.sparkContext.setJobGroup("counted", "")
    stats = Ingestion(ChunkStore(spark, str(tmp_path / "store"))).run(str(tmp_path))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (stats.files_seen, stats.files_succeeded, stats.files_failed, stats.pages_parsed) == (6, 5, 1, 5)
    assert (stats.chunks_created, stats.chunks_skipped, stats.chunks_upserted) == (5, 2, 3)
    assert jobs <= 32 and len(stats.warnings) == 1


def described(spark):
    rows = [(f"h{k}", f"text number {k} about access", [float(k), 1.0], ("published", "draft", None)[k % 3], ("en", "de", "fr", None, "")[k % 5]) for k in range(60)]
    return spark.createDataFrame(rows, "chunk_hash string, text string, vector array<double>, status string, language string").withColumn("chunk_id", F.col("chunk_hash"))


def filters_of_scan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_filters_choose_folders_of_a_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = described(spark)
    store.append(rows.filter("chunk_hash < 'h3'"))
    store.upsert(rows.filter("chunk_hash >= 'h3'"))
    assert "in_status" not in store.read().columns and sorted(store.read().select(rows.columns).collect()) == sorted(rows.collect())
    plain, placed = Retriever(store.read()), Retriever(store.searchable())
    asked = spark.createDataFrame([(1, "number 3"), (2, "access")], "query_id long, query string")
    for own in ({"language": "en"}, {"language": ""}, {"language": "none such"}, {"document_type": "pdf"}, {}):
        assert placed.sparse(asked, 9, own).orderBy("query_id", "rank").collect() == plain.sparse(asked, 9, own).orderBy("query_id", "rank").collect()
    assert "in_language" in filters_of_scan(placed._allowed({"language": "en"})) and "in_status" in filters_of_scan(placed._allowed({}))
    assert "in_status" not in filters_of_scan(plain._allowed({}))
    # values that aren't text are compared by Spark's rules for them, not by a hash
    assert "in_language" not in filters_of_scan(placed._allowed({"language": 1}))


def test_questions_own_filters_choose_folders(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.append(described(spark))
    plain, placed = Retriever(store.read()), Retriever(store.searchable())
    schema = "query_id long, query string, filters map<string,string>, vector array<double>"
    for asked in ([(1, "number 3", {"language": "en"}, [1.0, 0.0]), (2, "access", {"language": "fr"}, [0.0, 1.0])], [(1, "number", {"language": "de"}, [1.0, 0.0]), (2, "access", None, [1.0, 1.0])]):
        queries = spark.createDataFrame(asked, schema)
        for search in ("sparse", "dense"):
            got, want = (getattr(r, search)(queries, 7).orderBy("query_id", "rank").collect() for r in (placed, plain))
            assert got == want and got
    own, fields = placed._own(spark.createDataFrame([(1, "x", {"language": "en"}, [1.0])], schema))
    assert "in_language" in filters_of_scan(layout.in_folders_of(placed._allowed({}), own, fields))
    own, fields = placed._own(spark.createDataFrame([(1, "x", {"language": "en"}, [1.0]), (2, "x", None, [1.0])], schema))
    assert "in_language" not in filters_of_scan(layout.in_folders_of(placed._allowed({}), own, fields))


def test_a_store_without_folders_stays_so(spark, tmp_path, monkeypatch):
    store, rows = ChunkStore(spark, str(tmp_path / "store")), described(spark)
    with monkeypatch.context() as patch:
        patch.setattr(layout, "FIELDS", ())
        store.append(rows.filter("chunk_hash < 'h3'"))
    store.upsert(rows)
    assert store.compact(most=0) > 0 and "in_status" not in store.searchable().columns
    assert sorted(store.read().select(rows.columns).collect()) == sorted(rows.collect())


def test_many_values_make_few_folders(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("status"))
    placed = layout.laid_out(rows)
    assert placed.select("in_status").distinct().count() == layout.FOLDERS and placed.select("in_language").distinct().count() == 1
    assert [r["status"] for r in layout.in_folders(placed, {"status": "77"}).filter("status = '77'").collect()] == ["77"]
    assert layout.in_folders(rows, {"status": "77"}).count() == 5000


def _sql_rows(name, tables):
    """Rows of a query's SQL over these tables (pandas)."""
    con = duckdb.connect()
    for key, rows in tables.items():
        con.register(key, rows)
    return con.execute(catalog.SQL[name]).fetchall()


def test_cleaned_pages_are_those_of_their_sql(spark, tmp_path):
    pages = pd.DataFrame({"page_id": [1, 2, 3, 4], "html": ["<title>und&amp;&amp</title><p>a &copy; b</p>", "&amp;copy; &middot;", "", "x&amp"]})
    spark.createDataFrame(pages).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, catalog.clean_text_pages(spark, str(tmp_path)).collect())) == sorted(_sql_rows("clean_text_pages", {"pages": pages}))


def test_cjk_tokens_are_rows_of_whole_texts(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2, 3], "text": ["long words " * 50 + "End of it", "xyz", None]})
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(tuple, catalog.cjk_tokens(spark, str(tmp_path)).collect()))
    assert rows == sorted(_sql_rows("cjk_tokens", {"documents": docs})) and sum(r[0] == 1 for r in rows) > 350
    assert rows[-1] == (2, 0, "xyz")


def test_a_refreshed_index_is_scored_where_chunks_are_read(spark, tmp_path):
    """No posting is dealt out by query and chunk: what is shuffled are each task's best."""
    docs = pd.DataFrame({"doc_id": range(40), "text": [None if k == 8 else " ".join(f"w{(k * j) % 11}" for j in range(k % 9)) for k in range(40)]})
    asked = pd.DataFrame({"item_id": range(4), "text": ["w1 w2 revised", "w0 w0 w3", "absent", "w10 w4"]})
    for name, rows in {"documents": docs, "benchmark": asked}.items():
        rows.to_parquet(tmp_path / f"{name}.parquet")
    found = catalog.index_refresh(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    got = sorted(map(tuple, found.collect()))
    assert got and got == sorted(_sql_rows("index_refresh", {"documents": docs, "benchmark": asked}))


def test_a_failed_retrieval_is_no_refusal(spark, chunks, queries, monkeypatch):
    def broken(*_):
        raise RuntimeError

    late = lambda candidates, limit: rerank.lexical(candidates, limit).withColumn("rerank_score", F.raise_error(F.lit("late")).cast("double"))
    config = RetrievalConfig(threshold=0.3)
    monkeypatch.setattr(catalog, "retriever", lambda *_: Retriever(chunks, config, reranker=late))
    monkeypatch.setattr(catalog, "questions", lambda *_: queries)
    with pytest.raises(Exception, match="late"):
        catalog.answers(spark, "").collect()
    row = service.Service(Retriever(chunks, reranker=late), config=config).query(queries.filter("query_id = 1"), "hybrid").first()
    assert (row["answer"], row["refusal_reason"], row["retrieval"]["failed"]) == (None, "retrieval_failed", ["reranker"])
    monkeypatch.setattr(service, "answer_one", lambda *_: row.asDict())
    assert service.respond(None, spark, b'{"query": "IAM access denied"}')[0] == 503
    half = service.Service(Retriever(chunks, embed=broken), config=config)
    got = {r["query_id"]: r for r in half.query(queries.filter("query_id <> 2"), "hybrid").collect()}
    assert not got[1]["refused"] and got[1]["retrieval"]["failed"] == ["dense"] and got[3]["refusal_reason"] == "retrieval_failed"
    with pytest.raises(RuntimeError):
        half.query(queries, "dense")


@pytest.mark.parametrize("part", ["dense", "sparse", "reranker"])
def test_a_mode_that_fails_has_no_metrics(spark, chunks, monkeypatch, part):
    def late(candidates, limit):
        return rerank.lexical(candidates, limit).withColumn("rerank_score", F.raise_error(F.lit("late")).cast("double"))

    asked = spark.createDataFrame([("a", "IAM access denied", True, ["iam.pdf"]), ("b", "zebra", False, [])], "query_id string, query string, answerable boolean, expected_sources array<string>")
    if part == "reranker":
        monkeypatch.setattr(evaluate, "dense_rerank_pipeline", lambda chunks, config: Retriever(chunks, config, reranker=late))
    else:
        search = getattr(Retriever, part)
        monkeypatch.setattr(Retriever, part, lambda *a: search(*a).withColumn("score", F.raise_error(F.lit("late")).cast("double")))
    with pytest.raises(Exception, match="late"):
        evaluate.evaluate_modes(chunks, asked)
