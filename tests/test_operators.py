import hashlib
import re
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import bm25, context, dense, embedding, evaluation, fusion, rerank
from lodestar.operators.chunking import Chunker, split
from lodestar.operators.filters import FilterPolicy, matches
from lodestar.plans import oracles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_split_keeps_separators_and_overlap():
    assert split("aa. bb. cc", 6, 0) == ["aa. bb", ". cc"]
    assert all(len(c) <= 20 for c in split("word " * 100, 20, 5))
    assert split("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert split("", 10, 0) == []


def test_chunker(spark):
    with pytest.raises(ValueError):
        Chunker(0)
    with pytest.raises(ValueError):
        Chunker(10, 10)
    pages = spark.createDataFrame([("a b\n\nc d", "f.md", 1, False), (None, "g.pdf", 1, True)], "text string, source_file string, page_number int, used_ocr boolean")
    out = Chunker(4, 0).chunks(pages).select("text", "chunk_ordinal", "document_type", "status", "language").collect()
    assert [tuple(r) for r in out] == [("a b", 0, "markdown", "published", "en"), ("c d", 1, "markdown", "published", "en")]


def test_filter_policy(spark):
    policy = FilterPolicy({"status": "published", "tenant_id": 7})
    assert policy.apply({"status": "draft", "tenant_id": 1, "language": "en"}) == {"status": "published", "tenant_id": 7, "language": "en"}
    with pytest.raises(ValueError, match="bad, worse"):
        policy.apply({"worse": 1, "bad": 2})
    frame = spark.createDataFrame([("a", "en"), ("b", None)], "chunk_id string, language string")
    assert [r[0] for r in frame.filter(matches({"language": "en"})).collect()] == ["a"]


def test_bm25_matches_its_formula(spark):
    texts = {"a": "red fox fox", "b": "red dog", "c": "blue whale sings", "d": ""}
    queries = {1: "fox red red", 2: "unknown", 3: "  "}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = {(q, c): s for q, c, s, _ in rows(bm25.search(asked, bm25.index(chunks), 10), "query_id", "rank")}
    n, tokens = len(texts), {k: v.split() for k, v in texts.items()}
    avg = sum(map(len, tokens.values())) / n
    want = {}
    for term, times in Counter(queries[1].split()).items():
        df = sum(term in t for t in tokens.values())
        for k, t in tokens.items():
            if term in t:
                tf = t.count(term)
                want[1, k] = want.get((1, k), 0) + times * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    narrow = bm25.search(asked, bm25.index(chunks, terms=bm25.query_terms(asked)), 10)
    assert rows(narrow, "query_id", "rank") == rows(bm25.search(asked, bm25.index(chunks), 10), "query_id", "rank")
    only = bm25.search(asked, bm25.index(chunks), 10, chunks.filter("chunk_id = 'b'"))
    assert {(q, c): s for q, c, s, _ in only.collect()} == {(1, "b"): got[1, "b"]}


def test_embedding_and_nearest(spark):
    docs = spark.createDataFrame([("a", "lambda timeout"), ("b", "bucket policy"), ("c", ""), ("d", "lambda timeout")], "chunk_id string, text string")
    vectors = embedding.embed(docs, "chunk_id", "text", 64)
    got = {r["chunk_id"]: r["vector"] for r in vectors.collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-9 and not any(got["c"]) and got["a"] == got["d"]
    asked = spark.createDataFrame([(1, "lambda timeout")], "query_id long, query string")
    asked = embedding.embed(asked, "query_id", "query", 64)
    assert [r[1] for r in rows(dense.nearest(asked, vectors, 2), "rank")] == ["a", "d"]
    assert dense.nearest(asked, vectors.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        dense.nearest(asked, vectors, 0)


def test_nearest_in_small_blocks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(f"c{i:03}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)] + [("none", None), ("zero", [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [rng.random() for _ in range(4)]) for q in range(9)], "query_id long, vector array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v))
    want = []
    for q, v in ((r["query_id"], r["vector"]) for r in asked.collect()):
        scored = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / size(v) / size(w), 9) + 0.0 if any(w) else 0.0, c) for c, w in rows if w is not None)
        want += [(q, c, k + 1) for k, (_, c) in enumerate(scored[:7])]
    assert rows_of(dense.nearest(asked, vectors, 7)) == want
    best = dense._Best(3, 2)
    import numpy as np

    for a in range(0, 40, 4):
        best.add(np.full((4, 3), 0.5) + (a == 20), 0, np.array([f"n{a + k:02}" for k in range(4)], object))
        if a % 8 == 0:
            best.rows()
    assert best.rows()[2].tolist() == ["n20", "n21"] * 3


def rows_of(found):
    return [(r["query_id"], r["chunk_id"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()]


def test_chunks_without_an_id(spark):
    frame = spark.createDataFrame([("a", "h", "t"), ("", "h", "t"), (None, None, "t")], "chunk_id string, chunk_hash string, text string")
    got = [r["chunk_id"] for r in fusion.identified(frame).collect()]
    assert got[:2] == ["a", "h"] and len(got[2]) == 64


def test_fusion(spark):
    schema = "query_id long, chunk_id string, rank int"
    fused = fusion.fuse({"dense": spark.createDataFrame([(1, "s", 1), (1, "d", 2)], schema), "sparse": spark.createDataFrame([(1, "p", 1), (1, "s", 2)], schema)}, 10)
    first = fused.orderBy("rank").first()
    assert (first["chunk_id"], first["dense_rank"], first["sparse_rank"], first["sources"]) == ("s", 1, 2, "dense,sparse")
    assert abs(first["score"] - (1 / 61 + 1 / 62)) < 1e-9
    twice = fusion.fuse({"dense": spark.createDataFrame([(1, "d", 1), (1, "d", 2)], schema), "sparse": spark.createDataFrame([(1, "d", 1)], schema)}, 10)
    assert twice.count() == 1


def test_rerank(spark):
    schema = "query_id long, query string, chunk_id string, text string, context_summary string, score double, rank int"
    found = spark.createDataFrame([(1, "Lambda timeout", "x", "S3 bucket", None, 0.9, 1), (1, "Lambda timeout", "y", "lambda timeout fix", None, 0.5, 2), (2, "!!!", "z", "t", None, 0.2, 1)], schema)
    got = {r["chunk_id"]: (r["rerank_rank"], r["rerank_score"]) for r in rerank.lexical(found, 5).collect()}
    assert got["y"][0] == 1 and abs(got["y"][1] - (0.7 + 0.3 * 0.5 / 0.9)) < 1e-8
    assert got["x"] == (2, 0.3) and got["z"] == (1, 0.2)

    def broken(candidates, limit):
        raise RuntimeError

    plain, failed = rerank.with_fallback(found, 1, broken)
    assert failed and sorted(r["chunk_id"] for r in plain.collect()) == ["x", "z"]


def blocks(spark, texts, source="guide.pdf"):
    data = [(1, f"c{i}", t, None, source if isinstance(source, str) else source[i], 7, i + 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "query_id long, chunk_id string, text string, context_summary string, source_file string, page_number int, rank int, parent_id string")


def test_context(spark):
    twice = blocks(spark, ["same text"]).union(blocks(spark, ["same text"]).withColumn("rank", F.lit(2)))
    built = context.build(twice).first()
    assert built["context"] == "<retrieved_context>\n[S1] [source: guide.pdf, page: 7]\nsame text\n</retrieved_context>" and built["chunks"] == 1
    assert built["source_map"]["S1"]["chunk_id"] == "c0"
    words = " ".join(["word"] * 100)
    small = context.build(blocks(spark, [words] * 5, [f"f{i}" for i in range(5)]), 80).first()
    assert small["token_count"] == 80 and small["chunks"] == 1
    assert context.build(blocks(spark, ["x"]), 6).count() == 0
    assert context.select_blocks(blocks(spark, ["a", "b", "c"])).count() == 2


def test_parents(spark):
    child = blocks(spark, ["child"]).withColumn("parent_id", F.lit("p"))
    parents = spark.createDataFrame([("p", "parent", "guide.pdf", 3, None, "published"), ("q", "draft", "g", 1, None, "draft")], "chunk_id string, text string, source_file string, page_number int, context_summary string, status string")
    got = context.expand_parents(child, parents).first()
    assert (got["chunk_id"], got["text"], got["child_chunk_id"], got["rank"]) == ("p", "parent", "c0", 1)
    kept = context.expand_parents(child.withColumn("parent_id", F.lit("q")), parents).first()
    assert kept["chunk_id"] == "c0" and kept["child_chunk_id"] is None
    other = context.expand_parents(child.withColumn("parent_id", F.lit("q")).withColumn("status", F.lit("published")), parents, None).first()
    assert (other["chunk_id"], other["status"], other["page_number"]) == ("q", "draft", 1)


def test_citations(spark):
    frame = spark.createDataFrame([("a [S1]",), ("b [S9]",), ("c",)], "t string")
    check = context.validate_citations(F.col("t"), F.array(F.lit("S1")))
    assert [r[0] for r in frame.select(check["valid"]).collect()] == [True, False, False]


def brute_threshold(observed):
    scores = sorted({s for s, _ in observed if s is not None})
    if not scores:
        return 1.0
    tried = [scores[0] - 1e-9, scores[-1] + 1e-9] + [(a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)]
    right = lambda t: sum((s is not None and s >= t) == a for s, a in observed)
    return max(tried, key=lambda t: (right(t), t))


@pytest.mark.parametrize("observed", [[(0.9, True), (0.5, False), (0.7, True), (None, False)], [(0.2, True), (0.2, False)], [(None, True)]])
def test_calibration(spark, observed):
    frame = spark.createDataFrame([(i, s, a) for i, (s, a) in enumerate(observed)], "query_id long, top_score double, answerable boolean")
    assert abs(evaluation.calibrate(frame).first()[0] - brute_threshold(observed)) < 1e-12


def test_evidence_by_rare_words_and_short_pieces(spark):
    texts = {"a": "one two three four", "b": "xone two threex two four", "c": "two  THREE", "d": "", "e": "nothing two"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    pieces = {1: "one two three", 2: "two", 3: "e two t", 4: "absent words here", 5: "two three", 6: "two three two"}
    asked = spark.createDataFrame([(q, [e]) for q, e in pieces.items()] + [(7, None)], "query_id long, evidence array<string>")
    normal = lambda t: " ".join(t.lower().split())
    want = sorted((q, c) for q, e in pieces.items() for c, t in texts.items() if normal(e) in normal(t))
    assert rows(evaluation.evidence_chunks(asked, chunks), "query_id", "chunk_id") == want


def test_recall(spark):
    questions = spark.createDataFrame([(1, ["Alpha  beta"]), (2, ["none"])], "query_id long, evidence array<string>")
    chunks = spark.createDataFrame([("a", "x alpha beta y"), ("b", "ALPHA BETA"), ("c", "z")], "chunk_id string, text string")
    reference = evaluation.evidence_chunks(questions, chunks)
    assert rows(reference, "chunk_id") == [(1, "a"), (1, "b")]
    found = spark.createDataFrame([(1, "a"), (1, "c")], "query_id long, chunk_id string")
    assert rows(evaluation.context_recall(questions, reference, found), "query_id") == [(1, 0.5), (2, 0.0)]


def random_chunks(spark, rng, ids):
    words = [f"w{int(rng.expovariate(0.08))}" for _ in range(4000)]
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"])) for i in ids], "chunk_id string, text string, language string")


def test_pruning_and_segments_change_no_result(spark, tmp_path):
    rng = random.Random(8)
    first = random_chunks(spark, rng, [f"c{k}" for k in range(400)]).cache()
    asked = spark.createDataFrame([(q, " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(12)) + (" w0 w0" if q % 2 else ""), {"language": "de"} if q == 3 else None) for q in range(12)] + [(98, "absent", None), (99, " ", None)], "query_id long, query string, filters map<string,string>")
    ordered = lambda df: df.orderBy("query_id", "rank").select("query_id", "chunk_id", "score", "rank").collect()
    stored = bm25.Stored(spark, str(tmp_path / "index"))
    stored.replace(bm25.index(first))
    own = asked.withColumn("filter_language", F.col("filters")["language"])
    for limit in (1, 5):
        for more in ({}, {"candidates": first.filter("language = 'en'")}, {"candidates": first, "fields": ["language"]}):
            want = ordered(bm25.search(own, bm25.index(first), limit, **more))
            assert want and all(ordered(bm25.search(own, stored.index(), limit, **more, prune=p)) == want for p in (None, False, True))
    # chunks that are added, changed and removed: as a fresh fit
    changed = random_chunks(spark, rng, [f"c{k}" for k in range(350, 500)]).cache()
    stored.refresh(changed, first.join(changed, "chunk_id", "left_semi"))
    gone = changed.filter("substring(chunk_id, -1) = '7'")
    index = stored.refresh(changed.limit(0), gone)
    now = first.join(changed, "chunk_id", "left_anti").unionByName(changed).join(gone, "chunk_id", "left_anti")
    fresh = bm25.index(now)
    compared = lambda i: (sorted(map(tuple, i.terms.collect())), [(r["n"], round(r["avgdl"], 9)) for r in i.corpus.collect()], i.postings.count(), [ordered(bm25.search(asked, i, 5, prune=p)) for p in (False, True)])
    want = compared(fresh)
    assert compared(index) == want
    compact = stored.compact()
    assert len(compact.stored.segments) == 1 and stored.vacuum() == [1, 2, 3] and compared(compact) == want
    plan = bm25.search(asked.limit(1), compact, 5, prune=False)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan[plan.index("PartitionFilters") :][:200]


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "word")], "query_id long, query string")
    stored = bm25.Stored(spark, str(tmp_path / "index"))
    assert bm25.search(asked, stored.refresh(none), 5).count() == 0
    assert [r["chunk_id"] for r in bm25.search(asked, stored.refresh(spark.createDataFrame([("a", "a word")], none.schema)), 5).collect()] == ["a"]
    assert bm25.search(asked.limit(0), stored.index(), 5).count() == 0


def test_an_index_by_chunk_in_segments(spark, tmp_path, monkeypatch):
    """Chunks that are added, changed, removed and added again: as a fresh fit, whether removed ids are broadcast or shuffled."""
    rng = random.Random(18)
    first = random_chunks(spark, rng, [f"c{k}" for k in range(300)]).cache()
    changed = random_chunks(spark, rng, [f"c{k}" for k in range(260, 400)]).cache()
    gone = changed.filter("substring(chunk_id, -1) = '7'")
    back = random_chunks(spark, rng, ["c277", "c500"]).cache()
    now = first.join(changed, "chunk_id", "left_anti").unionByName(changed).join(gone, "chunk_id", "left_anti").unionByName(back)
    asked = spark.createDataFrame([(q, " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(12)) + " w0 w0") for q in range(8)] + [(98, "absent"), (99, " ")], "query_id long, query string")
    ordered = lambda i, **more: bm25.search(asked, i, 5, **more).orderBy("query_id", "rank").select("query_id", "chunk_id", "score", "rank").collect()
    compared = lambda i: (sorted(map(tuple, i.terms.collect())), [(r["n"], round(r["avgdl"], 9)) for r in i.corpus.collect()], i.postings.count(), ordered(i), ordered(i, candidates=first.filter("language = 'en'")))
    want = compared(bm25.index(now))
    for most in (bm25.GONE, 0):
        monkeypatch.setattr(bm25, "GONE", most)
        stored = bm25.StoredTexts(spark, str(tmp_path / f"index{most}"))
        stored.refresh(first)
        stored.refresh(changed, first.join(changed, "chunk_id", "left_semi"))
        stored.refresh(changed.limit(0), gone)
        assert compared(stored.refresh(back)) == want
    none = bm25.StoredTexts(spark, str(tmp_path / "none"))
    assert bm25.search(asked, none.refresh(first.limit(0)), 5).count() == 0 and ordered(none.refresh(back)) == ordered(bm25.index(back))
    assert ordered(none.refresh(back.limit(0), back)) == []


def test_blocks_of_vectors_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(2)
    rows = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(vectors)] + [(900, None, 0)], "chunk_id long, vector array<double>, kind long")
    asked = rows.filter("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "vector", F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 3).alias("filter_kind"))
    want = [tuple(r) for r in dense.nearest(asked, rows, 4, fields=["kind"]).orderBy("query_id", "rank").collect()]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q, c, score, rank in want:
        allowed = [k for k in range(300) if q % 2 or k % 3 == q % 3]
        best = sorted(allowed, key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))
        assert best[rank - 1] == c and abs(score - unit[q] @ unit[c]) < 1e-8
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 50)
    assert [tuple(r) for r in dense.nearest(asked, rows, 4, fields=["kind"]).orderBy("query_id", "rank").collect()] == want and len(want) == 160
    assert dense.nearest(asked.limit(0), rows, 4).count() == dense.nearest(asked, rows.limit(0), 4).count() == 0


def test_evidence_of_any_length(spark):
    texts = ["The red fox", "a fox", "", None, "foxes and Ox", "x"]
    pieces = ["red fox", "fox", "ox", "x", "", "the red fox", "and ox", "absent", None, " fox  "]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame(list(enumerate(pieces)), "query_id long, evidence string")
    found = evaluation.evidence_chunks(asked, chunks)
    low = lambda t: " ".join(t.split()).lower()
    assert sorted(map(tuple, found.collect())) == [(q, c) for q, p in enumerate(pieces) if p is not None for c, t in enumerate(texts) if t is not None and low(p) in low(t)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert evaluation.evidence_chunks(asked.limit(0), chunks).count() == 0


def test_thresholds_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.random() < 0.6, None if rng.random() < 0.1 else round(rng.random(), 2)) for k in range(400)]
    observed = spark.createDataFrame(rows, "query_id long, answerable boolean, top_score double")
    got = {round(r["threshold"], 9): r["accuracy"] for r in evaluation.thresholds(observed).collect()}
    scores = sorted({s for *_, s in rows if s is not None})
    wanted = [scores[0] - 1e-9, scores[-1] + 1e-9, *((a + b) / 2 for a, b in zip(scores[:-1], scores[1:], strict=True))]
    right = lambda t: sum((s is not None and s >= t) == known for _, known, s in rows) / len(rows)
    assert got.keys() == {round(t, 9) for t in wanted} and all(abs(got[round(t, 9)] - right(t)) < 1e-12 for t in wanted)


@pytest.mark.parametrize(("size", "overlap"), [(30, 8), (7, 0), (50, 49)])
def test_chunks_equal_their_sql(size, overlap):
    choice = random.Random(3)
    pieces = ["a", "bb", " ", "\n", "\n\n", ". ", ", ", "; ", "。", "，", "；", "中", "word ", "x" * 30, " " * 5]
    texts = ["".join(choice.choice(pieces[: choice.randint(2, 15)]) for _ in range(choice.randint(0, 300))) for _ in range(200)]
    texts += ["x" * 100, "x" * (size + 1), "x" * size, "", None, "\n\n" * 40, " " * 100, "a. " * 50]
    con = pytest.importorskip("duckdb").connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "source": "s.pdf", "text": texts}))
    got = {}
    for doc_id, number, text in con.sql(f"SELECT doc_id, chunk_ordinal, text FROM ({oracles.recursive_chunks(size, overlap)}) ORDER BY 1, 2").fetchall():
        assert number == len(got.setdefault(doc_id, []))
        got[doc_id].append(text)
    assert got == {i: chunks for i, t in enumerate(texts) if (chunks := split(t, size, overlap) if t else [])}


def test_bins_of_one_id_meet_across_rows_and_tasks(spark):
    """Rows of one id are one text; the tokens of a text are not shuffled, nor grouped in a task's memory."""
    rows = [(1, "a b"), (2, None), (3, "中 x"), (1, "b c"), (None, "d"), (None, "d")] + [(k, f"w{k} w{k + 1}") for k in range(4, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = embedding.embed_long(docs, "doc_id", "text", 16)
    want = {}
    for key, text in rows:
        for token in re.findall("[a-z0-9]+|[一-鿿]", text or ""):
            digest = hashlib.sha256(token.encode()).digest()
            at = key, int.from_bytes(digest[:4], "big") % 16
            want[at] = want.get(at, 0.0) + (1.0 if digest[4] & 1 else -1.0)
    assert {(r["doc_id"], r["idx"]): r["value"] for r in found.collect()} == {k: v for k, v in want.items() if v}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "MapInArrow" in plan


def test_an_index_kept_by_chunk_finds_the_same(spark, tmp_path):
    docs = [(k, " ".join(f"t{k % m}" for m in (2, 3, 5, 7)) + (" 中文中" if k % 4 else " t1 t1")) for k in range(300)] + [(300, None)]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "t1 t1 t4"), (2, "中文 t6"), (3, "nothing"), (4, " ")], "query_id long, query string")
    kept, plain = bm25.save_texts(chunks, f"{tmp_path}/index"), bm25.index(chunks)
    assert rows_of(bm25.search(asked, kept, 7)) == rows_of(bm25.search(asked, plain, 7))
    some = chunks.filter("chunk_id % 3 = 0")
    assert rows_of(bm25.search(asked, kept, 7, some)) == rows_of(bm25.search(asked, plain, 7, some))
    assert sorted(map(tuple, kept.terms.collect())) == sorted(map(tuple, plain.terms.collect())) and kept.corpus.first() == plain.corpus.first()
    assert "MapInArrow" in bm25.search(asked, kept, 7)._jdf.queryExecution().executedPlan().toString()
