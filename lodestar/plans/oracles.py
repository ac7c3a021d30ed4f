"""DuckDB SQL of the catalog's queries."""

from __future__ import annotations

from lodestar.operators.chunking import SEPARATORS

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_.:/-]*')"
HASHED = r"regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_.:/-]*|[\x{{4e00}}-\x{{9fff}}]')"
BUDGET = r"len(regexp_extract_all({0}, '[A-Za-z0-9_./:-]+|[\x{{4e00}}-\x{{9fff}}]|[^\s]'))"
_COLLAPSED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _sentence(text: str) -> str:
    value = f"trim({_COLLAPSED.format(text)}, '\"''`- ')"
    found = f"regexp_extract({value}, '^[^.!?。！？]*[.!?。！？]')"
    return (
        f"CASE WHEN {value} = '' THEN 'This chunk contains no usable textual context.' "
        f"ELSE trim(substr(CASE WHEN {found} <> '' THEN {found} ELSE rtrim(substr({value}, 1, 240), ' ,;:，；：') || '.' END, 1, 240)) END"
    )


#: Named pieces and what each needs before it.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "chunks": (
        (),
        f"SELECT d.doc_id AS chunk_id, d.text, d.source AS source_file, d.lang AS language, CASE WHEN l.quality = 1 THEN 'published' ELSE 'draft' END AS status, {_sentence('d.text')} AS context_summary FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "q": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "lengths": (("chunks",), f"SELECT chunk_id, {TOKENS.format('text')} AS ts, len({TOKENS.format('text')}) AS dl FROM chunks"),
    "post": (("lengths",), "SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, dl, unnest(ts) AS term FROM lengths) GROUP BY ALL"),
    "terms": (("post",), "SELECT term, count(*) AS df FROM post GROUP BY term"),
    "corpus": (("lengths",), "SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths"),
    "qt": (("q",), f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM q) GROUP BY ALL"),
    "scores": (
        ("post", "terms", "corpus", "qt"),
        "SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 9) AS score FROM post JOIN terms USING (term) JOIN qt USING (term), corpus GROUP BY ALL",
    ),
    "sparse": (("scores",), "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 30"),
    "tokens": (
        ("chunks", "q"),
        f"SELECT kind, id, token, count(*) AS tf FROM (SELECT 0 AS kind, chunk_id AS id, unnest({HASHED.format('text')}) AS token FROM chunks UNION ALL SELECT 1, query_id, unnest({HASHED.format('query')}) FROM q) GROUP BY ALL",
    ),
    "bins": (
        ("tokens",),
        "SELECT kind, id, (('0x' || substr(sha256(token), 1, 8))::UBIGINT % 384)::INT AS idx, sum(tf * CASE WHEN ('0x' || substr(sha256(token), 10, 1))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value FROM tokens GROUP BY ALL HAVING value <> 0",
    ),
    "norms": (("bins",), "SELECT kind, id, sqrt(sum(value * value)) AS norm FROM bins GROUP BY ALL"),
    "dots": (
        ("norms", "bins"),
        "SELECT x.id AS query_id, y.id AS chunk_id, sum(x.value * y.value) AS dot FROM bins x JOIN bins y ON x.kind = 1 AND y.kind = 0 AND x.idx = y.idx GROUP BY ALL",
    ),
    "dense": (
        ("dots", "norms", "q", "chunks"),
        "SELECT q.query_id, c.chunk_id, round(coalesce(d.dot / nx.norm / ny.norm, 0), 9) + 0.0 AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(d.dot / nx.norm / ny.norm, 0), 9) DESC, c.chunk_id) AS rank FROM q CROSS JOIN chunks c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id LEFT JOIN norms nx ON nx.kind = 1 AND nx.id = q.query_id LEFT JOIN norms ny ON ny.kind = 0 AND ny.id = c.chunk_id QUALIFY rank <= 30",
    ),
    "fused": (
        ("dense", "sparse"),
        "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score, min(CASE WHEN s = 'dense' THEN place END) AS dense_rank, min(CASE WHEN s = 'sparse' THEN place END) AS sparse_rank, string_agg(s, ',' ORDER BY s) AS sources, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + place)), 12) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, rank AS place, 'dense' AS s FROM dense UNION ALL SELECT query_id, chunk_id, rank, 'sparse' FROM sparse) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + place)), 12) DESC, chunk_id) <= 30",
    ),
    "wide": (
        ("dense", "sparse"),
        "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + place)), 12) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, rank AS place FROM dense WHERE rank <= 9 UNION ALL SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 9) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + place)), 12) DESC, chunk_id) <= 9",
    ),
}


def _reranked(name: str, limit: int) -> tuple[tuple[str, ...], str]:
    """The lexical rerank of a ranked piece."""
    body = "coalesce(c.context_summary, '') || chr(10) || coalesce(c.text, '')"
    share = f"len(list_intersect(list_distinct({TOKENS.format('q.query')}), {TOKENS.format(body)}))::DOUBLE / len(list_distinct({TOKENS.format('q.query')}))"
    return (
        (name, "q", "chunks"),
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, before) AS rank FROM (SELECT r.query_id, r.chunk_id, r.rank AS before, c.source_file, c.text, c.context_summary, round(0.7::DOUBLE * ({share}) + (1 - 0.7::DOUBLE) * greatest(0, r.score / CASE WHEN max(abs(r.score)) OVER (PARTITION BY r.query_id) > 0 THEN max(abs(r.score)) OVER (PARTITION BY r.query_id) ELSE 1 END), 9) AS rerank_score FROM (SELECT * FROM {name} WHERE rank <= 20) r JOIN q USING (query_id) JOIN chunks c USING (chunk_id)) QUALIFY rank <= {limit}",
    )


_PARTS["hybrid"], _PARTS["dense_re"], _PARTS["sparse_re"], _PARTS["wide_re"] = _reranked("fused", 5), _reranked("dense", 5), _reranked("sparse", 5), _reranked("wide", 3)
_PARTS["good"] = (("hybrid",), "SELECT * FROM hybrid WHERE rerank_score >= 0.545")


def _blocks(source: str, budget: int, cap: int) -> tuple[tuple[str, ...], str]:
    header = "'[S' || n || '] [source: ' || source_file || ', page: ?]'"
    payload = "CASE WHEN trim(context_summary) <> '' THEN 'Context summary: ' || trim(context_summary) || chr(10) || text ELSE text END"
    return (
        (source,),
        f"""SELECT *, min(CASE WHEN room > 0 AND whole > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n) AS fits FROM (
  SELECT *, {budget - 6} - head - coalesce(sum(head + whole) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM (
    SELECT *, {header} AS header, {BUDGET.format(header)} AS head, {BUDGET.format(payload)} AS whole FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (
        SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) <= {cap})))) QUALIFY fits = 1""",
    )


_PARTS["blocks"], _PARTS["capped"], _PARTS["good_blocks"] = _blocks("hybrid", 1200, 2), _blocks("hybrid", 10**9, 1), _blocks("good", 1200, 2)
_EVIDENCE = "lower(" + _COLLAPSED.format("{0}") + ")"
_PARTS["evidence"] = (("q", "chunks"), f"SELECT DISTINCT q.query_id, c.chunk_id, c.source_file FROM q JOIN chunks c ON contains({_EVIDENCE.format('c.text')}, {_EVIDENCE.format('q.query')})")
_PARTS["observed"] = (
    ("q", "sparse", "evidence", "chunks"),
    """SELECT q.query_id, q.query_id IN (SELECT query_id FROM evidence) AS answerable, max(CASE WHEN s.rank = 1 THEN round(s.score, 6) END) AS top_score,
  min(CASE WHEN (q.query_id, c.source_file) IN (SELECT (query_id, source_file) FROM evidence) THEN s.rank END) AS first,
  count(CASE WHEN s.rank <= 5 AND (q.query_id, c.source_file) IN (SELECT (query_id, source_file) FROM evidence) THEN 1 END) AS matched5, count(CASE WHEN s.rank <= 5 THEN 1 END) AS shown5
  FROM q LEFT JOIN sparse s ON s.query_id = q.query_id AND s.rank <= 10 LEFT JOIN chunks c ON c.chunk_id = s.chunk_id GROUP BY q.query_id""",
)
_PARTS["candidates"] = (
    ("observed",),
    "SELECT (top_score + lead(top_score) OVER (ORDER BY top_score)) / 2 AS threshold FROM (SELECT DISTINCT top_score FROM observed WHERE top_score IS NOT NULL) UNION ALL SELECT min(top_score) - 1e-9::DOUBLE FROM observed UNION ALL SELECT max(top_score) + 1e-9::DOUBLE FROM observed",
)
_PARTS["calibrated"] = (
    ("candidates", "observed"),
    "SELECT coalesce((SELECT threshold FROM (SELECT threshold, avg(CASE WHEN coalesce(top_score >= threshold, false) = answerable THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM candidates, observed WHERE threshold IS NOT NULL GROUP BY threshold) ORDER BY accuracy DESC, threshold DESC LIMIT 1), 1.0) AS threshold",
)


_PARTS["answer_blocks"] = _blocks("good", 8000, 2)
_UNIT = r"(?:\s*(?:[A-Za-z0-9_./:-]+|[\x{4e00}-\x{9fff}]|[^\s]))"
_PAYLOAD = "CASE WHEN trim(context_summary) <> '' THEN 'Context summary: ' || trim(context_summary) || chr(10) || text ELSE text END"
_PARTS["strings"] = (
    ("blocks",),
    f"SELECT query_id, n, head + least(whole, room) AS tokens, header || chr(10) || CASE WHEN whole > room THEN regexp_extract({_PAYLOAD}, '^{_UNIT}{{' || least(room, 1000) || '}}{_UNIT}{{' || greatest(room - 1000, 0) || '}}') ELSE {_PAYLOAD} END AS block FROM blocks",
)
_PARTS["shown"] = (("hybrid", "q"), "SELECT query_id, count(*) AS final_chunks FROM hybrid GROUP BY 1")
_METRICS = """SELECT '{mode}' AS mode, round(threshold, 6) AS threshold, round(sum(CASE WHEN answerable AND first <= 5 THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS recall_at_5,
  round(sum(CASE WHEN answerable AND first <= 10 THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS recall_at_10,
  round(sum(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first, 0) ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS mrr,
  round(sum(CASE WHEN answerable AND shown5 > 0 THEN matched5::DOUBLE / shown5 ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS context_precision,
  round(sum(CASE WHEN NOT answerable AND NOT coalesce(top_score >= threshold, false) THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN NOT answerable THEN 1 END), 1), 6) AS refusal_accuracy,
  round(sum(CASE WHEN answerable AND coalesce(top_score >= threshold, false) THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS acceptance_accuracy
  FROM {observed}, {calibrated} GROUP BY threshold"""
_PARTS["dense_re10"], _PARTS["hybrid10"] = _reranked("dense", 10), _reranked("fused", 10)


def _mode(name: str, source: str, score: str) -> None:
    """Pieces observed_<name> and calibrated_<name>: a mode's judged questions and its threshold."""
    expected = "(q.query_id, c.source_file) IN (SELECT (query_id, source_file) FROM evidence)"
    _PARTS[f"observed_{name}"] = (
        ("q", source, "evidence", "chunks"),
        f"""SELECT q.query_id, q.query_id IN (SELECT query_id FROM evidence) AS answerable, max(CASE WHEN s.rank = 1 THEN s.{score} END) AS top_score, min(CASE WHEN {expected} THEN s.rank END) AS first,
  count(CASE WHEN s.rank <= 5 AND {expected} THEN 1 END) AS matched5, count(CASE WHEN s.rank <= 5 THEN 1 END) AS shown5
  FROM q LEFT JOIN {source} s ON s.query_id = q.query_id AND s.rank <= 10 LEFT JOIN chunks c ON c.chunk_id = s.chunk_id GROUP BY q.query_id""",
    )
    for piece in ("candidates", "calibrated"):
        _PARTS[f"{piece}_{name}"] = (
            (f"observed_{name}", *((f"candidates_{name}",) if piece == "calibrated" else ())),
            _PARTS[piece][1].replace("observed", f"observed_{name}").replace("FROM candidates", f"FROM candidates_{name}"),
        )


_MODES = {"dense": ("dense", "score"), "dense+rerank": ("dense_re10", "rerank_score"), "hybrid+rerank": ("hybrid10", "rerank_score")}
for _name, (_source, _score) in _MODES.items():
    _mode(_name.replace("+", "_"), _source, _score)


def _with(names: tuple[str, ...], select: str) -> str:
    """select after the pieces it needs, each once and after its own needs."""
    order: list[str] = []

    def need(name: str) -> None:
        for before in _PARTS[name][0]:
            need(before)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + " " + select


_HASH = f"sha256({_STRIPPED.format('text')})"
_ODD = f"SELECT {_HASH} AS chunk_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1"
_EVEN = f"SELECT {_HASH} FROM documents WHERE doc_id % 2 = 0"
_CLEAN = "html"
for _pattern, _by in (
    (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"<[^>]+>", " "),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_by}', 'g')"
for _entity, _by in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_entity}', '{_by}')"
for _pattern, _by in (
    (r"(?m)^(?:\s{0,3}#{1,6}\s+|\s*>\s?|\s*[-*_]{3,}\s*$)", ""), (r"\*\*|__|~~|`{1,3}", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (r"\r\n", "\n"), (r"\r", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_by}', 'g')"


def _nearest(where: str) -> str:
    return f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INT AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND {where}) WHERE rank <= 10"""


_TOP = "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM {0} WHERE rank <= 10"
_RERANKED = "SELECT query_id, chunk_id, rank::INT AS rank, '{1}+rerank' AS backend, round(rerank_score, 6) AS score FROM {0}"
_CITED = "list_distinct(['S' || (turn % 5), 'S1'])"

def _literal(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


def recursive_chunks(size: int, overlap: int) -> str:
    """Chunks of documents: texts are cut at ever weaker separators until every part is shorter than `size`, then runs of parts are packed, a chunk a step."""
    separators = "[" + ", ".join(map(_literal, SEPARATORS)) + "]"
    stripped = _STRIPPED.format("substr(d.text, (p.off + c[a] + 1)::BIGINT, (c[b] - c[a])::BIGINT)")
    return rf"""WITH RECURSIVE cuts AS (
  SELECT doc_id, 0 AS depth, 0::BIGINT AS parent, 0::BIGINT AS run, 0::BIGINT AS off, text AS part, 0 AS tried, true AS open FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, depth + 1, base, (sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER before)::BIGINT, base + (sum(length(piece)) OVER before)::BIGINT - length(piece), piece, use, length(piece) >= {size} AND use < {len(SEPARATORS)}
  FROM (SELECT doc_id, depth, off AS base, use, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (
    SELECT doc_id, depth, off, use, CASE WHEN use = {len(SEPARATORS)} THEN list_transform(range(1, length(part) + 1), lambda k: substr(part, k, 1)) ELSE list_filter(list_prepend(string_split(part, sep)[1], list_transform(string_split(part, sep)[2:], lambda p: sep || p)), lambda p: p <> '') END AS pieces
    FROM (SELECT *, {separators}[use] AS sep FROM (SELECT doc_id, depth, off, part, list_position(list_transform({separators}, lambda s, k: k > tried AND contains(part, s)), true) AS use FROM cuts WHERE open))))
  WINDOW before AS (PARTITION BY doc_id, depth, base ORDER BY i)),
runs AS (SELECT doc_id, min(off) AS off, list_prepend(0::BIGINT, list(off + length(part) - first_off ORDER BY off)) AS c FROM (SELECT *, min(off) OVER (PARTITION BY doc_id, depth, parent, run) AS first_off FROM cuts WHERE NOT open) GROUP BY doc_id, depth, parent, run),
packed AS (
  SELECT doc_id, off, c, 1::BIGINT AS a, len(list_filter(c, lambda x: x <= {size}))::BIGINT AS b FROM runs
  UNION ALL
  SELECT doc_id, off, c, a, len(list_filter(c, lambda x: x <= c[a] + {size}))::BIGINT FROM (
    SELECT doc_id, off, c, 1 + len(list_filter(c, lambda x: x < greatest(c[b] - {overlap}, c[b + 1] - {size})))::BIGINT AS a FROM packed WHERE b < len(c))),
found AS (SELECT p.doc_id, d.source, p.off + c[a] AS start, {stripped} AS text FROM packed p JOIN documents d ON d.doc_id = p.doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_ordinal, sha256(text) AS chunk_hash, text, CASE WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh-CN' ELSE 'en' END AS language, CASE WHEN lower(source) LIKE '%.pdf' THEN 'pdf' ELSE 'markdown' END AS document_type, 'published' AS status FROM found WHERE text <> ''"""


SQL: dict[str, str] = {
    "clean_text_pages": rf"SELECT page_id, regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g') AS clean FROM pages",
    "first_sentence": f"SELECT doc_id, {_sentence('text')} AS sentence FROM documents",
    "bm25_token_counts": f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::BIGINT AS n_distinct FROM documents",
    "hash_tokens": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({HASHED.format('text')}) AS token FROM documents) GROUP BY ALL",
    "count_tokens": f"SELECT doc_id, {BUDGET.format('text')}::BIGINT AS n_tokens FROM documents",
    "chunk_metadata": rf"""SELECT doc_id, chunk_hash, CASE WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh-CN' ELSE 'en' END AS language, CASE WHEN lower(source) LIKE '%.pdf' THEN 'pdf' ELSE 'markdown' END AS document_type,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT *, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || chunk_hash::BLOB) AS h FROM (SELECT *, {_HASH} AS chunk_hash FROM documents))""",
    "normalized_evidence": f"SELECT item_id, {_EVIDENCE.format('text')} AS evidence FROM benchmark",
    "recursive_chunks": recursive_chunks(512, 64),
    "dedup_first_wins": f"SELECT {_HASH} AS chunk_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "existing_semi": f"SELECT chunk_hash FROM ({_ODD}) WHERE chunk_hash IN ({_EVEN})",
    "pending_anti": f"SELECT chunk_hash, doc_id FROM ({_ODD}) WHERE chunk_hash NOT IN ({_EVEN})",
    "upsert_merge": f"SELECT chunk_hash, coalesce(min(CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN doc_id END), min(doc_id)) AS doc_id FROM (SELECT {_HASH} AS chunk_hash, doc_id FROM documents) GROUP BY 1",
    "upsert_store": "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' revised' ELSE coalesce(text, '') END) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "index_refresh": _with(("sparse",), "SELECT query_id, chunk_id::BIGINT AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 10").replace(
        f"chunks AS ({_PARTS['chunks'][1]})",
        "chunks AS (SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' revised' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id IS NOT NULL AND doc_id % 5 <> 0)",
    ),
    "ingestion_stats": f"SELECT coalesce(sum(n), 0)::BIGINT AS created, count(*) AS unique_chunks, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, count(CASE WHEN known THEN 1 END) AS existing, count(CASE WHEN NOT known THEN 1 END) AS pending FROM (SELECT chunk_hash, n, chunk_hash IN ({_EVEN}) AS known FROM (SELECT {_HASH} AS chunk_hash, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1))",
    "hash_embedding_long": _with(("bins",), "SELECT id AS doc_id, idx, value FROM bins WHERE kind = 0"),
    "vector_dimensions": "SELECT len(embedding)::BIGINT AS dimensions, count(*) AS vectors FROM embeddings GROUP BY 1",
    "dense_topk": _nearest("true"),
    "dense_topk_filtered": _nearest("b.label = 1"),
    "store_counts": _with(("chunks", "post", "terms"), "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks) AS vectors, (SELECT count(*) FROM post) AS postings, (SELECT sum(tf) FROM post)::BIGINT AS tokens, (SELECT count(*) FROM terms) AS terms"),
    "bm25_term_stats": _with(("terms",), "SELECT term, df FROM terms"),
    "bm25_corpus_stats": _with(("corpus",), "SELECT n, round(avgdl, 6) AS avgdl FROM corpus"),
    "bm25_topk": _with(("sparse",), _TOP.format("sparse")),
    "bm25_filtered_topk": _with(
        ("scores", "chunks"),
        "SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, round(score, 6) AS score FROM scores JOIN chunks USING (chunk_id) WHERE language = 'en' AND status = 'published' QUALIFY rank <= 10",
    ),
    "hashed_dense_topk": _with(("dense",), _TOP.format("dense")),
    "rrf_fusion": _with(("fused",), "SELECT query_id, chunk_id, rank::INT AS rank, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, sources, round(score, 9) AS score FROM fused"),
    "hybrid_rerank": _with(("hybrid",), _RERANKED.format("hybrid", "hybrid")),
    "dense_rerank": _with(("dense_re",), _RERANKED.format("dense_re", "dense")),
    "sparse_rerank": _with(("sparse_re",), _RERANKED.format("sparse_re", "sparse")),
    "dense_only": _with(("dense",), "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM dense WHERE rank <= 5"),
    "hybrid_wide": _with(("wide_re",), "SELECT query_id, chunk_id, rank::INT AS rank, round(rerank_score, 6) AS score FROM wide_re"),
    "relevance_threshold": _with(("good",), "SELECT query_id, chunk_id, rank::INT AS rank FROM good"),
    "context_selection": _with(("blocks",), "SELECT query_id, chunk_id, n::INT AS n, (head + least(whole, room))::BIGINT AS tokens, header FROM blocks"),
    "per_document_cap": _with(("capped",), "SELECT query_id, source_file, chunk_id, n::INT AS n FROM capped"),
    "refusal_decision": _with(
        ("q", "hybrid", "good", "good_blocks"),
        "SELECT query_id, reason <> '' AS refused, reason FROM (SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM hybrid) THEN 'no_retrieval_results' WHEN query_id NOT IN (SELECT query_id FROM good) THEN 'below_relevance_threshold' WHEN query_id NOT IN (SELECT query_id FROM good_blocks) THEN 'empty_context' ELSE '' END AS reason FROM q)",
    ),
    "parent_expansion": _with(
        ("chunks",),
        "SELECT c.chunk_id AS own_id, coalesce(p.chunk_id, c.chunk_id) AS chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN c.chunk_id END AS child_chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN p.source_file ELSE c.source_file END AS source_file FROM chunks c LEFT JOIN chunks p ON c.chunk_id % 10 <> 0 AND p.chunk_id = c.chunk_id - c.chunk_id % 10 AND p.status = 'published'",
    ),
    "citation_validation": "SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN 'S1' ELSE 'S' || (turn % 5) || ',S1' END AS referenced, CASE WHEN turn % 5 IN (0, 4) THEN 'S' || (turn % 5) ELSE '' END AS invalid, turn % 5 NOT IN (0, 4) AS valid FROM conversations",
    "evidence_containment": _with(("evidence",), "SELECT query_id, chunk_id FROM evidence"),
    "threshold_calibration": _with(("calibrated",), "SELECT round(threshold, 6) AS threshold FROM calibrated"),
    "retrieval_metrics": _with(
        ("observed", "calibrated"),
        """SELECT round(threshold, 6) AS threshold, round(sum(CASE WHEN answerable AND first <= 5 THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS recall_at_5,
  round(sum(CASE WHEN answerable AND first <= 10 THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS recall_at_10,
  round(sum(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first, 0) ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS mrr,
  round(sum(CASE WHEN answerable AND shown5 > 0 THEN matched5::DOUBLE / shown5 ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS context_precision,
  round(sum(CASE WHEN NOT answerable AND NOT coalesce(top_score >= threshold, false) THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN NOT answerable THEN 1 END), 1), 6) AS refusal_accuracy,
  round(sum(CASE WHEN answerable AND coalesce(top_score >= threshold, false) THEN 1.0::DOUBLE ELSE 0 END) / greatest(count(CASE WHEN answerable THEN 1 END), 1), 6) AS acceptance_accuracy
  FROM observed, calibrated GROUP BY threshold""",
    ),
    "truncated_texts": f"SELECT doc_id, CASE WHEN {BUDGET.format('text')} > 50 THEN regexp_extract(text, '^{_UNIT}{{50}}') ELSE text END AS head FROM documents",
    "context_strings": _with(
        ("strings",),
        "SELECT query_id, '<retrieved_context>' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n) || chr(10) || '</retrieved_context>' AS context, (sum(tokens) + 6)::BIGINT AS token_count, count(*) AS chunks FROM strings GROUP BY 1",
    ),
    "retrieval_diagnostics": _with(
        ("q", "dense", "sparse", "fused", "shown"),
        "SELECT query_id, (SELECT count(*) FROM dense d WHERE d.query_id = q.query_id) AS dense_candidates, (SELECT count(*) FROM sparse d WHERE d.query_id = q.query_id) AS sparse_candidates, (SELECT count(*) FROM fused d WHERE d.query_id = q.query_id) AS fused, (SELECT count(*) FROM fused d WHERE d.query_id = q.query_id AND d.rank <= 20) AS reranked_candidates, coalesce((SELECT final_chunks FROM shown d WHERE d.query_id = q.query_id), 0)::BIGINT AS final_chunks, 'hybrid' AS mode, false AS reranker_fallback FROM q",
    ),
    "answers": _with(
        ("q", "hybrid", "good", "answer_blocks"),
        """SELECT query_id, CASE WHEN reason IS NULL THEN line || ' [S1]' ELSE '知识库无法回答该问题。' END AS answer, reason IS NOT NULL AS refused, reason AS refusal_reason, coalesce(chunks, results, 0)::BIGINT AS final_chunks, coalesce(tokens, 0)::BIGINT AS context_tokens
  FROM (SELECT q.query_id, r.results, b.chunks, b.tokens, b.line, CASE WHEN r.results IS NULL THEN 'no_retrieval_results' WHEN g.n IS NULL THEN 'below_relevance_threshold' WHEN b.chunks IS NULL THEN 'empty_context' END AS reason
    FROM q LEFT JOIN (SELECT query_id, count(*) AS results FROM hybrid GROUP BY 1) r USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM good GROUP BY 1) g USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS chunks, sum(head + least(whole, room)) + 6 AS tokens, max(CASE WHEN n = 1 THEN split_part('Context summary: ' || trim(context_summary), chr(10), 1) END) AS line FROM answer_blocks GROUP BY 1) b USING (query_id))""",
    ),
    "mode_metrics": _with(
        tuple(f"{piece}_{m.replace('+', '_')}" for m in _MODES for piece in ("observed", "calibrated")),
        " UNION ALL ".join(_METRICS.format(mode=m, observed=f"observed_{m.replace('+', '_')}", calibrated=f"calibrated_{m.replace('+', '_')}") for m in _MODES),
    ),
    "question_recall": _with(
        ("q", "evidence", "wide_re"),
        "SELECT q.query_id, round(coalesce(count(s.chunk_id)::DOUBLE / nullif(count(e.chunk_id), 0), 0), 6) AS recall FROM q LEFT JOIN evidence e ON e.query_id = q.query_id LEFT JOIN wide_re s ON s.query_id = e.query_id AND s.chunk_id = e.chunk_id GROUP BY q.query_id",
    ),
    "cjk_tokens": f"""WITH t AS (SELECT doc_id, translate(text, 'aeiou', '\u4e00\u4e01\u4e03\u4e07\u4e09') AS text FROM documents), s AS (SELECT doc_id, {TOKENS.format('text')} AS latin, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]') AS single FROM t),
ts AS (SELECT doc_id, list_concat(latin, single, list_transform(range(1, greatest(len(single), 1)), lambda i: single[i] || single[i + 1])) AS ts FROM s)
SELECT doc_id, unnest(range(0, len(ts)))::BIGINT AS at, unnest(ts) AS token FROM ts""",
    "incremental_ingest_stream": f"SELECT DISTINCT chunk_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT *, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || chunk_hash::BLOB) AS h FROM (SELECT {_HASH} AS chunk_hash FROM documents WHERE text IS NOT NULL))",
    "context_recall": _with(
        ("q", "evidence", "sparse"),
        "SELECT q.query_id, round(coalesce(count(s.chunk_id)::DOUBLE / nullif(count(e.chunk_id), 0), 0), 6) AS recall FROM q LEFT JOIN evidence e ON e.query_id = q.query_id LEFT JOIN sparse s ON s.query_id = e.query_id AND s.chunk_id = e.chunk_id AND s.rank <= 3 GROUP BY q.query_id",
    ),
}
