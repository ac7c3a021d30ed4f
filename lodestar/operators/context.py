"""Token-budgeted context, parent expansion and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import block_header, block_payload, citations, count_tokens, truncate_to_tokens
from lodestar.operators.filters import positive
from lodestar.operators.fusion import first_wins

# The wrapper, and the tokens it counts.
OPENING, CLOSING = "<retrieved_context>\n", "\n</retrieved_context>"
WRAPPER_TOKENS = 6
MAX_TOKENS, PER_DOCUMENT = 8000, 2


def budget_from_characters(characters: int) -> int:
    """A token budget from a character budget."""
    return characters // 4


def expand_parents(results: DataFrame, parents: DataFrame, status: str | None = "published") -> DataFrame:
    """Results whose parent_id is a known parent's chunk_id become that parent.

    The child's rank and scores stay and its id is kept as child_chunk_id; all other columns that both
    have are the parent's. Parents of another status are not let in by their children; None lets in all."""
    own = ("query_id", "query", "rank", "retrieval_rank", "dense_rank", "sparse_rank", "rerank_rank", "rerank_score", "score", "sources", "backend")
    fields = [c for c in results.columns if c in parents.columns and c not in own]
    known = parents if status is None else parents.filter(F.col("status") == status)
    known = first_wins(known, ["chunk_id"], ["chunk_id"]).select(*[F.col(f).alias(f"_p_{f}") for f in fields])
    joined = results.join(known, F.nullif(F.col("parent_id").cast("string"), F.lit("")) == F.col("_p_chunk_id").cast("string"), "left")
    found = F.col("_p_chunk_id").isNotNull()
    joined = joined.withColumn("child_chunk_id", F.when(found, F.col("chunk_id")))
    return joined.withColumns({f: F.when(found, F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_p_{f}" for f in fields])


def select_blocks(results: DataFrame, max_tokens: int = MAX_TOKENS, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Results (query_id, chunk_id, text, context_summary, source_file, page_number, rank) that the context admits,
    with n (S1 is 1), header, payload (the last may be cut) and tokens.

    A chunk counts once, a document per_document times. Token counts add up, because line ends part
    all pieces; a block is admitted if its header fits behind the whole blocks before it, and none
    is after one that isn't. A cut block uses up what is left, so whole lengths decide alike."""
    positive(max_tokens=max_tokens, per_document=per_document)
    by_rank = ["rank", "chunk_id"]
    once = first_wins(results, ["query_id", "chunk_id"], by_rank)
    file = F.coalesce(F.col("source_file"), F.lit("unknown"))
    capped = once.withColumn("source_file", file).withColumn("_of", F.row_number().over(Window.partitionBy("query_id", "source_file").orderBy(*by_rank))).filter(F.col("_of") <= per_document).drop("_of")
    order = Window.partitionBy("query_id").orderBy(*by_rank)
    blocks = capped.withColumn("n", F.row_number().over(order))
    blocks = blocks.withColumn("header", block_header(F.col("n"), F.col("source_file"), F.col("page_number"))).withColumn("payload", block_payload(F.col("context_summary"), F.col("text")))
    blocks = blocks.withColumn("_head", count_tokens(F.col("header"))).withColumn("_whole", count_tokens(F.col("payload")))
    before = F.coalesce(F.sum(F.col("_head") + F.col("_whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(max_tokens - WRAPPER_TOKENS) - F.col("_before") - F.col("_head")
    blocks = blocks.withColumn("_before", before).withColumn("_left", left)
    fits = ((F.col("_left") > 0) & (F.col("_whole") > 0)).cast("int")
    blocks = blocks.withColumn("_fits", F.min(fits).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_fits = 1")
    tokens = F.col("_head") + F.least(F.col("_whole"), F.col("_left"))
    return blocks.withColumn("tokens", tokens.cast("long")).withColumn("_cut", F.col("_whole") > F.col("_left")).drop("_before", "_fits", "_head", "_whole")


def build(results: DataFrame, max_tokens: int = MAX_TOKENS, per_document: int = PER_DOCUMENT) -> DataFrame:
    """query_id, context, token_count, chunks and source_map (S1 to chunk, file and page); no row for a query without blocks."""
    blocks = select_blocks(results, max_tokens, per_document)
    payload = F.when(F.col("_cut"), truncate_to_tokens(F.col("payload"), F.col("_left"))).otherwise(F.col("payload"))
    blocks = blocks.withColumn("block", F.concat("header", F.lit("\n"), payload)).withColumn("source_id", F.concat(F.lit("S"), F.col("n")))
    source = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "source_file", F.col("page_number").cast("string").alias("page_number"))
    rows = blocks.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks"),
        (F.sum("tokens") + WRAPPER_TOKENS).alias("token_count"),
        F.count("*").alias("chunks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("key"), source.alias("value"))))).alias("source_map"),
    )
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return rows.select("query_id", F.concat(F.lit(OPENING), body, F.lit(CLOSING)).alias("context"), "token_count", "chunks", "source_map")


def validate_citations(answer: Column, known: Column, required: bool = True) -> dict[str, Column]:
    """referenced, invalid and valid of an answer, given an array of known source ids."""
    cited = citations(answer)
    invalid = F.array_except(cited, known)
    enough = F.size(cited) > 0 if required else F.lit(True)
    return {"referenced": cited, "invalid": invalid, "valid": (F.size(invalid) == 0) & enough}
