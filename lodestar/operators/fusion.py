"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.filters import positive

RANK_CONSTANT = 60
DIGITS = 12


def identified(chunks: DataFrame) -> DataFrame:
    """chunks with a chunk_id in every row: where it is missing or empty, the chunk_hash, else the text's hash."""
    if dict(chunks.dtypes)["chunk_id"] != "string":
        return chunks
    known = [F.nullif(F.col(c), F.lit("")) for c in ("chunk_id", "chunk_hash") if c in chunks.columns]
    return chunks.withColumn("chunk_id", F.coalesce(*known, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))


def first_wins(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def fuse(rankings: dict[str, DataFrame], limit: int, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    """query_id, chunk_id, score, dense_rank, sparse_rank, sources, rank.

    rankings: source name to (query_id, chunk_id, rank), in order of precedence. A list votes once for
    a chunk, by its first place; the vote is 1 / (rank_constant + place), ties go to the lesser id."""
    positive(rank_constant=rank_constant)
    votes: DataFrame | None = None
    for name, ranked in rankings.items():
        place = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
        own = ranked.select("query_id", "chunk_id", F.row_number().over(place).alias("place"), F.lit(name).alias("source"))
        own = own.groupBy("query_id", "chunk_id", "source").agg(F.min("place").alias("place"))
        votes = own if votes is None else votes.unionByName(own)
    # the few votes are dealt anew here, lest plans above rely on how a union happens to be partitioned
    votes = votes.repartition("query_id", "chunk_id")
    rank_of = lambda name: F.min(F.when(F.col("source") == name, F.col("place"))).alias(f"{name}_rank")
    fused = votes.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rank_constant + F.col("place"))), DIGITS).alias("score"), rank_of("dense"), rank_of("sparse"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
