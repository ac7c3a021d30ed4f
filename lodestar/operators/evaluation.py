"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.jobs import broadcast_if_small, cut
from lodestar.functions.text import normalize_evidence

DIGITS = 9
EDGE = 1e-9
#: Characters of the strings that lead to the texts of a short piece of evidence.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters in a text; none of a shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _holding(asked: DataFrame, texts: DataFrame, keys: Column, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the texts (chunk_id, body) that hold a piece (query_id, evidence, keys).

    Whatever holds a piece has all its keys among its own, so the texts of its rarest key are all that are looked at."""
    asked = cut(asked)
    wanted = broadcast_if_small(asked.select(F.explode("keys").alias("key")).distinct())
    held = cut(texts.select("chunk_id", F.explode(keys).alias("key")).join(wanted, "key", "left_semi"))
    counts = held.groupBy("key").agg(F.count("*").alias("n"))
    keyed = asked.select("query_id", "evidence", F.explode("keys").alias("key")).join(counts, "key", "left")
    rarest = keyed.groupBy("query_id", "evidence").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    pairs = rarest.join(held, "key").select("query_id", "evidence", "chunk_id")
    # the texts themselves meet the pairs: what is joined is normalized, not all
    met = chunks.select("chunk_id", "text").join(broadcast_if_small(cut(pairs)), "chunk_id")
    return met.filter(normalize_evidence(F.col("text")).contains(F.col("evidence"))).select("query_id", "chunk_id")


def evidence_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of chunks whose text holds one of a question's pieces of evidence.

    questions: query_id and evidence (a string or an array of them). Keys that a piece shares with every text that holds it
    lead to the texts: of three words or more the words but the first and last, which are whole words
    there too; of fewer words its strings of GRAM characters, or the piece itself if it is shorter. An empty piece is in all texts."""
    pieces = F.col("evidence") if dict(questions.dtypes)["evidence"].startswith("array") else F.array("evidence")
    asked = questions.select("query_id", F.explode(pieces).alias("evidence")).select("query_id", normalize_evidence(F.col("evidence")).alias("evidence")).filter("evidence is not null").distinct()
    texts = chunks.select("chunk_id", normalize_evidence(F.col("text")).alias("body"))
    words = F.split("evidence", " ")
    asked = cut(asked.withColumn("size", F.when(F.size(words) > 2, F.lit(-1)).otherwise(F.least(F.length("evidence"), F.lit(GRAM)))))
    found = None
    for size in sorted(r[0] for r in asked.select("size").distinct().collect()):  # five values at most
        own = asked.filter(F.col("size") == size)
        if size < 0:
            rows = _holding(own.withColumn("keys", F.array_distinct(F.slice(words, 2, F.size(words) - 2))), texts, F.array_distinct(F.split("body", " ")), chunks)
        elif size:
            rows = _holding(own.withColumn("keys", _grams(F.col("evidence"), size)), texts, _grams(F.col("body"), size), chunks)
        else:
            rows = _holding(own.withColumn("keys", F.array(F.lit(""))), texts.filter("body is not null"), F.array(F.lit("")), chunks)
        found = rows if found is None else found.union(rows)
    return texts.limit(0).join(asked.limit(0), F.lit(False)).select("query_id", "chunk_id") if found is None else found.distinct()


def judged(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Per question: answerable, top_score, first (rank of the first match), matched5 and shown5.

    questions: query_id, answerable, expected_sources; results: query_id, rank, score, source_file."""
    hits = questions.join(results, "query_id", "left")
    match = F.coalesce(F.array_contains("expected_sources", F.col("source_file")), F.lit(False))
    return hits.groupBy("query_id", "answerable").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.min(F.when(match, F.col("rank"))).alias("first"),
        F.count(F.when(match & (F.col("rank") <= 5), 1)).alias("matched5"),
        F.count(F.when(F.col("rank") <= 5, 1)).alias("shown5"),
    )


def thresholds(observed: DataFrame) -> DataFrame:
    """(threshold, accuracy) of every candidate: beyond either end of the top scores and between neighbours.

    Scores are counted once and summed up from the greatest: what is accepted at a threshold is a
    running sum. Distinct scores are dealt by ranges; each range sums up its own and is shifted by the
    ranges before it, of which one row of sums and ends goes to all tasks."""
    counts = observed.filter("top_score is not null").groupBy("top_score").agg(F.count(F.when(F.col("answerable"), 1)).alias("known"), F.count(F.when(~F.col("answerable"), 1)).alias("unknown"))
    every = observed.agg(F.count("*").alias("all"), F.count(F.when(~F.col("answerable"), 1)).alias("refusable"))
    falling = counts.repartitionByRange(F.desc("top_score")).sortWithinPartitions(F.desc("top_score"))
    placed = cut(falling.withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)))
    ranges = placed.groupBy("part").agg(F.sum("known").alias("known"), F.sum("unknown").alias("unknown"), F.max("top_score").alias("high"), F.min("top_score").alias("low"))
    ends = ranges.agg(F.collect_list(F.struct("part", "known", "unknown", "high", "low")).alias("ranges"))
    rows = placed.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(every))
    line = Window.partitionBy("part").orderBy(F.desc("top_score"))
    earlier, later = F.filter("ranges", lambda r: r["part"] < F.col("part")), F.filter("ranges", lambda r: r["part"] > F.col("part"))
    above = lambda c: F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.aggregate(earlier, F.lit(0).cast("long"), lambda total, r: total + r[c])
    next_ = F.coalesce(F.lead("top_score").over(line), F.array_max(F.transform(later, lambda r: r["high"])))
    last = F.coalesce(F.lag("top_score").over(line), F.array_min(F.transform(earlier, lambda r: r["low"])))
    rows = rows.select("top_score", "all", "refusable", next_.alias("next"), last.alias("last"), above("known").alias("right"), above("unknown").alias("wrong"))
    accuracy = lambda right, wrong: (right + F.col("refusable") - wrong) / F.col("all")
    below = F.struct(F.coalesce((F.col("top_score") + F.col("next")) / 2, F.col("top_score") - EDGE).alias("threshold"), accuracy(F.col("right"), F.col("wrong")).alias("accuracy"))
    beyond = F.when(F.col("last").isNull(), F.struct((F.col("top_score") + EDGE).alias("threshold"), accuracy(F.lit(0), F.lit(0)).alias("accuracy")))
    return rows.select(F.explode(F.array(below, beyond)).alias("t")).filter("t is not null").select("t.*")


def calibrate(observed: DataFrame) -> DataFrame:
    """One row: the most accurate threshold, of equal ones the greatest; 1.0 without scores."""
    best = thresholds(observed).agg(F.max_by("threshold", F.struct("accuracy", "threshold")).alias("threshold"))
    return best.select(F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def metrics(observed: DataFrame) -> DataFrame:
    """One row of recall, reciprocal rank, precision, refusal and acceptance at the calibrated threshold."""
    rows = observed.crossJoin(F.broadcast(calibrate(observed)))
    known, unknown = F.col("answerable"), ~F.col("answerable")
    part = lambda value, which: F.coalesce(F.sum(F.when(which, value)) / F.greatest(F.count(F.when(which, 1)), F.lit(1)), F.lit(0.0))
    accepted = F.coalesce(F.col("top_score") >= F.col("threshold"), F.lit(False))
    return rows.groupBy("threshold").agg(
        part(F.coalesce(F.col("first") <= 5, F.lit(False)).cast("double"), known).alias("recall_at_5"),
        part(F.coalesce(F.col("first") <= 10, F.lit(False)).cast("double"), known).alias("recall_at_10"),
        part(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), known).alias("mrr"),
        part(F.when(F.col("shown5") > 0, F.col("matched5") / F.col("shown5")).otherwise(0.0), known).alias("context_precision"),
        part((~accepted).cast("double"), unknown).alias("refusal_accuracy"),
        part(accepted.cast("double"), known).alias("acceptance_accuracy"),
    )


def context_recall(questions: DataFrame, reference: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id and recall: the share of reference chunks that were retrieved; 0 without a reference."""
    got = retrieved.select("query_id", "chunk_id").distinct().withColumn("got", F.lit(1))
    shares = reference.join(got, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("got") / F.count("*")).alias("recall"))
    return questions.select("query_id").join(shares, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))
