"""Mixing sources to target weights by systematic sampling (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, md5_bits, unused, words_count

#: Expected copies are held in units of 1 / UNIT, so that prefix sums are exact and reruns agree.
UNIT = 1 << 24
#: Hash ranges of a size class, at least, and rows of the whole for each further one.
SALTS, ROWS_PER_SALT = 64, 1 << 20


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_ratio: float = 3.0, share: float = 1.0) -> DataFrame:
    """Per source: source_size and target.

    Sources, by code point with null last, take the weights in turn. The total (share of all sizes)
    is dealt by weight; a target stops at max_ratio times its source's size and the excess is dealt
    anew among the others until none is above: sources are taken by rising cap per weight, and the
    first whose cap isn't reached by what is left shows the level for all that follow.
    One row per source runs through the single-partition windows here; documents don't."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", pick)
    named = named.withColumn("cap", F.col("source_size") * F.lit(float(max_ratio))).withColumn("total", F.sum("source_size").over(one) * F.lit(float(share)))
    rising = one.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    level = named.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    level = level.withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("free", F.col("cap") * F.col("open") > F.col("weight") * F.col("left"))
    level = level.withColumn("first", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("left"), F.col("open")))).over(one))
    target = F.when(F.col("free"), F.col("weight") * F.col("first.left") / F.col("first.open")).otherwise(F.col("cap"))
    return level.select("source", "source_size", "rank", target.alias("target"))


def size_class(size: Column) -> Column:
    """A number that rises with the size, in steps of an eighth of a power of two."""
    digits = F.length(F.bin(size))
    return (digits * 8 + F.expr("cast(shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7 as int)")).cast("int")


def draw_copies(rows: DataFrame, offset_seed: str, ties: tuple[str, ...] = (), salts: int = SALTS) -> DataFrame:
    """Adds `copies` to rows with source_rank, size, doc_id and long `expected` (in 1 / UNIT).

    Expected copies are prefix-summed within a source, in order of size class, hash of the id, size
    and id, one offset drawn from the seed and the source is added, and a row is emitted once for
    every whole unit its own step crosses. The order by size makes each source's words come near its
    target. A class's rows are cut by ranges of the hash into salts (a power of two) groups, whose
    sums shift the later ones: a source that holds most rows is spread over many tasks, and how many
    doesn't change the result."""
    group = ["source_rank", "class", "salt"]
    spread = md5_bits(F.col("doc_id"))
    salted = rows.withColumn("class", size_class(F.col("size"))).withColumn("spread", spread).withColumn("salt", F.shiftright("spread", 52 - salts.bit_length() + 1).cast("int"))
    sums = salted.groupBy(*group).agg(F.sum("expected").alias("step"))
    earlier = Window.partitionBy("source_rank").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(sums.select(*group, F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("shift")))
    within = Window.partitionBy(*group).orderBy("spread", "size", "doc_id", *ties).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{offset_seed}/"), F.col("source_rank").cast("string"))), 1, 6), 16, 10).cast("long")
    upto = salted.withColumn("upto", F.sum("expected").over(within)).join(broadcast_checked(shifts, 200_000), group)
    end = F.col("shift") + F.col("upto") + offset
    copies = F.floor(end / F.lit(UNIT)) - F.floor((end - F.col("expected")) / F.lit(UNIT))
    return upto.withColumn("copies", copies.cast("long")).drop("class", "salt", "spread", "upto", "shift")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_ratio: float = 3.0,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row, and the columns ties.

    Null or empty texts have size 0 and take nothing but may be drawn; a source without words has
    target 0; null is a source of its own, the last; rows of one id (null too) are drawn apart,
    and those of one size are interchangeable unless the columns ties put them in order; an empty table
    gives no rows. Other columns aren't read. The sizes are checkpointed, so texts are read once."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_count(F.col(text_col)).alias("size"), *ties))
    salts = max(SALTS, 1 << (sized.count() // ROWS_PER_SALT).bit_length())
    goal = broadcast_checked(cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_ratio, share)), 100_000)
    wanted = goal.withColumnRenamed("source", "goal_source").withColumnRenamed("rank", "source_rank")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("long")
    rows = sized.join(wanted, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("expected", rate)
    drawn = draw_copies(rows, seed, ties, salts)
    return drawn.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *ties)


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as mix() draws it, with their columns, which may have any names.

    Rows are told apart by two hashes of all their columns (those of map type aside), never by their
    place, and meet their copies by these, so that neither null nor repeated ids share a task. Rows
    that agree in all columns are the same row several times: they come as often as all of them were drawn."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    keys = unused(docs, "key0", "key1")
    copies_of, rows_of, times, copy = unused(docs, "copies", "rows", "times", "copy")
    keyed = docs.withColumns({name: F.xxhash64(F.lit(k), *[c.isNull() for c in columns], *columns) for k, name in enumerate(keys)})
    plain = keyed.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"), (keys[0], "key0"), (keys[1], "key1"))])
    found = mix(plain, ties=("key0", "key1"), **options).groupBy("key0", "key1").agg(F.sum("copies").alias(copies_of), F.count("*").alias(rows_of))
    rows = keyed.join(found.withColumnsRenamed({"key0": keys[0], "key1": keys[1]}), keys)
    # of several equal rows one stands for all: that of the least place, which only says how many there are
    several = F.when(F.col(rows_of) > 1, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).otherwise(F.lit(1))
    rows = rows.withColumn(times, F.when(several == 1, F.col(copies_of)).otherwise(F.lit(0)).cast("int")).filter(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB's form of mix() with its default parameters.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (((rank - 1) % 3) + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM r),
l AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
), f AS (SELECT *, cap * open > weight * remaining AS free FROM l),
lead AS (SELECT remaining, open FROM f WHERE free ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN free THEN weight * (SELECT remaining FROM lead) / (SELECT open FROM lead) ELSE cap END AS target FROM f),
d AS (
  SELECT z.doc_id, z.size, t.source_size, t.rank, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216.0::DOUBLE) ELSE 0 END::BIGINT AS expected,
         length(bin(z.size)) * 8 + ((z.size >> greatest(length(bin(z.size)) - 4, 0)) & 7) AS class,
         ('0x' || substr(md5(coalesce(z.doc_id::VARCHAR, '')), 1, 13))::BIGINT AS spread,
         ('0x' || substr(md5('mix/' || t.rank::VARCHAR), 1, 6))::BIGINT AS u
  FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, sum(expected) OVER (PARTITION BY rank ORDER BY class, spread, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + u AS upto FROM d
), e AS (SELECT *, (upto // 16777216 - (upto - expected) // 16777216)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target::DOUBLE AS target, copies, (copies * size)::BIGINT AS taken FROM e
"""
