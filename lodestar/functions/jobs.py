"""Checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of data up to which a side is broadcast once it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that setting is missing a temporary one is made if Spark runs within this machine alone, as
    in tests; on a cluster RuntimeError is raised."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lodestar-")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """df as cut() gives it, and aggregates of its rows that the same job takes on its way.

    They belong to the last stage, whose tasks count once each, whatever is run again before it."""
    seen = Observation()
    written = cut(df.observe(seen, *[m.alias(name) for name, m in measures.items()]))
    return written, seen.get


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is measured to have at most `rows` rows and BROADCAST_BYTES bytes; else as it is, and joins shuffle.

    Texts and arrays count by their length as JSON or text, all else as eight bytes."""
    long = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    sizes = [F.octet_length(F.col(f.name) if f.dataType.typeName() in ("string", "binary") else F.to_json(F.col(f.name))) for f in long]
    width = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(8 * len(df.columns)).cast("long"))
    count, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if count <= rows and size <= BROADCAST_BYTES else df
