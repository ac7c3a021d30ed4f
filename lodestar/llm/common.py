"""Helpers that the corpus operators share: checkpoints, checked broadcasts, Arrow text buffers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """Writes df to the reliable checkpoint folder and returns what was written."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes after which an Arrow batch ends. By Spark's 10,000 rows a batch of texts has 50 MB and more, which the JVM
#: holds outside its heap and Python once more, both for what comes and for what goes back.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python batches of BATCH_BYTES, unless it has a bound of its own.

    It is a setting of the session, since plans are run later than they are made; results don't depend on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names made of the stems that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            name, k = f"{stem}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of data that a broadcast may have.
BROADCAST_BYTES = 16 << 20


def broadcast_checked(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df, already cut, for broadcast if it is counted to have at most max_rows rows and max_bytes bytes.

    Beyond that it is returned as it is and the join shuffles. Numbers count as eight bytes."""
    lengths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = sum(lengths, F.lit(8 * len(df.columns)).cast("long"))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def md5_bits(column, digits: int = 13):
    """The first hexadecimal digits of a string column's MD5 as a long; null hashes as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")


def words_count(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and len+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most about `most` bytes; one longer document stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)
