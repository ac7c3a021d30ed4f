"""Tables that are made once and kept, as an ingested store is: chunks, vectors and the search index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.jobs import shared_folder
from lodestar.operators import bm25
from lodestar.sources import layout

_FOLDERS: dict[tuple, str] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: their names, sizes and times."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.getFileStatus(at)
    files = fs.listStatus(at) if top.isDirectory() else [top]
    return (path, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


@dataclass(frozen=True)
class Kept:
    """chunks with vector, and the BM25 index over them."""

    chunks: DataFrame
    index: bm25.Index


def kept(spark: SparkSession, sources: list[str], make: Callable[[], DataFrame]) -> Kept:
    """The chunks that make() gives of the sources and their index, written once for an application and a state of the sources' files.

    They lie in the shared folder, the chunks in folders by status and language, and are made again when a file changes or their folder is gone."""
    key = (spark.sparkContext.applicationId, *(state(spark, s) for s in sources))
    jvm = spark.sparkContext._jvm
    folder = _FOLDERS.get(key)
    if folder is not None:
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/index/corpus/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            folder = None
    if folder is None:
        folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        layout.write(make(), f"{folder}/chunks")
        bm25.save_texts(spark.read.parquet(f"{folder}/chunks"), f"{folder}/index")
        _FOLDERS[key] = folder
    return Kept(spark.read.parquet(f"{folder}/chunks"), bm25.load_texts(spark, f"{folder}/index"))
