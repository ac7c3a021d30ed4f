"""Incremental ingestion of a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import chunk_hash
from lodestar.operators.fusion import first_wins
from lodestar.plans.ingestion import Ingestion, Stats
from lodestar.sources.files import SUFFIXES
from lodestar.sources.store import ChunkStore

#: What Spark's binaryFile source gives of a file.
FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, source: str, schema, store_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Runs over all files that are new at `source` and ends; returns the finished query.

    Every micro-batch keeps the first row of each content hash and appends those that aren't stored.
    A batch that is repeated after a failure finds its rows stored and adds none."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("chunk_hash", chunk_hash(F.col(text_col))).filter(F.col(text_col).isNotNull())
    store = ChunkStore(spark, store_path)

    def add(batch: DataFrame, _: int) -> None:
        store.append(store.pending(first_wins(batch, ["chunk_hash"], [id_col])))

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_files_stream(spark: SparkSession, folder: str, ingestion: Ingestion, checkpoint: str) -> list[Stats]:
    """Ingests the supported files of a folder that no run with this checkpoint has seen; gives each micro-batch's counters.

    A micro-batch goes through what a batch run does: parse, chunk, summarise and embed what isn't
    stored, store it and add a segment to the index, if there is one. The keyed state is the store
    itself: a micro-batch repeated after a failure finds its chunks and adds none."""
    rows = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder).filter(F.col("path").rlike(SUFFIXES))
    done: list[Stats] = []

    def add(batch: DataFrame, _: int) -> None:
        done.append(ingestion.add_files(batch.select("path", "content")))

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done
