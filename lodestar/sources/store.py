"""The chunk store: Parquet files in buckets by chunk hash, under a versioned manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.jobs import broadcast_if_small, cut
from lodestar.functions.text import point_id
from lodestar.functions.versions import Versions
from lodestar.operators.fusion import first_wins
from lodestar.sources import layout

#: Buckets of a store, fixed when it is made.
BUCKETS = 64
#: What an ingested chunk has; a store without any rows has these columns.
COLUMNS = "chunk_hash string, chunk_id string, text string, path string, source_file string, page_number int, chunk_ordinal int, used_ocr boolean, document_type string, language string, status string, context_summary string, summary_fallback boolean, vector array<double>, point_id string"


def bucket_of(chunk_hash: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chunk_hash), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ChunkStore:
    """Chunks keyed by chunk_hash.

    Every write makes a generation of its own, a folder with a file or more per bucket; the manifest
    says which generations a bucket consists of. New keys add a generation to their buckets; replaced
    keys have their buckets, and no others, written anew. What a version names is never changed, so that a run that
    dies leaves the version before it readable, and readers of a former one aren't disturbed until vacuum().
    Within a bucket, chunks lie in folders by status and language; a store made without such folders stays without."""

    spark: SparkSession
    path: str

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/manifest")

    def exists(self) -> bool:
        """Whether anything was stored."""
        return self.versions.read()[0] >= 0

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Stored chunks, with the column bucket, of these buckets."""
        _, held = self.versions.read()
        if not held:
            return self.spark.createDataFrame([], f"{COLUMNS}, bucket int")
        live = {int(b): own for b, own in held["live"].items() if buckets is None or int(b) in buckets}
        schema = T.StructType.fromJson(held["schema"])
        folders = [layout.folder_column(f) for f in held.get("layout", [])]
        data = f"{self.path}/data"
        paths = [f"{data}/generation={g}/bucket={b}" for b, own in live.items() for g in own]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("bucket", *folders)]]))
        whole = reduce(lambda s, c: s.add(c, T.IntegerType()), ("bucket", *folders), schema.add("generation", T.StringType()))
        return self.spark.read.schema(whole).option("basePath", data).parquet(*paths).drop("generation")

    def read(self) -> DataFrame:
        """All stored chunks; a store that doesn't exist has none."""
        return self.searchable().drop(*map(layout.folder_column, layout.FIELDS))

    def searchable(self) -> DataFrame:
        """All stored chunks with their folders (sources/layout.py), by which a search's filters choose what is read."""
        return self._rows().drop("bucket")

    def vector_size(self) -> int | None:
        return self.versions.read()[1].get("size")

    def ensure(self, size: int) -> None:
        """ValueError if stored vectors have another size."""
        have = self.vector_size()
        if have is not None and have != size:
            raise ValueError(f"the store holds vectors of {have} dimensions, not {size}")

    def _near(self, hashes: DataFrame) -> DataFrame:
        """Stored chunks of the buckets that hashes (chunk_hash) fall into; at most as many numbers as there are buckets reach the driver."""
        _, held = self.versions.read()
        if not held:
            return self._rows()
        return self._rows([r[0] for r in hashes.select(bucket_of(F.col("chunk_hash"), held["buckets"])).distinct().collect()])

    def existing(self, hashes: DataFrame) -> DataFrame:
        """Of hashes (chunk_hash), those that are stored. The store isn't shuffled if the hashes can be broadcast."""
        asked = hashes.select("chunk_hash").distinct()
        return self._near(hashes).select("chunk_hash").join(broadcast_if_small(asked), "chunk_hash", "left_semi")

    def pending(self, chunks: DataFrame) -> DataFrame:
        """Chunks that aren't stored."""
        return chunks.join(broadcast_if_small(self.existing(chunks)), "chunk_hash", "left_anti")

    def by_id(self, ids: DataFrame) -> DataFrame:
        """Stored chunks of ids (chunk_id), each once; no filter applies. The ids go to the store, not the store to them, if they can be broadcast."""
        return self.read().join(broadcast_if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")

    def append(self, chunks: DataFrame) -> None:
        """Adds chunks that are known not to be stored; the point's id follows from the hash."""
        self._publish(chunks, replaces=False)

    def upsert(self, chunks: DataFrame) -> None:
        """Adds chunks, one for each hash; those whose hash is stored replace what is there, with all their columns."""
        self._publish(chunks, replaces=True)

    def _publish(self, chunks: DataFrame, replaces: bool) -> None:
        version, held = self.versions.read()
        held = held or {"buckets": BUCKETS, "size": None, "schema": None, "live": {}, "layout": list(layout.FIELDS)}
        bucket = bucket_of(F.col("chunk_hash"), held["buckets"]).alias("bucket")
        fresh = cut(chunks.drop("point_id", "bucket", *map(layout.folder_column, layout.FIELDS)).dropDuplicates(["chunk_hash"]).withColumn("point_id", point_id(F.col("chunk_hash"))).select("*", bucket))
        written, anew = fresh, set()
        if replaces and version >= 0:
            met = self._near(fresh).join(broadcast_if_small(fresh.select("chunk_hash")), "chunk_hash", "left_semi")
            anew = {r[0] for r in met.select("bucket").distinct().collect()}
        if anew:
            stay = self._rows(sorted(anew)).join(broadcast_if_small(fresh.select("chunk_hash")), "chunk_hash", "left_anti")
            written = fresh.unionByName(stay, allowMissingColumns=True)
        self._commit(version, held, written, anew)

    def _commit(self, version: int, held: dict, rows: DataFrame, anew: set[int]) -> None:
        """Writes a generation and names it in the next version; buckets in `anew` consist of it alone."""
        generation = uuid.uuid4().hex
        at = f"{self.path}/data/generation={generation}"
        fields = held.get("layout", [])
        folders = [layout.folder_column(f) for f in fields]
        rows = rows.drop(*folders)
        placed = layout.laid_out(rows, fields) if fields else rows
        placed.repartition("bucket").sortWithinPartitions("bucket", *folders, "chunk_hash").write.partitionBy("bucket", *folders).parquet(at)
        fs, top = Versions(self.spark, at)._at()
        found = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
        live = {b: own for b, own in held["live"].items() if int(b) not in anew}
        live |= {b: [*live.get(b, []), generation] for b in found}
        known = {f["name"]: f for f in (held["schema"] or {"fields": []})["fields"]}
        known |= {f["name"]: f for f in json.loads(rows.drop("bucket").schema.json())["fields"]}
        size = held["size"]
        if size is None and "vector" in rows.columns:
            first = rows.filter("vector is not null").select(F.size("vector")).first()
            size = first and first[0]
        self.versions.publish(version, {"buckets": held["buckets"], "layout": fields, "size": size, "schema": {"type": "struct", "fields": list(known.values())}, "live": live})

    def compact(self, most: int = 8) -> int:
        """Writes buckets of more than `most` generations anew; gives how many there were."""
        version, held = self.versions.read()
        many = {int(b) for b, own in held.get("live", {}).items() if len(own) > most}
        if many:
            self._commit(version, held, self._rows(sorted(many)), many)
        return len(many)

    def vacuum(self) -> int:
        """Deletes files of generations that the manifest doesn't name, left by replaced buckets or runs that died; gives how many folders went.

        Readers of former versions, and runs that haven't published yet, must have ended."""
        _, held = self.versions.read()
        named = {(g, b) for b, own in held.get("live", {}).items() for g in own}
        fs, top = Versions(self.spark, f"{self.path}/data")._at()
        gone = 0
        for generation in fs.listStatus(top) if fs.exists(top) else []:
            name = generation.getPath().getName().removeprefix("generation=")
            for bucket in fs.listStatus(generation.getPath()):
                if bucket.isDirectory() and (name, bucket.getPath().getName().removeprefix("bucket=")) not in named:
                    gone += bool(fs.delete(bucket.getPath(), True))
        return gone


def merged(stored: DataFrame, incoming: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """What a keyed overwrite leaves: incoming rows, and stored rows of other keys."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def first_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The first chunk of each hash in the order given."""
    return first_wins(chunks, ["chunk_hash"], order)
