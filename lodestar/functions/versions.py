"""Versioned manifests: what a table consists of, published by one rename."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Versions:
    """Files 0.json, 1.json, ... of a folder, by the folder's own file system; the greatest number holds.

    Data that a version names is written before it and never changed after, so a run that dies before
    it publishes leaves the version before it as it was."""

    spark: SparkSession
    folder: str

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self) -> tuple[int, dict]:
        """Number and content of the version that holds; -1 and {} without any."""
        fs, folder = self._at()
        if not fs.exists(folder):
            return -1, {}
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return -1, {}
        fs, path = self._at(f"{max(numbers)}.json")
        stream = fs.open(path)
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, after: int, content: dict) -> int:
        """Makes content the version that follows `after`; RuntimeError if another run has published it meanwhile."""
        fs, path = self._at(f"{after + 1}.json")
        _, draft = self._at(f"_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"version {after + 1} of {self.folder} exists already")
        return after + 1
