"""Markdown and PDF files as pages."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.jobs import cut
from lodestar.functions.text import clean_text, strip

# What is read, and the length under which a PDF page counts as scanned.
SUFFIXES = r"(?i)\.(pdf|md|markdown)$"
SCANNED_BELOW = 30
#: From a PDF's bytes and a page number (from 0) to the page's text by OCR, "" if there is none.
Ocr = Callable[[bytes, int], str]


def discover(spark: SparkSession, source: str) -> DataFrame:
    """path and content of supported files: the file itself, or all below a folder; none if there is nothing at the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return files.select("path", "content").filter(F.col("path").rlike(SUFFIXES))


def listing(spark: SparkSession, source: str) -> DataFrame:
    """path of the supported files, in order; no content is read."""
    return discover(spark, source).select("path").orderBy("path")


def _pdf_pages(content: bytes) -> list[tuple[int, str]]:
    from pypdf import PdfReader

    out = []
    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages):
        try:
            out.append((number + 1, page.extract_text() or ""))
        except Exception:  # a damaged page doesn't lose the others
            out.append((number + 1, ""))
    return out


def _raw_pages(path: str, content: bytes) -> list[tuple[int, str]]:
    if path.lower().endswith(".pdf"):
        return _pdf_pages(content)
    try:
        return [(1, content.decode("utf-8-sig"))]
    except UnicodeDecodeError:
        return [(1, content.decode("latin-1"))]


def _scanned(files: DataFrame, scanned: DataFrame, ocr: Ocr | None) -> DataFrame:
    """path, page_number and raw text by OCR of the pages scanned (path, page_number); a page whose OCR fails has no text.

    Only files that have such pages are read for them."""
    if ocr is None:
        return scanned.withColumn("raw", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, number in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(ocr(content, number - 1) or "")
                except Exception:  # tools of all kinds; one page's failure costs no other page
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "page_number", "raw"])

    asked = files.select("path", "content").join(scanned, "path").select("path", "page_number", "content")
    return asked.mapInArrow(run, "path string, page_number int, raw string")


def parse(files: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """path, source_file, page_number, used_ocr, text and error; a file that can't be read has one row with an error.

    A PDF page of under SCANNED_BELOW characters, once cleaned, counts as scanned: its text is what OCR
    gives, nothing without OCR, and used_ocr tells that this was something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, n, text, None) for n, text in _raw_pages(path, content)]
                except Exception as problem:  # parsers of foreign formats raise anything
                    rows.append((path, None, None, f"{type(problem).__name__}: {problem}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "page_number", "raw", "error"])

    pages = files.select("path", "content").mapInArrow(run, "path string, page_number int, raw string, error string")
    pages = cut(pages.select("path", "page_number", clean_text(F.col("raw")).alias("text"), "error"))
    short = F.lower("path").endswith(".pdf") & F.col("error").isNull() & (F.length("text") < SCANNED_BELOW)
    seen = _scanned(files, pages.filter(short).select("path", "page_number"), ocr)
    seen = seen.select("path", "page_number", clean_text(F.col("raw")).alias("text"), F.lit(None).cast("string").alias("error")).withColumn("used_ocr", F.col("text") != "")
    every = pages.filter(~short).withColumn("used_ocr", F.lit(False)).unionByName(seen)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return every.select("path", name.alias("source_file"), "page_number", "used_ocr", "text", "error")


def usable(pages: DataFrame) -> DataFrame:
    """Pages that have text."""
    return pages.filter(F.col("error").isNull() & (strip(F.col("text")) != ""))
