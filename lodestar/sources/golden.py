"""Golden question sets and result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

LEAST_ROWS = 15


def _rows(spark: SparkSession, path: str) -> list:
    """The list in a JSON file, which people write by hand."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, list):
        raise ValueError("a golden set is a list")
    return found


def questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, category, answerable, expected_sources, filters.

    ValueError for fewer than LEAST_ROWS rows, a row that is no object, or filters that are none; of
    the filters those with a scalar value count."""
    found = _rows(spark, path)
    if len(found) < LEAST_ROWS:
        raise ValueError(f"a golden set has at least {LEAST_ROWS} rows")
    rows = []
    for row in found:
        if not isinstance(row, dict):
            raise ValueError("every row of a golden set is an object")
        filters = row.get("filters", {})
        if not isinstance(filters, dict):
            raise ValueError("filters are an object")
        missing = [c for c in ("id", "category", "answerable", "question", "expected_sources") if c not in row]
        if missing:
            raise ValueError(f"a row lacks {', '.join(missing)}")
        scalar = {k: json.dumps(v) if isinstance(v, bool) else str(v) for k, v in filters.items() if isinstance(v, (str, int, float, bool))}
        rows.append((str(row["id"]), str(row["question"]), str(row["category"]), bool(row["answerable"]), [str(s) for s in row["expected_sources"]], scalar))
    return spark.createDataFrame(rows, "query_id string, query string, category string, answerable boolean, expected_sources array<string>, filters map<string,string>")


def evidence_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id (place in the file), query and evidence; the evidence may be a text or a list of texts."""
    rows = [(i, str(r["question"]), [str(e) for e in (r["reference_evidence"] if isinstance(r["reference_evidence"], list) else [r["reference_evidence"]])]) for i, r in enumerate(_rows(spark, path))]
    return spark.createDataFrame(rows, "query_id long, query string, evidence array<string>")


def write_results(rows: DataFrame, path: str) -> None:
    """The few rows of an evaluation as an indented JSON list in one file."""
    spark = rows.sparkSession
    text = json.dumps([r.asDict(recursive=True) for r in rows.collect()], indent=2, ensure_ascii=False) + "\n"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
