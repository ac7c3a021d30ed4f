"""Scalar text functions as Spark columns.

Only token-exact truncation and the collapsing of white space leave the JVM."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.functions.entities import decode_entities

# Patterns, word classes and sentences that results depend on.
CJK = r"[\x{4e00}-\x{9fff}]"
LATIN_TOKEN = r"[a-z0-9][a-z0-9_.:/-]*"
BUDGET_TOKEN = r"[A-Za-z0-9_./:-]+|[\x{4e00}-\x{9fff}]|[^\s\x1c-\x1f]"
SPACE = r"[\s\x1c-\x1f]"
CITATION = r"\[(S\d+)\]"
TEXTS = 256
NO_CONTEXT = "This chunk contains no usable textual context."
CLEANING = (
    (r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"<[^>]+>", " "),
)
DECORATION = (
    (r"(?mdU)^(?:\s{0,3}#{1,6}\s+|\s*>\s?|\s*[-*_]{3,}\s*$)", ""),
    (r"(?<!\\)(?:\*\*|__|~~|`{1,3})", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "),
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"[ \t]+", " "),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
)


def in_python(pattern: str) -> re.Pattern:
    """One of these patterns for Python's re."""
    return re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", pattern))


def _replaced(column: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, column)


def strip(column: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    return F.regexp_replace(column, rf"(?U)^{SPACE}+|{SPACE}+$", "")


@F.arrow_udf(StringType())
def collapse(text: pa.Array) -> pa.Array:
    """Each run of white space as one space, none at the ends.

    Python splits at the same characters as SPACE has, in a small part of the time that the JVM's pattern takes."""
    parts = [pa.array([None if v is None else " ".join(v.split()) for v in text.slice(a, TEXTS).to_pylist()], pa.string()) for a in range(0, len(text), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def clean_text(column: Column, entities: bool = True, closed: bool = False) -> Column:
    """Text without HTML and Markdown; null and blank give ''. entities=False leaves character references as they are, closed those without a semicolon."""
    plain = _replaced(column, CLEANING)
    plain = decode_entities(plain, closed) if entities else plain
    return F.when(column.isNull() | (strip(column) == ""), F.lit("")).otherwise(strip(_replaced(plain, DECORATION)))


def first_sentence(column: Column, max_chars: int = 240) -> Column:
    """First sentence of at most max_chars, or the beginning with a full stop.

    The text without its white space is handed on as one value, for else every mention would make it anew."""

    def of(value: Column) -> Column:
        sentence = F.regexp_extract(value, r"^[^.!?。！？]*[.!?。！？]", 0)
        opening = F.concat(F.rtrim(F.substring(value, 1, max_chars), F.lit(" ,;:，；：")), F.lit("."))
        chosen = F.when(sentence != "", sentence).otherwise(opening)
        return F.when(value == "", F.lit(NO_CONTEXT)).otherwise(strip(F.substring(chosen, 1, max_chars)))

    value = F.btrim(collapse(F.coalesce(column, F.lit(""))), F.lit("\"'`- "))
    return F.get(F.transform(F.array(value), of), F.lit(0))


def hash_tokens(column: Column) -> Column:
    """Tokens for feature hashing, in reading order: Latin words and single CJK characters."""
    return F.regexp_extract_all(F.lower(column), F.lit(f"{LATIN_TOKEN}|{CJK}"), F.lit(0))


def bm25_tokens(column: Column) -> Column:
    """Latin words, then CJK characters, then bigrams of the characters in turn.

    The characters are matched once and handed to the function that pairs them as one value."""

    def with_pairs(single: Column) -> Column:
        many = F.greatest(F.size(single) - 1, F.lit(0))
        return F.concat(single, F.zip_with(F.slice(single, 1, many), F.slice(single, 2, many), lambda a, b: F.concat(a, b)))

    single = F.regexp_extract_all(column, F.lit(CJK), F.lit(0))
    cjk = F.when(column.rlike(CJK), F.get(F.transform(F.array(single), with_pairs), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(F.lower(column), F.lit(LATIN_TOKEN), F.lit(0)), cjk)


def count_tokens(column: Column) -> Column:
    """Tokens that a context budget counts."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(f"(?U){BUDGET_TOKEN}"))


@F.arrow_udf(StringType())
def truncate_to_tokens(text: pa.Array, limit: pa.Array) -> pa.Array:
    """The text up to the end of its limit-th token; TEXTS of them at a time, so that few are Python's strings at once."""
    token = in_python(BUDGET_TOKEN)

    def one(value: str | None, most: float | None) -> str:
        if value is None or most is None or most != most or most <= 0:
            return ""
        for number, found in enumerate(token.finditer(value), 1):
            if number == most:
                end = found.end()
            elif number > most:
                return value[:end].rstrip()
        return value

    starts = range(0, len(text), TEXTS)
    parts = [pa.array([one(v, m) for v, m in zip(text.slice(a, TEXTS).to_pylist(), limit.slice(a, TEXTS).to_pylist(), strict=True)], pa.string()) for a in starts]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def language(column: Column) -> Column:
    return F.when(column.rlike(CJK), F.lit("zh-CN")).otherwise(F.lit("en"))


def document_type(file: Column) -> Column:
    return F.when(F.lower(file).endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("markdown"))


def chunk_hash(column: Column) -> Column:
    return F.sha2(strip(column), 256)


def point_id(digest: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a chunk's hash."""
    raw = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), digest.cast("binary")))
    part = lambda a, n: F.substring(raw, a, n)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def citations(answer: Column) -> Column:
    """Distinct source ids that an answer cites, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(f"(?U){CITATION}"), F.lit(1)))


def normalize_evidence(column: Column) -> Column:
    return F.lower(collapse(column))


def block_header(number: Column, source_file: Column, page: Column) -> Column:
    return F.concat(F.lit("[S"), number.cast("string"), F.lit("] [source: "), source_file, F.lit(", page: "), F.coalesce(page.cast("string"), F.lit("?")), F.lit("]"))


def block_payload(summary: Column, text: Column) -> Column:
    own = strip(F.coalesce(summary, F.lit("")))
    return F.when(own != "", F.concat(F.lit("Context summary: "), own, F.lit("\n"), text)).otherwise(text)
