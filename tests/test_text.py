import hashlib
import html.entities
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.entities import decode_entities


def one(spark, value, function, *more):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"), *more).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("# Title\n<script>x()</script>**Bold** [link](u) text![i](p)<!-- c -->", "Title\nBold link text"),
        ("<!-- only -->", ""),
        ("   ", ""),
        (None, ""),
        ("a\r\nb\rc\n\n\n\nd", "a\nb\nc\n\nd"),
        ("> quoted\n---\nx", "quoted\n\nx"),
        ("&lt;b&gt; &eacute; &amp;amp;", "<b> é &amp;"),
        ("a\x01b\tc   d", "a b c d"),
        ("keep *one* and _two_ but not ~~three~~ or `four`", "keep *one* and _two_ but not three or four"),
    ],
)
def test_clean_text(spark, value, want):
    assert one(spark, value, tx.clean_text) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("One. Two.", "One."),
        ("", tx.NO_CONTEXT),
        (None, tx.NO_CONTEXT),
        ("  　'`- ", tx.NO_CONTEXT),
        ("no end here ,", "no end here."),
        ("中文。后面", "中文。"),
        ("x" * 300, "x" * 240),
        ("a\n\n b!", "a b!"),
    ],
)
def test_first_sentence(spark, value, want):
    assert one(spark, value, tx.first_sentence) == want


def test_tokens(spark):
    assert one(spark, "S3 policy. 中文字 a-b", tx.bm25_tokens) == ["s3", "policy.", "a-b", "中", "文", "字", "中文", "文字"]
    assert one(spark, "中", tx.bm25_tokens) == ["中"]
    assert one(spark, "", tx.bm25_tokens) == []
    assert one(spark, "A 中 b/c", tx.hash_tokens) == ["a", "中", "b/c"]
    assert one(spark, "a.b (c) 　中文", tx.count_tokens) == 6
    assert one(spark, None, tx.count_tokens) == 0


@pytest.mark.parametrize(("n", "want"), [(0, ""), (2, "a b"), (4, "a b (c"), (9, "a b (c)  ")])
def test_truncate(spark, n, want):
    assert one(spark, "a b (c)  ", tx.truncate_to_tokens, F.lit(n)) == want


def test_identities(spark):
    digest = hashlib.sha256(b"x y").hexdigest()
    assert one(spark, "  x y\n", tx.chunk_hash) == digest
    assert one(spark, digest, tx.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, digest))
    assert one(spark, "中", tx.language) == "zh-CN"
    assert one(spark, "A.PDF", tx.document_type) == "pdf"
    assert one(spark, "[S2] [S1] [S2] [x]", tx.citations) == ["S2", "S1"]
    assert one(spark, " A  B\n", tx.normalize_evidence) == "a b"


def test_cjk_tokens_take_linear_time(spark):
    import time

    long = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(100_000))
    frame = spark.createDataFrame([(long,), ("ab " + long[:3] + " cd",), (long[0],), ("",), (None,)], "t string")
    tokens = frame.select(tx.bm25_tokens(F.col("t")).alias("x"))
    tokens.collect()
    begun = time.monotonic()
    got = [r["x"] for r in tokens.collect()]
    assert time.monotonic() - begun < 5
    assert got[0] == [*long, *(a + b for a, b in zip(long, long[1:], strict=False))]
    assert got[1:] == [["ab", "cd", *long[:3], long[:2], long[1:3]], [long[0]], [], None]


def test_every_named_reference(spark):
    """All names, with and without what follows them, against the standard library."""
    values = [form.format(n) for n in html.entities.html5 for form in ("a&{0}b", "&{0}", "&{0};", "&{0}=1 &{0}")]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", decode_entities(F.col("t")).alias("r")).collect()
    assert len(values) > 8000 and [r["r"] for r in rows] == [html.unescape(r["t"]) for r in rows]


def test_references_by_number_and_broken_ones(spark):
    points = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000]
    values = [form.format(n) for n in points for form in ("&#{0};", "&#x{0:x};x", "&#X{0:X}", "&#000{0}z")]
    pieces, choice = ["&", "#", "x", ";", "a", "m", "p", "l", "t", "n", "o", " ", "<", "1", "é", "&amp;", "&not", "&#12"], random.Random(5)
    values += ["", "&", "&&", "&#;", "&#xg;", "& amp;", "&notit;", "&ampamp;amp", "&" + "x" * 40 + ";", "&amp" * 500]
    values += ["".join(choice.choice(pieces) for _ in range(choice.randint(1, 40))) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", decode_entities(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows] == [html.unescape(r["t"]) for r in rows]
    assert one(spark, "&#" + "9" * 6000 + ";", decode_entities) == "�" and one(spark, None, decode_entities) is None


def test_cleaning_stays_in_the_jvm(spark):
    plan = spark.createDataFrame([("a&amp;b",)], "t string").select(tx.clean_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_closed_references_alone(spark):
    """What the SQL of clean_text_pages decodes: a reference ends with a semicolon, one of a cut title doesn't."""
    for value, want in (("and&amp</h1>", "and&amp"), ("&amp;&amp &copy;&copy", "&&amp ©&copy"), ("&#233;&#233 &notit;", "é&#233 &notit;")):
        assert one(spark, value, lambda c: tx.clean_text(c, closed=True)) == want
