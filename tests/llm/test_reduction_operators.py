"""Merkle manifest, repeated windows and source divergence against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import divergence, lexicon, manifest, substrings
from lodestar.llm.fmindex import FMIndex, suffix_order

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree string, at long, term string, batch long, number long"


def frame(spark, rows):
    """Rows of manifest.FIELDS in a table whose further columns are named as the operators' own."""
    return spark.createDataFrame([(*r, "h", "t", 7, "x", 3, 4) for r in rows], SCHEMA)


ODD = [
    (None, None, None, None, None), (None, "a", "en", 3, "null id"), (1, "", "", 0, ""), (2, "b", None, None, " \n"), (3, "s", "x", 5, "Single"),
    (4, "a", "en", 9, "Same Text"), (4, "a", "en", 9, "Same Text"), (5, "ü", "en", 1, "Ünïcödé ÄB"), (6, "a", "en", 40000, "Word " * 8000),
]


# ---------------------------------------------------------------- manifest


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (8, 1), (2, 2), (3, 1)])
def test_manifest_equals_whole_lists(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    rows = [(10 + i, rng.choice("ab"), rng.choice(["en"] * 8 + ["de", "fr", None, ""]), i, f"Text {i}") for i in range(150)] + ODD
    rng.shuffle(rows)
    got = manifest.manifest(frame(spark, rows).repartition(5), fanout=fanout, levels=levels)
    folded = got.select("*", manifest.fold(F.col("leaf"), F.col("proof")).alias("folded"), manifest.siblings(F.col("proof")).alias("joined"))
    have = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["joined"]) for r in folded.collect())
    want = manifest.brute(rows, fanout=fanout)
    assert have == sorted((str(rows[i][0]), leaf, sub, root, "".join(proof)) for i, (leaf, sub, root, proof) in want.items())
    assert all(r["folded"] == r["root"] for r in folded.collect())


def test_audited(spark):
    rows = [(i, "s", "en", 1, f"Upper {i}") for i in range(60)] + [(100 + i, "s", "de", 1, f"lower {i}") for i in range(30)] + [(None, "s", "de", 1, "Null Id")]
    got = {r["doc_id"]: r for r in manifest.audited(frame(spark, rows)).collect()}
    want = {rows[i][0]: v for i, v in manifest.brute(rows).items()}
    for i, *_, text in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text != text.lower()
        assert got[i]["verified"] != hit and (got[i]["folded_root"] == got[i]["root"]) != hit
        assert got[i]["proof_sha256"] == hashlib.sha256("".join(want[i][3]).encode()).hexdigest()
    assert any(not r["verified"] for r in got.values())


def test_manifest_of_few(spark):
    assert manifest.audited(frame(spark, [])).collect() == []
    one = manifest.audited(frame(spark, ODD[3:4])).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- lexicon and FM-index


def test_numbers_tell_words_apart_by_bytes(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(400)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    for weak in (False, True):
        if weak:  # all words collide
            monkeypatch.setattr(lexicon, "hashes", lambda raw, start, end: np.zeros(len(start), np.uint64))
        number, first = lexicon.numbers(raw, start, end)
        seen = {}
        assert all(seen.setdefault(n, w) == w for n, w in zip(number.tolist(), words, strict=True)) and len(seen) == len(set(words)) == len(first)
        assert all(words[first[n]] == w for n, w in zip(number.tolist(), words, strict=True))
        assert lexicon.strings(raw, start, end).to_pylist() == words


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sigma, n, depth = int(rng.integers(2, 7)), int(rng.integers(1, 90)), int(rng.integers(1, 7))
        text, values = rng.integers(0, sigma, n), rng.integers(0, 100, n)
        held = text.tolist()
        assert suffix_order(text, sigma).tolist() == sorted(range(n), key=lambda i: held[i:])
        index = FMIndex(text, sigma, depth, values)
        asked, start, length = rng.integers(0, sigma + 1, 40), np.array([0, 15]), np.array([15, 25])
        match, low, high = index.matching(asked, start, length)
        at = 0
        for s, m in zip(start.tolist(), length.tolist(), strict=True):
            for i in range(s, s + m):
                best, where = 0, list(range(n + 1))
                for k in range(1, min(depth, s + m - i) + 1):
                    pattern = asked[i : i + k].tolist()
                    found = [] if 0 in pattern else [j for j in range(n - k + 1) if held[j : j + k] == pattern]
                    if not found:
                        break
                    best, where = k, found
                assert (match[at], high[at] - low[at]) == (best, len(where))
                if best == depth:
                    assert index.least[index.classes(low[at : at + 1])][0] == min(values[j] for j in where)
                at += 1


# ---------------------------------------------------------------- repeated windows


def passages(rng, n):
    """Documents with near copies, shared passages, a very common line amid other words, and repeats within themselves."""
    word = lambda: rng.choice("Alpha alpha bêta gamma delta Ωmega x yy zzz".split()) + str(rng.randint(0, 60))
    line = "this very common line of nine words is everywhere"
    long = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            text += [line] + [word() for _ in range(rng.randint(0, 15))]
        if i % 5 == 0:
            cut = long.split()
            text += cut[rng.randint(0, 30) : rng.randint(31, 70)]
        if i % 7 == 0 and out:
            near = rng.choice(out).split()
            if near:
                near[rng.randrange(len(near))] = word()
            text = near
        if i % 11 == 0:
            text += text
        out.append(rng.choice([" ", "\t", "\n \n"]).join(text))
    return out + out[3:9] + out[4:6]


@pytest.mark.parametrize("batch_bytes", [4 << 20, 1500])
def test_windows_equal_brute_force(spark, batch_bytes):
    rng = random.Random(batch_bytes)
    texts = passages(rng, 620)
    ids = rng.sample(range(10_000), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, texts[20]), (None, None), (20_000, None), (20_001, ""), (20_002, " \n"), (ids[0], texts[30]), (ids[0], texts[30])]
    docs = spark.createDataFrame([(i, t, 1, "h", 2, b"x") for i, t in rows], "doc_id long, text string, batch long, hashes string, number long, verdicts binary").repartition(6)
    want = substrings.brute(rows)
    got = substrings.repeated_windows(docs, batch_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, n, r, hashlib.sha256(k.encode()).hexdigest())) for i, n, r, k in want)
    assert sum(w[2] for w in want) > 5000
    kept = substrings.without_windows(docs, batch_bytes).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str((i, k)) for i, _, _, k in want)


def test_windows_of_long_and_no_texts(spark):
    schema = "doc_id long, text string"
    assert substrings.repeated_windows(spark.createDataFrame([], schema)).collect() == []
    rng = random.Random(3)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(600_000))  # several stretches
    words = long.split()
    rows = [(1, long), (2, " ".join(words[substrings.STRETCH - 20 : substrings.STRETCH + 20])), (3, " ".join(words[5:17])), (4, "x " * 300_000), (5, "x " * 12)]
    got = {r["doc_id"]: r for r in substrings.repeated_windows(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["n_removed"] for i in range(1, 6)] == [0, 40, 0, 0, 0]
    with pytest.raises(ValueError):
        substrings.repeated_windows(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---------------------------------------------------------------- divergence


def divergences(rows, min_docs=3, top=200):
    """(lang, source, part, item, value, rank) by plain sums; rows are (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for a, b, t in rows]
    seen, count, groups = collections.Counter(), collections.Counter(), sorted({d[:2] for d in docs})
    for a, b, words in docs:
        seen.update((a, w) for w in set(words))
        count.update((a, b, w) for w in words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (a, w), n in seen.items() if a == lang and n >= min_docs)
        sources = [g[1] for g in groups if g[0] == lang]
        share = lambda counts: [1 + 10**9 * (c + 1) // (sum(counts) + len(kept)) for c in counts]  # noqa: B023, E731
        p = {s: share([count[lang, s, w] for w in kept]) for s in sources}
        q = share([sum(count[lang, s, w] for s in sources) for w in kept])
        for s in sources:
            pairs = [(o, sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(w, (x - y) ** 2 // y) for w, x, y in zip(kept, p[s], q, strict=True) if count[lang, s, w] and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("block", [divergence.BLOCK, 5])
def test_audit_equals_plain_sums(spark, block):
    rng = random.Random(block)
    vocabulary = ["Word" + "abcdefghij"[k % 10] * (k // 10 + 1) + "ßé"[k % 2] for k in range(60)]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en"] * 5 + ["de", None, ""]), rng.choice(["hot"] * 8 + [f"s{k}" for k in range(9)] + [None, "ü", "z"])
        rows.append((lang, source, " ".join(rng.choice(vocabulary[: rng.randint(5, 60)]) for _ in range(rng.randint(0, 30)))))
    rows += [("en", "no text", None), ("en", "no terms", "123 456"), ("xx", "a", "One"), ("xx", "b", "two"), ("one", "alone", "tick tick"), ("de", "hot", "A\x00b 'c' " * 50)]
    docs = spark.createDataFrame([(i, *r, 1, "t", 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, number long, term string, n long").repartition(6)
    got = divergence.audit(docs, top=7, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergences(rows, top=7)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_each_two_meet_once_a_block(spark):
    for groups in (1, 2, 3, 6, 7, 20):
        cells = spark.createDataFrame([("en", 0, k, groups, 1, b"") for k in range(groups)], "lang string, block long, number long, groups long, n long, vector binary")
        met = [tuple(sorted((r["host"], r["number"]))) for first in range(0, 20, 8) for r in divergence.visits(cells, first, 8).collect()]
        assert sorted(met) == [(i, j) for i in range(groups) for j in range(i + 1, groups)]


def test_terms_of_a_long_text_count_once(spark, monkeypatch):
    text = "alpha beta gamma " * 500_000  # over one piece
    rows = [("en", "a", text), ("en", "b", "alpha"), ("en", "c", "alpha beta")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == divergences(rows)


def test_shares_are_exact_for_large_counts():
    count = np.array([0, 7 * 10**14, 3 * 10**15])
    assert divergence.shares(count, 5 * 10**15, 10**6).tolist() == [1 + 10**9 * (int(c) + 1) // (5 * 10**15 + 10**6) for c in count]
