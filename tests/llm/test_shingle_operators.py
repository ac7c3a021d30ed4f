import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontam, neardup, suffixdedup
from lodestar.llm.shingles import shingles
from lodestar.llm.common import text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, s1 string, digest string"


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


def shingle_set(text, width):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not own:
        return set()
    return {tuple(own)} if len(own) < width else {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}


def near_brute(rows, width=4, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d is None, d or 0), len(sets[i]), None if d is None else least[root(i)], d is None or least[root(i)] == d) for i, (d, _) in enumerate(rows))


def near_rows(rng):
    rows = []
    for k in range(12):
        base = words(rng, rng.randint(3, 80)).split()
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, rows[k][1].upper()) for k in range(3)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, " "), (907, "ä é"), (3, rows[3][1]), (None, rows[0][1]), (None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_rows(random.Random(seed))
    got = neardup.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in got.collect()) == near_brute(rows)


@pytest.mark.parametrize("block", [4 << 20, 4000])
def test_near_duplicate_families_are_searched(spark, monkeypatch, block):
    """Many unlike copies of one text: links beyond the first nodes are found."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    rng = random.Random(5)
    base, rows = words(rng, 60).split(), []
    for i in range(120):
        own = list(base)
        for p in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            own[p] = words(rng, 1) + str(i)
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(frame(spark, rows))
    assert sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in got.collect()) == near_brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words in here now"), (3, "other words in here now"), (None, "a b c d e f g"), (4, None)]
    docs = frame(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    assert neardup.keep_one(docs.limit(0)).count() == 0 and neardup.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_never_cross_documents():
    raw, offsets = text_buffer(__import__("pyarrow").array(["a b", "", None, "c d", "a b c d e"]))
    hashes, at = shingles(raw, offsets, 4)
    assert (at[1:] - at[:-1]).tolist() == [1, 0, 0, 1, 2] and len(set(hashes.tolist())) == 4


@pytest.mark.parametrize("size", [3, 7, 13, 30, 90])
def test_contaminated(spark, size):
    rng = random.Random(size)
    items = [(i, words(rng, size)) for i in range(8)] + [(98, None), (99, ""), (100, "two words")]
    docs = [(i, words(rng, rng.randint(0, 900)) + " " + items[i][1].upper() + " " + words(rng, rng.randint(0, 900))) for i in range(8)]
    damaged = items[0][1].split()
    damaged[0] = "changed"
    docs += [(50, " ".join(damaged)), (51, words(rng, 2000)), (52, None), (53, ""), (54, "Two  words"), (None, items[1][1]), (7, docs[7][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.contaminated(frame(spark, docs), bench)
    want = []
    for d, t in docs:
        for i, u in items:
            own = shingle_set(u, 5)
            both = len(own & shingle_set(t, 5))
            if own and 100 * both >= 80 * len(own):
                want.append(((d is None, d or 0), i, len(own), both))
    assert sorted(((r[0] is None, r[0] or 0), *r[1:4]) for r in got.collect()) == sorted(want)


def test_decontamination_in_passes_and_on_nothing(spark, monkeypatch):
    docs = frame(spark, [(1, "x " * 5 + "alpha beta gamma delta epsilon zeta"), (2, "clean text"), (None, "alpha beta gamma delta epsilon zeta")])
    bench = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {w}") for i, w in enumerate(["zeta", "eta", "theta"])], "item_id long, text string")
    once = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 1)
    assert sorted(map(str, decontam.contaminated(docs, bench).collect())) == once and len(once) == 2
    assert [r["doc_id"] for r in decontam.clean(docs, bench).orderBy("doc_id").collect()] == [None, 2]
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(4)
    passages = [words(rng, 30) for _ in range(4)]
    rows = [(i, words(rng, rng.randint(0, 20)) + rng.choice(passages)[rng.randint(0, 20) :] + words(rng, rng.randint(0, 20))) for i in range(40)]
    rows += [(50, rows[3][1]), (3, rows[3][1]), (51, "ab" * 200), (52, "ab" * 90), (53, "é" * 60), (54, "é" * 30), (55, None), (56, ""), (57, "short"), (58, "short"), (None, rows[5][1]), (None, None)]
    key = lambda r: ((r[0] is None, r[0] or 0), *r[1:])
    want = sorted(map(key, suffixdedup.brute(rows)))
    docs = frame(spark, rows)
    for batch_bytes in (1 << 20, 500):
        got = suffixdedup.repeated_passages(docs, batch_bytes)
        assert sorted(key(tuple(r)) for r in got.collect()) == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.without_repeats(docs.filter("doc_id = 0 or doc_id = 57")).collect()}
    assert kept[57] == b"short"
    assert suffixdedup.repeated_passages(docs.limit(0)).count() == 0


def test_very_frequent_passages_and_long_texts(monkeypatch):
    monkeypatch.setattr(suffixdedup, "STRETCH", 256)
    rng = random.Random(9)
    shared = words(rng, 25)
    phrase = words(rng, 7)[:30]
    rows = [(i, words(rng, rng.randint(0, 300)) + shared + words(rng, 5) + phrase + "".join(rng.choice("ab") for _ in range(4)) + shared[:40]) for i in range(14)]
    rows.append((20, "".join(x + phrase for x in ("aa", "ab", "ba", "bb") * 6) + "\0" * 80 + shared))
    rows.append((21, "\0" * 70 + shared[3:] + "\0" * 61))
    rows += [(22, (phrase + shared[:70] + "|") * 9 + "ab" * 80), (23, "ab" * 50 + (shared[:70] + "|") * 5)]
    want = sorted(suffixdedup.brute(rows))
    for frequent, array, run in ((2, 1 << 20, 1 << 14), (64, 1 << 20, 4), (3, 700, 2)):
        monkeypatch.setattr(suffixdedup, "FREQUENT", frequent)
        monkeypatch.setattr(suffixdedup, "ARRAY", array)
        monkeypatch.setattr(suffixdedup, "RUN", run)
        for groups in (1, 2, 5):
            batches = [[r for r in rows if r[0] % 5 == b] for b in range(5)]
            assert _in_process(batches, 5, groups) == want


def _in_process(batches, shards, groups):
    """The five steps without Spark, so that patched limits hold."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tables = {b: pa.table({"batch": pa.array([b] * len(r), pa.int64()), "id": pa.array([i for i, _ in r], pa.int64()), "text": pa.array([t for _, t in r], pa.string())}) for b, r in enumerate(batches)}
    by = lambda t, column: [t.filter(pc.equal(t[column], v)) for v in t[column].unique().to_pylist()]
    listed = pa.concat_tables([suffixdedup.list_anchors(shards)(t) for t in tables.values()])
    kept = pa.concat_tables([suffixdedup.keep_anchors(t) for t in by(listed, "shard")])
    contexts = pa.concat_tables([suffixdedup.cut_contexts(shards, groups)(t, kept.filter(pc.equal(kept["batch"], b))) for b, t in tables.items()])
    for _ in range(2):
        contexts = pa.concat_tables([suffixdedup.settle(n) for t in by(contexts, "level") for n in by(t, "number")])
    verdicts = contexts.select(["batch", "verdicts"])
    out = pa.concat_tables([suffixdedup.remove(t, verdicts.filter(pc.equal(verdicts["batch"], b))) for b, t in tables.items()])
    return sorted(tuple(r.values()) for r in out.to_pylist())


def test_merging_contexts_by_binary_search():
    import numpy as np

    rng = random.Random(10)
    texts = [bytes(rng.choice(b"\0ab") for _ in range(rng.choice([50, 51, 76]))) for _ in range(30)]
    texts += [t[:50] for t in texts] + texts[:9] + [texts[0][:50] + b"\0"]
    raw, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    group = suffixdedup.merged(raw, np.cumsum(length) - length, length)
    assert all((a == b) == (x == y) for a, x in zip(texts, group, strict=True) for b, y in zip(texts, group, strict=True))


def test_suffix_arrays():
    import numpy as np

    from lodestar.llm.suffixes import common_prefixes, suffix_order

    rng = np.random.default_rng(3)
    for n, alphabet in ((0, 2), (1, 2), (7, 1), (8, 1), (9, 1), (60, 2), (400, 3), (300, 255), (2000, 2)):
        raw = rng.integers(0, alphabet, n).astype(np.uint8)
        text = raw.tobytes()
        want = sorted(range(n), key=lambda i: text[i:])
        assert suffix_order(raw).tolist() == want
        if n < 2:
            continue
        shared = [0] + [next((k for k in range(20) if a + k >= n or b + k >= n or text[a + k] != text[b + k]), 20) for a, b in zip(want, want[1:], strict=False)]
        assert common_prefixes(raw, np.array(want), 20).tolist() == shared


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101)], "u long, v long")
    got = {r["node"]: r["label"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100
    assert neardup.components(edges.filter(F.lit(False))).count() == 0
    rng = random.Random(2)
    made = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(400, i) for i in range(401, 460)]
    made = [(u, v) for u, v in made if u != v]
    label = {x: x for e in made for x in e}
    while any(label[u] != label[v] for u, v in made):
        for u, v in made:
            label[u] = label[v] = min(label[u], label[v])
    many = spark.createDataFrame(made, "u long, v long").repartition(5)
    for task_rows in (1000, 60):
        got = neardup.components(many, task_rows).collect()
        assert len(got) == len(label) and {r["node"]: r["label"] for r in got} == label


def test_rare_shingles_find_all_that_are_alike():
    import numpy as np

    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 2, 5, 40, 200):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(12):
            own = base.copy()
            own[rng.random(size) < 0.08] = rng.integers(0, 2**63, 1)
            sets.append(np.unique(own))
    for percent in (80, 50, 100):
        found = {(i, int(k)) for i, places in neardup.alike_pairs(sets, sets, percent) for k in places}
        for i, x in enumerate(sets):
            for k, y in enumerate(sets):
                common = len(set(x.tolist()) & set(y.tolist()))
                assert 100 * common < percent * (len(x) + len(y) - common) or (i, k) in found


def test_a_long_text_is_hashed_in_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodestar.llm import shingles as module

    rng = random.Random(6)
    texts = [words(rng, 300), "x" * 500 + " " + "y" * 90, "", words(rng, 3), "z" * 64]
    raw, offsets = text_buffer(pa.array(texts))
    whole = shingles(raw, offsets, 4)
    monkeypatch.setattr(module, "STRETCH", 64)
    assert all((a == b).all() for a, b in zip(whole, shingles(raw, offsets, 4), strict=True))
    long = np.frombuffer(("word " * 13_000_000).encode(), np.uint8)
    monkeypatch.setattr(module, "STRETCH", 1 << 20)
    assert shingles(long, np.array([0, len(long)]), 5)[1].tolist() == [0, 12_999_996]


def test_two_nodes_left_over_in_a_bucket_are_compared(spark, monkeypatch):
    import numpy as np

    def by_size(hashes, at, bands=24):  # documents of one size share all buckets
        n = np.diff(at)
        return np.repeat(n[n > 0].astype(np.uint64)[:, None], bands, axis=1)

    monkeypatch.setattr(neardup, "band_keys", by_size)
    rng = random.Random(13)
    rows = []
    for g in range(24):
        first = words(rng, 30 + g)
        rows += [(4 * g + i, t) for i, t in enumerate([first, first + "x", words(rng, 30 + g), words(rng, 30 + g)])]
    rows = [(i, " ".join(f"{w}{k}" for k, w in enumerate(t.split()))) for i, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - 1 if i % 4 == 1 else i for i in got}
