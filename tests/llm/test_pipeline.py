import hashlib
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_shingle_operators import near_brute, shingle_set

import corpus_pipeline as pipeline
from lodestar.llm import decontam, langid, neardup, sharding
from lodestar.llm import queries as corpus
from lodestar.llm.common import BATCH_BYTES, BATCH_SETTING, text_buffer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("the and of ing tion er ou".split()) for _ in range(2)) for _ in range(n))
    rows = [(i, say(rng.randint(20, 60)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " x", "en", "s1"), (102, "123 456", "en", "s2"), (103, None, "en", None)]
    items = [(0, say(30)), (1, say(12))]
    rows += [(104, say(30) + " " + items[0][1] + " " + say(30), "en", "s0")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    first = pipeline.identify_language(spark, docs, folder)
    assert ids(first) == [i for i in ids(docs) if i not in (102, 103)] and first.columns == columns
    second = pipeline.drop_near_duplicates(spark, first, folder)
    assert ids(second) == [i for i in ids(first) if i not in (100, 101)] and second.columns == columns
    third = pipeline.decontaminate(spark, second, folder)
    assert ids(third) == [i for i in ids(second) if i != 104] and third.columns == columns
    fourth = pipeline.mix_sources(spark, third, folder)
    assert set(ids(fourth)) <= set(ids(third)) and fourth.columns == columns and fourth.count() >= 30
    last = pipeline.assign_shards(spark, fourth, folder)
    assert ids(last) == ids(fourth)
    whole = pipeline.run(spark, folder)
    assert sorted(map(str, whole.select("doc_id", "shard").collect())) == sorted(map(str, last.select("doc_id", "shard").collect()))


def brute_copies(rows):
    """How often systematic sampling draws each (id, source, size), by one running sum a source."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if now[s] > 3 * sizes[s]]
        if not above:
            target |= now
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= set(above)
    out = {}
    for number, source in enumerate(order, 1):
        own = sorted((len(f"{n:b}") * 8 + (n >> max(0, len(f"{n:b}") - 4) & 7), int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16), n, i) for i, s, n in rows if s == source)
        step = int(target[source] / sizes[source] * 2**24) if sizes[source] else 0
        at = int(hashlib.md5(f"mix/{number}".encode()).hexdigest()[:6], 16)
        for *_, i in own:
            out[i] = (at + step) // 2**24 - at // 2**24
            at += step
    return out


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda d: sorted((r["doc_id"], r["text"]) for r in d.collect())
    first = pairs(pipeline.identify_language(spark, docs, folder))
    held = docs.filter(F.col("doc_id").isin([i for i, _ in first]))
    second = pairs(pipeline.drop_near_duplicates(spark, held, folder))
    marks = near_brute(first, width=5)
    assert [i for i, _ in second] == [key[1] for key, _, _, kept in marks if kept] and len(second) < len(first)
    held = docs.filter(F.col("doc_id").isin([i for i, _ in second]))
    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    third = pairs(pipeline.decontaminate(spark, held, folder))
    assert third == [(i, t) for i, t in second if not any(100 * len(s & shingle_set(t, 5)) >= 80 * len(s) for s in items)] and len(third) < len(second)
    held = docs.filter(F.col("doc_id").isin([i for i, _ in third]))
    fourth = pipeline.mix_sources(spark, held, folder)
    copies = brute_copies([(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in held.collect()])
    assert sorted(r["doc_id"] for r in fourth.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    last = pipeline.assign_shards(spark, fourth, folder).collect()
    assert all(r["shard"] == sharding.brute(r["doc_id"], corpus.TREE) and r["grown_shard"] == sharding.brute(r["doc_id"], corpus.GROWN) for r in last)
    slots = {}
    for r in last:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.QUERIES) == list(range(1, 14))
    assert set(corpus.SQL) <= set(corpus.QUERIES)


def test_near_sql_and_queries_agree(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    for name in corpus.SQL:
        got = corpus.QUERIES[name](spark, folder)
        want = connection.execute(corpus.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def test_parameters():
    assert (neardup.BANDS, decontam.PERMUTATIONS, langid.ORDER) == (24, 64, 4)


def test_null_and_repeated_ids_are_judged_by_their_texts(spark, folder, tmp_path):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("the and of ing tion er ou".split()) for _ in range(2)) for _ in range(n))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    own = [say(40) for _ in range(4)]
    rows = [(None, own[0]), (5, own[0]), (None, own[0] + " x"), (6, own[1]), (6, own[2]), (None, own[3]), (None, f"{say(20)} {item}"), (6, f"{item} {say(20)}"), (None, None), (None, None)]
    spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = lambda d: sorted(((r["doc_id"] or 0, r["text"] or "") for r in d.collect()))
    once = pipeline.drop_near_duplicates(spark, docs, folder)
    assert got(once) == sorted((i or 0, t or "") for k, (i, t) in enumerate(rows) if k not in (0, 2))
    clean = pipeline.decontaminate(spark, once, folder)
    assert got(clean) == sorted((i or 0, t or "") for k, (i, t) in enumerate(rows) if k not in (0, 2, 6, 7))


def test_run_writes_and_rereads_every_stage(spark, folder, monkeypatch):
    seen = []

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen.append((name, {f.split("/")[-2] for f in docs.inputFiles()}))
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(pipeline, "STAGES", [watched(*s) for s in pipeline.STAGES])
    assert pipeline.run(spark, folder).count() > 0
    names = [n for n, _ in pipeline.STAGES]
    assert seen == list(zip(names, [{"documents.parquet"}, *({n} for n in names)], strict=False))


@pytest.mark.parametrize("stage", [pipeline.identify_language, pipeline.drop_near_duplicates, pipeline.decontaminate])
def test_python_gets_texts_in_small_batches(spark, folder, tmp_path, stage):
    row = F.struct(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 400).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    spark.range(0, 4000, 1, 1).select(row.alias("r")).select("r.*").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(BATCH_SETTING)
    try:
        stage(spark, docs, folder)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert 10_000_000 < sum(r["n"] for r in sizes) and max(r["n"] for r in sizes) <= 1.5 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, "1000000")
        stage(spark, docs, folder)
        assert spark.conf.get(BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_filters_of_few_items_are_small():
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choice("the and of ing tion er ou".split()) for _ in range(3)) for _ in range(n))
    items = [say(n) for n in (6, 9, 20, 30, 50, 90) for _ in range(20)]
    index = decontam.ItemIndex(list(range(len(items))), items, 5, 80)
    assert len(index.classes) == 4 and len(pickle.dumps(index)) < 1_000_000
    texts = [f"{say(30)} {item} {say(30)}" for item in items] + [say(200) for _ in range(50)]
    sets = [shingle_set(t, 5) for t in items]
    want = [(d, i) for d, t in enumerate(texts) for i, s in enumerate(sets) if 100 * len(s & shingle_set(t, 5)) >= 80 * len(s)]
    raw, offsets = text_buffer(pa.array(texts))
    assert [hit[:2] for hit in index.find(np.array(raw), offsets)] == want and len(want) >= len(items)
