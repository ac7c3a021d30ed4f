"""Near-duplicate detection by min-max hashing (operator 2).

Every permutation gives a document its minimum and its maximum, two values for one evaluation.
Bands of four such values find candidates; a candidate is linked only if its full shingle sets
pass (shingles are compared by 64 bits of hash). Documents of equal shingle sets are one node from the start, so copies cost nothing later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, pieces, small_batches, text_buffer, unused
from lodestar.llm.shingles import mixed, permutations, shingles

#: 24 bands of two permutations: a pair at 0.8 is missed by all bands with a chance of 3e-6.
BANDS = 24
#: Bytes of sets of a family's members that one task compares with as many others.
BLOCK_BYTES = 4 << 20
#: Pairs that share a rare shingle, held at once in a block.
PAIRS = 1 << 21
#: Rows of a side, once counted, up to which a join broadcasts it.
SMALL = 500_000
#: Edges in a task of components().
TASK_ROWS = 200_000
#: First nodes of a band bucket that its other members are compared with, one after the other.
ROUNDS = 2
PIECE = 1 << 20


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document and their offsets."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    ends = np.zeros(len(at), np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return (np.concatenate(parts) if parts else hashes[:0]), ends


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def band_keys(hashes: np.ndarray, at: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One row of band keys for each non-empty set; of each permutation both extremes take part."""
    a, b = permutations(2 * bands, 7)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    keys = np.zeros((len(starts), bands), np.uint64)
    if not len(starts):
        return keys
    for i in range(bands):
        for p in (2 * i, 2 * i + 1):
            v = low * a[p] + b[p]
            both = np.minimum.reduceat(v, starts).astype(np.uint64) << np.uint64(32) | np.maximum.reduceat(v, starts)
            keys[:, i] = mixed(keys[:, i] + both + np.uint64(i))
    return keys


def _sketch(width: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                hashes, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                hashes, at = _distinct(hashes, at)
                keys = band_keys(hashes, at, bands)
                n = np.diff(at)
                ends = np.zeros(b - a + 1, np.int32)
                np.cumsum((n > 0) * bands, out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                s1 = _sums(mixed(hashes + np.uint64(1)), at).view(np.int64)
                s2 = _sums(mixed(hashes + np.uint64(0x9E3779B97F4A7C15)), at).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(s1), pa.array(s2), lists], names=["id", "n", "s1", "s2", "bands"])

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                hashes, at = _distinct(*shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width))
                s1 = _sums(mixed(hashes + np.uint64(1)), at).view(np.int64)
                sets = pa.array([hashes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s1), sets], names=["id", "s", "hashes"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _compare() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(u, v, x, y) to (u, v, common, total) of the full sets x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            left, right = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                common[i] = _common(x, y)
                total[i] = len(x) + len(y) - common[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(total)], names=["u", "v", "common", "total"])

    return run


def _rare(sets: list[np.ndarray], vocabulary: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, set) of each set's rarest shingles, of which two sets alike by percent have one in common."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    ranks = rank[np.searchsorted(vocabulary, np.concatenate(sets))]
    order = np.lexsort((ranks, owner))
    within = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    few = order[within <= (sizes - -(-sizes * percent // 100))[owner]]
    return ranks[few], owner[few]


def alike_pairs(asked: list[np.ndarray], among: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every set asked that has any: its place and the places of the sets among that may be alike.

    Shingles are ranked by how many sets of the two lists have them. Sets that are alike share one of
    their first n - percent * n + 1 by rank, and neither is too small for the other."""
    vocabulary, count = np.unique(np.concatenate(asked + among), return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(vocabulary))
    (left, who), (right, whom) = _rare(asked, vocabulary, rank, percent), _rare(among, vocabulary, rank, percent)
    order = np.argsort(right, kind="stable")
    right, whom = right[order], whom[order]
    low = np.searchsorted(right, left)
    many = np.searchsorted(right, left, "right") - low
    own, others = np.array([len(s) for s in asked]), np.array([len(s) for s in among])
    upto = np.cumsum(np.bincount(who, many, len(asked)).astype(np.int64))
    at = np.searchsorted(who, np.arange(len(asked) + 1))
    first = 0
    while first < len(asked):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        some = slice(at[first], at[last])
        n = many[some]
        if n.sum():
            entry = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs = np.unique(np.repeat(who[some], n) * len(among) + whom[entry])
            x, y = pairs // len(among), pairs % len(among)
            fit = 100 * np.minimum(own[x], others[y]) >= percent * np.maximum(own[x], others[y])
            x, y = x[fit], y[fit]
            heads = np.flatnonzero(np.diff(x, prepend=-1))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True):
                yield int(x[a]), y[a:b]
        first = last


def _search_block(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between a block's open members (rest) and its members: of those that would join two
    labels already joined within the block, the first only."""

    def run(block: pa.Table) -> pa.Table:
        rest, node, label = (block.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "node", "label"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in block.column("hashes").chunks for v in c]
        asked, among = np.flatnonzero(rest), np.flatnonzero(~rest)
        found: list[tuple[int, int]] = []
        if len(asked) and len(among):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            for i, places in alike_pairs([sets[i] for i in asked], [sets[i] for i in among], percent):
                own = sets[asked[i]]
                mine = root(int(label[asked[i]]))
                for k in places.tolist():
                    if (theirs := root(int(label[among[k]]))) == mine:
                        continue
                    other = sets[among[k]]
                    common = _common(own, other)
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        parent[max(mine, theirs)] = mine = min(mine, theirs)
                        found.append((int(node[asked[i]]), int(node[among[k]])))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and for each the least node that these edges reach."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return nodes, nodes[least]
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while ((further := least[least]) != least).any():
            least = further


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to (u, v): every node but the least of its part, after that least one."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, least = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        some = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(least[some]), pa.array(nodes[some])], names=["u", "v"])


def components(edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, label) with the least node reachable, for every node of an edge (u, v) of longs; u is not v.

    Every task contracts its own task_rows edges to stars. If there are several tasks, their stars are
    merged by turns: each node's greater neighbours are hung on the least neighbour of all (large
    star), then its lesser ones and itself on the least (small star), until nothing changes. Nodes are
    shuffled, never collected or broadcast; edges don't grow in number; only a count and a checksum
    of the edges reach the driver."""
    edges = cut(edges.select("u", "v"))
    tasks = max(1, -(-edges.count() // task_rows))
    star = cut(edges.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
    mark = None
    while tasks > 1:
        both = star.select(F.col("u").alias("x"), F.col("v").alias("y")).union(star.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("u"))
        large = both.filter("y > x").join(least, "x").select("u", F.col("y").alias("v")).distinct()
        lesser = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lesser, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v")))).alias("e")).select("e.u", "e.v")
        star = cut(small.filter("u != v").distinct().coalesce(tasks))
        now = tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return star.select(F.col("v").alias("node"), F.col("u").alias("label")).union(star.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, node) whose key has several nodes."""
    several = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("key")
    return cut(keys.join(several, "key", "left_semi"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Links hold for 100 * intersection >= percent * union of the full shingle sets. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows of one id are judged each by its
    own text and may differ; equal rows have equal results. A null id takes part in no link: its
    component_id is null and it is kept. An empty table gives no rows. Other columns aren't read.

    The members of a band bucket are compared with the bucket's first node, not with each other.
    Members less than half like it are dealt with anew among themselves, with a first node of their
    own. By the triangle inequality of the Jaccard distance, two that could be linked at 80 percent
    are then both at least 0.3 like one first node: these likenesses make families. What is left of
    a bucket after ROUNDS is a family as it is. A family whose links leave it in several parts is
    searched further: its members outside the largest part, in blocks, against all its members. A
    block of BLOCK_BYTES on either side compares those only that share one of their rarest shingles."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(texts.dtypes)["id"]
    sketches = cut(texts.mapInArrow(_sketch(width, bands), f"id {id_type}, n long, s1 long, s2 long, bands array<long>"))
    nodes = sketches.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = _shared(nodes.select("node", "n", F.explode("bands").alias("key")))

    wanted = cut(members.select("node").distinct().join(nodes, "node").select("node", "id", F.col("s1").alias("s")))
    near = texts.filter("id is not null").join(broadcast_checked(wanted.select("id").distinct(), SMALL), "id", "left_semi")
    sets = near.mapInArrow(_sets(width), f"id {id_type}, s long, hashes binary").join(broadcast_checked(wanted, SMALL), ["id", "s"])
    sets = cut(sets.groupBy("node").agg(F.first("hashes").alias("hashes")))

    family = max(1, 50 - (100 - percent))
    likeness: DataFrame | None = None
    for _ in range(ROUNDS):
        if not members.limit(1).count():
            break
        hubs = members.groupBy("key").agg(F.min(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.*")
        pairs = cut(members.join(hubs, "key").filter("node != hub").withColumn("sized", 100 * F.least("n", "hub_n") >= family * F.greatest("n", "hub_n")))
        # sets of too different sizes are known to be unlike; the greater one isn't copied
        tried = pairs.filter("sized").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        left, right = sets.select(F.col("node").alias("u"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("y"))
        judged = cut(tried.join(right, "v").join(left, "u").select("u", "v", "x", "y").mapInArrow(_compare(), "u long, v long, common long, total long"))
        likeness = judged if likeness is None else likeness.union(judged)
        unlike = judged.filter("100 * common < 50 * total").select(F.col("u").alias("hub"), F.col("v").alias("node"))
        apart = pairs.filter("sized").join(broadcast_checked(cut(unlike), SMALL), ["hub", "node"], "left_semi")
        members = _shared(pairs.filter("not sized").select("node", "n", "key").union(apart.select("node", "n", "key")))

    sized = sketches.drop("bands")
    if likeness is not None:
        links = likeness.filter(100 * F.col("common") >= percent * F.col("total")).select("u", "v")
        labels = components(links)
        left_over = members.join(members.groupBy("key").agg(F.min("node").alias("hub")), "key").filter("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        kin = likeness.filter(100 * F.col("common") >= family * F.col("total")).select("u", "v").union(left_over)
        families = components(kin).withColumnRenamed("label", "family")
        parts = families.join(labels, "node", "left").join(nodes.select("node", "n"), "node")
        parts = cut(parts.select("family", "node", F.coalesce("label", "node").alias("label"), (8 * F.col("n")).alias("bytes")))
        counts = parts.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        most = F.max(F.struct("bytes", "label"))
        open_ = counts.groupBy("family").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), most["bytes"].alias("most"), most["label"].alias("largest"))
        # two nodes were compared already, unless they are only what is left of a bucket
        alone = F.lit(False)
        if members.limit(1).count():
            spared = left_over.select(F.col("u").alias("node")).distinct().join(families, "node").select("family").distinct()
            open_ = open_.join(spared.withColumn("spared", F.lit(True)), "family", "left")
            alone = F.coalesce("spared", F.lit(False))
        open_ = cut(open_.filter((F.col("parts") > 1) & ((F.col("size") > 2) | alone)).select("family", "largest", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.ceil((F.col("bytes") - F.col("most")) / BLOCK_BYTES).cast("int").alias("rests")))
        if open_.limit(1).count():
            inside = cut(parts.join(broadcast_checked(open_, SMALL), "family"))
            inside = sets.join(broadcast_checked(inside, SMALL), "node")
            hashed = F.xxhash64("node")
            among = inside.withColumn("rest", F.lit(False)).withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
            asked = inside.filter("label != largest").withColumn("rest", F.lit(True)).withColumn("part", F.pmod(hashed, F.col("rests")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            columns = ["family", "block", "part", "rest", "node", "label", "hashes"]
            more = cut(among.select(columns).union(asked.select(columns)).repartition("family", "block", "part").groupBy("family", "block", "part").applyInArrow(_search_block(percent), "u long, v long"))
            if more.limit(1).count():
                labels = components(links.union(more))
        named = nodes.select("node", "s1", "s2", "n", "id", "copies").join(broadcast_checked(labels, SMALL), "node", "left")
        least = named.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"))
        named = named.join(broadcast_checked(cut(least), SMALL), "label", "left").filter("copies > 1 or label is not null")
    else:
        named = nodes.filter("copies > 1").withColumn("least", F.col("id"))
    known = cut(named.select("s1", "s2", "n", F.coalesce("least", "id").alias("component")))
    out = sized.join(broadcast_checked(known, SMALL), ["s1", "s2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their columns, which may have any names.

    Of an id that several rows have, one row stays (by a hash of its text) if any of them is kept.
    Rows with a null id have no identity to be compared by and stay; keep_rows() judges each row."""
    own, place = unused(docs, "kept_id", "place")
    marks = near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col).filter("doc_id is not null")
    ids = cut(marks.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("any")).filter("rows > 1 or not any"))
    apart = broadcast_checked(ids.select(F.col("doc_id").alias(own)), SMALL)
    again = broadcast_checked(ids.filter("any").select(F.col("doc_id").alias(own)), SMALL)
    single = docs.join(apart, docs[id_col] == F.col(own), "left_anti")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col)
    several = docs.join(again, docs[id_col] == F.col(own), "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
    return single.unionByName(several)


def keep_rows(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of every component, with its columns, which may have any names: that of the least id, null last, else the first.

    Rows are told apart by their place in the scan, so docs must be read from a file or checkpoint
    (or mapped from one row by row); null and repeated ids are judged each by its own text."""
    small_batches(docs.sparkSession)
    (row,) = unused(docs, "row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    plain = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = cut(near_duplicates(plain, width, percent, id_col="row", text_col="text").select("doc_id", "component_id", "kept"))
    several = broadcast_checked(cut(marks.filter("not kept").select("component_id").distinct()), SMALL)
    members = marks.join(several, "component_id", "left_semi").select(F.col("doc_id").alias("row"), "component_id")
    named = cut(plain.select("row", "id").join(broadcast_checked(cut(members), SMALL), "row"))
    chosen = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("chosen"))
    gone = cut(named.join(chosen, "component_id").filter(F.col("row") != F.col("chosen")).select(F.col("row").alias(row)))
    return keyed.join(broadcast_checked(gone, SMALL), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB's form of near_duplicates() with its default parameters.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y)
SELECT n.doc_id, n.n AS n_shingles, min(reach.y) AS component_id, n.doc_id = min(reach.y) AS kept FROM n JOIN reach ON reach.x = n.doc_id GROUP BY n.doc_id, n.n
"""
