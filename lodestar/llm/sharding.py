"""Sharding by a hierarchical weighted hash tree (operator 9).

A key descends from the root to a region, a rack and a shard. At every node its children race: each
draws an exponential arrival time of the rate of its weight from a hash of the key and the child's
name, and only the winner is entered. A node's weight is the sum of its shards' weights."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, md5_bits

#: Rows a shard's numbering puts into one task are a shard's rows over this.
SUB_BUCKETS = 256
DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.region}/{self.rack}/{self.shard}"


@dataclass(frozen=True)
class Tree:
    """Shards that were planned together, and shards that were grown since.

    A changed weight alters the draws of the nodes above its shard alone, so rows move only into
    that subtree or out of it. A region that grows by a shard is held as a race between its former
    self, whose weight and draw stay, and the new shard: a row goes to the new shard or stays where
    it was. Each grown shard costs a draw more; planning all anew makes them part of their racks."""

    planned: tuple[Leaf, ...]
    grown: tuple[Leaf, ...] = ()

    def grow(self, leaf: Leaf) -> Tree:
        return replace(self, grown=(*self.grown, leaf))

    def reweighted(self, weights: dict[int, float]) -> Tree:
        """The tree with other weights for some shards."""
        change = lambda leaves: tuple(replace(x, weight=weights.get(x.shard, x.weight)) for x in leaves)
        return Tree(change(self.planned), change(self.grown))


def uniform_leaf(shard: int, shards_per_rack: int = 5, racks_per_region: int = 4) -> Leaf:
    per_region = shards_per_rack * racks_per_region
    return Leaf(shard // per_region, shard % per_region // shards_per_rack, shard)


def uniform_tree(n: int) -> Tree:
    """n equal shards."""
    return Tree(tuple(uniform_leaf(s) for s in range(n)))


def levels(leaves: tuple[Leaf, ...]) -> list[list[list[tuple[int, str, float]]]]:
    """For the root, each region and each rack: its children's place in the next level, name and weight.

    In the last level a shard's own number stands for its place. Leaves without weight are left out."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("the tree needs a planned shard of positive weight")
    regions = sorted({x.region for x in live})
    racks = sorted({(x.region, x.rack) for x in live})
    total = lambda chosen: float(sum(x.weight for x in chosen))
    return [
        [[(i, f"{r}", total(x for x in live if x.region == r)) for i, r in enumerate(regions)]],
        [[(i, f"{g}/{r}", total(x for x in live if (x.region, x.rack) == (g, r))) for i, (g, r) in enumerate(racks) if g == region] for region in regions],
        [[(x.shard, x.name, float(x.weight)) for x in sorted(live, key=lambda x: x.shard) if (x.region, x.rack) == rack] for rack in racks],
    ]


def _arrival(key: Column, name: Column, weight: Column, seed: str) -> Column:
    u = (md5_bits(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), key), DIGITS).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def _race(key: Column, entrants: list[tuple[Column, Column, Column]], seed: str) -> Column:
    """struct(draw, at) of the first to arrive among (place, name, weight); a null name takes no part, equal draws go to the lesser place."""
    runs = [F.when(name.isNotNull(), F.struct(_arrival(key, name, weight, seed).alias("draw"), at.alias("at"))) for at, name, weight in entrants]
    return runs[0] if len(runs) == 1 else F.least(*runs)


def assigned(rows: DataFrame, key: Column, trees: dict[str, Tree], seed: str = "shards") -> DataFrame:
    """rows with a column for each tree, the key's shard in it. Trees of the same planned shards share one descent.

    Each level is a column of its own, so that a draw is taken for the children of the entered node only."""
    out = rows
    for number, planned in enumerate(dict.fromkeys(t.planned for t in trees.values())):
        names = [f"__{level}{number}" for level in ("region", "rack", "shard")]
        at = F.lit(0)
        for name, nodes in zip(names, levels(planned), strict=True):
            own = [F.array(*[F.array(*[F.lit(child[k]) for child in node]) for node in nodes]) for k in range(3)]
            entrants = [tuple(F.get(F.get(column, at), F.lit(j)) for column in own) for j in range(max(map(len, nodes)))]
            out = out.withColumn(name, _race(key, entrants, seed))
            at = F.col(f"{name}.at")
        for column, tree in trees.items():
            if tree.planned != planned:
                continue
            shard = F.col(f"{names[2]}.at")
            added = [x for x in tree.grown if x.weight > 0]
            if added:
                new = f"__new{number}{column}"
                out = out.withColumn(new, _race(key, [(F.lit(x.shard), F.lit(x.name), F.lit(float(x.weight))) for x in added], seed))
                shard = F.when(F.col(f"{new}.draw") < F.col(f"{names[0]}.draw"), F.col(f"{new}.at")).otherwise(shard)
            out = out.withColumn(column, shard.cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in [*rows.columns, *trees]])


def number_within(df: DataFrame, group: str, order: list[str], sub: Column, name: str, subs: int = SUB_BUCKETS) -> DataFrame:
    """Adds a gapless 0-based number within `group`.

    Each group is cut into sub-buckets which are numbered apart and then shifted by the rows of
    the group's earlier sub-buckets, so no task holds a whole group."""
    held = df.withColumn("__sub", sub)
    counts = held.groupBy(group, "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(counts.select(group, "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")))
    within = Window.partitionBy(group, "__sub").orderBy(*order)
    return (
        held.withColumn("__at", F.row_number().over(within))
        .join(broadcast_checked(shifts, 200 * subs), [group, "__sub"])
        .withColumn(name, (F.col("__shift") + F.col("__at") - 1).cast("long"))
        .drop("__sub", "__at", "__shift")
    )


def shard(docs: DataFrame, tree: Tree, grown: Tree, id_col: str = "doc_id", text_col: str = "text", seed: str = "shards") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `key`: id and tree alone decide. A null text has no bytes (size 16, crc 0); rows of one id,
    null included (it hashes as the empty string), share a shard and take slots of their own; an
    empty table gives no rows; columns other than id and text are not read. The few numbers of a
    row are checkpointed, so that texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = cut(assigned(rows, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), {"shard": tree, "grown_shard": grown}, seed))
    # repeated ids: their sizes and checksums take part so that they don't meet in one sub-bucket
    sub = md5_bits(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"), 8) % SUB_BUCKETS
    out = number_within(rows, "shard", ["doc_id", "size", "text_crc32"], sub, "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def moved_share(docs: DataFrame, old: Tree, new: Tree, id_col: str = "doc_id") -> DataFrame:
    """One row: rows, and rows whose shard differs between two trees."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    both = assigned(docs.select(key.alias("key")), F.col("key"), {"old": old, "new": new})
    return both.select((F.col("old") != F.col("new")).cast("long").alias("m")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("moved"))


def brute(doc_id, tree: Tree, seed: str = "shards") -> int:
    """The same law in plain Python, for tests."""

    def draw(name: str, weight: float) -> float:
        digest = hashlib.md5(f"{seed}/{name}/{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return -math.log((int(digest[:DIGITS], 16) + 0.5) / 16**DIGITS) / weight

    node = [x for x in tree.planned if x.weight > 0]
    best = None
    for part in (lambda x: f"{x.region}", lambda x: f"{x.region}/{x.rack}", lambda x: x.name):
        children: dict[str, list[Leaf]] = {}
        for leaf in node:
            children.setdefault(part(leaf), []).append(leaf)
        first = min(children, key=lambda name: draw(name, sum(x.weight for x in children[name])))
        best = best or draw(first, sum(x.weight for x in children[first]))
        node = children[first]
    arrivals = [(best, node[0].shard)] + [(draw(x.name, x.weight), x.shard) for x in tree.grown if x.weight > 0]
    return min(arrivals)[1]


def shard_sql(tree: Tree, grown: Tree, seed: str = "shards") -> str:
    """DuckDB's form of shard() for two trees of the same planned shards; CRC-32 goes bit by bit."""
    rows = [(level, parent, at, name, weight) for level, nodes in enumerate(levels(tree.planned)) for parent, node in enumerate(nodes) for at, name, weight in node]
    rows += [(3, 0, x.shard, x.name, float(x.weight)) for x in grown.grown]
    nodes = ", ".join(f"({level}, {parent}, {at}, '{name}', {weight!r}::DOUBLE)" for level, parent, at, name, weight in rows)
    race = lambda level, source, parent: f"SELECT {source}.key, arg_min(d.child, d.draw) AS child, min(d.draw) AS draw FROM {source} JOIN draws d ON d.key = {source}.key AND d.level = {level} AND d.parent = {parent} GROUP BY 1"
    return f"""
WITH n(level, parent, child, name, weight) AS (VALUES {nodes}),
t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents),
k AS (SELECT DISTINCT key FROM t),
draws AS (SELECT key, level, parent, child, -ln((('0x' || substr(md5('{seed}/' || name || '/' || key), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {float(16**DIGITS)!r}::DOUBLE) / weight AS draw FROM k, n),
a AS ({race(0, "k", "0")}), b AS ({race(1, "a", "a.child")}), c AS ({race(2, "b", "b.child")}), g AS ({race(3, "k", "0")}),
s AS (
  SELECT t.doc_id, (octet_length(encode(t.text)) + 16)::BIGINT AS size, c.child AS shard, CASE WHEN g.draw < a.draw THEN g.child ELSE c.child END AS grown_shard, t.key,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(t.text)), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda crc, bits: xor(xor(crc, bits) >> 1, 3988292384::BIGINT * (xor(crc, bits) & 1)))) AS text_crc32
  FROM t JOIN a USING (key) JOIN c USING (key) JOIN g USING (key)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || '/' || size || '/' || text_crc32), 1, 8))::BIGINT % {SUB_BUCKETS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM s
"""
