"""Merkle manifest of a dataset by superblock reduction (operator 11).

Every row is a leaf, the leaves of a tree column's value form one tree, the trees' roots form one more,
whose root stands for the dataset. Nodes are dealt into buckets by index / fanout ** levels; one task
collapses `levels` levels of a bucket to its root, and the bucket roots are reduced likewise until a
tree has one node. Then proofs go down the same way: a bucket's nodes get their siblings inside the
bucket, followed by those of the bucket's root. No task holds more than a bucket, no tree is collected."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import broadcast_checked, cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that a bucket collapses.
FANOUT, LEVELS = 8, 4
#: Rows of a side, once counted, up to which a join broadcasts it.
SMALL = 200_000
#: A value of the tree column as a name: null comes first, the others in the order of their bytes.
_NULL, _MARK = "-", "="


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values: list[Column]) -> Column:
    """The values joined, each as `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(encoded(values), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof, an array of structs (before, after)."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """The proof's sibling hashes, joined level by level and left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with `at`, their number within the tree in this order, and `n`, how many it has.

    Rows are dealt by ranges of the order, so that a tree of most rows spreads over tasks; each range
    counts its own trees, and running sums over the ranges shift the counts."""
    placed = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    ranges = placed.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("count"))
    tree = Window.partitionBy("tree")
    upto = F.sum("count").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    shifts = cut(ranges.select("tree", "part", (upto - F.col("count") - F.col("first")).alias("shift"), F.sum("count").over(tree).alias("n")))
    out = placed.withColumn("part", part).join(broadcast_checked(shifts, SMALL), ["tree", "part"])
    return out.withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def runs(hashes: list[str], fanout: int) -> list[str]:
    """The nodes above: each run of fanout hashes as one."""
    return [sha256_hex("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]


def _collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket's nodes (tree, bucket, at, n, hash) to its root; levels end where the tree has one node."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        hashes, n = nodes.sort_values("at")["hash"].tolist(), int(nodes["n"].iat[0])
        for _ in range(levels):
            if n > 1:
                hashes, n = runs(hashes, fanout), -(-n // fanout)
        return pd.DataFrame({"tree": nodes["tree"].iloc[:1].array, "at": nodes["bucket"].iloc[:1].array, "n": [n], "hash": hashes})

    return run


def _extend(fanout: int, levels: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's nodes and the chain above its root to these columns of the nodes and their own chains."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.take(pc.sort_indices(nodes.column("at")))
        hashes, n = nodes.column("hash").to_pylist(), nodes.column("n")[0].as_py()
        lower: list[tuple[list[str], list[str]]] = []
        while n > 1 and len(lower) < levels:
            before, after = [], []
            for i in range(0, len(hashes), fanout):
                own = hashes[i : i + fanout]
                joined = "".join(own)
                before += [joined[: 64 * k] for k in range(len(own))]
                after += [joined[64 * k + 64 :] for k in range(len(own))]
            lower.append((before, after))
            hashes, n = runs(hashes, fanout), -(-n // fanout)
        columns = []
        for side, name in enumerate(("before", "after")):
            chains = [above.column(name)[0].as_py()]
            for level in reversed(lower):
                chains = [[x, *chains[i // fanout]] for i, x in enumerate(level[side])]
            columns.append(pa.array(chains, pa.list_(pa.string())))
        tops = pa.array([above.column("tops")[0].as_py()] * len(nodes), pa.list_(pa.string()))
        return pa.Table.from_arrays([*(nodes.column(c) for c in names), *columns, tops], names=[*names, "before", "after", "tops"])

    return run


class Reduction:
    """Trees of nodes (tree, at, n, hash, ...) reduced step by step; only whether a step has work reaches the driver."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int):
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels
        self.steps = [nodes]
        while True:
            open_ = self.steps[-1].filter("n > 1")
            if not open_.limit(1).count():
                break
            dealt = open_.select("tree", self._bucket(), "at", "n", "hash")
            self.steps.append(cut(dealt.groupBy("tree", "bucket").applyInPandas(_collapse(fanout, levels), "tree string, at long, n long, hash string")))

    def _bucket(self) -> Column:
        return F.floor(F.col("at") / F.lit(self.width)).cast("long").alias("bucket")

    def tops(self) -> DataFrame:
        """(tree, hash): every tree's root."""
        out = None
        for step in self.steps:
            own = step.filter("n = 1").select("tree", "hash")
            out = own if out is None else out.unionByName(own)
        return cut(out)

    def chains(self, above: DataFrame) -> DataFrame:
        """The first step's nodes with before and after, the siblings level by level up to the dataset's
        root, and tops, the roots on the way. above: those of the trees' roots (tree, before, after, tops)."""
        names, parents = ["tree", "at"], None
        for k in range(len(self.steps) - 1, -1, -1):
            nodes = self.steps[k]
            if not k:
                names = [c for c in nodes.columns if c != "n"]
            alone = nodes.filter("n = 1").join(broadcast_checked(above, SMALL), "tree").select(*names, "before", "after", "tops")
            if parents is None:
                parents = alone
                continue
            kept = T.StructType([nodes.schema[c] for c in names])
            schema = T.StructType([*kept.fields, *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("before", "after", "tops"))])
            dealt = nodes.filter("n > 1").withColumn("bucket", self._bucket()).groupBy("tree", "bucket")
            parents = dealt.cogroup(parents.groupBy("tree", "at")).applyInArrow(_extend(self.fanout, self.levels, names), schema).unionByName(alone)
        return parents


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and what is carried (name to expression of docs).

    proof lists the levels from the leaf's to the dataset's root, each with the hashes `before` and
    `after` the node in its run, joined; fold(leaf, proof) gives root. Leaves of a tree ascend by id
    (null first), those of one id by leaf; equal rows have equal leaves, and each its own place. Null is a tree of its
    own, the first. Nulls and empty texts differ as leaves. A single row is leaf, subroot and root with
    an empty proof; an empty table gives no rows. Columns not named aren't read and may have any names.
    The text is read once: leaves are checkpointed, and whatever follows moves hashes only."""
    carried = dict(carry or {})
    columns = {f"carried{k}": c for k, c in enumerate(carried.values())}
    tree = F.coalesce(F.concat(F.lit(_MARK), F.col(tree_col).cast("string")), F.lit(_NULL)).alias("tree")
    leaves = cut(docs.select(tree, F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in fields]).alias("hash"), *[c.alias(name) for name, c in columns.items()]))
    trees = Reduction(numbered(leaves, ["id", "hash"]), fanout, levels)
    subroots = numbered(trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    whole = Reduction(subroots, fanout, levels)
    none = F.array().cast("array<string>")
    over = whole.tops().select("tree", none.alias("before"), none.alias("after"), F.array("hash").alias("tops"))
    above = whole.chains(over).select(F.col("name").alias("tree"), "before", "after", F.concat(F.array("hash"), "tops").alias("tops"))
    rows = trees.chains(cut(above))
    proof = F.zip_with("before", "after", lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), proof.alias("proof"), *[F.col(c).alias(n) for c, n in zip(columns, carried, strict=True)]
    )


def tampered_leaf(fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text's A-Z were lower-cased if 3 divides the id's CRC-32, else its own."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf_hash([lower if c == "text" else F.col(c) for c in fields])
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed).otherwise(leaf_hash([F.col(c) for c in fields]))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether each row as tampered with still folds to the root."""
    rows = manifest(docs, carry={"tampered": tampered_leaf()})
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("proof")), 256), "folded_root": fold(F.col("tampered"), F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def brute(rows: list[tuple], tree_at: int = 2, fanout: int = FANOUT) -> dict[int, tuple[str, str, str, list[str]]]:
    """Row number to (leaf, subroot, root, siblings) by whole lists, for tests; rows are tuples of FIELDS."""
    leaf = [sha256_hex("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]

    def climb(nodes: list[tuple[str, list[int]]], found: dict[int, list[str]]) -> str:
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), fanout):
                run = nodes[i : i + fanout]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        found[m] += [h for j, (h, _) in enumerate(run) if j != k]
                up.append((sha256_hex("".join(h for h, _ in run)), [m for _, ms in run for m in ms]))
            nodes = up
        return nodes[0][0]

    found: dict[int, list[str]] = {i: [] for i in range(len(rows))}
    names = sorted({r[tree_at] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {t: sorted((i for i, r in enumerate(rows) if r[tree_at] == t), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i])) for t in names}
    sub = {t: climb([(leaf[i], [i]) for i in members[t]], found) for t in names}
    root = climb([(sub[t], members[t]) for t in names], found) if names else ""
    return {i: (leaf[i], sub[r[tree_at]], root, found[i]) for i, r in enumerate(rows)}


def audit_sql(levels: int = 9) -> str:
    """DuckDB's form of audited(), for unique ids and up to 8 ** levels rows of a language."""
    def code(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(code(text if c == "text" else c) for c in FIELDS) + ")"

    parts, joins, befores, afters = [], "", [], []
    for tree, start, depth in (("l", "leaves", levels), ("r", "tops", levels)):
        last = start
        for k in range(depth):
            parts.append(f"{tree}{k} AS (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {last})")
            parts.append(
                f"{tree}p{k} AS (SELECT a.tree, a.pos, string_agg(CASE WHEN b.pos < a.pos THEN b.h END, '' ORDER BY b.pos) AS x, string_agg(CASE WHEN b.pos > a.pos THEN b.h END, '' ORDER BY b.pos) AS y"
                f" FROM {tree}{k} a JOIN {tree}{k} b ON b.tree = a.tree AND b.pos // 8 = a.pos // 8 WHERE a.n > 1 GROUP BY ALL)"
            )
            last = f"{tree}u{k}"
            parts.append(f"{last} AS (SELECT tree, pos // 8 AS pos, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {tree}{k} GROUP BY tree, pos // 8)")
            place = f"l.pos // {8**k}" if tree == "l" else f"t.pos // {8**k}"
            joins += f" LEFT JOIN {tree}p{k} ON {tree}p{k}.tree = {'l.tree' if tree == 'l' else 't.tree'} AND {tree}p{k}.pos = {place}"
            befores.append(f"{tree}p{k}.x")
            afters.append((f"{tree}p{k}.tree", f"{tree}p{k}.y"))
        if tree == "l":
            parts.append(f"subs AS (SELECT tree AS name, h FROM {last})")
            parts.append("tops AS (SELECT '' AS tree, name, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS pos, h FROM subs)")
        else:
            parts.append(f"root AS (SELECT h FROM {last})")
    steps = ", ".join(f"CASE WHEN {have} IS NULL THEN NULL ELSE {{'b': coalesce({b}, ''), 'a': coalesce({a}, '')}} END" for b, (have, a) in zip(befores, afters, strict=True))
    crc = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda crc, bits: xor(xor(crc, bits) >> 1, 3988292384::BIGINT * (xor(crc, bits) & 1))))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, {leaf("text")} AS h,
         CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS tampered
  FROM documents
), {", ".join(parts)},
w AS (
  SELECT l.doc_id, l.h AS leaf, t.h AS subroot, (SELECT h FROM root) AS root, l.tampered, list_filter([{steps}], lambda s: s IS NOT NULL) AS proof
  FROM leaves l JOIN tops t ON t.name = l.tree{joins}
), f AS (
  SELECT *, CASE WHEN len(proof) = 0 THEN tampered ELSE list_reduce(list_prepend({{'b': '', 'a': tampered}}, proof), lambda acc, s: {{'b': '', 'a': sha256(s.b || acc.a || s.a)}}).a END AS folded_root FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
