"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf. Leaves of a group (here a language) stand in id order; every two
consecutive nodes become one until one is left, the group's subroot. Subroots, in group
order, give the root by the same rule.

Leaves are sorted by range and numbered from the offsets of the written files, so no window
sees a whole group. A leaf partition is an aligned run of ``1 << BLOCK_LEVELS`` leaves. Only
nodes above those partitions are stored; what lies inside one is derived again from its leaves.
To prove its leaves, a partition computes which node coordinates it misses (``octopus``: the
union over all its leaves, without those derivable from them), all partitions fetch theirs by
one join, and each derives the shared inner nodes once and expands single proofs locally.
Nodes near the root are wanted by many partitions: the join key carries a salt, so no key
meets more than ``1 << SALT_LEVELS`` requests.

Null columns are written as ``-``. A null group is a group of its own, before all others; null
ids come first in theirs and are never tampered with. Ties of ids stand in the order of their
leaf hashes, and repeated rows, whose leaves are equal, in any order. Empty texts are values
of no bytes, very long ones are hashed by Spark in the scan and go no further. An empty table
gives no rows. Only the five columns of the leaf are read; others, whatever their names, are
not. A group holds up to 2**62 leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.staging import stage
from riskframe.llm.text import with_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 9
SALT_LEVELS = 10
#: Levels of the tree over the subroots are numbered from here in a partition's fetched rows.
_HEAD = 100
_NODE = "g string, n bigint, level int, idx bigint, hash string"


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return max(0, (n - 1).bit_length())


def width(n: int, level: int) -> int:
    """Nodes on a level over ``n`` leaves."""
    return -(-n >> level)


def join_hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def octopus(leaves: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The coordinates (level, index) that must be fetched to prove ``leaves`` of a tree over ``n``.

    The union over all their proofs, without the nodes that the leaves themselves give.
    """
    known, missing = sorted(set(leaves)), []
    for level in range(height(n)):
        have, last = set(known), width(n, level)
        missing += [(level, i ^ 1) for i in known if i ^ 1 not in have and i ^ 1 < last]
        known = sorted({i >> 1 for i in known})
    return missing


def grow(known: dict[int, str], n: int, level: int, levels: int,
         fetched: dict[tuple[int, int], str] | None = None) -> Iterator[dict[int, str]]:
    """The nodes of the next ``levels`` levels over those ``known`` on ``level``.

    Siblings come from ``known`` or ``fetched``; a node without a sibling on its level is hashed alone.
    Each level's mapping is completed with the fetched siblings before the next is derived.
    """
    for at in range(level, level + levels):
        last = width(n, at)
        for i in list(known):
            if i ^ 1 < last and i ^ 1 not in known:
                known[i ^ 1] = (fetched or {})[at, i ^ 1]
        up = {}
        for i in known:
            if i >> 1 not in up:
                left, right = known[i & ~1], known.get(i | 1, "")
                up[i >> 1] = join_hash(left, right)
        known = up
        yield known


def siblings(path: int, n: int, levels: Sequence[dict[int, str]]) -> list[tuple[str, bool]]:
    """(hash, stands left) of the siblings of leaf ``path``, by level; levels[0] holds leaves."""
    out = []
    for at in range(height(n)):
        i = (path >> at) ^ 1
        if i < width(n, at):
            out.append((levels[at][i], not i & 1))
        else:
            out.append(("", False))
    return out


def fold(leaf: str, proof: Iterable[tuple[str, bool]]) -> str:
    """The root that a leaf and its siblings give."""
    for other, left in proof:
        leaf = join_hash(other, leaf) if left else join_hash(leaf, other)
    return leaf


def leaf_hash(columns: Sequence[Column]) -> Column:
    """H of the columns, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def place(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a group ``g``) numbered from 0 in each group: adds ``idx`` and the group's size ``n``.

    The rows are written in order of (g, *order) by range; a row's number is its index in its
    file plus the rows of its group in files before.
    """
    keys = ["g", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    staged = stage(ranged, "ordered")
    at = staged.metadataColumn("_metadata")
    t = staged.select("*", at["file_name"].alias("file"), at["row_index"].alias("_at"))
    spans = t.groupBy("g", "part", "file").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    files = Window.partitionBy("g").orderBy("part", "file")
    spans = stage(spans.select(
        "g", "part", "file", "_first",
        F.coalesce(F.sum("_rows").over(files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("g")).alias("n"),
    ), "spans")
    return t.join(spans, ["g", "part", "file"]).select(
        *rows.columns, "n", (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"))


def _grown(level: int, whole: bool, block_levels: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes above one block of nodes of ``level``: all of them (``whole``) or the topmost."""
    def run(table: pa.Table) -> pa.Table:
        g, n = table["g"][0].as_py(), table["n"][0].as_py()
        known = dict(zip(table["idx"].to_pylist(), table["hash"].to_pylist()))
        levels = min(block_levels, height(n) - level)
        made = [(level + 1 + k, i, h) for k, up in enumerate(grow(known, n, level, levels)) for i, h in up.items()]
        if not whole:
            top = level + levels
            made = [m for m in made if m[0] == top] or [(level, i, h) for i, h in known.items()]
        return pa.table({
            "g": pa.array([g] * len(made), pa.string()), "n": pa.array([n] * len(made), pa.int64()),
            "level": pa.array([m[0] for m in made], pa.int32()), "idx": pa.array([m[1] for m in made], pa.int64()),
            "hash": pa.array([m[2] for m in made], pa.string()),
        })

    return run


@dataclass(frozen=True)
class Tree:
    """Placed ``leaves`` (g, idx, n, hash and more) and the ``nodes`` above their blocks."""

    leaves: DataFrame
    nodes: DataFrame
    block_levels: int

    def tops(self) -> DataFrame:
        """The root (g, hash) of each group."""
        return self.nodes.where(F.col("level") == _height(F.col("n"))).select("g", "hash")

    def blocks(self) -> DataFrame:
        """(g, n, block) of every leaf partition."""
        low = F.least(F.lit(self.block_levels), _height(F.col("n")))
        return self.nodes.where(F.col("level") == low).select("g", "n", F.col("idx").alias("block"))


def _height(n: Column) -> Column:
    """Bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0)).cast("int")


def build(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> Tree:
    """The tree of each group over ``leaves`` as ``place`` gives them, with a column ``hash``."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    layer, level, stored = leaves.select("g", "n", "idx", "hash"), 0, None
    while True:
        in_block = layer.groupBy("g", F.shiftright("idx", block_levels).alias("block"))
        made = stage(in_block.applyInArrow(_grown(level, level > 0, block_levels), _NODE), "nodes")
        stored = made if stored is None else stored.unionByName(made)
        level += block_levels
        if height(most) <= level:
            return Tree(leaves, stored, block_levels)
        layer = made.where(F.col("level") == level).select("g", "n", "idx", "hash")


def _requests(block_levels: int, salt_levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, n, block in zip(*[c.to_pylist() for c in batch.columns]):
                own = range(block << block_levels, min(n, (block + 1) << block_levels))
                for level, idx in octopus(own, n):
                    salt = (block & ((1 << (level - block_levels)) - 1)) >> salt_levels
                    rows.append((g, block, level, idx, salt))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
                    (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["g", "block", "level", "idx", "salt"],
            )

    return run


def fetch(tree: Tree, salt_levels: int = SALT_LEVELS) -> DataFrame:
    """(g, block, level, idx, hash): the nodes that each leaf partition misses, by one join."""
    wanted = tree.blocks().mapInArrow(
        _requests(tree.block_levels, salt_levels), "g string, block bigint, level int, idx bigint, salt bigint")
    above = F.col("level") - F.lit(tree.block_levels)
    copies = F.expr(f"shiftright(shiftleft(1L, greatest(level - {tree.block_levels}, 0)) - 1, {salt_levels})")
    served = tree.nodes.where(above >= 0).select(
        "g", "level", "idx", "hash", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("salt"))
    return wanted.join(served, ["g", "level", "idx", "salt"]).select("g", "block", "level", "idx", "hash")


def _expand(tree_levels: int, extra: Sequence[str], emit: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Proofs of one leaf partition from its leaves and what it fetched."""
    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        n, idx = own["n"][0].as_py(), own["idx"].to_pylist()
        hashes = own["hash"].to_pylist()
        fetched, head = {}, []
        for level, i, h in zip(*[got[c].to_pylist() for c in ("level", "idx", "hash")]):
            if level >= _HEAD:
                head.append((level, h, bool(i)))
            else:
                fetched[level, i] = h
        levels = [dict(zip(idx, hashes))]
        levels += grow(levels[0], n, 0, height(n), fetched)
        shared = [(h, left) for _, h, left in sorted(head)]
        subroot = levels[-1][0]
        root = fold(subroot, shared)
        proofs = [siblings(i, n, levels) + shared for i in idx]
        return emit(own.select(list(extra)), hashes, proofs, subroot, root)

    return run


def expand(tree: Tree, fetched: DataFrame, extra: Sequence[str], emit: Callable, schema: str) -> DataFrame:
    """``emit(extra columns, leaf hashes, proofs, subroot, root)`` of every leaf partition as rows of ``schema``."""
    block = F.shiftright("idx", tree.block_levels).alias("block")
    own = tree.leaves.select("g", "n", "idx", "hash", *extra).groupBy("g", block)
    return own.cogroup(fetched.groupBy("g", "block")).applyInArrow(
        _expand(tree.block_levels, extra, emit), schema)


def _paths(extra: pa.Table, hashes: list[str], proofs: list, subroot: str, root: str) -> pa.Table:
    """Each leaf's siblings as rows; ``of`` is the group that the leaf stands for."""
    rows = [(of, _HEAD + k, int(left), h) for of, proof in zip(extra["of"].to_pylist(), proofs)
            for k, (h, left) in enumerate(proof)]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["g", "level", "idx", "hash"])


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, the nodes their partitions miss up to the root, and the root."""

    tree: Tree
    fetched: DataFrame
    root: str | None


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
             more: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS,
             salt_levels: int = SALT_LEVELS) -> Manifest:
    """The manifest of ``docs``; ``more`` are columns that stay beside each leaf."""
    name = F.col(f"`{group}`").cast("string")
    rows = docs.select(
        # A group key that is never null and keeps the order of the names.
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("g"),
        F.col(f"`{doc_id}`").alias("id"), leaf_hash([F.col(f"`{c}`") for c in fields]).alias("hash"),
        *[c.alias(k) for k, c in (more or {}).items()],
    )
    tree = build(place(with_rows(rows), ["id", "hash", "_row"]).drop("_row"), block_levels)
    # The subroots are the leaves of one more tree.
    tops = tree.tops().select(F.lit("").alias("g"), F.col("g").alias("of"), "hash")
    upper = build(place(tops, ["of"]), block_levels)
    head = stage(expand(upper, fetch(upper, salt_levels), ["of"], _paths, "g string, level int, idx bigint, hash string"), "heads")
    root = upper.tops().first()
    own = fetch(tree, salt_levels)
    above = tree.blocks().select("g", "block").join(head, "g").select("g", "block", "level", "idx", "hash")
    return Manifest(tree, own.unionByName(above), root["hash"] if root else None)


def _digests(extra: pa.Table, hashes: list[str], proofs: list, subroot: str, root: str) -> pa.Table:
    leaves, spoilt = hashes, extra["spoilt"].to_pylist()
    folded = [fold(s or leaf, proof) for leaf, s, proof in zip(leaves, spoilt, proofs)]
    many = len(leaves)
    return pa.table({
        "doc_id": extra["id"], "leaf": pa.array(leaves, pa.string()), "subroot": pa.array([subroot] * many, pa.string()),
        "root": pa.array([root] * many, pa.string()),
        "proof_sha256": pa.array([join_hash(*[h for h, _ in proof]) for proof in proofs], pa.string()),
        "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


def audit(docs: DataFrame, spoilt: Column, block_levels: int = BLOCK_LEVELS, salt_levels: int = SALT_LEVELS) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot, root, the digest of its proof, and the check.

    ``spoilt`` is a leaf hash to check in place of the true one (null: the true one).
    """
    made = manifest(docs, more={"spoilt": spoilt}, block_levels=block_levels, salt_levels=salt_levels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return expand(
        made.tree, made.fetched, ["id", "spoilt"], _digests,
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def tampered(every: int = 7) -> Column:
    """The leaf with 1 added to n_chars where ``every`` divides the crc32 of the id, else null."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(every)) == 0, leaf_hash(changed))
