"""SimHash near-duplicates, found with BK-trees.

Fingerprint: each shingle's XXH64 votes on 64 bits; a bit is set when more than half of the
votes set it. Two fingerprints link when at most ``radius`` bits differ.

Search: equal fingerprints are merged first, so copies never meet. A pair within the radius
agrees in at least one of radius + 1 bit blocks; each (block, value) is a shard. A task
builds a BK-tree per shard: children are keyed by their Hamming distance to the parent, and
a query at distance d from a node follows only the edges d - radius to d + radius. The
number of trees grows with the data, so queries and trees are brought together by a shuffle
on the shard rather than by broadcasting the trees. A shard above ``shard_rows`` is cut into
sub-trees of bounded size, and its queries visit each of them; that spreads a hot shard over
many tasks and leaves no pair out. Each tree returns a spanning forest of its links, not all
pairs, and the components of all forests are the groups.

Null texts count as empty. Texts without words have fingerprint zero and link like others.
Ties: the smallest doc_id names the group. Repeated rows each get a row. A null doc_id gets
a row but does not name a group unless all ids of the group are null. Only the id and text
columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
import xxhash

from riskframe.functions.staging import stage
from riskframe.llm.components import components
from riskframe.llm.text import select_rows, with_rows

WORDS = 3
SEED = 42
RADIUS = 3
SHARD_ROWS = 8_192
_BLOCK = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint; votes are added in blocks, so memory is bounded."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    votes = np.zeros(64, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        upto = min(n, at + _BLOCK)
        h = np.array(
            [hash64(whole[starts[i]:ends[min(i + words, len(w)) - 1]], SEED) for i in range(at, upto)], dtype="<u8"
        )
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Fingerprint column, as a signed long with the same bits."""
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).astype(np.int64))

    return of(text)


class BKTree:
    """Distinct values; ``edges[i]`` maps a distance to the child of node i at that distance."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        new = len(self.values)
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.edges[at]:
                self.edges[at][d] = new
                break
            at = self.edges[at][d]
        self.values.append(value)
        self.edges.append({})

    def within(self, query: int, radius: int) -> list[int]:
        """Node numbers within ``radius`` of one query."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ query).bit_count()
            if d <= radius:
                out.append(at)
            edges = self.edges[at]
            todo += [c for k, c in edges.items() if d - radius <= k <= d + radius]
        return out

    def batches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within radius): all queries go down together."""
        todo = [(0, np.arange(len(queries)))] if self.values and len(queries) else []
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(queries[who] ^ np.uint64(self.values[at])).astype(np.int64)
            yield at, who[d <= radius]
            for k, child in self.edges[at].items():
                near = who[np.abs(d - k) <= radius]
                if len(near):
                    todo.append((child, near))


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _forest_links(queries: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links between queries and members of one tree (members are queries too)."""
    tree = BKTree(members.tolist())
    values = np.unique(np.concatenate([queries, members]))
    at_member = np.searchsorted(values, members)
    forest, links = _Forest(len(values)), []

    def meet(i: int, j: int) -> None:
        if forest.join(i, j):
            links.append((int(values[i]), int(values[j])))

    if len(values) <= 64:
        for i, q in enumerate(values.tolist()):
            for node in tree.within(q, radius):
                meet(i, int(at_member[node]))
        return links
    for node, who in tree.batches(values, radius):
        own = int(at_member[node])
        if len(who) > 64:
            # Most of a dense neighbourhood is joined already; drop those by their parent.
            parents = np.array(forest.up)[who]
            who = who[np.unique(parents, return_index=True)[1]]
        for i in who.tolist():
            meet(i, own)
    return links


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Shards arrive sorted, so one is complete when the next begins."""
    names = ["a", "b"]

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=names)

    def tree(rows: list[np.ndarray]) -> list[tuple[int, int]]:
        fp, member = rows[3].astype(np.uint64), rows[4].astype(bool)
        return _forest_links(fp, fp[member], radius) if len(fp) > 1 else []

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        change = np.zeros(len(cols[0]) - 1, dtype=bool)
        for k in range(3):
            change |= cols[k][1:] != cols[k][:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1]).tolist()
        links: list[tuple[int, int]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                links += tree([c[lo:hi] for c in cols])
        held = [c[cuts[-1]:] for c in cols]
        if links:
            yield emit(links)
    if held is not None and (links := tree(held)):
        yield emit(links)


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints of the column ``fp``."""
    distinct = stage(prints.select("fp").distinct(), "prints")
    blocks = radius + 1
    width = -(-64 // blocks)
    shard = F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(fp, {k * width})").bitwiseAND(
            F.lit((1 << min(width, 63)) - 1)).alias("value"))
        for k in range(blocks)
    ]))
    rows = distinct.select("fp", shard.alias("s")).select("s.block", "s.value", "fp")
    sizes = stage(rows.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    cut = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    placed = (
        rows.join(sizes.withColumn("trees", cut), ["block", "value"])
        .withColumn("own", own)
        # A pair of fingerprints meets in the sub-tree of the one with the smaller number.
        .select("block", "value", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree"), "fp", "own")
        .select("block", "value", "tree", "fp", (F.col("tree") == F.col("own")).alias("member"))
    )
    key = ["block", "value", "tree"]
    return (
        placed.repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(lambda batches: _search(batches, radius), "a long, b long")
    )


def _named(prints: DataFrame, first: Column, radius: int, shard_rows: int) -> DataFrame:
    """(fp, first) with the smallest ``first`` of each fingerprint's group."""
    roots = components(links(prints, radius, shard_rows)).select(F.col("node").alias("fp"), "root")
    own = prints.groupBy("fp").agg(F.min(first).alias("first"))
    own = stage(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    return own.join(least, "root").select("fp", F.col("least").alias("first"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", words: int = WORDS,
           radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, one row per input row."""
    prints = stage(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints"
    )
    named = _named(prints, F.col("doc_id"), radius, shard_rows)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", words: int = WORDS,
               radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (columns unchanged).

    Rows are told apart by their place in a written copy, so null and repeated ids lose no
    group: of several rows with the smallest id, or of a group without ids, one stays.
    """
    rows = with_rows(docs)
    prints = stage(rows.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(rows.columns[-1]).alias("row"),
        fingerprint(F.col(f"`{text_col}`"), words).alias("fp"),
    ), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = _named(prints, first, radius, shard_rows).select("first.row").distinct()
    return select_rows(rows, kept, True).drop(rows.columns[-1])
