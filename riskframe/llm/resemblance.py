"""Near-duplicates at a five-word similarity of 0.8: SimHash and BK-trees propose, shingle sets decide.

Two texts link when the Jaccard similarity of their distinct five-word shingles is
``SIMILARITY`` or more. Shingles are compared as 64-bit hashes, all of them. A fraction p of
differing bits of a ``BITS`` (512) bit SimHash estimates the angle pi * p between two sets:
sets of one size and similarity 0.8 differ in 78 bits on average, with a deviation of 8.
``RADIUS`` (110) lies four deviations above; it only proposes pairs.

So wide a radius leaves no bit block that close texts must share. The shards are therefore
bands of minimum hashes of the same shingles: texts of similarity s share a given band with
probability s ** ROWS and one of all bands with 1 - (1 - s ** ROWS) ** BANDS. The search
misses a pair at exactly 0.8 with probability 3e-5 by the bands and about 4e-5 by the radius,
and closer pairs more rarely. Within a shard the links are those of a BK-tree whose children
are keyed by their Hamming distance to the parent. A shard above ``shard_rows`` is cut into
blocks, and every pair of blocks is one task's cell of bounded size, so no pair is left out.

The members of a proposed component are compared with one leader first, in cells bounded by rows
and by shingles. Members that do not link to it are compared with all others, block by block. A cell
reads the texts of its members and keeps a spanning forest of the pairs within the radius that reach
the similarity; the components of these forests are the groups.

Texts of fewer than five words count as one shingle. Null and blank texts have the empty
set and are copies of each other. Texts with equal sets are merged before the search. Ties:
the smallest doc_id names the group. A null doc_id does not name a group unless all ids of
the group are null. Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from riskframe.functions.staging import stage
from riskframe.llm.components import components
from riskframe.llm.simhash import BKTree, _Forest
from riskframe.llm.text import select_rows, with_rows

WORDS = 5
BITS = 512
RADIUS = 110
#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS = 20
ROWS = 4
SHARD_ROWS = 2_048
#: Members of a block whose texts are compared, and the shingles they may hold together.
CONFIRM_ROWS = 256
CONFIRM_SHINGLES = 1 << 20
_BLOCK = 255 * 4
_LANES = BITS // 64
_SALTS = np.random.default_rng(11).integers(1, 1 << 63, _LANES, dtype=np.uint64)
_FACTORS = np.random.default_rng(12).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all of its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending; fewer words than a shingle give one hash."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(w) - words + 1)
    whole = b" ".join(w)
    upto = (np.cumsum([len(x) + 1 for x in w]) - 1).tolist()
    starts = [0, *[e + 1 for e in upto[:n - 1]]]
    ends = upto[words - 1:] or upto[-1:]
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash64(whole[a:b]) for a, b in zip(starts, ends)), np.uint64, n))


def sketch_of(shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The wide fingerprint and the band keys; votes are added in blocks, so memory is bounded."""
    votes = np.zeros(BITS, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        h = shingles[at:at + _BLOCK]
        bits = np.unpackbits(_mix(h[:, None] ^ _SALTS[None, :]).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(h), 255):
            # 255 votes fit into a byte.
            votes += np.add.reduce(bits[k:k + 255], axis=0, dtype=np.uint8)
        np.minimum(least, (h[:, None] * _FACTORS[None, :]).min(axis=0), out=least)
    wide = np.packbits((2 * votes > len(shingles)).astype(np.uint8), bitorder="little").tobytes()
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return wide, np.array(keys, dtype=np.uint64).astype(np.int64)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """From (doc_id, text, row): doc_id, row, key and size of the shingle set, sketch (binary) and
    bands (array of keys), one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py(), words) for t in batch.column(1)]
            made = [sketch_of(s) for s in sets]
            keys = np.concatenate([k for _, k in made]) if made else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s for s, _ in made], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * BANDS, pa.array(keys))],
                names=["doc_id", "row", "key", "size", "sketch", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "row").mapInArrow(
        run, f"doc_id {kind}, row struct<f: string, i: bigint>, key binary, size bigint, sketch binary, bands array<bigint>"
    )


def cell_links(values: list[bytes], left: np.ndarray, right: np.ndarray, radius: int,
               names: list[bytes] | None = None,
               alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[bytes, bytes]]:
    """Spanning links of a cell: a BK-tree of its ``left`` values, queried with its ``right`` ones.

    With ``alike`` a pair within the radius must also pass it. Links hold ``names``, else values.
    """
    names = names or values
    tree, nodes = BKTree([]), np.flatnonzero(left).tolist()
    for i in nodes:
        tree.add(int.from_bytes(values[i], "little"))
    wide = np.frombuffer(b"".join(values), "<u8").reshape(len(values), _LANES)
    forest, links = _Forest(len(values)), []
    todo = [(0, np.flatnonzero(right))] if nodes else []
    while todo:
        node, who = todo.pop()
        own = nodes[node]
        d = np.bitwise_count(wide[who] ^ wide[own]).sum(axis=1, dtype=np.int64)
        near = who[d <= radius]
        if alike:
            near = near[[forest.root(i) != forest.root(own) for i in near.tolist()]] if len(near) else near
            near = near[alike(own, near)] if len(near) else near
        elif len(near) > 16:
            # Most of a dense neighbourhood is joined already; drop those by their parent.
            near = near[np.unique(np.array(forest.up)[near], return_index=True)[1]]
        for i in near.tolist():
            if forest.join(i, own):
                links.append((names[i], names[own]))
        for k, child in tree.edges[node].items():
            on = who[np.abs(d - k) <= radius]
            if len(on):
                todo.append((child, on))
    return links


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Cells arrive sorted, so one is complete when the next begins."""
    cell, values, own = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(values) > 1:
            i, j = cell[2], cell[3]
            o = np.array(own)
            links = cell_links(values, o == i, o == j, radius)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"]
                )

    for batch in batches:
        for *key, value, block in zip(*[c.to_pylist() for c in batch.columns]):
            if key != cell:
                yield from close()
                cell, values, own = key, [], []
            values.append(value)
            own.append(block)
    yield from close()


def similar(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A test of one set against several: which have a Jaccard similarity of ``SIMILARITY`` or more."""
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.int64)
    over, under = SIMILARITY

    def alike(own: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), dtype=bool)
        n = size[others]
        # Sizes further apart than the similarity cannot reach it; empty sets equal no other.
        fit = np.flatnonzero((np.minimum(n, size[own]) * under >= np.maximum(n, size[own]) * over) & (n > 0))
        if len(fit):
            mark[ids[own]] = 1
            n = n[fit]
            common = np.add.reduceat(mark[np.concatenate([ids[k] for k in others[fit].tolist()])], np.cumsum(n) - n)
            mark[ids[own]] = 0
            out[fit] = common * under >= (n + size[own] - common) * over
        return out

    return alike


def _confirm(batches: Iterator[pa.RecordBatch], radius: int, words: int) -> Iterator[pa.RecordBatch]:
    """Links between the two sides of cells (root, low, high, side, key, sketch, text), which arrive sorted."""
    cell, sides, keys, values, sets = None, [], [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            o = np.array(sides)
            links = cell_links(values, o == 1, o == 2, radius, keys, similar(sets))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"]
                )

    for batch in batches:
        for row in range(batch.num_rows):
            *at, side, key, value, text = [c[row].as_py() for c in batch.columns]
            if at != cell:
                yield from close()
                cell, sides, keys, values, sets = at, [], [], [], []
            sides.append(side)
            keys.append(key)
            values.append(value)
            sets.append(shingles_of(text, words))
    yield from close()


def _blocks(rows: Column, shingles: Column, most: int) -> Column:
    """No more blocks than members: a block of one long text is as small as it gets."""
    wanted = F.ceil(F.greatest(rows / F.lit(most), shingles / F.lit(CONFIRM_SHINGLES), F.lit(1.0)))
    return F.least(wanted, rows).cast("int")


def _compared(cells: DataFrame, words: int, radius: int) -> DataFrame:
    key = ["near", "low", "high"]
    return stage(
        cells.select(*key, "side", "key", "sketch", "text").repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(lambda batches: _confirm(batches, radius, words), "a binary, b binary"), "confirmed",
    )


def confirmed(nodes: DataFrame, texts: DataFrame, words: int = WORDS, radius: int = RADIUS,
              shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between the keys of ``nodes`` whose texts have similar shingle sets.

    Every member of a proposed component is first compared with one leader. Only members that do
    not link to it are compared with all others, block by block.
    """
    near = components(links(nodes, radius, shard_rows)).select(F.col("node").alias("sketch"), F.col("root").alias("near"))
    rows = nodes.select("key", "sketch", "size", F.col("first.row").alias("row"))
    rows = stage(rows.join(near, "sketch", "left").withColumn("near", F.coalesce("near", "sketch")), "near")
    most = min(shard_rows, CONFIRM_ROWS)
    sizes = rows.groupBy("near").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("key").alias("leader")).where("n > 1")
    sizes = sizes.select("near", "n", "leader", _blocks(F.col("n"), F.col("shingles"), most).alias("blocks"))
    members = stage(rows.join(stage(sizes, "near_sizes"), "near"), "members")
    # Only the members' texts move.
    held = select_rows(texts, members.select("row"), True)
    held = held.select("text", F.col(held.columns[-1]).alias("row"))
    found = stage(held.select("text", F.col("row.f").alias("f"), F.col("row.i").alias("i")).join(
        members.select("*", F.col("row.f").alias("f"), F.col("row.i").alias("i")).drop("row"), ["f", "i"]), "member_texts")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    leads = F.col("key") == F.col("leader")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    with_leader = found.select(
        "*", F.when(leads, 1).otherwise(2).alias("side"), F.explode(F.when(leads, everywhere).otherwise(F.array(block))).alias("low"),
    ).withColumn("high", F.lit(-1))
    linked = _compared(with_leader, words, radius)
    joined = linked.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # In a component of two the leader has met the only other member.
    rest = found.where(~leads & (F.col("n") > 2)).join(joined, "key", "left_anti")
    rest = stage(rest.select("near", "key", "size", "blocks"), "rest")
    if rest.isEmpty():
        return linked
    few = rest.groupBy("near").agg(F.count("*").alias("r"), F.sum("size").alias("s"))
    few = stage(few.select("near", _blocks(F.col("r"), F.col("s"), most).alias("parts")), "rest_sizes")
    again = rest.select("key", F.lit(True).alias("is_rest"))
    cells = found.join(few, "near").join(again, "key", "left")
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    here = lambda side, low, high: F.struct(F.lit(side).alias("side"), low.alias("low"), high.alias("high"))
    as_any = F.transform(parts, lambda p: here(2, p, block))
    as_rest = F.transform(everywhere, lambda b: here(1, part, b))
    cells = cells.select("near", "key", "sketch", "text", F.inline(
        F.when(F.col("is_rest"), F.concat(as_rest, as_any)).otherwise(as_any)))
    return linked.unionByName(_compared(cells, words, radius))


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) within the radius between the sketches of ``nodes`` (sketch, bands).

    Band keys are counted and matched with short names of the sketches; only those that share a
    band fetch the sketch itself. Two sketches of one name, or two bands of one key, only propose more.
    """
    light = nodes.select(F.explode("bands").alias("value"), F.xxhash64("sketch").alias("sid"))
    sizes = light.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    shards = stage(sizes.select("value", blocks.alias("blocks")), "shards")
    wide = nodes.select("sketch").distinct().withColumn("sid", F.xxhash64("sketch"))
    own = F.pmod(F.xxhash64("sketch"), F.col("blocks")).cast("int")
    cells = (
        light.join(shards, "value").join(wide, "sid").withColumn("own", own)
        .select("value", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.lit(0).alias("band"), "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sketch", "own")
    )
    key = ["value", "i", "j"]
    return (
        cells.repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(lambda batches: _search(batches, radius), "a binary, b binary")
    )


def _grouped(rows: DataFrame, words: int, radius: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text, row): the sketches, and (key, first) with the first row of each key's group."""
    made = stage(sketches(rows, words), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = made.groupBy("key").agg(
        F.min("sketch").alias("sketch"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min(first).alias("first")
    )
    nodes = stage(nodes, "nodes")
    roots = components(confirmed(nodes, rows, words, radius, shard_rows)).select(F.col("node").alias("key"), "root")
    named = nodes.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = stage(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return made, named.select("key", "root").join(least, "root").select("key", "first")


def groups(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", words: int = WORDS,
           radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id and component_id, one row per input row."""
    rows = with_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")))
    made, named = _grouped(rows.withColumnRenamed("_row", "row"), words, radius, shard_rows)
    return made.select("doc_id", "key").join(named, "key").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", words: int = WORDS,
               radius: int = RADIUS, shard_rows: int = SHARD_ROWS, scanned: bool = False) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (columns unchanged).

    Rows are told apart by their place in a written table (``docs`` itself if it is ``scanned``), so
    null and repeated ids lose no group: of several rows with the smallest id, or of a group
    without ids, one stays.
    """
    rows = with_rows(docs, scanned)
    row = rows.columns[-1]
    slim = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(row).alias("row"))
    made, named = _grouped(slim, words, radius, shard_rows)
    dropped = made.select("key", "row").join(named, "key").where("row <> first.row").select("row")
    return select_rows(rows, dropped, False).drop(row)
