"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POSITIONS`` places. Each shard owns ``vnodes`` of them, found by hashing; a
key belongs to the next virtual node clockwise of its own place. Loads are bounded by exact
capacities: with n rows and s shards, n mod s shards hold one row more than the others, so
counts are at most one apart. Keys that find their shard full go on clockwise to the next
virtual node whose shard has room: all rows try their home first, and in each place the
rows ranked last are the ones that move on.

Only counts by place (at most ``POSITIONS`` of them) reach the driver, which works out for
each place how many of its rows go to which shard and at which slot they begin. Rows then
find their shard by their rank within the place. The rank is the sum of the counts of the
place's earlier cells and a row number inside the cell; cells come from the row's position
in a written table, so equal keys, however many, spread over all cells of their place.

Null ids and texts are allowed: a null id is a key of its own, a null text has size 16 and
the checksum of an empty one. Repeated rows are rows like others. Ties within a place are
ordered by id, checksum, size and the position in the written table. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window, functions as F
import xxhash

from riskframe.functions.staging import stage

POSITIONS = 1 << 16
VNODES = 256
CELLS = 32


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in order, and the shard at each."""
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = xxhash.xxh64_intdigest(f"shard {s} node {v}") % POSITIONS
            while at in owner:  # taken: the next free place clockwise
                at = (at + 1) % POSITIONS
            owner[at] = s
    places = sorted(owner)
    return places, [owner[p] for p in places]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) covering every counted row.

    Round k lets the rows still without a shard try the k-th virtual node from home. Since
    capacities add up to the number of rows, one trip round the ring places everything.
    """
    if vnodes * shards > POSITIONS // 2:
        raise ValueError("too many virtual nodes for the ring")
    places, owners = ring(shards, vnodes)
    free = capacities(sum(counts.values()), shards)
    used = [0] * shards
    out = []
    waiting = []
    for place in sorted(counts):
        waiting.append((place, 0, counts[place], bisect.bisect_left(places, place) % len(places)))
    for turn in range(len(places)):
        later = []
        for place, first, end, home in waiting:
            s = owners[(home + turn) % len(places)]
            take = min(free[s], end - first)
            if take:
                out.append((place, first, first + take, s, used[s]))
                free[s] -= take
                used[s] += take
            if first + take < end:
                later.append((place, first + take, end, home))
        waiting = later
        if not waiting:
            break
    return out


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def place_rows(docs: DataFrame, shards: int, doc_id: str = "doc_id", text_col: str = "text",
               vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 48).cast("int")
    rows = stage(
        docs.select(F.col(doc_id).alias("doc_id"), text_size(F.col(text_col)).alias("size"),
                    text_crc(F.col(text_col)).alias("text_crc32")).withColumn("place", place),
        "rows",
    )
    at = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    rows = rows.select("*", at.alias("at")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "at.f", "at.i"), F.lit(CELLS)).cast("int")
    )
    cells = stage(rows.groupBy("place", "cell").agg(F.count("*").alias("n")), "cells")
    counts = {r["place"]: r["n"] for r in cells.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    parts = assign(counts, shards, vnodes) if counts else []
    # One row for each place and shard it reaches: bounded by the ring, not by the data.
    table = spark.createDataFrame(parts, "place int, first long, end long, shard int, base long").groupBy(
        "place"
    ).agg(F.collect_list(F.struct("first", "end", "shard", "base")).alias("parts"))
    earlier = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("place", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "cell").orderBy("doc_id", "text_crc32", "size", "at.f", "at.i")
    ranked = rows.join(starts, ["place", "cell"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    )
    mine = F.filter("parts", lambda p: (F.col("rank") >= p.first) & (F.col("rank") < p.end))[0]
    return (
        ranked.join(F.broadcast(table), "place")
        .withColumn("_p", mine)
        .select("doc_id", "size", "text_crc32", F.col("_p.shard").alias("shard"),
                (F.col("_p.base") + F.col("rank") - F.col("_p.first")).alias("slot"))
    )
