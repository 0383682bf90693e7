"""Connected components by contraction, for link tables of any size.

Each round every node points at its neighbour (or itself) with the smallest hash, pointers
are followed one step further, and the links are redrawn between the nodes pointed at. The
link table shrinks by a constant factor a round, whatever the shape of the graph, because
hashes change with the round. Hot nodes only meet aggregates with map-side combine and
joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.staging import stage

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is some node of its component.

    Self links and repeated links do no harm; links with a null end are left out.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stage(ends.distinct(), "links")
    levels = []
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731,B023
        first = both.groupBy("u").agg(F.least(F.min(ranked("v")), F.min(ranked("u")))["n"].alias("p"))
        first = stage(first, "pointers")
        onward = first.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        level = stage(first.join(onward, "p").select("u", F.col("pp").alias("p")), "level")
        levels.append(level)
        edges = stage(
            edges.join(level, "u").select(F.col("p").alias("x"), "v")
            .join(level.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
            .where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(),
            "links",
        )
    else:
        raise RuntimeError("components did not settle")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = levels[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for level in reversed(levels[:-1]):
        up = roots.select(F.col("node").alias("p"), F.col("root").alias("r"))
        roots = level.join(up, "p", "left").select(
            F.col("u").alias("node"), F.coalesce("r", "p").alias("root")
        )
    return roots
