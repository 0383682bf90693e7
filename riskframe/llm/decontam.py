"""Benchmark decontamination by size-partitioned MinHash containment search.

Each benchmark item is reduced to its smallest shingle hashes. How many depends on its
size: of n distinct shingles, a text holding at least t*n of them lacks at most n-ceil(t*n),
so any n-ceil(t*n)+1 of the item's shingles include one that the text has. The signature
of that length therefore finds every text above the threshold, however long the text is;
a signature of one fixed length would not. Size partitions: items of the same shingle
width and signature length are one class; widths below five serve items of fewer words.

Texts probe the signatures with all their shingles. A text that meets one is a candidate
for that item and is verified by exact shingle containment in the same row.

Null and blank texts and items match nothing. Items of one to four words count as a single
shingle of their own width. Repeated items are reported under each id; repeated documents
under each id once. Ties do not arise. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.staging import stage
from riskframe.llm.text import select_rows, shingle_hashes, with_rows, words

WIDTH = 5
THRESHOLD = 0.8
#: Signatures are broadcast up to this many rows (about 16 bytes each), else joined by hash.
BROADCAST_ROWS = 1_000_000


def _lower_words(text: str) -> Column:
    return words(F.lower(F.coalesce(F.col(text), F.lit(""))))


def signatures(items: DataFrame, item_id: str = "item_id", text_col: str = "text",
               width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, width, shingles (distinct hashes, ascending) and signature (the smallest of them)."""
    w = items.select(F.col(item_id).alias("item_id"), _lower_words(text_col).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(width)))
    hashes = shingle_hashes(F.col("w"), width)
    for k in range(1, width):
        hashes = F.when(F.col("width") == k, shingle_hashes(F.col("w"), k)).otherwise(hashes)
    s = w.select("item_id", "width", F.sort_array(F.array_distinct(hashes)).alias("shingles"))
    n = F.size("shingles")
    # The margin keeps 0.8 * 5 from rounding to more than 4.
    need = F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return s.select("*", F.slice("shingles", 1, n - need + 1).alias("signature"), need.alias("need"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
          threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (doc_id, item_id) with n_shingles, n_shared and containment >= threshold."""
    signed = stage(signatures(items, item_id, item_text, width, threshold), "signatures")
    sizes = [r for r in signed.groupBy("width").agg(F.sum(F.size("shingles")).alias("n")).collect()]
    texts = docs.select(F.col(doc_id).alias("doc_id"), _lower_words(text_col).alias("w"))
    out = None
    for r in sorted(sizes, key=lambda r: r["width"]):
        of_width = signed.where(F.col("width") == r["width"])
        found = _verified(texts, of_width, r["width"], r["n"] <= broadcast_rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _verified(texts, signed, width, True)
    return out


def _verified(texts: DataFrame, signed: DataFrame, width: int, small: bool) -> DataFrame:
    # The outer form: for a plain explode the optimizer would infer a filter that evaluates
    # the split once for every shingle.
    hashed = texts.select("doc_id", F.array_distinct(shingle_hashes(F.col("w"), width)).alias("have"))
    probes = signed.select("item_id", F.explode("signature").alias("h"))
    if small:
        items = signed.select("item_id", "shingles", "need")
        met = (
            hashed.select("doc_id", "have", F.explode_outer("have").alias("h"))
            .join(F.broadcast(probes), "h")
            .join(F.broadcast(items), "item_id")
        )
    else:
        pairs = (
            hashed.select("doc_id", F.explode_outer("have").alias("h")).join(probes, "h")
            .select("doc_id", "item_id").distinct()
        )
        met = (
            pairs.join(signed.select("item_id", "shingles", "need"), "item_id")
            .withColumnRenamed("doc_id", "_of")
            .join(hashed, F.col("_of").eqNullSafe(F.col("doc_id")))
        )
    shared = met.select(
        "doc_id", "item_id", F.size("shingles").cast("bigint").alias("n_shingles"), "need",
        F.size(F.array_intersect("shingles", "have")).cast("bigint").alias("n_shared"),
    )
    return (
        shared.where(F.col("n_shared") >= F.col("need"))
        .groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", scanned: bool = False, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged.

    Each row is judged by its own text, whatever its id. Rows are told apart by their place in
    a written table (``docs`` itself if it is ``scanned``), and only the places of leaks move.
    """
    rows = with_rows(docs, scanned)
    row = rows.columns[-1]
    slim = rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    leaked = leaks(slim, items, doc_id="row", text_col="text", **options)
    return select_rows(rows, leaked.select(F.col("doc_id").alias("row")), False).drop(row)
