"""Helpers shared by the text operators: words, shingles, column names, batch limits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions.staging import stage
from riskframe.session import configure

#: The white space that separates words (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Arrow batches are cut by rows and bytes, so very long texts do not pile up in a worker.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def session(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def words(text: Column) -> Column:
    """Words of a text in order; null or blank text gives an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(word: Column, size: int) -> Column:
    """A 64-bit hash for each run of ``size`` words; no entries for fewer words."""
    last = F.size(word) - F.lit(size)
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def with_rows(docs: DataFrame, scanned: bool = False) -> DataFrame:
    """``docs`` with the key of each row (file and index) in a new column, its last.

    ``scanned`` says that ``docs`` is a scan of a written table, whose own rows then give the keys;
    anything else is written once.
    """
    name = free_name(docs, "_row")
    for source in ([docs] if scanned else []) + [None]:
        try:
            source = stage(docs, "rows") if source is None else source
            at = source.metadataColumn("_metadata")
            return source.select("*", F.struct(at["file_path"].alias("f"), at["row_index"].alias("i")).alias(name))
        except AnalysisException:
            if not scanned:
                raise
            scanned = False
    raise AssertionError("a written table has rows")


#: Bitmaps of rows are broadcast up to this size, else joined by their key. One of 4 KiB covers up to 32,768 rows of a file.
BITMAP_BYTES = 128 << 20
_BITMAP = 4_096 + 200


def select_rows(rows: DataFrame, keys: DataFrame, keep: bool) -> DataFrame:
    """The ``rows`` of ``with_rows`` whose key is in ``keys`` (row), or with ``keep`` false is not.

    The keys become a bitmap for each stretch of a file, one bit a row, so that the rows themselves
    need no shuffle while all bitmaps together are below BITMAP_BYTES.
    """
    row = rows.columns[-1]
    f, bucket, bits = (free_name(rows, n) for n in ("_file", "_bucket", "_bits"))
    at = F.col("row.i") + 1
    maps = stage(
        keys.groupBy(F.col("row.f").alias(f), F.bitmap_bucket_number(at).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits)), "row_bitmaps",
    )
    small = maps.count() * _BITMAP <= BITMAP_BYTES
    here = F.col(row)["i"] + 1
    joined = rows.join(
        F.broadcast(maps) if small else maps,
        (F.col(row)["f"] == F.col(f)) & (F.bitmap_bucket_number(here) == F.col(bucket)), "inner" if keep else "left",
    )
    place = F.bitmap_bit_position(here)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return joined.where(is_set if keep else ~is_set).select(*[F.col(f"`{c}`") for c in rows.columns])
