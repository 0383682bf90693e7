"""Quality rules, line first: judge each line, drop failing lines, then judge what is left.

A line with a word fails when one of these rules holds:

* punctuation: it does not end with closing punctuation, or exclamation and question
  marks are more than half as many as its words;
* navigation: markup and menu symbols are more than a tenth as many as its words;
* boilerplate: it holds a phrase of licences, consent notices or site chrome, as whole words.

A document is rejected when the base rule fails or when the lines that passed hold less
than ``min_kept`` of the code points of all lines with a word.

Null, empty and blank texts have no words, fail the base rule and are rejected. Repeated
rows are judged alike, ties do not arise, and an empty table gives no rows. Only the id and text columns are read, so other columns may have
any name. Everything is built-in expressions on one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.text import SPACE, words

SYMBOLS = "[#*$%&|<>]"
CLOSING = "[.!?:;\\x{2026}\"')\\]\\x{201D}\\x{2019}\\x{00BB}][\\x20\\x09-\\x0D]*$"
#: Phrases of site chrome, whole words only: a single word such as "cookie" says nothing.
BOILERPLATE = (
    "(^|[^a-z])("
    "all rights reserved|copyright (\\(c\\) ?|\\x{00A9} ?)?[12][0-9][0-9][0-9]|licensed under (a|the)|"
    "terms of (use|service)|privacy policy|(we|site|website|page) uses? cookies|"
    "(accept|allow|reject|manage) (all )?cookies|cookie (policy|settings|notice|consent|preferences)|"
    "enable javascript|javascript (is )?(disabled|required|turned off)|sign (in|up) (to|for|now|here)|"
    "log in (to|now|here|or)|subscribe (to our|now|today|here)|click here"
    ")([^a-z]|$)"
)
MIN_WORDS = 50
MIN_KEPT = 0.7


def line_passes(line: Column) -> Column:
    """True when no line rule fails; lines without a word pass (they carry nothing)."""
    n_words = F.size(words(line))
    marks = F.length(line) - F.length(F.regexp_replace(line, "[!?]", ""))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    fails = (
        ~line.rlike(CLOSING)
        | (2 * marks > n_words)
        | (10 * symbols > n_words)
        | F.lower(line).rlike(BOILERPLATE)
    )
    return (n_words == 0) | ~fails


def _repeat_words(df: DataFrame, out: str) -> DataFrame:
    """Add ``out``: words lying in a 3-word window that occurs twice or more in ``_w``.

    Window hashes are sorted together with their positions (packed in the low bits), and
    neighbours with equal high bits are confirmed by comparing the words themselves.
    """
    at = lambda a, i: F.get(F.col(a), i)
    m = F.size("_w") - 2
    hashes = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.xxhash64(at("_w", i), at("_w", i + 1), at("_w", i + 2)))
    df = df.withColumn("_h", F.when(m >= 2, hashes).otherwise(F.array().cast("array<bigint>")))
    bits = F.length(F.bin(F.size("_h").cast("bigint")))
    df = df.withColumn("_bits", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), bits).otherwise(0))
    # Shift amounts must be columns, which only the SQL form takes.
    packed = F.expr("sort_array(transform(_h, (h, i) -> shiftleft(shiftright(h, _bits), _bits) + i))")
    df = df.withColumn("_p", F.when(F.col("_bits") > 0, packed))
    same = (
        "shiftright(_p[{a}], _bits) = shiftright(_p[{b}], _bits) and "
        + " and ".join(f"_w[pos({{a}}) + {k}] = _w[pos({{b}}) + {k}]" for k in range(3))
    )
    for x in "ab":
        same = same.replace(f"pos({{{x}}})", f"cast(_p[{{{x}}}] & (shiftleft(1L, _bits) - 1) as int)")
    twins = (
        "filter(transform(sequence(1, size(_p) - 1), k -> case when "
        + same.format(a="k", b="k - 1")
        + " then k end), k -> k is not null)"
    )
    df = df.withColumn("_k", F.when(F.col("_bits") > 0, F.expr(twins)))
    spots = F.expr(
        "sort_array(transform(array_union(_k, transform(_k, k -> k - 1)),"
        " k -> _p[k] & (shiftleft(1L, _bits) - 1)))"
    )
    df = df.withColumn("_s", spots)
    covered = F.expr(
        "case when size(_s) > 0 then 3 + aggregate(sequence(0, size(_s) - 1), 0L,"
        " (t, k) -> t + case when k = 0 then 0 else least(3L, _s[k] - _s[k - 1]) end) else 0L end"
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base measures, line verdict and the cleaned text."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("_l", F.split("_t", "\n", -1))
    df = df.withColumn("_lw", F.filter("_l", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))
    df = df.withColumn("_ok", F.filter("_l", line_passes))
    df = _repeat_words(df, "n_repeat_words")
    n_words = F.size("_w").cast("bigint")
    total = lambda a: F.length(F.array_join(a, ""))
    df = df.select(
        "id", "_t",
        n_words.alias("n_words"),
        total(F.col("_w")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lw") - F.size(F.array_distinct("_lw"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        total(F.col("_lw")).cast("bigint").alias("line_chars"),
        F.array_join("_ok", "\n").alias("clean_text"),
        total(F.filter("_ok", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)).cast("bigint").alias("kept_chars"),
        (F.size("_l") - F.size("_ok")).cast("bigint").alias("n_failed_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("kept_chars") >= MIN_KEPT * F.col("line_chars"))
    )
    # A filter on generated columns is not pushed below them, where it would repeat the
    # measures for every word.
    whole = F.struct(*[F.col(c) for c in df.columns if c != "_t"])
    return df.select(F.explode_outer(F.array(whole)).alias("r")).select("r.*")


def clean_documents(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """Rows of documents that pass, with the failing lines taken out of their text.

    Columns are those of ``docs``; ``count_col``, where present, is the new length.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = measure(packed.select(F.col("row").alias("row"), F.col(f"row.`{text_col}`").alias("text")), "row", "text")
    out = []
    for f in docs.schema:
        c = F.col(f"id.`{f.name}`")
        if f.name == text_col:
            c = F.col("clean_text")
        elif f.name == count_col:
            c = F.length("clean_text").cast(f.dataType)
        out.append(c.alias(f.name))
    return judged.where("kept").select(*out)
