"""Scalar column expressions. All stay in whole-stage codegen; none is a UDF."""

from __future__ import annotations

from collections.abc import Mapping
import re

from pyspark.sql import Column, functions as F

# Text a CSV reader treats as missing (the usual data-frame default list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
TRUE_TOKENS = ("true", "1", "yes", "y")
FALSE_TOKENS = ("false", "0", "no", "n")


def normalise_name(raw: str) -> str:
    """snake_case form of one header."""
    return re.sub(r"[^a-z0-9]+", "_", raw.strip().lower()).strip("_")


def normalise_text(c: Column) -> Column:
    """The header rule applied to values."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def na_to_null(name: str) -> Column:
    """A text column with the missing-value tokens removed."""
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return F.expr(f"CASE WHEN `{name}` NOT IN ({tokens}) THEN `{name}` END")


def flag_strict(c: Column) -> Column:
    """1 for true/"true" in any case, 0 for everything else, missing included."""
    return F.coalesce((F.lower(F.trim(c.cast("string"))) == "true").cast("int"), F.lit(0))


def flag_lenient(c: Column) -> Column:
    """1/0 for the usual spellings, NULL for missing or unknown."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE_TOKENS), 1).when(s.isin(*FALSE_TOKENS), 0)


def to_number(c: Column) -> Column:
    """Double or NULL; NaN counts as missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def encode_target(c: Column, codes: Mapping[str, int]) -> Column:
    """Class of a raw label; NULL when the label is missing or unknown."""
    s = F.lower(F.trim(c.cast("string")))
    out = None
    for cls in sorted(set(codes.values())):
        tokens = sorted(k for k, v in codes.items() if v == cls)
        out = F.when(s.isin(*tokens), cls) if out is None else out.when(s.isin(*tokens), cls)
    return out


def decode_label(c: Column, labels: Mapping[int, str]) -> Column:
    out = None
    for code, text in sorted(labels.items()):
        out = F.when(c == code, text) if out is None else out.when(c == code, text)
    return out.otherwise("Unknown")


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary replacement; values without an entry pass through."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def fill(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def right_closed_bin(c: Column, edges: tuple[float, ...], labels: tuple) -> Column:
    """Label of the (edge, next edge] interval; NULL outside all of them."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (c > lo) if hi == float("inf") else (c > lo) & (c <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def age_group(age: Column) -> Column:
    return right_closed_bin(age, (0, 5, 15, 50, 100), ("0-5", "6-15", "16-50", "50+"))


def age_group_order(age: Column) -> Column:
    return right_closed_bin(age, (0, 5, 15, 50, 100), (0, 1, 2, 3))


def rain_class(mm: Column) -> Column:
    return right_closed_bin(mm, (0, 50, 150, 300, float("inf")), (0, 1, 2, 3))


def age_months(age: Column) -> Column:
    return F.floor(age * 12).cast("int")


def anemia_status(hb: Column) -> Column:
    return F.when(hb < 11, "Yes").otherwise("No")


def heat_humidity_index(temperature: Column, humidity: Column) -> Column:
    return temperature * humidity / 100


def rate_per_thousand(cases: Column, population: Column) -> Column:
    return F.try_divide(cases, population) * 1000


def stay_days(admission: Column, discharge: Column) -> Column:
    return F.datediff(discharge, admission)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def decide(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def order_hash(id_col: Column, seed: int) -> Column:
    """A 32-digit hex key that orders rows at random, the same way on every run."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
