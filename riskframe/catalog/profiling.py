"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.oracle import NUMERIC, TYPED
from riskframe.catalog.registry import query, r6
from riskframe.operators import profile
from riskframe.sources import readers
from riskframe.spec import CLINICAL

_ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_STATS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def _describe_sql(cols, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {table}" for c in cols)


@query("d1_describe", f"WITH {TYPED} " + _describe_sql(NUMERIC, "typed"))
def d1(spark, sf):
    out = profile.describe(inputs.typed(spark, sf), CLINICAL.numeric)
    return out.withColumns({c: r6(c) for c in _STATS})


@query("d1_describe_lineitem", _describe_sql(_ITEM, "lineitem"))
def d1_lineitem(spark, sf):
    out = profile.describe(readers.read_table(spark, sf, "lineitem"), _ITEM)
    return out.withColumns({c: r6(c) for c in _STATS})


@query("d2_value_counts", f"WITH {TYPED} SELECT residence, count(*) AS n FROM typed GROUP BY 1")
def d2(spark, sf):
    return profile.value_counts(inputs.typed(spark, sf), "residence")


@query("d3_value_share", f"""WITH {TYPED}
SELECT sex, count(*) AS n, round(count(*) / (SELECT count(*) FROM typed), 4) AS share FROM typed GROUP BY 1""")
def d3(spark, sf):
    return profile.value_shares(inputs.typed(spark, sf), "sex")


def _corr_sql(a: str, b: str) -> str:
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * "
            f"stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0)")


_CORR = (*CLINICAL.numeric, CLINICAL.target)


def _cell(i: int, j: int) -> str:
    r = "1.0::DOUBLE" if i == j else f"round({_corr_sql(_CORR[i], _CORR[j])}, 6)"
    return (f"SELECT '{_CORR[i]}' AS a, '{_CORR[j]}' AS b, {r} AS r, {int(j > i)} AS is_upper "
            f"FROM {'(SELECT 1)' if i == j else 'typed'}")


@query("d4_correlation", f"WITH {TYPED} " + " UNION ALL ".join(
    _cell(i, j) for i in range(len(_CORR)) for j in range(len(_CORR))))
def d4(spark, sf):
    out = profile.correlation_matrix(inputs.typed(spark, sf), _CORR)
    return out.withColumn("r", r6("r"))


@query("d5_target_correlation", f"""WITH {TYPED}
SELECT round({_corr_sql('hemoglobin_g_dl', 'case_status')}, 6) AS r FROM typed""")
def d5(spark, sf):
    return profile.target_correlation(
        inputs.typed(spark, sf), "hemoglobin_g_dl", CLINICAL.target).select(r6("r"))


@query("d6_prevalence", f"WITH {TYPED} " + " UNION ALL ".join(
    f"SELECT case_status, '{c}' AS flag, round(100.0 * sum({c}) / count({c}), 6) AS percent "
    f"FROM typed GROUP BY 1" for c in CLINICAL.flags))
def d6(spark, sf):
    return profile.prevalence(inputs.typed(spark, sf), CLINICAL.flags, CLINICAL.target).withColumn(
        "percent", r6("percent"))


def _hist_sql(cols, table: str, bins: int = 20) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor(({c} - lo) / ((hi - lo) / {bins})) + 1, {bins}) END "
        f"AS INTEGER) AS bin, count(*) AS n FROM {table}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in cols)


@query("d7_histogram", f"WITH {TYPED} " + _hist_sql(CLINICAL.continuous, "typed"))
def d7(spark, sf):
    return profile.histogram(inputs.typed(spark, sf), CLINICAL.continuous)


@query("d7_histogram_lineitem", _hist_sql(_ITEM, "lineitem"))
def d7_lineitem(spark, sf):
    return profile.histogram(readers.read_table(spark, sf, "lineitem"), _ITEM)


def _box_sql(cols, table: str, target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {target}, '{c}' AS feature, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, "
        f"round(any_value(q3), 6) AS q3, "
        f"CAST(min({c}) FILTER (WHERE {c} >= q1 - 1.5*(q3 - q1) AND {c} <= q3 + 1.5*(q3 - q1)) AS DOUBLE) AS whisker_low, "
        f"CAST(max({c}) FILTER (WHERE {c} >= q1 - 1.5*(q3 - q1) AND {c} <= q3 + 1.5*(q3 - q1)) AS DOUBLE) AS whisker_high, "
        f"count(*) FILTER (WHERE {c} < q1 - 1.5*(q3 - q1) OR {c} > q3 + 1.5*(q3 - q1)) AS n_outliers "
        f"FROM {table} JOIN (SELECT {target}, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {table} GROUP BY 1) USING ({target}) WHERE {c} IS NOT NULL GROUP BY 1"
        for c in cols)


def _round_box(df):
    return df.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("d8_box_summary", f"WITH {TYPED} " + _box_sql(CLINICAL.continuous, "typed", "case_status"))
def d8(spark, sf):
    return _round_box(profile.box_summary(inputs.typed(spark, sf), CLINICAL.continuous, CLINICAL.target))


_DOCS = r"""docs AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS n_words,
  length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) AS digit_share, lang, source, quality
  FROM documents JOIN labels USING (doc_id))"""


@query("d9_text_profile", f"WITH {_DOCS} " + _box_sql(("n_chars", "n_words", "digit_share"), "docs", "quality"))
def d9(spark, sf):
    docs = inputs.documents(spark, sf)
    return _round_box(profile.box_summary(docs, ("n_chars", "n_words", "digit_share"), "quality"))


@query("d9_text_histogram", f"WITH {_DOCS} " + _hist_sql(("n_chars", "n_words"), "docs"))
def d9_histogram(spark, sf):
    return profile.histogram(inputs.documents(spark, sf), ("n_chars", "n_words"))


@query("d9_text_prevalence", r"""SELECT quality, 'is_' || l AS flag,
  round(100.0 * count(*) FILTER (WHERE lang = l) / count(*), 6) AS percent
FROM documents JOIN labels USING (doc_id), (SELECT unnest(['en', 'de', 'fr', 'es']) AS l) GROUP BY quality, l""")
def d9_prevalence(spark, sf):
    langs = ("en", "de", "fr", "es")
    docs = inputs.documents(spark, sf).select(
        "quality", *[(F.col("lang") == v).cast("int").alias(f"is_{v}") for v in langs])
    return profile.prevalence(docs, [f"is_{v}" for v in langs], "quality").withColumn("percent", r6("percent"))
