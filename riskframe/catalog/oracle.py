"""Shared DuckDB fixtures: the cohort, its cleaned form and its split.

These are inputs of the queries, proven equal in both engines by the queries
that return them. The operator under test is always written out per query.
"""

COHORT = """
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, month(o_orderdate) AS m, c_mktsegment AS seg,
         CASE WHEN (7*o_orderkey + 3*o_custkey) % 100 < 45 THEN 1 ELSE 0 END AS pos
  FROM orders JOIN customer ON o_custkey = c_custkey
),
shifted AS (
  SELECT *, 0 AS shift FROM base
  UNION ALL SELECT *, 1000000000 AS shift FROM base WHERE k % 250 = 0
),
cohort AS (
  SELECT k + shift AS patient_id,
    CASE WHEN k % 97 <> 0 THEN ((13*c + k) % 800) / 10.0::DOUBLE END AS age_years,
    CASE WHEN k % 10 = 3 THEN NULL WHEN k % 211 = 0 THEN 'n/a'
         ELSE CAST((80 + (31*k + c) % 70 - 15*pos) / 10.0::DOUBLE AS VARCHAR) END AS hemoglobin_g_dl,
    CAST((c + k) % 3 + pos * ((11*k) % 9) AS INTEGER) AS fever_days,
    CASE WHEN (3*k + c) % 5 < 3 THEN 1 ELSE 0 END AS uses_mosquito_net,
    CASE WHEN (17*k) % 100 < 30 + 60*pos THEN 'True' ELSE 'False' END AS has_fever,
    CASE WHEN (19*k + c) % 100 < 25 + 55*pos THEN 'true' ELSE 'false' END AS has_chills,
    (23*k + c) % 100 < 40 + 35*pos AS has_headache,
    (29*k + c) % 100 < 15 + 30*pos AS has_vomiting,
    (37*k + c) % 100 < 20 + 15*pos AS has_diarrhea,
    CASE WHEN k % 89 <> 0 THEN (41*k + c) % 100 < 35 + 45*pos END AS has_weakness,
    CASE WHEN c % 101 = 0 THEN NULL WHEN c % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
    CASE WHEN k % 1999 = 0 THEN 'PeriUrban' WHEN seg IN ('BUILDING','HOUSEHOLD') THEN 'Urban'
         ELSE 'Rural' END AS residence,
    CASE WHEN m BETWEEN 4 AND 10 THEN 'Rainy' ELSE 'Dry' END AS season,
    CASE WHEN pos = 1 AND k % 3 = 0 THEN 'Positive' WHEN pos = 1 AND k % 3 = 1 THEN 'positive'
         WHEN pos = 1 THEN ' POSITIVE ' WHEN k % 2 = 0 THEN 'Negative' ELSE '0' END AS case_status,
    pos * ((43*k) % 50000) AS parasitemia_count
  FROM shifted
)"""

# Lenient flags, numbers as doubles, 0/1 target, copies kept.
TYPED = COHORT + """,
typed AS (
  SELECT patient_id, sex, residence, season,
    age_years, TRY_CAST(hemoglobin_g_dl AS DOUBLE) AS hemoglobin_g_dl,
    CAST(fever_days AS DOUBLE) AS fever_days, uses_mosquito_net,
    CAST(lower(has_fever) = 'true' AS INTEGER) AS has_fever,
    CAST(lower(has_chills) = 'true' AS INTEGER) AS has_chills,
    CAST(has_headache AS INTEGER) AS has_headache, CAST(has_vomiting AS INTEGER) AS has_vomiting,
    CAST(has_diarrhea AS INTEGER) AS has_diarrhea, CAST(has_weakness AS INTEGER) AS has_weakness,
    CASE WHEN lower(trim(case_status)) IN ('positive', '1') THEN 1 ELSE 0 END AS case_status
  FROM cohort
)"""

CLEAN = TYPED + """,
clean AS (
  SELECT min(patient_id) AS patient_id, sex, residence, season, age_years, hemoglobin_g_dl, fever_days,
    uses_mosquito_net, has_fever, has_chills, has_headache, has_vomiting, has_diarrhea, has_weakness,
    case_status
  FROM typed GROUP BY ALL
)"""

SPLIT = CLEAN + """,
quota AS (
  SELECT case_status AS cls, q + CASE WHEN row_number() OVER (ORDER BY rem DESC, case_status)
      <= t - sum(q) OVER () THEN 1 ELSE 0 END AS n_test
  FROM (SELECT case_status, (count(*) * t) // n AS q, (count(*) * t) % n AS rem, any_value(t) AS t
        FROM clean, (SELECT count(*) AS n, (count(*) + 4) // 5 AS t FROM clean) GROUP BY case_status, t, n)
),
split AS (
  SELECT s.* EXCLUDE (rk), CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY case_status
          ORDER BY md5(concat(patient_id, ':', 42))) AS rk FROM clean) s
  JOIN quota ON cls = case_status
)"""

# Training medians and modes, and every row filled with them.
NUMERIC = ("age_years", "hemoglobin_g_dl", "fever_days", "uses_mosquito_net", "has_fever",
           "has_chills", "has_headache", "has_vomiting", "has_diarrhea", "has_weakness")
CATEGORICAL = ("sex", "residence", "season")


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1) AS d_{c}")


FILLED = SPLIT + ",\ndefaults AS (SELECT " + ", ".join(
    f"(SELECT quantile_cont({c}, 0.5) FROM split WHERE split = 'train') AS d_{c}" for c in NUMERIC
) + ", " + ", ".join(_mode(c) for c in CATEGORICAL) + "),\nfilled AS (SELECT patient_id, " + ", ".join(
    f"CAST(coalesce({c}, d_{c}) AS DOUBLE) AS {c}" for c in NUMERIC
) + ", " + ", ".join(f"coalesce({c}, d_{c}) AS {c}" for c in CATEGORICAL) + (
    ", case_status, split FROM split, defaults)")

STATS = FILLED + ",\nstats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in NUMERIC
) + " FROM filled WHERE split = 'train')"

SCALED = STATS + ",\nscaled AS (SELECT patient_id, " + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in NUMERIC
) + ", sex, residence, season, case_status, split FROM filled, stats)"

# Four fixed scores per record, with ties.
FIXED = TYPED + """,
scored AS (
  SELECT 'model_' || j AS model, patient_id, residence, case_status AS y,
    ((31*patient_id + 7*j*(patient_id % 1009) + 20*j*case_status) % 101) / 100.0::DOUBLE AS p,
    CASE WHEN ((31*patient_id + 7*j*(patient_id % 1009) + 20*j*case_status) % 101) / 100.0::DOUBLE >= 0.5
      THEN 1 ELSE 0 END AS yhat
  FROM typed, (SELECT unnest([1, 2, 3, 4]) AS j)
)"""
