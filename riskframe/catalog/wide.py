"""Queries over categorical columns that grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.facts import _sound
from riskframe.catalog.registry import query, r6
from riskframe.functions.staging import new_path, stage
from riskframe.operators.clean import clean
from riskframe.operators.prepare import class_weights, weight_expression
from riskframe.operators.score import score
from riskframe.operators.split import apply_split, fit_split
from riskframe.operators.wide import fit_wide, load_wide
from riskframe.plans.wide import train_wide
from riskframe.sources.cohort import order_cohort
from riskframe.spec import ORDERS

_SPLIT = """
typed AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 89 <> 0 THEN o_totalprice END AS total,
  CASE WHEN o_orderkey % 97 <> 0 THEN 'customer ' || o_custkey END AS customer, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CAST(CASE WHEN (11 * o_orderkey) % 10 < 8 THEN o_custkey % 2 ELSE o_orderkey % 2 END AS INTEGER) AS returned FROM orders),
clean AS (SELECT min(order_id) AS order_id, total, customer, day, returned FROM typed GROUP BY ALL),
quota AS (SELECT returned AS cls, q + CASE WHEN row_number() OVER (ORDER BY rem DESC, returned) <= t - sum(q) OVER ()
    THEN 1 ELSE 0 END AS n_test
  FROM (SELECT returned, (count(*) * t) // n AS q, (count(*) * t) % n AS rem, any_value(t) AS t
    FROM clean, (SELECT count(*) AS n, (count(*) + 4) // 5 AS t FROM clean) GROUP BY returned, t, n)),
split AS (SELECT s.* EXCLUDE (rk), CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY returned ORDER BY md5(concat(order_id, ':', 42))) AS rk FROM clean) s
  JOIN quota ON cls = returned),
codes AS (
  SELECT 'customer' AS feature, v AS value, row_number() OVER (ORDER BY v) - 1 AS code
  FROM (SELECT DISTINCT customer AS v FROM split WHERE split = 'train' AND customer IS NOT NULL)
  UNION ALL SELECT 'day', v, row_number() OVER (ORDER BY v) - 1
  FROM (SELECT DISTINCT day AS v FROM split WHERE split = 'train' AND day IS NOT NULL))"""


def _split(spark, sf):
    table = stage(clean(order_cohort(spark, sf), ORDERS), "cleaned")
    return apply_split(table, fit_split(table, ORDERS.id, ORDERS.target))


@query("e9_wide_dictionary", f"WITH {_SPLIT} SELECT feature, value, code FROM codes")
def e9(spark, sf):
    return fit_wide(_split(spark, sf).where("split = 'train'"), ORDERS).dictionary


@query("e11_wide_vectors", f"""WITH {_SPLIT},
stats AS (SELECT quantile_cont(total, 0.5) AS mid,
    (SELECT customer FROM split WHERE split = 'train' AND customer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual,
    (SELECT count(*) FROM codes WHERE feature = 'customer') AS wide
  FROM split WHERE split = 'train'),
filled AS (SELECT order_id, split, coalesce(total, mid) AS total, coalesce(customer, usual) AS customer, day, wide FROM split, stats),
scale AS (SELECT avg(total) AS m, stddev_pop(total) AS s FROM filled WHERE split = 'train')
SELECT order_id, split, round((total - m) / s, 6) AS total, concat_ws(',', 1 + a.code, 1 + wide + b.code) AS hot
FROM filled JOIN scale ON true LEFT JOIN codes a ON a.feature = 'customer' AND a.value = customer
  LEFT JOIN codes b ON b.feature = 'day' AND b.value = day""")
def e11(spark, sf):
    """The scaled number and the places of the ones in every row's sparse vector."""
    table = _split(spark, sf)
    rows = fit_wide(table.where("split = 'train'"), ORDERS).assemble(table)
    at = F.col("_v.indices")
    return rows.withColumn("_v", F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<int>>")["features"]).select(
        "order_id", "split", r6("total"), F.concat_ws(",", F.slice(at, 2, 2).cast("array<string>")).alias("hot"))


def _gradient(result) -> float:
    """Largest entry of the gradient of the penalised mean loss over all numbers and categories."""
    model, rows, y = result.model, result.train, ORDERS.target
    classes = class_weights(rows, y).collect()
    total = sum(r["n"] * r["weight"] for r in classes)
    p = model.predict(rows).withColumn("_r", weight_expression(y, classes) * (F.col("p") - F.col(y)) / total)
    p = stage(p.select("_r", *model.coef, *ORDERS.categorical), "residuals")
    worst = [F.abs(F.sum("_r")).alias("g"), *[F.abs(F.sum(F.col("_r") * F.col(c)) + w / total).alias(c) for c, w in model.coef.items()]]
    most = max(p.agg(*worst).first())
    for c in ORDERS.categorical:
        slopes = p.groupBy(F.col(c).alias("value")).agg(F.sum("_r").alias("g"))
        mine = model.weights.where(F.col("feature") == c)
        most = max(most, mine.join(slopes, "value", "left").agg(
            F.max(F.abs(F.coalesce("g", F.lit(0.0)) + F.col("weight") / total))).first()[0])
    return most


@query("f1_wide_logistic_facts", f"""WITH {_SPLIT} SELECT 'logistic_regression' AS model, returned AS y, count(*) AS n, true AS checked
FROM split WHERE split = 'test' GROUP BY returned""")
def f1(spark, sf):
    """The gradient vanishes in every category, and the reloaded model scores raw rows like the fresh one."""
    path = new_path(spark, "wide")
    raw = order_cohort(spark, sf)
    result = train_wide(raw, ORDERS, out_dir=path)
    again = load_wide(spark, path, ORDERS)
    fresh = result.scored.select(ORDERS.id, F.round("p", 4).alias("p"))
    reloaded = score(raw, ORDERS, again.prep, again.predict).join(fresh, ORDERS.id)
    same = reloaded.where(~F.col("predicted_probability").eqNullSafe(F.col("p"))).isEmpty()
    return _sound(result.scored, same and _gradient(result) < 1e-4)
