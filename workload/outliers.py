"""Robust outliers and box-plot numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasirisk import boxplot_statistics, mad_outliers
from workload.common import ORDER_SQL, Registered, mad_sql, orders, rounded, table

# Mostly zero: the value of error events only, so the MAD over all values is 0.
ERROR_SQL = "SELECT event_id, CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS error_value FROM events"


def error_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0).alias("error_value")
    )


def _outliers(df, column, row_id, k, **options):
    return rounded(mad_outliers(df, column, row_id, k, **options), ["value", "z_score"], 4)


def _outliers_sql(source, column, row_id, test):
    return f"""WITH {mad_sql(source, column, row_id)}
SELECT id AS {row_id}, round(x, 4) + 0.0 AS value, round(z, 4) + 0.0 AS z_score FROM scored_x WHERE {test}"""


def _box(df, column, k):
    return rounded(boxplot_statistics(df, column, k), ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


def _box_sql(source, column, row_id, k):
    clip = lambda v: f"round(least(greatest({v}, -{k}), {k}), 4) + 0.0"
    return f"""WITH {mad_sql(source, column, row_id)},
  q AS (SELECT quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.75) AS q3, count(*) AS n
    FROM scored_x),
  w AS (SELECT min(z) FILTER (z >= q1 - 1.5 * (q3 - q1)) AS lo, max(z) FILTER (z <= q3 + 1.5 * (q3 - q1)) AS hi,
    count(*) FILTER (z < q1 - 1.5 * (q3 - q1) OR z > q3 + 1.5 * (q3 - q1)) AS n_fliers FROM scored_x, q)
SELECT n AS n_values, round(q1, 4) + 0.0 AS q1, round(med, 4) + 0.0 AS median, round(q3, 4) + 0.0 AS q3,
  {clip("least(lo, q1)")} AS whisker_low, {clip("greatest(hi, q3)")} AS whisker_high, n_fliers FROM q, w"""


QUERIES = {
    "mad_outliers": Registered(
        lambda spark, sf: _outliers(orders(spark, sf), "o_totalprice", "o_orderkey", 1.0),
        _outliers_sql(ORDER_SQL, "o_totalprice", "o_orderkey", "z > 1.0"),
    ),
    "mad_outliers_events": Registered(
        lambda spark, sf: _outliers(table(spark, sf, "events"), "value", "event_id", 2.2414),
        _outliers_sql("SELECT event_id, value FROM events", "value", "event_id", "z > 2.2414"),
    ),
    "mad_outliers_zero_fallback": Registered(
        lambda spark, sf: _outliers(error_values(spark, sf), "error_value", "event_id", 2.2414),
        _outliers_sql(ERROR_SQL, "error_value", "event_id", "z > 2.2414"),
    ),
    "mad_outliers_two_sided": Registered(
        lambda spark, sf: _outliers(orders(spark, sf), "o_totalprice", "o_orderkey", 1.2, two_sided=True),
        _outliers_sql(ORDER_SQL, "o_totalprice", "o_orderkey", "abs(z) > 1.2"),
    ),
    "boxplot_statistics": Registered(
        lambda spark, sf: _box(table(spark, sf, "events"), "value", 2.2414),
        _box_sql("SELECT event_id, value FROM events", "value", "event_id", 2.2414),
    ),
    "boxplot_zero_fallback": Registered(
        lambda spark, sf: _box(error_values(spark, sf), "error_value", 2.5),
        _box_sql(ERROR_SQL, "error_value", "event_id", 2.5),
    ),
}
