"""Many quasi-identifiers: searches beyond the reach of one count per subset; ordered files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasirisk import attribute_contributions, column_influence, combination_contribution, minimal_sample_uniques, suda_scores
from quasirisk import rounded as two_decimals
from quasirisk.plans.materialize import new_path
from quasirisk.sources import sinks
from workload.common import PART_QI, Registered, msu_sql, parts, rounded, table
from workload.risk import QUERIES as RISK
from workload.special_uniques import PART_MSU, _msu_names, _scores_sql, _shares_sql

# Expressions that Spark and DuckDB evaluate alike.
ORDER_COLUMNS = {
    "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "y": "CAST(year(o_orderdate) AS INT)",
    "mo": "CAST(month(o_orderdate) AS INT)", "d": "CAST(day(o_orderdate) AS INT)", "q": "CAST(quarter(o_orderdate) AS INT)",
    **{f"price_{n}": f"CAST(floor(o_totalprice / {n}) AS BIGINT)" for n in (1000, 5000, 10000, 25000, 50000, 100000)},
    **{f"cust_{n}": f"o_custkey % {n}" for n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)},
    **{f"cust_by_{n}": f"CAST(floor(o_custkey / {n}) AS BIGINT)" for n in (10, 100)},
}
PART_COLUMNS = {
    "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size", "color": "substr(p_name, 1, 3)",
    **{f"price_{n}": f"CAST(floor(p_retailprice / {n}) AS BIGINT)" for n in (50, 200)},
    **{f"key_{n}": f"p_partkey % {n}" for n in (3, 5, 7, 11)},
}
ORDER_QI, WIDE_QI = list(ORDER_COLUMNS), list(PART_COLUMNS)


def _listed(columns):
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


WIDE_ORDERS = f"SELECT o_orderkey, {_listed(ORDER_COLUMNS)} FROM orders"
WIDE_PARTS = f"SELECT p_partkey, {_listed(PART_COLUMNS)} FROM part"


def wide_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in ORDER_COLUMNS.items()])


def wide_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in PART_COLUMNS.items()])


def _cube_sql(source, qi, low, high):
    """Combination contribution by one cube; for columns without NULL."""
    m = len(qi)
    names = ", ".join(f"CASE WHEN s.mask & {1 << i} <> 0 THEN '{c}' END" for i, c in enumerate(qi))
    return f"""WITH t AS ({source}),
  cells AS (SELECT {(1 << m) - 1} - GROUPING({", ".join(reversed(qi))}) AS mask, count(*) AS n FROM t GROUP BY CUBE ({", ".join(qi)})),
  u AS (SELECT mask, count(*) FILTER (n = 1 AND mask <> 0) AS uniques FROM cells GROUP BY mask),
  s AS (SELECT a.mask, a.uniques, b.uniques AS rest, (SELECT uniques FROM u WHERE mask = {(1 << m) - 1}) AS everything
    FROM u a JOIN u b ON b.mask = {(1 << m) - 1} - a.mask WHERE bit_count(a.mask) BETWEEN {low} AND {high})
SELECT array_to_string(list_filter([{names}], lambda c: c IS NOT NULL), ', ') AS combination,
  CAST(bit_count(mask) AS INTEGER) AS size, uniques AS unique_rows, rest AS unique_rows_excluding,
  CASE WHEN uniques > 0 THEN round((everything - rest) / uniques, 6) + 0.0 END AS score FROM s"""


def _lines(spark, path):
    """Lines of a written table with their place, over all files in the order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    # A handful of result lines.
    listed = lines.agg(F.sort_array(F.collect_list(F.struct("file", "at", "value"))).alias("lines"))
    body = F.filter("lines", lambda x: ~x["value"].startswith("index,") & ~x["value"].startswith("Column,"))
    return listed.select(F.posexplode(body).alias("place", "line")).select("place", F.col("line.value").alias("line"))


def _contributions_file(spark, sf_dir):
    shares = two_decimals(attribute_contributions(parts(spark, sf_dir), PART_QI, "p_partkey"))
    return _lines(spark, sinks.write_contributions(shares, new_path(spark, "contributions") + ".csv", PART_QI))


def _influence_file(spark, sf_dir):
    return _lines(spark, sinks.write_influence(column_influence(parts(spark, sf_dir), PART_QI), new_path(spark, "influence") + ".csv"))


QUERIES = {
    "minimal_sample_uniques_wide": Registered(
        lambda spark, sf: minimal_sample_uniques(wide_orders(spark, sf), ORDER_QI, "o_orderkey", max_size=2),
        f"""WITH {msu_sql(WIDE_ORDERS, "o_orderkey", ORDER_QI, 2)}
SELECT id AS o_orderkey, {_msu_names(ORDER_QI)} AS msu, CAST(size AS INTEGER) AS size FROM msu""",
    ),
    "suda_scores_wide": Registered(
        lambda spark, sf: suda_scores(wide_parts(spark, sf), WIDE_QI, "p_partkey", 0.2, max_size=4),
        _scores_sql(msu_sql(WIDE_PARTS, "p_partkey", WIDE_QI, 4), WIDE_QI, "p_partkey", 0.2),
    ),
    "combination_contribution_wide": Registered(
        lambda spark, sf: rounded(combination_contribution(wide_parts(spark, sf), WIDE_QI, 3, 7), ["score"]),
        _cube_sql(WIDE_PARTS, WIDE_QI, 3, 7),
    ),
    "write_contributions_ordered": Registered(
        _contributions_file,
        f"""SELECT CAST(list_position({PART_QI}, variable) - 1 AS INTEGER) AS place,
  (list_position({PART_QI}, variable) - 1) || ',' || variable || ',' || contribution AS line FROM ({_shares_sql(PART_MSU, PART_QI)})""",
    ),
    "write_influence_ordered": Registered(
        _influence_file,
        f"""SELECT CAST(row_number() OVER (ORDER BY normalized_difference DESC, "column") - 1 AS INTEGER) AS place,
  "column" || ',' || unique_count_after_removal || ',' || difference || ',' || normalized_difference AS line
FROM ({RISK["column_influence"].sql})""",
    ),
}
