"""Reading, profiling, sorting and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasirisk import (
    attribute_contributions,
    by_distinct,
    cell_information_gain,
    column_influence,
    columns_of_kind,
    combination_contribution,
    combine_dictionary,
    describe_column,
    distinct_values,
    drop_columns,
    load_dictionary,
    load_table,
    preview,
    profile,
    project,
    rounded as two_decimals,
    sort_table,
    suda_record_table,
)
from quasirisk.plans.materialize import new_path
from quasirisk.sources import sinks
from workload.common import (
    DOC_QI,
    DOC_SQL,
    ORDER_QI,
    ORDER_SQL,
    PART_QI,
    PART_SQL,
    Registered,
    labelled_documents,
    orders,
    parts,
    rounded,
    same_tuple,
    gains_sql,
    table,
)
from workload.risk import QUERIES as RISK
from workload.special_uniques import PART_MSU, _codes_cte, _encoded, _shares_sql, dis_sql

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART_COLUMNS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]


def _written(spark, df, suffix):
    path = new_path(spark, "table") + suffix
    df.write.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _padded(df):
    """The table under names with blanks around them, as found in real headers."""
    return df.toDF(*[f"  {c} " for c in df.columns])


def _profile_sql(source, columns, overrides=None):
    kind = "CASE WHEN n_distinct > 45 THEN 'Continuous' ELSE 'Categorical' END"
    for c, k in (overrides or {}).items():
        kind = f"CASE WHEN col = '{c}' THEN '{k}' ELSE {kind} END"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct FROM t" for c in columns)
    return f"""SELECT col AS "column", n_distinct, {kind} AS kind FROM (WITH t AS ({source}) {rows})"""


def _dictionary(spark, sf_dir):
    """Write a column dictionary made from the profile of ``part`` and read it back."""
    known = profile(parts(spark, sf_dir)).where("kind = 'Categorical'")
    entries = F.map_from_entries(F.collect_list(F.struct("column", F.struct(F.col("n_distinct").alias("Levels")))))
    path = new_path(spark, "dictionary")
    # One line per categorical column of one table.
    known.agg(F.to_json(entries).alias("value")).write.text(path)
    return load_dictionary(spark, path)


DICTIONARY_SQL = f"""WITH p AS ({_profile_sql(PART_SQL, PART_COLUMNS)})
SELECT "column", n_distinct, kind,
  CASE WHEN kind = 'Categorical' THEN '{{"Levels":' || n_distinct || '}}' ELSE 'not available' END AS metadata FROM p"""


def _gains_csv(spark, sf_dir):
    rows = rounded(cell_information_gain(parts(spark, sf_dir), PART_QI, "p_partkey"), [f"cig_{c}" for c in PART_QI] + ["RIG"])
    return load_table(spark, sinks.write_gains(rows, "p_partkey", new_path(spark, "gains") + ".csv"))


def _records_csv(spark, sf_dir):
    records = suda_record_table(parts(spark, sf_dir), PART_QI, "p_partkey")
    path = sinks.write_suda_records(records, "p_partkey", new_path(spark, "records") + ".csv")
    return load_table(spark, path).withColumnRenamed("dis-score", "dis_score").select(
        *[F.col(c).cast("double").alias(c) for c in [*PART_QI, "dis_score", "score"]]
    )


def _contributions_csv(spark, sf_dir):
    shares = two_decimals(attribute_contributions(parts(spark, sf_dir), PART_QI, "p_partkey"))
    path = sinks.write_contributions(shares, new_path(spark, "contributions") + ".csv", PART_QI)
    return load_table(spark, path).withColumn("contribution", F.col("contribution").cast("double"))


def _influence_csv(spark, sf_dir):
    path = sinks.write_influence(column_influence(parts(spark, sf_dir), PART_QI), new_path(spark, "influence") + ".csv")
    return load_table(spark, path).withColumn("Normalized Difference", F.col("Normalized Difference").cast("double"))


def _combinations_csv(spark, sf_dir):
    contribution = rounded(combination_contribution(parts(spark, sf_dir), PART_QI, 1, 2), ["score"])
    path = sinks.write_combinations(contribution, new_path(spark, "results"))
    return load_table(spark, path).withColumn("Score", F.col("Score").cast("double"))


QUERIES = {
    "load_csv": Registered(
        lambda spark, sf: load_table(spark, _written(spark, _padded(parts(spark, sf)), ".csv")),
        "SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    ),
    "load_tsv_nulls": Registered(
        lambda spark, sf: load_table(spark, _written(spark, _padded(labelled_documents(spark, sf)), ".tsv")),
        f"""SELECT doc_id, lang, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, n_chars
FROM ({DOC_SQL})""",
    ),
    "load_csv_schema": Registered(
        lambda spark, sf: load_table(
            spark, _written(spark, orders(spark, sf), ".csv"), schema=orders(spark, sf).schema
        ),
        ORDER_SQL,
    ),
    "profile": Registered(
        lambda spark, sf: by_distinct(profile(table(spark, sf, "customer"))),
        _profile_sql("SELECT * FROM customer", CUSTOMER_COLUMNS),
    ),
    "profile_nulls": Registered(
        lambda spark, sf: profile(labelled_documents(spark, sf)),
        _profile_sql(DOC_SQL, ["doc_id", *DOC_QI, "n_chars"]),
    ),
    "profile_overrides": Registered(
        lambda spark, sf: profile(orders(spark, sf), {"o_orderkey": "Categorical", "order_month": "Continuous"}),
        _profile_sql(
            ORDER_SQL, ["o_orderkey", *ORDER_QI, "o_totalprice"],
            {"o_orderkey": "Categorical", "order_month": "Continuous"},
        ),
    ),
    "columns_of_kind": Registered(
        lambda spark, sf: columns_of_kind(profile(orders(spark, sf)), "Categorical"),
        f"""SELECT "column" FROM ({_profile_sql(ORDER_SQL, ["o_orderkey", *ORDER_QI, "o_totalprice"])})
WHERE kind = 'Categorical'""",
    ),
    "project_and_drop": Registered(
        lambda spark, sf: drop_columns(project(table(spark, sf, "orders"), ["o_orderkey", *ORDER_QI[:2]]), ["o_orderstatus"]),
        "SELECT o_orderkey, o_orderpriority FROM orders",
    ),
    "sorted_preview": Registered(
        lambda spark, sf: preview(
            sort_table(orders(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [True, False])
        ),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "distinct_values": Registered(
        lambda spark, sf: distinct_values(table(spark, sf, "part"), "p_type"),
        "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL",
    ),
    "distinct_values_nulls": Registered(
        lambda spark, sf: distinct_values(labelled_documents(spark, sf), "quality", with_null=True),
        f"SELECT DISTINCT quality FROM ({DOC_SQL})",
    ),
    "column_dictionary": Registered(
        lambda spark, sf: combine_dictionary(profile(parts(spark, sf)), _dictionary(spark, sf)), DICTIONARY_SQL
    ),
    "describe_column": Registered(
        lambda spark, sf: describe_column(_dictionary(spark, sf), "p_brand"),
        """SELECT 'p_brand' AS "column", '{"Levels":' || count(DISTINCT p_brand) || '}' AS metadata FROM part""",
    ),
    "write_gains": Registered(
        _gains_csv,
        f"""WITH {gains_sql(PART_SQL, PART_QI)}
SELECT t.p_partkey, {", ".join(f'round("cig_{c}", 6) + 0.0 AS "{c}"' for c in PART_QI)}, round("RIG", 6) + 0.0 AS "RIG"
FROM t JOIN gains ON {same_tuple(PART_QI)}""",
    ),
    "write_suda_records": Registered(
        _records_csv,
        f"""WITH {PART_MSU}, {_codes_cte(PART_QI, PART_QI[:2])}, {dis_sql(PART_QI, 0.2)},
  s AS (SELECT t.*, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id)
SELECT {_encoded(PART_QI, PART_QI[:2], "s")}, score, CAST(printf('%.4f',
  score * (SELECT theta * ones FROM level) / (SELECT sum(score) FROM s)) AS DOUBLE) + 0.0 AS dis_score FROM s""",
    ),
    "write_contributions": Registered(
        _contributions_csv,
        f"SELECT CAST(list_position({PART_QI}, variable) - 1 AS BIGINT) AS \"index\", * FROM ({_shares_sql(PART_MSU, PART_QI)})",
    ),
    "write_influence": Registered(
        _influence_csv,
        f"""SELECT "column" AS "Column", unique_count_after_removal AS "Unique Rows After Removal",
  difference AS "Difference in Unique Rows", normalized_difference AS "Normalized Difference"
FROM ({RISK["column_influence"].sql})""",
    ),
    "write_combinations": Registered(
        _combinations_csv,
        f"""SELECT combination AS "Combination", unique_rows AS "Unique Rows",
  unique_rows_excluding AS "Unique Rows Excluding Columns", score AS "Score" FROM ({RISK["combination_contribution"].sql})""",
    ),
}
