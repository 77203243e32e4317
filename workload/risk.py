"""Group-size metrics and column influence."""

from __future__ import annotations

from quasirisk import (
    collapse_table,
    column_influence,
    combination_contribution,
    k_anonymity,
    l_diversity,
    risk_summary,
    sensitive_attribute,
    unique_rows,
)
from workload.common import (
    CUSTOMER_QI,
    CUSTOMER_SQL,
    DOC_QI,
    DOC_SQL,
    LINE_QI,
    LINE_SQL,
    PART_QI,
    PART_SQL,
    Registered,
    customers,
    labelled_documents,
    lines,
    parts,
    rounded,
    subsets,
    table,
    uniques_sql,
)


def _summary_sql(source: str, qi: list[str], sensitive: str | None, columns: int) -> str:
    names = ", ".join(qi)
    filled = " AND ".join(f"{c} IS NOT NULL" for c in qi)
    distinct = f"count(DISTINCT {sensitive})" if sensitive else "CAST(NULL AS BIGINT)"
    return f"""WITH t AS ({source}),
  g AS (SELECT {names}, count(*) AS n, {distinct} AS l FROM t GROUP BY {names})
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST({columns} AS INTEGER) AS total_columns,
  CAST({len(qi)} AS INTEGER) AS num_selected_columns, count(*) FILTER (n = 1) AS num_unique_rows,
  min(n) FILTER ({filled}) AS k_anonymity, CAST(min(l) FILTER ({filled}) AS BIGINT) AS l_diversity FROM g"""


def _influence_sql(source: str, qi: list[str]) -> str:
    full = uniques_sql(qi, range(len(qi)), False)
    rows = [
        f"SELECT '{c}' AS col, {full} AS u_all, {uniques_sql(qi, [j for j in range(len(qi)) if j != i], False)} AS u_rest, "
        f"(SELECT count(DISTINCT {c}) FROM t) AS d"
        for i, c in enumerate(qi)
    ]
    return f"""WITH t AS ({source}), r AS ({" UNION ALL ".join(rows)})
SELECT col AS "column", u_rest AS unique_count_after_removal, u_all - u_rest AS difference, d AS distinct_values,
  round((u_all - u_rest) / d::DOUBLE, 6) + 0.0 AS ratio,
  CAST(printf('%.1f', (u_all - u_rest) / d::DOUBLE) AS DOUBLE) + 0.0 AS normalized_difference FROM r"""


def _combination_sql(source: str, qi: list[str], low: int, high: int) -> str:
    full = uniques_sql(qi, range(len(qi)), True)
    rows = [
        f"SELECT '{', '.join(qi[i] for i in s)}' AS combination, CAST({len(s)} AS INTEGER) AS size, "
        f"{uniques_sql(qi, s, True)} AS unique_rows, "
        f"{uniques_sql(qi, [i for i in range(len(qi)) if i not in s], True)} AS unique_rows_excluding"
        for s in subsets(qi, low, high)
    ]
    return f"""WITH t AS ({source}), r AS ({" UNION ALL ".join(rows)})
SELECT combination, size, CAST(unique_rows AS BIGINT) AS unique_rows,
  CAST(unique_rows_excluding AS BIGINT) AS unique_rows_excluding,
  round(({full} - unique_rows_excluding)::DOUBLE / nullif(unique_rows, 0), 6) + 0.0 AS score FROM r"""


def _influence(df, qi):
    return rounded(column_influence(df, qi), ["ratio", "normalized_difference"])


QUERIES = {
    "risk_summary": Registered(
        lambda spark, sf: risk_summary(customers(spark, sf).drop("c_custkey"), CUSTOMER_QI, "balance_sign"),
        _summary_sql(CUSTOMER_SQL, CUSTOMER_QI, "balance_sign", 4),
    ),
    "risk_summary_nulls": Registered(
        lambda spark, sf: risk_summary(labelled_documents(spark, sf).drop("n_chars"), DOC_QI),
        _summary_sql(DOC_SQL, DOC_QI, None, 5),
    ),
    "risk_summary_lineitem": Registered(
        lambda spark, sf: risk_summary(
            table(spark, sf, "lineitem").select(*LINE_QI, "l_linenumber"), LINE_QI, "l_linenumber"
        ),
        _summary_sql("SELECT * FROM lineitem", LINE_QI, "l_linenumber", 6),
    ),
    "collapse_table": Registered(
        lambda spark, sf: collapse_table(labelled_documents(spark, sf), DOC_QI, "doc_id"),
        f"""SELECT lang, source, quality, toxic, count(*) AS group_rows, min(doc_id) AS doc_id FROM ({DOC_SQL})
GROUP BY lang, source, quality, toxic""",
    ),
    "risk_summary_collapsed": Registered(
        lambda spark, sf: risk_summary(
            collapse_table(customers(spark, sf), [*CUSTOMER_QI, "balance_sign"]), CUSTOMER_QI, "balance_sign", "group_rows"
        ),
        _summary_sql(CUSTOMER_SQL, CUSTOMER_QI, "balance_sign", 4),
    ),
    "unique_rows": Registered(
        lambda spark, sf: unique_rows(lines(spark, sf), LINE_QI),
        f"WITH t AS ({LINE_SQL}) SELECT {uniques_sql(LINE_QI, range(5), False)} AS num_unique_rows",
    ),
    "k_anonymity": Registered(
        lambda spark, sf: k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"]),
        "SELECT min(n) AS k_anonymity FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)",
    ),
    "k_anonymity_nulls": Registered(
        lambda spark, sf: k_anonymity(labelled_documents(spark, sf), ["lang", "quality", "toxic"]),
        f"""SELECT min(n) AS k_anonymity FROM (SELECT count(*) AS n FROM ({DOC_SQL})
WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang, quality, toxic)""",
    ),
    "l_diversity": Registered(
        lambda spark, sf: l_diversity(
            customers(spark, sf),
            ["n_name", "c_mktsegment"],
            sensitive_attribute([("c_custkey", False), ("balance_band", True), ("balance_sign", True)]),
        ),
        f"""SELECT min(l) AS l_diversity FROM (SELECT count(DISTINCT balance_band) AS l FROM ({CUSTOMER_SQL})
GROUP BY n_name, c_mktsegment)""",
    ),
    "l_diversity_nulls": Registered(
        lambda spark, sf: l_diversity(labelled_documents(spark, sf), ["lang", "source"], "quality"),
        f"""SELECT min(l) AS l_diversity FROM (SELECT count(DISTINCT quality) AS l FROM ({DOC_SQL})
WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source)""",
    ),
    "column_influence": Registered(
        lambda spark, sf: _influence(parts(spark, sf), PART_QI), _influence_sql(PART_SQL, PART_QI)
    ),
    "column_influence_nulls": Registered(
        lambda spark, sf: _influence(labelled_documents(spark, sf), DOC_QI), _influence_sql(DOC_SQL, DOC_QI)
    ),
    "column_influence_lineitem": Registered(
        lambda spark, sf: _influence(lines(spark, sf), LINE_QI), _influence_sql(LINE_SQL, LINE_QI)
    ),
    "combination_contribution": Registered(
        lambda spark, sf: rounded(combination_contribution(parts(spark, sf), PART_QI, 1, 2), ["score"]),
        _combination_sql(PART_SQL, PART_QI, 1, 2),
    ),
    "combination_contribution_nulls": Registered(
        lambda spark, sf: rounded(combination_contribution(labelled_documents(spark, sf), DOC_QI, 1, 4), ["score"]),
        _combination_sql(DOC_SQL, DOC_QI, 1, 4),
    ),
    "combination_contribution_lineitem": Registered(
        lambda spark, sf: rounded(combination_contribution(lines(spark, sf), LINE_QI, 3, 7), ["score"]),
        _combination_sql(LINE_SQL, LINE_QI, 3, 5),
    ),
}
