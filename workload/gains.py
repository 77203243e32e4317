"""Cell and row information gain and everything derived from it."""

from __future__ import annotations


from quasirisk import (
    cell_information_gain,
    gain_long,
    gain_matrix,
    gain_summary,
    gain_totals,
    information_gain,
    mad_outliers,
    personal_information_factor,
)
from workload.common import (
    DOC_QI,
    DOC_SQL,
    LINE_QI,
    LINE_SQL,
    ORDER_QI,
    ORDER_SQL,
    PART_QI,
    PART_SQL,
    Registered,
    gains_sql,
    labelled_documents,
    lines,
    orders,
    parts,
    rounded,
    same_tuple,
)


def _cells(qi):
    return [f"cig_{c}" for c in qi]


def _rows_sql(source, qi, row_id, masked=(), mask="{c} IS NULL", only=None):
    chosen = only or [*_cells(qi), "RIG"]
    values = ", ".join(f'round(gains."{c}", 6) + 0.0 AS "{c}"' for c in chosen)
    return f"""WITH {gains_sql(source, qi, masked, mask)}
SELECT t.{row_id}, {values} FROM t JOIN gains ON {same_tuple(qi)}"""


def _expanded(source, qi, masked=()):
    """Row-level long form: one (col, g) row per table row and QI."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, \"cig_{c}\" AS g FROM per_row" for c in qi)
    return f"""WITH {gains_sql(source, qi, masked)},
  per_row AS (SELECT gains.* FROM t JOIN gains ON {same_tuple(qi)}),
  long AS ({long})"""


def _pif_sql(source, qi, percentile, masked=()):
    return f"""WITH {gains_sql(source, qi, masked)},
  per_row AS (SELECT gains."RIG" AS rig FROM t JOIN gains ON {same_tuple(qi)}),
  p AS (SELECT quantile_cont(rig, {percentile / 100}) AS pif FROM per_row)
SELECT CAST({percentile} AS INTEGER) AS percentile, round(pif, 6) + 0.0 AS pif,
  CAST(CASE WHEN pif >= 1 THEN 1 WHEN pif >= 0.33 THEN 2 WHEN pif >= 0.11 THEN 3 WHEN pif >= 0.04 THEN 4 ELSE 5 END
    AS INTEGER) AS safe_level FROM p"""


def _cig(df, qi, row_id, **mask):
    return rounded(cell_information_gain(df, qi, row_id, **mask), [*_cells(qi), "RIG"])


def _pif(df, qi, percentile, **mask):
    return rounded(personal_information_factor(information_gain(df, qi, **mask), percentile), ["pif"])


def _summary(df, qi, **mask):
    numbers = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return rounded(gain_summary(information_gain(df, qi, **mask)), numbers, 5)


def _summary_sql(source, qi, masked=()):
    stats = {
        "mean": "avg(g)", "std": "stddev_samp(g)", "min": "min(g)", "p25": "quantile_cont(g, 0.25)",
        "p50": "quantile_cont(g, 0.5)", "p75": "quantile_cont(g, 0.75)", "max": "max(g)",
    }
    listed = ", ".join(f'round({e}, 5) + 0.0 AS "{a}"' for a, e in stats.items())
    return f"""{_expanded(source, qi, masked)},
  s AS (SELECT col AS "column", {listed}, avg(g) AS raw FROM long GROUP BY col)
SELECT * EXCLUDE (raw), abs(raw - max(raw) OVER ()) < 1e-9 AS is_top FROM s"""


QUERIES = {
    "cell_information_gain": Registered(
        lambda spark, sf: _cig(parts(spark, sf), PART_QI, "p_partkey"), _rows_sql(PART_SQL, PART_QI, "p_partkey")
    ),
    "cell_information_gain_orders": Registered(
        lambda spark, sf: _cig(orders(spark, sf), ORDER_QI, "o_orderkey"), _rows_sql(ORDER_SQL, ORDER_QI, "o_orderkey")
    ),
    "cell_information_gain_nulls": Registered(
        lambda spark, sf: _cig(labelled_documents(spark, sf), DOC_QI, "doc_id"), _rows_sql(DOC_SQL, DOC_QI, "doc_id")
    ),
    "cig_mask_nulls": Registered(
        lambda spark, sf: _cig(labelled_documents(spark, sf), DOC_QI, "doc_id", mask_nulls=True),
        _rows_sql(DOC_SQL, DOC_QI, "doc_id", DOC_QI),
    ),
    "cig_mask_value": Registered(
        lambda spark, sf: _cig(labelled_documents(spark, sf), DOC_QI, "doc_id", mask_values=[0]),
        _rows_sql(DOC_SQL, DOC_QI, "doc_id", ["quality", "toxic"], "{c} = 0"),
    ),
    "row_information_gain": Registered(
        lambda spark, sf: _cig(orders(spark, sf), ORDER_QI, "o_orderkey").select("o_orderkey", "RIG"),
        _rows_sql(ORDER_SQL, ORDER_QI, "o_orderkey", only=["RIG"]),
    ),
    "personal_information_factor": Registered(
        lambda spark, sf: _pif(orders(spark, sf), ORDER_QI, 95), _pif_sql(ORDER_SQL, ORDER_QI, 95)
    ),
    "pif_median_masked": Registered(
        lambda spark, sf: _pif(labelled_documents(spark, sf), DOC_QI, 50, mask_nulls=True),
        _pif_sql(DOC_SQL, DOC_QI, 50, DOC_QI),
    ),
    "pif_lineitem": Registered(
        lambda spark, sf: _pif(lines(spark, sf), LINE_QI, 95), _pif_sql(LINE_SQL, LINE_QI, 95)
    ),
    "gain_totals": Registered(
        lambda spark, sf: rounded(gain_totals(information_gain(parts(spark, sf), PART_QI)), ["total"], 4),
        f"""{_expanded(PART_SQL, PART_QI)}
SELECT col AS "column", round(sum(g), 4) + 0.0 AS total FROM long GROUP BY col""",
    ),
    "gain_totals_masked": Registered(
        lambda spark, sf: rounded(
            gain_totals(information_gain(labelled_documents(spark, sf), DOC_QI, mask_nulls=True)), ["total"], 4
        ),
        f"""{_expanded(DOC_SQL, DOC_QI, DOC_QI)}
SELECT col AS "column", round(sum(g), 4) + 0.0 AS total FROM long GROUP BY col""",
    ),
    "gain_summary": Registered(
        lambda spark, sf: _summary(orders(spark, sf), ORDER_QI), _summary_sql(ORDER_SQL, ORDER_QI)
    ),
    "gain_summary_masked": Registered(
        lambda spark, sf: _summary(labelled_documents(spark, sf), DOC_QI, mask_nulls=True),
        _summary_sql(DOC_SQL, DOC_QI, DOC_QI),
    ),
    "gain_matrix": Registered(
        lambda spark, sf: gain_matrix(_cig(parts(spark, sf), PART_QI, "p_partkey"), "p_partkey"),
        f"""WITH {gains_sql(PART_SQL, PART_QI)}
SELECT t.p_partkey, {", ".join(f'round(gains."cig_{c}", 6) + 0.0 AS "{c}"' for c in PART_QI)}
FROM t JOIN gains ON {same_tuple(PART_QI)}""",
    ),
    "gain_long": Registered(
        lambda spark, sf: gain_long(_cig(parts(spark, sf), PART_QI, "p_partkey"), ["p_partkey"]),
        f"""WITH {gains_sql(PART_SQL, PART_QI)},
  r AS (SELECT t.p_partkey, gains.* FROM t JOIN gains ON {same_tuple(PART_QI)})
{" UNION ALL ".join(f'SELECT p_partkey, {chr(39)}{c}{chr(39)} AS "column", round("cig_{c}", 6) + 0.0 AS cig FROM r' for c in PART_QI)}""",
    ),
    "rig_outliers_two_sided": Registered(
        lambda spark, sf: rounded(
            mad_outliers(
                rounded(cell_information_gain(parts(spark, sf), PART_QI, "p_partkey"), ["RIG"], 9),
                "RIG", "p_partkey", 2.0, two_sided=True, zero_fallback=False,
            ),
            ["value", "z_score"], 4,
        ),
        f"""WITH {gains_sql(PART_SQL, PART_QI)},
  v AS (SELECT t.p_partkey, round(gains."RIG", 9) AS x FROM t JOIN gains ON {same_tuple(PART_QI)}),
  c AS (SELECT count(*) AS n_rows, median(x) AS med FROM v),
  d AS (SELECT median(abs(x - med)) AS mad FROM v, c)
SELECT p_partkey, round(x, 4) + 0.0 AS value, round((x - med) / (mad / 0.6745), 4) + 0.0 AS z_score
FROM v, c, d WHERE n_rows >= 5 AND abs((x - med) / (mad / 0.6745)) > 2.0""",
    ),
}

__all__ = ["QUERIES"]
