"""Special uniques (SUDA2) and category codes."""

from __future__ import annotations

from quasirisk import (
    attribute_contributions,
    attribute_level_contributions,
    category_codes,
    encode_categories,
    file_level_risk,
    mad_outliers,
    minimal_sample_uniques,
    record_contributions,
    suda_record_table,
    suda_scores,
    with_row_id,
)
from quasirisk import rounded as two_decimals
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
    dis_sql,
    labelled_documents,
    lines,
    mad_sql,
    msu_sql,
    orders,
    parts,
    rounded,
)

PART_MSU = msu_sql(PART_SQL, "p_partkey", PART_QI)
DOC_MSU = msu_sql(DOC_SQL, "doc_id", DOC_QI)
DOC_MSU_SET = msu_sql(DOC_SQL, "doc_id", DOC_QI, missing_nulls=True)
LINE_NUMBERED = f"SELECT row_number() OVER () AS rn, * FROM ({LINE_SQL})"
LINE_MSU = msu_sql(LINE_NUMBERED, "rn", LINE_QI)


def _msu_names(qi):
    listed = ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{c}' END" for i, c in enumerate(qi))
    return f"array_to_string(list_filter([{listed}], lambda c: c IS NOT NULL), ', ')"


def _scores_sql(ctes, qi, row_id, fraction):
    return f"""WITH {ctes}, {dis_sql(qi, fraction)},
  s AS (SELECT t.id, coalesce(n_msu, 0) AS n_msu, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id),
  d AS (SELECT *, score * (SELECT theta * ones FROM level) / (SELECT sum(score) FROM s) AS dis FROM s)
SELECT id AS {row_id}, CAST(n_msu AS INTEGER) AS n_msu, score, CAST(printf('%.4f', dis) AS DOUBLE) + 0.0 AS dis_score,
  least(CAST(printf('%.4f', dis) AS DOUBLE), 1.0) + 0.0 AS dis_prob FROM d"""


def _shares_sql(ctes, qi):
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, 100.0 * sum(CASE WHEN mask & {1 << i} <> 0 THEN weight ELSE 0 END) / sum(weight) AS s FROM msu"
        for i, c in enumerate(qi)
    )
    return f"""WITH {ctes}, shares AS ({rows})
SELECT variable, CAST(printf('%.2f', s) AS DOUBLE) + 0.0 AS contribution FROM shares"""


def _codes_cte(qi, text):
    """CTE codes(variable, value, code) of the text columns of t."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS value, dense_rank() OVER (ORDER BY {c}) - 1 AS code "
        f"FROM (SELECT DISTINCT {c} FROM t WHERE {c} IS NOT NULL)"
        for c in text
    )
    return f"codes AS ({rows})"


def _levels_sql(ctes, qi, text):
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(t.{c} AS VARCHAR) AS value, "
        f"{'CAST(NULL AS DOUBLE)' if c in text else f'CAST(t.{c} AS DOUBLE)'} AS number, weight "
        f"FROM msu JOIN t ON t.id = msu.id WHERE mask & {1 << i} <> 0"
        for i, c in enumerate(qi)
    )
    listed = ", ".join(f"'{c}'" for c in text)
    return f"""WITH {ctes}, {_codes_cte(qi, text)}, e AS ({rows}),
  g AS (SELECT variable, value, min(number) AS number, sum(weight) AS w FROM e GROUP BY variable, value)
SELECT g.variable, g.value,
  CASE WHEN g.variable IN ({listed}) THEN coalesce(code, -1)::DOUBLE ELSE number END AS code,
  CAST(printf('%.2f', w * 100.0 / (SELECT sum(weight) FROM msu)) AS DOUBLE) + 0.0 AS contribution
FROM g LEFT JOIN codes ON g.variable = codes.variable AND g.value = codes.value"""


def _records_sql(ctes, qi, row_id):
    shares = ", ".join(
        f"round(100.0 * sum(CASE WHEN mask & {1 << i} <> 0 THEN weight ELSE 0 END) / sum(weight), 6) + 0.0 AS pct_{c}"
        for i, c in enumerate(qi)
    )
    return f"WITH {ctes} SELECT id AS {row_id}, {shares} FROM msu GROUP BY id"


def _encoded(qi, text, alias="t"):
    return ", ".join(
        f"coalesce((SELECT code FROM codes WHERE variable = '{c}' AND value = {alias}.{c}), -1)::DOUBLE AS {c}"
        if c in text
        else f"{alias}.{c}::DOUBLE AS {c}"
        for c in qi
    )


QUERIES = {
    "category_codes": Registered(
        lambda spark, sf: category_codes(labelled_documents(spark, sf), DOC_QI),
        f"WITH t AS ({DOC_SQL}), {_codes_cte(DOC_QI, ['lang', 'source'])} SELECT variable, value, code FROM codes",
    ),
    "encode_categories": Registered(
        lambda spark, sf: encode_categories(orders(spark, sf), ORDER_QI, "o_orderkey"),
        f"""WITH t AS ({ORDER_SQL}), {_codes_cte(ORDER_QI, ORDER_QI[:2])}
SELECT o_orderkey, {_encoded(ORDER_QI, ORDER_QI[:2])} FROM t""",
    ),
    "minimal_sample_uniques": Registered(
        lambda spark, sf: minimal_sample_uniques(parts(spark, sf), PART_QI, "p_partkey"),
        f"WITH {PART_MSU} SELECT id AS p_partkey, {_msu_names(PART_QI)} AS msu, CAST(size AS INTEGER) AS size FROM msu",
    ),
    "minimal_sample_uniques_nulls": Registered(
        lambda spark, sf: minimal_sample_uniques(labelled_documents(spark, sf), DOC_QI, "doc_id"),
        f"WITH {DOC_MSU} SELECT id AS doc_id, {_msu_names(DOC_QI)} AS msu, CAST(size AS INTEGER) AS size FROM msu",
    ),
    "suda_missing_values": Registered(
        lambda spark, sf: minimal_sample_uniques(labelled_documents(spark, sf), DOC_QI, "doc_id", missing_nulls=True),
        f"WITH {DOC_MSU_SET} SELECT id AS doc_id, {_msu_names(DOC_QI)} AS msu, CAST(size AS INTEGER) AS size FROM msu",
    ),
    "minimal_sample_uniques_capped": Registered(
        lambda spark, sf: minimal_sample_uniques(parts(spark, sf), PART_QI, "p_partkey", max_size=2),
        f"""WITH {msu_sql(PART_SQL, "p_partkey", PART_QI, 2)}
SELECT id AS p_partkey, {_msu_names(PART_QI)} AS msu, CAST(size AS INTEGER) AS size FROM msu""",
    ),
    "suda_scores": Registered(
        lambda spark, sf: suda_scores(parts(spark, sf), PART_QI, "p_partkey", 0.2),
        _scores_sql(PART_MSU, PART_QI, "p_partkey", 0.2),
    ),
    "suda_scores_capped": Registered(
        lambda spark, sf: suda_scores(orders(spark, sf), ORDER_QI, "o_orderkey", 0.2, max_size=3),
        _scores_sql(msu_sql(ORDER_SQL, "o_orderkey", ORDER_QI, 3), ORDER_QI, "o_orderkey", 0.2),
    ),
    "suda_scores_nulls": Registered(
        lambda spark, sf: suda_scores(labelled_documents(spark, sf), DOC_QI, "doc_id", 0.3),
        _scores_sql(DOC_MSU, DOC_QI, "doc_id", 0.3),
    ),
    "file_level_risk": Registered(
        lambda spark, sf: rounded(file_level_risk(lines(spark, sf), LINE_QI, 0.2), ["theta"]),
        f"""WITH t AS ({LINE_SQL}), {dis_sql(LINE_QI, 0.2)}
SELECT ones, twos, round(theta, 6) + 0.0 AS theta FROM level""",
    ),
    "suda_contributions": Registered(
        lambda spark, sf: two_decimals(attribute_contributions(parts(spark, sf), PART_QI, "p_partkey")),
        _shares_sql(PART_MSU, PART_QI),
    ),
    "suda_contributions_lineitem": Registered(
        lambda spark, sf: two_decimals(attribute_contributions(with_row_id(lines(spark, sf)), LINE_QI, "row_id")),
        _shares_sql(LINE_MSU, LINE_QI),
    ),
    "suda_level_contributions": Registered(
        lambda spark, sf: two_decimals(attribute_level_contributions(parts(spark, sf), PART_QI, "p_partkey")),
        _levels_sql(PART_MSU, PART_QI, PART_QI[:2]),
    ),
    "suda_record_contributions": Registered(
        lambda spark, sf: rounded(
            record_contributions(parts(spark, sf), PART_QI, "p_partkey"), [f"pct_{c}" for c in PART_QI]
        ),
        _records_sql(PART_MSU, PART_QI, "p_partkey"),
    ),
    "suda_record_table": Registered(
        lambda spark, sf: suda_record_table(parts(spark, sf), PART_QI, "p_partkey"),
        f"""WITH {PART_MSU}, {_codes_cte(PART_QI, PART_QI[:2])}, {dis_sql(PART_QI, 0.2)},
  s AS (SELECT t.*, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id)
SELECT id AS p_partkey, {_encoded(PART_QI, PART_QI[:2], "s")}, score, CAST(printf('%.4f',
  score * (SELECT theta * ones FROM level) / (SELECT sum(score) FROM s)) AS DOUBLE) + 0.0 AS dis_score FROM s""",
    ),
    "suda_score_outliers": Registered(
        lambda spark, sf: rounded(
            mad_outliers(suda_scores(labelled_documents(spark, sf), DOC_QI, "doc_id"), "score", "doc_id", 0.5),
            ["value", "z_score"], 4,
        ),
        f"""WITH {DOC_MSU}, s AS (SELECT t.id, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id),
  {mad_sql("SELECT * FROM s", "score", "id")}
SELECT id AS doc_id, round(x, 4) + 0.0 AS value, round(z, 4) + 0.0 AS z_score FROM scored_x WHERE z > 0.5""",
    ),
    "dis_score_outliers_two_sided": Registered(
        lambda spark, sf: rounded(
            mad_outliers(
                suda_scores(labelled_documents(spark, sf), DOC_QI, "doc_id"), "dis_score", "doc_id", 0.5, two_sided=True
            ),
            ["value", "z_score"], 4,
        ),
        f"""WITH {DOC_MSU}, {dis_sql(DOC_QI, 0.2)},
  s AS (SELECT t.id, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id),
  d AS (SELECT id, CAST(printf('%.4f', score * (SELECT theta * ones FROM level) / (SELECT sum(score) FROM s)) AS DOUBLE) AS dis
    FROM s),
  {mad_sql("SELECT * FROM d", "dis", "id")}
SELECT id AS doc_id, round(x, 4) + 0.0 AS value, round(z, 4) + 0.0 AS z_score FROM scored_x WHERE abs(z) > 0.5""",
    ),
}
