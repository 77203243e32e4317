"""Noise, rounding, recoding, suppression and before/after comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasirisk import (
    AddNoise,
    CombineSelected,
    DropColumn,
    RemoveDecimals,
    RoundNearest,
    RoundUp,
    apply_recipe,
    cell_information_gain,
    combine_values,
    compare_versions,
    generalisation_tree,
    information_gain,
    mad_outliers,
    personal_information_factor,
    revert,
    risk_summary,
    suppress_above,
    suppress_rows,
)
from workload.common import (
    ORDER_SQL,
    PART_QI,
    PART_SQL,
    Registered,
    gains_sql,
    mad_sql,
    orders,
    parts,
    rounded,
    same_tuple,
    table,
)

SEGMENTS = [
    (["BUILDING", "MACHINERY"], "INDUSTRY"),
    (["HOUSEHOLD", "FURNITURE"], "HOME"),
]
SEGMENT_CASE = """CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INDUSTRY'
  WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME' ELSE c_mktsegment END"""
RECIPE = [
    RoundUp("p_size", 1),
    CombineSelected("p_type", ("ECONOMY", "STANDARD"), "BASIC"),
    RoundNearest("p_retailprice", 2),
]
MITIGATED_SQL = """SELECT p_partkey, p_brand, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'BASIC' ELSE p_type END AS p_type,
  CAST(ceil(p_size / 10.0) * 10 AS BIGINT) AS p_size, round_even(p_retailprice / 100, 0) * 100 AS p_retailprice FROM part"""


def _noise_check(spark, sf_dir, kind, variance):
    """Facts about the noise that hold for any correct sample: within six standard errors."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    noisy = apply_recipe(events.withColumn("before", F.col("value")), [AddNoise("value", kind, 7, "event_id")])
    added = noisy.select((F.col("value") - F.col("before")).alias("e"))
    kurtosis = 6.0 if kind == "laplacian" else 3.0
    moments = added.agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.var_pop("e").alias("variance"),
        F.min(F.col("e") != 0).alias("all_changed"),
    )
    root = F.sqrt(F.col("n"))
    return moments.select(
        "n",
        (F.abs("mean") < 6.0 * variance**0.5 / root).alias("mean_ok"),
        (F.abs(F.col("variance") - variance) < 6.0 * variance * (kurtosis - 1.0) ** 0.5 / root).alias("variance_ok"),
        "all_changed",
    )


NOISE_SQL = "SELECT count(*) AS n, true AS mean_ok, true AS variance_ok, true AS all_changed FROM events"


def _recoded_segments(spark, sf_dir):
    df, history = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), {}
    for values, replacement in SEGMENTS:
        df, history = combine_values(df, history, "c_mktsegment", values, replacement)
    return df, history


def _tree_sql(hide):
    made = " UNION ALL ".join(
        [f"SELECT 'c_mktsegment', '{r}'" for _, r in SEGMENTS]
        + [f"SELECT '{r}', '{v}'" for vs, r in SEGMENTS for v in vs]
    )
    combined = ", ".join(f"'{v}'" for vs, _ in SEGMENTS for v in vs)
    shown = f" WHERE child NOT IN ({combined})" if hide else ""
    source = "c_mktsegment" if hide else SEGMENT_CASE
    return f"""SELECT DISTINCT parent, child FROM (
  SELECT * FROM (SELECT 'c_mktsegment' AS parent, {source} AS child FROM customer){shown} UNION ALL {made})"""


def _compared(spark, sf_dir):
    before = parts(spark, sf_dir)
    return compare_versions(
        {"original": before, "mitigated": apply_recipe(before, RECIPE)},
        lambda df: risk_summary(df, PART_QI).select("total_rows", "num_unique_rows", "k_anonymity"),
    )


def _compared_pif(spark, sf_dir):
    before = parts(spark, sf_dir)
    both = compare_versions(
        {"original": before, "mitigated": apply_recipe(before, RECIPE)},
        lambda df: personal_information_factor(information_gain(df, PART_QI), 95),
    )
    return rounded(both.select("version", "pif"), ["pif"])


def _version_sql(version, source):
    names = ", ".join(PART_QI)
    return f"""SELECT '{version}' AS version, CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (n = 1) AS num_unique_rows,
  min(n) AS k_anonymity FROM (SELECT count(*) AS n FROM ({source}) GROUP BY {names})"""


def _pif_sql(version, source):
    return f"""SELECT '{version}' AS version, pif FROM (WITH {gains_sql(source, PART_QI)}
  SELECT round(quantile_cont(gains."RIG", 0.95), 6) + 0.0 AS pif FROM t JOIN gains ON {same_tuple(PART_QI)})"""


QUERIES = {
    "noise_laplacian": Registered(lambda spark, sf: _noise_check(spark, sf, "laplacian", 2.0), NOISE_SQL),
    "noise_gaussian": Registered(lambda spark, sf: _noise_check(spark, sf, "gaussian", 1.0), NOISE_SQL),
    "round_up": Registered(
        lambda spark, sf: apply_recipe(
            orders(spark, sf).select("o_orderkey", "o_totalprice"), [RoundUp("o_totalprice", 3)]
        ),
        "SELECT o_orderkey, CAST(ceil(o_totalprice / 1000) AS BIGINT) * 1000 AS o_totalprice FROM orders",
    ),
    "round_nearest": Registered(
        lambda spark, sf: apply_recipe(
            parts(spark, sf).select("p_partkey", "p_size", "p_retailprice"),
            [RoundNearest("p_retailprice", 2), RoundNearest("p_size", 1)],
        ),
        """SELECT p_partkey, round_even(p_size / 10.0, 0)::DOUBLE * 10 AS p_size,
  round_even(p_retailprice / 100, 0) * 100 AS p_retailprice FROM part""",
    ),
    "remove_decimals": Registered(
        lambda spark, sf: apply_recipe(
            orders(spark, sf).select("o_orderkey", "o_totalprice"), [RemoveDecimals("o_totalprice")]
        ),
        "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders",
    ),
    "combine_values": Registered(
        lambda spark, sf: _recoded_segments(spark, sf)[0],
        f"SELECT c_custkey, {SEGMENT_CASE} AS c_mktsegment FROM customer",
    ),
    "combine_selected": Registered(
        lambda spark, sf: apply_recipe(
            parts(spark, sf).select("p_partkey", "p_size"), [CombineSelected("p_size", ("1", "2", "3"), "small")]
        ),
        """SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'small' ELSE CAST(p_size AS VARCHAR) END AS p_size
FROM part""",
    ),
    "revert": Registered(
        lambda spark, sf: apply_recipe(parts(spark, sf), revert(RECIPE, "p_type")),
        """SELECT p_partkey, p_brand, p_type, CAST(ceil(p_size / 10.0) * 10 AS BIGINT) AS p_size,
  round_even(p_retailprice / 100, 0) * 100 AS p_retailprice FROM part""",
    ),
    "drop_column": Registered(
        lambda spark, sf: apply_recipe(parts(spark, sf), [DropColumn("p_retailprice"), *RECIPE[:2]]),
        f"SELECT p_partkey, p_brand, p_type, p_size FROM ({MITIGATED_SQL})",
    ),
    "generalisation_tree": Registered(
        lambda spark, sf: generalisation_tree(
            _recoded_segments(spark, sf)[0], "c_mktsegment", _recoded_segments(spark, sf)[1]
        ),
        _tree_sql(False),
    ),
    "generalisation_tree_hidden": Registered(
        lambda spark, sf: generalisation_tree(
            table(spark, sf, "customer"), "c_mktsegment", _recoded_segments(spark, sf)[1], hide_combined=True
        ),
        _tree_sql(True),
    ),
    "suppress_above": Registered(
        lambda spark, sf: suppress_above(
            rounded(cell_information_gain(parts(spark, sf), PART_QI, "p_partkey"), ["RIG"]), "RIG", 9.0
        ).select("p_partkey", "RIG"),
        f"""WITH {gains_sql(PART_SQL, PART_QI)}
SELECT * FROM (SELECT t.p_partkey, round(gains."RIG", 6) + 0.0 AS "RIG" FROM t JOIN gains ON {same_tuple(PART_QI)})
WHERE "RIG" <= 9.0""",
    ),
    "suppress_rows": Registered(
        lambda spark, sf: suppress_rows(
            orders(spark, sf).select("o_orderkey", "o_totalprice"),
            mad_outliers(orders(spark, sf), "o_totalprice", "o_orderkey", 1.0),
            "o_orderkey",
        ),
        f"""WITH {mad_sql(ORDER_SQL, "o_totalprice", "o_orderkey")}
SELECT id AS o_orderkey, x AS o_totalprice FROM scored_x WHERE z <= 1.0""",
    ),
    "compare_versions": Registered(
        _compared, f"{_version_sql('original', PART_SQL)} UNION ALL {_version_sql('mitigated', MITIGATED_SQL)}"
    ),
    "compare_pif": Registered(
        _compared_pif, f"{_pif_sql('original', PART_SQL)} UNION ALL {_pif_sql('mitigated', MITIGATED_SQL)}"
    ),
}
