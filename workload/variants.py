"""Weights, sentinels, missing numbers, dates, many columns, large recodings, approximate percentiles."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quasirisk import (
    AddNoise,
    RemoveDecimals,
    RoundUp,
    apply_recipe,
    cell_information_gain,
    collapse_table,
    encode_categories,
    generalisation_levels,
    information_gain,
    mad_outliers,
    minimal_sample_uniques,
    personal_information_factor,
    profile,
    recode,
    suda_record_table,
    suda_scores,
)
from workload.common import (
    ORDER_QI,
    ORDER_SQL,
    PART_QI,
    PART_SQL,
    Registered,
    dis_sql,
    gains_sql,
    msu_sql,
    orders,
    parts,
    rounded,
    same_tuple,
    table,
)
from workload.special_uniques import _codes_cte, _encoded, _msu_names, _scores_sql
from workload.wide import PART_COLUMNS, WIDE_PARTS, WIDE_QI, wide_parts

FIRST_DAY = datetime.date(1995, 3, 1)
DATE_QI = ["o_orderstatus", "o_orderpriority", "day"]
DATE_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority, date_trunc('month', o_orderdate)::DATE AS day FROM orders"
SENTINEL_SQL = "SELECT p_partkey, p_brand, p_type, CASE WHEN p_size % 5 = 0 THEN -999 ELSE p_size END AS p_size FROM part"
# One part in seven has no size (as NaN); sizes carry a fraction.
NAN_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size + 0.25 END AS size FROM part"
WIDE_LINES = {f"by_{n}": f"l_partkey % {n}" for n in range(2, 52)} | {f"of_{n}": f"(l_orderkey + l_suppkey) % {n}" for n in range(2, 52)}


def dated(spark, sf_dir):
    day = F.trunc("o_orderdate", "month").alias("day")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", day)


def sentinels(spark, sf_dir):
    size = F.when(F.col("p_size") % 5 == 0, F.lit(-999)).otherwise(F.col("p_size"))
    return parts(spark, sf_dir).withColumn("p_size", size)


def sizes(spark, sf_dir):
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") + 0.25).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"))


def _collapsed(spark, sf_dir):
    """One row per combination with the number of parts, the smallest part as its id."""
    return collapse_table(parts(spark, sf_dir), PART_QI, "p_partkey")


def _on_firsts(sql):
    """Results of the rows that stand for a combination."""
    return f"SELECT * FROM ({sql}) WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_type, p_size)"


def _record_sql():
    return f"""WITH {msu_sql(PART_SQL, "p_partkey", PART_QI)}, {_codes_cte(PART_QI, PART_QI[:2])}, {dis_sql(PART_QI, 0.2)},
  s AS (SELECT t.*, coalesce(score, 0.0) AS score FROM t LEFT JOIN scored ON t.id = scored.id)
SELECT id AS p_partkey, {_encoded(PART_QI, PART_QI[:2], "s")}, score, CAST(printf('%.4f',
  score * (SELECT theta * ones FROM level) / (SELECT sum(score) FROM s)) AS DOUBLE) + 0.0 AS dis_score FROM s"""


def _missing_sql(source, row_id, qi, mark):
    """Special uniques of a table whose sentinel was read as NULL; NULLs take part in none."""
    blank = ", ".join(f"nullif({c}, {mark}) AS {c}" if c == qi[-1] else c for c in (row_id, *qi))
    ctes = msu_sql(f"SELECT {blank} FROM ({source})", row_id, qi, missing_nulls=True)
    return f"WITH {ctes} SELECT id AS {row_id}, {_msu_names(qi)} AS msu, CAST(size AS INTEGER) AS size FROM msu"


def _independent(spark, sf_dir):
    """Correlation of the noise of two columns and of two steps: within six standard errors of none."""
    events = table(spark, sf_dir, "events").select("event_id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    steps = [AddNoise("a", "gaussian", 7, "event_id"), AddNoise("b", "gaussian", 7, "event_id")]
    both = apply_recipe(events, steps).withColumn("first", F.col("a"))
    twice = apply_recipe(both, [RoundUp("b", 6), AddNoise("a", "gaussian", 7, "event_id")])
    second = twice.withColumn("again", F.col("a") - F.col("first"))
    first = apply_recipe(events, steps).select("event_id", F.col("b").alias("other"))
    facts = second.join(first, "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.corr("first", "other").alias("columns"), F.corr("first", "again").alias("steps")
    )
    small = lambda c: F.abs(c) < 6.0 / F.sqrt("n")
    return facts.select("n", small("columns").alias("columns_independent"), small("steps").alias("steps_independent"))


def _content_noise(spark, sf_dir):
    """Noise without a row id: the same after repartitioning, and of its own distribution.

    P(|noise| < quarter of a standard deviation) is 0.2978 for Laplace and 0.1974 for Normal.
    """
    events = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("double").alias("value"))
    found = []
    for kind, share in (("laplacian", 0.2978), ("gaussian", 0.1974)):
        scale = 2.0**0.5 if kind == "laplacian" else 1.0
        runs = [
            apply_recipe(df.withColumn("before", F.col("value")), [AddNoise("value", kind, 11)])
            for df in (events, events.repartition(13))
        ]
        digest = lambda df: df.agg(F.bit_xor(F.xxhash64("event_type", "before", "value")).alias("d"))
        near = (F.abs(F.col("value") - F.col("before")) < scale / 4).cast("double")
        facts = runs[0].agg(
            F.count(F.lit(1)).alias("n"), F.avg(near).alias("share"), F.count_distinct("event_type", "before", "value").alias("distinct"),
            F.bit_xor(F.xxhash64("event_type", "before", "value")).alias("d"),
        )
        fits = F.abs(F.col("share") - share) < 4.5 * (share * (1 - share)) ** 0.5 / F.sqrt("n")
        other = digest(runs[1]).select("d", F.lit(True).alias("same"))
        found.append(
            facts.join(other, "d", "left").select(
                F.lit(kind).alias("kind"), "n", F.coalesce("same", F.lit(False)).alias("same_when_repartitioned"),
                fits.alias("distribution_fits"), (F.col("distinct") > 0.99 * F.col("n")).alias("copies_differ"),
            )
        )
    return found[0].unionByName(found[1])


def _customers_by_nation(spark, sf_dir):
    """Every customer number among the orders replaced by the customer's nation."""
    nations = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("value"), F.concat(F.lit("nation "), "c_nationkey").alias("replacement")
    )
    listed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return recode(listed, "customer", nations.where("value % 3 <> 0"))


def _brand_levels(spark, sf_dir):
    """Brands into makers (by last digit), makers into groups, and one group renamed."""
    part = table(spark, sf_dir, "part")
    maker = F.concat(F.lit("maker "), F.right("p_brand", F.lit(1)))
    first = part.select(F.lit(1).alias("step"), F.col("p_brand").alias("value"), maker.alias("replacement")).distinct()
    group = F.when(F.right("value", F.lit(1)) < "5", "low").otherwise("high")
    second = first.select(F.lit(2).alias("step"), F.col("replacement").alias("value")).distinct()
    second = second.where("value <> 'maker 0'").select("step", "value", group.alias("replacement"))
    third = second.select(F.lit(3).alias("step"), F.col("replacement").alias("value"), F.lit("all").alias("replacement"))
    return generalisation_levels(part, "p_brand", first.unionByName(second).unionByName(third.where("value = 'low'").distinct()))


LEVELS_SQL = """WITH RECURSIVE
  one AS (SELECT DISTINCT 1 AS step, p_brand AS value, 'maker ' || right(p_brand, 1) AS replacement FROM part),
  two AS (SELECT DISTINCT 2 AS step, replacement AS value, CASE WHEN right(replacement, 1) < '5' THEN 'low' ELSE 'high' END AS replacement
    FROM one WHERE replacement <> 'maker 0'),
  three AS (SELECT DISTINCT 3 AS step, replacement AS value, 'all' AS replacement FROM two WHERE replacement = 'low'),
  taken AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
  names AS (SELECT value AS name FROM one UNION SELECT replacement FROM taken),
  edges AS (SELECT step, coalesce(replacement, 'p_brand') AS parent, name AS child FROM names LEFT JOIN taken ON value = name),
  tree AS (SELECT step, parent, child, CAST(1 AS BIGINT) AS depth FROM edges WHERE step IS NULL
    UNION ALL SELECT e.step, e.parent, e.child, t.depth + 1 FROM edges e JOIN tree t ON e.parent = t.child AND e.step IS NOT NULL)
SELECT step, parent, child, depth FROM tree"""


def _histogram_sql(values, fraction):
    """Bounds of the approximate percentile: the buckets of both neighbouring ranks, from rows (x)."""
    return f"""b AS (SELECT x, CASE WHEN x = 0 THEN 0 ELSE sign(x) * ((floor(log2(abs(x))) + 2000) * 64
      + floor(abs(x) / pow(2, floor(log2(abs(x)))) * 64)) END AS bucket FROM ({values})),
  h AS (SELECT bucket, count(*) AS n, min(x) AS lo, max(x) AS hi FROM b GROUP BY bucket),
  c AS (SELECT *, sum(n) OVER (ORDER BY bucket) - n AS below, sum(n) OVER () AS total FROM h),
  f AS (SELECT * FROM c WHERE below <= floor({fraction} * (total - 1)) AND floor({fraction} * (total - 1)) < below + n),
  l AS (SELECT * FROM c WHERE below <= ceil({fraction} * (total - 1)) AND ceil({fraction} * (total - 1)) < below + n),
  found AS (SELECT f.lo + (f.hi - f.lo) / 2 + ((l.lo + l.hi) / 2 - (f.lo + f.hi) / 2)
      * ({fraction} * (f.total - 1) - floor({fraction} * (f.total - 1))) AS value, f.lo AS low, l.hi AS high,
    CASE WHEN f.lo = l.hi THEN 0.0 ELSE (l.below + l.n - f.below) / f.total END AS rank_error FROM f, l)"""


def _pif_approx(spark, sf_dir):
    """On gains to three decimals: the last bits of a sum depend on its order."""
    gains = information_gain(orders(spark, sf_dir), ORDER_QI)
    steps = gains.withColumn("RIG", F.round(F.col("RIG") * 1000) / 1000)
    found = personal_information_factor(steps, 95, approximate=True)
    return rounded(found, ["pif", "low", "high", "rank_error"])


def _mad_approx(spark, sf_dir):
    found = mad_outliers(orders(spark, sf_dir), "o_totalprice", "o_orderkey", 1.0, approximate=True)
    return rounded(found, ["value", "z_score"], 4)


def _expressions(columns):
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _profile_wide(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in WIDE_LINES.items()]))


def _profile_sql(columns):
    counts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM t" for c in columns)
    return f"""WITH t AS (SELECT {_expressions(columns)} FROM lineitem), counts AS ({counts})
SELECT *, CASE WHEN n_distinct > 45 THEN 'Continuous' ELSE 'Categorical' END AS kind FROM counts"""


GAIN_QI = [c for c in PART_COLUMNS if c not in ("key_7", "key_11")]

QUERIES = {
    "suda_scores_weighted": Registered(
        lambda spark, sf: suda_scores(_collapsed(spark, sf), PART_QI, "p_partkey", 0.2, weight="group_rows"),
        _on_firsts(_scores_sql(msu_sql(PART_SQL, "p_partkey", PART_QI), PART_QI, "p_partkey", 0.2)),
    ),
    "suda_record_table_weighted": Registered(
        lambda spark, sf: suda_record_table(_collapsed(spark, sf), PART_QI, "p_partkey", weight="group_rows"),
        _on_firsts(_record_sql()),
    ),
    "suda_sentinel": Registered(
        lambda spark, sf: minimal_sample_uniques(sentinels(spark, sf), PART_QI, "p_partkey", missing_value=-999),
        _missing_sql(SENTINEL_SQL, "p_partkey", PART_QI, "-999"),
    ),
    "suda_sentinel_date": Registered(
        lambda spark, sf: minimal_sample_uniques(
            dated(spark, sf), DATE_QI, "o_orderkey", missing_value=FIRST_DAY
        ),
        _missing_sql(DATE_SQL, "o_orderkey", DATE_QI, f"DATE '{FIRST_DAY}'"),
    ),
    "cig_mask_date": Registered(
        lambda spark, sf: rounded(
            cell_information_gain(dated(spark, sf), DATE_QI, "o_orderkey", mask_values=[FIRST_DAY]),
            [*[f"cig_{c}" for c in DATE_QI], "RIG"],
        ),
        f"""WITH {gains_sql(DATE_SQL, DATE_QI, ["day"], "{c} = DATE '" + str(FIRST_DAY) + "'")}
SELECT t.o_orderkey, {", ".join(f'round(gains."{c}", 6) + 0.0 AS "{c}"' for c in [*[f"cig_{c}" for c in DATE_QI], "RIG"])}
FROM t JOIN gains ON {same_tuple(DATE_QI)}""",
    ),
    "information_gain_wide": Registered(
        lambda spark, sf: rounded(
            information_gain(wide_parts(spark, sf), GAIN_QI).select(*GAIN_QI, "group_rows", *[f"cig_{c}" for c in GAIN_QI], "RIG"),
            [*[f"cig_{c}" for c in GAIN_QI], "RIG"],
        ),
        f"""WITH {gains_sql(WIDE_PARTS, GAIN_QI)}
SELECT {", ".join(GAIN_QI)}, CAST(n AS BIGINT) AS group_rows,
  {", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in [*[f"cig_{c}" for c in GAIN_QI], "RIG"])} FROM gains""",
    ),
    "encode_categories_wide": Registered(
        lambda spark, sf: encode_categories(wide_parts(spark, sf), WIDE_QI, "p_partkey"),
        f"""WITH t AS ({WIDE_PARTS}), {_codes_cte(WIDE_QI, ["p_brand", "p_type", "color"])}
SELECT p_partkey, {_encoded(WIDE_QI, ["p_brand", "p_type", "color"])} FROM t""",
    ),
    "round_up_nan": Registered(
        lambda spark, sf: apply_recipe(sizes(spark, sf), [RoundUp("size", 1)]),
        f"SELECT p_partkey, CAST(ceil(size / 10.0) * 10 AS BIGINT) AS size FROM ({NAN_SQL})",
    ),
    "remove_decimals_nan": Registered(
        lambda spark, sf: apply_recipe(sizes(spark, sf), [RemoveDecimals("size")]),
        f"SELECT p_partkey, CAST(trunc(size) AS BIGINT) AS size FROM ({NAN_SQL})",
    ),
    "noise_independent": Registered(
        _independent, "SELECT count(*) AS n, true AS columns_independent, true AS steps_independent FROM events"
    ),
    "noise_content_keyed": Registered(
        _content_noise,
        """SELECT kind, (SELECT count(*) FROM events) AS n, true AS same_when_repartitioned, true AS distribution_fits,
  true AS copies_differ FROM (VALUES ('laplacian'), ('gaussian')) v(kind)""",
    ),
    "combine_values_large": Registered(
        _customers_by_nation,
        """SELECT o_orderkey, CASE WHEN c_custkey % 3 <> 0 THEN 'nation ' || c_nationkey ELSE CAST(o_custkey AS VARCHAR) END AS customer
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    ),
    "generalisation_tree_levels": Registered(_brand_levels, LEVELS_SQL),
    "pif_approx": Registered(
        _pif_approx,
        f"""WITH {gains_sql(ORDER_SQL, ORDER_QI)}, {_histogram_sql(
            f'SELECT round(gains."RIG" * 1000) / 1000 AS x FROM t JOIN gains ON {same_tuple(ORDER_QI)}', 0.95)}
SELECT CAST(95 AS INTEGER) AS percentile, round(value, 6) + 0.0 AS pif,
  CAST(CASE WHEN value >= 1 THEN 1 WHEN value >= 0.33 THEN 2 WHEN value >= 0.11 THEN 3 WHEN value >= 0.04 THEN 4 ELSE 5 END
    AS INTEGER) AS safe_level, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(rank_error, 6) + 0.0 AS rank_error
FROM found""",
    ),
    "mad_approx": Registered(
        _mad_approx,
        f"""WITH median AS (WITH {_histogram_sql("SELECT o_totalprice AS x FROM orders", 0.5)} SELECT value FROM found),
  spread AS (WITH {_histogram_sql("SELECT abs(o_totalprice - (SELECT value FROM median)) AS x FROM orders", 0.5)} SELECT value FROM found),
  z AS (SELECT o_orderkey, o_totalprice, (o_totalprice - m.value) / (s.value / 0.6745) AS z FROM orders, median m, spread s)
SELECT o_orderkey, round(o_totalprice, 4) + 0.0 AS value, round(z, 4) + 0.0 AS z_score FROM z WHERE z > 1.0""",
    ),
    "profile_wide": Registered(_profile_wide, _profile_sql(WIDE_LINES)),
}
