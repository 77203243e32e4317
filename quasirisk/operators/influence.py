"""What single columns and column combinations contribute to uniqueness."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quasirisk.functions.rounding import python_round
from quasirisk.operators.search import DENSE_COLUMNS, uniques_by_set
from quasirisk.plans.keys import collapse, key_names, require_columns, require_mask_width
from quasirisk.plans.lattice import subset_masks, subset_statistics
from quasirisk.plans.materialize import materialize

# Up to this many subsets are counted one by one; beyond, from the minimal sets of the records.
LATTICE_SUBSETS = 255


def column_influence(df: DataFrame, qi: Sequence[str], weight: str | None = None) -> DataFrame:
    """Uniques lost when one column is left out, also per distinct value of that column.

    Columns: column, unique_count_after_removal, difference, distinct_values, ratio,
    normalized_difference (ratio to one decimal).  NULL is a value.  No rows for a single
    QI.  The full set, the leave-one-out sets and the single columns are counted together,
    told apart by a number ``s``, so any number of columns will do: 0 is the full set,
    1..m leave out one column each, m+1..2m are the single columns.
    """
    qi = require_columns(df, qi)
    m = len(qi)
    base = collapse(df, qi, weight=weight).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2 * m))))
    kept = [f"IF(s = 0 OR s = {m + 1 + i} OR (s <= {m} AND s <> {1 + i}), {k}, NULL) AS {k}" for i, k in enumerate(key_names(m))]
    cells = base.selectExpr("s", *kept, "n").groupBy("s", *key_names(m)).agg(F.sum("n").alias("n"))
    filled = F.expr(" OR ".join(f"{k} IS NOT NULL" for k in key_names(m)))
    stats = cells.groupBy("s").agg(F.count_if(F.col("n") == 1).alias("uniques"), F.count_if(filled).alias("values"))
    # 2m + 1 rows: per column its leave-one-out row and its own row, and the full set.
    number = F.when(F.col("s") > m, F.col("s") - m).otherwise(F.col("s"))
    pairs = stats.withColumn("number", number).groupBy("number").agg(
        F.max(F.when(F.col("s") <= m, F.col("uniques"))).alias("rest"), F.max(F.when(F.col("s") > m, F.col("values"))).alias("own")
    )
    all_of = F.map_from_entries(F.collect_list(F.struct("number", F.struct("rest", "own"))))
    names = F.array(*[F.lit(c) for c in qi])
    zero = F.lit(0).cast("long")
    found = pairs.agg(all_of.alias("stats")).select("stats", F.posexplode(names).alias("position", "column"))
    mine = F.try_element_at("stats", F.col("position") + 1)
    out = found.where(F.lit(m > 1)).select(
        "column",
        F.coalesce(mine["rest"], zero).alias("unique_count_after_removal"),
        (F.coalesce(F.try_element_at("stats", F.lit(0))["rest"], zero) - F.coalesce(mine["rest"], zero)).alias("difference"),
        F.coalesce(mine["own"], zero).alias("distinct_values"),
    )
    ratio = F.try_divide(F.col("difference").cast("double"), F.col("distinct_values").cast("double"))
    return out.withColumn("ratio", ratio).withColumn("normalized_difference", python_round(F.col("ratio"), 1))


def subset_table(spark: SparkSession, qi: Sequence[str], min_size: int, max_size: int) -> DataFrame:
    """combination, size, mask, rest of all subsets of the given sizes, made in parallel.

    Sets grow by one later column at a time, so nothing but wanted sets and their beginnings
    is made, and the driver lists none.
    """
    m, full = len(qi), (1 << len(qi)) - 1
    bits = [1 << i for i in range(m)]
    grown = spark.range(1).select(F.lit(0).cast("long").alias("mask"))
    kept = None
    for size in range(1, min(max_size, m) + 1):
        later = F.filter(F.array(*[F.lit(b).cast("long") for b in bits]), lambda b: b > F.col("mask"))
        grown = grown.withColumn("bit", F.explode(later)).select((F.col("mask") + F.col("bit")).alias("mask"))
        if size >= min_size:
            level = grown.withColumn("size", F.lit(size))
            kept = level if kept is None else kept.union(level)
    names = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(c)) for b, c in zip(bits, qi)])
    return kept.select(F.array_join(F.filter(names, lambda c: c.isNotNull()), ", ").alias("combination"), "size", "mask", (F.lit(full).cast("long") - F.col("mask")).alias("rest"))


def combination_contribution(
    df: DataFrame, qi: Sequence[str], min_size: int = 3, max_size: int = 7, weight: str | None = None
) -> DataFrame:
    """Uniques of every column subset and of its complement.

    Columns: combination, size, unique_rows, unique_rows_excluding, score =
    (uniques on all columns - unique_rows_excluding) / unique_rows; NULL where
    unique_rows is 0.  Rows with a NULL inside a subset do not count for that subset.
    """
    qi = require_columns(df, qi)
    m = require_mask_width(qi)
    if min_size < 1 or max_size < min_size:
        raise ValueError("Sizes must satisfy 1 <= min_size <= max_size.")
    if min_size > m:
        raise ValueError("min_size exceeds the number of columns.")
    full = (1 << m) - 1
    count = sum(math.comb(m, size) for size in range(min_size, min(max_size, m) + 1))
    base = collapse(df, qi, weight=weight)
    # One row per subset, whatever the size of the data; a subset without uniques may have none.
    if count > LATTICE_SUBSETS and m <= DENSE_COLUMNS:
        stats = materialize(uniques_by_set(base, m, drop_nulls=True))
    else:
        wanted = subset_masks(m, min_size, max_size)
        masks = sorted(({full} | set(wanted) | {full ^ s for s in wanted}) - {0})
        stats = materialize(subset_statistics(base, m, masks, drop_nulls=True))
    subsets = subset_table(df.sparkSession, qi, min_size, max_size)
    uniques = lambda name: stats.select(F.col("mask").alias(name), F.col("uniques").alias(f"of_{name}"))
    zero = F.lit(0).cast("long")
    out = subsets.join(uniques("mask"), "mask", "left").join(uniques("rest"), "rest", "left").select(
        "combination", "size", F.coalesce("of_mask", zero).alias("unique_rows"), F.coalesce("of_rest", zero).alias("unique_rows_excluding")
    )
    everything = F.coalesce(stats.where(F.col("mask") == full).agg(F.max("uniques")).scalar(), zero)
    gain = (everything - F.col("unique_rows_excluding")).cast("double")
    return out.withColumn("score", F.try_divide(gain, F.col("unique_rows").cast("double")))
