"""Counting all wanted subsets of the QIs from the collapsed base.

A subset is a long bitmask (bit i = QI i).  Rows are exploded by the subset list,
unselected keys are blanked, and one map-side-combined aggregate keyed by (mask, keys)
counts every subset at once; the mask in the key tells "not selected" from a genuine
NULL.  The plan has the same size for 3 or 300 subsets.

Many subsets are counted in two such steps: first every pattern over the first half of
the QIs with the other half kept, then the patterns over the second half, from the cells
of the first step.  With m QIs and b base rows this sends about 2 * 2**(m/2) * b rows
into the aggregates instead of 2**m * b.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quasirisk.plans.keys import bits_where, key_names


# Up to this many subsets are counted in one step, more in two.
ONE_STEP_SUBSETS = 31


def subset_masks(m: int, min_size: int = 1, max_size: int | None = None) -> list[int]:
    """Bitmasks of all subsets with min_size..max_size members, small first."""
    top = m if max_size is None else min(max_size, m)
    return [
        sum(1 << i for i in members)
        for size in range(min_size, top + 1)
        for members in combinations(range(m), size)
    ]


def subset_name(mask: int, qi: Sequence[str]) -> str:
    return ", ".join(c for i, c in enumerate(qi) if mask >> i & 1)


def mask_array(spark: SparkSession, masks: Sequence[int]) -> Column:
    """The masks as one array<bigint>, from a one-row table rather than in the query's text."""
    return spark.createDataFrame([([int(s) for s in masks],)], "masks array<bigint>").scalar()


def cells(long: DataFrame, m: int, with_id: bool = False) -> DataFrame:
    """Aggregate exploded (mask, k0.., n[, rid]) rows to one row per subset cell."""
    masked = [f"IF(mask & {1 << i}L <> 0, {k}, NULL) AS {k}" for i, k in enumerate(key_names(m))]
    aggs = [F.sum("n").alias("n")]
    if with_id:
        aggs.append(F.min("rid").alias("rid"))
    rest = ["n", "rid"] if with_id else ["n"]
    return long.selectExpr("mask", *masked, *rest).groupBy("mask", *key_names(m)).agg(*aggs)


def subset_cells(
    base: DataFrame, m: int, masks: Sequence[int], unusable: Column | None = None, with_id: bool = False
) -> DataFrame:
    """Cells (mask, k0.., n[, rid]) of all given subsets.

    ``unusable`` is a bitmask computed from k0.. (NULL keys, sentinels); a row takes no
    part in a subset that contains one of its unusable columns.
    """

    def usable(rows: DataFrame, wanted: Column) -> DataFrame:
        return rows if unusable is None else rows.where(wanted.bitwiseAND(unusable) == 0)

    masks = sorted(set(masks))
    spark = base.sparkSession
    if len(masks) <= ONE_STEP_SUBSETS:
        return cells(usable(base.withColumn("mask", F.explode(mask_array(spark, masks))), F.col("mask")), m, with_id)
    first_half = (1 << (m + 1) // 2) - 1
    second_half = ((1 << m) - 1) ^ first_half
    members: dict[int, list[int]] = {}
    for s in masks:
        members.setdefault(s & first_half | second_half, []).append(s)
    steps = base.withColumn("mask", F.explode(mask_array(spark, sorted(members))))
    kept_first = F.col("mask").bitwiseAND(F.lit(first_half).cast("long"))
    halfway = cells(usable(steps, kept_first), m, with_id)
    # Each pattern of the first step with the subsets it leads to; as long as the subset list.
    lists = spark.createDataFrame(sorted(members.items()), "mask long, members array<bigint>")
    final = halfway.join(lists, "mask").withColumn("mask", F.explode("members")).drop("members")
    return cells(usable(final, F.col("mask")), m, with_id)


def subset_statistics(base: DataFrame, m: int, masks: Sequence[int], drop_nulls: bool) -> DataFrame:
    """(mask, uniques), one row per subset that has cells: the number of its cells of size 1."""
    nulls = bits_where([F.col(k).isNull() for k in key_names(m)]) if drop_nulls else None
    return subset_cells(base, m, masks, nulls).groupBy("mask").agg(F.count_if(F.col("n") == 1).alias("uniques"))
