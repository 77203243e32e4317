"""Robust outliers: distance from the median in units of the scaled MAD."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasirisk.plans.keys import clean, col, require_columns
from quasirisk.plans.quantile import approximate_ranks, select_ranks, value_counts, weighted_values

# Consistency constant of the MAD, default threshold, fewest values tested.
MAD_SCALE = 0.6745
DEFAULT_K = 2.2414
MIN_VALUES = 5


@dataclass(frozen=True)
class Scale:
    """Figures of the values that are tested: all of them, or the non-zero ones."""

    nonzero: bool
    rows: int
    q1: float
    median: float
    q3: float
    mad: float


def _exact(values: DataFrame, fractions: list[float]) -> tuple[int, list[float]]:
    return select_ranks(values, fractions).get((), (0, []))


def _approximate(values: DataFrame, fractions: list[float]) -> tuple[int, list[float]]:
    rows, found = approximate_ranks(values, fractions)
    return rows, [a.value for a in found]


def _figures(values: DataFrame, nonzero: bool, select: Callable) -> Scale | None:
    """Quartiles and MAD of rows (x, n); two selections, without shuffling values."""
    values = values.where("x <> 0") if nonzero else values
    rows, points = select(values, [0.25, 0.5, 0.75])
    if rows < MIN_VALUES:
        return None
    q1, median, q3 = points
    # An infinite value is infinitely far from an infinite median only if they differ.
    distance = F.when(F.col("x") == median, F.lit(0.0)).otherwise(F.abs(F.col("x") - median))
    return Scale(nonzero, rows, q1, median, q3, select(values.select(distance.alias("x"), "n"), [0.5])[1][0])


def _robust_scale(values: DataFrame, zero_fallback: bool, select: Callable = _exact) -> Scale | None:
    """The scale to test with; the non-zero values are looked at only if the MAD is zero."""
    scale = _figures(values, False, select)
    if scale is None or scale.mad > 0 or not zero_fallback:
        return scale
    scale = _figures(values, True, select)
    return scale if scale is not None and scale.mad > 0 else None


def _z(value: Column, scale: Scale) -> Column:
    """Robust z-score.  A zero MAD puts every other value infinitely far away."""
    away = value - F.lit(scale.median)
    if scale.mad == 0:
        return F.when(away != 0, F.signum(away) * F.lit(float("inf")))
    return away / F.lit(scale.mad / MAD_SCALE)


def _tested(value: Column, scale: Scale) -> Column:
    return value.isNotNull() & (value != 0 if scale.nonzero else F.lit(True))


def mad_outliers(
    df: DataFrame,
    column: str,
    row_id: str,
    k: float = DEFAULT_K,
    two_sided: bool = False,
    zero_fallback: bool = True,
    approximate: bool = False,
) -> DataFrame:
    """Outlying rows: row_id, value, z_score with z > k (or |z| > k when two_sided).

    Fewer than five values: no rows.  When the MAD is zero, zero_fallback repeats the
    test on the non-zero values alone (nothing if that is not possible either); without
    it every value other than the median is infinitely far out.  ``approximate`` takes
    median and MAD from one histogram each, over the rows as they are: the median is off by
    at most 1/128 of itself, the MAD by 1/128 of itself and the error of the median.
    """
    require_columns(df, [column])
    require_columns(df, [row_id])
    if approximate:
        scale = _robust_scale(weighted_values(df, column), zero_fallback, _approximate)
    else:
        scale = _robust_scale(value_counts(df, column).table, zero_fallback)
    values = df.select(col(row_id), clean(df, column).cast("double").alias("value"))
    if scale is None:
        return values.where(F.lit(False)).withColumn("z_score", F.lit(None).cast("double"))
    z = _z(F.col("value"), scale)
    out = values.where(_tested(F.col("value"), scale)).select(col(row_id), "value", z.alias("z_score"))
    distance = F.abs("z_score") if two_sided else F.col("z_score")
    return out.where(distance > k)


def boxplot_statistics(
    df: DataFrame, column: str, k: float = DEFAULT_K, zero_fallback: bool = True
) -> DataFrame:
    """Box-plot numbers of the z-scores in one row.

    q1, median, q3; whiskers at the last value within 1.5 box lengths (not inside the
    box), clipped to +-k; n_values; n_fliers beyond the unclipped whiskers.
    """
    require_columns(df, [column])
    counts = value_counts(df, column)
    scale = _robust_scale(counts.table, zero_fallback)
    kept = counts.table.where(F.lit(False)) if scale is None else counts.table.where(_tested(F.col("x"), scale))
    scale = scale or Scale(False, 0, 0.0, 0.0, 0.0, 1.0)
    quarter = lambda q: _z(F.lit(q), scale)
    kept = kept.select(
        "n", _z(F.col("x"), scale).alias("z"), quarter(scale.q1).alias("q1"), quarter(scale.median).alias("median"),
        quarter(scale.q3).alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low_in, high_in = F.col("z") >= F.col("q1") - reach, F.col("z") <= F.col("q3") + reach
    beyond = F.sum(F.when(low_in & high_in, F.lit(0)).otherwise(F.col("n")))
    stats = kept.groupBy("q1", "median", "q3").agg(
        F.min(F.when(low_in, F.col("z"))).alias("low"),
        F.max(F.when(high_in, F.col("z"))).alias("high"),
        F.sum("n").alias("n_values"),
        beyond.alias("n_fliers"),
    )
    low = F.least(F.coalesce("low", "q1"), "q1")
    high = F.greatest(F.coalesce("high", "q3"), "q3")
    clip = lambda v: F.least(F.greatest(v, F.lit(-float(k))), F.lit(float(k)))
    return stats.select(
        "n_values", "q1", "median", "q3", clip(low).alias("whisker_low"), clip(high).alias("whisker_high"), "n_fliers"
    )
