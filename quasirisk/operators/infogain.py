"""Cell and row information gain and the Personal Information Factor.

The gain of a cell is the Kullback-Leibler divergence, in bits, between the values its
column takes among rows agreeing on all other QIs and the values it takes overall.  It
depends on the other QIs only, and

    sum_v p_v log2(p_v / q_v) = (1/n) sum_v n_v log2(n_v / q_v) - log2(n)

turns it into one plain aggregate (sums with map-side combine) instead of a window, so
no group of rows ever has to sit in one task.  All columns are worked on together: the
collapsed base is exploded by column, giving a plan whose size does not depend on the
number of QIs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.functions.levels import safe_level
from quasirisk.functions.rounding import python_round
from quasirisk.operators.risk import WEIGHT
from quasirisk.plans.keys import col, collapse, key_names, keyed, may_equal, require_columns
from quasirisk.plans.lookup import is_small, skew_safe_lookup
from quasirisk.plans.materialize import materialize, materialize_measured
from quasirisk.plans.quantile import approximate_percentiles, exact_percentiles, percentiles_of_counts, value_counts

PREFIX = "cig_"


def gain_columns(gains: DataFrame) -> list[str]:
    """Cell-gain columns of a gain table, in order; the row gain is not one of them."""
    return [c for c in gains.columns if c.startswith(PREFIX)]


def _others(i: int, m: int) -> Column:
    """Key of a base row without column i, equal to ``others`` of ``cells_by_column``."""
    rest = [f"'{k}', IF({j} <> {i}, {k}, NULL)" for j, k in enumerate(key_names(m))]
    return F.expr(f"named_struct('c', {i}, {', '.join(rest)})")


def cells_by_column(base: DataFrame, m: int) -> DataFrame:
    """Explode base rows by column c: ``own`` = (c, its value), ``others`` = (c, the rest)."""
    own = ", ".join(f"'{k}', IF(c = {i}, {k}, NULL)" for i, k in enumerate(key_names(m)))
    rest = ", ".join(f"'{k}', IF(c <> {i}, {k}, NULL)" for i, k in enumerate(key_names(m)))
    return base.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).selectExpr(
        f"named_struct('c', c, {own}) AS own", f"named_struct('c', c, {rest}) AS others", "n"
    )


def regrouped_keys(m: int) -> list[Column]:
    """Undo ``cells_by_column``: exactly one of the two structs holds each key."""
    return [F.coalesce(F.col(f"own.{k}"), F.col(f"others.{k}")).alias(k) for k in key_names(m)]


def _is_masked(dtype: T.DataType, key: Column, mask_nulls: bool, mask_values: Sequence) -> Column:
    hit = key.isNull() if mask_nulls else F.lit(False)
    for v in mask_values:
        if may_equal(dtype, v):
            hit = hit | F.coalesce(key == F.lit(v), F.lit(False))
    return hit


def information_gain(
    df: DataFrame,
    qi: Sequence[str],
    mask_nulls: bool = False,
    mask_values: Sequence = (),
    weight: str | None = None,
) -> DataFrame:
    """Gains of every distinct QI combination: QIs, group_rows, ``cig_<column>``.., ``RIG``.

    A masked cell (NULL with mask_nulls, or equal to one of mask_values) counts as 0; its
    value still takes part in the distributions.  ``group_rows`` is the weight for the
    functions below, which need no row-level table.
    """
    qi = require_columns(df, qi)
    if reserved := {WEIGHT, "RIG"} & set(qi):
        raise ValueError(f"Reserved column names: {sorted(reserved)}")
    gains = _gains(df, materialize(collapse(df, qi, weight=weight)), qi, mask_nulls, mask_values)
    named = [F.col(k).alias(c) for k, c in zip(key_names(len(qi)), qi)]
    return gains.select(*named, F.col("n").alias(WEIGHT), *_titled_gains(qi), "RIG")


def _titled_gains(qi: Sequence[str]) -> list[Column]:
    return [F.col(f"g{i}").alias(PREFIX + c) for i, c in enumerate(qi)]


def _gains(
    df: DataFrame, base: DataFrame, qi: Sequence[str], mask_nulls: bool, mask_values: Sequence
) -> DataFrame:
    """k0.., n, g0.., RIG from the materialised base (read several times below)."""
    m = len(qi)
    keys = key_names(m)
    long = cells_by_column(base, m)
    marginal = long.groupBy("own").agg(F.sum("n").alias("rows_own"), F.count(F.lit(1)).alias("cells_own"))
    totals = base.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"))).scalar()
    with_own = skew_safe_lookup(long, marginal, "own", "cells_own", totals["cells"])
    surprise = F.col("n") * F.log2(F.col("n") / F.col("rows_own"))
    divergence = (
        with_own.groupBy("others")
        .agg(F.sum("n").alias("rows"), F.sum(surprise).alias("bits"), F.count(F.lit(1)).alias("cells_others"))
        .select(
            "others",
            "cells_others",
            (F.col("bits") / F.col("rows") + F.log2(totals["rows"] / F.col("rows"))).alias("gain"),
        )
    )
    known = materialize_measured(divergence)
    if is_small(known):
        # One broadcast, shared by a join per column; the base is not shuffled.
        wide = base
        for i in range(m):
            mine = F.broadcast(known.table).select(F.col("others").alias("o"), F.greatest("gain", F.lit(0.0)).alias(f"g{i}"))
            wide = wide.join(mine, _others(i, m) == F.col("o")).drop("o")
    else:
        found = skew_safe_lookup(long, known, "others", "cells_others", totals["cells"])
        wide = (
            found.select(*regrouped_keys(m), "n", F.col("own.c").alias("c"), "gain")
            .groupBy(*keys, "n")
            .agg(*[F.max(F.when(F.col("c") == i, F.greatest("gain", F.lit(0.0)))).alias(f"g{i}") for i in range(m)])
        )
    gains, total = [], F.lit(0.0)
    for i, (name, k) in enumerate(zip(qi, keys)):
        hit = _is_masked(df.schema[name].dataType, F.col(k), mask_nulls, mask_values)
        gains.append(F.when(hit, F.lit(0.0)).otherwise(F.col(f"g{i}")).alias(f"g{i}"))
        total = total + F.col(f"g{i}")
    return wide.select(*keys, "n", *gains).withColumn("RIG", total)


def row_gain(gains: DataFrame) -> Column:
    """Row information gain: the sum of the row's cell gains."""
    total = F.lit(0.0)
    for c in gain_columns(gains):
        total = total + col(c)
    return total


def cell_information_gain(
    df: DataFrame,
    qi: Sequence[str],
    row_id: str,
    mask_nulls: bool = False,
    mask_values: Sequence = (),
) -> DataFrame:
    """Gains of every row: row_id, ``cig_<column>``.., ``RIG``."""
    qi = require_columns(df, qi)
    require_columns(df, [row_id])
    keys = key_names(len(qi))
    rows = keyed(df, qi, col(row_id).alias("rid")).select("rid", F.struct(*keys).alias("key"))
    base = materialize(collapse(df, qi))
    gains = _gains(df, base, qi, mask_nulls, mask_values)
    per_key = gains.select(F.struct(*keys).alias("key"), "n", *[f"g{i}" for i in range(len(qi))], "RIG")
    total = base.agg(F.sum("n")).scalar()
    out = skew_safe_lookup(rows, per_key, "key", "n", total)
    return out.select(F.col("rid").alias(row_id), *_titled_gains(qi), "RIG")


def personal_information_factor(
    gains: DataFrame, percentile: int = 95, weight: str | None = WEIGHT, approximate: bool = False
) -> DataFrame:
    """One row: percentile, pif (that percentile of RIG), safe_level.

    ``approximate`` reads the gains once, without storing their values, and adds low, high
    (the exact percentile lies between them) and rank_error.
    """
    if not 0 <= percentile <= 100:
        raise ValueError("Give a percentile from 0 to 100.")
    if approximate:
        found = approximate_percentiles(gains, "RIG", [percentile / 100], weight)
        return found.select(
            F.lit(percentile).alias("percentile"), F.col("value").alias("pif"),
            safe_level(F.col("value")).alias("safe_level"), "low", "high", "rank_error",
        )
    points = exact_percentiles(gains, "RIG", [percentile / 100], weight)
    return points.select(
        F.lit(percentile).alias("percentile"),
        F.col("p0").alias("pif"),
        safe_level(F.col("p0")).alias("safe_level"),
    )


def gain_long(gains: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long form: kept columns, ``column``, ``cig``; the heat-map matrix in rows."""
    entries = [
        F.struct(F.lit(c[len(PREFIX):]).alias("column"), col(c).alias("cig")) for c in gain_columns(gains)
    ]
    return gains.select(*[col(c) for c in keep], F.explode(F.array(*entries)).alias("e")).select(
        *[col(c) for c in keep], "e.column", "e.cig"
    )


def gain_matrix(gains: DataFrame, row_id: str) -> DataFrame:
    """Wide row-by-column matrix of cell gains, without RIG."""
    return gains.select(col(row_id), *[col(c).alias(c[len(PREFIX):]) for c in gain_columns(gains)])


def gain_totals(gains: DataFrame, weight: str | None = WEIGHT) -> DataFrame:
    """Sum of each column's cell gains over all rows: column, total."""
    n = col(weight) if weight else F.lit(1)
    long = gain_long(gains.withColumn("_w", n), ["_w"])
    return long.groupBy("column").agg(F.sum(F.col("cig") * F.col("_w")).alias("total"))


def gain_summary(gains: DataFrame, weight: str | None = WEIGHT, digits: int | None = None) -> DataFrame:
    """Per column: mean, std, min, p25, p50, p75, max and is_top (highest mean).

    With digits (2 for display) the figures are rounded; is_top goes by the unrounded mean.
    """
    n = col(weight) if weight else F.lit(1)
    # The gains are evaluated once; everything else is about distinct values.
    counts = value_counts(gain_long(gains.withColumn("_w", n), ["_w"]), "cig", "_w", ["column"])
    w, x = F.col("n"), F.col("x")
    # One row per column of the table from here on.  Kept, so that equal means stay equal.
    means = materialize(counts.table.groupBy("column").agg(
        F.sum(w).alias("rows"), (F.sum(w * x) / F.sum(w)).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")
    ))
    # Squares of distances to the mean; sums of squares would cancel.
    away = x - F.col("mean")
    spread = counts.table.join(F.broadcast(means.select("column", "mean")), "column")
    spread = spread.groupBy("column").agg(F.sum(w * away * away).alias("spread"))
    quartiles = percentiles_of_counts(counts, [0.25, 0.5, 0.75], ["column"])
    top = means.agg(F.max("mean")).scalar()
    table = means.join(spread, "column").join(quartiles, "column").select(
        "column",
        "mean",
        F.sqrt(F.try_divide(F.col("spread"), F.col("rows") - 1)).alias("std"),
        "min",
        F.col("p0").alias("p25"),
        F.col("p1").alias("p50"),
        F.col("p2").alias("p75"),
        "max",
        (F.col("mean") == top).alias("is_top"),
    )
    if digits is None:
        return table
    figures = [c for c in table.columns if c not in ("column", "is_top")]
    return table.select(*[python_round(F.col(c), digits).alias(c) if c in figures else c for c in table.columns])
