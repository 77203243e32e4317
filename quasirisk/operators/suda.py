"""Special uniques: minimal sample uniques, SUDA and DIS-SUDA scores, contributions.

A minimal sample unique (MSU) of a record is a set of QIs on which the record is
unique while it is unique on none of the set's proper subsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasirisk.functions.rounding import python_round
from quasirisk.operators.encode import category_codes, encoded_rows, string_columns
from quasirisk.operators.search import minimal_sets
from quasirisk.plans.keys import bits_where, col, collapse, key_names, may_equal, require_columns, require_mask_width
from quasirisk.plans.lattice import subset_cells, subset_masks
from quasirisk.plans.lookup import attach_unique
from quasirisk.plans.materialize import Measured, materialize, materialize_measured, stored

# Up to this many subsets are counted together; beyond, classes are refined recursively.
ONE_PASS_SUBSETS = 127


def _missing_bits(df: DataFrame, qi: Sequence[str], missing_value, missing_nulls: bool) -> Column:
    conditions = []
    for name, key in zip(qi, key_names(len(qi))):
        hit = F.col(key).isNull() if missing_nulls else F.lit(False)
        if missing_value is not None and may_equal(df.schema[name].dataType, missing_value):
            hit = hit | (F.col(key) == F.lit(missing_value))
        conditions.append(hit)
    return bits_where(conditions)


def _minimal(masks: Column) -> Column:
    """Keep the masks without a proper subset in the array (at most 2**m - 1 entries)."""
    by_size = F.transform(
        F.array_sort(F.transform(masks, lambda s: F.struct(F.bit_count(s).alias("size"), s.alias("mask")))),
        lambda s: s["mask"],
    )
    covered = lambda acc, s: F.exists(acc, lambda y: s.bitwiseAND(y) == y)
    return F.aggregate(
        by_size,
        F.array().cast("array<bigint>"),
        lambda acc, s: F.when(covered(acc, s), acc).otherwise(F.concat(acc, F.array(s))),
    )


def special_uniques(
    df: DataFrame,
    qi: Sequence[str],
    row_id: str,
    max_size: int | None = None,
    missing_value=None,
    missing_nulls: bool = False,
    base: DataFrame | None = None,
    weight: str | None = None,
) -> Measured:
    """Records with at least one MSU: rid and ``msus`` (bitmasks, smallest first).

    A cell equal to missing_value (or NULL, with missing_nulls) takes part in no MSU;
    by default NULL is a value like any other.  ``base`` is the materialised collapsed
    table, for callers that need it themselves.  The result is materialised and measured.
    """
    qi = require_columns(df, qi)
    require_columns(df, [row_id])
    m = require_mask_width(qi)
    top = m if max_size is None else max_size
    if not 1 <= top <= m:
        raise ValueError("max_size must lie between 1 and the number of columns.")
    blocked = _missing_bits(df, qi, missing_value, missing_nulls)
    few = sum(math.comb(m, size) for size in range(1, top + 1)) <= ONE_PASS_SUBSETS
    if base is None:
        collapsed = collapse(df, qi, row_id, weight)
        if not few:
            with stored(collapsed) as base:
                return materialize_measured(minimal_sets(base, m, blocked, top))
        base = materialize(collapsed)

    def uniques(counted: DataFrame) -> DataFrame:
        return counted.where(F.col("n") == 1).groupBy("rid").agg(F.collect_list("mask").alias("found"))

    if few:
        found = uniques(subset_cells(base, m, subset_masks(m, 1, top), blocked, with_id=True))
        return materialize_measured(found.select("rid", _minimal(F.col("found")).alias("msus")))

    return materialize_measured(minimal_sets(base, m, blocked, top))


def msu_weights(m: int, max_size: int | None = None) -> list[float]:
    """Score of an MSU by its size 1..M: the product of (m - i) for i = size..M-1."""
    top = m if max_size is None else max_size
    return [float(math.prod(m - i for i in range(size, top))) for size in range(1, top + 1)]


def _holds(i: int):
    """Lambda telling whether a mask contains column i."""
    return lambda s: s.bitwiseAND(F.lit(1 << i).cast("long")) != 0


def _weighted(uniques: DataFrame, m: int, max_size: int | None) -> DataFrame:
    """Add ``score`` and per-column weights w0.. (weight of the MSUs holding the column)."""
    sizes = F.expr("array(" + ", ".join(f"{w!r}D" for w in msu_weights(m, max_size)) + ")")
    weight = lambda s: F.element_at(sizes, F.bit_count(s))

    def total(masks: Column) -> Column:
        return F.aggregate(masks, F.lit(0.0), lambda acc, s: acc + weight(s))

    holding = [
        total(F.filter("msus", _holds(i))).alias(f"w{i}") for i in range(m)
    ]
    return uniques.select("*", total(F.col("msus")).alias("score"), *holding)


def _require_fraction(sample_fraction: float) -> None:
    if not 0 < sample_fraction <= 1:
        raise ValueError("sample_fraction must be in (0, 1].")


def _level(base: DataFrame, sample_fraction: float) -> DataFrame:
    """One row (ones, twos, theta): cells of size 1 and 2 and the file-level intrusion risk.

    theta = p*n1 / (p*n1 + 2*(1-p)*n2) with n1, n2 the number of cells of size 1 and 2.
    """
    p = float(sample_fraction)
    counts = base.agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    theta = F.try_divide(p * F.col("ones"), p * F.col("ones") + 2.0 * (1.0 - p) * F.col("twos"))
    return counts.withColumn("theta", theta)


def minimal_sample_uniques(df: DataFrame, qi: Sequence[str], row_id: str, **options) -> DataFrame:
    """One row per record and MSU: row_id, msu (column names joined by ", "), size."""
    found = special_uniques(df, qi, row_id, **options).table
    names = F.array(*[F.lit(c) for c in qi])
    flags = F.expr("array(" + ", ".join(f"{1 << i}L" for i in range(len(qi))) + ")")
    out = found.select(F.col("rid").alias(row_id), F.explode("msus").alias("mask"))
    chosen = F.filter(
        F.zip_with(names, flags, lambda c, b: F.when(F.col("mask").bitwiseAND(b) != 0, c)), lambda c: c.isNotNull()
    )
    return out.select(col(row_id), F.array_join(chosen, ", ").alias("msu"), F.bit_count("mask").alias("size"))


def _scored(
    df: DataFrame, base: DataFrame, qi: Sequence[str], row_id: str, sample_fraction: float, max_size: int | None,
    missing_value, missing_nulls: bool,
) -> Measured:
    """Special uniques only: rid, n_msu, score, dis_score; with the size of their table."""
    _require_fraction(sample_fraction)
    uniques = special_uniques(df, qi, row_id, max_size, missing_value, missing_nulls, base)
    found = _weighted(uniques.table, len(qi), max_size).select("rid", F.size("msus").alias("n_msu"), "score")
    level = _level(base, sample_fraction).select(F.struct("ones", "theta")).scalar()
    total = found.agg(F.sum("score")).scalar()
    dis = F.try_divide(F.col("score") * level["theta"] * level["ones"], total)
    scored = found.withColumn("dis", dis).withColumn("dis_score", python_round(F.col("dis"), 4)).drop("dis")
    return Measured(scored, uniques.rows, uniques.bytes)


def suda_scores(
    df: DataFrame,
    qi: Sequence[str],
    row_id: str,
    sample_fraction: float = 0.2,
    max_size: int | None = None,
    missing_value=None,
    missing_nulls: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Every row: row_id, n_msu, score, dis_score (4 decimals), dis_prob (capped at 1).

    Rows without an MSU score 0.  dis_score spreads the file-level risk over the
    records by score, with mean theta over the size-1 cells; it is not capped.
    """
    qi = require_columns(df, qi)
    require_columns(df, [row_id])
    base = materialize(collapse(df, qi, row_id, weight))
    scored = _scored(df, base, qi, row_id, sample_fraction, max_size, missing_value, missing_nulls)
    rows = attach_unique(df.select(col(row_id).alias("rid")), scored, "rid")
    return rows.select(
        F.col("rid").alias(row_id),
        F.coalesce("n_msu", F.lit(0)).alias("n_msu"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("dis_score", F.lit(0.0)).alias("dis_score"),
    ).withColumn("dis_prob", F.least("dis_score", F.lit(1.0)))


def file_level_risk(
    df: DataFrame, qi: Sequence[str], sample_fraction: float = 0.2, weight: str | None = None
) -> DataFrame:
    """One row: cells of size 1 and 2 and the file-level intrusion risk theta."""
    _require_fraction(sample_fraction)
    return _level(collapse(df, require_columns(df, qi), weight=weight), sample_fraction)


def _column_entries(qi: Sequence[str], *more: tuple[str, object]) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("variable"), F.col(f"w{i}").alias("w"), *[f(i).alias(a) for a, f in more])
                for i, c in enumerate(qi)
            ]
        )
    ).alias("e")


def attribute_contributions(
    df: DataFrame, qi: Sequence[str], row_id: str, max_size: int | None = None, **options
) -> DataFrame:
    """Per column: share (%) of the total MSU weight held by MSUs using the column.

    Shares overlap, so they add up to more than 100.  Unrounded; see ``rounded``.
    """
    qi = require_columns(df, qi)
    found = _weighted(special_uniques(df, qi, row_id, max_size=max_size, **options).table, len(qi), max_size)
    sums = found.agg(F.sum("score").alias("score"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(qi))])
    return sums.select("score", _column_entries(qi)).select(
        F.col("e.variable").alias("variable"),
        F.coalesce(F.try_divide(F.col("e.w") * 100.0, F.col("score")), F.lit(0.0)).alias("contribution"),
    )


def attribute_level_contributions(
    df: DataFrame, qi: Sequence[str], row_id: str, max_size: int | None = None, **options
) -> DataFrame:
    """As above per (variable, value): variable, value (text), code, contribution.

    The values of a column add up to the column's share.  ``code`` is the category code
    of string columns (NULL value: -1) and the number itself for others.
    """
    qi = require_columns(df, qi)
    require_columns(df, [row_id])
    base = materialize(collapse(df, qi, row_id, options.get("weight")))
    uniques = special_uniques(df, qi, row_id, max_size=max_size, base=base, **options)
    found = _weighted(uniques.table, len(qi), max_size).join(base.drop("n"), "rid")
    text = string_columns(df, qi)
    number = lambda i: F.lit(None).cast("double") if qi[i] in text else F.col(f"k{i}").cast("double")
    levels = (
        found.select(_column_entries(qi, ("value", lambda i: F.col(f"k{i}").cast("string")), ("number", number)))
        .select("e.*")
        .where(F.col("w") > 0)
        .groupBy("variable", "value")
        .agg(F.sum("w").alias("w"), F.min("number").alias("number"))
    )
    total = found.agg(F.sum("score")).scalar()
    codes = category_codes(df, qi)
    code = F.when(
        F.col("variable").isin(text), F.coalesce(F.col("code"), F.lit(-1)).cast("double")
    ).otherwise(F.col("number"))
    return levels.join(codes, ["variable", "value"], "left").select(
        "variable", "value", code.alias("code"), (F.col("w") * 100.0 / total).alias("contribution")
    )


def record_contributions(
    df: DataFrame, qi: Sequence[str], row_id: str, max_size: int | None = None, **options
) -> DataFrame:
    """Per special unique: share (%) of the record's score by column, ``pct_<column>``."""
    qi = require_columns(df, qi)
    found = _weighted(special_uniques(df, qi, row_id, max_size=max_size, **options).table, len(qi), max_size)
    shares = [(F.col(f"w{i}") * 100.0 / F.col("score")).alias(f"pct_{c}") for i, c in enumerate(qi)]
    return found.select(F.col("rid").alias(row_id), *shares)


def rounded(contributions: DataFrame) -> DataFrame:
    """Contributions to two decimals, largest first (within a variable for levels)."""
    out = contributions.withColumn("contribution", python_round(F.col("contribution"), 2))
    if "value" in out.columns:
        return out.orderBy("variable", F.desc("contribution"), "value")
    return out.orderBy(F.desc("contribution"), "variable")


def suda_record_table(
    df: DataFrame,
    qi: Sequence[str],
    row_id: str,
    sample_fraction: float = 0.2,
    max_size: int | None = None,
    missing_value=None,
    missing_nulls: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Every row: row_id, the QIs encoded as doubles, dis_score, score."""
    qi = require_columns(df, qi)
    require_columns(df, [row_id])
    base = materialize(collapse(df, qi, row_id, weight))
    scored = _scored(df, base, qi, row_id, sample_fraction, max_size, missing_value, missing_nulls)
    rows = attach_unique(encoded_rows(df, base, qi, row_id), scored, "rid")
    return rows.select(
        F.col("rid").alias(row_id),
        *[F.col(f"e{i}").alias(c) for i, c in enumerate(qi)],
        F.coalesce("dis_score", F.lit(0.0)).alias("dis_score"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
