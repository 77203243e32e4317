"""Quasi-identifier keys: validation, null handling and the collapsed base.

Every risk metric depends on the table only through the distinct combinations of
its quasi-identifiers (QIs) and how often each occurs.  ``collapse`` computes that
once, with map-side combine, so a combination held by a third of all rows leaves
each map task as a single record.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and dashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns as a list; ``ValueError`` if empty, repeated or unknown."""
    columns = list(columns)
    if not columns:
        raise ValueError("Select at least one column.")
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    if repeated:
        raise ValueError(f"Columns given more than once: {repeated}")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Columns not in the table: {unknown}")
    return columns


def require_mask_width(qi: Sequence[str]) -> int:
    """Number of QIs; arbitrary subsets are long bitmasks, so at most 62."""
    if len(qi) > 62:
        raise ValueError("Subsets of more than 62 quasi-identifiers cannot be listed.")
    return len(qi)


def may_equal(dtype: T.DataType, value: object) -> bool:
    """Whether a column of this type can hold the value; others never match it."""
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float, Decimal)):
        return isinstance(dtype, T.NumericType)
    if isinstance(value, datetime.date):
        return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(value, str) and isinstance(dtype, T.StringType)


def clean(df: DataFrame, name: str) -> Column:
    """The column with floating NaN read as NULL (Spark keeps the two apart)."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def key_names(m: int) -> list[str]:
    return [f"k{i}" for i in range(m)]


def keyed(df: DataFrame, qi: Sequence[str], *extra: Column) -> DataFrame:
    """Project to the QIs as k0, k1, ... plus extra columns."""
    return df.select(*[clean(df, c).alias(k) for c, k in zip(qi, key_names(len(qi)))], *extra)


def row_weight(weight: str | None) -> Column:
    """How many rows of the original table a row stands for."""
    return col(weight).cast("long") if weight else F.lit(1).cast("long")


def collapse(df: DataFrame, qi: Sequence[str], row_id: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per distinct QI combination: k0.., ``n`` rows, smallest ``rid``."""
    extra = [row_weight(weight).alias("n"), *([col(row_id).alias("rid")] if row_id else [])]
    aggs = [F.sum("n").alias("n")]
    if row_id:
        aggs.append(F.min("rid").alias("rid"))
    return keyed(df, qi, *extra).groupBy(*key_names(len(qi))).agg(*aggs)


def any_null(keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def bits_where(conditions: Sequence[Column]) -> Column:
    """Long bitmask with bit i set where condition i holds (NULL counts as no)."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out
