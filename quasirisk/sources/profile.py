"""Column profile: distinct values and statistical kind."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.plans.keys import clean, require_columns
from quasirisk.sources.tables import kinds_map

# Fixed value: more distinct values than this make a column continuous.
MAX_CATEGORIES = 45
KINDS = ("Categorical", "Continuous")
# Columns from which on values are counted as rows.
WIDE_COLUMNS = 32
# Different values, over all columns, that a task holds before it passes them on.
HELD_VALUES = 500_000


def profile(df: DataFrame, overrides: Mapping[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: column, n_distinct (non-null), kind.

    ``overrides`` maps columns to "Categorical" or "Continuous".  ``approximate`` counts
    with a fixed-size sketch, one pass without a shuffle of values.  Tables of more than
    WIDE_COLUMNS columns are turned into rows (column, value), different ones of each task, that
    meet in one aggregate.
    """
    overrides = dict(overrides or {})
    if overrides:
        require_columns(df, list(overrides))
        if bad := sorted(set(overrides.values()) - set(KINDS)):
            raise ValueError(f"Unknown kinds: {bad}")
    count = F.approx_count_distinct if approximate else F.count_distinct
    counted = df.select(*[clean(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    wide = [f.name for f in counted.schema.fields if _has_text(f.dataType)] if not approximate else []
    wide = wide if len(wide) > WIDE_COLUMNS else []
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n_distinct"))
        for i, c in enumerate(df.columns) if f"c{i}" not in wide
    ]
    long = _counts_of_rows(counted, wide, df.columns) if wide else None
    if entries:
        row = counted.agg(*[count(F.col(c)).alias(c) for c in counted.columns if c not in wide])
        few = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        long = long.unionByName(few).orderBy("position") if long else few
    kind = F.when(F.col("n_distinct") > MAX_CATEGORIES, F.lit(KINDS[1])).otherwise(F.lit(KINDS[0]))
    if overrides:
        kind = F.coalesce(F.try_element_at(kinds_map(overrides), F.col("column")), kind)
    return long.select("column", "n_distinct", kind.alias("kind"))


def _has_text(dtype: T.DataType) -> bool:
    """Whether different values of the type differ as text."""
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.BinaryType, T.TimestampType, T.TimestampNTZType)
    return isinstance(dtype, plain)


def _comparable(name: str, dtype: T.DataType) -> Column:
    """The column as a long, text or bytes: equal where and only where the values are."""
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    if isinstance(dtype, T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)  # local times may repeat
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("string")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    return c if isinstance(dtype, T.BinaryType) else c.cast("long")


def _bytes_of(values: pa.Array) -> pa.Array:
    """Different values of one column as different bytes."""
    import numpy as np

    if pa.types.is_floating(values.type):
        values = pa.array(np.asarray(values).view(np.int64))
    if pa.types.is_integer(values.type):
        values = values.cast(pa.string())
    return values.cast(pa.binary())


def _counts_of_rows(df: DataFrame, wide: list[str], titles: list[str]) -> DataFrame:
    """(position, column, n_distinct) of the wide ones of columns c0, c1, ..., NULLs not counted.

    Tasks find the different values of each column as arrays, up to HELD_VALUES at a time, so
    a value that is common leaves each task once or a few times; values are spread over the
    shuffle by column and value, and only their counts meet in the end.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    at = {c: int(c[1:]) for c in wide}

    def distinct(batches):
        held: dict = {}  # by column: different values so far, and arrays of later ones
        size = 0

        def merged():
            return {c: [pa.concat_arrays(arrays).unique()] for c, arrays in held.items()}

        def flush():
            for c, (values,) in held.items():
                values = _bytes_of(values)
                yield pa.RecordBatch.from_arrays([pa.array([at[c]] * len(values), pa.int32()), values], names=["position", "v"])

        for batch in batches:
            for c, column in zip(wide, batch.columns, strict=True):
                values = column.unique().drop_null()
                if len(values):
                    held.setdefault(c, []).append(values)
                    size += len(values)
            if size > HELD_VALUES:
                held = merged()
                size = sum(len(values) for (values,) in held.values())
                if size > HELD_VALUES // 2:
                    yield from flush()
                    held, size = {}, 0
        held = merged()
        yield from flush()

    rows = df.select(*[_comparable(c, types[c]).alias(c) for c in wide]).mapInArrow(distinct, "position int, v binary")
    counts = rows.distinct().groupBy("position").agg(F.count("v").alias("n_distinct"))
    # One row per column of the table; a column without values has no count.
    listed = df.sparkSession.createDataFrame([(at[c], titles[at[c]]) for c in wide], "position int, column string")
    return listed.join(counts, "position", "left").fillna(0, ["n_distinct"]).orderBy("position")


def by_distinct(profiled: DataFrame) -> DataFrame:
    """Profile with the most varied columns first."""
    return profiled.orderBy(F.desc("n_distinct"), "column")


def columns_of_kind(profiled: DataFrame, kind: str) -> DataFrame:
    """Columns of one kind, as listed for recoding (Categorical) or noise and rounding."""
    if kind not in KINDS:
        raise ValueError(f"Unknown kind: {kind}")
    return profiled.where(F.col("kind") == kind).select("column")
