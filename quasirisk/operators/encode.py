"""Category codes: 0-based rank of each string value in its column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.operators.infogain import cells_by_column, regrouped_keys
from quasirisk.plans.keys import col, collapse, key_names, keyed, require_columns
from quasirisk.plans.lookup import is_small, join_struct_key, skew_safe_lookup
from quasirisk.plans.materialize import materialize, materialize_measured


def string_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dictionary of the string columns among ``columns``: variable, value, code.

    Codes follow the code-point order of the values; NULL has no entry.  The distinct
    values of all columns are range-partitioned together and ranked inside each range.
    """
    columns = require_columns(df, columns)
    text = string_columns(df, columns)
    entries = [
        F.struct(F.lit(columns.index(c)).alias("c"), F.lit(c).alias("variable"), col(c).alias("value")) for c in text
    ]
    if not entries:
        empty = "c int, variable string, value string, code long"
        return df.sparkSession.createDataFrame([], empty).drop("c")
    values = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
    # Ordered blocks; the block number is stored with the rows, so both readers agree.
    blocks = materialize(
        values.distinct().repartitionByRange("c", "value").withColumn("block", F.spark_partition_id())
    )
    upto = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block and column.
    offsets = blocks.groupBy("c", "block").agg(F.count(F.lit(1)).alias("rows")).select(
        "c", "block", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("c", "block").orderBy("value"))
    return blocks.withColumn("place", place).join(F.broadcast(offsets), ["c", "block"]).select(
        "variable", "value", (F.col("offset") + F.col("place") - 1).alias("code")
    )


def encoded_tuples(df: DataFrame, base: DataFrame, qi: Sequence[str]) -> DataFrame:
    """From the materialised base, per distinct QI combination: k0.., n, and its encoded keys e0.. as doubles.

    Strings become their code (NULL: -1); other columns are cast to double.
    """
    m = len(qi)
    keys = key_names(m)
    text = string_columns(df, qi)
    positions = {c: i for i, c in enumerate(qi)}

    def encoded(i: int) -> Column:
        found = F.coalesce(F.col(f"code{i}"), F.lit(-1)) if qi[i] in text else F.col(keys[i])
        return found.cast("double").alias(f"e{i}")

    if not text:
        return base.select(*keys, "n", *[encoded(i) for i in range(m)])
    codes = materialize_measured(category_codes(df, qi))
    if is_small(codes):
        found = base
        for c in text:
            i = positions[c]
            mine = codes.table.where(F.col("variable") == c).select(F.col("value").alias("v"), F.col("code").alias(f"code{i}"))
            found = found.join(F.broadcast(mine), F.col(keys[i]) == F.col("v"), "left").drop("v")
        return found.select(*keys, "n", *[encoded(i) for i in range(m)])
    # A dictionary too large to broadcast: look all columns up together, then regroup.
    own_value = F.coalesce(*[F.when(F.col("own.c") == positions[c], F.col(f"own.k{positions[c]}")) for c in text])
    c_of = F.element_at(F.create_map(*[x for c in text for x in (F.lit(c), F.lit(positions[c]))]), F.col("variable"))
    cells = (
        cells_by_column(base, m)
        .where(F.col("own.c").isin([positions[c] for c in text]))
        .withColumn("value", own_value)
        .where(F.col("value").isNotNull())
        .withColumn("entry", F.struct(F.col("own.c").alias("c"), "value"))
    )
    weights = cells.groupBy("entry").agg(F.count(F.lit(1)).alias("cells"))
    dictionary = codes.table.select(F.struct(c_of.alias("c"), "value").alias("entry"), "code").join(weights, "entry")
    found = skew_safe_lookup(cells, dictionary, "entry", "cells", weights.agg(F.sum("cells")).scalar())
    per_key = (
        found.select(F.struct(*regrouped_keys(m)).alias("key"), F.col("own.c").alias("c"), "code")
        .groupBy("key")
        .agg(*[F.max(F.when(F.col("c") == positions[c], F.col("code"))).alias(f"code{positions[c]}") for c in text])
    )
    joined = join_struct_key(base.withColumn("key", F.struct(*keys)), per_key, "key", "left")
    return joined.select(*keys, "n", *[encoded(i) for i in range(m)])


def encoded_rows(df: DataFrame, base: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Every row: rid, e0.. (the encoded columns)."""
    keys = key_names(len(columns))
    codes = [f"e{i}" for i in range(len(columns))]
    tuples = encoded_tuples(df, base, columns).select(F.struct(*keys).alias("key"), "n", *codes)
    rows = keyed(df, columns, col(row_id).alias("rid")).select("rid", F.struct(*keys).alias("key"))
    total = base.agg(F.sum("n")).scalar()
    return skew_safe_lookup(rows, tuples, "key", "n", total).select("rid", *codes)


def encode_categories(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """row_id and the columns as doubles: codes for strings (NULL: -1), values otherwise."""
    columns = require_columns(df, columns)
    require_columns(df, [row_id])
    out = encoded_rows(df, materialize(collapse(df, columns)), columns, row_id)
    return out.select(F.col("rid").alias(row_id), *[F.col(f"e{i}").alias(c) for i, c in enumerate(columns)])
