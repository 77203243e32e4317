"""Group-size metrics: unique rows, k-anonymity and l-diversity.

Metrics take an optional ``weight`` column: the number of original rows a row stands
for.  ``collapse_table`` scans a large table once and leaves such a weighted table for
any number of metrics on its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.plans.keys import any_null, clean, collapse, key_names, keyed, require_columns, row_weight
from quasirisk.plans.materialize import materialize

# Column telling how many rows of the original table a collapsed row stands for.
WEIGHT = "group_rows"


def collapse_table(df: DataFrame, columns: Sequence[str], row_id: str | None = None) -> DataFrame:
    """Distinct combinations of the columns with ``group_rows``, materialised.

    With row_id also the smallest id of each combination, which is all the special
    unique functions need.  Give the sensitive column along with the QIs for
    l-diversity.
    """
    columns = require_columns(df, columns)
    if WEIGHT in columns:
        raise ValueError(f"Reserved column name: {WEIGHT}")
    base = materialize(collapse(df, columns, row_id))
    ids = [F.col("rid").alias(row_id)] if row_id else []
    return base.select(
        *[F.col(k).alias(c) for k, c in zip(key_names(len(columns)), columns)], F.col("n").alias(WEIGHT), *ids
    )


def unique_rows(df: DataFrame, qi: Sequence[str], weight: str | None = None) -> DataFrame:
    """``num_unique_rows``: QI combinations held by exactly one row; NULL is a value."""
    base = collapse(df, require_columns(df, qi), weight=weight)
    return base.agg(F.count_if(F.col("n") == 1).alias("num_unique_rows"))


def k_anonymity(df: DataFrame, qi: Sequence[str], weight: str | None = None) -> DataFrame:
    """``k_anonymity``: the smallest group; rows with a NULL key are left out."""
    qi = require_columns(df, qi)
    base = collapse(df, qi, weight=weight).where(~any_null(key_names(len(qi))))
    return base.agg(F.min("n").alias("k_anonymity"))


def _groups(df: DataFrame, qi: Sequence[str], sensitive: str, weight: str | None = None) -> DataFrame:
    """Per QI combination: ``n`` rows and ``l`` distinct non-null sensitive values.

    Counting (QI, sensitive) pairs first keeps a dominant combination spread over its
    sensitive values; the second step only adds up those pair counts.
    """
    keys = key_names(len(qi))
    rows = keyed(df, qi, clean(df, sensitive).alias("s"), row_weight(weight).alias("n"))
    pairs = rows.groupBy(*keys, "s").agg(F.sum("n").alias("n"))
    return pairs.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("s").alias("l"))


def l_diversity(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    """``l_diversity``: fewest distinct sensitive values in any group without NULL keys."""
    qi = require_columns(df, qi)
    require_columns(df, [sensitive])
    groups = _groups(df, qi, sensitive).where(~any_null(key_names(len(qi))))
    return groups.agg(F.min("l").alias("l_diversity"))


def risk_summary(
    df: DataFrame, qi: Sequence[str], sensitive: str | None = None, weight: str | None = None
) -> DataFrame:
    """All group-size metrics in one row and one pass over the table."""
    qi = require_columns(df, qi)
    if sensitive is None:
        groups = collapse(df, qi, weight=weight).withColumn("l", F.lit(None).cast("long"))
    else:
        require_columns(df, [sensitive])
        groups = _groups(df, qi, sensitive, weight)
    full_key = ~any_null(key_names(len(qi)))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_rows"),
        F.lit(len([c for c in df.columns if c not in (weight, WEIGHT)])).alias("total_columns"),
        F.lit(len(qi)).alias("num_selected_columns"),
        F.count_if(F.col("n") == 1).alias("num_unique_rows"),
        F.min(F.when(full_key, F.col("n"))).alias("k_anonymity"),
        F.min(F.when(full_key, F.col("l"))).alias("l_diversity"),
    )
