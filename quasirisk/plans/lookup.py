"""Joining a per-key result back to rows, some keys of which may be very common.

The right side has one row per key and knows how many left rows carry the key.  It is
materialised and measured.  If it is small it is broadcast.  Otherwise the keys above
1/HOT_SHARE of the left rows - at most HOT_SHARE in number, whatever the data - are
broadcast, so their rows are never shuffled, and the rest is a shuffle join whose
heaviest key holds at most 1/HOT_SHARE of the rows.  No row is dropped either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasirisk.plans.materialize import Measured, materialize_measured

# At most this many keys per family can hold more than 1/HOT_SHARE of the rows.
HOT_SHARE = 1000
# Measured size up to which the whole right side is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def is_small(right: Measured) -> bool:
    return right.bytes <= BROADCAST_BYTES


def join_struct_key(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Shuffle join on a struct column.

    Sorting goes by a hash of it, a plain long; the struct only has to settle ties.
    """
    hashed = lambda side: side.withColumn("_hash", F.xxhash64(on))
    return hashed(left).join(hashed(right), ["_hash", on], how).drop("_hash")


def skew_safe_lookup(
    left: DataFrame, right: DataFrame | Measured, on: str, rows_per_key: str, total_rows: Column
) -> DataFrame:
    """Join of ``left`` with ``right`` (unique on ``on``), safe for heavy keys.

    ``on`` may be a struct column: structs with NULL fields compare equal, which makes
    the join null-safe while staying an equi-join.  Each left key must be present on the
    right: a row without a partner (an input that changed between two reads) ends the job.
    """
    known = right if isinstance(right, Measured) else materialize_measured(right)
    given = [c for c in known.table.columns if c not in (on, rows_per_key)]
    if is_small(known):
        return _complete(left.join(F.broadcast(_marked(known.table.drop(rows_per_key))), on, "left"), given)
    is_hot = F.col(rows_per_key) * F.lit(HOT_SHARE) > total_rows
    hot = F.broadcast(known.table.where(is_hot).drop(rows_per_key))
    cold = known.table.where(~is_hot).drop(rows_per_key)
    light = left.join(hot.select(on), on, "left_anti")
    rest = _complete(join_struct_key(light, _marked(cold), on, "left"), given)
    return left.join(hot, on).unionByName(rest)


def _marked(right: DataFrame) -> DataFrame:
    return right.withColumn("_met", F.lit(True))


def _complete(joined: DataFrame, given: list[str]) -> DataFrame:
    """Whatever column of the right side is read, a row without a partner is found out."""
    lost = F.raise_error(F.lit("A row has no counterpart: the input changed between two reads."))
    checked = {c: F.when(F.col("_met").isNull(), lost.cast(joined.schema[c].dataType)).otherwise(F.col(c)) for c in given}
    return joined.withColumns(checked).drop("_met")


def attach_unique(left: DataFrame, right: Measured, on: str) -> DataFrame:
    """Left join on a key unique on both sides: broadcast if measured small, else shuffle."""
    return left.join(F.broadcast(right.table) if is_small(right) else right.table, on, "left")
