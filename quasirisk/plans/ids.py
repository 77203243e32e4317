"""Row numbers and row keys without a global sort or a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.plans.keys import col

# monotonically_increasing_id() keeps the position in the low 33 bits.
POSITION_BITS = 33
# Copies of one row that are written out as one piece, and copies above which they are dealt out.
COPIES, FEW_COPIES = 10_000, 4


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 0-based position of each row.

    Pass 1 counts rows per input partition (a scan of no columns), pass 2 adds each
    partition's offset to the position inside it.  The offsets are one row per input
    partition.  The input must give the same rows in the same order both times: a file
    scan, or the result of ``materialize``.
    """
    tag = F.monotonically_increasing_id()
    tagged = df.withColumn("_part", F.shiftright(tag, POSITION_BITS)).withColumn(
        "_pos", tag.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def with_content_key(df: DataFrame, name: str = "content_key") -> DataFrame:
    """The same rows with a number that depends on a row's content and its place among equal rows.

    Equal rows are counted, which combines in the tasks, and written out again from the
    count, so it does not matter where they were: repeated runs, other partitionings and
    repeated tasks give the same pairs of row and key.  Counts are small where the rows are
    many, so those above FEW_COPIES are cut into pieces of COPIES and dealt out to all
    shuffle partitions: a task writes its share of the rows, however few there are to tell
    apart.  -0.0 becomes 0.0.  Different rows share a key only if their 64-bit hashes collide.
    """
    if maps := [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]:
        raise ValueError(f"Columns whose content has no order: {maps}. Give a row id.")
    names = [col(c) for c in df.columns]
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    last = F.floor((F.col("_copies") - 1) / COPIES)
    many = counted.where(F.col("_copies") > FEW_COPIES)
    pieces = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_piece"))
    # A given number of partitions stays; those of adaptive execution are merged by the bytes before writing out.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, "_piece", *names)
    few = counted.where(F.col("_copies") <= FEW_COPIES).withColumn("_piece", F.lit(0).cast("long"))
    first = F.col("_piece") * COPIES
    numbers = F.sequence(first, F.least(first + COPIES, F.col("_copies")) - 1)
    rows = few.unionByName(pieces).select(*names, F.explode(numbers).alias("_number"))
    return rows.select(*names, F.xxhash64(*names, "_number").alias(name))
