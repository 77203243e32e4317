"""Recoding by a history of replacements, and the tree the history makes.

A history is an ordered list of steps; each replaces some values of a column by one value.
Steps are functions on values, so a whole history is one function: composed once, it is
looked up once per row, however many steps there are.

A history table has the columns step, value, replacement: one row per replaced value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quasirisk.plans.keys import col, require_columns
from quasirisk.plans.lookup import is_small, skew_safe_lookup
from quasirisk.plans.materialize import materialize, materialize_measured

Steps = Sequence[tuple[Sequence[str], str]]

# Values up to which a dictionary is written into the expression.
LITERAL_VALUES = 256
HISTORY_SCHEMA = "step int, value string, replacement string"


def compose_history(steps: Steps) -> dict[str, str]:
    """What each replaced value becomes after all steps; values that end as themselves are left out.

    Read from the last step to the first: what a step replaces goes where the later steps
    take its replacement.
    """
    final: dict[str, str] = {}
    for values, replacement in reversed(steps):
        target = final.get(replacement, replacement)
        final.update(dict.fromkeys(values, target))
    return {value: target for value, target in final.items() if value != target}


def history_table(spark: SparkSession, steps: Steps) -> DataFrame:
    """The steps as a table, numbered from 1."""
    rows = [(i, v, r) for i, (values, r) in enumerate(steps, 1) for v in dict.fromkeys(values)]
    types = (pa.int32(), pa.string(), pa.string())
    cells = [pa.array([row[i] for row in rows], t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.table(cells, names=["step", "value", "replacement"]))


def recode(df: DataFrame, column: str, dictionary: DataFrame | Mapping[str, str]) -> DataFrame:
    """Replace the values of a text column that a dictionary lists; all others stay, NULL too.

    ``dictionary`` is a mapping or a table (value, replacement), unique by value.  A short
    mapping becomes part of the expression; anything longer is measured: a small one is
    broadcast, a large one meets the column's distinct values in a shuffle join first and
    then the rows, so a value held by a third of all rows is never shuffled.
    """
    require_columns(df, [column])
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise ValueError(f"Column '{column}' does not hold text.")
    if isinstance(dictionary, Mapping):
        if not dictionary:
            return df
        if len(dictionary) <= LITERAL_VALUES:
            pairs = F.map_from_arrays(F.lit(list(dictionary)), F.lit(list(dictionary.values())))
            return df.withColumn(column, F.coalesce(F.try_element_at(pairs, col(column)), col(column)))
        cells = {"value": list(dictionary), "replacement": list(dictionary.values())}
        dictionary = df.sparkSession.createDataFrame(pa.table(cells))
    listed = materialize_measured(
        dictionary.where("value IS NOT NULL").select(F.col("value").alias("_value"), F.col("replacement").alias("_new"))
    )
    order = df.columns
    if is_small(listed):
        joined = df.join(F.broadcast(listed.table), col(column) == F.col("_value"), "left")
        return joined.withColumn(column, F.coalesce("_new", col(column))).select(*[col(c) for c in order])
    counted = df.groupBy(F.struct(col(column).alias("v")).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    known = counted.join(listed.table, F.col("_key.v") == F.col("_value"), "left").select("_key", "_rows", "_new")
    keyed = df.withColumn("_key", F.struct(col(column).alias("v")))
    found = skew_safe_lookup(keyed, known, "_key", "_rows", df.agg(F.count(F.lit(1))).scalar())
    return found.withColumn(column, F.coalesce("_new", col(column))).select(*[col(c) for c in order])


def generalisation_levels(df: DataFrame, column: str, history: DataFrame) -> DataFrame:
    """The tree of a column with its levels: step, parent, child, depth.

    ``df`` is the source table, ``history`` a history table of the column, of any length.
    A child hangs below what it was replaced by; ``step`` is the step that replaced it, NULL
    for what is left at the end, which hangs below the column (depth 1).  A replacement that
    a later step combines again becomes an inner node.  A value that comes back under an
    earlier name is a node of its own, told apart by the step that made it, so there are no
    cycles.  Steps that replace a value by itself, NULLs and values the table does not hold
    make no node; a replacement is one even if nothing was there to be replaced.

    Depths come from pointer doubling: every node knows an ancestor and the distance to it,
    and each round asks the ancestor for its own, so a chain of d steps takes log2(d) joins.
    """
    require_columns(df, [column])
    steps = history.select("step", "value", "replacement").where(
        "value IS NOT NULL AND replacement IS NOT NULL AND value <> replacement"
    ).dropDuplicates(["step", "value"])
    # Made by a step (0: in the source) and, at the same step or later, taken by one.
    source = df.select(F.lit(0).alias("step"), col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    made = source.unionByName(steps.select("step", F.col("replacement").alias("value")).distinct())
    events = made.withColumn("target", F.lit(None).cast("string")).unionByName(
        steps.select("step", "value", F.col("replacement").alias("target"))
    )
    # From the last event back.  A step takes its values before it makes its replacement.
    later = Window.partitionBy("value").orderBy(F.desc("step"), F.col("target").isNotNull())
    later = later.rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("target").isNotNull(), F.struct("step", "target"))
    followed = events.withColumn("next", F.last(taken, ignorenulls=True).over(later)).where("target IS NULL")
    # A name made again before it is taken is the same node as before: keep the first.
    nodes = materialize(
        followed.groupBy("value", "next").agg(F.min("step").alias("made"))
        .select(F.struct("value", F.coalesce("next.step", F.lit(0)).alias("until")).alias("node"), "value", "next", "made")
    )
    # The node of the replacement is the one made by then and not yet taken.
    there = nodes.select(F.col("value").alias("target"), F.col("node").alias("up"), "made", F.col("node.until").alias("until"))
    low = nodes.where("next IS NOT NULL").select("node", "next.step", "next.target")
    linked = low.join(there, "target").where("made <= step AND (until = 0 OR until > step)")
    top = nodes.where("next IS NULL").select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("up"))
    links = materialize(linked.select("node", "up").unionByName(top))
    # Distance to the known ancestor, or to the column where there is none.
    jumps = links.withColumn("depth", F.lit(1).cast("long"))
    while jumps.where("up IS NOT NULL").limit(1).count():
        above = jumps.select(F.col("node").alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more"))
        jumps = materialize(
            jumps.join(above, "up", "left")
            .select("node", F.col("next_up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
    placed = links.join(jumps.select("node", "depth"), "node")
    step = F.when(F.col("node.until") > 0, F.col("node.until"))
    return placed.select(
        step.alias("step"), F.coalesce("up.value", F.lit(column)).alias("parent"), F.col("node.value").alias("child"), "depth"
    )
