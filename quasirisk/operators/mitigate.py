"""Lowering the risk: noise, rounding, recoding, suppression, and measuring again.

A *recipe* is an ordered list of steps applied to the source table.  The source is
never changed, so reverting a column means applying the recipe without its steps.
All steps are narrow: one projection, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.functions.noise import gaussian_noise, laplace_noise
from quasirisk.functions.rounding import round_nearest, round_up, truncate
from quasirisk.operators.recode import compose_history, history_table, recode
from quasirisk.plans.ids import with_content_key
from quasirisk.plans.keys import col, require_columns

# column -> [(values, replacement), ...] in the order the combinations were made.
History = dict[str, list[tuple[list[str], str]]]


def _require_numeric(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"Column '{column}' is not numeric.")


def _require_text(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise ValueError(f"Column '{column}' does not hold text.")


@dataclass(frozen=True)
class AddNoise:
    """Add noise to a numeric column, which becomes a double.

    kind "laplacian" draws from Laplace(0, scale), any other kind from Normal(0, scale).
    With a row_id the draws depend on (seed, column, step of the recipe, row id) only.
    Without one they depend on the row's content and its number among equal rows, so
    neither another partitioning nor a repeated task changes them; that takes a shuffle of
    the distinct rows.  On a stream, where equal rows cannot be counted, they come from the
    generator of the task instead.  Columns and steps get independent draws; recipes applied
    to the same column one after the other need different seeds.
    """

    column: str
    kind: str = "gaussian"
    seed: int = 0
    row_id: str | None = None
    scale: float = 1.0

    def apply(self, df: DataFrame, step: int = 0) -> DataFrame:
        _require_numeric(df, self.column)
        key, order = self.row_id, df.columns
        if key is None and not df.isStreaming:
            key = "_content"
            df = with_content_key(df, key)
        draw = laplace_noise if self.kind == "laplacian" else gaussian_noise
        noise = draw(self.seed, col(key) if key else None, self.scale, f"{step}/{self.column}")
        noisy = df.withColumn(self.column, col(self.column).cast("double") + noise)
        return noisy.select(*[col(c) for c in order])


@dataclass(frozen=True)
class RoundUp:
    """Round up to the next multiple of 10**precision."""

    column: str
    precision: int

    def apply(self, df: DataFrame) -> DataFrame:
        _require_numeric(df, self.column)
        return df.withColumn(self.column, round_up(col(self.column), self.precision))


@dataclass(frozen=True)
class RoundNearest:
    """Round to the nearest multiple of 10**precision (1 to 6), halves to even."""

    column: str
    precision: int

    def apply(self, df: DataFrame) -> DataFrame:
        _require_numeric(df, self.column)
        if not 1 <= self.precision <= 6:
            raise ValueError("Precision must be between 1 and 6.")
        return df.withColumn(self.column, round_nearest(col(self.column), self.precision))


@dataclass(frozen=True)
class RemoveDecimals:
    """Truncate toward zero; NULL stays NULL."""

    column: str

    def apply(self, df: DataFrame) -> DataFrame:
        _require_numeric(df, self.column)
        return df.withColumn(self.column, truncate(col(self.column)))


@dataclass(frozen=True)
class CombineSelected:
    """Replace at least two values of a column, read as text, by one value."""

    column: str
    values: tuple[str, ...]
    replacement: str

    def apply(self, df: DataFrame) -> DataFrame:
        require_columns(df, [self.column])
        if len(self.values) < 2:
            raise ValueError("Select at least two values to combine.")
        if not self.replacement:
            raise ValueError("Give a replacement value.")
        text = col(self.column).cast("string")
        return df.withColumn(self.column, _replace(text, self.values, self.replacement))


@dataclass(frozen=True)
class DropColumn:
    """Leave a redundant column out."""

    column: str

    def apply(self, df: DataFrame) -> DataFrame:
        require_columns(df, [self.column])
        return df.drop(self.column)


Step = AddNoise | RoundUp | RoundNearest | RemoveDecimals | CombineSelected | DropColumn


def apply_recipe(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for number, step in enumerate(steps):
        df = step.apply(df, number) if isinstance(step, AddNoise) else step.apply(df)
    return df


def revert(steps: Sequence[Step], column: str) -> list[Step]:
    """The recipe without the column's steps; ``ValueError`` if it has none."""
    kept = [s for s in steps if s.column != column]
    if len(kept) == len(steps):
        raise ValueError(f"The recipe has no step for column {column}.")
    return kept


def _replace(text: Column, values: Sequence[str], replacement: str) -> Column:
    return F.when(text.isin(*values), F.lit(replacement)).otherwise(text)


def _replay(df: DataFrame, history: Mapping[str, Sequence[tuple[Sequence[str], str]]]) -> DataFrame:
    for column, combinations in history.items():
        _require_text(df, column)
        df = recode(df, column, compose_history(combinations))
    return df


def combine_values(
    df: DataFrame, history: History, column: str, values: Sequence[str], replacement: str
) -> tuple[DataFrame, History]:
    """Combine values of a text column into one; returns the table and the longer history.

    The earlier history of all columns is replayed on the given table, the column's
    values are trimmed, and then everything including the new combination is replayed.
    Values and replacement are trimmed of blanks and quotes.  However long the history, each
    row is looked up once before and once after trimming (``recode``).
    """
    _require_text(df, column)
    tidy = lambda v: v.strip().strip("'\"")
    longer: History = {c: list(done) for c, done in history.items()}
    longer.setdefault(column, []).append(([tidy(v) for v in values], tidy(replacement)))
    replayed = _replay(df, history)
    # Tabs, line breaks and the blanks of other scripts go, too.
    trimmed = replayed.withColumn(column, F.regexp_replace(col(column), r"(?U)^\s+|\s+$", ""))
    return _replay(trimmed, longer), longer


def generalisation_tree(
    df: DataFrame, column: str, history: History, hide_combined: bool = False
) -> DataFrame:
    """Edges (parent, child): column -> replacement -> original values, column -> values.

    With hide_combined, values that went into a combination hang below their
    replacement only.
    """
    require_columns(df, [column])
    steps = history_table(df.sparkSession, history.get(column, []))
    text = col(column).cast("string")
    current = df.select(text.alias("child")).where(F.col("child").isNotNull()).distinct()
    made = steps.select(F.col("replacement").alias("child"))
    below = current.unionByName(made)
    if hide_combined:
        below = below.join(steps.select(F.col("value").alias("child")).distinct(), "child", "left_anti")
    top = below.select(F.lit(column).alias("parent"), "child")
    return top.unionByName(steps.select(F.col("replacement").alias("parent"), F.col("value").alias("child"))).distinct()


def suppress_above(df: DataFrame, risk: str, threshold: float) -> DataFrame:
    """Keep the rows whose risk is at most the threshold or unknown."""
    require_columns(df, [risk])
    return df.where(col(risk).isNull() | (col(risk) <= threshold))


def suppress_rows(df: DataFrame, flagged: DataFrame, row_id: str) -> DataFrame:
    """Drop the rows whose id is listed in ``flagged`` (for example outliers)."""
    require_columns(df, [row_id])
    require_columns(flagged, [row_id])
    return df.join(flagged.select(col(row_id)).distinct(), row_id, "left_anti")


def compare_versions(
    versions: Mapping[str, DataFrame], metric: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same metric on several versions of a table, told apart by ``version``."""
    if not versions:
        raise ValueError("Give at least one version.")
    out = None
    for name, table in versions.items():
        measured = metric(table).select(F.lit(name).alias("version"), "*")
        out = measured if out is None else out.unionByName(measured, allowMissingColumns=True)
    return out
