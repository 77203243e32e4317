"""Writing results as CSV folders, one part file per task."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.operators.infogain import PREFIX, gain_columns
from quasirisk.plans.keys import col

# Column titles and file-name stems of exported results.
INFLUENCE_TITLES = {
    "column": "Column",
    "unique_count_after_removal": "Unique Rows After Removal",
    "difference": "Difference in Unique Rows",
    "normalized_difference": "Normalized Difference",
}
COMBINATION_TITLES = {
    "combination": "Combination",
    "unique_rows": "Unique Rows",
    "unique_rows_excluding": "Unique Rows Excluding Columns",
    "score": "Score",
}
RESULT_STEMS = {"combinations": "combinedresult", "suda": "sudaresult"}
TIMESTAMP_FORMAT = "%Y%m%d_%H%M%S"


def default_name(kind: str, now: datetime | None = None) -> str:
    """File name of a result: stem, underscore, time stamp."""
    stamp = (now or datetime.now(timezone.utc)).strftime(TIMESTAMP_FORMAT)
    return f"{RESULT_STEMS[kind]}_{stamp}.csv"


def write_csv(df: DataFrame, path: str) -> str:
    """Write with a header; a sorted table keeps its order across part files."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # of values, which keep theirs
    df.write.option("header", True).option("escape", '"').options(**blanks).csv(path)
    return path


def _titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).alias(t) for c, t in titles.items()])


def write_gains(gains: DataFrame, row_id: str, path: str) -> str:
    """Cell gains under their column names and RIG, with the row index, riskiest first."""
    cells = [col(c).alias(c[len(PREFIX):]) for c in gain_columns(gains)]
    return write_csv(gains.select(col(row_id), *cells, "RIG").orderBy(F.desc("RIG"), col(row_id)), path)


def write_suda_records(records: DataFrame, row_id: str, path: str) -> str:
    """Record scores, highest dis-score first, without the row index."""
    ordered = records.orderBy(F.desc("dis_score"), col(row_id)).drop(row_id)
    return write_csv(ordered.withColumnRenamed("dis_score", "dis-score"), path)


def write_contributions(contributions: DataFrame, path: str, qi: Sequence[str]) -> str:
    """Attribute contributions in QI order; the index is the column's place among the QIs."""
    place = F.array_position(F.array(*[F.lit(c) for c in qi]), F.col("variable")) - 1
    table = contributions.select(place.alias("index"), "variable", "contribution")
    return write_csv(table.orderBy("index"), path)


def write_influence(influence: DataFrame, path: str) -> str:
    ordered = influence.orderBy(F.desc("normalized_difference"), "column")
    return write_csv(_titled(ordered, INFLUENCE_TITLES), path)


def write_combinations(contribution: DataFrame, folder: str, name: str | None = None) -> str:
    """Combination results in ``folder``, under a time-stamped name unless one is given."""
    return write_csv(_titled(contribution, COMBINATION_TITLES), f"{folder}/{name or default_name('combinations')}")
