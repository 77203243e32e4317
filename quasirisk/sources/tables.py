"""Loading and looking at tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.plans.keys import clean, col, require_columns

# Texts read as missing in delimited files.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"


def trim_header(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; values are left alone."""
    return df.toDF(*[c.strip() for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Read floating NaN as NULL in every column."""
    return df.select(*[clean(df, c).alias(c) for c in df.columns])


def _typed(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit: long, double, boolean.

    One aggregate over all columns, one row back.
    """
    checks = []
    for i, c in enumerate(df.columns):
        value = col(c)
        checks += [
            F.count(value).alias(f"v{i}"),
            F.count_if(value.rlike(_WHOLE) & value.try_cast("long").isNotNull()).alias(f"l{i}"),
            F.count_if(value.rlike(_NUMBER)).alias(f"d{i}"),
            F.count_if(value.rlike(_TRUTH)).alias(f"b{i}"),
        ]
    seen = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        filled = seen[f"v{i}"]
        kind = "string"
        if filled and seen[f"l{i}"] == filled:
            kind = "long"
        elif filled and seen[f"d{i}"] == filled:
            kind = "double"
        elif filled and seen[f"b{i}"] == filled:
            kind = "boolean"
        out.append((F.trim(col(c)).cast(kind) if kind in ("long", "double") else col(c).cast(kind)).alias(c))
    return df.select(*out)


def _checked(reader: DataFrameReader, path: str) -> DataFrame:
    """The fields as text, under trimmed names; ends the job where a line has too many."""
    names = reader.csv(path).columns
    fields = [T.StructField(f"_{i}", T.StringType()) for i in range(len(names) + 1)]
    # A further field catches what is beyond the header; that is the rule, not the exception.
    wide = reader.option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
    surplus = F.raise_error(F.lit("A line has more fields than the header."))
    over = col(fields[-1].name).isNotNull()
    return wide.select(*[
        F.when(over, surplus.cast("string")).otherwise(col(f.name)).alias(n.strip()) for f, n in zip(fields, names)
    ])


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
    multiline: bool = True,
) -> DataFrame:
    """Read a delimited file with a header: tab for ``.tsv``, comma otherwise.

    Names are trimmed, values are not; missing tokens become NULL.  Types are found in
    one pass over the data unless a schema (of the trimmed names) is given.  A line with
    more fields than the header ends the job, one with fewer is filled up with NULL.  Line
    breaks inside quotes belong to the value; ``multiline=False`` promises that there are
    none, and lets Spark split each file between tasks.
    """
    reader = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",")
    reader = reader.option("escape", '"').option("multiLine", multiline).option("inferSchema", False)
    # Spark keeps "" apart from an empty field; both count as missing here.
    reader = reader.option("emptyValue", "")
    raw = _checked(reader, path)
    text = raw.select(*[F.when(~col(c).isin(*missing_tokens), col(c)).alias(c) for c in raw.columns])
    if schema is None:
        return _typed(text)
    require_columns(text, schema.names)
    cast = lambda f: F.trim(col(f.name)) if isinstance(f.dataType, T.NumericType) else col(f.name)
    return text.select(*[cast(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet table with trimmed names and floating NaN as NULL."""
    return nan_to_null(trim_header(spark.read.parquet(path)))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns, in the given order."""
    return df.select(*[col(c) for c in require_columns(df, columns)])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*require_columns(df, columns))


def sensitive_attribute(candidates: Sequence[tuple[str, bool]]) -> str | None:
    """The first ticked column of (column, ticked) pairs, or None."""
    return next((c for c, ticked in candidates if ticked), None)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def distinct_values(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    require_columns(df, [column])
    values = df.select(clean(df, column).alias(column)).distinct()
    return values if with_null else values.where(col(column).isNotNull())


def sort_table(df: DataFrame, by: Sequence[str], descending: Sequence[bool] | None = None) -> DataFrame:
    """Sort results; text that reads as numbers is ordered by number, other text after it."""
    by = require_columns(df, by)
    order: list[Column] = []
    for c, down in zip(by, descending or [False] * len(by)):
        keys = [col(c)]
        if isinstance(df.schema[c].dataType, T.StringType):
            keys.insert(0, F.when(col(c).rlike(_NUMBER), F.trim(col(c)).try_cast("double")))
        order += [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]
    return df.orderBy(*order)


def combine_dictionary(profile: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add each column's dictionary entry to a profile, "not available" if it has none."""
    joined = profile.join(dictionary, "column", "left")
    return joined.withColumn("metadata", F.coalesce("metadata", F.lit("not available")))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Read a column dictionary: a JSON object of column -> object; (column, metadata)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("column", "metadata"))


def describe_column(dictionary: DataFrame, column: str) -> DataFrame:
    """One row (column, metadata): the entry of a column, or "not available"."""
    found = dictionary.where(F.col("column") == column).agg(F.first("metadata").alias("metadata"))
    return found.select(
        F.lit(column).alias("column"), F.coalesce("metadata", F.lit("not available")).alias("metadata")
    )


def kinds_map(overrides: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
