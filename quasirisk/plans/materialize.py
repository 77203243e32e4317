"""Reliable materialisation in the folder the cluster names."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a folder in its warehouse.

    A warehouse on a local path is shared only if the master is local, too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not sc.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        named = os.path.join(warehouse, "_checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{prefix}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to reliable storage and cut the lineage there.

    For results that later steps read several times.  Survives executor loss (nothing is
    recomputed) and gives every reader the same values: sums of doubles differ in the
    last bit from one evaluation to the next.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Types that Parquet keeps as they are.
PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.BinaryType, T.TimestampType, T.TimestampNTZType)


@contextmanager
def stored(df: DataFrame):
    """``materialize`` for many rows with few values: compressed, and deleted at the end of the block.

    What is made out of the table has to be materialised inside the block.
    """
    if not all(isinstance(f.dataType, PLAIN) for f in df.schema.fields):
        yield materialize(df)
        return
    spark = df.sparkSession
    path = new_path(spark, "stored")
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@dataclass(frozen=True)
class Measured:
    """A materialised table with its row count, size in bytes and other observed sums."""

    table: DataFrame
    rows: int
    bytes: int
    seen: dict = field(default_factory=dict)


def _width(value: str, dtype: T.DataType) -> str:
    """SQL for the bytes held by a value: fixed-size types count 16, text its length."""
    if isinstance(dtype, T.StructType):
        return " + ".join(["8", *[_width(f"{value}.`{f.name}`", f.dataType) for f in dtype.fields]])
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return f"coalesce(octet_length({value}), 0) + 16"
    if isinstance(dtype, T.ArrayType):
        return f"coalesce(size({value}), 0) * 16 + 16"
    return "16"


def materialize_measured(df: DataFrame, **aggregates: str) -> Measured:
    """``materialize`` that also counts rows and bytes, in the same job.

    ``aggregates`` are further SQL aggregates to observe by name.  A retried task may be
    counted twice, so the figures can be too high; they only choose between plans.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    # Internal column names only, so they need no escaping beyond backticks.
    width = " + ".join(_width(f"`{f.name}`", f.dataType) for f in df.schema.fields)
    watched = df.observe(seen, F.expr("count(1) AS rows"), F.expr(f"sum(CAST({width} AS BIGINT)) AS bytes"),
                         *[F.expr(f"{sql} AS {name}") for name, sql in aggregates.items()])
    table = watched.checkpoint(eager=True)
    figures = seen.get
    return Measured(table, figures["rows"], figures["bytes"] or 0, {a: figures[a] for a in aggregates})
