"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text handed to a Python worker at once, so that very long documents come a few at a time.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the session's warehouse.

    The warehouse is shared on a cluster unless it is a local path, which is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_work"


class Store:
    """Intermediate tables of one run, below one fresh folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # Long texts: bound what one Arrow batch holds.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut and survives lost executors."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no result reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(
    df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list]]
) -> DataFrame:
    """``mapInArrow`` whose function is made once per task, for state such as caches."""

    def run(batches):
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def summed_parts(partials: DataFrame) -> dict:
    """Sums by part of rows (part int, values array<float or double>), as arrays by part.

    For statistics of a fixed size: each task sends one row per part, parts are added up in
    parallel, and the driver receives one array per part.
    """
    import numpy as np

    def add_up(batches):
        held: dict = {}
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[part] = held.get(part, 0) + values.values.to_numpy().astype(np.float64)
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), kind)], names=["part", "values"])

    added = partials.repartition("part").mapInArrow(add_up, "part int, values array<double>")
    return {row["part"]: np.array(row["values"]) for row in added.collect()}
