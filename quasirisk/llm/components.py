"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store


def connected_components(edges: DataFrame, store: Store, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternates two steps until nothing changes.  Large star: each node links its larger
    neighbours to its smallest one.  Small star: each node links its smaller neighbours to
    the smallest.  Both keep connectivity, and the number of rounds grows with the log of
    the longest path.  Minima are combinable aggregates; the joins back are on single
    nodes, whose hot partitions adaptive execution can split.  Each round is a written
    table, so nothing is recomputed after the loss of an executor.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = store.keep(edges, f"{name}_0")
    before, round_ = None, 0
    while True:
        round_ += 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        star = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Nodes without a larger neighbour keep their link through the small star's input.
        star = star.filter("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("low"))
        linked = star.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = store.keep(linked.filter("a <> b").distinct(), f"{name}_{round_}")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if round_ > 1:
            store.drop(f"{name}_{round_ - 1}")
        edges = now
        if state == before:
            break
        before = state
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
