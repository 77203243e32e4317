"""Mixing sources to target weights by apportioning blocks of words.

Targets share the size of the corpus by weight; no source may be taken more than a few
times.  The targets are votes, blocks of equal size are seats, and seats go to the highest
quotients votes / 1, 3, 5, ... (Sainte-Laguë), first to sources, then to the shards of each
source.  A shard lays its documents end to end in seeded order, cuts them into blocks and
takes as many as its quota says: whole passes first, then blocks at seeded, even steps.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quasirisk.llm.store import Store
from quasirisk.llm.text import WORD

#: Words of a block at most, blocks of the smallest source at least, and rows of a shard on average.
BLOCK, LEAST_BLOCKS, SHARD_ROWS = 64, 1000, 256
WEIGHTS, LIMIT = (1, 2, 3), 3


def with_rank(df: DataFrame, order: list[Column], store: Store, name: str, into: str = "rank_") -> DataFrame:
    """Add the 0-based position in a total order, without one task that sorts everything.

    Ranges are sorted apart; the counts of the ranges before are added.  ``order`` has to be
    unique, so that no range is held together by equal rows.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.keep(df.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), name)
    before = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    bases = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return dealt.withColumn("at_", inside).join(F.broadcast(bases), "range_").withColumn(into, F.col("at_") + F.col("base_")).drop("range_", "at_", "base_")


def apportion(cells: DataFrame, store: Store, name: str) -> DataFrame:
    """Add ``seats`` to rows (group, cell, votes, total): the group's ``total`` by highest quotients.

    Groups and cells are NULL-free and cells are unique in their group.  All but a few seats are
    certain: with V votes and C cells, a divisor of V / (total -+ (C + 2) / 2) gives too few or
    too many, and at most 2 C + 4 quotients lie between the two.  Those are ranked, and ties go
    to the lower cell.  Groups without votes get no seats.
    """
    cells = cells.filter("votes > 0 AND total > 0")
    stats = cells.groupBy("group").agg(F.sum("votes").alias("all_"), F.count(F.lit(1)).alias("cells_"))
    slack = F.col("cells_") / 2 + 1
    few = F.when(F.col("total") > slack, F.floor(F.col("votes") * (F.col("total") - slack) / F.col("all_") + 0.5)).otherwise(F.lit(0))
    many = F.floor(F.col("votes") * (F.col("total") + slack) / F.col("all_") + 0.5)
    bounded = cells.join(stats, "group").withColumns({"few_": few.cast("long"), "many_": many.cast("long")})
    bounded = store.keep(bounded.select("group", "cell", "votes", "total", "few_", "many_"), f"{name}_bounded")
    open_ = bounded.filter("many_ > few_").select("group", "cell", "votes", F.explode(F.expr("sequence(few_, many_ - 1)")).alias("seat"))
    quotient = F.col("votes") / (2 * F.col("seat") + 1)
    ranked = with_rank(open_.withColumn("quotient", quotient), [F.col("group"), F.desc("quotient"), F.col("cell"), F.col("seat")], store, f"{name}_open")
    ranked = store.keep(ranked, f"{name}_ranked")
    groups = bounded.groupBy("group").agg((F.max("total") - F.sum("few_")).alias("left_"))
    groups = groups.join(ranked.groupBy("group").agg(F.min("rank_").alias("first_")), "group")
    won = ranked.join(groups, "group").filter("rank_ - first_ < left_").groupBy("group", "cell").agg(F.count(F.lit(1)).alias("won_"))
    seats = (F.col("few_") + F.coalesce("won_", F.lit(0))).alias("seats")
    return bounded.join(won, ["group", "cell"], "left").select("group", "cell", "votes", "total", seats)


def shared_targets(sources: DataFrame, total: int, limit: int) -> DataFrame:
    """Add ``target`` to rows (weight, source_size): ``total`` by weight, at most ``limit`` sizes.

    What a full source cannot take goes to the others by weight until none is above.  The level
    (target for a weight of 1) only rises, so each round is one aggregate and the driver holds
    three numbers.
    """
    level = Fraction(0)
    while True:
        # Full: limit * size <= level * weight, in whole numbers.
        full = F.lit(limit) * F.col("source_size").cast("decimal(38,0)") * F.lit(level.denominator).cast("decimal(38,0)") <= F.col(
            "weight"
        ) * F.lit(level.numerator).cast("decimal(38,0)")
        held = sources.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if not held["weight"]:
            break
        raised = Fraction(total - limit * (held["full"] or 0), held["weight"])
        if raised <= level:
            break
        level = raised
    share = F.col("weight") * F.lit(level.numerator).cast("double") / F.lit(level.denominator).cast("double")
    return sources.withColumn("target", F.when(full, F.lit(limit) * F.col("source_size").cast("double")).otherwise(share))


def seeded(seed: int, *parts: Column) -> Column:
    """Digest of the seed and the parts; NULLs count as their own value."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))


def number(digest: Column) -> Column:
    """First 15 hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK,
    least_blocks: int = LEAST_BLOCKS, shard_rows: int = SHARD_ROWS, seed: int = 13,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of (doc_id, text, source).

    ``size`` is the number of words; sources in code-point order, NULL last, have the
    ``weights`` in turn.  ``target`` is the source's share of all words, ``taken`` the words
    the mix takes from the document, repeats counted: at most ``limit`` times its size.

    Blocks have ``block`` words, or fewer so that the smallest target still has
    ``least_blocks`` of them (one word at least); a source misses its target by about one
    block per shard.  The result depends on the seed and the rows alone, not on their order
    or partitions.  NULL and empty texts have size 0 and are taken 0 times; a NULL doc_id is
    an id like any other; rows with equal doc_id, source and size are interchangeable, and
    what is taken is dealt out among them; other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, "mixing")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # Equal rows travel as one with a count.
    sized = docs.select("doc_id", "source", words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    sized = store.keep(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    sources = with_rank(sources, [F.col("source").asc_nulls_last()], store, "sources", "cell")
    weight = F.array(*map(F.lit, weights))[(F.col("cell") % len(weights)).cast("int")].cast("long")
    sources = store.keep(sources.withColumn("weight", weight), "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = store.keep(shared_targets(sources, total, limit), "targets")
    smallest = targets.filter("target > 0").agg(F.min("target")).first()[0] or 0
    block = max(1, min(block, int(smallest // least_blocks)))
    votes = targets.select(F.lit(0).alias("group"), "cell", F.col("target").alias("votes"), F.lit(round(total / block)).alias("total"))
    quotas = apportion(votes, store, "by_source").select("cell", F.col("seats").alias("quota"))

    shards = F.ceil(F.col("rows") / shard_rows).cast("long").alias("shards")
    known = targets.join(quotas, "cell", "left").select(
        F.col("source").alias("source_"), F.col("cell").alias("group"), "source_size", "target", shards, F.coalesce("quota", F.lit(0)).alias("quota")
    )
    digest = seeded(seed, F.col("doc_id"), F.col("size"))
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("digest", digest)
    # The shard's number is hashed anew, so that it says nothing about the order inside.
    placed = store.keep(placed.withColumn("cell", number(seeded(seed + 1, F.col("digest"))) % F.col("shards")), "placed")
    held = placed.groupBy("group", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("votes"), F.max("quota").alias("total"))
    cells = apportion(held, store, "by_shard").select("group", "cell", F.col("votes").alias("words"), F.col("seats").alias("quota_"))

    big = lambda c: c.cast("decimal(38,0)")
    blocks = F.ceil(F.col("words") / block).cast("long")
    cells = cells.withColumns({"blocks": blocks, "quota_": F.least(F.col("quota_"), limit * blocks)})
    cells = cells.withColumns({
        "passes": F.expr("quota_ div blocks"), "extra": F.col("quota_") % F.col("blocks"),
        "phase": number(seeded(seed + 2, F.col("group"), F.col("cell"))) % F.col("blocks"),
    })
    inside = Window.partitionBy("group", "cell").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size")
    run = F.col("size") * F.col("copies")
    laid = placed.withColumn("end_", F.sum(run).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    laid = laid.withColumn("begin_", F.col("end_") - run).join(cells, ["group", "cell"], "left")
    laid = laid.withColumn("copy_", F.explode(F.expr("sequence(1L, copies)")))
    start = F.col("begin_") + (F.col("copy_") - 1) * F.col("size")

    def steps(i: Column) -> Column:
        """Seeded, even steps: how often a step of extra / blocks has passed a whole number by block i."""
        return F.floor((big(i) * big(F.col("extra")) + big(F.col("phase"))) / big(F.col("blocks"))).cast("long")

    def picked(words: Column) -> Column:
        """Words of the extra blocks among the first ``words`` of the shard."""
        i = F.floor(words / F.lit(block)).cast("long")
        whole = steps(i - 1) - steps(F.lit(-1).cast("long"))
        return whole * block + (steps(i) - steps(i - 1)) * (words - i * block)

    taken = F.col("passes") * F.col("size") + picked(start + F.col("size")) - picked(start)
    return laid.select(
        "doc_id", "source", "size", "source_size", "target",
        F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )
